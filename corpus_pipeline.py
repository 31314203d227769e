"""The training-data pipeline over the table documents, as stages that each read what the one before kept.

1. language_id: texts without a letter, or in which no learned language shows (limits fitted on labelled rows), go; if none could be learned, every text with a letter stays.
2. line_dedup: later copies of repeated line runs of 50 words or more are deleted; a document that loses all its text goes.
3. simhash: of near copies (five-word shingles, similarity 0.8 or more) the document of the smallest id stays.
4. decontaminate: spans that hold ten consecutive words of a benchmark item are cut out; a document of which more than half is hit goes.
5. bpe: token ids are added, and decoded again: ``decoded_sha256`` is the digest of the bytes they stand for.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscope.llm import bpe, decontaminate, langid, line_dedup, simhash
from markscope.llm._common import ensure_checkpoint_dir, read_table
from markscope.llm.queries import TOKENIZER_FILE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = docs.where(~langid.held_out())
    model = langid.fit_limits(langid.fit_language_filter(labelled), labelled)
    return langid.keep_identified(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    return kept.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"\S")).drop("n_lines_removed")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = simhash.near_duplicates(docs).select("doc_id")
    return docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER_FILE))
    return bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, digest="decoded_sha256").withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("simhash", dedup_near), ("decontaminate", remove_benchmark), ("bpe", encode)]

#: SQL cannot express fitted language models, fingerprints or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
