"""Whole jobs: inspect, clean and inspect again, and report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rows import clean_udf
from ..operators import containers, detectors
from ..operators.characters import Options, cleaned_text
from ..sources.files import cleaned_name


def inspect_texts(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return detectors.text_results(docs, key, id_col=id_col, text=text, **options)


def clean_texts(docs: DataFrame, o: Options = Options(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, cleaned, counts) in one pass without an exchange."""
    return docs.select(id_col, clean_udf(o)(F.col(text)).alias("r")).select(id_col, "r.*")


def clean_and_reinspect(docs: DataFrame, o: Options = Options(), key: str | None = None, id_col: str = "doc_id", text: str = "text", wanted: Callable[[detectors.Detector], bool] | None = None) -> DataFrame:
    """Comparison of the detectors, or of the ``wanted`` ones, before and after cleaning."""
    return detectors.compare_cells(docs, lambda t: cleaned_text(t, o), key, id_col, text, wanted)


def process_files(files: DataFrame, strip_all_metadata: bool = True, o: Options = Options()) -> DataFrame:
    """A row per routed file: cleaned bytes or text, actions and error; nothing is dropped silently."""
    images = containers.clean(files.where("route = 'image'"), strip_all_metadata).select("path", "data", "actions", "error")
    texts = files.where("route = 'text'").select("path", clean_udf(o)(F.decode("content", "UTF-8")).alias("r"))
    texts = texts.select("path", F.encode("r.cleaned", "UTF-8").alias("data"), F.array(F.format_string("removed %d, replaced %d", "r.removed_count", "r.replaced_count")).alias("actions"), F.lit(None).cast("string").alias("error"))
    rest = files.where("route not in ('image', 'text')").select("path", F.lit(None).cast("binary").alias("data"), F.array().cast("array<string>").alias("actions"), F.when(F.col("route") == "server", "needs a server").when(F.col("route") == "too_large", "file is too large").otherwise("unsupported file type").alias("error"))
    return images.unionByName(texts).unionByName(rest).withColumn("cleaned_path", cleaned_name(F.col("path")))


def report(results: DataFrame, key_supplied: bool = False, settings: dict[str, str] | None = None, after: DataFrame | None = None) -> DataFrame:
    """A JSON document per input: settings, results, summary and, with ``after``, the comparison. A key is never written."""
    row = F.struct("detector", "layer", "status", "confidence", "score", "threshold", "evidence", "note", "note_key", "requires_key", "requires_model", "local", "heuristic", "meta")
    ordinal = F.create_map(*[F.lit(x) for i, d in enumerate(C.DETECTORS) for x in (d[0], i)])
    per = results.groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal[F.col("detector")].alias("o"), F.to_json(row).alias("r")))), lambda x: x["r"]).alias("results"))
    out = per.join(detectors.summarize(results), "input_id")
    parts = [F.create_map(*[F.lit(x) for kv in {**(settings or {}), "key_supplied": str(key_supplied).lower()}.items() for x in kv]).alias("settings"), F.from_json(F.concat(F.lit("["), F.array_join("results", ","), F.lit("]")), f"array<{results.select(row.alias('r')).schema['r'].dataType.simpleString()}>").alias("results"), F.struct("character", "metadata", "statistical", "heuristic").alias("summary")]
    if after is not None:
        both = detectors.compare(results, after).groupBy("input_id").agg(F.array_sort(F.collect_list(F.struct("detector", "before_status", "after_status", "delta", "same", "same_status"))).alias("comparison"))
        out = out.join(both, "input_id", "left")
        parts.append(F.col("comparison"))
    return out.select("input_id", F.to_json(F.struct(F.current_timestamp().cast("string").alias("generated_at"), *parts)).alias("report"))
