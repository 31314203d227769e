"""The driver's queries of the engine's own operators, with SQL for DuckDB where SQL can express the rows.

The tables hold no marks, so most queries read a planted view of documents, built by functions that both engines share. The
SQL states the rows in another way than the operators find them: what each planted case must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .operators import characters, containers, detectors, gumbel, modelbound, stylometry
from .operators.characters import Options
from .plans import pipeline

KEY = "example-key"
ZWSP, NBSP, WIDE, SHY = "\u200b", "\u00a0", "\u3000", "\u00ad"
LOOKS = "\u0430\u0435\u043e\u0440\u0441"
BIDI_TAIL = " \u202bq\u202c \u200e\u2066x\u2069"
EMOJI = " \u2764\ufe0f\u200d\U0001f525 a\ufe0f \U0001f468\u200d\U0001f469 x\u200dy"
EMOJI_CLEAN = " \u2764\ufe0f\u200d\U0001f525 a \U0001f468\u200d\U0001f469 xy"
FLAGS = " \U0001f3f4\U000e0067\U000e0062\U000e007f ok \U0001f3f4\U000e0067 bad \U000e0001\U000e0041"
FLAGS_CLEAN = " \U0001f3f4\U000e0067\U000e0062\U000e007f ok \U0001f3f4 bad "
SCRIPTS = " \u0645\u06cc\u200c\u0631\u0648\u0645 \u0915\u094d\u200d\u0937 iso\u200c \u1820\u180b \u1780\u17b4 \u1100\u1160 stray\u1160"
SCRIPTS_CLEAN = " \u0645\u06cc\u200c\u0631\u0648\u0645 \u0915\u094d\u200d\u0937 iso \u1820\u180b \u1780\u17b4 \u1100\u1160 stray"
ODD = "\ue000\ufdd0\u2065\U000f0000\U0001ffff \U00013000\U00013430 \U00013430x"
ODD_CLEAN = " \U00013000\U00013430 x"
AI_HEAD = "It is important to note that we delve into a myriad of topics. Furthermore, "
AI_TAIL = " In conclusion, a holistic approach plays a pivotal role. As an AI, I hope this helps."


def _case(**by: str) -> str:
    return "CASE doc_id % 12 " + " ".join(f"WHEN {k[1:]} THEN {v}" for k, v in by.items()) + " ELSE text END"


PLANTED = _case(
    k1=f"replace(text, 'e ', 'e{ZWSP} ')", k2=f"concat('\u202e', substr(text, 1, 20), '\u202c', substr(text, 21), '{BIDI_TAIL}')", k3=f"replace(replace(text, ' a', '{NBSP}a'), ' l', '{WIDE}l')",
    k4=f"translate(text, 'aeopc', '{LOOKS}')", k5=f"concat(text, '{EMOJI}')", k6=f"concat(text, '{FLAGS}')", k7=f"replace(text, 'er', 'e{SHY}r')", k8=f"concat(text, '{SCRIPTS}')",
    k9=f"concat('\ufeff', text, '{ODD}')", k10=f"concat('{AI_HEAD}', text, '{AI_TAIL}')", k11="concat(text, '\n```\n', substr(text, 1, 200), '\n```\n')",
)
#: What default cleaning must leave of each planted case.
CLEANED = {
    "k1": "text", "k2": f"concat(text, '{BIDI_TAIL}')", "k3": "text", "k4": PLANTED, "k5": f"concat(text, '{EMOJI_CLEAN}')", "k6": f"concat(text, '{FLAGS_CLEAN}')", "k7": "text",
    "k8": f"concat(text, '{SCRIPTS_CLEAN}')", "k9": f"concat(text, '{ODD_CLEAN}')", "k10": PLANTED, "k11": PLANTED,
}
VIEW = f"WITH p AS (SELECT doc_id, lang, text, {PLANTED} AS t FROM documents)"
#: Characters that inspection reports in each planted case: case, kind and count.
REPORTED = [
    (1, "zwj_family", "length(t) - length(text)"), (2, "bidi", "7"), (3, "space", f"length(t) - length(replace(replace(t, '{NBSP}', ''), '{WIDE}', ''))"), (5, "variation_selector", "1"), (5, "zwj_family", "1"),
    (6, "tag_chars", "3"), (7, "strip", "length(t) - length(text)"), (8, "zwj_family", "1"), (8, "strip", "1"), (9, "zwj_family", "1"), (9, "private_use", "2"), (9, "noncharacter", "2"), (9, "reserved_ignorable", "1"), (9, "other_cf", "1"),
]
HITS = VIEW + ", h AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{kind}' AS kind, CAST({n} AS BIGINT) AS n FROM p WHERE doc_id % 12 = {k}" for k, kind, n in REPORTED) + "), hits AS (SELECT * FROM h WHERE n > 0)"
STATUS = """, d AS (SELECT p.doc_id, p.lang, x.detector,
  coalesce(sum(n) FILTER (WHERE x.detector = 'unicode-invisible' AND kind NOT IN ('bidi', 'space') OR x.detector = 'bidi-controls' AND kind = 'bidi'), 0) AS strong,
  coalesce(sum(n) FILTER (WHERE x.detector = 'homoglyph' AND kind = 'space'), 0) AS weak
  FROM p CROSS JOIN (VALUES ('unicode-invisible'), ('bidi-controls'), ('homoglyph')) x(detector) LEFT JOIN hits USING (doc_id) GROUP BY ALL),
 s AS (SELECT doc_id, lang, detector, CASE WHEN strong > 0 THEN 'detected' WHEN weak > 0 THEN 'uncertain' ELSE 'clean' END AS status, CAST(strong + weak AS DOUBLE) AS score FROM d)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", F.expr(PLANTED).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language, detector and status."""
    docs = planted(spark, sf_dir)
    rows = detectors.text_results(docs).select(F.col("input_id").alias("doc_id"), "detector", "status").join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang", "detector", "status").agg(F.count("*").alias("n"))


def char_hits(spark, sf_dir):
    return characters.hits(planted(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.sum("count").alias("n"))


def char_hit_totals(spark, sf_dir):
    docs = planted(spark, sf_dir)
    return characters.hits(docs).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "kind").agg(F.sum("count").alias("n"))


def char_hits_topk(spark, sf_dir):
    """The feature is a report of the five most frequent code points."""
    return characters.hits(planted(spark, sf_dir)).groupBy("codepoint", "kind").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "codepoint").limit(5)


def _clean(o: Options):
    return lambda spark, sf_dir: characters.clean(planted(spark, sf_dir), o).select("doc_id", F.md5("cleaned").alias("cleaned_md5"), F.col("output_length").cast("long").alias("output_length"))


def char_clean_stats(spark, sf_dir):
    return characters.clean(planted(spark, sf_dir)).select("doc_id", F.col("removed_count").cast("long").alias("removed"), F.col("replaced_count").cast("long").alias("replaced"))


def clean_labels(spark, sf_dir):
    return characters.clean_stats(planted(spark, sf_dir)).groupBy("label", "action").agg(F.sum("n").alias("n"))


def inspect_reports(spark, sf_dir):
    return characters.inspect(planted(spark, sf_dir)).select("doc_id", F.col("length").cast("long").alias("length"), F.col("suspicious_total").cast("long").alias("suspicious_total"), F.size("notes").cast("long").alias("n_notes"))


def flag_tags(spark, sf_dir):
    """Tag characters that a complete flag keeps."""
    return characters.kept(planted(spark, sf_dir), C.TAGS)


def bidi_pairs(spark, sf_dir):
    chars = characters.decide(planted(spark, sf_dir)).select("doc_id", "pos", "cp")
    return characters.valid_bidi_pairs(chars, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


def glue_preservation(spark, sf_dir):
    return characters.kept(planted(spark, sf_dir), C.GLUE)


def detectors_character(spark, sf_dir):
    rows = detectors.text_results(planted(spark, sf_dir)).where("layer = 'character'")
    return rows.select(F.col("input_id").alias("doc_id"), "detector", "status", "score")


def detector_matrix(spark, sf_dir):
    return detectors.text_results(planted(spark, sf_dir), KEY).select(F.col("input_id").alias("doc_id"), "detector", "layer", "status", "requires_key", "requires_model", "local", "heuristic")


def summary_by_input(spark, sf_dir):
    return detectors.summarize(detectors.text_results(planted(spark, sf_dir))).select(F.col("input_id").alias("doc_id"), "character", "metadata", "statistical", "n_errors")


def summary_by_lang(spark, sf_dir):
    docs = planted(spark, sf_dir)
    return summary_by_input(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "character").agg(F.count("*").alias("n"))


def compare_before_after(spark, sf_dir):
    rows = pipeline.clean_and_reinspect(planted(spark, sf_dir), wanted=lambda d: d.layer == "character")
    return rows.select(F.col("input_id").alias("doc_id"), "detector", "before_status", "after_status", "delta", "same", "same_status")


def overall_effect(spark, sf_dir):
    """Heuristics, which the effect does not count, are not run."""
    rows = pipeline.clean_and_reinspect(planted(spark, sf_dir), wanted=lambda d: not d.heuristic)
    return detectors.overall_effect(rows).select(F.col("input_id").alias("doc_id"), "statistical_effect", "residual_character")


def words(spark, sf_dir):
    w = stylometry.words(F.col("text"))
    return planted(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


def sentences(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", F.size(stylometry.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def burstiness(spark, sf_dir):
    b = stylometry.burstiness(stylometry.sentences(F.col("text")))
    return planted(spark, sf_dir).select("doc_id", b.alias("b")).select("doc_id", F.round("b.mean_len", 5).alias("mean_len"), F.round("b.cv", 5).alias("cv"))


def mattr(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", F.round(stylometry.mattr(stylometry.words(F.col("text"))), 6).alias("mattr"))


def mattr_by_windows(spark, sf_dir):
    return stylometry.mattr_by_windows(planted(spark, sf_dir)).select("doc_id", F.round("mattr", 6).alias("mattr"))


def ai_phrases(spark, sf_dir):
    found = planted(spark, sf_dir).select("doc_id", F.explode(stylometry.phrase_matches(F.col("text"))).alias("m"))
    return found.select("doc_id", F.col("m.phrase").alias("phrase"), F.col("m.count").cast("long").alias("n"))


def stylometry_score(spark, sf_dir):
    return stylometry.score(planted(spark, sf_dir)).select("doc_id", "word_count", "sentence_count", "burstiness_cv", "lexical_diversity", "ai_ngram_density", "score", "confidence_level", "status")


FINDINGS = ["PNG chunk caBX (possible C2PA container)", "JPEG APP1: c2pa, http://ns.adobe.com/xmp/InstanceID/", "TIFF tag 305 (Software) present", "PNG tEXt: AI generator (Software=ChatGPT)", "truncated chunk b''IDAT''", "byte-scan C2PA markers: jumb", "info: nothing", "AVIF XMP uuid box", "not a valid AVIF (no ISOBMFF boxes found)", "GIF comment extension present", "exif: trainedAlgorithmicMedia"]
FINDING = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FINDINGS)) + " END"


def _findings(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(FINDING.replace("b''IDAT''", "b\\'IDAT\\'")).alias("finding"))


def finding_confidence(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", stylometry.finding_confidence(F.col("finding")).alias("confidence"))


def metadata_buckets(spark, sf_dir):
    return detectors.bucket_findings(_findings(spark, sf_dir)).select("doc_id", "bucket")


def gumbel_tokens(spark, sf_dir):
    ids = gumbel.token_ids(gumbel.tokens(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.md5(F.array_join(ids, "")).alias("ids_md5"))


def gumbel_windows(spark, sf_dir):
    return gumbel.windows(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("is_first").cast("long")).alias("counted"))


def gumbel_statistic(spark, sf_dir):
    rows = gumbel.detect(documents(spark, sf_dir), KEY)
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("tokens_total", "skipped_no_context", "skipped_repeated", "counted")], F.round("statistic", 5).alias("statistic"))


def gumbel_verdict(spark, sf_dir):
    return gumbel.detect(documents(spark, sf_dir), KEY).select("doc_id", "is_watermarked", F.round("p_value", 6).alias("p_value"))


PAGE_HINT = "concat(html, CASE page_id % 4 WHEN 1 THEN 'made with C2PA and cai:' WHEN 2 THEN 'Generated by OpenAI' ELSE '' END)"


def hint_scan_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(PAGE_HINT).alias("h"))
    return pages.select("page_id", F.array_join(containers.contains_any(F.col("h"), C.ALL_HINTS), ",").alias("hits"))


SIGNS = ["89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "000000186674797061766966", "00000018667479706D696631", "424D", "474946383961", "4D4D002A"]
FORMATS = ["png", "jpeg", "webp", "avif", "heic", "bmp", "gif", "tiff"]
SIGNED = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SIGNS)) + " ELSE '' END"


def _blobs(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.concat(F.unhex(F.expr(SIGNED)), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))


def format_sniff(spark, sf_dir):
    return _blobs(spark, sf_dir).select("doc_id", containers.sniff_column(F.col("content")).alias("format"))


def _pngs(spark, sf_dir) -> DataFrame:
    """A PNG per document: header, a text chunk with the document's text, end. Checksums are not looked at."""
    def chunk(kind: str, data: Column) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), F.encode(F.lit(kind), "US-ASCII"), data, F.unhex(F.lit("00000000")))

    text = F.concat(F.encode(F.when(F.col("doc_id") % 2 == 0, "Software").otherwise("Comment"), "US-ASCII"), F.unhex(F.lit("00")), F.encode(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, " ChatGPT").otherwise("")), "UTF-8"))
    body = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), chunk("IHDR", F.unhex(F.lit("00000001000000010806000000"))), chunk("tEXt", text), chunk("IEND", F.unhex(F.lit(""))))
    return documents(spark, sf_dir).select("doc_id", body.alias("content"))


def image_inspect(spark, sf_dir):
    return containers.inspect(_pngs(spark, sf_dir), keep=("doc_id",)).select("doc_id", "format", "has_c2pa", "has_ai_metadata", F.size("findings").cast("long").alias("n_findings"))


def image_clean(spark, sf_dir):
    rows = containers.clean(_pngs(spark, sf_dir), keep=("doc_id",))
    return rows.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.array_join("actions", ";").alias("actions"))


def file_detectors(spark, sf_dir):
    rows = detectors.file_results(containers.inspect(_pngs(spark, sf_dir), keep=("doc_id",)), "doc_id").where("layer = 'metadata'")
    return rows.select(F.col("input_id").alias("doc_id"), "detector", "status")


def nfkc_clean(spark, sf_dir):
    return characters.clean(planted(spark, sf_dir), Options(nfkc=True)).select("doc_id", F.md5("cleaned").alias("cleaned_md5"), "nfkc_changed")


def kgw_verdict(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 100).alias("green"), (20 + F.col("doc_id") * 7 % 200).alias("scored"))
    return modelbound.kgw_verdict(rows).select("doc_id", F.round("z_score", 6).alias("z_score"), "status")


THRESHOLDS = {50: 0.9, 100: 0.6, 200: 0.4, 400: 0.3}


def synthid_threshold_bucket(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 100 / 100).alias("posterior"), (F.col("doc_id") * 3 % 500).alias("scored"))
    return modelbound.synthid_verdict(rows, THRESHOLDS).select("doc_id", F.col("bucket").cast("long").alias("bucket"), "threshold", "status")


def reports(spark, sf_dir):
    rows = pipeline.report(detectors.text_results(planted(spark, sf_dir), KEY), key_supplied=True)
    return rows.select(F.col("input_id").alias("doc_id"), F.get_json_object("report", "$.settings.key_supplied").alias("key_supplied"), F.get_json_object("report", "$.summary.character").alias("character"), F.contains("report", F.lit(KEY)).alias("leaks"))


QUERIES = {
    "flagship": flagship, "char_hits": char_hits, "char_hit_totals": char_hit_totals, "char_hits_topk": char_hits_topk, "inspect_reports": inspect_reports,
    "char_clean_default": _clean(Options()), "char_clean_aggressive": _clean(Options(aggressive=True)), "char_clean_paranoid": _clean(Options(aggressive=True, strip_glue=True, strip_bidi=True)),
    "char_clean_keep_spaces": _clean(Options(normalize_spaces=False)), "char_clean_strip_bidi": _clean(Options(strip_bidi=True)), "char_clean_stats": char_clean_stats, "clean_labels": clean_labels,
    "flag_tags": flag_tags, "bidi_pairs": bidi_pairs, "glue_preservation": glue_preservation, "detectors_character": detectors_character, "detector_matrix": detector_matrix,
    "summary_by_input": summary_by_input, "summary_by_lang": summary_by_lang, "compare_before_after": compare_before_after, "overall_effect": overall_effect, "words": words, "sentences": sentences,
    "burstiness": burstiness, "mattr": mattr, "mattr_by_windows": mattr_by_windows, "ai_phrases": ai_phrases, "stylometry_score": stylometry_score, "finding_confidence": finding_confidence,
    "metadata_buckets": metadata_buckets, "gumbel_tokens": gumbel_tokens, "gumbel_windows": gumbel_windows, "gumbel_statistic": gumbel_statistic, "gumbel_verdict": gumbel_verdict,
    "hint_scan_pages": hint_scan_pages, "format_sniff": format_sniff, "image_inspect": image_inspect, "image_clean": image_clean, "file_detectors": file_detectors, "nfkc_clean": nfkc_clean,
    "kgw_verdict": kgw_verdict, "synthid_threshold_bucket": synthid_threshold_bucket, "reports": reports,
}


def _cleaned_sql(over: dict[str, str] | None = None) -> str:
    return f"SELECT doc_id, md5(c) AS cleaned_md5, CAST(length(c) AS BIGINT) AS output_length FROM (SELECT doc_id, {_case(**{**CLEANED, **(over or {})})} AS c FROM documents)"


_BARE = {
    "k2": "concat(text, ' q x')", "k4": "text", "k5": "concat(text, ' \u2764\U0001f525 a \U0001f468\U0001f469 xy')", "k6": "concat(text, ' \U0001f3f4 ok \U0001f3f4 bad ')",
    "k8": "concat(text, ' \u0645\u06cc\u0631\u0648\u0645 \u0915\u094d\u0937 iso \u1820 \u1780 \u1100 stray')", "k9": "concat(text, ' \U00013000 x')",
}
_WORDS = r"regexp_extract_all(t, '[\p{L}\p{N}_](?:[''\-\p{L}\p{N}_]*[\p{L}\p{N}_])?')"
_SENTENCES = VIEW + r""", o AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '(?m)^[ \t]*```[^\n]*'), lambda x, i: i % 2 = 1) AS parts FROM p),
 s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(array_to_string(parts, chr(10)), '([.!?])[\s\x{00a0}\x{3000}]+', '\1' || chr(10), 'g'), '\n+')) AS s FROM o), q AS (SELECT doc_id, s FROM s WHERE trim(s, ' ' || chr(9) || chr(10) || chr(160) || chr(12288)) <> '')"""
_PHRASE_ROWS = ", ".join("('" + p.replace("'", "''") + f"', '{n.replace(chr(39), chr(39) * 2)}')" for p, n, _ in C.PHRASES)
_MATTR = VIEW + f""", w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: lower(x)) AS ws FROM p), e AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
 l AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id, w ORDER BY i), -1) AS b FROM e),
 m AS (SELECT doc_id, CASE WHEN n <= 50 THEN count(DISTINCT w) / CAST(n AS DOUBLE) ELSE sum(greatest(0, least(i, n - 50) - greatest(0, i - 49, b + 1) + 1)) / (50.0::DOUBLE * (n - 49)) END AS v FROM l GROUP BY doc_id, n)
 SELECT p.doc_id, round(coalesce(v, 0), 6) AS mattr FROM p LEFT JOIN m USING (doc_id)"""
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_ALL = "('unicode-invisible'), ('bidi-controls'), ('homoglyph')"
_AFTER = f""", a AS (SELECT doc_id, detector, CASE WHEN detector = 'bidi-controls' AND doc_id % 12 = 2 THEN 'detected' ELSE 'clean' END AS after_status, CASE WHEN detector = 'bidi-controls' AND doc_id % 12 = 2 THEN 5.0 ELSE 0.0 END AS after_score FROM s)"""
_NUMBERS = "SELECT doc_id, doc_id % 100 AS green, 20 + doc_id * 7 % 200 AS scored FROM documents"

#: Whether a generator key's value names a generator; planted, or as part of a word of the text.
_MADE = f"SELECT doc_id, doc_id % 4 = 0 OR doc_id % 2 = 0 AND len(list_filter({C.GENERATORS!r}, lambda g: contains(lower(text), lower(g)))) > 0 AS made FROM documents"

ORACLES: dict[str, str] = {
    "char_hits": HITS + " SELECT doc_id, kind, n FROM hits",
    "char_hit_totals": HITS + " SELECT lang, kind, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY lang, kind",
    "inspect_reports": HITS + " SELECT p.doc_id, CAST(length(t) AS BIGINT) AS length, CAST(coalesce(sum(n), 0) AS BIGINT) AS suspicious_total, CAST(CASE WHEN sum(n) > 0 THEN 2 ELSE 3 END AS BIGINT) AS n_notes FROM p LEFT JOIN hits USING (doc_id) GROUP BY p.doc_id, t",
    "char_clean_default": _cleaned_sql(),
    "char_clean_aggressive": _cleaned_sql({"k4": "text"}),
    "char_clean_paranoid": _cleaned_sql(_BARE),
    "char_clean_keep_spaces": _cleaned_sql({"k3": PLANTED}),
    "char_clean_strip_bidi": _cleaned_sql({"k2": "concat(text, ' q x')"}),
    "char_clean_stats": HITS + " SELECT p.doc_id, CAST(coalesce(sum(CASE WHEN kind = 'bidi' THEN 2 WHEN kind <> 'space' THEN n END), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE kind = 'space'), 0) AS BIGINT) AS replaced FROM p LEFT JOIN hits USING (doc_id) GROUP BY p.doc_id",
    "flag_tags": "SELECT doc_id, CAST(3 AS BIGINT) AS kept, CAST(2 AS BIGINT) AS stripped FROM documents WHERE doc_id % 12 = 6",
    "bidi_pairs": "SELECT doc_id, CAST(2 AS BIGINT) AS n FROM documents WHERE doc_id % 12 = 2",
    "glue_preservation": "SELECT doc_id, CAST(CASE doc_id % 12 WHEN 5 THEN 3 WHEN 6 THEN 3 WHEN 8 THEN 5 END AS BIGINT) AS kept, CAST(2 AS BIGINT) AS stripped FROM documents WHERE doc_id % 12 IN (5, 6, 8)",
    "detectors_character": HITS + STATUS + " SELECT doc_id, detector, status, score FROM s",
    "summary_by_input": HITS + STATUS + " SELECT doc_id, CASE WHEN bool_or(status = 'detected') THEN 'detected' WHEN bool_or(status = 'uncertain') THEN 'uncertain' ELSE 'clean' END AS character, 'not_applicable' AS metadata, 'unavailable' AS statistical, CAST(0 AS BIGINT) AS n_errors FROM s GROUP BY doc_id",
    "summary_by_lang": HITS + STATUS + ", v AS (SELECT doc_id, lang, CASE WHEN bool_or(status = 'detected') THEN 'detected' WHEN bool_or(status = 'uncertain') THEN 'uncertain' ELSE 'clean' END AS character FROM s GROUP BY doc_id, lang) SELECT lang, character, count(*) AS n FROM v GROUP BY lang, character",
    "compare_before_after": HITS + STATUS + _AFTER + " SELECT doc_id, detector, status AS before_status, after_status, after_score - score AS delta, status = after_status AND after_score = score AS same, status = after_status AS same_status FROM s JOIN a USING (doc_id, detector)",
    "overall_effect": "SELECT doc_id, 'none' AS statistical_effect, CAST(CASE WHEN doc_id % 12 = 2 THEN 1 ELSE 0 END AS BIGINT) AS residual_character FROM documents",
    "words": VIEW + f" SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, CAST(len(list_distinct(list_transform({_WORDS}, lambda x: lower(x)))) AS BIGINT) AS n_distinct FROM p",
    "sentences": _SENTENCES + " SELECT p.doc_id, count(s) AS n_sentences FROM p LEFT JOIN q USING (doc_id) GROUP BY p.doc_id",
    "burstiness": _SENTENCES + f", n AS (SELECT doc_id, len({_WORDS.replace('(t,', '(s,')}) AS k FROM q) SELECT p.doc_id, round(coalesce(avg(k), 0), 5) AS mean_len, round(CASE WHEN count(k) > 1 THEN stddev_samp(k) / avg(k) END, 5) AS cv FROM p LEFT JOIN (SELECT * FROM n WHERE k > 0) USING (doc_id) GROUP BY p.doc_id",
    "mattr": _MATTR,
    "mattr_by_windows": _MATTR,
    "ai_phrases": VIEW + f", x(pattern, phrase) AS (VALUES {_PHRASE_ROWS}), m AS (SELECT doc_id, phrase, CAST(len(regexp_extract_all(t, '(?i)' || pattern)) AS BIGINT) AS n FROM p CROSS JOIN x) SELECT doc_id, phrase, n FROM m WHERE n > 0",
    "finding_confidence": f"SELECT doc_id, CASE WHEN f LIKE '%png chunk cabx%' OR f LIKE '%trainedalgorithmicmedia%' THEN 'confirmed' WHEN f LIKE 'info:%' OR f LIKE '%truncated chunk%' OR f LIKE '%not a valid%' THEN 'informational' WHEN f LIKE '%byte-scan%' THEN 'likely_false_positive' WHEN f LIKE '%png %' OR f LIKE '%jpeg app%' OR f LIKE '%xmp%' OR f LIKE '%exif%' OR f LIKE '%ai:%' THEN 'probable' ELSE 'informational' END AS confidence FROM (SELECT doc_id, lower({FINDING}) AS f FROM documents)",
    "metadata_buckets": "SELECT doc_id, unnest(CASE doc_id % 11 WHEN 0 THEN ['c2pa'] WHEN 1 THEN ['c2pa', 'xmp'] WHEN 2 THEN ['exif'] WHEN 3 THEN ['ai-generator-marker'] WHEN 5 THEN ['c2pa'] WHEN 7 THEN ['xmp'] WHEN 10 THEN ['exif', 'ai-generator-marker'] ELSE ['other-metadata'] END) AS bucket FROM documents",
    "gumbel_tokens": f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n_tokens, md5(coalesce(array_to_string(list_transform(k, lambda x: sha256(x)[1:16]), ''), '')) AS ids_md5 FROM (SELECT doc_id, {_TOKENS} AS k FROM documents)",
    "gumbel_windows": f"WITH k AS (SELECT doc_id, {_TOKENS} AS k FROM documents), w AS (SELECT doc_id, unnest(list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 3], ' '))) AS w FROM k) SELECT doc_id, count(*) AS n, count(DISTINCT w) AS counted FROM w GROUP BY doc_id",
    "hint_scan_pages": f"SELECT page_id, array_to_string(list_filter({C.ALL_HINTS!r}, lambda n: contains(h, lower(n))), ',') AS hits FROM (SELECT page_id, lower({PAGE_HINT}) AS h FROM pages)",
    "format_sniff": "SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FORMATS)) + " ELSE 'unknown' END AS format FROM documents",
    "image_inspect": f"SELECT doc_id, 'png' AS format, false AS has_c2pa, made AS has_ai_metadata, CAST(made AS BIGINT) AS n_findings FROM ({_MADE})",
    "image_clean": "SELECT doc_id, CAST(45 AS BIGINT) AS n_bytes, 'drop chunk tEXt' AS actions FROM documents",
    "file_detectors": "SELECT doc_id, d AS detector, CASE WHEN d = 'ai-generator-marker' AND made THEN 'detected' ELSE 'clean' END AS status FROM (" + _MADE + ") CROSS JOIN (VALUES ('c2pa'), ('xmp'), ('exif'), ('ai-generator-marker'), ('other-metadata')) x(d)",
    "kgw_verdict": f"WITH n AS ({_NUMBERS}), z AS (SELECT *, (green - 0.25::DOUBLE * scored) / sqrt(scored * 0.1875::DOUBLE) AS z FROM n) SELECT doc_id, round(z, 6) AS z_score, CASE WHEN scored < 50 THEN 'uncertain' WHEN z >= 4 THEN 'detected' WHEN z < 2 THEN 'clean' ELSE 'uncertain' END AS status FROM z",
    "synthid_threshold_bucket": "WITH t(n, thr) AS (VALUES (50, 0.9::DOUBLE), (100, 0.6::DOUBLE), (200, 0.4::DOUBLE), (400, 0.3::DOUBLE)), d AS (SELECT doc_id, doc_id % 100 / 100.0::DOUBLE AS p, doc_id * 3 % 500 AS k FROM documents), b AS (SELECT doc_id, p, k, coalesce(max(n) FILTER (WHERE n <= k), 50) AS bucket FROM d CROSS JOIN t GROUP BY doc_id, p, k) SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, thr AS threshold, CASE WHEN k < 100 THEN 'uncertain' WHEN p >= thr THEN 'detected' WHEN p < 0.12 THEN 'clean' ELSE 'uncertain' END AS status FROM b JOIN t ON t.n = b.bucket",
    "reports": HITS + STATUS + " SELECT doc_id, 'true' AS key_supplied, CASE WHEN bool_or(status = 'detected') THEN 'detected' WHEN bool_or(status = 'uncertain') THEN 'uncertain' ELSE 'clean' END AS character, false AS leaks FROM s GROUP BY doc_id",
}
