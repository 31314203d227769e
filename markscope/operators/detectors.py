"""The detector registry, its uniform result rows, verdict roll-up and comparison.

A detector never changes its input; a heuristic never says ``detected``; ``unavailable`` is not ``clean``.
Results of all local text detectors come from one pass over a text, and become a row per detector by one ``explode``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.rows import inspect_udf
from . import characters, gumbel, stylometry

EVIDENCE = "array<struct<label:string,detail:string,offsets:array<int>>>"
FIELDS = ["input_id", "detector", "layer", "status", "confidence", "score", "threshold", "evidence", "note", "note_key", "note_params", "requires_key", "requires_model", "local", "heuristic", "meta"]


@dataclass
class Detector:
    """A registered detector; ``run`` maps inputs to rows of (input_id, status, confidence, score, threshold, evidence, note, note_key, meta)."""

    id: str
    layer: str
    local: bool = True
    requires_key: bool = False
    requires_model: bool = False
    heuristic: bool = False
    kind: str = "text"
    run: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Registry:
    detectors: dict[str, Detector] = field(default_factory=dict)

    def register(self, d: Detector) -> Detector:
        if d.layer not in ("character", "metadata", "statistical") or not d.id:
            raise ValueError("a detector needs an id and a known layer")
        self.detectors[d.id] = d
        return d

    def by_id(self, name: str) -> Detector | None:
        return self.detectors.get(name)

    def list(self, layer: str | None = None) -> list[Detector]:
        return [d for d in self.detectors.values() if layer in (None, d.layer)]


def default_registry() -> Registry:
    out = Registry()
    for name, layer, local, key, model, heuristic in C.DETECTORS:
        out.register(Detector(name, layer, local, key, model, heuristic, "file" if layer == "metadata" else "text"))
    return out


def dimension(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """The registry as a table: one row a detector, in order."""
    rows = [(i, d.id, d.layer, d.local, d.requires_key, d.requires_model, d.heuristic, d.kind) for i, d in enumerate((registry or default_registry()).list())]
    return spark.createDataFrame(rows, "ordinal int, detector string, layer string, local boolean, requires_key boolean, requires_model boolean, heuristic boolean, kind string")


def _cell(name: str, status: Column, score: Column | None = None, confidence: Column | None = None, threshold: Column | None = None, evidence: Column | None = None, note_key: Column | str | None = None, note: Column | None = None, meta: Column | None = None) -> Column:
    number = lambda c: (F.lit(None) if c is None else c).cast("double")
    text = lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")
    return F.struct(
        F.lit(name).alias("detector"), F.when(status.isin(list(C.STATUSES)), status).otherwise("error").alias("status"), number(confidence).alias("confidence"), number(score).alias("score"),
        number(threshold).alias("threshold"), F.coalesce((F.array() if evidence is None else evidence).cast(EVIDENCE), F.array().cast(EVIDENCE)).alias("evidence"), text(note).alias("note"), text(note_key).alias("note_key"),
        (F.create_map().cast("map<string,string>") if meta is None else meta.cast("map<string,string>")).alias("meta"),
    )


def _rows(inputs: DataFrame, cells: list[Column], registry: Registry) -> DataFrame:
    """A result row per input and cell, with the registry's columns from literals."""
    out = inputs.select("input_id", F.explode(F.array(*cells)).alias("r")).select("input_id", "r.*")
    for column, get in (("layer", lambda d: d.layer), ("requires_key", lambda d: d.requires_key), ("requires_model", lambda d: d.requires_model), ("local", lambda d: d.local), ("heuristic", lambda d: d.heuristic)):
        of = F.create_map(*[F.lit(x) for d in registry.list() for x in (d.id, get(d))])
        out = out.withColumn(column, of[F.col("detector")])
    return out.withColumn("note_params", F.lit(None).cast("map<string,string>")).select(*FIELDS)


def _character_cell(name: str, kinds: tuple[str, ...], weak: tuple[str, ...] = ()) -> Column:
    mine = F.filter("_hits", lambda h: h["kind"].isin(list(kinds)))
    strong = F.exists(mine, lambda h: ~h["kind"].isin(list(weak))) if weak else F.size(mine) > 0
    total = F.aggregate(mine, F.lit(0), lambda a, h: a + h["count"])
    status = F.when(F.col("_hits").isNull(), "error").when(F.size(mine) == 0, "clean").when(strong, "detected").otherwise("uncertain")
    detail = lambda h: F.format_string("%s ×%d (%s, %s)", h["label"], h["count"], h["kind"], F.when(h["kind"] == "space", "informational").otherwise("probable"))
    evidence = F.transform(mine, lambda h: F.struct(characters.codepoint(h["cp"]).alias("label"), detail(h).alias("detail"), h["sample_offsets"].alias("offsets")))
    meta = F.create_map(F.lit("length"), F.col("_length").cast("string"), F.lit("kinds"), F.array_join(F.array_distinct(F.transform(mine, lambda h: h["kind"])), ","))
    return _cell(name, status, total, F.when(strong, 1.0), evidence=evidence, note_key=F.when((F.size(mine) > 0) & ~strong, "inspect.noteInformational"), meta=meta)


def _evidence(*pairs: tuple[str, Column]) -> Column:
    empty = F.array().cast("array<int>")
    return F.array(*[F.struct(F.lit(a).alias("label"), b.cast("string").alias("detail"), empty.alias("offsets")) for a, b in pairs])


def text_results(docs: DataFrame, key: str | None = None, window: int = C.GUMBEL_WINDOW, threshold: float = C.GUMBEL_THRESHOLD, aggressive: bool = False, strip_glue: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All detectors' rows for texts: metadata detectors do not apply, model-bound ones are unavailable."""
    return _rows(*text_cells(docs, key, window, threshold, aggressive, strip_glue, id_col, text), default_registry())


def text_cells(docs: DataFrame, key: str | None = None, window: int = C.GUMBEL_WINDOW, threshold: float = C.GUMBEL_THRESHOLD, aggressive: bool = False, strip_glue: bool = False, id_col: str = "doc_id", text: str = "text", wanted: Callable[[Detector], bool] | None = None) -> tuple[DataFrame, list[Column]]:
    """A row per text (``input_id``, ``_t`` and what detectors found) and each detector's result as an expression over it, in the registry's order.

    Detectors that are not ``wanted`` are not run.
    """
    registry = default_registry()
    on = {d.id: wanted is None or wanted(d) for d in registry.list()}
    rows = docs.select(F.col(f"`{id_col}`").alias("input_id"), F.col(f"`{text}`").alias("_t"))
    likely = characters.suspicious(F.col("_t"), characters.Options(aggressive=aggressive))
    # one scan: texts without a suspicious character reach the function as null
    if any(on[d.id] for d in registry.list("character")):
        rows = rows.withColumn("_hits", inspect_udf(aggressive, strip_glue)(F.when(likely, F.col("_t"))))
    rows = rows.withColumn("_length", F.length("_t"))
    cells: dict[str, Column] = {
        "unicode-invisible": _character_cell("unicode-invisible", C.INVISIBLE_KINDS), "bidi-controls": _character_cell("bidi-controls", ("bidi",)), "homoglyph": _character_cell("homoglyph", ("confusable", "space"), ("space",)),
        **{d.id: _cell(d.id, F.lit("not_applicable")) for d in registry.list("metadata")},
    }
    if on["stylometry"]:
        rows, cells["stylometry"] = _style(rows)
    if on["gumbel"]:
        rows, cells["gumbel"] = _replay(rows, key, window, threshold)
    cells |= {x: _cell(x, F.lit("unavailable"), note_key="inspect.noteNoSidecar") for x in ("kgw", "synthid-text")}
    cells |= {"upstream-detect": _cell("upstream-detect", F.lit("unavailable"), note_key="inspect.noteNoServer"), "textseal": _cell("textseal", F.lit("not_tested"), note_key="inspect.noteTextSeal")}
    return rows, [c for name, c in cells.items() if on[name]]


def _style(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with the style report, and its cell; the report is computed from the same row: a few native expressions and two Arrow functions."""
    style = stylometry.score(rows.withColumn("_all", F.struct(*rows.columns)), "_all", "_t")
    rows = style.select("_all.*", F.struct("word_count", "sentence_count", "burstiness_cv", "lexical_diversity", "ai_ngram_density", "matched_markers", "score", "confidence_level", "status", "findings").alias("_s"))
    s = F.col("_s")
    empty = F.array().cast("array<int>")
    style_evidence = F.concat(
        F.filter(_evidence(("burstiness_cv", s["burstiness_cv"]), ("lexical_diversity", s["lexical_diversity"]), ("ai_ngram_density", s["ai_ngram_density"])), lambda e: e["detail"].isNotNull()),
        F.transform(s["matched_markers"], lambda m: F.struct(F.lit("marker").alias("label"), F.format_string("%s ×%d (w=%s)", m["phrase"], m["count"], m["weight"].cast("string")).alias("detail"), empty.alias("offsets"))),
        F.transform(s["findings"], lambda f: F.struct(F.lit("finding").alias("label"), f.alias("detail"), empty.alias("offsets"))),
    )
    return rows, _cell(
        "stylometry", F.when(s["status"] == "insufficient_length", "not_tested").when(s["confidence_level"].isin("HIGH", "MEDIUM"), "uncertain").otherwise("clean"), s["score"], threshold=F.lit(C.STYLE_THRESHOLD),
        evidence=style_evidence, note_key="inspect.noteHeuristic", meta=F.create_map(F.lit("word_count"), s["word_count"].cast("string"), F.lit("sentence_count"), s["sentence_count"].cast("string"), F.lit("confidence_level"), s["confidence_level"], F.lit("status"), s["status"]),
    )


def _replay(rows: DataFrame, key: str | None, window: int, threshold: float) -> tuple[DataFrame, Column]:
    """The rows with the keyed replay's report, if there is a key, and its cell."""
    if key is None or not key.strip():
        return rows, _cell("gumbel", F.lit("unavailable"), note_key="inspect.noteNoGumbelKey")
    try:
        packed = rows.withColumn("_all", F.struct(*rows.columns))
        got = gumbel.detect(packed.select("_all", "_t"), key, window, threshold, id_col="_all", text="_t")
    except ValueError as e:  # bad options become an error row
        return rows, _cell("gumbel", F.lit("error"), note=F.lit(str(e)))
    rows = got.select("_all.*", F.struct(*[c for c in got.columns if c != "_all"]).alias("_g"))
    g = F.col("_g")
    told = _evidence(
        ("p_value", F.format_string("%.3e", g["p_value"])), ("statistic", g["statistic"]), ("counted", F.format_string("%d of %d tokens", g["counted"], g["tokens_total"])),
        ("skipped", F.format_string("%d no-context, %d repeated-window", g["skipped_no_context"], g["skipped_repeated"])),
    )
    some = g["counted"] > 0
    meta = F.create_map(F.lit("window"), g["window"].cast("string"), F.lit("counted"), g["counted"].cast("string"), F.lit("tokens_total"), g["tokens_total"].cast("string"), F.lit("scheme"), F.lit("exp"))
    return rows, _cell("gumbel", F.when(~some, "not_tested").when(g["is_watermarked"], "detected").otherwise("clean"), F.when(some, g["score"]), threshold=F.when(some, -F.log10(g["threshold"])), evidence=F.when(some, told), note_key=F.when(some, "inspect.noteGumbelReplay").otherwise("inspect.noteGumbelShort"), meta=meta)


def bucket_findings(findings: DataFrame, finding: str = "finding") -> DataFrame:
    """A row per finding and bucket; a finding may fall into several buckets, or else into other-metadata."""
    got = F.array_compact(F.array(*[F.when(F.col(finding).rlike(p), F.lit(name)) for name, p in C.BUCKETS.items()]))
    return findings.withColumn("bucket", F.explode(F.when(F.size(got) > 0, got).otherwise(F.array(F.lit("other-metadata")))))


def file_results(reports: DataFrame, id_col: str = "path") -> DataFrame:
    """All detectors' rows for container reports (format, has_c2pa, has_ai_metadata, findings)."""
    registry = default_registry()
    rows = reports.withColumn("input_id", F.col(f"`{id_col}`"))
    def fit(pattern: str):
        return lambda f: f.rlike(pattern)

    fits = {name: fit(p) for name, p in C.BUCKETS.items()}
    empty = F.array().cast("array<int>")
    meta = F.create_map(F.lit("format"), F.col("format"), F.lit("has_c2pa"), F.col("has_c2pa").cast("string"), F.lit("has_ai_metadata"), F.col("has_ai_metadata").cast("string"))
    cells = [_cell(d.id, F.lit("not_applicable")) for d in registry.list("character")]
    for d in registry.list("metadata"):
        if d.id in fits:
            lines = F.filter("findings", fits[d.id])
        else:
            lines = F.filter("findings", lambda f: ~(fits["c2pa"](f) | fits["xmp"](f) | fits["exif"](f) | fits["ai-generator-marker"](f)))
        n, some = F.size(lines), F.size(lines) > 0
        evidence = F.transform(lines, lambda f: F.struct(F.col("format").alias("label"), f.alias("detail"), empty.alias("offsets")))
        if d.id == "c2pa":
            cells.append(_cell(d.id, F.when(F.col("has_c2pa"), "detected").when(some, "uncertain").otherwise("clean"), n, F.when(F.col("has_c2pa"), 1.0), evidence=evidence, meta=meta))
        elif d.id == "ai-generator-marker":
            cells.append(_cell(d.id, F.when(some & F.col("has_ai_metadata"), "detected").when(some, "uncertain").otherwise("clean"), n, F.when(some & F.col("has_ai_metadata"), 1.0), evidence=evidence, meta=meta))
        else:
            plain = F.forall(lines, lambda f: f.rlike(C.STRUCTURAL))
            cells.append(_cell(d.id, F.when(~some | plain, "clean").otherwise("uncertain"), n, evidence=evidence, note_key=F.when(some & plain, "inspect.noteStructural").when(some, "inspect.noteMetadataPresent"), meta=meta))
    cells += [_cell(d.id, F.lit("not_applicable")) for d in registry.list("statistical")]
    return _rows(rows, cells, registry)


def run_registered(inputs: DataFrame, detector: Detector) -> DataFrame:
    """Rows of a detector of one's own, with the registry's columns; an unknown status becomes error."""
    got = detector.run(inputs)
    out = got.withColumn("status", F.when(F.col("status").isin(list(C.STATUSES)), F.col("status")).otherwise("error"))
    if detector.heuristic:
        out = out.withColumn("status", F.when(F.col("status") == "detected", "uncertain").otherwise(F.col("status")))
    kinds = {"confidence": "double", "score": "double", "threshold": "double", "evidence": EVIDENCE, "note": "string", "note_key": "string", "note_params": "map<string,string>", "meta": "map<string,string>"}
    for name, kind in kinds.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    for name in ("layer", "requires_key", "requires_model", "local", "heuristic"):
        out = out.withColumn(name, F.lit(getattr(detector, name)))
    return out.withColumn("detector", F.lit(detector.id)).select(*FIELDS)


def summarize(results: DataFrame) -> DataFrame:
    """Verdicts per input and layer, the heuristic's status, and the number of error rows."""
    layer, status = F.col("layer"), F.col("status")

    def any_of(cond: Column) -> Column:
        return F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1

    def verdict(mine: Column, statistical: bool = False) -> Column:
        has = lambda s: any_of(mine & (status == s))
        all_na = ~any_of(mine & (status != "not_applicable"))
        out = F.when(has("detected"), "detected").when(has("uncertain"), "uncertain")
        if statistical:
            return out.when(has("clean"), "clean").when(all_na, "not_applicable").otherwise("unavailable")
        return out.when(all_na, "not_applicable").otherwise("clean")

    # the first heuristic in the registry's order; one of one's own comes after them
    first = (layer == "statistical") & F.col("heuristic")
    ordinal = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, d in enumerate(C.DETECTORS) for x in (d[0], i)]), F.col("detector")), F.lit(len(C.DETECTORS)))
    return results.groupBy("input_id").agg(
        verdict(layer == "character").alias("character"), verdict(layer == "metadata").alias("metadata"), verdict((layer == "statistical") & ~F.col("heuristic"), True).alias("statistical"),
        F.min_by(F.when(first, status), F.when(first, ordinal)).alias("heuristic"), F.sum((status == "error").cast("long")).alias("n_errors"),
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per input and detector: both statuses and scores, whether the status stayed, the score's change and whether all stayed."""
    b = before.select("input_id", "detector", "layer", "heuristic", F.col("status").alias("before_status"), F.col("score").alias("before_score"))
    a = after.select("input_id", "detector", F.col("status").alias("after_status"), F.col("score").alias("after_score"))
    return _changes(b.join(a, ["input_id", "detector"], "left"))


def _changes(pairs: DataFrame) -> DataFrame:
    out = pairs.withColumn("same_status", F.coalesce(F.col("after_status") == F.col("before_status"), F.lit(False))).withColumn("delta", F.col("after_score") - F.col("before_score"))
    return out.withColumn("same", F.col("same_status") & (F.col("delta").isNull() | (F.abs("delta") < 1e-9)))


def compare_cells(docs: DataFrame, cleaned: Callable[[Column], Column], key: str | None = None, id_col: str = "doc_id", text: str = "text", wanted: Callable[[Detector], bool] | None = None) -> DataFrame:
    """The rows of ``compare`` for texts and what ``cleaned`` makes of them, a text at a time: nothing is dealt out or joined.

    Each row is compared with its own cleaned text, so rows of equal or null id stay apart.
    """

    def told(cells: list[Column]) -> Column:
        return F.array(*[F.struct(c["detector"].alias("detector"), c["status"].alias("status"), c["score"].alias("score")) for c in cells])

    registry = default_registry()
    rows, cells = text_cells(docs, key, id_col=id_col, text=text, wanted=wanted)
    rows = rows.select(F.struct("input_id", told(cells).alias("before")).alias("_id"), cleaned(F.col("_t")).alias("_t"))
    rows, cells = text_cells(rows, key, id_col="_id", text="_t", wanted=wanted)
    pairs = F.zip_with("input_id.before", told(cells), lambda b, a: F.struct(b["detector"].alias("detector"), b["status"].alias("before_status"), b["score"].alias("before_score"), a["status"].alias("after_status"), a["score"].alias("after_score")))
    out = rows.select(F.col("input_id.input_id").alias("input_id"), F.explode(pairs).alias("p"))
    of = {x: F.create_map(*[F.lit(v) for d in registry.list() for v in (d.id, getattr(d, x))]) for x in ("layer", "heuristic")}
    return _changes(out.select("input_id", "p.detector", *[m[F.col("p.detector")].alias(x) for x, m in of.items()], "p.before_status", "p.before_score", "p.after_status", "p.after_score"))


def overall_effect(compared: DataFrame) -> DataFrame:
    """Per input: what cleaning did to the statistical layer (same, same_status, changed or none), and detectors of characters whose row afterwards is missing or not clean. Heuristics do not count."""
    real = (F.col("layer") == "statistical") & ~F.col("heuristic") & F.col("before_status").isin("detected", "clean", "uncertain")
    per = compared.groupBy("input_id").agg(
        F.sum(real.cast("int")).alias("n"), F.sum((real & ~F.col("same")).cast("int")).alias("moved"), F.sum((real & ~F.col("same_status")).cast("int")).alias("changed"),
        F.sum(((F.col("layer") == "character") & F.coalesce(F.col("after_status") != "clean", F.lit(True))).cast("long")).alias("residual_character"),
    )
    return per.select("input_id", F.when(F.col("n") == 0, "none").when(F.col("changed") > 0, "changed").when(F.col("moved") > 0, "same_status").otherwise("same").alias("statistical_effect"), "residual_character")


def shown(results: DataFrame) -> DataFrame:
    """The rows that a report shows: detectors that do not apply to an input are left out."""
    return results.where("status <> 'not_applicable'")


def best_of(scores: DataFrame, key: str = "input_id") -> DataFrame:
    """The best score with its threshold, and whether any row is marked: rows (key, score, threshold, is_watermarked)."""
    return scores.groupBy(key).agg(F.max_by(F.struct("score", "threshold"), "score").alias("b"), (F.max(F.col("is_watermarked").cast("int")) == 1).alias("any_watermarked")).select(key, "b.score", "b.threshold", "any_watermarked")
