import random

from markscope.functions.rows import nfkc
from markscope.operators import characters, detectors
from markscope.operators.characters import Options

MARKS = "\u200b\u200d\u200c\ufe0f\u00a0\u3000\u202a\u202b\u202c\u202e\u2066\u180b\u17b4\u1160\u1100\u1820\u1780\u4e00\u0645\u0430\u2764\U0001f3f4\U000e0067\U000e007f\ue000\u00ad"


def texts(n):
    r = random.Random(9)
    return ["".join(r.choice(MARKS + "ab1 ") for _ in range(r.randrange(1, 25))) for _ in range(n)]


def test_rows_and_windows_agree(spark):
    rows = [(k, t) for k, t in enumerate(texts(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for o in (Options(), Options(aggressive=True, strip_glue=True, strip_bidi=True)):
        want = {k: list(t) for k, t in rows}
        for x in characters.decide(df, o).collect():
            want[x.doc_id][x.pos] = x.out or ""
        got = {x.doc_id: x.cleaned for x in characters.clean(df, o).collect()}
        assert got == {k: "".join(v) for k, v in want.items()}


def test_each_row_is_a_text(spark):
    rows = [(1, "ab\u200bc"), (1, "xy\u200bz"), (None, "p\u200bq"), (None, None), (2, ""), (1, "ab\u200bc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.cleaned or "", x.removed_count) for x in characters.clean(df).collect())
    assert got == [(0, "", 0), (0, "pq", 1), (1, "abc", 1), (1, "abc", 1), (1, "xyz", 1), (2, "", 0)]
    assert sorted(x.suspicious_total for x in characters.inspect(df).collect()) == [0, 0, 1, 1, 1, 1]
    assert characters.hits(df).count() == 4 and characters.clean(df.limit(0)).count() == 0
    assert sorted((x.label, x.n) for x in characters.clean_stats(df).collect()) == [("U+200B ZERO WIDTH SPACE", 1)] * 4


def test_long_texts():
    assert nfkc("\uff21bc " * 20_000) == ("Abc " * 20_000, 20_000)
    # a run of glue is walked once
    from markscope.functions.rows import clean_text

    assert clean_text("\u1100" + "\u1160" * 50_000 + "x")[1] == 0


def test_effect_of_cleaning(spark):
    kind = "input_id long, detector string, layer string, status string, score double, heuristic boolean"
    before = spark.createDataFrame([(1, "stylometry", "statistical", "uncertain", 0.6, True), (1, "bidi-controls", "character", "detected", 2.0, False), (2, "gumbel", "statistical", "detected", 9.0, False)], kind)
    after = spark.createDataFrame([(1, "stylometry", "statistical", "clean", 0.1, True), (2, "gumbel", "statistical", "detected", 8.0, False)], kind)
    got = {x.input_id: x for x in detectors.overall_effect(detectors.compare(before, after)).collect()}
    assert (got[1].statistical_effect, got[1].residual_character) == ("none", 1)
    assert (got[2].statistical_effect, got[2].residual_character) == ("same_status", 0)


def test_texts_are_compared_row_by_row(spark, monkeypatch):
    from markscope.operators import stylometry
    from markscope.plans import pipeline

    rows = [(1, "a\u200bb"), (1, "x\u202ey\u200e"), (None, "p\u200bq"), (None, None), (2, "plain"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipeline.clean_and_reinspect(df)
    assert got.count() == len(rows) * len(detectors.default_registry().list())
    two = df.where("doc_id = 2").limit(1)
    before, after = (detectors.text_results(x) for x in (two, characters.clean(two).select("doc_id", characters.F.col("cleaned").alias("text"))))
    assert detectors.compare(before, after).dtypes == pipeline.clean_and_reinspect(two).dtypes
    assert sorted(map(str, detectors.compare(before, after).collect())) == sorted(map(str, pipeline.clean_and_reinspect(two).collect()))
    # detectors of characters alone: no style report, no exchange
    monkeypatch.setattr(stylometry, "score", None)
    got = pipeline.clean_and_reinspect(df, wanted=lambda d: d.layer == "character")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(None, "unicode-invisible", "detected", "clean")] + [(1, "bidi-controls", "detected", "detected"), (1, "unicode-invisible", "detected", "clean")]
    moved = [(x.input_id, x.detector, x.before_status, x.after_status) for x in got.where("before_status <> 'clean' or after_status <> 'clean'").collect()]
    assert sorted(moved, key=str) == sorted(want, key=str)


def test_effect_without_heuristics(spark, monkeypatch):
    from markscope import queries
    from markscope.operators import stylometry
    from markscope.plans import pipeline

    df = spark.createDataFrame([(1, "x\u202ey\u200e"), (2, "a\u200bb"), (3, None)], "doc_id long, text string")
    want = sorted(map(tuple, detectors.overall_effect(pipeline.clean_and_reinspect(df)).collect()))
    monkeypatch.setattr(stylometry, "score", None)
    monkeypatch.setattr(queries, "planted", lambda spark, sf_dir: df)
    assert sorted(map(tuple, queries.overall_effect(spark, "").collect())) == want == [(1, "none", 1), (2, "none", 0), (3, "none", 0)]


def test_kept_by_row_agrees_with_windows(spark):
    from markscope import constants as C

    rows = list(enumerate(texts(300)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chars = characters.decide(df).collect()
    inside = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)
    for ranges in (C.GLUE, C.TAGS):
        want = {}
        for x in chars:
            if inside(x.cp, ranges):
                want.setdefault(x.doc_id, [0, 0])[x.kind is not None] += 1
        assert {x.doc_id: [x.kept, x.stripped] for x in characters.kept(df, ranges).collect()} == want
    # each row is a text of its own
    odd = spark.createDataFrame([(1, "a\u200db"), (1, "a\u200db"), (None, "\u2764\ufe0f"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.kept, x.stripped) for x in characters.kept(odd, C.GLUE).collect()) == [(0, 1, 0), (1, 0, 1), (1, 0, 1)]
    assert characters.kept(odd.limit(0), C.GLUE).count() == 0


def test_glue_is_not_dealt_out(spark, monkeypatch):
    from markscope import queries

    monkeypatch.setattr(queries, "planted", lambda spark, sf_dir: spark.createDataFrame([(1, "a\u200db"), (2, "x")], "doc_id long, text string"))
    got = queries.glue_preservation(spark, "")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and [tuple(x) for x in got.collect()] == [(1, 0, 1)]


def test_flag_tags_are_not_dealt_out(spark, monkeypatch):
    from markscope import queries

    flags = [(1, "\U0001f3f4\U000e0067\U000e007f \U000e0067"), (2, "a\u200db"), (1, "\U000e0041")]
    monkeypatch.setattr(queries, "planted", lambda spark, sf_dir: spark.createDataFrame(flags, "doc_id long, text string"))
    got = queries.flag_tags(spark, "")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, got.collect())) == [(1, 0, 1), (1, 2, 1)]
