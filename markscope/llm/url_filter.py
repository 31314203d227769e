"""URL filter by the ratio of two character language models, with host and path rules before it.

Rules give (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts with
the rule's path; the longest fitting rule wins. URLs that a rule decides are the labelled examples: one
variable-order Markov model is fitted to the accepted and one to the rejected ones, and the URLs without a
rule are judged by the difference of the two log-likelihoods per character. Everything is DataFrame
expressions.

Model: for contexts of 0 to ``order`` characters, the probability of the next character is its count in
that context plus ``SMOOTH`` times its probability in the context one shorter, normalised; order 0 is smoothed with
a uniform alphabet. A (context, character) pair is kept if counted ``MIN_COUNT`` times in both classes
together; the longest kept context of each position speaks. Both models are one table of log-ratios.

All labelled URLs are fitted (``max_rows`` may bound them: a hash of the URL decides which). All their pairs of
``MIN_COUNT`` or more are kept; only where ``max_entries`` is given are the most frequent so many kept. A table of up to
``BROADCAST_ENTRIES`` pairs is broadcast, a larger one meets the positions in a shuffle.

Calibration: a hash of the URL deals the labelled rows into ``FOLDS`` folds, and each row's ratio is taken by a model of the other
folds, whose counts are the whole's less the fold's. The threshold lies between the mean ratios of both classes, nearer to the class
with the smaller deviation. If a class has no such ratios the threshold is 0; if one class has no examples, every URL without a rule is allowed.

Cases: null URLs and URLs without "://" have an empty host and path, no rule, and are judged on their characters (null: as
empty text, ratio 0); a ratio equal to the threshold allows; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

Rule = tuple[str, str, str]

ORDER = 4
SMOOTH = 4.0
MIN_COUNT = 3
FOLDS = 5
BROADCAST_ENTRIES = 1_000_000
#: Characters of the uniform alphabet below order 0.
ALPHABET = 128.0
_START = "\u0001"
_END = "\u0002"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule], field: int) -> Column:
    """Of the longest rule that fits: its text (field 0) or its verdict (field 1); null if none fits."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit((h + p, verdict)[field])).otherwise(out)
    return out


def _positions(df: DataFrame, keys: list[str], order: int) -> DataFrame:
    """A row per character of ``u`` and its end mark: keys, ``c``, and contexts ``x`` of ``order`` characters."""
    u = F.concat(F.lit(_START * order), F.col("u"), F.lit(_END))
    return (
        df.select(*keys, u.alias("w")).select(*keys, "w", F.explode(F.sequence(F.lit(1), F.length("w") - order)).alias("i"))
        .select(*keys, F.substring("w", F.col("i"), F.lit(order)).alias("x"), F.substring("w", F.col("i") + order, F.lit(1)).alias("c"))
    )


def fit_ratio_model(labelled: DataFrame, order: int = ORDER, max_rows: int | None = None, max_entries: int | None = None) -> tuple[list[DataFrame], float] | None:
    """Tables of log-ratios (x, c, r) for orders 0 to ``order`` and the threshold; None without both classes.

    ``labelled``: u (text) and good (boolean).
    """
    rows = labelled.select("u", "good", F.pmod(F.xxhash64("u", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"))
    if max_rows is not None:
        share = min(1.0, max_rows / max(labelled.count(), 1))
        rows = rows.where(F.pmod(F.xxhash64("u"), F.lit(1_000_003)) < share * 1_000_003)
    models = range(FOLDS + 1)  # number m lacks fold m; the last lacks none
    grams = _positions(rows, ["good", "fold"], order)
    counted = [F.count(F.when((F.col("good") if side == "a" else ~F.col("good")) & (F.col("fold") != m), 1)).alias(f"{side}{m}") for side in "ab" for m in models]
    counts = cut(grams.select("good", "fold", "c", F.explode(F.array(*[F.substring("x", order - k + 1, k) for k in range(order + 1)])).alias("x")).groupBy("x", "c").agg(*counted))
    totals = counts.where("x = ''").agg(*[F.sum(f"{side}{m}").alias(f"{side}{m}") for side in "ab" for m in models]).first()
    if not totals[f"a{FOLDS}"] or not totals[f"b{FOLDS}"]:
        return None
    n = [F.col(f"a{m}") + F.col(f"b{m}") for m in models]
    kept = counts.where(n[FOLDS] >= MIN_COUNT)
    if max_entries is not None:
        kept = kept.orderBy(F.desc(n[FOLDS]), "x", "c").limit(max_entries)
    sums = counts.groupBy("x").agg(*[F.sum(f"{side}{m}").alias(f"n{side}{m}") for side in "ab" for m in models])
    kept = cut(kept.join(sums, "x").withColumn("k", F.length("x")))
    # from order 0 up: probabilities in the context one shorter are ready
    tables: list[DataFrame] = []
    folds: list[DataFrame] = []
    below = None
    probabilities = [f"p{side}{m}" for side in "ab" for m in models]
    for k in range(order + 1):
        level = kept.where(F.col("k") == k)
        if below is None:
            level = level.withColumns({f"{p}_": F.lit(1 / ALPHABET) for p in probabilities})
        else:
            shorter = below.select(F.col("x").alias("y"), "c", *[F.col(p).alias(f"{p}_") for p in probabilities])
            level = level.withColumn("y", F.substring("x", 2, k)).join(shorter, ["y", "c"], "left").drop("y").fillna(1 / ALPHABET, [f"{p}_" for p in probabilities])
        level = level.withColumns({f"p{side}{m}": (F.col(f"{side}{m}") + SMOOTH * F.col(f"p{side}{m}_")) / (F.col(f"n{side}{m}") + SMOOTH) for side in "ab" for m in models})
        said = [F.when(n[m] >= MIN_COUNT, F.log(F.col(f"pa{m}") / F.col(f"pb{m}"))) for m in models]
        below = cut(level.select("x", "c", *probabilities, said[FOLDS].alias("r"), F.array(*said[:FOLDS]).alias("rs")))
        tables.append(below.select("x", "c", "r"))
        folds.append(below.select("x", "c", F.col("rs").alias("r")))
    # models without a class say nothing
    able = [m for m in range(FOLDS) if totals[f"a{m}"] and totals[f"b{m}"]]
    scored = ratio(rows.where(F.col("fold").isin(able)).select("good", "fold", "u", F.monotonically_increasing_id().alias("_row")), ["good", "fold"], folds, lambda r: r[F.col("fold")])
    got = {r["good"]: r for r in scored.groupBy("good").agg(F.avg("ratio").alias("m"), F.stddev_pop("ratio").alias("s")).collect()}
    if True not in got or False not in got:
        return tables, 0.0
    good, bad = got[True], got[False]
    spread = good["s"] + bad["s"]
    return tables, (good["m"] * bad["s"] + bad["m"] * good["s"]) / spread if spread else (good["m"] + bad["m"]) / 2


def ratio(df: DataFrame, keys: list[str], tables: list[DataFrame], pick: Callable[[Column], Column] = lambda r: r) -> DataFrame:
    """keys and ``ratio``: the log-likelihood difference per character of ``u``; ``_row`` tells rows apart.

    A position is one row; ``pick`` takes its log-ratio from a table's ``r``; sums are formed before rows are dealt out.
    """
    order = len(tables) - 1
    at = _positions(df, [*keys, "_row"], order)
    for k, table in enumerate(tables):
        t = table.select(F.col("x").alias(f"x{k}"), F.col("c").alias(f"c{k}"), F.col("r").alias(f"r{k}"))
        few = t.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
        at = at.join(F.broadcast(t) if few else t.hint("merge"), (F.substring("x", order - k + 1, k) == F.col(f"x{k}")) & (F.col("c") == F.col(f"c{k}")), "left").drop(f"x{k}", f"c{k}")
    said = F.coalesce(*[pick(F.col(f"r{k}")) for k in range(order, -1, -1)], F.lit(0.0))
    return at.groupBy("_row", *keys).agg((F.sum(said) / F.count("*")).alias("ratio")).drop("_row")


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), order: int = ORDER, max_rows: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Per row: ``keep``, host, path, rule, verdict (allow or block) and, where no rule fits, ratio and threshold."""
    named = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, named, strict=True)], F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("_url"))
    rows = rows.select(*named, "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules, 0)).withColumn("said", longest_rule(F.col("host"), F.col("path"), rules, 1))
    text = F.lower("_url").alias("u")
    model = fit_ratio_model(rows.where("rule is not null").select(text, (F.col("said") == "allow").alias("good")), order, max_rows, max_entries)
    ruled = rows.where("rule is not null").withColumn("ratio", F.lit(None).cast("double")).withColumn("verdict", F.col("said"))
    rest = rows.where("rule is null")
    if model is None:
        threshold = 0.0
        rest = rest.withColumn("ratio", F.lit(0.0)).withColumn("verdict", F.lit("allow"))
    else:
        tables, threshold = model
        keys = [*named, "host", "path"]
        rest = ratio(rest.select(*keys, text, F.monotonically_increasing_id().alias("_row")), keys, tables)
        rest = rest.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    out = [F.col(n).alias(c) for n, c in zip(named, keep, strict=True)] + [F.col(c) for c in ("host", "path", "rule", "verdict", "ratio")]
    return ruled.select(*out).unionByName(rest.select(*out)).withColumn("threshold", F.lit(float(threshold)))
