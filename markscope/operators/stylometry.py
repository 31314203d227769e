"""Writing-style statistics. Everything but the moving type-token ratio and exact rounding is a native expression per row; nothing is exchanged."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

#: White space and line breaks as Python strings see them, in Java regex classes.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_LINE_END = r"\r\n|[\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
_W = r"\p{L}\p{N}_"
WORD = rf"[{_W}](?:['\-{_W}]*[{_W}])?"
_SPLIT = rf"(?<=[.!?])[{SPACE}]+|\n+"
_FENCE = r"(?m)^[\t \x1F\xA0\u1680\u2000-\u200A\u202F\u205F\u3000]*```[^\n]*"


def words(text: Column) -> Column:
    """Lower-cased words: letters, digits and underscores with inner hyphens and apostrophes."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), F.lower)


def sentences(text: Column) -> Column:
    """Sentences outside code fences: every second piece between fence lines is fenced."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), _LINE_END, "\n")
    open_parts = F.filter(F.split(lines, _FENCE), lambda x, i: i % 2 == 0)
    pieces = F.split(F.array_join(open_parts, "\n"), _SPLIT)
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+$", "")), lambda s: s != "")


def burstiness(found: Column) -> Column:
    """Mean, sample deviation and their ratio (cv) of the sentences' word counts; cv is null below two sentences."""
    # one pass of sums over whole numbers, which doubles hold exactly; the sentences are worked out once
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(a: Column, s: Column) -> Column:
        x = F.size(F.regexp_extract_all(s, F.lit(WORD), 0)).cast("double")
        return F.struct((a["n"] + F.when(x > 0, 1.0).otherwise(0.0)).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))

    def done(a: Column) -> Column:
        mean = F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(0.0)
        dev = F.when(a["n"] > 1, F.sqrt(F.greatest(F.lit(0.0), (a["q"] - a["s"] * a["s"] / a["n"]) / (a["n"] - 1))))
        return F.struct(mean.alias("mean_len"), F.coalesce(dev, F.lit(0.0)).alias("std_dev"), (dev / mean).alias("cv"))

    return F.aggregate(found, start, add, done)


def java_phrase(pattern: str) -> str:
    """A phrase pattern with Python's meaning of word ends, white space, word characters and case in Java."""
    out, in_class = "", False
    tokens = re.findall(r"\\.|.", pattern)
    for token, after in zip(tokens, [*tokens[1:], ""], strict=True):
        if token == r"\b":  # before a letter a word starts, elsewhere one ends
            out += rf"(?<![{_W}])" if after.isalpha() else rf"(?![{_W}])"
        elif token in (r"\s", r"\w"):
            inner = SPACE if token == r"\s" else _W
            out += inner if in_class else f"[{inner}]"
        else:
            in_class = token == "[" or in_class and token != "]"
            out += token
    return "(?iu)" + out


def phrase_matches(text: Column) -> Column:
    """Array of (phrase, count, weight, first three samples) of the phrases that occur."""
    text = F.coalesce(text, F.lit(""))
    # a text that lacks a pattern's words is not searched for it; letters that case folding equates with ASCII ones are equal here too
    odd = "\u0130\u0131\u017f\u212a"
    low = F.lower(F.when(text.rlike(f"[{odd}]"), F.translate(text, odd, "iisk")).otherwise(text))

    def search(row: Column) -> Column:
        found = []
        for pattern, name, weight in C.PHRASES:
            likely = reduce(and_, [reduce(or_, [F.contains(row["low"], F.lit(w)) for w in some]) for some in needed_words(pattern)])
            got = F.regexp_extract_all(row["text"], F.lit(java_phrase(pattern)), 0)
            found.append(F.struct(F.lit(name).alias("phrase"), F.when(likely, got).otherwise(F.array().cast("array<string>")).alias("samples"), F.lit(weight).alias("weight")))
        return F.array(*found)

    # bound by a lambda, so that both the lower-cased text and each search are worked out once
    found = F.flatten(F.transform(F.array(F.struct(text.alias("text"), low.alias("low"))), search))
    some = F.filter(found, lambda m: F.size(m["samples"]) > 0)
    return F.transform(some, lambda m: F.struct(m["phrase"].alias("phrase"), F.size(m["samples"]).alias("count"), m["weight"].alias("weight"), F.slice(m["samples"], 1, 3).alias("samples")))


def needed_words(pattern: str) -> list[list[str]]:
    """Of each group and each run of letters that a match must hold, the alternatives (their first run of letters)."""
    must = re.sub(r"\((?:\?:)?(?:[^()]|\([^()]*\))*\)[?*]", " ", pattern)  # what may be left out
    out = []
    for group in re.findall(r"\(\?:([^()]*(?:\([^()]*\)[^()]*)*)\)", must):
        found = [re.match(r"[a-z]*", re.sub(r"[a-z']\?|\[[a-z]+\]\?", " ", x))[0] for x in group.split("|")]
        if all(len(w) > 1 for w in found):
            out.append(found)
    rest = re.sub(r"\(\?:.*?\)(?![|\w)])|\[[^\]]*\][+*?]?|\\[a-z][+*]?|[a-z']\?", " ", must)
    return sorted(out + [[w] for w in re.findall(r"[a-z]{2,}", rest)], key=lambda ws: -min(map(len, ws)))


def moving_ratio(ws: list[str], window: int = C.MATTR_WINDOW) -> float:
    """Mean share of distinct words over all windows: each word counts in the windows that do not hold it earlier."""
    n = len(ws)
    if n <= window:
        return len(set(ws)) / n if n else 0.0
    last: dict[str, int] = {}
    total = 0
    for i, w in enumerate(ws):
        total += max(0, min(i, n - window) - max(0, i - window + 1, last.get(w, -1) + 1) + 1)
        last[w] = i
    return total / (window * (n - window + 1))


@F.pandas_udf(T.DoubleType())
def mattr_of_ids(ids: pd.Series) -> pd.Series:
    return pd.Series([moving_ratio(x.tolist() if x is not None else []) for x in ids], dtype="float64")


def mattr(ws: Column | str) -> Column:
    """Moving type-token ratio of an array of words; they cross into Python as hashes."""
    return mattr_of_ids(F.transform(ws, lambda w: F.xxhash64(w)))


def mattr_by_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = C.MATTR_WINDOW) -> DataFrame:
    """The same ratio as rows and a lag over equal words, for use where Python is unwanted. Rows of equal id and text count as one."""
    w = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias("_t")).distinct().select(id_col, F.xxhash64(id_col, "_t").alias("_row"), words(F.col("_t")).alias("_w"))
    each = w.select("_row", F.size("_w").alias("n"), F.posexplode("_w").alias("i", "word"))
    before = F.coalesce(F.lag("i").over(Window.partitionBy("_row", "word").orderBy("i")), F.lit(-1))
    span = F.greatest(F.lit(0), F.least("i", F.col("n") - window) - F.greatest(F.lit(0), F.col("i") - window + 1, before + 1) + 1)
    total = each.withColumn("c", F.when(F.col("n") <= window, (before < 0).cast("int")).otherwise(span)).groupBy("_row", "n").agg(F.sum("c").alias("c"))
    total = total.select("_row", (F.col("c") / F.when(F.col("n") <= window, F.col("n")).otherwise(window * (F.col("n") - window + 1))).alias("mattr"))
    return w.select(id_col, "_row").join(total, "_row", "left").fillna(0.0, ["mattr"]).drop("_row")


def finding_confidence(finding: Column) -> Column:
    """Confidence class of a finding."""
    low = F.lower(finding)
    some = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda s: F.contains(low, s))
    return F.when(some(C.CONFIRMED), "confirmed").when(F.startswith(low, F.lit("info:")) | some(C.INFORMATIONAL), "informational").when(F.contains(low, F.lit("byte-scan")), "likely_false_positive").when(some(C.PROBABLE), "probable").otherwise("informational")


@F.pandas_udf(T.DoubleType())
def round4(x: pd.Series) -> pd.Series:
    """Half-even rounding of the exact binary value."""
    return x.map(lambda v: None if pd.isna(v) else round(v, 4))


@F.pandas_udf(T.StringType())
def fixed2(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.2f}")


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "<text>") -> DataFrame:
    """The style report of each text; a heuristic that never says more than a tier."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), words(t).alias("_w"), sentences(t).alias("_s"), phrase_matches(t).alias("matched_markers"))
    rows = rows.select(id_col, "_w", "matched_markers", F.size("_w").alias("word_count"), F.size("_s").alias("sentence_count"), burstiness(F.col("_s"))["cv"].alias("_cv"))
    rows = rows.withColumn("_m", mattr("_w")).drop("_w")
    n, cv, few = F.col("word_count"), F.col("_cv"), F.col("word_count") < C.MIN_WORDS
    weight = F.aggregate("matched_markers", F.lit(0.0), lambda a, m: a + m["count"] * m["weight"])
    rows = rows.withColumn("_d", F.when(few, 0.0).otherwise(weight / (n / 100.0))).withColumn("_cv", F.when(~few, cv))
    d, m = F.col("_d"), F.col("_m")
    burst = F.when(cv < 0.25, 0.95).when(cv < 0.35, 0.80).when(cv < 0.45, 0.50).when(cv < 0.55, 0.25).when(cv.isNotNull(), 0.05)
    grams = F.when(d >= 2.0, 1.0).when(d >= 1.0, 0.75).when(d >= 0.5, 0.45).when(d > 0, 0.20).otherwise(0.0)
    variety = F.when(m.between(0.68, 0.76), 0.4).otherwise(0.1)
    whole = F.when(burst.isNull(), (grams * 0.45 + variety * 0.10) / 0.55).otherwise(burst * 0.45 + grams * 0.45 + variety * 0.10)
    rows = rows.withColumn("_k", F.when(n < C.FULL_WORDS, 0.4 + 0.6 * ((n - C.MIN_WORDS) / float(C.FULL_WORDS - C.MIN_WORDS))).otherwise(1.0))
    rows = rows.withColumn("_x", F.when(few, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), whole * F.col("_k")))))
    rows = rows.withColumns({"_cv2": fixed2("_cv"), "_d2": fixed2("_d"), "_k2": fixed2("_k"), "burstiness_cv": round4("_cv"), "lexical_diversity": round4("_m"), "ai_ngram_density": round4("_d"), "score": round4("_x")})
    x = F.col("_x")
    told = F.transform("matched_markers", lambda p: F.when(few, F.format_string("AI phrase marker '%s' found (%dx)", p["phrase"], p["count"])).otherwise(F.format_string("AI cadence phrase '%s' (%dx)", p["phrase"], p["count"])))
    more = F.array_compact(F.array(
        F.when((cv < 0.35) & (F.col("sentence_count") >= 3), F.format_string("Unnaturally uniform sentence cadence (CV=%s < 0.35)", F.col("_cv2"))),
        F.when(d >= 1.0, F.format_string("Elevated AI formulaic transition density (%s/100w)", F.col("_d2"))),
    ))
    notes = F.array_compact(F.array(
        F.when(few, F.format_string("Sample contains %d words; statistical stylometry is uncalibrated below 30 words", n)),
        F.when(~few & cv.isNull(), F.lit("Sentence burstiness unavailable (fewer than 2 parsed sentences — e.g. body wrapped in a code fence); composite renormalized over AI-phrase density and lexical diversity")),
        F.when(~few & (n < C.FULL_WORDS), F.format_string("Sample word count (%d) is in calibration range (30-100); score dampened by factor %s", n, F.col("_k2"))),
    ))
    rows = rows.withColumn("findings", F.concat(told, more)).withColumn("notes", notes)
    return rows.select(
        id_col, F.lit(path).alias("path"), "word_count", "sentence_count", "burstiness_cv", "lexical_diversity", "ai_ngram_density", "matched_markers", "score",
        F.when(x >= 0.75, "HIGH").when(x >= 0.5, "MEDIUM").when(x >= 0.25, "LOW").otherwise("CLEAN").alias("confidence_level"),
        F.when(few, "insufficient_length").otherwise("ok").alias("status"), "findings", F.transform("findings", finding_confidence).alias("findings_confidence"), "notes",
    )
