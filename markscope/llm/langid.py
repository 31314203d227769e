"""Language identification with a bit-sliced Bloom filter of character n-grams.

One filter answers for every language at once: slot i of the table holds a bit mask with one bit per
language, and the AND of an n-gram's ``HASHES`` slots is the set of languages that (may) contain it.
A text's n-grams are looked up, the bits of the masks are counted per language, and each count is
corrected for the filter's false positives, which are measured per language on the finished filter
from the share of set bits. The language with the largest corrected share of n-grams wins.

N-grams have 3 or 4 characters of lower-cased words with their ends marked; digits, symbols and white
space only separate words. They are hashed to 64 bits.

Fitting takes all rows with a text and a language (``max_docs`` may bound them per language: a hash of the id decides, so the
sample is stable) and keeps all n-grams that are typical of a language: counted at least ``MIN_COUNT`` times in the fitted rows and
at least ``TYPICAL`` times as frequent there as in the language where they are most frequent. A task counts in bounded memory,
whatever the number of its rows (``HELD``); Spark adds the counts up. The model grows with the
distinct n-grams of the fitted rows: 24 bits of the table and 8 bytes on the driver for each that is kept.

Cases: a null text or one without a letter is ``und`` with score 0; if nothing can be learned every
text is ``und``, and ``keep_identified`` keeps those with a letter; equal counts go to the smaller language name; whole texts are read in blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, pick

#: Parts into which the shares from 0 to 1 are cut to find the limits.
SHARE_STEPS = 1 << 16
MIN_COUNT = 3
TYPICAL = 0.5
ORDERS = (3, 4)
HASHES = 2
#: Of the labelled fitting rows, the share whose values are passed over when limits are fitted.
LOW = 0.01
#: A text must reach this part of the share that all but ``LOW`` of its language's fitting rows reach. The score has no such
#: limit: near 0.5 are texts that mix two learned languages, while unlearned ones and letter junk may score 0.6.
SHARE_PART = 0.4
#: Languages up to which the table of their shares is broadcast.
BROADCAST_LANGUAGES = 10_000
#: Characters handled at once.
BLOCK = 1 << 20
#: N-grams, and n-grams with their counts, that a fitting task holds at once (8 and 16 bytes each, and some times that while they are sorted).
HELD = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for what is no letter."""
    low = text.lower()
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_is_letter()[np.minimum(a, 0x10FFFF)], a, 0).astype(np.uint64)


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def text_blocks(text: str) -> Iterator[str]:
    """The text in blocks that end at a space where one is near."""
    start, n = 0, len(text)
    while n - start > BLOCK:
        at = text.rfind(" ", start + BLOCK // 2, start + BLOCK)
        at = at if at > 0 else start + BLOCK
        yield text[start:at]
        start = at
    yield text[start:]


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of ``text``."""
    c = np.concatenate((np.zeros(1, np.uint64), _codes(text), np.zeros(1, np.uint64)))
    sep = c == 0
    c = c[~(sep & np.concatenate(([False], sep[:-1])))]  # no two separators in a row
    sep = c == 0
    out, h, crossed = [], c, np.zeros(len(c), bool)
    for n in range(2, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m < 1:
            break
        h = (h[:m] * _MUL ^ (h[:m] >> np.uint64(31))) + c[n - 1 :]
        crossed = crossed[:m] | sep[n - 2 : n - 2 + m] if n > 2 else crossed[:m]
        if n in ORDERS:
            out.append(_mix(h[~crossed] + np.uint64(n)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _sum_counts(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, with the sum of its counts."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first) if len(first) else n


def gram_counts(rows: Iterable[tuple[str, str | None]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, n-grams, counts) of rows of a language and a text, in bounded memory: an n-gram of a language may come several times, its counts add up."""
    new: dict[str, list[np.ndarray]] = {}
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    n_new = 0

    def fold() -> None:
        for name, parts in new.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            if name in counted:
                h, n = _sum_counts(np.concatenate((counted[name][0], h)), np.concatenate((counted[name][1], n)))
            counted[name] = h, n
        new.clear()

    for name, text in rows:
        if not has_letter(text):
            continue
        for block in text_blocks(text):
            h = grams(block)
            new.setdefault(name, []).append(h)
            n_new += len(h)
            if n_new >= HELD:
                fold()
                n_new = 0
                if sum(len(h) for h, _ in counted.values()) >= HELD:
                    yield from ((name, *x) for name, x in counted.items())
                    counted.clear()
    fold()
    yield from ((name, *x) for name, x in counted.items())


@dataclass
class LanguageFilter:
    """``table``: one mask a slot, in words of 64 languages; ``fpr``: false positives per language."""

    languages: list[str]
    table: np.ndarray  # (slots, words), of bytes for up to 8 languages, else of 64-bit words
    fpr: np.ndarray
    least_share: np.ndarray | None = None  # limit of ``keep_identified`` per language, by ``fit_limits``

    def masks(self, h: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.table) - 1)
        step = (h >> np.uint64(40)) | np.uint64(1)
        got = self.table[(h & size).astype(np.int64)]
        for k in range(1, HASHES):
            got = got & self.table[((h + np.uint64(k) * step) & size).astype(np.int64)]
        return got

    def counts(self, h: np.ndarray) -> np.ndarray:
        got = self.masks(h)
        if len(self.languages) <= 8:
            seen = np.bincount(got[:, 0].astype(np.int64), minlength=1 << len(self.languages))
            bits = np.arange(len(seen))
            return np.array([seen[(bits >> k) & 1 == 1].sum() for k in range(len(self.languages))], float)
        return np.array([((got[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum() for k in range(len(self.languages))], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the winner's margin: its corrected share of the sum of the two best shares."""
        k, _, score = self.best(text)
        return (self.languages[k], score) if k is not None else ("und", 0.0)

    def best(self, text: str | None) -> tuple[int | None, float, float]:
        """The winner's position (None: no language or letter), its corrected share and its margin."""
        if not self.languages or not has_letter(text):
            return None, 0.0, 0.0
        n, hits = 0, np.zeros(len(self.languages))
        for block in text_blocks(text):
            h = grams(block)
            n += len(h)
            hits += self.counts(h)
        share = np.maximum(0.0, (hits / max(n, 1) - self.fpr) / (1 - self.fpr))
        best = int(np.argmax(share))  # the first of equals; names are sorted
        second = float(np.max(np.delete(share, best))) if len(share) > 1 else 0.0
        top = float(share[best])
        return best, top, top / (top + second) if top > 0 else 0.0

    def shows(self, text: str | None, min_score: float) -> bool:
        """Whether a learned language shows: the score and, where limits are fitted, the share reach them. Where nothing was learned, a letter is enough."""
        if not self.languages:
            return has_letter(text)
        k, share, score = self.best(text)
        if k is None or score < min_score:
            return False
        return self.least_share is None or bool(share >= self.least_share[k])


def build_filter(kept: dict[str, np.ndarray], bits_per_gram: int = 24) -> LanguageFilter:
    langs = sorted(kept)
    total = max(1, max((len(v) for v in kept.values()), default=1))
    slots = 1 << int(np.ceil(np.log2(max(1024, total * bits_per_gram))))
    table = np.zeros((slots, max(1, (len(langs) + 63) // 64)), np.uint64)
    size = np.uint64(slots - 1)
    for k, lang in enumerate(langs):
        h = kept[lang]
        step = (h >> np.uint64(40)) | np.uint64(1)
        for j in range(HASHES):
            at = np.unique(((h + np.uint64(j) * step) & size).astype(np.int64))
            table[at, k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    return LanguageFilter(langs, table.astype(np.uint8) if len(langs) <= 8 else table, np.minimum(fill**HASHES, 0.99))


def _fitting(labelled: DataFrame, text: str, lang: str, id_col: str, max_docs: int | None) -> DataFrame:
    """(l, t): the rows that have a text and a language, with ``max_docs`` at most about so many a language."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("l is not null and t is not null")
    if max_docs is None:
        return rows.select("l", "t")
    # a row per language: broadcast, so that no text is dealt out, unless there are very many
    share = cut(rows.groupBy("l").agg(F.least(F.lit(1.0), F.lit(float(max_docs)) / F.count("*")).alias("share")))
    few = share.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    return rows.join(F.broadcast(share) if few else share, "l").where(F.pmod(F.xxhash64("i"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("l", "t")


def fit_language_filter(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_docs: int | None = None) -> LanguageFilter:
    """Learn from the rows of ``labelled`` with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for batch in batches for x in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True))
        for name, h, n in gram_counts(rows):
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["l", "g", "n"])

    rows = _fitting(labelled, text, lang, id_col, max_docs)
    counted = cut(rows.mapInArrow(count, "l string, g long, n long").groupBy("g", "l").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))
    # frequencies as shares of each language's n-grams
    totals = cut(counted.groupBy("l").agg(F.sum("n").cast("double").alias("s")))
    shares = counted.join(totals, "l").select("g", "l", (F.col("n") / F.col("s")).alias("f"))
    typical = (
        shares.groupBy("g").agg(F.collect_list(F.struct("l", "f")).alias("x"), F.max("f").alias("m"))
        .select("g", F.transform(F.filter("x", lambda x: x["f"] >= TYPICAL * F.col("m")), lambda x: x["l"]).alias("ls")).select("g", F.explode("ls").alias("l"))
    )
    # the model: 8 bytes an n-gram
    got = typical.toArrow()
    names = got.column("l").combine_chunks().dictionary_encode()
    hashes, at = got.column("g").to_numpy().view(np.uint64), names.indices.to_numpy()
    return build_filter({name: np.sort(hashes[at == k]) for k, name in enumerate(names.dictionary.to_pylist())})


def fit_limits(model: LanguageFilter, labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_docs: int | None = None) -> LanguageFilter:
    """``model`` with a limit on the corrected share per language, from the fitting rows that it puts in their own language.

    Where a language has no such row, the lowest limit of the others holds; without any there are no limits.
    """
    if not model.languages:
        return model
    rows = _fitting(labelled, text, lang, id_col, max_docs)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            got = [(name, *m.best(t)) for name, t in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), strict=True)]
            seen = Counter((k, int(share * SHARE_STEPS)) for name, k, share, _ in got if k is not None and m.languages[k] == name)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.int32()) for i in (0, 1)] + [pa.array(seen.values(), pa.int64())], names=["k", "step", "n"])

    # the step that holds the row after the lowest share LOW: counts add up exactly, in whatever order they come
    steps = cut(rows.mapInArrow(run, "k int, step int, n long").groupBy("k", "step").agg(F.sum("n").alias("n")))
    below = F.sum("n").over(Window.partitionBy("k").orderBy("step"))
    low = steps.withColumn("below", below).join(F.broadcast(steps.groupBy("k").agg(F.sum("n").alias("all"))), "k").where(F.col("below") > F.floor(F.col("all") * F.lit(LOW)))
    got = {r["k"]: r["step"] / SHARE_STEPS * SHARE_PART for r in low.groupBy("k").agg(F.min("step").alias("step")).collect()}  # a row per language
    if not got:
        return model
    return replace(model, least_share=np.array([got.get(k, min(got.values())) for k in range(len(model.languages))]))


def identify_language(df: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred`` and ``score`` (0 to 1)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """True for ids that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(df: DataFrame, model: LanguageFilter, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text has a language with a score of ``min_score`` or more and within the model's limits; all columns are kept."""
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            yield batch.filter(pa.array([m.shows(t.as_py(), min_score) for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
