"""Line deduplication by a suffix array over line numbers.

The corpus is a sequence of lines per document; blank lines are skipped. Lines get numbers in sorted order of their
128-bit hashes, and the suffixes of the line sequences are ordered by distributed prefix doubling: the rank of 2k lines is
the rank of the pair (rank of the first k lines, rank of the next k lines), with pairs ranked in sorted order by a range
partitioning. Only suffixes that share their lines with another place stay in, so work shrinks with each round.

Suffixes that agree on r lines form an interval of the suffix array with a longest common prefix of r
or more. r lines are the pair of overlapping powers of two, so every interval is found by its two ranks, and neither the whole
array nor the prefix lengths are stored: an interval is the group of places of equal rank pairs. A run counts
if it has ``min_words`` words or more; its first occurrence (by id, then by a hash of the text, then by line) is kept and
the lines of all later ones are deleted. Every maximal repeated run that counts is the union of shortest
counting runs that start or end at its lines, so only those are looked up, and nothing longer than ``min_words`` lines is ranked.

Lines count as equal if their trimmed texts have equal 128-bit hashes. Doubling needs about log2(min_words) rounds; each
ends in a reliable checkpoint.

Cases: null and empty texts have no lines and stay; blank lines stay where they are; rows of equal id and
text are one document and get equal results; a null id comes last; a document that loses all lines keeps an empty text; an
empty table gives an empty result; other columns, of any name, are kept (but ``n_lines_removed`` is replaced). Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut

MIN_WORDS = 50
_DOC = ("id", "th")


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, th (hash of the text), pos (among lines that are not blank), h and g (the line's hash), w (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            row, pos, h, w = [], [], bytearray(), []
            for k, t in enumerate(batch.column(2)):
                at = 0
                for line in (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n"):
                    if n := len(line.split()):
                        row.append(k)
                        pos.append(at)
                        h += xxhash.xxh3_128_digest(line.strip(), 7)
                        w.append(n)
                        at += 1
            take = pa.array(row, pa.int64())
            halves = np.frombuffer(bytes(h), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(w, pa.int32())], names=["id", "th", "pos", "h", "g", "w"]
            )

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "id long, th long, pos int, h long, g long, w int")


def _rank(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` with ``rank``: unique, and in the order of the keys."""
    n = table.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return cut(table.repartitionByRange(int(n), *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The key values that more than one place has."""
    place = F.struct("id", "th", "pos")
    return rows.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select(*keys)


def line_ranks(docs: DataFrame, longest: int, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The places of repeated lines with ranks r0, r1, ... of 1, 2, 4, ... lines (null: not repeated), and the last level."""
    lines = cut(_lines(docs, id_col, text))
    places = lines.join(_rank(_shared(lines, "h", "g"), "h", "g"), ["h", "g"]).select(*_DOC, "pos", "w", F.col("rank").alias("r0")).dropDuplicates([*_DOC, "pos"])
    places = cut(places)
    level, span = 0, 1
    while span * 2 <= longest:
        w = Window.partitionBy(*_DOC).orderBy("pos")
        # after a removed place the next row is further away; such pairs hold a line that is not repeated
        after = F.when(F.lead("pos", span).over(w) == F.col("pos") + span, F.lead(f"r{level}", span).over(w))
        paired = places.withColumn("_b", after)
        both = paired.where(F.col(f"r{level}").isNotNull() & F.col("_b").isNotNull()).select("id", "th", "pos", F.col(f"r{level}").alias("_a"), "_b")
        ranks = _rank(_shared(both, "_a", "_b"), "_a", "_b")
        named = both.join(ranks, ["_a", "_b"]).select("id", "th", "pos", F.col("rank").alias(f"r{level + 1}"))
        places = cut(places.join(named, [*_DOC, "pos"], "left"))
        level, span = level + 1, span * 2
        if not places.where(F.col(f"r{level}").isNotNull()).limit(1).count():
            break
    return places, level


def repeated_runs(places: DataFrame, level: int, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, pos, n): runs of n lines from pos that count and occur earlier, as shortest runs."""
    names = [f"r{k}" for k in range(level + 1)]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # a document may go on in the next batch
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((ids[1:] != ids[:-1]) | (th[1:] != th[:-1])) + 1
            if len(change):
                last = int(change[-1])
                yield from ended([*held[:-1], batch.slice(0, last)])
                held = [batch.slice(last)]
        yield from ended(held)

    def ended(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        ids, th, pos, w = (t.column(i).to_numpy().astype(np.int64) for i in range(4))
        rank = np.stack([t.column(n).fill_null(-1).to_numpy() for n in names])
        n = len(ids)
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1] + 1)))
        first = np.flatnonzero(new)
        island = np.cumsum(new) - 1
        last = np.append(first[1:], n)[island]
        done = np.cumsum(w)
        before = done - w
        # the shortest run that starts at each line, and the shortest that ends there
        at = np.arange(n)
        end = np.searchsorted(done, before + min_words)
        ok = end < last
        s, e = at[ok], end[ok]
        start = np.searchsorted(before, done - min_words, side="right") - 1
        ok = start >= first[island]
        s, e = np.concatenate((s, start[ok])), np.concatenate((e, at[ok]))
        s, size = np.unique(np.stack((s, e - s + 1)), axis=1) if len(s) else (s, s)
        k = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        fits = k <= level
        s, size, k = s[fits], size[fits], k[fits]
        a, b = rank[k, s], rank[k, s + size - (1 << k)]
        fits = (a >= 0) & (b >= 0)
        s, size, a, b = s[fits], size[fits], a[fits], b[fits]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[s], th[s], pos[s].astype(np.int32), size.astype(np.int32), a, b)], names=["id", "th", "pos", "n", "a", "b"])

    ordered = places.select(*_DOC, "pos", "w", *names).repartition(*_DOC).sortWithinPartitions(*_DOC, "pos")
    found = cut(ordered.mapInArrow(runs, "id long, th long, pos int, n int, a long, b long"))
    first = found.groupBy("n", "a", "b").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.max(F.struct("id", "th", "pos")).alias("last")).where("first <> last")
    first = cut(first)  # both sides are dealt out anew, so that the places of one very common run can be split
    later = found.join(first, ["n", "a", "b"]).where(F.struct("id", "th", "pos") != F.col("first"))
    return later.select("id", "th", "pos", "n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without later copies of repeated line runs, and ``n_lines_removed``.

    A column ``n_chars`` is set to the new length where a text has changed. Counted lines are lines that are not blank.
    """
    rows = docs.drop("n_lines_removed")
    places, level = line_ranks(rows, min_words, id_col, text)
    spans = repeated_runs(places, level, min_words).groupBy(*_DOC).agg(F.collect_list(F.struct("pos", "n")).alias("_runs"))
    names = rows.columns
    at, length = names.index(text), names.index("n_chars") if "n_chars" in names else None
    # keys of names that no column has
    low = {c.lower() for c in names}
    key, mark, runs = (next(n for k in range(len(names) + 1) if (n := f"_{name}{k}") not in low) for name in ("id", "th", "runs"))
    keyed = rows.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1))).withColumn(mark, F.xxhash64(F.col(f"`{text}`")))
    spans = spans.select(F.col("id").alias(key), F.col("th").alias(mark), F.col("_runs").alias(runs))
    joined = keyed.join(spans.hint("shuffle_hash"), [key, mark], "left").select(*[F.col(f"`{c}`") for c in names], F.col(f"{runs}.pos").alias(f"{runs}p"), F.col(f"{runs}.n").alias(f"{runs}n"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, max(1, whole.num_rows), 1000)):
            texts, sizes = batch.column(at).to_pylist(), batch.column(length).to_pylist() if length is not None else []
            gone = [0] * batch.num_rows
            for k, (p, n) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                if p:
                    texts[k], gone[k] = drop_lines(texts[k], zip(p, n, strict=True))
                    if length is not None:
                        sizes[k] = len(texts[k])
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=[*names, "n_lines_removed"])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields] + [T.StructField("n_lines_removed", T.LongType())])
    return joined.mapInArrow(rewrite, schema)


def drop_lines(text: str, runs) -> tuple[str, int]:
    """The text without the given runs (first line, lines) of its lines that are not blank, and how many went."""
    drop: set[int] = set()
    for p, n in runs:
        drop.update(range(p, p + n))
    kept, at = [], 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            at += 1
            if at - 1 in drop:
                continue
        kept.append(line)
    return "\n".join(kept), len(drop)
