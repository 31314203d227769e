"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

``fingerprints``: words are split at ASCII white space after lower-casing A-Z; each shingle of ``words`` words
(repeats included; a text of fewer words is one shingle) is hashed by XXH64 with seed 42; a bit is set if more
than half the hashes have it. A text without words has fingerprint zero.

``link_fingerprints``: distinct fingerprints at ``radius`` or fewer differing bits are linked. Candidates come by
pigeonhole: the 64 bits are cut into ``radius + 2`` blocks, so two linked fingerprints agree in at least two of
them, and every pair of blocks is a key. Within a key, fingerprints are laid out as bit planes, 64 fingerprints a
machine word; for each fingerprint, the planes' differences are added by carry-save counters of a few words,
for all others at once, and a block of words is abandoned once all its counters exceed the radius. Only the
edges of a spanning forest of each key's links leave its task.

A key that more than ``TILE`` fingerprints share is cut into parts: see ``link_keyed``; a task holds one part and no link is lost.

``components``: links are contracted round by round in DataFrame joins, until none is left; each round is
checkpointed in the shared folder. Copies never multiply work: components are made of distinct fingerprints
and only then joined to documents.

``near_duplicates``: fingerprints of five-word shingles are compared within bands of minimum hashes, and the texts of those found
by their shingle sets.

Cases: null and empty texts have fingerprint zero and are linked like any other; a null id takes part in groups but is never
a component's id unless all are null; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import cut, pick

WORDS = 4
RADIUS = 4
TILE = 8192
#: Links that one task joins (16 bytes each, and a few hundred in its dictionary).
LOCAL_LINKS = 500_000
#: Fingerprints of a larger key that all others of it are held against first.
LEADERS = 64
#: Words of 64 fingerprints that are compared and abandoned together.
STRIP = 32
#: Words that are worked on at once: queries times words of a strip.
CELLS = 8192
#: Planes after which strips are abandoned.
_CHECKS = (14, 22, 30, 40, 50)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    one = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return one(b" ".join(ws), 42)
    total, n = np.zeros(64, np.int64), len(ws) - words + 1
    for lo in range(0, n, 1 << 16):
        part = ws[lo : lo + (1 << 16) + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = len(part) - words + 1
        h = np.fromiter((one(joined[s:e], 42) for s, e in zip(starts[:m].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, m)
        total += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and ``fp``, the fingerprint's bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return pick(docs, id_col, text).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of every fingerprint, 64 fingerprints a word, filled up with copies of the last."""
    size = -(-len(fps) // 64) * 64
    padded = np.concatenate((fps, np.repeat(fps[-1:], size - len(fps))))
    bits = np.unpackbits(padded.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(fps: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """For each query's position, the positions in ``fps`` at ``radius`` or fewer differing bits."""
    planes = bit_planes(fps)
    levels = max(1, int(radius).bit_length())  # counters hold up to 2**levels - 1, then overflow for good
    width = planes.shape[1]
    flip = np.where(np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), _FULL, np.uint64(0))
    step = max(1, CELLS // min(width, STRIP))
    for q0 in range(0, len(queries), step):
        mask = flip[q0 : q0 + step]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, width, STRIP):
            part = planes[:, lo : lo + STRIP]
            shape = (len(mask), part.shape[1])
            count = [np.zeros(shape, np.uint64) for _ in range(levels)]
            over = np.zeros(shape, np.uint64)
            rows = np.arange(len(mask))  # queries whose strip is not abandoned
            for b in range(0, 64, 2):
                x = part[b][None, :] ^ mask[rows, b][:, None]
                y = part[b + 1][None, :] ^ mask[rows, b + 1][:, None]
                # a carry-save adder takes two planes and the lowest counter
                u = x ^ y
                carry = (x & y) | (u & count[0])
                count[0] ^= u
                for j in range(1, levels):
                    count[j], carry = count[j] ^ carry, count[j] & carry
                over |= carry
                if b in _CHECKS:
                    live = ((over | _above(count, radius)) != _FULL).any(axis=1)
                    if not live.all():
                        rows, over, count = rows[live], over[live], [c[live] for c in count]
                        if not len(rows):
                            break
            if len(rows):
                near = ~(over | _above(count, radius))
                r, c = np.nonzero(np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little"))
                found.append((rows[r], c + lo * 64))
        if found:
            r, c = (np.concatenate(x) for x in zip(*found, strict=True))
            r, c = r[c < len(fps)], c[c < len(fps)]
            order = np.argsort(r, kind="stable")
            r, c = r[order], c[order]
            for g in np.split(np.arange(len(r)), np.flatnonzero(r[1:] != r[:-1]) + 1):
                if len(g):
                    yield q0 + int(r[g[0]]), c[g]


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the counters that exceed ``radius``."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], _FULL)
    for j in range(len(count) - 1, -1, -1):
        if radius >> j & 1:
            same = same & count[j]
        else:
            more = more | (same & count[j])
            same = same & ~count[j]
    return more


def _forest(fps: np.ndarray, pairs: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """(edges, 2): each fingerprint of a group with the group's smallest."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, others in pairs:
        for j in others.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(fps))])
    at = np.flatnonzero(roots != np.arange(len(fps)))
    return np.stack((fps[roots[at]], fps[at]), axis=1)


def key_blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(shift, mask) of each of the ``radius + 2`` blocks of the 64 bits."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    return [(int(a), (1 << int(b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within ``radius``: a spanning forest of each key, thinned."""
    blocks = key_blocks(radius)
    fp = F.col("fp")
    part = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit(m)) for s, m in blocks]
    keys = [F.struct(F.lit(i).alias("t"), (part[a] * (1 << 32) + part[b]).alias("k")) for i, (a, b) in enumerate(combinations(range(len(blocks)), 2))]
    return link_keyed(distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", F.xxhash64("x.t", "x.k").alias("key")), radius)


def link_keyed(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join all fingerprints of one ``key`` within ``radius``; rows (key, fp) are distinct.

    A key of up to ``TILE`` fingerprints is compared in one piece. Of a larger one, all are first held against up to ``LEADERS``
    of them and joined through every leader they are near. Fingerprints outside the largest group that results are then held
    against all of the key, part by part: of two that are not joined yet one is outside that group, so no link is lost.
    """
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = keyed.join(sizes, "key").select("key", "fp", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    tiles = rows.where("parts = 1").select("key", F.lit(0).alias("part"), "fp", F.lit(True).alias("asks"))
    found = None
    if not sizes.where(F.col("n") > TILE).isEmpty():
        near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
        large = cut(rows.where("parts > 1"))
        leaders = large.groupBy("key", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(LEADERS)).alias("slot")).agg(F.min("fp").alias("l"))
        leaders = cut(leaders.groupBy("key").agg(F.sort_array(F.collect_list("l")).alias("leaders")))
        held = large.join(leaders, "key").withColumn("near", F.filter("leaders", lambda x: near(x, F.col("fp"))))
        held = cut(held.select("key", "fp", "parts", "near", F.get("near", F.lit(0)).alias("a")))
        # leaders that are near each other, or near one fingerprint, are of one group
        told = leaders.select("key", F.explode("leaders").alias("a"), "leaders").select("key", F.filter("leaders", lambda x: near(x, F.col("a"))).alias("near"))
        told = told.unionByName(held.where(F.size("near") > 1).select("key", "near")).select("key", F.col("near")[0].alias("a"), F.explode("near").alias("b"))
        group = cut(_leader_groups(told.distinct()))
        found = held.where("a is not null").select("a", F.col("fp").alias("b")).unionByName(group.select(F.col("g").alias("a"), F.col("l").alias("b"))).where("a <> b")
        held = cut(held.select("key", "fp", "parts", "a").join(group.withColumnRenamed("l", "a"), ["key", "a"], "left").select("key", "fp", "parts", "g"))
        most = held.where("g is not null").groupBy("key", "g").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("g", F.struct("c", "g")).alias("most"))
        held = held.join(cut(most), "key").withColumn("asks", F.coalesce(F.col("g") != F.col("most"), F.lit(True)))
        # one that asks is in every part; its own part holds it once more, which the tile undoes
        own = held.select("key", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp", F.lit(False).alias("asks"))
        rest = held.where("asks").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "fp", "asks")
        tiles = tiles.unionByName(own).unionByName(rest)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by tile; a tile may span batches
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
            fps, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            edges = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            out = []
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)], strict=True):
                here = tuple(ids[s].tolist())
                if here != last:
                    if held:
                        out.append(_tile_links(held, radius))
                    held, last = [], here
                held.append((fps[s:e], asks[s:e]))
            if out and (got := np.concatenate(out)).size:
                yield _edges(got)
        if held and (got := _tile_links(held, radius)).size:
            yield _edges(got)

    linked = tiles.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(compare, "a long, b long")
    found = linked.unionByName(found) if found is not None else linked
    # a fingerprint has a root in each of its keys: the roots are tied to one of them, and most fingerprints keep one link
    roots = found.groupBy("b").agg(F.collect_set("a").alias("roots")).select("b", "roots", F.array_min("roots").alias("a"))
    ties = roots.select("a", F.explode("roots").alias("b")).where("a <> b")
    return roots.select("a", "b").unionByName(ties).distinct()


def _leader_groups(told: DataFrame) -> DataFrame:
    """(key, l, g): of each key's leaders, of which links (key, a, b) name every one, the smallest that is joined with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for key, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = {x: x for link in links for x in link.values()}
                for link in links:
                    a, b = of[link["a"]], of[link["b"]]
                    if a != b:
                        of = {x: min(a, b) if g in (a, b) else g for x, g in of.items()}
                out += [(key, x, g) for x, g in of.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["key", "l", "g"])

    return told.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("links")).mapInArrow(run, "key long, l long, g long")


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    signed = np.ascontiguousarray(pairs).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["a", "b"])


def _tile_links(held: list[tuple[np.ndarray, np.ndarray]], radius: int) -> np.ndarray:
    """Links of one tile's rows: fingerprints, and whether each is held against all."""
    every = np.concatenate([x for x, _ in held]).view(np.uint64)
    asks = np.unique(every[np.concatenate([x for _, x in held]).astype(bool)])
    fps = np.unique(every)
    if len(fps) < 2 or not len(asks):
        return np.zeros((0, 2), np.uint64)
    at = np.searchsorted(fps, asks)
    if len(fps) < 24:  # too few for a word of 64: one exclusive or and bit count each
        near = np.bitwise_count(asks[:, None] ^ fps[None, :]) <= radius
        return _forest(fps, ((int(at[i]), np.flatnonzero(near[i])) for i in range(len(asks))))
    return _forest(fps, ((int(at[i]), others) for i, others in within_radius(fps, asks, radius)))


def jaccard(a: str | None, b: str | None, words: int) -> float:
    """Similarity of two texts' sets of word shingles."""
    return _similarity(*(np.unique(_shingle_hashes(t, words)) for t in (a, b)))


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


#: Near copies: minimum hashes in a band and bands (a pair of similarity 0.8 shares a band with probability 0.9998), and
#: the radius of fingerprints (64 bits differ in 9.7 on average at 0.8, with a deviation of 2.9: 0.999 lie within 18).
BAND, BANDS, NEAR_RADIUS = 4, 16, 18
#: Shared shingles of a candidate group that one tile holds; a larger group is dealt over several.
TILE_SHINGLES = 1 << 18
#: Rows of groups that are broadcast to the texts; more meet them in a shuffle.
BROADCAST_ROWS = 400_000

_ODD = np.random.default_rng(7).integers(1, 1 << 63, BAND * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text without words has one shingle of its own."""
    import xxhash

    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(b" ".join(ws[i : i + words]), 42) for i in range(max(1, len(ws) - words + 1))), np.uint64)


def sketch(text: str | None, words: int) -> tuple[int, list[int]]:
    """Fingerprint and band keys of a text."""
    h = _shingle_hashes(text, words)
    total, low = np.zeros(64, np.int64), np.full(len(_ODD), _FULL)
    for s in range(0, len(h), 4096):
        part = h[s : s + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        low = np.minimum(low, (part[None, :] * _ODD[:, None]).min(axis=1))
    fp = int(np.packbits(total * 2 > len(h), bitorder="little").view("<i8")[0])
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND).T:
        key = (key ^ column) * _ODD[0]
        key ^= key >> np.uint64(31)
    return fp, key.view(np.int64).tolist()


def sketches(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(i, h, fp, keys) of rows with an id: the text's digest, fingerprint and band keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(_digest(t), *sketch(t, words)) for t in (t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in got], of) for k, of in enumerate((pa.binary(), pa.int64(), pa.list_(pa.int64())))]], names=["i", "h", "fp", "keys"])

    return pick(docs, id_col, text).where(F.col(f"`{id_col}`").isNotNull()).mapInArrow(run, f"i {kind}, h binary, fp long, keys array<long>")


def _digest(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept): documents that are near copies, and the smallest id of their group.

    Texts whose shingle sets have a Jaccard similarity of ``similarity`` or more are linked, and what links connect is a group.

    Candidates: fingerprints that share a band of minimum hashes are compared by bit planes, and those within ``NEAR_RADIUS``
    join a candidate group (16 bands of 4: see ``BAND``; pigeonhole keys of a 64-bit fingerprint cannot serve at such a radius).
    In a candidate group no link is lost: all texts are held against the one of the smallest id; where that does
    not join all, texts that share a shingle of their prefixes (see below) are held against its smallest holder, and
    then, in tiles of shingle sets, all pairs of them that no links connect yet and whose sizes allow it. No pair is a row.

    Equal texts count once. Texts are read for candidate groups only, once. Rows of one id count as one document (its first text).
    Joins deal out both sides, so that a large group can be split over tasks. Null ids take no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sk = cut(sketches(docs, words, id_col, text).dropDuplicates(["i"]))
    keyed = sk.select("fp", F.posexplode("keys").alias("band", "key")).select("key", "fp").distinct()
    label = components(link_keyed(keyed, NEAR_RADIUS))
    nodes = sk.select("i", "h", "fp").join(label, sk["fp"] == label["v"], "left").select("i", "h", F.coalesce("c", "fp").alias("g"))
    nodes = cut(nodes.groupBy("h").agg(F.min("i").alias("own"), F.min("g").alias("g"), F.count("*").alias("copies")))
    equal = sk.select("i", "h").join(cut(nodes.where("copies > 1").select("h", "own")), "h").where("i <> own").select("i", "own")
    several = cut(nodes.groupBy("g").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("g"))
    members = cut(nodes.join(several, "g").select(F.col("own").alias("i"), "g", "h"))
    few = members.count() <= BROADCAST_ROWS
    texts = pick(docs, id_col, text).toDF("i", "t").join(F.broadcast(members) if few else members, "i")
    texts = cut(texts.where(F.unhex(F.md5(F.coalesce("t", F.lit("")))) == F.col("h")).select("i", "g", "t"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by r, so its set serves many rows; texts are taken up one at a time
        last, held = None, None
        for batch in batches:
            keep = []
            for i, r in enumerate(batch.column(1).to_pylist()):
                if held is None or r != last:
                    last, held = r, np.unique(_shingle_hashes(batch.column(3)[i].as_py(), words))
                mine = np.unique(_shingle_hashes(batch.column(2)[i].as_py(), words))
                keep.append(_similarity(mine, held) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["i", "r"]).filter(pa.array(keep, pa.bool_()))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["i", "g", "s"])

    def verified(pairs: DataFrame) -> DataFrame:
        got = pairs.join(texts.select("i", "t"), "i").join(texts.select(F.col("i").alias("r"), F.col("t").alias("rt")), "r")
        return cut(got.select("i", "r", "t", "rt").mapInArrow(alike, f"i {kind}, r {kind}").distinct())

    leaders = cut(members.groupBy("g").agg(F.min("i").alias("r"), F.count("*").alias("n")))
    links = verified(members.join(leaders, "g").where("i <> r").select("i", "r"))
    # a group whose members are all alike to its leader is done
    done = links.groupBy("r").agg(F.count("*").alias("linked"))
    open_groups = cut(leaders.join(done, "r", "left").where(F.coalesce("linked", F.lit(0)) < F.col("n") - 1).select("g"))
    # two sets that are alike share one of the first n - ceil(similarity n) + 1 shingles in any common order: the rarest first
    tokens = texts.join(open_groups, "g").select("i", "g", "t").mapInArrow(shingles, f"i {kind}, g long, s array<long>")
    tokens = cut(tokens.select("i", F.size("s").alias("n"), F.explode("s").alias("x"), "g").select("i", "n", F.xxhash64("g", "x").alias("k")))
    shared = cut(tokens.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"))
    whole = tokens.join(shared, "k").groupBy("i", "n").agg(F.sort_array(F.collect_list(F.struct("c", "k")))["k"].alias("s"))
    first = F.size("s") - F.ceil(F.col("n") * F.lit(float(similarity)) - 1e-6).cast("int") + 1
    whole = cut(whole.withColumn("f", first).where("f > 0"))
    held = whole.select("i", F.explode(F.slice("s", F.lit(1), F.col("f"))).alias("k"))

    # every holder of a shingle against its smallest holder, so that most copies are joined before all pairs are formed
    now = held.select("k", "i").join(links.withColumnRenamed("r", "c"), "i", "left").withColumn("c", F.coalesce("c", "i"))
    least = cut(now.groupBy("k").agg(F.min("i").alias("r"), F.min_by("c", "i").alias("rc")))
    links = links.unionByName(verified(now.join(least, "k").where("i <> r and c <> rc").select("i", "r").distinct()))
    # then the pairs that share such a shingle and are still apart: what they do not link is not alike
    label = components(links.select(F.col("i").alias("a"), F.col("r").alias("b")))
    of = whole.select("i", F.size("s").alias("m")).join(members.select("i", "g"), "i")
    of = cut(of.join(label.withColumnRenamed("v", "i"), "i", "left").withColumn("c", F.coalesce("c", "i")))
    # of each candidate group, the documents outside its most frequent group against all, in tiles: pairs within that group are never formed
    by = of.groupBy("g", "c").agg(F.count("*").alias("d"), F.sum("m").alias("m")).groupBy("g")
    by = by.agg(F.max(F.struct("d", "c"))["c"].alias("most"), F.count("*").alias("groups"), F.ceil(F.sum("m") / TILE_SHINGLES).cast("int").alias("parts"))
    of = of.join(cut(by.where("groups > 1").select("g", "most", "parts")), "g")
    own = F.array(F.struct(F.pmod(F.xxhash64("i"), F.col("parts")).cast("int").alias("part"), (F.col("c") != F.col("most")).cast("int").alias("role")))
    ask = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(2).alias("role")))
    places = of.select("i", "g", "c", F.explode(F.when(F.col("c") == F.col("most"), own).otherwise(F.concat(own, ask))).alias("x")).select("i", "g", "c", "x.*")
    tiles = places.join(whole, "i").select("g", "part", "role", "i", "c", "n", "f", "s").repartition("g", "part").sortWithinPartitions("g", "part", "role", "i")
    links = links.unionByName(cut(tiles.mapInArrow(lambda batches: _tile_alike(batches, similarity), f"i {kind}, r {kind}")))
    joined = components(links.select(F.col("i").alias("a"), F.col("r").alias("b")))
    copies = equal.join(joined, equal["own"] == joined["v"], "left").select("i", F.coalesce("c", "own").alias("kept"))
    return joined.where("v <> c").toDF("i", "kept").unionByName(copies).toDF(id_col, "kept")


def _tile_alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (i, r) of tiles of rows (g, part, role, i, c, n, f, s); in a tile, those that ask (role 2) come last."""
    tile, last = None, None
    for batch in batches:
        g, part, role, ids, c, n, f = (batch.column(k).to_pylist() for k in range(7))
        sets, out = batch.column(7), []
        for k in range(batch.num_rows):
            if (g[k], part[k]) != last:
                tile, last = _Tile(similarity), (g[k], part[k])
            s = sets[k].values.to_numpy()
            if role[k] < 2:
                tile.add(role[k], ids[k], c[k], n[k], f[k], s)
            else:
                out.extend(tile.links(ids[k], c[k], n[k], f[k], s))
        kinds = batch.schema.field(3).type
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds) for k in (0, 1)], names=["i", "r"])


class _Tile:
    """Shingle sets that others are held against, one at a time: those with a shingle of both prefixes, a size that allows it
    and another group so far are compared exactly. Links that groups found here do not need are left out."""

    def __init__(self, similarity: float):
        self.similarity, self.rows, self.numbers, self.token = similarity, [], {}, None

    def add(self, role, i, c, n: int, f: int, s: np.ndarray) -> None:
        self.rows.append((role, i, self.numbers.setdefault(c, len(self.numbers)), n, f, s))

    def _index(self) -> None:
        role, ids, group, n, f, sets = zip(*self.rows, strict=True)
        self.role, self.n, self.sets = np.array(role), np.array(n), sets
        self.ids = np.empty(len(ids), object)
        self.ids[:] = ids
        self.group = np.array(group)
        self.sizes = np.array([len(s) for s in sets])
        token, row = np.concatenate([s[:k] for s, k in zip(sets, f, strict=True)]), np.repeat(np.arange(len(f)), f)
        order = np.argsort(token, kind="stable")
        self.token, self.row = token[order], row[order]
        self.now = list(range(len(self.numbers)))

    def links(self, i, c, n: int, f: int, s: np.ndarray) -> list[tuple]:
        if not self.rows:
            return []
        if self.token is None:
            self._index()
        if c not in self.numbers:
            self.numbers[c] = len(self.now)
            self.now.append(len(self.now))
        mine = self.now[self.numbers[c]]
        lo, hi = (np.searchsorted(self.token, s[:f], side) for side in ("left", "right"))
        near = np.unique(np.concatenate([self.row[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        least, most = np.minimum(self.n[near], n), np.maximum(self.n[near], n)
        near = near[(least >= most * self.similarity - 1e-6) & (self.group[near] != mine)]
        near = near[(self.role[near] == 0) | (self.ids[near] < i)]  # of two that ask, the greater finds the pair
        s, out = np.sort(s), []
        while len(near):
            take = max(1, int(np.searchsorted(np.cumsum(self.sizes[near]), 1 << 16)))
            part, near = near[:take], near[take:]
            values = np.concatenate([self.sets[k] for k in part])
            hit = s[np.minimum(np.searchsorted(s, values), len(s) - 1)] == values
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(self.sizes[part])[:-1])))
            for k in part[both / (self.n[part] + n - both) >= self.similarity].tolist():
                old = int(self.group[k])
                if old != mine:
                    out.append((i, self.ids[k]))
                    self.group[self.group == old] = mine
                    self.now = [mine if x == old else x for x in self.now]
            near = near[self.group[near] != mine]
        return out


def components(links: DataFrame) -> DataFrame:
    """(v, c): the smallest v of each linked node's component. ``links``: a, b.

    Up to ``LOCAL_LINKS`` links are joined by one task; more of them in rounds, with the same result.
    Each round every node points at the one of smallest hash among itself and its neighbours, and links
    are carried over to what their ends point at, until none is left; in each component one node is.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    kind = edges.schema["a"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(v):
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = parent[up]
                v = up
            return v

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(x, batch_kind) for x in (nodes, [root(v) for v in nodes])], names=["v", "c"])

    if edges.count() <= LOCAL_LINKS:
        batch_kind = to_arrow_type(edges.schema["a"].dataType)
        return cut(edges.coalesce(1).mapInArrow(joined, f"v {kind}, c {kind}"))
    label = None
    seed = 0
    while not edges.isEmpty():
        seed += 1
        rank = lambda c, seed=seed: F.struct(F.xxhash64(c, F.lit(seed)).alias("x"), F.col(c).alias("p"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least(rank("a"), F.col("m"))["p"].alias("p"))
        up = cut(up)
        left, right = up.toDF("a", "pa"), up.toDF("b", "pb")
        edges = cut(edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if label is None:
            label = up
        else:
            label = label.toDF("w", "q").join(up, F.col("q") == up["v"], "left").select(F.col("w").alias("v"), F.coalesce("p", "q").alias("p"))
    if label is None:
        return edges.toDF("v", "c")
    label = cut(label)
    least = cut(label.groupBy("p").agg(F.min("v").alias("c")))
    return label.join(least, "p").select("v", "c")


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``fp`` (signed long), ``component_id`` (the smallest id of its group)."""
    fps = cut(fingerprints(docs, words, id_col, text))
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    label = components(link_fingerprints(distinct.select("fp"), radius))
    # both sides of each join are dealt out anew, so that the rows of one large group or fingerprint can be split
    linked = cut(distinct.join(label, distinct["fp"] == label["v"]).select("fp", "least", "c"))
    least = cut(linked.groupBy("c").agg(F.min("least").alias("component_id")))
    of = linked.join(least, "c").select("fp", "component_id")
    table = cut(distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return fps.join(table, "fp").select(id_col, "fp", "component_id")
