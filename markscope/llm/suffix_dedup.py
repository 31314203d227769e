"""Suffix-array deduplication: bytes covered by a ``LENGTH``-byte string of an earlier document go.

Suffix sorting (``suffix_array``) is linear grouping construction. Suffixes are grouped by their first symbol;
groups are taken in descending order, and the previous-smaller pointer of each suffix of a group tells which
suffix of a lower group it extends. Suffixes that are extended equally often move to the upper end of their
group as a new group, so groups end as equal Lyndon prefixes. A second pass walks the finished order from the
smallest suffix and puts each suffix whose Lyndon prefix ends there into the next place of its group. Nothing is renamed and
nothing recurses.

Distribution. A corpus has no single suffix array, so candidate strings are dealt into independent ones:

1. Documents with equal texts become one, with their ids; texts are dealt by a hash of the text, copies having been
   joined before that, so a large group of copies is one row a task.
2. Every window of ``LENGTH`` bytes is owned by the smallest hash of the ``GRAM``-byte strings in it, so equal windows
   have equal owners. Consecutive windows of one owner are a context, at most 64 windows.
3. Owners that occur in one document only are found from packed hashes (8 bytes each) and dropped.
4. The other contexts go to the task of their owner, equal ones joined beforehand with their smallest id. There, contexts
   of one owner with different bytes go into a generalised suffix array; suffixes that agree on ``LENGTH`` bytes are
   neighbours, and the smallest id among them is the first holder of the window. A window whose rolling
   hash is alone there is left out before sorting; hashes decide nothing else.
5. Each text gets its contexts' first holders and windows back, and every document its removed bytes.

Only hashes, contexts of repeated owners and answers are dealt out besides the texts themselves; all in packed rows.

Cases: a null text is an empty one; texts shorter than ``LENGTH`` bytes lose nothing; documents with one id never remove each
other's bytes; a null id counts as larger than any; repeated rows have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick

LENGTH = 50
GRAM = 20
#: Documents, and bytes of stored input, for each group of texts.
GROUP_DOCS, GROUP_BYTES = 1500, 3 << 20
#: Symbols that one suffix array holds, unless one owner's contexts are more.
ARRAY_SYMBOLS = 400_000
_LAST = np.iinfo(np.int64).max

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in ascending order; an end is smaller than any symbol."""
    n = len(s)
    size_of: dict[int, int] = {}
    for c in s:
        size_of[c] = size_of.get(c, 0) + 1
    start_of, at = {}, 0
    for c in sorted(size_of):
        start_of[c] = at
        at += size_of[c]
    free = dict(start_of)
    sa, where, group, size = [0] * n, [0] * n, [0] * n, [0] * n
    for c, k in size_of.items():
        size[start_of[c]] = k
    for i, c in enumerate(s):
        k = free[c]
        free[c] = k + 1
        sa[k] = i
        where[i] = k
        group[i] = start_of[c]
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        low = group[sa[end]]
        if low == end:  # a group of one
            i = sa[end]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                h = group[p]
                k = size[h] - 1
                if k:
                    size[h] = k
                    k += h
                    j = where[p]
                    o = sa[k]
                    sa[j] = o
                    where[o] = j
                    sa[k] = p
                    where[p] = k
                    size[k] = 1
                    group[p] = k
            end -= 1
            continue
        extended: dict[int, int] = {}
        for i in sorted(sa[low : end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                extended[p] = extended.get(p, 0) + 1
        # by old group and number of extensions, more of them further up
        alike: dict[tuple[int, int], list[int]] = {}
        for p, k in extended.items():
            key = (k, group[p])
            if key in alike:
                alike[key].append(p)
            else:
                alike[key] = [p]
        for k, h in sorted(alike, reverse=True) if len(alike) > 1 else alike:
            moved = alike[k, h]
            last = h + size[h]
            left = size[h] - len(moved)
            if left:
                for p in moved:
                    last -= 1
                    j = where[p]
                    o = sa[last]
                    sa[j] = o
                    where[o] = j
                    sa[last] = p
                    where[p] = last
                size[h] = left
                size[last] = len(moved)
                for p in moved:
                    group[p] = last
        end = low - 1
    # each suffix goes to its group's next place once the suffix after its Lyndon prefix is placed
    out, placed, place = [0] * n, bytearray(n), list(range(n))
    i = n
    for k in range(-1, n):
        if k >= 0:
            i = out[k]
        p = i - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            j = place[g]
            place[g] = j + 1
            out[j] = p
            p = prev[p]
    return out


def _words(text: bytes) -> np.ndarray:
    """The eight bytes from each place of the text as one number (zeros beyond its end)."""
    a = np.frombuffer(text + b"\0" * 8, np.uint8)
    return np.lib.stride_tricks.as_strided(a, (len(text), 8), (1, 1))


def _gram_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of ``GRAM`` bytes from the words at their start, 8 bytes on, and 8 bytes before their end."""
    h = a * _M1
    h ^= (b * _M2) >> np.uint64(7)
    h += c * _M3
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def _slide(h: np.ndarray, wide: int, best) -> np.ndarray:
    """The best of each ``wide`` neighbours."""
    span = 1
    while span * 2 <= wide:
        h = best(h[:-span], h[span:])
        span *= 2
    rest = wide - span
    return best(h[: len(h) - rest], h[rest:]) if rest else h


def context_layout(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each context, its number of windows and the place of its owner behind its start.

    A window's owner is the smallest hash among its ``GRAM``-byte strings; a context is a run of windows of
    one owner, cut after every 64.
    """
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    m, wide = n - GRAM + 1, LENGTH - GRAM + 1
    w = _words(text).copy().view("<u8").ravel()
    h = _gram_hash(w[:m], w[8 : 8 + m], w[GRAM - 8 : GRAM - 8 + m])
    own = _slide(h, wide, np.minimum)
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    sizes = np.diff(np.append(starts, len(own)))
    # a string owns some window if its hash is the largest smallest hash of the windows around it
    pad = np.zeros(wide - 1, np.uint64)
    place = np.flatnonzero(h == _slide(np.concatenate((pad, own, pad)), wide, np.maximum))
    if len(place) != len(starts) or sizes.max() > 64 or (h[place] != own[starts]).any():
        # equal hashes near each other: cut long runs and look each owner up
        pieces = -(-sizes // 64)
        base = np.repeat(starts, pieces)
        within = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(starts + sizes, pieces)
        starts = base + 64 * within
        sizes = np.minimum(64, end - starts)
        place = np.array([s + int(np.flatnonzero(h[s : s + wide] == own[s])[0]) for s in starts.tolist()], np.int64)
    return sizes.astype(np.uint8), (place - starts).astype(np.uint8)


def owner_at(text: bytes, places: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM``-byte strings at these places."""
    w = _words(text)
    return _gram_hash(*(w[places + k].view("<u8").ravel() for k in (0, 8, GRAM - 8)))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def range_hashes(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes."""
    n = len(text)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(text, np.uint8)] * power[:n], out=total[1:])
    # divided by the start's power, so that the place in the text does not matter
    h = (total[starts + sizes] - total[starts]) * inverse[starts] + sizes.astype(np.uint64) * _M3
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def first_holders(texts: list[bytes], ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each context, a bit mask of the windows that a context of a smaller id holds too.

    ``texts`` are distinct for one owner; ``ids`` the smallest ids that have them.
    """
    masks = np.zeros(len(texts), np.uint64)
    order = np.argsort(owner, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], owner[order][1:] != owner[order][:-1], [True])))
    jobs = [order[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1]
    batch: list[np.ndarray] = []
    size = 0
    for job in [*jobs, None]:
        if job is None or size > ARRAY_SYMBOLS:
            if batch:
                _sort_batch(texts, ids, batch, masks)
            batch, size = [], 0
        if job is not None:
            batch.append(job)
            size += sum(len(texts[i]) for i in job)
    return masks


def _sort_batch(texts: list[bytes], ids: np.ndarray, jobs: list[np.ndarray], masks: np.ndarray) -> None:
    every = np.concatenate(jobs)
    job_of = np.repeat(np.arange(len(jobs)), [len(j) for j in jobs])
    lens = np.array([len(texts[i]) for i in every], np.int64)
    joined = b"".join(texts[i] for i in every)
    offsets = np.concatenate(([0], np.cumsum(lens)[:-1]))
    windows = lens - LENGTH + 1
    of = np.repeat(np.arange(len(every)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    h = range_hashes(joined, offsets[of] + at, np.full(len(of), LENGTH, np.int64)) + job_of[of].astype(np.uint64) * _M1
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    again = n[back] > 1
    if not again.any():
        return
    # maximal runs of windows that may occur again, as strings; equal strings once, with the smallest id
    turn = np.flatnonzero(np.concatenate(([True], (again[1:] != again[:-1]) | (of[1:] != of[:-1]))))
    stop = np.append(turn[1:], len(again))
    use = again[turn]
    turn, stop = turn[use], stop[use]
    strings: dict[bytes, int] = {}
    least: list[int] = []
    which = np.empty(len(turn), np.int64)
    for k, (s, e) in enumerate(zip(turn.tolist(), stop.tolist(), strict=True)):
        lo = int(offsets[of[s]] + at[s])
        text = joined[lo : lo + e - s + LENGTH - 1]
        j = strings.setdefault(text, len(least))
        i = int(ids[every[of[s]]])
        if j == len(least):
            least.append(i)
        elif i < least[j]:
            least[j] = i
        which[k] = j
    # one generalised suffix array; 255 never occurs in UTF-8 and ends each string
    whole = b"\xff".join(strings)
    sa = np.array(suffix_array(list(whole)), np.int64)
    str_len = np.array([len(x) for x in strings], np.int64)
    str_at = np.concatenate(([0], np.cumsum(str_len + 1)[:-1]))
    owner_of = np.repeat(np.arange(len(str_len)), str_len + 1)[: len(whole)]
    inside = np.arange(len(whole)) - str_at[owner_of]
    sa = sa[inside[sa] <= str_len[owner_of[sa]] - LENGTH]
    raw = np.frombuffer(whole, np.uint8)
    same = np.empty(len(sa), bool)
    same[0] = False
    for lo in range(1, len(sa), 1 << 15):
        hi = min(len(sa), lo + (1 << 15))
        span = np.arange(LENGTH)
        same[lo:hi] = (raw[sa[lo:hi, None] + span] == raw[sa[lo - 1 : hi - 1, None] + span]).all(axis=1)
    first = np.flatnonzero(~same)
    smallest = np.minimum.reduceat(np.array(least, np.int64)[owner_of[sa]], first)
    holder = np.full(len(whole), _LAST)
    holder[sa] = np.repeat(smallest, np.diff(np.append(first, len(sa))))
    for k, (s, e) in enumerate(zip(turn.tolist(), stop.tolist(), strict=True)):
        i = every[of[s]]
        lo = str_at[which[k]]
        hit = holder[lo : lo + e - s] < ids[i]
        if hit.any():
            masks[i] |= np.bitwise_or.reduce(np.uint64(1) << (at[s:e][hit]).astype(np.uint64))


def _buckets(v: np.ndarray, n: int) -> np.ndarray:
    return ((v * _M1) >> np.uint64(20)) % np.uint64(n)


def _u64(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<u8")


def _i64(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<i8")


class _Texts:
    """A group's distinct texts with all their ids and the sizes of their contexts."""

    def __init__(self, table: pa.Table):
        self.texts: list[bytes] = []
        self.sizes: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.ids: list[list[np.ndarray]] = []
        seen: dict[bytes, int] = {}
        for sha, text, ids, sizes, owner in zip(*(table.column(c).to_pylist() for c in ("sha", "text", "ids", "sizes", "owner")), strict=True):
            k = seen.setdefault(sha, len(self.texts))
            if k == len(self.texts):
                self.texts.append(text)
                self.sizes.append(np.frombuffer(sizes, np.uint8).astype(np.int64))
                self.owner.append(np.frombuffer(owner, np.uint8).astype(np.int64))
                self.ids.append([])
            self.ids[k].append(_i64(ids))

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, ids, and of the contexts starts, sizes in windows and places of the owners."""
        for text, ids, sizes, owner in zip(self.texts, self.ids, self.sizes, self.owner, strict=True):
            starts = np.cumsum(sizes) - sizes
            yield text, np.concatenate(ids), starts, sizes, starts + owner


def _collapse(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    names = ["gid", "sha", "text", "ids", "sizes", "owner"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            found: dict[bytes, tuple[bytes, list[int]]] = {}
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = (t or "").encode("utf-8", "surrogatepass")
                found.setdefault(hashlib.blake2b(text, digest_size=16).digest(), (text, []))[1].append(_LAST if i is None else i)
            layout = [context_layout(x[0]) for x in found.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(sha[:6], "little") % groups for sha in found], pa.int32()), pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.binary()),
                 pa.array([np.array(x[1], "<i8").tobytes() for x in found.values()], pa.binary()), *[pa.array([x[k].tobytes() for x in layout], pa.binary()) for k in (0, 1)]],
                names=names,
            )


def _packed_owners(table: pa.Table, buckets: int) -> pa.Table:
    """(bucket, gid, one, many): owners in one text of the group, and in several."""
    got = []
    for text, _, _, _, places in _Texts(table):
        if len(places):
            got.append(np.unique(owner_at(text, places)))
    out: dict[str, list] = {"bucket": [], "gid": [], "one": [], "many": []}
    if got:
        v, n = np.unique(np.concatenate(got), return_counts=True)
        b = _buckets(v, buckets)
        order = np.argsort(b, kind="stable")
        v, n, b = v[order], n[order], b[order]
        edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
        gid = table.column("gid")[0].as_py()
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            out["bucket"].append(int(b[s]))
            out["gid"].append(gid)
            out["one"].append(v[s:e][n[s:e] == 1].tobytes())
            out["many"].append(v[s:e][n[s:e] > 1].tobytes())
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("gid", pa.int32()), ("one", pa.binary()), ("many", pa.binary())]))


def _repeated_owners(table: pa.Table) -> pa.Table:
    """(gid, owners): of each group, the owners that more than one text of the corpus has."""
    one, many = [_u64(x) for x in table.column("one").to_pylist()], [_u64(x) for x in table.column("many").to_pylist()]
    v, n = np.unique(np.concatenate(one + many), return_counts=True)
    keep = np.union1d(v[n > 1], np.concatenate(many))
    gids, blobs = [], []
    for gid, a, b in zip(table.column("gid").to_pylist(), one, many, strict=True):
        mine = np.intersect1d(np.concatenate((a, b)), keep, assume_unique=True)
        if len(mine):
            gids.append(gid)
            blobs.append(mine.tobytes())
    return pa.table({"gid": pa.array(gids, pa.int32()), "owners": pa.array(blobs, pa.binary())})


_CONTEXTS = "bucket int, gid int, owner binary, digest binary, size binary, least binary, bytes binary"


def _contexts(texts: pa.Table, repeated: pa.Table, buckets: int) -> pa.Table:
    """Distinct contexts of the group's repeated owners, packed for each bucket."""
    names = ["bucket", "gid", "owner", "digest", "size", "least", "bytes"]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    known = [_u64(x) for x in repeated.column("owners").to_pylist()]
    rows: list[list] = [[] for _ in names]
    parts: list[tuple] = []
    if known and texts.num_rows:
        keep = np.sort(np.concatenate(known))
        pieces: list[bytes] = []
        for text, ids, starts, sizes, places in _Texts(texts):
            if not len(starts):
                continue
            v = owner_at(text, places)
            at = np.searchsorted(keep, v)
            use = np.flatnonzero(keep[np.minimum(at, len(keep) - 1)] == v)
            if len(use):
                s, z = starts[use], sizes[use] + LENGTH - 1
                parts.append((v[use], range_hashes(text, s, z), z, np.full(len(use), ids.min())))
                pieces += [text[a : a + b] for a, b in zip(s.tolist(), z.tolist(), strict=True)]
    if parts:
        v, d, z, least = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((least, d))  # equal contexts together, the smallest id first
        order = order[np.concatenate(([True], d[order][1:] != d[order][:-1]))]
        b = _buckets(v[order], buckets)
        order = order[np.argsort(b, kind="stable")]
        b = _buckets(v[order], buckets)
        edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
        gid = texts.column("gid")[0].as_py()
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            o = order[s:e]
            for out, x in zip(rows, (int(b[s]), gid, v[o].tobytes(), d[o].tobytes(), z[o].astype("<u4").tobytes(), least[o].astype("<i8").tobytes(), zlib.compress(b"".join(pieces[i] for i in o), 1)), strict=True):
                out.append(x)
    return pa.table([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)


def _answers(table: pa.Table) -> pa.Table:
    """(gid, digest, least, mask): for each group's contexts the first holder and the windows its owner loses."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    v = np.concatenate([_u64(x) for x in cols["owner"]])
    d = np.concatenate([_u64(x) for x in cols["digest"]])
    z = [np.frombuffer(x, "<u4").astype(np.int64) for x in cols["size"]]
    least = np.concatenate([_i64(x) for x in cols["least"]])
    row = np.repeat(np.arange(len(z)), [len(x) for x in z])
    place = np.concatenate([np.cumsum(x) - x for x in z])
    z = np.concatenate(z)
    order = np.lexsort((least, d))
    new = np.concatenate(([True], d[order][1:] != d[order][:-1]))
    kind_of = np.empty(len(d), np.int64)
    kind_of[order] = np.cumsum(new) - 1
    chosen = order[new]  # one row of each distinct context, of the smallest id
    texts: list[bytes] = [b""] * len(chosen)
    by_row = np.argsort(row[chosen], kind="stable")
    edges = np.searchsorted(row[chosen][by_row], np.arange(table.num_rows + 1))
    for r in range(table.num_rows):
        if edges[r + 1] > edges[r]:
            raw = zlib.decompress(cols["bytes"][r])
            for k in by_row[edges[r] : edges[r + 1]].tolist():
                i = chosen[k]
                texts[k] = raw[place[i] : place[i] + z[i]]
    masks = first_holders(texts, least[chosen], v[chosen])
    first = least[chosen][kind_of]
    gids, out = [], [[], [], []]
    edges = np.searchsorted(row, np.arange(table.num_rows + 1))
    for r in range(table.num_rows):
        at = slice(edges[r], edges[r + 1])
        gids.append(cols["gid"][r])
        for x, y in zip(out, (d[at], first[at], masks[kind_of[at]]), strict=True):
            x.append(y.tobytes())
    return pa.table([pa.array(gids, pa.int32()), *[pa.array(x, pa.binary()) for x in out]], names=["gid", "digest", "least", "mask"])


def removed_spans(text: bytes, starts: np.ndarray, sizes: np.ndarray, me: int, digest: np.ndarray, least: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes of ``text`` that document ``me`` loses; the answers are sorted by digest."""
    if not len(starts) or not len(digest):
        return []
    h = range_hashes(text, starts, sizes + LENGTH - 1)
    at = np.minimum(np.searchsorted(digest, h), len(digest) - 1)
    use = np.flatnonzero(digest[at] == h)
    edge = np.zeros(len(text) + 1, np.int64)
    whole = use[least[at[use]] < me]
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, starts[whole] + sizes[whole] + LENGTH - 1, -1)
    some = use[(least[at[use]] >= me) & (mask[at[use]] != 0)]
    for i in some.tolist():
        bits = int(mask[at[i]])
        for k in range(int(sizes[i])):
            if bits >> k & 1:
                edge[starts[i] + k] += 1
                edge[starts[i] + k + LENGTH] -= 1
    covered = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    turn = np.flatnonzero(covered[1:] != covered[:-1])
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, ``spans`` (packed pairs of byte offsets) and ``kept`` (bytes)."""
    rows = _spans(docs, id_col, text, _kept_row)
    return rows.toDF(id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept")


def suffix_dedup_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``suffix_dedup``, with ``kept_sha256`` for the kept bytes."""
    return _spans(docs, id_col, text, _digest_row).toDF(id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")


def _kept_row(kept: bytes) -> bytes:
    return kept


def _digest_row(kept: bytes) -> bytes:
    return hashlib.sha256(kept).hexdigest().encode()


def _spans(docs: DataFrame, id_col: str, text: str, last) -> DataFrame:
    spark = docs.sparkSession
    rows = pick(docs, id_col, text).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    groups = max(8, min(max(rows.count() // GROUP_DOCS, stored // GROUP_BYTES), 1 << 20))
    buckets = max(8, groups // 2)
    texts = rows.mapInArrow(lambda it: _collapse(it, groups), "gid int, sha binary, text binary, ids binary, sizes binary, owner binary").repartition("gid")

    packed = texts.groupBy("gid").applyInArrow(lambda t: _packed_owners(t, buckets), "bucket int, gid int, one binary, many binary")
    repeated = packed.groupBy("bucket").applyInArrow(_repeated_owners, "gid int, owners binary")
    contexts = texts.groupBy("gid").cogroup(repeated.groupBy("gid")).applyInArrow(lambda a, b: _contexts(a, b, buckets), _CONTEXTS)
    answers = contexts.groupBy("bucket").applyInArrow(_answers, "gid int, digest binary, least binary, mask binary")

    def finish(a: pa.Table, b: pa.Table) -> pa.Table:
        digest = np.concatenate([np.zeros(0, np.uint64), *map(_u64, b.column("digest").to_pylist())])
        least = np.concatenate([np.zeros(0, np.int64), *map(_i64, b.column("least").to_pylist())])
        mask = np.concatenate([np.zeros(0, np.uint64), *map(_u64, b.column("mask").to_pylist())])
        order = np.argsort(digest, kind="stable")
        digest, least, mask = digest[order], least[order], mask[order]
        out: list[list] = [[] for _ in range(6)]
        for raw, ids, starts, sizes, _ in _Texts(a):
            me = int(ids.min())
            own = removed_spans(raw, starts, sizes, me, digest, least, mask)
            copies = [(0, len(raw))] if len(raw) >= LENGTH else []
            tail: dict[bool, bytes] = {}
            for i in ids.tolist():
                spans = copies if i > me else own
                if (i > me) not in tail:
                    kept, at = [], 0
                    for s, e in spans:
                        kept.append(raw[at:s])
                        at = e
                    tail[i > me] = last(b"".join([*kept, raw[at:]]))
                for x, y in zip(out, (None if i == _LAST else i, len(raw), sum(e - s for s, e in spans), len(spans), np.array(spans, "<i8").tobytes(), tail[i > me]), strict=True):
                    x.append(y)
        return pa.table([pa.array(out[0], pa.int64()), *[pa.array(x, pa.int64()) for x in out[1:4]], pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "tail"])

    done = texts.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, spans binary, tail binary")
    if last is _digest_row:
        return done.withColumn("tail", F.col("tail").cast("string"))
    return done
