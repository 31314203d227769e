"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and all their suffixes go into one automaton over word numbers. Training
words are streamed through it while the longest match that ends at each word is tracked. A window
is ``window`` consecutive item words, or a whole item of fewer words; where a tracked match covers a
window, the window's words are hit. ``contamination`` reports hits per document, ``decontaminate``
removes hit spans and drops documents of which more than ``max_coverage`` is hit.

Words: A-Z lower-cased, then runs of characters that are digits, a-z or not ASCII.

A match of two or more words needs every pair of neighbours to be a pair of some item, so words are
first screened in bulk: only runs whose words and neighbouring pairs all occur in items, and that are as
long as the shortest window, walk the automaton. Shorter runs cannot hold a window.

The automaton has at most two states a word. Items are dealt to automata of at most ``SHARD_WORDS`` words each, and each is a
broadcast of its own, so the size of one is bounded and a task holds one at a time, however many items there are. With
several, a batch of documents goes through one after the other, so each is loaded once a batch. Items reach the driver as a
stream, one shard at a time.

Cases: null and empty texts have no words; an item without words has no window; repeated items all count;
documents are rows, so repeated ids give repeated rows; an empty item table hits nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pick, sha256_hex

WINDOW = 10
SHARD_WORDS = 500_000
#: Slots of the pair screen, a power of two.
PAIR_SLOTS = 1 << 22
MAX_COVERAGE = 0.5

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets of ``words(text)``."""
    return [m.span() for m in _WORD.finditer(text)]


class ItemAutomaton:
    """Generalised suffix automaton of items' words, with the windows that its states end."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.shortest = window
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        #: state -> window length -> ids of items
        self.windows: dict[int, dict[int, set]] = {}
        self._chains: dict[int, list[tuple[int, frozenset]]] = {}
        coded = [(name, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64)) for name, ws in items if ws]
        for _, ids in coded:
            last = 0
            for c in ids.tolist():
                last = self._extend(last, c)
            if len(ids) > 1:
                self.pairs[self._slot(ids[:-1], ids[1:])] = True
        for name, ids in coded:
            size = min(window, len(ids))
            self.shortest = min(self.shortest, size)
            v = n = 0
            for c in ids.tolist():
                v, n = self.step(v, n, c)
                if n >= size:
                    u = v
                    while self.len[self.link[u]] >= size:
                        u = self.link[u]
                    self.windows.setdefault(u, {}).setdefault(size, set()).add(name)

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & (PAIR_SLOTS - 1)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while v and c not in self.next[v]:
            v = self.link[v]
            n = self.len[v]
        if c in self.next[v]:
            return self.next[v][c], n + 1
        return 0, 0

    def _chain(self, v: int) -> list[tuple[int, frozenset]]:
        """Windows that end at state v or at a state of its shorter suffixes, longest first."""
        if v not in self._chains:
            own = sorted(self.windows.get(v, {}).items(), reverse=True)
            self._chains[v] = [(k, frozenset(x)) for k, x in own] + (self._chain(self.link[v]) if v else [])
        return self._chains[v]

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word spans (start, end), merged, and the ids of items with an occurring window."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not self.vocab or len(ws) < self.shortest:
            return spans, found
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        known = ids > 0
        if self.shortest == 1:
            broken = ~known
            starts = np.flatnonzero(known & np.concatenate(([True], broken[:-1])))
            ends = np.flatnonzero(known & np.concatenate((broken[1:], [True]))) + 1
        else:
            pair = known[:-1] & known[1:]
            at = np.flatnonzero(pair)
            pair[at] = self.pairs[self._slot(ids[at], ids[at + 1])]
            edge = np.diff(np.concatenate(([0], pair.view(np.int8), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < self.shortest:
                continue
            v = n = 0
            for i, c in enumerate(ids[s:e].tolist(), s):
                v, n = self.step(v, n, c)
                if n < self.shortest:
                    continue
                most = 0
                for size, names in self._chain(v):
                    if size <= n:
                        most = max(most, size)
                        found |= names
                if most:
                    if spans and spans[-1][1] >= i + 1 - most:
                        # a longer window may start before spans already held
                        low = i + 1 - most
                        while spans and spans[-1][1] >= low:
                            low = min(low, spans.pop()[0])
                        spans.append((low, i + 1))
                    else:
                        spans.append((i + 1 - most, i + 1))
        return spans, found


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def build_automata(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> list[Broadcast]:
    """Automata of the items' words, each of at most ``SHARD_WORDS`` words (or one item), broadcast."""
    sc = items.sparkSession.sparkContext
    held: list[Broadcast] = []
    shard: list[tuple[str, list[bytes]]] = []
    size = 0

    def close() -> None:
        held.append(sc.broadcast(pickle.dumps(ItemAutomaton(shard, window))))

    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        ws = words(r["t"])
        if shard and size + len(ws) > SHARD_WORDS:
            close()
            shard, size = [], 0
        shard.append((r["i"], ws))
        size += len(ws)
    close()
    return held


_LOADED: dict[int, ItemAutomaton] = {}


def _step(held: list[Broadcast], rows: int) -> int:
    """Documents that go through the automata together."""
    return 1000 if len(held) == 1 else max(1, rows)


def _scan_batch(held: list[Broadcast], all_words: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
    got = [([], set()) for _ in all_words]
    for b in held:
        if b.id not in _LOADED if hasattr(b, "id") else True:
            if len(held) > 1 or len(_LOADED) > 4:
                _LOADED.clear()
            automaton = pickle.loads(b.value)
            if hasattr(b, "id"):
                _LOADED[b.id] = automaton
        else:
            automaton = _LOADED[b.id]
        for k, ws in enumerate(all_words):
            spans, found = automaton.scan(ws)
            if found:
                got[k] = (merge([*got[k][0], *spans]), got[k][1] | found)
    return got


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids (sorted strings).

    Items of null id are hit like others; all of them together count as one in n_items and are not named.
    """
    held = build_automata(items, window=window)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = _step(held, batch.num_rows)
            for lo in range(0, max(1, batch.num_rows), step):
                part = batch.slice(lo, step)
                all_words = [words(t.as_py()) for t in part.column(1)]
                got = _scan_batch(held, all_words)
                names = [sorted(x[1] - {None}) for x in got]
                hit = [sum(e - s for s, e in x[0]) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, all_words), pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x[1]) for x in got], pa.int64()),
                     pa.array([sha256_hex(",".join(x).encode()) for x in names], pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(names, pa.list_(pa.string()))],
                    names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
                )

    return pick(docs, id_col, text).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text: str = "text") -> DataFrame:
    """The documents without the characters of hit spans; documents hit beyond ``max_coverage`` go.

    A span's characters go from its first word to its last. All columns are kept; a column ``n_chars``
    is set to the new length in characters where a text has changed.
    """
    held = build_automata(items, window=window)
    names = docs.columns
    at = names.index(text)
    length = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = _step(held, batch.num_rows)
            for lo in range(0, max(1, batch.num_rows), step):
                part = batch.slice(lo, step)
                texts = part.column(at).to_pylist()
                all_words = [words(t) for t in texts]
                keep, sizes = [], part.column(length).to_pylist() if length is not None else []
                for k, (spans, _) in enumerate(_scan_batch(held, all_words)):
                    hit = sum(e - s for s, e in spans)
                    keep.append(hit <= max_coverage * len(all_words[k]))
                    if hit and keep[-1]:
                        texts[k] = cut_spans(texts[k], spans)
                        if length is not None:
                            sizes[k] = len(texts[k])
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.column(at).type)
                if length is not None:
                    columns[length] = pa.array(sizes, part.column(length).type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    at = word_spans(text)
    out, start = [], 0
    for s, e in spans:
        out.append(text[start : at[s][0]])
        start = at[e - 1][1]
    return "".join([*out, text[start:]])
