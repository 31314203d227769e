import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from markscope.llm import simhash as H


def slow_fingerprint(text, k=4):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprint():
    r = random.Random(1)
    for t in [None, "", "  ", "A b", "a b c d", "É x Y\x0bz\tq  r s", *(" ".join(r.choices("abcdef", k=60)) for _ in range(20))]:
        assert H.fingerprint(t) == slow_fingerprint(t)
    t = " ".join(r.choices("abc", k=70_000))
    assert H.fingerprint(t) == slow_fingerprint(t)


def test_bit_sliced_comparison():
    rng = np.random.default_rng(3)
    for radius in (0, 1, 3, 4, 7, 12):
        fps = rng.integers(0, 1 << 63, 5000, np.uint64)
        fps[100:200] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
        fps[200:300] = fps[100:200] ^ np.uint64(0b10110101 << 20)
        got = {k: set(at.tolist()) for k, at in H.within_radius(fps, fps[:300], radius)}
        for k in range(300):
            assert got.get(k, set()) == set(np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= radius).tolist())


def test_groups_match_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = []
    for _ in range(600):
        f = r.choice(base)
        for _ in range(r.randrange(0, 5)):
            f ^= 1 << r.randrange(64)
        fps.append(f)
    ids = list(range(600))
    want = groups(ids, fps)
    for tile, leaders in ((8192, 64), (16, 64), (16, 3)):
        monkeypatch.setattr(H, "TILE", tile)
        monkeypatch.setattr(H, "LEADERS", leaders)
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
        nodes = {x.v: x.c for x in H.components(H.link_fingerprints(df)).collect()}
        by = {}
        for i, f in zip(ids, fps):
            s = f - (1 << 64) if f >> 63 else f
            by.setdefault(nodes.get(s, s), []).append(i)
        got = {i: min(v) for v in by.values() for i in v}
        assert [got[i] for i in ids] == want


def test_large_keys_lose_no_link(spark, monkeypatch):
    # in each key a chain whose neighbours alone are within the radius: between the groups of two leaders one link may be all there is
    monkeypatch.setattr(H, "TILE", 4)
    r = random.Random(5)
    rows, chains = [], []
    for key in range(40):
        bits = r.sample(range(64), 60)
        chain = [r.getrandbits(64)]
        for k in range(0, 60, 3):
            chain.append(chain[-1] ^ sum(1 << b for b in bits[k : k + 3]))
        chains.append([f - (1 << 64) if f >> 63 else f for f in chain])
        rows += [(key, f) for f in chains[-1]]
    keyed = spark.createDataFrame(rows, "key long, fp long")
    for leaders in (3, 8):
        monkeypatch.setattr(H, "LEADERS", leaders)
        nodes = {x.v: x.c for x in H.components(H.link_keyed(keyed, 4)).collect()}
        assert [{nodes.get(f, f) for f in chain} for chain in chains] == [{min(chain)} for chain in chains]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect() + [(1000, None), (1001, ""), (1002, "Same Words here twice ok"), (1003, "same words\there twice ok")]
    got = {x.doc_id: x for x in H.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = [x[0] for x in rows]
    fps = [slow_fingerprint(x[1]) for x in rows]
    assert [got[i].fp & (1 << 64) - 1 for i in ids] == fps
    assert [got[i].component_id for i in ids] == groups(ids, fps)
    assert H.simhash_groups(docs.limit(0)).count() == 0


def test_near_duplicates_match_all_pairs(spark):
    r = random.Random(7)
    docs, n = [(None, "no id"), (900, None), (901, ""), (902, "a b"), (903, "A b"), (904, "a c")], 0
    for size in (60, 150, 300):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for k in range(6):  # copies that are alike to the base, but not always to each other
            ws = list(base)
            for _ in range(0 if k == 3 else max(1, size // 70)):
                ws[r.randrange(size)] = f"x{r.randrange(10**6)}"
            docs.append((n, " ".join(ws)))
            n += 1
    docs += [(n + k, " ".join(f"u{r.randrange(10**6)}" for _ in range(80))) for k in range(10)] + [docs[-1]]
    ids = sorted({i for i, _ in docs if i is not None})
    text = {i: t for i, t in docs if i is not None}
    parent = {i: i for i in ids}
    for i in ids:  # smallest first, so a group's label is its smallest id
        todo = [i] if parent[i] == i else []
        while todo:
            a = todo.pop()
            for b in ids:
                if b != a and parent[b] == b and b > i and H.jaccard(text[a], text[b], 5) >= 0.8:
                    parent[b] = i
                    todo.append(b)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(x) for x in H.near_duplicates(df).collect()]
    assert sorted(got) == [(i, parent[i]) for i in ids if parent[i] != i]
    assert H.near_duplicates(df.limit(0)).count() == 0


def one_group(monkeypatch):
    """All documents in one candidate group."""

    def links(keyed, radius):
        fps = keyed.select("fp").distinct()
        return fps.select(F.lit(min(x.fp for x in fps.collect())).alias("a"), F.col("fp").alias("b"))

    monkeypatch.setattr(H, "link_keyed", links)


def test_chained_candidates_are_verified(spark, monkeypatch):
    # 1 and 3 meet in a group with 2, which is like neither
    ws = [f"w{k}" for k in range(100)]
    docs = [(1, " ".join(ws)), (2, " ".join(f"u{k}" for k in range(100))), (3, " ".join([*ws[:-1], "x"]))]
    one_group(monkeypatch)
    got = H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [tuple(x) for x in got] == [(3, 1)]


def test_links_between_linked_documents(spark, monkeypatch):
    # windows over one word list: only neighbours are alike, so 1 ~ 10, 2 ~ 11 and 10 ~ 11 are the only links
    r = random.Random(5)
    ws = [f"w{r.randrange(10**9)}" for _ in range(2000)]
    chain = [1, 10, 11, 2]
    docs = [(d, " ".join(ws[9 * k : 9 * k + 104])) for k, d in enumerate(chain)]
    # a long chain in random order, and one whose links are all just alike enough
    ids = r.sample(range(100, 1000), 60)
    docs += [(d, " ".join(ws[500 + 11 * k : 500 + 11 * k + 103])) for k, d in enumerate(ids)]
    docs += [(2000 + k, " ".join(f"v{j}" for j in range(k, k + 13))) for k in range(5)]
    assert H.jaccard(docs[-1][1], docs[-2][1], 5) == 0.8 and H.jaccard(docs[0][1], docs[2][1], 5) < 0.8
    one_group(monkeypatch)
    got = {x.doc_id: x.kept for x in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: 1 for d in chain[1:]} | {d: min(ids) for d in ids if d != min(ids)} | {2000 + k: 2000 for k in range(1, 5)}


def test_recall_at_production_parameters(spark):
    """Pairs just above and below the similarity, of short and long texts: at least 99 of 100 links, and no other."""
    r = random.Random(11)
    docs, want = [], {}
    for k in range(300):
        size = r.choice((30, 60, 120, 400))
        ws = [f"w{r.randrange(10**7)}" for _ in range(size)]
        other = list(ws)
        while True:
            changed = list(other)
            changed[r.randrange(size)] = f"x{r.randrange(10**7)}"
            if H.jaccard(" ".join(ws), " ".join(changed), 5) < (0.8 if k % 3 else 0.7):
                break
            other = changed
        docs += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(other))]
        if H.jaccard(docs[-1][1], docs[-2][1], 5) >= 0.8:
            want[2 * k + 1] = 2 * k
    got = {x.doc_id: x.kept for x in H.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) >= 200 and got.items() <= want.items() and len(got) >= 0.99 * len(want)


def test_components(spark, monkeypatch):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, 1000 + k) for k in range(1, 200)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    for most in (10**6, 0):
        monkeypatch.setattr(H, "LOCAL_LINKS", most)
        df = spark.createDataFrame(edges, "a long, b long")
        assert {x.v: x.c for x in H.components(df).collect()} == {v: root(v) for v in linked}
        assert H.components(df.limit(0)).count() == 0


def test_family_around_the_limit_matches_all_pairs(spark, monkeypatch):
    # copies of one text, each with changes of its own: most pairs lie just below the similarity, some above, few are linked early
    r = random.Random(13)
    base = [f"w{r.randrange(10**9)}" for _ in range(150)]
    docs = []
    for k in range(120):
        ws = list(base)
        for _ in range(r.choice((2, 3, 3, 4))):
            ws[r.randrange(len(ws))] = f"x{r.randrange(40)}"
        docs.append((k, " ".join(ws)))
    label = {d: d for d, _ in docs}
    for a, t in docs:
        for b, u in docs[:a]:
            if label[a] != label[b] and H.jaccard(t, u, 5) >= 0.8:
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if c == hi else c for d, c in label.items()}
    assert 10 < len(set(label.values())) < 110
    one_group(monkeypatch)
    df = spark.createDataFrame([(f"d{k:03}", t) for k, t in docs], "doc_id string, text string")
    for size in (1 << 18, 2000):
        monkeypatch.setattr(H, "TILE_SHINGLES", size)
        got = {x.doc_id: x.kept for x in H.near_duplicates(df).collect()}
        assert got == {f"d{d:03}": f"d{c:03}" for d, c in label.items() if d != c}
