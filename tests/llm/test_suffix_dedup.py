import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from markscope.llm import suffix_dedup as S


def brute(docs):
    """(n_bytes, n_removed, n_spans, sha) per row, by every window's first holder."""
    first = {}
    raw = [(10**30 if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=60))
def test_suffix_array_sorts(text):
    assert S.suffix_array([ord(c) for c in text]) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_larger():
    r = random.Random(1)
    for alphabet, n in (("ab", 3000), ("a", 500), ("abcdefgh", 4000)):
        t = "".join(r.choices(alphabet, k=n)) + "abab" * 100
        assert S.suffix_array([ord(c) for c in t]) == sorted(range(len(t)), key=lambda i: t[i:])


def test_contexts_follow_owners():
    r = random.Random(2)
    for t in (r.randbytes(3000), b"ab" * 300, b"a" * 500, ("".join(r.choices("ab c", k=2000)) * 2).encode(), b"x" * 49):
        sizes, owner = S.context_layout(t)
        assert sizes.sum() == max(0, len(t) - 49)
        starts = np.cumsum(sizes.astype(int)) - sizes
        got = S.owner_at(t, starts + owner) if len(t) > 49 else []
        h = S.owner_at(t, np.arange(max(0, len(t) - 19)))
        for s, z, v in zip(starts, sizes, got):
            assert all(h[k : k + 31].min() == v for k in range(s, s + z))


def test_hashes_do_not_depend_on_place():
    one = np.array([20])
    assert S.range_hashes(b"xx" + b"q" * 20, np.array([2]), one) == S.range_hashes(b"y" * 9 + b"q" * 20 + b"tail", np.array([9]), one)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdé", k=r.randrange(2, 8)))
    base = [" ".join(word() for _ in range(r.randrange(5, 120))) for _ in range(12)]
    passage = " ".join(word() for _ in range(25))
    docs = []
    for i in range(120):
        t = r.choice(base)
        for _ in range(r.randrange(3)):
            k = r.randrange(len(t))
            t = t[:k] + r.choice(["", "x", passage, word()]) + t[k + r.randrange(3) :]
        docs.append((i * 3 % 121, t))
    docs += [(500, None), (501, ""), (502, "short"), (503, "a" * 400), (504, "b" + "a" * 300 + "c"), (505, "ab" * 200), (506, "xab" * 3 + "ab" * 100), docs[3], (None, docs[4][1]), (None, base[0] + passage), (7, base[1])]
    return docs


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = S.suffix_dedup_digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
        want = sorted(((-1 if i is None else i), *x) for (i, _), x in zip(docs, brute(docs), strict=True))
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_kept_bytes_and_empty(spark):
    df = spark.createDataFrame([(2, "y" + "q1w2e3r4" * 10), (1, "q1w2e3r4" * 10 + "z")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in S.suffix_dedup(df).collect()}
    assert got == {1: b"q1w2e3r4" * 10 + b"z", 2: b"y"}
    assert S.suffix_dedup(df.limit(0)).count() == 0
