import random
import re

from markscope.llm import decontaminate as D
from markscope.llm._common import sha256_hex


def brute(text, items, window=10):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hit, found = set(), set()
    for name, t in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        size = min(window, len(iw))
        for i in range(len(iw) - size + 1 if size else 0):
            for j in range(len(ws) - size + 1):
                if ws[j : j + size] == iw[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(name))
    return len(ws), len(hit), len(found), sha256_hex(",".join(sorted(found)).encode())


def made(seed, n_items=12, n_docs=60):
    r = random.Random(seed)
    vocab = ["a", "b", "C", "Été", "x1"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 2, 5, 11, 14])))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        ws = r.choices(vocab, k=r.randrange(0, 40))
        if r.random() < 0.6:
            src = r.choice(items)[1].split()
            at = r.randrange(len(ws) + 1)
            ws[at:at] = src
        docs.append((d, r.choice([" ", ", ", "\n"]).join(ws)))
    return items, [*docs, (1000, None), (1001, ""), docs[0]]


def test_matches_brute_force(spark):
    for seed, few in ((1, 12), (2, 3)):
        items, docs = made(seed, few)
        items = [x for x in items if seed == 1 or len(x[1].split()) > 2]
        items += items[:1]
        got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert len(got) == len(docs)
        want = {d: brute(t, items) for d, t in docs}
        for x in got:
            assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == want[x.doc_id]
            assert x.contaminated == (x.n_hit > 0)


def test_shards_agree(spark, monkeypatch):
    items, docs = made(3)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.contamination(a, b).drop("item_ids").collect()))
    monkeypatch.setattr(D, "SHARD_WORDS", 20)
    assert sorted(map(tuple, D.contamination(a, b).drop("item_ids").collect())) == whole


def test_removal_and_coverage(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, "Before it, " + passage + " and " + " ".join(f"z{i}" for i in range(20)), "en", 0), (2, passage, "en", 1), (3, None, None, None), (4, "clean text", "en", 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long")
    out = {r.doc_id: r for r in D.decontaminate(df, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].text == "Before it,  and " + " ".join(f"z{i}" for i in range(20)) and out[1].n_chars == len(out[1].text)
    assert out[4].text == "clean text" and out[3].text is None


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).first().n_hit == 0
    assert D.contamination(docs.limit(0), none).count() == 0


def test_items_without_id(spark):
    words = [f"w{k}" for k in range(24)]
    items = spark.createDataFrame([(None, " ".join(words[:12])), (None, " ".join(words[12:])), (7, " ".join(words[5:20]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:12]) + " y"), (2, " ".join(words) + " z" * 40), (3, "x y z")], "doc_id long, text string")
    got = {r.doc_id: r for r in D.contamination(docs, items).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].item_ids, got[i].contaminated) for i in (1, 2, 3)] == [(12, 1, [], True), (24, 2, ["7"], True), (0, 0, [], False)]
    assert got[1].items_sha256 == sha256_hex(b"") and got[2].items_sha256 == sha256_hex(b"7")
    left = {r.doc_id: r.text for r in D.decontaminate(docs, items).collect()}
    assert left[2].split() == ["z"] * 40 and 1 not in left and left[3] == "x y z"
