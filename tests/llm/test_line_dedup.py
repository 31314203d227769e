import random

from markscope.llm import line_dedup as L


def brute(docs, min_words):
    """Kept texts: every run of consecutive lines with enough words that also starts at an earlier place goes."""
    seqs = []
    for i, t in docs:
        seqs.append([x.strip() for x in (t or "").split("\n") if x.strip()])
    first = {}
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    for k in order:
        s = seqs[k]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                first.setdefault(tuple(s[a:b]), (docs[k][0], a))
    out = {}
    for k in order:
        s, drop = seqs[k], set()
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(len(x.split()) for x in s[a:b]) >= min_words and first[tuple(s[a:b])] != (docs[k][0], a):
                    drop |= set(range(a, b))
        out[docs[k][0]] = len(drop), [x for n, x in enumerate(s) if n not in drop]
    return out


def test_matches_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(r.choices("abcdefg", k=r.choice([1, 1, 2, 3, 8]))) for _ in range(14)]
    docs = [(i, "\n".join(r.choices([*pool, ""], k=r.randrange(0, 14)))) for i in range(70)]
    docs += [(100, docs[3][1] + "\n" + docs[4][1]), (101, docs[3][1]), (102, "\n".join([pool[0]] * 20))]
    for min_words in (3, 7, 12):
        want = brute(docs, min_words)
        got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words).collect()
        assert len(got) == len(docs)
        for x in got:
            assert (x.n_lines_removed, [y.strip() for y in x.text.split("\n") if y.strip()]) == want[x.doc_id], (min_words, x)


def test_edge_cases(spark):
    run = "one two three\nfour five six"
    docs = [(1, None, 0, 9), (2, "", 0, 9), (3, run, 0, 9), (4, "new\n\n" + run + "\nend", 7, 9), (None, run, 1, 9), (3, run, 0, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, pos long")
    got = L.dedup_lines(df, 6).collect()
    assert sorted((x.doc_id or -1, x.text, x.n_lines_removed) for x in got if x.text is not None) == sorted([(2, "", 0), (3, run, 0), (3, run, 0), (4, "new\n\nend", 2), (-1, "", 2)])
    assert [x.n_chars for x in got if x.doc_id == 4] == [8] and {x.pos for x in got} == {9}
    assert L.dedup_lines(df.limit(0), 6).count() == 0


def test_clashing_names(spark):
    run = "one two three\nfour five six"
    names = ["_id0", "_th0", "_runs0", "_id", "_th", "_runs", "h", "g", "w", "n", "a", "b", "rank", "first", "id", "th"]
    df = spark.createDataFrame([(k, run, *range(len(names))) for k in (1, 2)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = {x.doc_id: x for x in L.dedup_lines(df, 6).collect()}
    assert (got[1].text, got[2].text) == (run, "") and [got[2][n] for n in names] == list(range(len(names)))
