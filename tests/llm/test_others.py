import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from markscope.llm import bpe, langid, license_scan, url_filter
from markscope.llm.queries import TOKENIZER_FILE, URL_RULES


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.read_ranks(public_tokenizers.path(TOKENIZER_FILE)), public_tokenizers.PATTERN)


def test_bpe_pieces_equal_whole(enc):
    r = random.Random(1)
    for _ in range(150):
        t = "".join(r.choice(["a", "Zb", "é", " ", "  ", "\n", "\t", "'s", "1", "漢", "!", ". ", "\u00a0", "😀"]) for _ in range(r.randrange(200)))
        assert bpe.encode_text(enc, t, 7) == enc.encode_ordinary(t)
        assert enc.decode_bytes(bpe.encode_text(enc, t, 7)) == t.encode()
        assert "".join(bpe.safe_pieces(t, 7)) == t


def test_bpe_table(spark, enc):
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENIZER_FILE))
    rows = [(1, None, 5), (2, "", 6), (3, "<|endoftext|> word " * 3000, 7), (3, "tie", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.bpe_digest(df, ranks, public_tokenizers.PATTERN).collect()}
    assert got[3, len(enc.encode_ordinary(rows[2][1]))].decoded_sha256 == bpe.sha256_hex(rows[2][1].encode())
    back = bpe.bpe_decode(bpe.bpe_encode(df, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t, _ in rows]
    assert bpe.bpe_digest(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_language_filter(docs.where(~langid.held_out()))
    rows = docs.join(langid.identify_language(docs, model), "doc_id").withColumn("h", langid.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.h]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of that")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify_language(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and 0 <= got[4].score <= 1
    assert langid.identify_language(odd, langid.fit_language_filter(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_all_rows_are_fitted(spark):
    # more rows a language than were once sampled: words of three rows each, and rows that are more or less like their language
    r = random.Random(8)
    made = lambda k, letters: ["".join(r.choices(letters, k=7)) for _ in range(k)]
    rows, words = [], {"aa": made(2000, "abcdefghijklm"), "zz": made(2000, "nopqrstuvwxyz")}
    for lang, own in words.items():
        for k in range(6000):
            rows.append((len(rows), " ".join([own[k // 3], *made(r.randrange(0, 4), "abcdefghijklmnopqrstuvwxyz")]), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit_language_filter(df)
    for k, lang in enumerate(model.languages):
        assert all(model.best(w)[:2] == (k, pytest.approx(1.0)) for w in words[lang])
    got = langid.fit_limits(model, df).least_share
    for k, lang in enumerate(model.languages):
        shares = sorted(x[1] for x in (model.best(t) for _, t, own in rows if own == lang) if x[0] == k)
        want = shares[int(len(shares) * langid.LOW)]
        assert 0 <= want - got[k] / langid.SHARE_PART < 1.01 / langid.SHARE_STEPS


def test_fitting_counts_in_bounded_memory(spark, monkeypatch):
    # one batch of 8 million n-grams (64 MB of hashes before they are sorted), of which every third text is of the other language
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(360)] + [None, "", "12 !"]
    langs = ["aa" if k % 3 else "zz" for k in range(len(texts))]
    tasks, df = [], spark.createDataFrame([(1, "some words some words some words", "aa")], "doc_id long, text string, lang string")
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a: (tasks.append(f), real(self, f, *a))[1])
    langid.fit_language_filter(df)
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["l", "t"])
    want, got = Counter(), Counter()
    for lang, text in zip(langs, texts, strict=True):
        want.update((lang, g) for g in langid.grams(text or "").view(np.int64).tolist())
    tracemalloc.start()
    try:
        for b in tasks[0](iter([batch])):
            for lang, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[lang, g] += n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == want
    assert sum(want.values()) > 8_000_000 and peak < 100 << 20


def test_gram_counts_given_out_in_parts(monkeypatch):
    monkeypatch.setattr(langid, "HELD", 50)
    r = random.Random(10)
    rows = [(r.choice(["aa", "zz"]), "".join(r.choices("abc ", k=30))) for _ in range(200)] + [("aa", None), ("zz", "7")]
    want, got = Counter(), Counter()
    for lang, text in rows:
        want.update((lang, g) for g in langid.grams(text or "").tolist())
    parts = list(langid.gram_counts(rows))
    for lang, h, n in parts:
        assert (np.diff(h.astype(object)) > 0).all()
        got.update(dict(zip([(lang, g) for g in h.tolist()], n.tolist(), strict=True)))
    assert got == want and len(parts) > 4
    assert list(langid.gram_counts([])) == []


def test_unlearned_languages_and_junk_go(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(3)
    fi = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    pl = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    junk = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 10))) for _ in range(n)) for n in (50, 500, 5000)]
    en = "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood."
    odd = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate([fi, fi * 50, pl, pl * 50, *junk, "12 34", None, en])], "doc_id long, text string, lang string")
    got = {x.doc_id for x in C.language_id(spark, docs.unionByName(odd), "").select("doc_id").collect()}
    assert got == {x.doc_id for x in docs.select("doc_id").collect()} | {10**6 + 9}


def test_texts_stay_where_no_language_is_learned(spark):
    import corpus_pipeline as C

    rows = [(1, "a clean text of some words"), (2, "12 34 !!"), (3, ""), (4, None), (5, "ein Text")]
    unlabelled = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    small = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string")
    for docs in (unlabelled, small):
        assert sorted(x.doc_id for x in C.language_id(spark, docs, "").collect()) == [1, 5]


def test_filter_has_no_false_negatives():
    model = langid.build_filter({"a": langid.grams("alpha beta"), "b": langid.grams("gamma delta")})
    assert model.counts(langid.grams("alpha beta"))[0] == len(langid.grams("alpha beta"))


def test_url_rules_and_models(spark):
    rows = [(1, "http://Blog.Example.ORG/es/1?x"), (2, "https://example.org/en/12"), (3, "https://notexample.org/es/1"), (4, None), (5, "no scheme"), (6, "x://a.com"), (7, "http://a.com/de/9#t"), (8, "http://a.net/fr/1")]
    rows += [(100 + i, f"http://site{i % 7}.com/fr/good-news-{i}") for i in range(60)] + [(200 + i, f"http://shop{i % 7}.com/de/cheap-pills-{i}") for i in range(60)]
    rows += [(300, "http://other.net/cheap-pills-5"), (301, "http://other.net/good-news-5"), (301, "http://other.net/good-news-5")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("blog.example.org", "/es/1", "example.org/es/", "block")
    assert (by[2].rule, by[2].verdict) == ("example.org/en/1", "block") and (by[3].rule, by[3].verdict) == ("org/", "allow")
    assert (by[4].host, by[4].path, by[4].rule) == ("", "", None) and (by[5].host, by[6].path, by[6].rule) == ("", "", None)
    assert (by[7].path, by[7].verdict) == ("/de/9", "block")
    assert by[300].verdict == "block" and by[301].verdict == "allow"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_url_model_keeps_all_pairs(spark):
    r = random.Random(2)
    made = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(2400)]
    rows = [(t + str(k), k % 2 == 0) for t in made for k in range(8)]
    tables, _ = url_filter.fit_ratio_model(spark.createDataFrame(rows, "u string, good boolean"))
    assert sum(t.count() for t in tables) > 110_000
    tables, _ = url_filter.fit_ratio_model(spark.createDataFrame(rows, "u string, good boolean"), max_entries=500)
    assert sum(t.count() for t in tables) == 500


def test_url_model_counts_all_rows(spark, monkeypatch):
    # more rows than were once sampled; each end stands in three of them, so that every one is learned from all rows only
    r = random.Random(6)
    made = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5)) for _ in range(20_000)]
    rows = [(made[k // 3], k // 3 % 2 == 0) for k in range(60_000)]
    df = spark.createDataFrame(rows, "u string, good boolean").repartition(4)
    tables, threshold = url_filter.fit_ratio_model(df)
    learned = {x + c for x, c in tables[4].select("x", "c").collect()}
    assert all(w in learned for w in made)
    # the same by tables that meet the positions in a shuffle
    few = df.limit(2000)
    urls = few.select("u", url_filter.F.monotonically_increasing_id().alias("_row"))
    want = sorted(round(x.ratio, 9) for x in url_filter.ratio(urls, [], tables).collect())
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 10)
    assert sorted(round(x.ratio, 9) for x in url_filter.ratio(urls, [], tables).collect()) == want


def test_license_rules(spark):
    mit = license_scan.SENTENCES["MitGrant"][0]
    rows = [
        (1, None), (2, ""), (3, "A license to nothing."), (4, "Text.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (5, "Released under the MIT License. " + mit + ": " + "x. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"),
        (7, "released### under$$$ the%%% mit&&& license*** other text. Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in (1, 2, 3, 4, 6)] == ["", "", "", "Apache-2.0", "UNKNOWN"]
    assert got[5].licenses == "MIT,UNKNOWN" and got[5].sentence_ids == "MIT,MitNotice"
    assert got[7].licenses == "CC-BY-NC-4.0"
    assert all(any(k in s for k in license_scan.KEYS.split("|")) for s in license_scan.known_sentences())


def test_license_identifiers(spark):
    texts = {
        "MIT": "// SPDX-License-Identifier: MIT\nint x;", "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0\n", "GPL-2.0": "/* SPDX-License-Identifier: GPL-2.0-only */\n",
        "GPL-3.0-or-later": "; SPDX-License-Identifier: GPL-3.0-or-later\n", "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See the file.)", "": "SPDX-License-Identifier: None-Such",
    }
    got = license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {k: k for k in texts}


def test_wrapped_license_texts(spark):
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    bsd = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
(2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
    names = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    gpl2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"
    gpl3 = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://example.org/x\n'
    texts = {
        "MIT": "MIT License\n\nCopyright (c) 2020 Someone\n\n" + grant, "BSD-2-Clause,All-Rights-Reserved": bsd, "BSD-3-Clause,All-Rights-Reserved": bsd + names, "ISC": "Copyright 2020 Someone\n" + isc,
        "GPL-2.0-or-later": gpl2, "GPL-3.0-or-later": gpl3, "Apache-2.0": apache, "": "a licence word\nin the open, all rights reserved\nby no one", "Zlib": "Some line\nLicensed under the zlib license\nanother line",
    }
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), *[lambda t, c=c: "".join(c + x + "\n" for x in t.split("\n")) for c in ("# ", " * ", "// ", ";; ")], lambda t: "\n\n".join(p.replace("\n", " ") for p in t.split("\n\n"))]
    rows = [(k, f, forms[f](t)) for k, t in texts.items() for f in range(len(forms))]
    # the last form has one line a paragraph, where what shares a line with other text need not be found
    rows = [x for x in rows if x[1] < len(forms) - 1 or x[0] in ("MIT", "GPL-2.0-or-later", "GPL-3.0-or-later")]
    got = license_scan.scan_licenses(spark.createDataFrame([(f"{k}/{f}", t) for k, f, t in rows], "doc_id string, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {f"{k}/{f}": k for k, f, _ in rows}


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = C.run(spark, "/root/testdata/sf0.001")
    assert set(docs.columns) < set(out.columns)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) <= docs.count()
    enc = bpe.encoder(bpe.read_ranks(public_tokenizers.path(TOKENIZER_FILE)), public_tokenizers.PATTERN)
    assert all(enc.decode_bytes(r.token_ids).decode() == r.text for r in rows)
    from markscope.llm.decontaminate import contamination

    assert contamination(out, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).where("contaminated").count() == 0


def test_pipeline_decodes(spark):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(1, "Été 漢 <|endoftext|> \n" * 40), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in C.encode(spark, docs, "").collect()}
    assert {i: got[i].decoded_sha256 for i in got} == {i: bpe.sha256_hex((t or "").encode()) for i, t in docs.collect()}
