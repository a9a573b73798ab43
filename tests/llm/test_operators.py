"""The operators on Spark: odd rows (nulls, empty and long texts, repeated rows, empty tables, clashing columns), brute force and DuckDB."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from allocspark.llm import decontaminate, licenses, neardup, quality_rules, registry, secret_scan, sentencepiece_codec, sharding, suffix_dedup, token_files, toxicity

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(4000))
TEXTS = [None, "", "Released under the MIT License.", LONG, LONG, LONG + " tail", 'token = "0123456789abcdef0123456789abcdef"', "a b c " * 40 + "### $$$", "Ünïcode ẞ 日本 " * 20]
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, kept string, ka2 int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", None, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(3, LONG, "en", "s", None, "x", "y", 1), (None, LONG, None, None, None, None, None, None)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{to}/documents.parquet")
    words = LONG.split()
    spark.createDataFrame([(1, " ".join(words[100:120])), (2, "w1x1 tail"), (3, None), (4, "--")], "item_id bigint, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame([(0, 1, None), (7, 0, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    none = tmp_path_factory.mktemp("none")
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{to}/{t}.parquet").where("false").write.parquet(f"{none}/{t}.parquet")
    return str(to), str(none)


@pytest.mark.parametrize("name", sorted(registry.MODULES))
def test_odd_and_empty_tables(spark, tables, name):
    query = registry.queries()[name]
    assert query(spark, tables[0]).count() == len(TEXTS) + 2
    assert query(spark, tables[1]).count() == 0


def test_texts_by_library(spark, tables):
    import public_tokenizers as P
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model")).collect():
        assert r.ids == lib.encode(r.text or "") and r.decoded == (r.text or "")


def test_token_files(spark, tables, tmp_path):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    token_files.write(docs, P.path("word_bpe_49k.json"), to := str(tmp_path / "ids"), segment_values=50)
    at = 0
    got = {r.doc_id: r for r in token_files.digests(spark, to).collect()}
    ids = {r.doc_id: r.ids for r in token_files.read(spark, to).collect()}
    for i, t in enumerate(TEXTS):
        want = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (ids[i], got[i].start, got[i].n_tokens, got[i].ids_crc32) == (want, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_shards(spark, tables):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("ring"))
    n = Counter()
    for r in sharding.assign(docs, 8, cells=64).collect():
        n[r.shard] += 1
        assert r["size"] == 5 and r.text_crc32 == zlib.crc32(b"same")
    assert sorted(n.values()) == [125] * 5 + [126] * 3


def near(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    s = [shingles(t) for t in texts]
    root = list(range(len(s)))
    for _ in s:
        for i in range(len(s)):
            for j in range(i):
                if s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return [(len(x), r) for x, r in zip(s, root, strict=True)]


@pytest.mark.parametrize("sparse", [8, 0])
def test_near_copies(spark, sparse):
    words = [f"v{i}" for i in range(60)]
    texts = [" ".join(words[:k] + ["X"] * (k % 3) + words[k + k % 4 :]) for k in range(0, 60, 2)] + ["a b", "A  b", "", None, " ".join(words[:30]), " ".join(words[20:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, sparse=sparse).collect()}
    assert [got[i] for i in range(len(texts))] == near(texts)


def test_ids_with_two_texts_and_texts_with_two_ids(spark):
    words = [f"v{i}" for i in range(60)]
    a, b = " ".join(words[:30]), " ".join(words[30:])
    rows = [(1, a), (1, b), (1, a), (5, b + " z"), (7, a + " y"), (9, a), (None, a), (None, None), (3, ""), (4, "q")]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (3, 3, True), (4, 4, True), (5, 1, False), (7, 1, False), (9, 1, False)]
    far = [(1, a), (1, b), (1, "u " * 9 + "w"), (5, b), (6, " ".join(words[10:40]) + " p q r s t u v w x y")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(far, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1), (5, 1), (6, 6)}


def passages():
    """Texts that share passages in every way: borders at many places, periods, copies."""
    r = random.Random(11)
    some = lambda n: "".join(r.choices("abcdefgh é", k=n))
    p = LONG[:700]
    shared = [some(r.randint(190, 500)) for _ in range(3)]
    mixed = [some(r.randint(0, 90)) + (x := r.choice(shared))[r.randint(0, 60) :] + some(r.randint(0, 90)) + x[: r.randint(150, 500)] for _ in range(60)]
    return [p, "start " + p[100:600] + " end", "nothing here", p[:150], None, "x" * 450, p, "ab" * 300, *mixed, *([shared[0] * 2] * 50)]


@pytest.mark.parametrize("more", [{}, {"chunk": 1}, {"chunk": 9000, "crowd": 2}, {"chunk": 500, "bound": 3}, {"crowd": 0}])
def test_passages(spark, more):
    texts = passages()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    raw = [(t or "").encode() for t in texts]
    c = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    got = suffix_dedup.deduplicated(docs, **more).collect()
    assert len(got) == len(texts)
    for r in got:
        t = raw[r.doc_id]
        gone = {j for i in range(len(t) - 199) if c[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert bytes(r.kept) == bytes(b for i, b in enumerate(t) if i not in gone), r.doc_id


def test_digests_of_passages(spark, tmp_path):
    texts = passages()
    raw = [(t or "").encode() for t in texts]
    c = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in enumerate(raw):
        gone = sorted({j for k in range(len(t) - 199) if c[t[k : k + 200]] > 1 for j in range(k, k + 200)})
        runs = sum(1 for a, b in zip([-2, *gone], gone) if b - a > 1)
        want.add((i, len(t), len(gone), runs, hashlib.sha256(bytes(b for j, b in enumerate(t) if j not in set(gone))).hexdigest()))
    assert set(map(tuple, suffix_dedup.query(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("name", ["op2_neardup", "op3_licenses", "op7_decontaminate"])
def test_as_duckdb(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    want = con.execute(registry.oracle_sql()[name])
    order = [[c[0] for c in want.description].index(x) for x in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_windows_by_join_are_the_same(spark, tables):
    docs, bench = (spark.read.parquet(f"{tables[0]}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted((str(r.doc_id), str(r._dc_hits)) for r in decontaminate.scan(docs, bench, most=m).collect()) for m in (1000, 0))
    assert a == b and any("start=100" in x for _, x in a)
    assert decontaminate.decontaminate(docs, bench, remove="spans").columns == docs.columns


def test_items_and_their_ids(spark):
    words = [f"u{i}" for i in range(40)]
    items = [("mmlu,4", " ".join(words[:13])), ("two\nlines", " ".join(words[1:14])), (None, " ".join(words[20:33])), ("", "u35 u36"), ("same", " ".join(words[:13])), ("same", "u38 u39"), ("none", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "u36 u35"), (None, "U35, u36!"), (3, None)], "doc_id bigint, text string")
    want = {1: [(0, 13, ["mmlu,4", "same"]), (1, 13, ["two\nlines"]), (20, 13, []), (35, 2, [""]), (38, 2, ["same"])], 2: [], None: [(0, 2, [""])], 3: []}
    for most in (decontaminate.MOST, 0):
        for r in decontaminate.scan(docs, bench, most=most).collect():
            assert [(h.start, h.length, sorted(h["items"])) for h in r._dc_hits] == want[r.doc_id], (most, r.doc_id)
    kept = decontaminate.decontaminate(docs, bench, remove="spans").orderBy("doc_id").collect()
    assert [r.text for r in kept] == ["!", " " + " ".join(words[14:20] + words[33:35] + words[37:38]), "u36 u35", None]


@pytest.mark.parametrize("n", [4096, 5000])
def test_many_windows_of_one_lead(spark, n):
    bench = spark.createDataFrame([(i, f"name the capital of place{i}") for i in range(n)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"Now name the capital of place{i}!") for i in (0, 1, 903, 904, n // 2, n - 1, n)], "doc_id bigint, text string")
    a, b = (sorted((r.doc_id, str(r._dc_hits)) for r in decontaminate.scan(docs, bench, most=m).collect()) for m in (decontaminate.MOST, 0))
    assert a == b and [(i, h != "[]") for i, h in a] == [(i, i < n) for i, _ in a]


def test_statistics_by_brute_force(spark):
    texts = ["a b c a b c d", "x\ny\nx\n \n", "$ # <|> one", "", None, "q " * 60, "ä ö 1 A! " * 15]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_rules.statistics(docs).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = len({k for i, x in enumerate(g) if g.count(x) > 1 for k in (i, i + 1, i + 2)})
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 50 or 2 * n > len(w))


def test_rules_find_the_planted_cause():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (1500, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.7) & (x[:, 5] > 0.5)
    rules = quality_rules.learn(x, bad)
    hit = np.any([quality_rules._covers(r, x) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * len(x)
    assert quality_rules.learn(x, np.zeros(len(x), bool)) == []


def test_licenses(spark):
    t = "Intro. Licensed under the MIT license. Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Licensed under CC BY-NC 4.0."
    r = licenses.scan(spark.createDataFrame([(1, t, "old")], "doc_id int, text string, licenses string")).first()
    assert (r.licenses, r.license_kind, r.n_sentences) == ("MIT,CC-BY-NC-4.0", "restricted", 4)


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
"""
NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful.
"""
ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file
"""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License.  You may obtain a copy of the License at
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt)
"""
STYLE = """Use of this source code is governed by a BSD-style license that can be
found in the LICENSE file.
"""
HOLDERS = ("Google Inc.", "Some Name Co., Ltd.", "Any Corp.", "J. Doe Ltd.")
GENUINE = [
    (ASF, "Apache-2.0", "permissive"), (EPL, "EPL-2.0", "copyleft"), (EPL.replace("License 2.0", "License v1.0"), "EPL-1.0", "copyleft"), (ZLIB, "Zlib", "permissive"), (BOOST, "BSL-1.0", "permissive"), (STYLE, "LicenseRef-BSD-style", "permissive"),
    *((BSD.replace("Somebody", h) + NAMES.replace("the copyright holder", h), "BSD-3-Clause", "permissive") for h in HOLDERS), *((BSD.replace("Somebody", h), "BSD-2-Clause", "permissive") for h in HOLDERS),
    ("MIT License\n\nCopyright (c) 2020 Somebody\n", "MIT", "permissive"), ("BSD 3-Clause License\n\n" + BSD.replace("Somebody", "Any Inc.") + NAMES, "BSD-3-Clause", "permissive"), ("The MIT License is one of many.\nSo is the Eclipse Public License 2.0 or another.", "", "none"),
    (APACHE, "Apache-2.0", "permissive"), (MIT, "MIT", "permissive"), (BSD, "BSD-2-Clause", "permissive"), (BSD + NAMES, "BSD-3-Clause", "permissive"), (GPL, "GPL-3.0-or-later", "copyleft"), (ONLY, "GPL-2.0-only", "copyleft"), (MPL, "MPL-2.0", "copyleft"),
    (GPL.replace("GNU", "GNU Affero"), "AGPL-3.0-or-later", "copyleft"), (GPL.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1"), "LGPL-2.1-or-later", "copyleft"),
    ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0", "restricted"), ("SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)", "MIT,GPL-2.0-only", "copyleft"),
    ("Permission is hereby granted to smoke.\nThe Apache License is one of many licenses.", "", "none"), (GPL.replace("version 3 of", "any version of"), "", "none"),
]


def test_genuine_notices(spark):
    shapes = (lambda t: t, lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */\nint x;\n", lambda t: "\r\n".join(f"# {x}".rstrip() for x in t.splitlines()) + "\r\n\r\nimport x\r\n", lambda t: "".join(f"// {x}\n" for x in t.splitlines()))
    docs = spark.createDataFrame([(i, k, f(t)) for i, (t, _, _) in enumerate(GENUINE) for k, f in enumerate(shapes)], "doc_id int, shape int, text string")
    got = {(r.doc_id, r.shape): (r.licenses, r.license_kind) for r in licenses.scan(docs).collect()}
    assert got == {(i, k): (n, kind) for i, (_, n, kind) in enumerate(GENUINE) for k in range(len(shapes))}


def test_secrets_within_long_runs():
    key, hexa = "ghp_x7Kq2ZbV9mT4wLr8YsN1cJd5Hf3Gp6Ae0UiQ", "0123456789abcdef01234567"
    net = secret_scan.trained()
    for t in (f"see download.example.com/files/releases/{key}/archive/latest/documents/index.html here", f"see {hexa}/{key} here", f"see {key}/{hexa} here"):
        at = t.index(key)
        assert any(k == 3 and a <= at and e >= at + len(key) for a, k, e in secret_scan.scan_texts([t], net)[0]), t
    for n in range(1, 300):
        seen = secret_scan.views(5, 5 + n)[1:] or [(5, 5 + n)]
        assert seen[0][0] == 5 and seen[-1][1] == 5 + n and all(e - b <= secret_scan.INSIDE for b, e in seen) and all(x[1] - y[0] >= 20 for x, y in zip(seen, seen[1:]))


def test_masking(spark):
    r = secret_scan.masked(spark.createDataFrame([(TEXTS[6],), (None,)], "text string")).collect()
    assert r[0].text == "[SECRET]\"" and r[1].text is None


def test_toxicity_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    bad, good = ([r.score for r in rows if r.held_out and labels[r.doc_id] == k] for k in (1, 0))
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) > 0.7 * len(bad) * len(good)


def test_pipeline(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).columns == docs.columns
    out = pipeline.run(spark, tables[0])
    assert {r.doc_id for r in out.collect()} <= {3, 8, None} and out.where("NOT round_trip").count() == 0
    assert pipeline.run(spark, tables[1]).count() == 0
