"""Language, quality, fingerprints, decontamination, licences, WARC, pipeline: edge cases, brute force, held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib

import numpy as np

TINY = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "the word and the other word of that"), (5, "the word and the other word of that"), (None, "le mot et la chose"), (6, "é" * 40000)]


def odd(spark):
    return spark.createDataFrame([(d, t, "x", 0.5) for d, t in ODD], "doc_id long, text string, score string, carried double")


def empty(spark, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame([], schema)


# Language


def test_language_held_out_accuracy_and_folds(spark):
    from lumenspark.llm.op1 import op1_language_id

    out = op1_language_id(spark, SMALL).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in out if r.held_out]
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    from pyspark.sql import functions as F

    from lumenspark.llm.language import fit_on, identify

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    network = fit_on(docs, F.lit(True), sample=100)
    got = identify(odd(spark), network).collect()
    by = {r.doc_id: r for r in got}
    assert [by[d].lang_pred for d in (1, 2, 3, 4)] == ["und"] * 4 and by[5].lang_pred != "und" and by[6].lang_pred != "und"
    assert len(got) == len(ODD) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert identify(empty(spark), network).count() == 0
    assert {r.lang_pred for r in identify(odd(spark), fit_on(empty(spark), F.lit(True))).collect()} == {"und"}


def test_language_sample_has_every_language(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lumenspark.llm import language

    monkeypatch.setattr(language, "train", lambda x, labels: [(w.tobytes().rstrip(b"\0").decode(), name) for w, name in zip(x[::2], labels[::2])])
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 1200).cast("string").alias("lang"))
    got = language.fit_on(docs, F.lit(True))
    assert sorted(r[1] for r in got) == sorted(2 * [str(i) for i in range(1200)]) and len(set(got)) == 2400
    crowd = docs.limit(0).union(spark.range(500).selectExpr("7L", "'same'", "'a'")).union(spark.range(20).selectExpr("id", "'x'", "'b'"))
    assert {r[1] for r in language.fit_on(crowd, F.lit(True), sample=10)} == {"a", "b"}
    # more languages than rows: the commonest, one row each; and an id that a third of the rows share
    many = docs.union(spark.range(5000, 5900).selectExpr("id", "concat('more ', id)", "'7'")).union(spark.range(1500).selectExpr("11L", "concat('copy ', id % 3)", "'11'"))
    got = language.fit_on(many, F.lit(True), sample=1000)
    assert len(got) == 1000 and len({r[1] for r in got}) == 1000 and "7" in {r[1] for r in got}
    hot = spark.range(400).selectExpr("5L AS doc_id", "'same words' AS text", "'a' AS lang").union(spark.range(20).selectExpr("id", "concat('x ', id)", "'b'"))
    assert sorted(r[1] for r in language.fit_on(hot, F.lit(True), sample=10)) == ["a", *["b"] * 5]


def test_language_tables_equal_the_network():
    from lumenspark.llm.language import EMBEDDING, WIDTHS, WINDOW, Scorer, train

    network = train(np.frombuffer((b"abc def " * 32 + b"xyz uvw " * 32), np.uint8).reshape(2, WINDOW), ["a", "b"], epochs=1)
    scorer = Scorer(network)
    windows = np.random.default_rng(1).integers(0, 256, (3, scorer.reach)).astype(np.uint8)
    emb = network.embedding[windows]
    pooled = [np.max([emb[:, i : i + w].reshape(3, w * EMBEDDING) @ f for i in range(WINDOW)], axis=0) for w, f in zip(WIDTHS, network.filters)]
    assert np.allclose(scorer._log(windows), network.pooled_to_log(np.concatenate(pooled, axis=1)), atol=1e-4)


# Quality


def test_quality_held_out_accuracy_and_folds(spark):
    from lumenspark.llm.op5 import op5_quality_classifier

    out = op5_quality_classifier(spark, SMALL).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_quality_edges(spark):
    from pyspark.sql import functions as F

    from lumenspark.llm.quality import quality_scores, train

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{TINY}/labels.parquet"), F.lit(True), sample=100)
    got = quality_scores(odd(spark), machine, carry=("doc_id", "score")).select("carried.doc_id", "score").collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality_scores(empty(spark), machine).count() == 0
    none = train(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {round(r.score, 6) for r in quality_scores(odd(spark), none).collect()} == {0.5}


def test_machine_equals_the_sum_over_pairs():
    import pyarrow as pa

    from lumenspark.llm.quality import FACTORS, WIDTH, Machine, features

    rng = np.random.default_rng(2)
    m = Machine(0.3, rng.normal(size=WIDTH).astype(np.float32), rng.normal(size=(WIDTH, FACTORS)).astype(np.float32))
    x = features(pa.array(["a b a c\nd 12 %% x", None, "word"]))
    for i, raw in enumerate(m.sums(x)[0]):
        slot, value = x.slot[x.first[i] : x.first[i + 1]], x.value[x.first[i] : x.first[i + 1]]
        pairs = sum(m.factor[slot[a]] @ m.factor[slot[b]] * value[a] * value[b] for a in range(len(slot)) for b in range(a))
        assert np.isclose(raw, 0.3 + m.weight[slot] @ value + pairs, rtol=1e-3, atol=1e-3)


# Fingerprints


def canonical(text):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", fold).strip(" ")


def fingerprint_facts(rows):
    order = sorted(range(len(rows)), key=lambda i: -rows[i][0])
    out = {}
    for at, i in enumerate(order):
        text, nxt = rows[i][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        out[rows[i][0]] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(text) == canonical(edited)), float(canonical(text) == canonical(nxt)), canonical(text), canonical(edited))
    return out


def check_fingerprints(out, rows):
    want = fingerprint_facts(rows)
    assert len(out) == len(rows)
    names = {}
    for r in out:
        n, sha, near_edited, near_next, c, e = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near_edited, near_next)
        for text, name in ((c, r.fingerprint), (e, r.edited_fingerprint)):
            assert names.setdefault(text, name) == name
    assert len(set(names.values())) == len(names)


def test_fingerprints_query(spark):
    from lumenspark.llm.op2 import op2_document_fingerprints

    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    check_fingerprints(op2_document_fingerprints(spark, TINY).collect(), rows)


def test_fingerprints_edges(spark):
    from lumenspark.llm.fingerprints import document_fingerprints

    rows = [(10, "Ａb c"), (900, "ab  C\n"), (901, "é Straße"), (-5, "É STRASSE"), (7, None), (8, ""), (9, " \t"), (12, "😀" * 7), (13, "x" * 50000), (14, "x" * 50000)]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, cell string, target int")
    out = document_fingerprints(df).collect()
    check_fingerprints(out, rows)
    name = {r.doc_id: r.fingerprint for r in out}
    assert name[10] == name[900] and name[901] == name[-5] and name[7] == name[8] == name[9] and name[13] == name[14]
    same = document_fingerprints(odd(spark)).collect()  # ties and a null id
    assert len(same) == len(ODD) and len({r.fingerprint for r in same if r.doc_id == 5}) == 1
    one = document_fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert document_fingerprints(empty(spark)).count() == 0


def test_fingerprints_with_colliding_digests(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lumenspark.llm import fingerprints

    monkeypatch.setattr(fingerprints, "digest", lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1))
    rows = [(i, "abcdefgh"[: i % 7] * (i % 5)) for i in range(60)]
    check_fingerprints(fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_fingerprints_of_far_clustered_and_repeated_ids(spark):
    from lumenspark.llm.fingerprints import document_fingerprints, with_next

    ids = [-(1 << 63), (1 << 63) - 1, 1 << 62, *range(1000, 1400)]
    rows = [(d, f"text {d} of words") for d in ids]
    check_fingerprints(document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    hot = rows + [(1100, f"more {i}") for i in range(600)] + [(None, f"none {i}") for i in range(50)]
    led = with_next(spark.createDataFrame(hot, "doc_id long, text string").coalesce(4))
    got = {(r.doc_id, r.text): (r.next_id, r.next_text) for r in led.collect()}
    start = ((1 << 63) - 1, f"text {(1 << 63) - 1} of words")
    seen = [start]
    while got[seen[-1]] != start and len(seen) <= len(hot):
        seen.append(got[seen[-1]])
    order = [d for d, _ in seen]
    assert sorted(map(str, seen)) == sorted(map(str, hot)) and order[: len(order) - 50] == sorted([d for d, _ in hot if d is not None], reverse=True)


# Decontamination


def test_contained_items(spark):
    from lumenspark.llm.decontamination import contaminated, sketch_length

    item = " ".join(f"w{i}" for i in range(20))
    near = item.replace("w19", "other")  # 15 of 16 shingles
    far = item.replace("w5", "other").replace("w14", "other")  # 6 of 16
    long = " ".join(f"u{i}" for i in range(30000))
    docs = spark.createDataFrame([(1, f"{long} {item.upper()}, {long}", 1), (2, f"a {near}", 2), (3, far, 3), (4, None, 4), (5, "", 5), (6, "short item", 6), (None, item, 7), (2, item, 8)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, item, 0), (11, None, 0), (12, "short item", 0), (13, "!!", 0)], "item_id long, text string, doc_id int")
    for limit in (1_000_000, 5):
        got = sorted([(r.doc_id or 0, r.item_id, r.n_shared, r.n_shingles) for r in contaminated(docs, items, broadcast_limit=limit).collect()])
        assert got == [(0, 10, 16, 16), (1, 10, 16, 16), (2, 10, 16, 16), (6, 12, 1, 1)]
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    for n in range(1, 300):  # a contained item can't miss the whole sketch
        assert n - -(-n * 80 // 100) < sketch_length(n, 80) <= n


def test_decontamination_equals_sql(spark):
    import duckdb

    from lumenspark.llm.op3 import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cols = ["doc_id", "item_id", "n_shared", "n_shingles", "containment"]
    for name, f in QUERIES.items():
        assert sorted(map(tuple, f(spark, SMALL).select(cols).collect())) == sorted(map(tuple, con.sql(SQL[name]).df()[cols].itertuples(index=False)))


def test_short_items_and_large_benchmarks(spark):
    from lumenspark.llm.decontamination import contaminated

    rng = np.random.default_rng(5)
    drawn = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 12, n))
    docs = [(1, "so 6 Times 7, is"), (2, "6 times or 7"), (3, "6 times 7"), (3, "6 times 7"), (None, "is 6 times 7 for all of us here"), (4, "times"), (5, "")]
    docs += [(10 + i, drawn(int(n))) for i, n in enumerate(rng.integers(1, 60, 60))]
    items = [(1, "6 times 7"), (2, "times"), (3, "so 6 times 7"), (4, None)] + [(10 + i, drawn(int(n))) for i, n in enumerate(rng.integers(1, 8, 40))]
    want = {}
    for d, text in docs:
        for i, item in items:
            w, v = re.findall("[a-z0-9]+", text.lower()), re.findall("[a-z0-9]+", (item or "").lower())
            grams = lambda x, n: {tuple(x[a : a + n]) for a in range(len(x) - n + 1)}
            n = min(5, len(v))
            if n and 100 * len(grams(w, n) & grams(v, n)) >= 80 * len(grams(v, n)):
                want[d, i] = len(grams(w, n) & grams(v, n)), len(grams(v, n))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 5):
        assert {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in contaminated(*frames, broadcast_limit=limit).collect()} == want
    plain = [contaminated(spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/benchmark.parquet"), broadcast_limit=limit) for limit in (1_000_000, 5)]
    assert sorted(plain[0].collect()) == sorted(plain[1].collect()) and plain[0].count()


# Licences


def test_license_rules(spark):
    from lumenspark.llm.licenses import scan

    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
    condition = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, f"x\n{grant} Other words. {condition}"), (2, f"{condition} {grant}"), (3, "Released under the MIT License."), (4, "released UNDER the  MIT-License"), (5, None), (6, ""), (7, "This was released under the MIT License."), (8, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (None, "a. " * 20000)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, licenses int")).collect()}
    assert [got[i].licenses for i in range(1, 9)] == [["MIT"], [], ["MIT"], ["MIT"], [], [], [], ["Apache-2.0", "CC-BY-NC-4.0"]]
    assert got[2].sentence_ids == ["mit-condition", "mit-grant"] and got[5].n_sentences == 0 and got[None].n_sentences == 20000
    assert scan(empty(spark)).count() == 0


def license_ids(text, sentences):
    """Known sentences of a text by trying every run of pieces of a paragraph, the longest first."""
    normal = lambda s: " ".join(re.findall("[a-z0-9]+", s.lower()))
    found = []
    for paragraph in re.split(r"\n[^A-Za-z0-9\n]*(?=\n)", text.replace("\r\n", "\n").replace("\r", "\n")):
        pieces = [p for p in map(normal, re.split(r"[.!?;:][ \t]+|\n+", paragraph)) if p]
        at = 0
        while at < len(pieces):
            runs = [n for n in range(len(pieces) - at, 0, -1) if " ".join(pieces[at : at + n]) in sentences]
            found += [sentences[" ".join(pieces[at : at + n])] for n in runs[:1]]
            at += runs[0] if runs else 1
    return found


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def test_license_texts_wrapped_and_unwrapped(spark):
    import textwrap

    from lumenspark.llm.licenses import FULL_SENTENCES, SENTENCES, scan

    semicolon = GPL_TEXT.replace("software:", "software;").replace("Foundation, either", "Foundation; either")
    texts = {"MIT": MIT_TEXT, "BSD": BSD_TEXT, "BSD list": BSD_TEXT.replace("1.", "(1)").replace("2.", "(2)").replace("3.", "(c)"), "GPL": GPL_TEXT, "GPL ;": semicolon, "Apache": APACHE_TEXT}
    want = {
        "MIT": (["mit-grant", "mit-condition", "mit-warranty"], ["MIT"]),
        "BSD": (["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], ["BSD-3-Clause"]),
        "GPL": (["gpl3-or-later-grant", "gpl-warranty"], ["GPL-3.0-or-later"]),
        "Apache": (["apache2-notice", "apache2-condition", "apache2-warranty"], ["Apache-2.0"]),
    }
    rows = []
    for name, text in texts.items():
        for width in (30, 50, 72, 79, 10**6):
            wrapped = "\n\n".join(textwrap.fill(p.strip(), width) for p in text.split("\n\n"))
            rows += [(name, wrapped), (name, "Some words here.\n\n" + textwrap.indent(wrapped, " * ", lambda _: True)), (name, wrapped.replace("\n", "\r\n")), (name, f"A title\n{wrapped}\nthe end")]
    rows += [("BSD", BSD_TEXT.replace("the copyright holder nor", owner)) for owner in ("Example, Inc. nor", "the\nUniversity nor", "the copyright\nholder\nnor")]
    many = " \n" * 50000 + "is the above. " * 20000 + GPL_TEXT.replace("either", "\n\neither")
    docs = spark.createDataFrame([*[(i, t) for i, (_, t) in enumerate(rows)], (-1, many), (-2, "the above" + "é" * 200000)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    known = SENTENCES | FULL_SENTENCES
    for i, (name, text) in enumerate(rows):
        assert (got[i].sentence_ids, got[i].licenses) == want[name.split(" ")[0]], text
        if name != "BSD list" and i < len(rows) - 3:
            assert got[i].sentence_ids == license_ids(text, known)
    # a blank line ends a sentence
    assert got[-1].sentence_ids == ["gpl3-version", "gpl-warranty"] and got[-1].licenses == [] and got[-2].sentence_ids == []


def test_equal_rows_of_a_third_of_the_table_and_long_heads(spark, monkeypatch):
    from lumenspark.llm import fingerprints as f

    rows = [(d, f"text {d}") for d in range(60)] + [(30, "same words")] * 400 + [(None, "nobody")] * 300 + [(59, "x" * 3_000_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    led = f.expanded(f.with_next(frame, least=20)).collect()
    plain = f.expanded(f.with_next(frame, least=10_000)).collect()
    assert len(led) == len(rows) and sorted(map(str, led)) == sorted(map(str, plain))
    follows = {}
    for r in led:
        follows.setdefault((r.doc_id, r.text), []).append((r.next_id, r.next_text))
    assert follows[30, "same words"].count((30, "same words")) == 399 and follows[None, "nobody"].count((None, "nobody")) == 299
    monkeypatch.setattr(f, "PART", 7)
    monkeypatch.setattr(f, "LEAST", 20)
    assert sorted(map(str, f.expanded(f.with_next(frame, least=20)).collect())) == sorted(map(str, led))
    plan = f.with_next(frame)._jdf.queryExecution().executedPlan().toString()
    broadcast = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    assert broadcast and "head_text" not in plan


def test_beginnings_titles_and_longer_rules(spark):
    from lumenspark.llm.licenses import scan

    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    rows = {
        "Released under the MIT license, see LICENSE.": ["MIT"],
        "the content of this page is licensed under CC-BY-4.0.": ["CC-BY-4.0"],
        "Dual licensed under the MIT license or the Apache License, Version 2.0": ["Apache-2.0", "MIT"],
        "It is unlicensed under the MIT licensees": [],
        "GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": ["GPL-3.0-only"],
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/": ["Apache-2.0"],
        "Mozilla Public License Version 2.0\n==================================": ["MPL-2.0"],
        bsd: ["BSD-2-Clause"],
        bsd + third: ["BSD-3-Clause"],
        bsd + third + "\n\nand for the rest\n\n" + bsd: ["BSD-2-Clause", "BSD-3-Clause"],
    }
    got = {r.doc_id: r.licenses for r in scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [sorted(got[i]) for i in range(len(rows))] == list(rows.values())


def test_spdx_expressions_and_old_names(spark):
    from lumenspark.llm.licenses import scan

    rows = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "# SPDX-License-Identifier: GPL-2.0": ["GPL-2.0-only"],
        "/* SPDX-License-Identifier: GPL-2.0+ */\nint x;": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: (LGPL-2.1-only OR BSD-3-Clause) AND ISC": ["BSD-3-Clause", "ISC", "LGPL-2.1-only"],
        "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0\n\nand mit": ["GPL-2.0-or-later"],
        "spdx-license-identifier: LGPL-3.0+\nSPDX-License-Identifier:\tmpl-2.0": ["LGPL-3.0-or-later", "MPL-2.0"],
        "SPDX-License-Identifier: Made-Up-1.0": [],
        "MIT OR Apache-2.0": [],
    }
    got = {r.doc_id: r.licenses for r in scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [sorted(got[i]) for i in range(len(rows))] == list(rows.values())


def test_other_licenses_and_tags(spark):
    import textwrap

    from lumenspark.llm.licenses import scan

    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = [
        ("GPL-2.0-or-later", gnu.format("program", "", "2")),
        ("LGPL-2.1-or-later", gnu.format("library", "Lesser ", "2.1")),
        ("LGPL-3.0-or-later", gnu.format("library", "Lesser ", "3")),
        ("AGPL-3.0-or-later", gnu.format("program", "Affero ", "3").replace("software;", "software:").replace("Foundation;", "Foundation,")),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it."),
        ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin"),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("MIT", "This project is licensed under the MIT License."),
        ("MIT", "// SPDX-License-Identifier: MIT"),
        ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0-only */"),
    ]
    rows = [(name, some) for name, text in texts for some in (text, "\n\n".join(textwrap.fill(p, 60) for p in text.split("\n\n")), f"Words before it.\n{text}\nWords after it.")]
    got = {r.doc_id: r.licenses for r in scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [[name] for name, _ in rows]


def test_licenses_equal_sql(spark):
    import duckdb

    from lumenspark.llm.op9 import QUERIES, SQL

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    cols = ["doc_id", "n_sentences", "sentence_ids", "licenses", "n_licenses"]
    for name, f in QUERIES.items():
        assert sorted(map(tuple, f(spark, SMALL).select(cols).collect())) == sorted(map(tuple, con.sql(SQL[name]).df()[cols].itertuples(index=False)))


# WARC


def test_fixity_finds_every_fault(spark):
    from lumenspark.llm.warc import fixity, records

    pages = [(i * 37 % 9001, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(300)] + [(None, None, None), (5, "a", "b"), (5, "a", "c"), (70000, "u", "é" * 50000)]
    changed = {37: "corrupt", 74: "missing"}
    copy = [(p, u, "other" if p == 37 else h) for p, u, h in pages if p != 74] + [(123456, "new", "page")]
    schema = "page_id long, url string, html string"
    make = lambda rows: records(spark.createDataFrame(rows, schema))
    out = {r.page_id: r for r in fixity(make(pages), make(copy)).collect()}
    assert {k: r.state for k, r in out.items() if r.state != "ok"} == changed | {123456: "added"}
    assert set(out) == {p for p, _, _ in pages} | {123456}
    first = sorted((r.offset, r.length) for r in out.values() if r.archive == 0 and r.offset is not None)
    assert all(a + n == b for (a, n), (b, _) in zip(first, first[1:]))
    assert {r.state for r in fixity(make(pages), make(pages[::-1])).collect()} == {"ok"}
    assert fixity(make([]), make([])).count() == 0
    assert {r.state for r in fixity(make(pages), make([])).collect()} == {"missing"}


def test_warc_query(spark):
    from lumenspark.llm.op10 import op10_warc_fixity

    ids = [r.page_id for r in spark.read.parquet(f"{TINY}/pages.parquet").collect()]
    luck = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 97 for i in ids}
    want = {i: "missing" if n == 0 else "corrupt" if n in (1, 2) else "ok" for i, n in luck.items()}
    assert {r.page_id: r.state for r in op10_warc_fixity(spark, TINY).collect()} == want


def test_fixity_equals_sql(spark):
    import duckdb

    from lumenspark.llm.op10 import SQL, op10_warc_fixity

    got = op10_warc_fixity(spark, SMALL).collect()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SMALL}/pages.parquet'")
    want = con.sql(SQL["op10_warc_fixity"]).fetchall()
    names = [c[0] for c in con.sql(SQL["op10_warc_fixity"]).description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(want)


def test_fixity_of_shared_ids_nulls_and_other_columns(spark):
    from lumenspark.llm.warc import fixity, records

    rows = [(1, "u", "a"), (1, "u", "b"), (1, "u", "b"), (2, None, None), (None, "n", "x"), (5000, "u", "é" * 3000)]
    schema = "page_id long, url string, html string, hash string, place int, archive string"
    make = lambda some: records(spark.createDataFrame([(*r, "h", 1, "z") for r in some], schema))
    state = lambda a, b: {r.page_id: r.state for r in fixity(make(a), make(b)).collect()}
    assert state(rows, rows[::-1]) == {1: "ok", 2: "ok", None: "ok", 5000: "ok"}
    assert state(rows, rows[1:]) == {1: "corrupt", 2: "ok", None: "ok", 5000: "ok"}
    assert state(rows[:4] + [rows[0]], rows[:4] + [rows[1]])[1] == "corrupt"  # as many, with the same least and greatest
    large = [((1 << 62) + 3584, "u", "b"), ((1 << 62) + 4096, "u", "c"), (-5, "u", "d"), (-(1 << 63), "u", "e"), ((1 << 63) - 1, "u", "f")]
    out = {r.page_id: r for r in fixity(make(large), make(large[1:])).collect()}
    assert out[(1 << 62) + 3584].state == "missing" and out[(1 << 62) + 3584].archive == (1 << 50) and out[(1 << 62) + 4096].archive == (1 << 50) + 1
    assert all(r.archive == r.page_id // 4096 and (r.state == "ok") == (r.page_id != (1 << 62) + 3584) for r in out.values())
    assert state(rows[:4], [*rows[:3], *rows[4:]]) == {1: "ok", 2: "missing", None: "added", 5000: "added"}


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        made = stage(spark, kept, TINY).cache()
        assert made.columns == docs.columns
        assert made.count() <= kept.count()
        kept = made
    ids = {r.doc_id for r in kept.collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in docs.collect() if any(b in r.text for b in benchmark)}
    assert not ids & dirty
    packed = p.run(spark, TINY).collect()
    assert {r.doc_id for r in packed} == ids
    assert max(r.offset + r.length for r in packed) <= 1024


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string"
    docs = spark.createDataFrame([(d, t, None, None, None, "x") for d, t in ODD], schema)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), TINY).count() == 0
    assert set(p.quality(spark, docs, TINY).collect()) <= set(docs.collect())
    near = p.near_dedup(spark, docs, TINY)
    assert near.columns == docs.columns
    assert sorted([tuple(r)[:2] for r in near.collect()], key=str) == sorted(set(ODD), key=str)
    passages = p.passage_dedup(spark, docs, TINY).collect()
    assert sorted([(r.doc_id, r.text) for r in passages], key=str) == sorted([(d, t or "") for d, t in ODD], key=str)
    assert sorted([tuple(r)[:2] for r in p.decontamination(spark, docs, TINY).collect()], key=str) == sorted(ODD, key=str)
    assert sorted([r.doc_id for r in p.packing(spark, docs, TINY).where("piece = 0").collect()], key=str) == sorted([d for d, _ in ODD], key=str)


def test_pipeline_drops_copies_and_items_of_rows_without_id(spark):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{TINY}/benchmark.parquet").first().text
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (7, text), (7, text), (None, text), (8, text + " more"), (9, f"before {item} after"), (None, f"also before {item} and after"), (None, "a text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in p.near_dedup(spark, docs, TINY).collect() if r.text.startswith("word0")] == [7]
    assert not [r for r in p.decontamination(spark, docs, TINY).collect() if item in r.text]
    long = " ".join(f"p{i}" for i in range(51))
    rows = [(1, f"start {long} end"), (2, f"other {long} tail"), (3, "x " + " ".join(f"p{i}" for i in range(45))), (None, long)]
    got = {r.doc_id: r.text for r in p.passage_dedup(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars long"), TINY).collect()}
    assert got[1] == rows[0][1] and got[2].split() == ["other", "tail"] and got[3] == rows[2][1] and None not in got
