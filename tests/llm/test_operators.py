"""Each operator against a brute-force version on small tables with the awkward cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm import bpe, extraction, hmm, licenses, mixing, neighbours, quality, queries, sharding, simhash, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}é" if i % 7 == 0 else f"w{i}" for i in rng.integers(0, words, n).tolist())


def sample() -> list[tuple]:
    shared, other = prose(1, 60), prose(2, 25)
    texts = [
        None, "", " \n\t ", "one", "one", prose(3, 19), prose(3, 20), prose(3, 20), shared, f"{prose(4, 30)}\n{shared} {prose(5, 40)}", f"{shared}\n\n{other}",
        f"{prose(6, 9)} {other} {other} {prose(7, 30)}", "a " * 70, "a b c " * 30, shared.upper(), prose(8, 5000), f"{prose(8, 5000)} x", "x" * 9000, f"{prose(9, 200)} # $ %",
        f"{prose(10, 40)}\n{prose(10, 40)}\n{prose(11, 10)}", f"{other} under the MIT License, Apache License, Version 2.0 CC-BY-NC 4.0", "É b \x85 c d",
    ]
    langs, sources = ["en", "fr", None], ["s0", "s0", "s1", None]
    rows = [(i * 3, t, langs[i % 3], sources[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [(9, prose(12, 50), "en", "s0", 1), (9, prose(12, 50), "en", "s0", 1), (None, shared, "en", "s1", 1), (None, other, None, None, None), (-5, f"{other} z", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_all_operators_take_empty_tables(spark, empty):
    for out in (
        mixing.mixed(empty), substrings.remove_repeats(empty), licenses.scanned(empty), sharding.hilbert_shards(empty), quality.quality_rules(empty), hmm.scored(empty),
        bpe.encoded(empty, queries.vocabulary()), simhash.near_duplicates(empty), simhash.one_of_each(empty),
        extraction.extracted(spark.createDataFrame([], "page_id long, url string, html string")), neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert out.collect() == []


CLASHES = ["a.b", "a`b", "__body", "_body", "body", "block", "bucket", "key", "_key", "rest", "row", "fp", "_fp", "__u", "curve_", "_x0", "x0", "html_", "words", "_hits", "value", "measure", "DOC", "n"]


def test_extra_columns_with_clashing_names_pass_through(spark):
    rows = [(i, prose(i, 30), "en", "s", *[f"{c} {i}" for c in CLASHES]) for i in range(4)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *CLASHES])
    vectors = spark.createDataFrame([(i, [1.0, float(i)], *CLASHES) for i in range(3)], ["vec_id", "embedding", *CLASHES])
    pages = spark.createDataFrame([(1, "u", "<p>some text</p>", *[f"{c} 1" for c in CLASHES])], ["page_id", "url", "html", *CLASHES])
    for out in (
        mixing.mixed(docs), substrings.remove_repeats(docs), licenses.scanned(docs), sharding.hilbert_shards(docs), quality.quality_rules(docs), hmm.scored(docs), bpe.encoded(docs, queries.vocabulary()),
        simhash.near_duplicates(docs), simhash.one_of_each(docs), extraction.extracted(pages),
    ):
        key = out.columns.index("doc_id" if "doc_id" in out.columns else "page_id")
        places = [(c, out.columns.index(c)) for c in CLASHES]
        assert all(r[at] == f"{c} {r[key]}" for r in out.collect() for c, at in places)
    assert neighbours.nearest(vectors, 2, every=1).count() == 6


def test_columns_of_made_names_are_replaced(spark):
    made = ["n_words", "kept", "KEPT", "n_removed", "copy", "score", "labels", "shard", "component_id", "ids", "n_tokens", "n_chars_", "detections", "rate", "Score"]
    docs = spark.createDataFrame([(i, prose(i, 30), "en", "s", *["old"] * len(made)) for i in range(3)], ["doc_id", "text", "lang", "source", *made])
    for out in (mixing.mixed(docs), substrings.remove_repeats(docs), licenses.scanned(docs), sharding.hilbert_shards(docs), quality.quality_rules(docs), hmm.scored(docs), bpe.encoded(docs, queries.vocabulary()), simhash.near_duplicates(docs)):
        names = [c.lower() for c in out.columns]
        assert out.count() <= 6 and "n_chars_" in names
        for new in {"copy", "n_removed", "labels", "shard", "kept", "score", "ids", "component_id"} & {f.name for f in out.schema if f.dataType.simpleString() != "string"}:
            assert names.count(new) == 1


# ---- 1 ----


def test_mixing_follows_the_poisson_distribution(spark, docs):
    got = mixing.mixed(docs, {"s0": 3.0, "s1": 1.0}, epochs=4.0)
    rows = sample()
    n = Counter(r[3] for r in rows)
    weight = {"s0": 3.0, "s1": 1.0, None: 0.0}
    want = Counter()
    for doc_id, text, lang, source, n_chars in rows:
        rate = 4.0 * weight[source] * len(rows) / (4.0 * n[source])
        u = int(hashlib.md5(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u and rate:
            k += 1
            p *= rate / k
            c += p
        want.update([(doc_id, text, source, j + 1) for j in range(k)])
    assert Counter((r.doc_id, r.text, r.source, r.copy) for r in got.collect()) == want
    assert set(got.columns) == {*docs.columns, "copy", "rate", "shuffle_key"}


def test_mixing_meets_target_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    got = {r.source: r["count"] for r in mixing.mixed(docs).groupBy("source").count().collect()}
    assert len(got) == 6 and all(abs(n - 1000) < 160 for n in got.values())


def test_very_high_rates_are_quick_and_right(spark):
    rows = [(i, "hot") for i in range(40_000)] + [(50_000, "rare")]
    table = mixing.rates(spark.createDataFrame(rows, "doc_id long, source string"), {"rare": 1.0, "hot": 1e-9}, epochs=25.0)
    r = {x.key: x for x in table.collect()}["rare"]
    assert r.rate > 1e6 and len(r.cdf) < 100 and r.draws * mixing.STEP >= r.rate
    few = mixing.mixed(spark.createDataFrame(rows[:2000:100] + rows[-1:], "doc_id long, source string"), {"rare": 1.0, "hot": 0.0}, epochs=200.0)
    n = few.count()
    assert abs(n - 4200) < 6 * 4200**0.5  # 21 rows x 200 epochs, all of them copies of one document
    assert sorted(x.copy for x in few.select("copy").collect()) == list(range(1, n + 1))


# ---- 2 ----


def brute_repeats(rows, length=20):
    seen, out = set(), []
    for doc_id, text, *_ in ordered(rows):
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            if g in seen:
                gone[i : i + length] = [True] * length
            seen.add(g)
        kept = " ".join(x for x, o in zip(w, gone) if not o)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if any(gone) else text))
    return Counter(out)


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substring_dedup_equals_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = substrings.remove_repeats(docs, block_bytes=20_000)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got.collect()) == brute_repeats(sample())


def test_substring_dedup_with_many_overlaps(spark):
    rng = np.random.default_rng(5)
    base = prose(20, 300, 50).split()
    rows = []
    for i in range(60):
        a, n = int(rng.integers(0, 250)), int(rng.integers(15, 50))
        rows.append((i, " ".join(base[a : a + n] + prose(100 + i, int(rng.integers(0, 12))).split() + base[a // 2 : a // 2 + n]), "en", "s", 0))
    rows += [(100 + i, "q r s " * int(rng.integers(6, 15)), "en", "s", 0) for i in range(6)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), block_bytes=3_000)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got.collect()) == brute_repeats(rows)


def test_suffix_automaton_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(30):
        passages = [rng.integers(0, 3, int(rng.integers(1, 15))).tolist() for _ in range(4)]
        automaton = substrings.SuffixAutomaton()
        for p in passages:
            automaton.add(p)
        query = rng.integers(0, 4, 20).tolist()
        parts = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = [max([n for n in range(i + 2) if n == 0 or tuple(query[i + 1 - n : i + 1]) in parts]) for i in range(len(query))]
        assert automaton.statistics(query) == want


# ---- 3 ----


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[7] = v[8] = v[20]
    rows = [(i, v[i].tolist()) for i in range(300)] + [(40, v[40].tolist()), (301, None), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] * 16), (305, [1.0]), (320, [float("inf")] * 16), (None, v[3].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, 20, every=20, block=64).collect()
    ids = np.array([*range(300), 40])
    x = np.vstack([v, v[40]]).astype(float)
    want = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want += [(int(ids[i]), r + 1, int(ids[j]), round(float(s[j]), 9)) for r, j in enumerate(np.lexsort((ids, -s))[:20])]
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == Counter(want)


@pytest.mark.parametrize("size", [1e-200, 1e-30, 1e30, 1e150, 1e153])
def test_neighbours_of_very_large_and_small_vectors(spark, size):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 4)) * size
    v[::3] *= 1e-3
    got = neighbours.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), 5, every=4, block=16).collect()
    want = []
    for i in range(0, 60, 4):
        s = (v * v[i]).sum(axis=1)
        s[i] = -np.inf
        want += [(i, r + 1, int(j)) for r, j in enumerate(np.lexsort((np.arange(60), -s))[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(want)


def test_no_neighbour_is_lost_when_scores_overflow(spark):
    v = np.abs(np.random.default_rng(8).normal(size=(60, 4))) * 1e160
    got = neighbours.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), 20, every=1).collect()
    assert len(got) == 1200 and all(r.score == math.inf for r in got)


def test_rows_that_share_a_vec_id_spread_over_blocks(spark):
    rng = np.random.default_rng(9)
    frame = spark.createDataFrame([(20, rng.normal(size=4).tolist()) for _ in range(500)], "vec_id long, embedding array<double>")
    packs = neighbours.gathered(neighbours.usable(frame), 10, 20).collect()
    assert len(packs) == 10 and max(len(r.ids) for r in packs) < 8 * 100
    got = neighbours.nearest(frame, 3, every=20, block=50).collect()
    assert len(got) == 1500 and {r.vec_id for r in got} == {20}


def test_fewer_candidates_than_k(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(frame, 20).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]


# ---- 4 ----


def test_license_scan(spark, docs):
    got = {(r.doc_id, r.n_words, r.n_base): r for r in licenses.scanned(docs).collect()}
    for doc_id, text, *_ in sample():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[(doc_id, len(w), len(places))]
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_suppression(spark):
    cases = {
        "Licensed under the GNU General Public License, version 3.": "gpl-3",
        "GPL v2 or later": "gpl-2-or-later",
        "the BSD 3-Clause License": "bsd-3",
        "cc by-nc-sa 4.0": "cc-by-nc,cc-by-nc-sa-4",
        "we permit this and admit that": "",
        "Apache License, Version 2.0 and Apache License, Version 2.0": "apache-2",
    }
    rows = [(i, t) for i, t in enumerate(cases)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i].labels for i, t in rows} == cases
    assert got[5].n_base == 2 and (got[5].first_word, got[5].last_word) == (0, 6)
    assert len(licenses.rules()) > 300


LICENSES = [
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "This library is free software under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. * Neither the name of the X nor the names of its contributors may be used to endorse. THIS SOFTWARE IS PROVIDED",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that. THIS SOFTWARE IS PROVIDED",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "SPDX-License-Identifier: Apache-2.0 OR MIT", "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause AND CC-BY-4.0", "licensed under the GPL version 2 or any later version",
    "under the terms of the mit license, apache license version 2 or gpl v3 only; cc by nc sa 4.0", "released into the public domain. All rights reserved. Copyright (c) 2020 cc-by-nc", "available under the Mozilla Public License 2.0 or later",
]
LABELS = ["gpl-3-or-later", "lgpl-2.1-or-later", "apache-2", "bsd-3", "bsd-2", "mit", "apache-2,mit", "bsd-3,cc-by-4,gpl-2-or-later", "gpl-2-or-later", "apache-2,cc-by-nc,cc-by-nc-sa-4,gpl-3,mit", "all-rights-reserved,cc-by-nc,copyright-notice,public-domain", "mpl-2-or-later"]


def brute_licenses(text):
    """Labels, score and detections of a text by another regex engine and plain loops."""
    import regex

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    norm = "".join(f" {w}" for w in words)
    hits = []
    for rank, (label, gate, rule, strength, also) in enumerate(licenses._rules()):
        if f" {gate} " in norm + " " and also in norm + " ":
            for m in regex.finditer(f" {rule}(?= |$)", norm):
                start = norm[: m.start()].count(" ")
                hits.append((start, start + m.group().count(" "), rank, label, strength))
    free = [h for h in hits if not any((o[0] <= h[0] and h[1] <= o[1]) and (o[:2] != h[:2] or o[2] < h[2]) for o in hits)]
    kept = []
    for h in sorted(free, key=lambda h: (h[2], h[0])):
        if not any(k[0] < h[1] and h[0] < k[1] for k in kept):
            kept.append(h)
    base = {label for p, label in licenses.PHRASES.items() if f" {p} " in norm + " "}
    return ",".join(sorted(base | {h[3] for h in kept})), max([1.0 if base else 0.0, *[h[4] for h in kept]]), sorted((h[0], h[1], h[3]) for h in kept)


def test_license_scan_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(LICENSES)] + [(100 + i, f"{prose(i, 30)} {a} {prose(i + 50, 9)}\n{b}") for i, (a, b) in enumerate(zip(LICENSES, LICENSES[1:] + LICENSES[:1]))]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(len(LICENSES))] == LABELS
    for i, t in rows:
        assert (got[i].labels, got[i].score, [(d.start, d.end, d.label) for d in got[i].detections]) == brute_licenses(t), t


def test_license_scan_is_native(docs):
    plan = licenses.scanned(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 5 ----


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><p>Site</p></header><nav><ul><li>Menu</li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><aside>Side</aside><div id=ad-top>Buy</div><article><h1>Head &amp; tail</h1><p>First <b>bold\n text<br>and a longer line of words to read here.<p>Second"
        "&nbsp;para<form><input>Send</form><div class='comments'><p>Me too</p></div></article><footer>Foot</footer></body></html>"
    )
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "plain words"), (5, "u", "<nav>only menu</nav>"), (1, "u", page)]
    got = extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Head & tail\nFirst bold text and a longer line of words to read here.\nSecond para"
    assert (text[2], text[3], text[4], text[5]) == ("", "", "plain words", "") and len(got) == 6
    assert all(r.n_chars == len(r.text) for r in got)


def test_extraction_without_article_element():
    body = "".join(f"<p>{prose(i, 60)}</p>" for i in range(6))
    links = "".join(f"<li><a href='/{i}'>l{i}</a></li>" for i in range(30))
    got = extraction.main_text(f"<body><ul>{links}</ul><div>{body}<p>Short end.</p></div><ul>{links}</ul></body>").split("\n")
    assert set(prose(i, 60) for i in range(6)) <= set(got) and len(got) < 14


# ---- 6 ----


def test_sharding_law(docs):
    got = sharding.hilbert_shards(docs, 7).collect()
    rows = sample()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(7))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_sharding_equals_brute_force(docs):
    """Grid, curve order and cut of every row."""
    rows = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), lang, source) for d, t, lang, source, _ in sample()]
    top, n = 255, len(rows)

    def places(i):
        count = Counter(r[i] for r in rows)
        out, before = {}, 0
        for name in sorted(count, key=lambda x: (x is not None, x or "")):
            out[name] = math.floor((before + count[name] / 2) / n * top)
            before += count[name]
        return out

    lang, source, log = places(3), places(4), [math.log2(r[1]) for r in rows]
    grid = np.array([(lang[r[3]], source[r[4]], math.floor((x - min(log)) / (max(log) - min(log)) * top + 0.5)) for r, x in zip(rows, log)])
    curve = sharding.hilbert(grid, 8).tolist()
    order = sorted(zip(curve, rows), key=lambda x: (x[0], x[1][0] is not None, x[1][0] or 0, x[1][2]))
    want = Counter()
    for i, (c, r) in enumerate(order):
        shard = i * 7 // n
        want[(r[0], r[1], r[2], c, shard, i - -(-shard * n // 7))] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.curve, r.shard, r.slot) for r in sharding.hilbert_shards(docs, 7).collect()) == want


def test_shards_can_be_skipped(spark):
    """A predicate on any dimension reads a part of the 40 files, by their least and greatest values."""
    got = sharding.hilbert_shards(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    files = got.groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("a", F.min), ("z", F.max))]).collect()
    read = lambda c, v: sum(r[f"a_{c}"] <= v <= r[f"z_{c}"] for r in files)
    assert read("lang", "fr") <= 14 and read("lang", "es") <= 14 and read("size", 20_000) <= 14
    assert np.mean([read("source", f"src{i}") for i in range(20)]) <= 16


def test_hilbert_curve_steps_to_neighbours():
    side = 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    path = grid[np.argsort(sharding.hilbert(grid, 3))]
    assert sorted(sharding.hilbert(grid, 3)) == list(range(side**3))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# ---- 7 ----


def test_quality_counts_and_base_rule(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    want = Counter()
    for doc_id, text, *_ in sample():
        w = WORDS.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[(doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w))] += 1
    assert got == want


def test_quality_thresholds_adapt(spark):
    """Two sources with different habits get different fences, and a text is judged by those of its own."""
    code = lambda i, n: f"{prose(i, 200, 5000)} {' '.join('$x' for _ in range(n))}\n" + "\n".join(f"{prose(i + 1, 8, 5000)}\n{{}}x" if i % 3 else prose(i + j, 9, 5000) for j in range(6))
    plain = lambda i: prose(i, 300, 5000)
    rows = [(i, code(i, 20 + i % 12), "en", "code", 0) for i in range(300)] + [(1000 + i, plain(i), "en", "news", 0) for i in range(300)]
    rows += [(2000, code(7, 30), "en", "news", 0), (2001, code(8, 30), "en", "code", 0)]
    limits = {r.source_key: r for r in quality.thresholds(quality.with_counts(spark.createDataFrame(rows, DOCS))).collect()}
    assert limits["=code"].max_symbol_share > 1.5 * limits["=news"].max_symbol_share
    assert limits["=code"].max_dup_line_share > limits["=news"].max_dup_line_share
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[2000] and got[2001] and sum(not k for d, k in got.items() if d < 2000) < 12


def test_quality_sketches_merge_to_the_same_fences(spark, docs):
    one = quality.thresholds(quality.with_counts(docs.coalesce(1))).orderBy("lang_key", "source_key").collect()
    assert one == quality.thresholds(quality.with_counts(docs.repartition(7))).orderBy("lang_key", "source_key").collect()


# ---- 8 ----


def random_model(rng, states: int, symbols: int) -> hmm.Model:
    prob = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(prob(states), prob(states, states), prob(states, symbols))


def brute_forward(model, seq):
    alpha, log = model.start * model.emit[:, seq[0]], 0.0
    for c in seq[1:]:
        log += math.log10(alpha.sum())
        alpha = (alpha / alpha.sum()) @ model.move * model.emit[:, c]
    return log + math.log10(alpha.sum())


def brute_posterior(start, move, emit, seq):
    """Expected starts, moves and states at each token, by unscaled recursions in longer floats."""
    start, move, emit = (np.asarray(x, np.longdouble) for x in (start, move, emit))
    alpha = [start * emit[seq[0]]]
    for c in seq[1:]:
        alpha.append(alpha[-1] @ move * emit[c])
    beta = [np.ones(len(start), np.longdouble)]
    for c in reversed(seq[1:]):
        beta.insert(0, move @ (emit[c] * beta[0]))
    whole = alpha[-1].sum()
    moves = sum((move * np.outer(a, emit[c] * b) / whole for a, b, c in zip(alpha, beta[1:], seq[1:])), np.zeros_like(move))
    states = [a * b / whole for a, b in zip(alpha, beta)]
    return states[0], moves, states, float(np.log10(whole))


@pytest.mark.parametrize("segment", [4, 64, 1024])
def test_forward_recursion_is_exact(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng = np.random.default_rng(2)
    model = random_model(rng, 3, 10)
    seqs = [rng.integers(0, 10, n).astype(np.int32) for n in (1, 5, 64, 65, 700, 3, 3)]
    assert np.allclose(model.score(seqs, model.emit.T), [brute_forward(model, s) for s in seqs], rtol=1e-10)


@pytest.mark.parametrize("segment", [2, 5, 1024])
def test_baum_welch_counts_are_exact_across_rows(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    model = random_model(rng, 3, 6)
    seqs = [rng.integers(0, 6, n).astype(np.int32) for n in (6, 1, 23, 5, 10, 2)]
    each = [brute_posterior(model.start, model.move, model.emit.T, s.tolist()) for s in seqs]
    emits = np.zeros((6, 3))
    for s, (_, _, states, _) in zip(seqs, each):
        for c, x in zip(s, states):
            emits[c] += x.astype(float)
    start, moves, token, state, log = model.counts(seqs, model.emit.T)
    got = np.column_stack([np.bincount(token, state[:, k], minlength=6) for k in range(3)])
    assert np.allclose(start, sum(e[0] for e in each).astype(float)) and np.allclose(moves, sum(e[1] for e in each).astype(float)) and np.allclose(got, emits)
    assert math.isclose(log, sum(e[3] for e in each))


def test_baum_welch_equals_all_paths():
    rng = np.random.default_rng(3)
    model = random_model(rng, 2, 4)
    seq = rng.integers(0, 4, 6)
    paths = [[(p >> i) & 1 for i in range(6)] for p in range(64)]
    joint = [model.start[p[0]] * model.emit[p[0], seq[0]] * np.prod([model.move[a, b] * model.emit[b, c] for a, b, c in zip(p, p[1:], seq[1:])]) for p in paths]
    moves = np.zeros((2, 2))
    for p, j in zip(paths, np.array(joint) / sum(joint)):
        for a, b in zip(p, p[1:]):
            moves[a, b] += j
    got = model.counts([seq.astype(np.int32)], model.emit.T)
    assert np.allclose(got[1], moves) and math.isclose(got[4], math.log10(sum(joint)))


def brute_scores(rows, states, passes):
    """score of every row, with the whole corpus in one place."""
    toks = [[*WORDS.findall(lower(t)), "\n"] for _, t, *_ in rows]
    train = [t for (d, *_), t in zip(rows, toks) if zlib.crc32(b"" if d is None else str(d).encode()) % 10]
    kind = {w: hmm.word_class(w.encode(), hmm.CLASSES) for t in toks for w in t}
    count, of_class = Counter(w for t in train for w in t), np.zeros(hmm.CLASSES)
    for w, c in count.items():
        of_class[kind[w]] += c
    n, v, c = sum(count.values()), len(count), hmm.CLASSES
    model = hmm.Model.first(states, of_class)
    for _ in range(passes):
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((c, states))
        for t in train:
            seq = [kind[w] for w in t]
            a, m, s, _ = brute_posterior(model.start, model.move, model.emit.T, seq)
            start, move = start + a.astype(float), move + m.astype(float)
            for x, k in zip(s, seq):
                emit[k] += x.astype(float)
        smooth = lambda x, add: (x + add) / (x + add).sum(axis=-1, keepdims=True)
        model = hmm.Model(smooth(start, 0.1), smooth(move, 0.1), smooth(emit.T, 0.01))
    share = model.shares()
    expected: dict = {}
    for t in train:
        for w, x in zip(t, brute_posterior(model.start, model.move, model.emit.T, [kind[w] for w in t])[2]):
            expected[w] = expected.get(w, 0) + x.astype(float)
    of = {w: (expected[w] + hmm.DRAW * share[kind[w]]) / (count[w] + hmm.DRAW) if w in expected else share[kind[w]] for w in kind}
    p = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + c))
    total = sum(of[w] * p(w) for w in count) + 0.1 / (n + 0.1 * (v + c)) * share.sum(axis=0)
    number = {w: i for i, w in enumerate(kind)}
    words = hmm.Model(model.start, model.move, np.array([of[w] * p(w) / total for w in kind]).T)
    return [brute_forward(words, [number[w] for w in t]) for t in toks]


def test_scores_equal_brute_force(spark):
    texts = [prose(i, int(n), 60) for i, n in enumerate(np.random.default_rng(6).integers(0, 90, 40))] + [None, "", "unheard of", prose(99, 900, 60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = hmm.scored(spark.createDataFrame(rows, DOCS), states=3, passes=2, block_bytes=4_000).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], brute_scores(rows, 3, 2), rtol=2e-4)


def test_probabilities_of_a_state_add_up_to_one(spark):
    """With one state every share is one, so a text of one known word scores its smoothed frequency, then the end's."""
    rows = [(i, "a b" if i % 2 else "a", "en", "s", 0) for i in range(30)]
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in [*t.split(), "\n"])
    n = sum(count.values())
    p = lambda w: (count[w] + 0.1) / (n + 0.1 * (3 + hmm.CLASSES))
    got = {r.doc_id: r.score for r in hmm.scored(spark.createDataFrame(rows, DOCS), states=1, passes=1).collect()}
    assert math.isclose(got[0], math.log10(p("a")) + math.log10(p("\n")), rel_tol=1e-3)


def test_hmm_base_columns(docs):
    rows = sample()
    toks = [[*WORDS.findall(lower(t)), "\n"] for _, t, *_ in rows]
    test = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, *_ in rows]
    c = Counter(w for t, h in zip(toks, test) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((d, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (d, *_), t, h in zip(rows, toks, test))
    got = hmm.scored(docs, block_bytes=20_000).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


# ---- 9 ----


def test_bpe_equals_the_library(docs, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    odd = ["<|endoftext|> a<|startoftext|>b", "don't we'LL İstanbul ΣΑΣ ﬁ", "é ́x 한국어 🎉🎉", "a\x1cb　c", "x" * 700 + " y", prose(1, 3000)]
    rows = sample() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)]
    got = bpe.encoded(spark.createDataFrame(rows, DOCS), queries.vocabulary()).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[(doc_id, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded) for r in got) == want
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)


def test_chunks_are_content_defined():
    a, b = prose(1, 2000).encode(), prose(2, 50).encode()
    assert b"".join(bpe.cut(a)) == a and len(bpe.cut(a)) > 10
    assert len(set(bpe.cut(a)) & set(bpe.cut(b + b" " + a))) >= len(bpe.cut(a)) - 2


# ---- 10 ----


def brute_fingerprint(text):
    w = WORDS.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(docs):
    rows = sample()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (d, *_), f in zip(rows, fps):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{f:016x}", least.get(root[f])) for (d, *_), f in zip(rows, fps))
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len({root[f] for f in fps})
    assert Counter(root[brute_fingerprint(r.text)] for r in kept) == Counter(set(root.values()))


@pytest.mark.parametrize("seed", [4, 5])
def test_links_keep_components(spark, seed):
    rng = np.random.default_rng(seed)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {0, (1 << 64) - 1, 1 << 63, 3}
    for _ in range(6):
        x = int(rng.integers(0, 1 << 62)) * 4
        fps.add(x)
        for _ in range(40):
            x = flip(x, int(rng.integers(1, 5)))
            fps.add(x)
    centre = int(rng.integers(0, 1 << 62))
    fps |= {flip(centre, int(rng.integers(1, 3))) for _ in range(150)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = sorted(map(signed, fps))
    want = brute_components(nodes, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    edges = simhash.links(spark.createDataFrame([(n,) for n in nodes], "fp long"))
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in edges.collect())
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {n: roots.get(n, n) for n in nodes} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(151)}, **{1000 + i: 1000 for i in range(300)}}
