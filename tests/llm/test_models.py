import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import additive_ann, language_id, license_scan, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- additive quantisation


def nearest_again(rows, query, k=10):
    ok = {i: v for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    q = np.array(ok[query], float)
    return sorted((float(np.sqrt(((np.array(v, float) - q) ** 2).sum())), i) for i, v in ok.items() if i != query)[:k]


def test_ann_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    bad = [(1000, None), (1100, [0.0] * 64), (1200, [float("nan")] * 64), (1300, [None] * 64), (1400, [1.0] * 3), (None, data[0][1])]
    same = [(2000 + i, data[0][1]) for i in range(12)]  # ties
    frame = spark.createDataFrame(data + bad + same, rows.select("vec_id", "embedding").schema)
    got = defaultdict(list)
    for r in additive_ann.search(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 2000}
    hits = 0
    for q, found in got.items():
        want = nearest_again(data + bad + same, q)
        assert len(found) == 10
        exact = dict((i, d) for d, i in nearest_again(data + same, q, 10_000))
        assert all(abs(exact[i] - d) < 1e-12 for i, d in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        hits += len({i for _, i in want} & {i for i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[0]] == list(range(2000, 2010))
    assert additive_ann.search(frame.where("vec_id in (1000, 1100)"), frame.where("vec_id % 100 = 0")).count() == 0


def test_repeated_candidates_leave_room_for_others(spark):
    rng = np.random.default_rng(6)
    near = [(1, [1.0, 0.0, 0.0, 0.001 * i]) for i in range(400)]  # one id, many vectors
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + near + [(2, [1.0, 0.1, 0.0, 0.0])] * 30 + [(3 + i, rng.normal(size=4).tolist()) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    got = [(r.vec_id, r.score) for r in additive_ann.search(frame, frame.where("vec_id = 0")).orderBy("rank").collect()]
    q, least = np.array(rows[0][1]), {}
    for i, v in rows[1:]:
        least[i] = min(least.get(i, math.inf), float(np.sqrt(((np.array(v) - q) ** 2).sum())))
    want = sorted(least.items(), key=lambda x: (x[1], x[0]))[:10]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([d for _, d in got], [d for _, d in want])


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.where("vec_id % 100 = 0")
    small = {"rerank": 16, "probes": 3, "share": 50}
    found = []
    for n in (1, 16):
        got = additive_ann.search(rows.repartition(n), asked, **small).collect()
        found.append(sorted(map(tuple, got)))
    assert found[0] == found[1] and len(found[0]) == 200
    data = [(r.vec_id, r.embedding) for r in rows.select("vec_id", "embedding").collect()]
    got, hits = defaultdict(set), 0
    for r in additive_ann.search(rows, asked, rerank=40).collect():
        got[r.query_id].add(r.vec_id)
    for q, ids in got.items():
        hits += len({i for _, i in nearest_again(data, q)} & ids)
    assert hits >= 0.9 * 10 * len(got)


def test_beam_search_beats_greedy_encoding():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    model = additive_ann.AdditiveQuantizer.fit(x, books=4, size=16)

    def error(beam):
        codes, norms = model.encode(x, beam)
        made = sum(b[codes[:, i]] for i, b in enumerate(model.codebooks))
        assert np.allclose((made**2).sum(1), norms, rtol=1e-4)
        return ((x - made) ** 2).sum()

    assert error(4) <= error(1)


# ---- language identification


def test_language(spark, docs, odd, none):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(full)
    lang = {r.doc_id: r.lang for r in full.select("doc_id", "lang").collect()}
    got = language_id.identify(full, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    strange = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert len(strange) == 9 and {strange[i].lang_pred for i in (3, 4, 8)} == {"und"} and strange[3].score == 0
    assert language_id.identify(none, model).count() == 0 and language_id.train(none) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_tables_equal_convolution():
    model = language_id.ByteCNN(["a", "b"], filters=4, window=32)
    x, _, _ = model.windows([b"some text that is longer than a window of thirty-two bytes", b"x"])
    raw, _ = model._pool(x)
    h = np.maximum(raw + model.bias, 0) @ model.out + model.out_bias
    p = np.exp(h) / np.exp(h).sum(1, keepdims=True)
    assert np.allclose(model.probabilities(x), p, atol=1e-5)


# ---- toxicity


def test_block_max_is_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(700):
        v = {t: rng.random() for t in rng.sample(range(30), rng.randint(1, 6))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, [0] * 700, 30, block=16)
    for q in vectors[:60]:
        want = sorted(((-sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(index.vectors)))
        want = [(i, -s) for s, i in want if s < 0][:15]
        ids, sims = index.nearest(q, 15)
        assert np.allclose([s for _, s in want], sims)
        assert {i for i, s in want if s > sims[-1] + 1e-9} <= set(ids.tolist())


def test_toxicity(spark, odd, none):
    full = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(full, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(full, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.train(odd, labels.where("false")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_scores_are_those_of_brute_force(spark):
    """The whole path against cosines over all examples, computed from the texts with plain dictionaries."""
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts, truth = dict(full.select("doc_id", "text").collect()), {r.doc_id: r.toxic for r in labels.collect()}
    bag = {d: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for d, t in texts.items()}
    examples = sorted(d for d in truth if zlib.crc32(str(d).encode()) % 5 and d in texts)
    df, n, toxic = Counter(w for b in bag.values() for w in b), len(examples), sum(truth[d] for d in examples)
    a, b = (Counter(w for d in examples if truth[d] == v for w in bag[d]) for v in (1, 0))

    def phi(w):
        under = (a[w] + b[w]) * (n - a[w] - b[w]) * toxic * (n - toxic)
        return abs(a[w] * (n - toxic - b[w]) - b[w] * (toxic - a[w])) / math.sqrt(under) if under else 0.0

    weight = {w: math.log(1 + len(texts) / df[w]) * phi(w) for w in {*a, *b}}

    def unit(words):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in words.items() if weight.get(w, 0) > 0}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    held = {d: unit(bag[d]) for d in examples}
    model = toxicity.train(full, labels)
    got = {r.doc_id: r for r in toxicity.score(full, model).collect()}
    assert set(got) == set(texts)
    for d in sorted(texts)[::9]:
        q = unit(bag[d])
        sims = sorted(((-sum(x * v.get(w, 0.0) for w, x in q.items()), e) for e, v in held.items()))[:15]
        assert np.allclose([-s for s, _ in sims if s < -1e-6], [s for s in got[d].similarities if s > 1e-6], rtol=0, atol=1e-6)  # six decimals
        assert {e for s, e in sims if -s > got[d].similarities[-1] + 1e-6} <= set(got[d].neighbours)
        by = dict(zip(got[d].neighbours, got[d].similarities, strict=True))
        w = {e: 1 / (1 - min(1, s) + 0.05) for e, s in by.items()}
        vote = (sum(x * truth[e] for e, x in w.items()) + 0.5) / (sum(w.values()) + 1)
        assert abs(got[d].score - 1 / (1 + math.exp(-(model.a * vote + model.b)))) < 1e-9


def test_every_significant_term_counts(spark):
    terms = [a + b + "z" for a in "abcdefghij" for b in "klmnop"]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:1200]
    rows = [(i, " ".join(terms[(3 * n + j) % 60] for j in range(3)) if n < 600 else "plain words", int(n < 600)) for n, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(frame.drop("toxic"), frame.drop("text"))
    assert set(terms) <= set(model.names)
    assert all(model.score(t) > 0.5 for t in terms)


# ---- content-defined chunks


def boundaries_again(data, average=32, least=12, most=512):
    gear, ends, last_seen, start = substring_dedup.gear_table().tolist(), [], -least, 0
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 15) : i + 1]:
            h = ((h << 2) + gear[b]) % 2**32
        if h >> (32 - (average.bit_length() - 1)) == 0:
            if i + 1 - last_seen >= least and i + 1 < len(data):
                ends.append(i + 1)
            last_seen = i + 1
    out = []
    for e in [*ends, len(data)]:
        while e - start > most:
            start += most
            out.append(start)
        out.append(e)
        start = e
    return out


def test_boundaries(docs):
    texts = [r.text.encode()[:4000] for r in docs.limit(15).collect()] + [b"a" * 3000, b"x", b"ab" * 900]
    for t in texts:
        assert substring_dedup.boundaries(t).tolist() == boundaries_again(t)
    a = texts[0]
    shifted = {bytes(x) for x in np.split(np.frombuffer(b"inserted " + a, np.uint8), substring_dedup.boundaries(b"inserted " + a)[:-1])}
    whole = [bytes(x) for x in np.split(np.frombuffer(a, np.uint8), substring_dedup.boundaries(a)[:-1])]
    assert sum(c in shifted for c in whole) >= len(whole) - 3


def test_repeated_passages(spark, docs, odd, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(55)
    rows = [(1, f"{text(80)} {shared} {text(90)}"), (2, f"{text(20)} {shared}"), (3, text(300)), (4, shared + text(5)), (5, text(12))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found} == {1, 2, 4}
    by = dict(rows)
    for r in found:
        assert by[r.doc_id].encode()[r.start : r.end].decode() in shared and r.first_doc_id == 1 and r.first == (r.doc_id == 1)
    assert substring_dedup.repeated_passages(none).count() == 0
    assert {r.doc_id for r in substring_dedup.repeated_passages(odd, words=1).collect()} <= {1, 2, 7}


def passages_again(rows, words, window=substring_dedup.WINDOW):
    """(doc_id, start, end, words, first_doc_id) by brute force: all chunks in a dictionary by their bytes."""
    gear = substring_dedup.gear_table().tolist()
    pieces = []
    for doc, text in rows:
        data = (text or "").encode()
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        inner = [s for s in starts if s > 0]

        def h(at, data=data):
            return sum(gear[b] << 2 * i for i, b in enumerate(reversed(data[max(0, at - 16) : at]))) % 2**32

        hs = {s: h(s) for s in inner}
        cuts = {min(inner[i : i + window], key=lambda s: (hs[s], -s)) for i in range(len(inner) - window + 1)}
        ends = sorted(cuts) + [len(data)] if data else []
        own = []
        for i, a in enumerate([0, *ends[:-1]] if ends else []):
            for e in ends[i:]:
                if sum(a <= s < e for s in starts) >= words:
                    own.append((a, e))
                    break
        pieces.append([(a, e, data[a:e]) for a, e in own])
    have = defaultdict(set)
    for (doc, _), own in zip(rows, pieces, strict=True):
        for _, _, x in own:
            have[x].add(doc)
    out = []
    for (doc, text), own in zip(rows, pieces, strict=True):
        passages = []
        for a, e, x in own:
            if len(have[x]) > 1:
                low = min((d for d in have[x] if d is not None), default=None)
                if passages and a < passages[-1][1]:
                    passages[-1][1] = max(e, passages[-1][1])
                else:
                    passages.append([a, e, low])
        data = (text or "").encode()
        out += [(doc, a, e, len(data[a:e].split()), low) for a, e, low in passages]
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [3, 20])
def test_passages_are_those_of_brute_force(spark, docs, words):
    rows = [(r.doc_id, r.text[:1500]) for r in docs.collect()]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (rows[1][0], rows[2][1]), (9001, rows[3][1][200:900]), (9002, "x" + rows[3][1][300:1200]), (9003, None), (9004, "a b " * 300)]
    rows += [(9005, "b a " * 300)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), words).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.words, r.first_doc_id) for r in got), key=str) == passages_again(rows, words)
    assert len(got) > 20


def test_matches_side_by_side_and_rows_of_one_id(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    p, q, r, s = text(60), text(60), text(60), text(60)
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(1, p), (2, q), (3, f"{cut(p, 10, 24)} {cut(q, 10, 18)} {text(30)}")]  # 14 and 8 words: no passage of 20
    rows += [(4, r), (5, s), (9, r), (9, s)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(x.doc_id for x in found) == [4, 5, 9, 9] and {x.first_doc_id for x in found} == {4, 5}
    nulls = [(None, r), (None, s), (4, r), (5, s)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(nulls, "doc_id bigint, text string")).collect()
    assert sorted(str(x.doc_id) for x in found) == ["4", "5", "None", "None"]


def test_every_passage_of_over_fifty_words_is_found(spark):
    rng = random.Random(12)
    word = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    text = lambda n, k=9: " ".join(word(rng.randint(1, k)) for _ in range(n))
    shared = [text(51, 1) for _ in range(60)] + [text(51) for _ in range(200)] + [" ".join([text(n)] * 60) for n in (1, 1, 2, 2, 3, 7)]
    rows = [(2 * i + j, f"{text(rng.randint(5, 90))} {s} {text(rng.randint(5, 90))}") for i, s in enumerate(shared) for j in (0, 1)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by = dict(rows)
    assert {r.doc_id for r in found} == set(by)
    for r in found:
        assert r.words >= 20 and by[r.doc_id].encode()[r.start : r.end].decode().split() == by[r.doc_id][r.start : r.end].split()
        assert len(by[r.doc_id][r.start : r.end].split()) == r.words


# ---- licences


def test_licence_model_agrees_with_the_plan(spark):
    model = license_scan.LicenceModel()
    assert model.accuracy > 0.95
    lines = ["Released under the MIT License.", "words before it: licensed under the Apache License, Version 2.0 and after", "the driving license of the driver is valid", "nothing to see", ""]
    frame = spark.createDataFrame([(7, "\n".join(lines), "x")], "doc_id bigint, text string, gram string")
    got = {r.paragraph: r for r in license_scan.scan(frame, model).collect()}
    for i, line in enumerate(lines):
        p = model.predict(line)
        best = model.classes[int(p.argmax())]
        if best != license_scan.UNKNOWN:
            assert got[i].family == best and abs(got[i].probability - p.max()) < 1e-6
            share = max(len(license_scan.shingles(license_scan.words(t)) & license_scan.shingles(license_scan.words(line))) / len(license_scan.shingles(license_scan.words(t))) for t in license_scan.TEMPLATES[best])
            assert abs(got[i].similarity - share) < 1e-9
        elif i in got:
            assert got[i].family == license_scan.UNKNOWN
    assert got[0].family == "mit" and got[0].confirmed and got[1].family == "apache-2.0" and got[2].family == license_scan.UNKNOWN


def test_unknown_lines_that_speak_of_licences(spark):
    model = license_scan.LicenceModel()
    lines = ["Licence: EUPL-1.2", "sublicence", "copyrighted stuff", "nothing to see"]
    got = {r.paragraph: r for r in license_scan.scan(spark.createDataFrame([(7, "\n".join(lines))], "doc_id bigint, text string"), model).collect()}
    assert set(got) == {0, 1, 2}
    for i, r in got.items():
        assert r.family == license_scan.UNKNOWN and not r.confirmed and abs(r.probability - model.predict(lines[i]).max()) < 1e-6


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_wrapped_notices(spark):
    model = license_scan.LicenceModel()
    notices = {1: (MIT, "mit"), 2: (BSD, "bsd"), 3: (GPL, "gpl"), 4: (GPL.replace("GNU General", "GNU Affero General"), "agpl"), 5: (ISC, "isc")}
    rows = [(i, f"some words before\n\n{t}\n\nand others after") for i, (t, _) in notices.items()]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect() if r.confirmed}
    assert {i: r.family for i, r in got.items()} == {i: f for i, (_, f) in notices.items()}
    assert all(r.paragraph == 2 and r.lines > 1 for r in got.values())
    one = [(6, "Licence: GPLv3"), (7, "Distributed under the GPL."), (8, "This licence applies to the whole work"), (9, "License: MIT")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(one, "doc_id bigint, text string"), model).collect()}
    assert [got[i].family for i in (6, 7, 8, 9)] == ["gpl", "gpl", license_scan.UNKNOWN, "mit"]


def test_licences_of_the_documents(spark, docs, odd, none):
    said = re.compile(r"License|All rights reserved|CC BY")
    want = Counter(r.doc_id for r in docs.collect() for line in r.text.split("\n") if said.search(line))
    got = Counter(r.doc_id for r in license_scan.scan(docs).collect() if r.confirmed)
    assert got == want
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0
