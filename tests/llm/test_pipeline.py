import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from tessera.llm import simhash_dedup
from tessera.llm.common import components
from tests.llm.test_text_operators import check_pieces

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        spark.createDataFrame([(9000, "12 + 30 = 42", None, "src0", 12), (9001, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    )
    stages = dict(C.STAGES)
    one = stages["language_id"](spark, docs, SF).cache()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {9000, 9001}
    two = stages["exact_dedup"](spark, one, SF).cache()
    groups = defaultdict(list)
    for r in one.collect():
        groups[r.text].append(r.doc_id)
    assert {r.doc_id for r in two.collect()} == {max(v) for v in groups.values()}
    three = stages["simhash_dedup"](spark, two, SF).cache()
    assert {r.doc_id for r in three.collect()} <= {r.doc_id for r in two.collect()} and three.count() > 0.9 * two.count()
    four = stages["mixing"](spark, three, SF).cache()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(count(r.text) for r in three.collect())
    assert abs(sum(count(r.text) for r in four.collect()) - 1.5 * total) < 0.01 * total
    for frame in (one, two, three, four):
        assert frame.columns == NAMES
    five = stages["packing"](spark, four, SF)
    assert check_pieces(five.collect(), {r.doc_id: r.text for r in four.collect()}) == 0


def test_repeated_rows_and_odd_tables(spark, odd, none):
    for frame, rows in ((odd, 5), (none, 0)):
        docs = frame.select(*NAMES)
        for _, stage in C.STAGES[:3]:
            docs = stage(spark, docs, SF)
        assert docs.count() == rows, [r.doc_id for r in docs.collect()]


def test_run(spark):
    assert C.run(spark, SF).count() > 200


def test_copies_behind_other_texts_of_their_fingerprint(spark):
    """Parts between equal words change places: the two-word shingles and so the fingerprints stay."""
    text = lambda parts: " ".join(f"a q{i} r{i}" for i in parts) + " a"
    rng = random.Random(3)
    rows = [text(rng.sample(range(60), 60)) for _ in range(40)]
    for i in (5, 20):
        words = rows[i].split()
        words[30:36] = words[33:36] + words[30:33]
        rows.append(" ".join(words))
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "row bigint, doc_id bigint, text string")
    assert frame.select("text").distinct().count() == 42
    for budget in (400, 1 << 21):
        got = defaultdict(set)
        for r in simhash_dedup.near_copies(frame, seeds=2, budget=budget).collect():
            got[r.component].add(r.row)
        assert sorted(map(sorted, got.values())) == [[5, 40], [20, 41]]


def alike_again(sets, comp):
    """Components by brute force over all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if comp[i] == comp[j] or both >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def random_sets(rng, n):
    bases = [rng.sample(range(5000), rng.randint(5, 60)) for _ in range(4)]
    return [{x if rng.random() > rng.choice([0, 0.05, 0.1, 0.2]) else rng.randrange(10**6) for x in rng.choice(bases)} if rng.random() > 0.03 else set() for _ in range(n)]


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_alike_sets_link_all_pairs():
    rng = random.Random(6)
    for n in (1, 2, 3, 40, 150):
        sets = random_sets(rng, n)
        comp = [rng.randrange(10**6) if rng.random() > 0.2 else 7 for _ in sets]
        grams = np.array([x for s in sets for x in sorted(s)], np.int64)
        size, yes = np.array(list(map(len, sets))), np.ones(n, bool)
        root = [comp.index(c) for c in comp]
        u, v = simhash_dedup.alike_sets(grams, size, np.array(comp), yes, yes, 0.8, step=50)
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            root = [a if x == b else x for x in root]
        assert same_groups(root, alike_again(sets, comp))


def test_large_clusters_are_joined_whole(spark):
    """Clusters of many shares: of copies, of texts that are close but not alike, and of both."""
    rng = random.Random(9)
    sets, cluster = [], []
    for c in range(3):
        base = list(range(c * 1000, c * 1000 + 30))
        for i in range(40):
            edits = [0, rng.randint(0, 2), rng.randint(5, 7)][c if rng.random() > 0.2 else rng.randrange(3)]
            changed = dict.fromkeys(rng.sample(base, edits))
            sets.append({x if x not in changed else 10**6 + 100 * len(sets) + x % 100 for x in base})
            cluster.append(c)
    rows = [(i, c, sorted(s), len(s) + 1) for i, (s, c) in enumerate(zip(sets, cluster, strict=True))]
    frame = spark.createDataFrame(rows, "row bigint, cluster bigint, grams array<bigint>, n bigint")
    want = alike_again(sets, list(range(len(sets))))
    assert 3 < len(set(want)) < 100
    for budget in (300, 1 << 21):
        comp = {r.node: r.root for r in components(simhash_dedup.alike(frame, 0.8, budget)).collect()}
        assert same_groups([comp.get(i, i) for i in range(len(sets))], want), budget


def test_near_copies_of_the_documents(spark):
    """Against all pairs: nothing links below 0.8, and at least nine in ten of the rows that have a partner are linked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"]).select(F.col("doc_id").alias("row"), "text")
    grams, by = {}, defaultdict(set)
    for r in docs.collect():
        w = r.text.lower().split()
        grams[r.row] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        for g in grams[r.row]:
            by[g].add(r.row)
    pairs = {(a, b) for rows in by.values() if len(rows) < 200 for a in rows for b in rows if a < b}
    pairs = {(a, b) for a, b in pairs if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    got = {r.row: r.component for r in simhash_dedup.near_copies(docs).collect()}
    partner = {x for p in pairs for x in p}
    assert set(got) <= partner and len(got) >= 0.9 * len(partner)


def test_runs_do_not_touch_each_other(spark):
    a = C.run(spark, SF)
    b = C.run(spark, SF)
    assert a.count() == b.count() > 200


def test_columns_with_any_name(spark):
    """Names that the stages use themselves are passed on unchanged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["row", "_row", "_ROW2", "_spans", "_passes", "_words", "fp", "component", "key", "kept", "digest", "cluster", "n"]
    more = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for _, stage in C.STAGES[:4]:
        more, docs = stage(spark, more, SF).cache(), stage(spark, docs, SF).cache()
        assert more.columns == [*NAMES, *names] and more.count() == docs.count()
        for r in more.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)
        assert sorted(map(tuple, more.select(*NAMES).collect())) == sorted(map(tuple, docs.select(*NAMES).collect()))
    assert C.STAGES[4][1](spark, more, SF).count() > 0
