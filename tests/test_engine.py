import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers as A
from tessera.operators import chunking as C
from tessera.operators import evaluation as E
from tessera.operators import labels as L
from tessera.operators import retrieval as R
from tessera.plans import grid as G
from tessera.plans import runner as N
from tessera.sources import corpus as S
from tessera.sources import html as H


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Revenue rose to $34,550", ["revenue", "rose", "to", "34,550", "34550"]),
        ("16.1 then 16.1% don't. 1,000%", ["16.1", "then", "16.1%", "don't", "1,000%"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens) == want


@pytest.mark.parametrize(("raw", "want"), [("34,550", "34550"), ("$ 34,550", "34550"), ("16.1 %", "16.1"), ("(9,415)", "-9415"), ("2.20", "2.2"), ("none", None)])
def test_numbers(spark, raw, want):
    assert one(spark, raw, T.normalise_number) == want


@pytest.mark.parametrize(("reply", "want"), [("VERDICT: OK", "OK"), ("so verdict: reject - vague", "REJECT"), ("VERDICT: REJECT: x", "REJECT"), ("fine", None)])
def test_verdicts(spark, reply, want):
    assert one(spark, reply, T.verdict) == want


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_fixed_chunks():
    count = lambda t: 1
    assert len(C.fixed_spans(words(100), 10, 0, count)) == 10
    text = words(20)
    a, b = C.fixed_spans(text, 10, 3, count)[:2]
    assert text[slice(*a)].split()[-3:] == text[slice(*b)].split()[:3]
    assert len(C.fixed_spans("x" * 400 + " y", 10, 0)) == 2
    with pytest.raises(ValueError):
        C.fixed_spans("a", 5, 5)


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n", max_size=200), st.integers(2, 9), st.integers(0, 1))
def test_chunks_cover_all_words(text, target, overlap):
    spans = C.fixed_spans(text, target, overlap)
    covered = {i for a, b in spans for i in range(a, b)}
    assert {i for i, ch in enumerate(text) if not ch.isspace()} <= covered
    assert spans == sorted(spans)


def block(kind, start, end, section):
    return {"kind": kind, "start": start, "end": end, "section_path": section}


def test_struct_chunks():
    text = words(60)
    count = lambda t: len(t.split())
    cut = text.index(" w10")
    blocks = [block("paragraph", 0, cut, ["a"]), block("paragraph", cut + 1, len(text), ["a"])]
    spans = C.struct_spans(blocks, text, 10, 20, count)
    assert [w for a, b in spans for w in text[a:b].split()] == text.split()  # nothing of a long block is lost
    assert C.struct_spans([block("boilerplate", 0, 5, ["a"])], text) == []
    two = [block("paragraph", 0, 5, ["a"]), block("paragraph", 6, 11, ["b"])]
    assert len(C.struct_spans(two, text)) == 2
    table = [block("table", 0, len(text), ["a"])]
    assert C.struct_spans(table, text, 10, 20, count) == [(0, len(text))]


def test_semantic_and_sentences():
    units = [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert C.semantic_spans(units, [0.0, 1.0, 0.0], 95, [1] * 4) == [(0, 3), (4, 7)]
    assert C.semantic_spans(units, [0.0] * 3, 95, [600] * 4, 1024) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    with pytest.raises(ValueError):
        C.semantic_spans(units, [0.0] * 3, 100, [1] * 4)
    text = "One two. Three? 4 five. no"
    assert [text[a:b] for a, b in C.sentence_spans(text)] == ["One two.", "Three?", "4 five. no"]


def run_of(spark, *ids):
    return spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")


def rels_of(spark, **gains):
    return spark.createDataFrame([("q", c, g) for c, g in gains.items()], "query_id string, chunk_id string, gain int")


@pytest.mark.parametrize(
    ("run", "rels", "ndcg", "rr"),
    [("abc", {"a": 1, "c": 1}, 0.91972, 1.0), ("xy", {"a": 1}, 0.0, 0.0), ("xa", {"a": 1}, 1 / math.log2(3), 0.5), ("ab", {"a": 0}, None, None)],
)
def test_metrics(spark, run, rels, ndcg, rr):
    q = spark.createDataFrame([("q",)], "query_id string")
    got = E.per_query(run_of(spark, *run), rels_of(spark, **rels), q).first()
    assert (got.ndcg is None) == (ndcg is None) and (ndcg is None or abs(got.ndcg - ndcg) < 1e-5)
    assert got.rr == rr


def test_relevance(spark):
    chunks = spark.createDataFrame([("c1", "d", 0, 300), ("c2", "d", 0, 100)], "chunk_id string, doc_id string, start int, end int")
    gold = spark.createDataFrame([("q1", "d", 100, 200, 2), ("q1", "d", 0, 50, 1), ("q2", "d", 0, 1000, 1)], "query_id string, doc_id string, start int, end int, gain int")
    got = {(r.query_id, r.chunk_id): r.gain for r in E.qrels(chunks, gold).collect()}
    assert got == {("q1", "c1"): 2, ("q1", "c2"): 1}
    assert E.reachability(gold, E.qrels(chunks, gold)).first().fraction == 0.5
    for bad in (0, -0.1, 1.5):
        with pytest.raises(ValueError):
            E.qrels(chunks, gold, bad)


def test_holm_and_constant_bootstrap(spark):
    got = {r.name: r.p_holm for r in E.holm(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.6)], "name string, p double")).collect()}
    assert got == {"a": 0.03, "b": 0.04, "c": 0.6}
    v = spark.createDataFrame([(i, 2.0) for i in range(5)], "query_id int, value double")
    r = E.bootstrap_ci(v, 50).first()
    assert (r.point, r.low, r.high) == (2.0, 2.0, 2.0)
    assert E.paired_test(v, v, 50).first().p == 1.0


def test_bm25_small(spark):
    chunks = spark.createDataFrame([("c1", "R&D expense 34,550 in 2025"), ("c2", "R&D expense 31,370 in 2024"), ("c3", "no figures")], "chunk_id string, text string")
    q = spark.createDataFrame([("a", "expense 34550"), ("b", "zzz")], "query_id string, text string")
    got = R.bm25(chunks, q).collect()
    assert [(r.query_id, r.chunk_id) for r in sorted(got, key=lambda r: r.rank)] == [("a", "c1"), ("a", "c2")]


def test_dense_keeps_negative_scores_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "chunk_id int, embedding array<float>")
    got = R.dense(v, v.where("chunk_id = 1").withColumnRenamed("chunk_id", "query_id"), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(1, 1.0), (3, 0.0), (2, -1.0)]


TABLE = """<table><tr><td></td><td colspan=2>2025</td><td>2024</td></tr>
<tr><td>Research and development</td><td>$</td><td>34,550</td><td>31,370</td></tr>
<tr><td>Selling, general</td><td></td><td>26,097</td><td>24,932</td></tr></table>"""


def test_tables():
    text, blocks = H.parse(f"<p>Before</p>{TABLE}<p>After</p>")
    assert [b["kind"] for b in blocks] == ["paragraph", "table", "paragraph"]
    t = blocks[1]["table"]
    assert t["n_header_rows"] == 1 and t["rows"][1] == ["Research and development", "$ 34,550", "31,370"]
    assert all(text[b["start"] : b["end"]] == b["text"] for b in blocks)
    assert H.render_sentences(t).split("\n")[0] == "Research and development -- 2025: $ 34,550; 2024: 31,370"
    layout = H.parse("<table><tr><td>a</td></tr></table>")[1]
    assert [b["kind"] for b in layout] == ["paragraph"]


def test_sections_and_contents():
    heads = ["Part I", *[f"Item {i}. Title {i}" for i in range(1, 7)]]
    html = "".join(f"<p>{h}</p>" for h in heads) + "".join(f"<p>{h}</p><p>{'filler. ' * 90}</p>" for h in heads)
    blocks = H.parse(html)[1]
    assert [b["kind"] for b in blocks[:7]] == ["boilerplate"] * 7
    assert blocks[-1]["section_path"] == ["Part I", "Item 6. Title 6"]


def test_text_normalisation_and_encodings():
    assert H.normalize_text("a\u0093b​   ﬁ") == "a“b fi"
    assert H.decode("é".encode("cp1252")) == "é" and H.decode(b'<meta charset="latin-1">\xe9')[-1] == "é"
    hidden = f"<div style='display: none'>{'x ' * 1500}</div><td style='display:none'>kept</td>"
    assert H.parse(hidden)[0] == "kept"
    with pytest.raises(ValueError):
        H.parse(b"")


def test_table_facts(spark):
    rows = [["", "2025", "2024"], ["Research and development2", "34,550", "31,370"], ["Total", "1", "2"], ["Acme Holdings Inc", "5", "6"], ["Selling costs, net", "n/a", "24,932"]]
    data = [("d", "t1", "Acme Holdings", r, "cap", 1, rows) for r in ("markdown", "row_sentences")]
    frame = spark.createDataFrame(data, "doc_id string, block_id string, company string, rendering string, caption string, n_header_rows int, rows array<array<string>>")
    got = {(r.row_label, r.period, r.value, r.line) for r in L.table_facts(frame).collect()}
    assert {x[:3] for x in got} == {("Research and development", "2025", "34,550"), ("Selling costs, net", "2024", "24,932")}
    table = {"rows": rows, "n_header_rows": 1, "caption": "cap"}
    for label, _, _, line in got:  # the line is that of the row in one of the renderings
        assert any(label[:8] in r.split("\n")[line] for r in (H.render_markdown(table), H.render_sentences(table)) if line < len(r.split("\n")))


def test_labels(spark):
    q = spark.createDataFrame([("q1", "What was net revenue of Acme in 2025?", "Acme Inc", "2025", "net revenue")], "query_id string, text string, company string, period string, passage string")
    for rewritten, problem in [("How much did Acme sell in fiscal 2025?", None), ("short", "empty or too short"), ("How much was sold in fiscal 2025 then?", "dropped the company name"), ("How much did Acme sell that time?", "dropped the fiscal period")]:
        got = L.apply_paraphrases(q, spark.createDataFrame([("q1", rewritten)], "query_id string, rewritten string")).first()
        assert got.problem == problem and (got.text == rewritten) == (problem is None)
    v = spark.createDataFrame([("a", "generated"), ("b", "human_verified"), ("c", "generated")], "query_id string, verification string")
    r = spark.createDataFrame([("a", "VERDICT: OK"), ("b", "VERDICT: REJECT no"), ("c", "?")], "query_id string, reply string")
    assert {x.query_id: x.verification for x in L.apply_verdicts(v, r).collect()} == {"a": "model_checked", "b": "human_verified", "c": "generated"}
    old = spark.createDataFrame([("a", 1)], "query_id string, x int")
    assert L.merge_preserving(old, spark.createDataFrame([("a", 2), ("b", 3)], "query_id string, x int")).count() == 2


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame([(1, "ko", ["10-K", "10-K/A", "10-K"], ["x", "y", "z"], ["2020-12-31"] * 3, ["2021-02-01", "2021-03-01", "2021-02-02"], ["a.htm", "b.htm", "c.pdf"])], "cik int, ticker string, form array<string>, accession array<string>, report_date array<string>, filing_date array<string>, document array<string>")
    got = S.latest_filings(S.filing_rows(pages), 4).collect()
    assert [r.doc_id for r in got] == ["ko-10-k-2020-12-31"]
    assert S.gaps(spark.createDataFrame([("ko",), ("pg",)], "ticker string"), spark.createDataFrame(got), 1).first().ticker == "pg"
    d = spark.createDataFrame([(1, "a", "s")], "doc_id int, text string, source string")
    with pytest.raises(Exception, match="missing or changed"):
        S.verified(d.withColumn("text", F.lit("b")), S.manifest(d)).collect()
    (tmp_path / "a.htm").write_bytes(b"<p>x</p>")
    docs = H.documents(S.read_raw(spark, str(tmp_path)))
    assert docs.first().text == "x" and docs.first().doc_id == "a"
    old = spark.createDataFrame([("rag", 5), ("long", 2)], "arm string, scored int")
    assert [r.arm for r in S.publishable(old, spark.createDataFrame([("rag", 4), ("long", 2)], "arm string, scored int")).collect()] == ["rag"]
    art = spark.createDataFrame([("b", "q", "t"), ("a", "q", "old"), ("c", "q", "t")], "artifact string, query_id string, query_text string")
    assert S.best_artifact(art, spark.createDataFrame([("q", "t")], "query_id string, text string")).first().artifact == "b"


def test_answers(spark):
    ctx = spark.createDataFrame([("q", ["p", "r"], "why?")], "query_id string, passages array<string>, question string")
    assert A.prompts(ctx).first().prompt == "[1] p\n\n[2] r\n\nQuestion: why?"
    ans = spark.createDataFrame([("q", ["a", "b"]), ("r", ["a", "zz"])], "query_id string, context_ids array<string>")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B")], "chunk_id string, text string")
    assert {r.query_id: r.passages for r in A.resolve_context(ans, chunks).collect()} == {"q": ["A", "B"], "r": None}
    f = spark.createDataFrame([("It is Partial, not supported",)], "x string").select(A.faithfulness("x").alias("y")).first()
    assert f.y == 0.5


def test_grid():
    grid = G.grid()
    assert len(grid) == 15 and len({c.name for c in grid}) == 15
    assert len(G.by_index(grid)) == 8
    for c in grid:
        if c.axis in ("chunking", "baseline"):
            assert G.changed(G.BASE, c) <= {"chunker"}
    with pytest.raises(ValueError):
        G.Config("x", "y", "z", "dense")


def test_sampling_is_seeded(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}", f"s{i % 2}") for i in range(60)], "id int, g string, s string")
    a = L.stratified_sample(rows, "id", "g", "s", 10, 8).collect()
    assert sorted(a) == sorted(L.stratified_sample(rows.orderBy(F.desc("id")), "id", "g", "s", 10, 8).collect()) and len(a) == 8


def rows_of(html):
    tree = H._Tree()
    tree.feed(f"<table>{html}</table>")
    return H.parse_table(next(tree.root.find("table")))["rows"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # a stretched label stands once, with and without a stretched header
        ("<tr><td colspan=3></td><td>2025</td><td>2024</td></tr><tr><td colspan=3>Cash and equivalents</td><td>35,934</td><td>29,943</td></tr>", ["Cash and equivalents", "35,934", "29,943"]),
        ("<tr><td colspan=3>Year ended</td><td>2025</td></tr><tr><td colspan=3>Net sales</td><td>1,000</td></tr>", ["Net sales", "1,000"]),
        ("<tr><td></td><td></td><td>2025</td><td></td></tr><tr><td>Revenue 1</td><td></td><td>416,161</td><td></td></tr>", ["Revenue 1", "416,161"]),
        ("<tr><td></td><td>2025</td><td>2024</td></tr><tr><td>Tax rate</td><td>16.1</td><td>16.1</td></tr>", ["Tax rate", "16.1", "16.1"]),
        ("<tr><td></td><td>2025</td><td>2024</td></tr><tr><td colspan=3>ASSETS:</td></tr><tr><td>Cash</td><td>1</td><td>2</td></tr>", ["ASSETS:", "", ""]),
    ],
)
def test_stretched_cells(html, want):
    assert rows_of(html)[1] == want


def test_spans_going_down():
    assert [r[0] for r in rows_of("<tr><td></td><td>2025</td></tr><tr><td rowspan=2>Segment</td><td>100</td></tr><tr><td>200</td></tr>")[1:]] == ["Segment", "Segment"]
    wide = rows_of("<tr><td>a 1</td><td rowspan=2>b 2</td><td>c 3</td></tr><tr><td colspan=2>d 4</td></tr><tr><td>e 5</td><td>f 6</td><td>g 7</td></tr>")
    assert wide[1] == ["d 4", "b 2", "d 4"]  # a wide cell goes around one that still spans down


@pytest.mark.parametrize("name", ["fixed20", "fixed20o5", "lines", "sentences", "struct30"])
def test_chunk_grammar(spark, name):
    text = "One two three. Four five six.\nSeven eight nine ten. Eleven.\n\nTwelve."
    got = C.chunk_corpus(spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string"), name).collect()
    assert got and all(text[r.start : r.end] == r.text and r.chunk_id == f"d#{r.start:08d}-{r.end:08d}" for r in got)
    assert {i for r in got for i in range(r.start, r.end)} >= {i for i, ch in enumerate(text) if not ch.isspace()}
    for bad in ("fixed", "words", "semantic95"):
        with pytest.raises(ValueError):
            C.chunk_corpus(spark.createDataFrame([], "doc_id string, text string"), bad)
    with pytest.raises(ValueError):
        C.struct_spans([], "", 10, 5)


def test_semantic_chunks(spark):
    text = "One a. Two b. Three c. Four d."
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    vectors = spark.createDataFrame([("d", i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]])], "doc_id string, pos int, embedding array<float>")
    got = C.chunk_corpus(docs, "semantic95", vectors).orderBy("start").collect()
    assert [r.text for r in got] == ["One a. Two b.", "Three c. Four d."]


def test_sections_of_chunks(spark):
    parsed = H.documents(spark.createDataFrame([("d", f"<p>Item 1. Business</p><p>Some words.</p>{TABLE}")], "doc_id string, html string"))
    got = C.chunk_corpus(parsed, "struct512").collect()
    assert any(r.contains_table for r in got) and all(r.section_path == ["Item 1. Business"] for r in got)
    at = parsed.select(T.section_path_at("blocks", F.lit(3)).alias("a"), T.section_path_at("blocks", F.lit(10**6)).alias("b"), F.size(T.blocks_overlapping("blocks", F.lit(0), F.lit(5))).alias("n")).first()
    assert at.a == ["Item 1. Business"] and at.b == [] and at.n == 1


def test_text_ids_of_gold(spark):
    docs = spark.createDataFrame([("doc-a", "x one two three four five six seven y")], "doc_id string, text string")
    got = E.gold_spans(docs, spark.createDataFrame([("q", "one two three four five six seven")], "query_id string, text string")).first()
    assert (got.passage_id, got.start, got.end) == ("doc-a:2-35", 2, 35)


def test_queries_from_facts(spark):
    parsed = H.documents(spark.createDataFrame([("d", f"<p>Item 1. Business</p>{TABLE}")], "doc_id string, html string"))
    blocks = parsed.select("doc_id", F.explode("blocks").alias("b")).where("b.kind = 'table'")
    tables = blocks.select("doc_id", "b.block_id", F.lit("acme inc").alias("company"), F.lit("tech").alias("sector"), F.lit("markdown").alias("rendering"), "b.table.caption", "b.table.n_header_rows", "b.table.rows")
    facts = L.located(L.table_facts(tables), parsed)
    text = parsed.first().text
    for r in facts.collect():
        assert text[r.start : r.end] == r.passage and r.row_label in r.passage and r.value in r.passage
    asked = L.build_queries(facts, 10)
    got = asked.collect()
    assert len(got) == 2 and all("Acme Inc" in r.text and r.period in r.text and 0 < r.lexical_overlap <= 1 for r in got)
    assert {(r.query_id, r.start) for r in L.relocated(asked, facts).collect()} == {(r.query_id, r.start) for r in got}


def test_pinned_samples(spark):
    q = spark.createDataFrame([(f"q{i:02d}", i / 20) for i in range(20)], "query_id string, lexical_overlap double")
    first = [r.query_id for r in L.sample_queries(q, 5).orderBy("position").collect()]
    assert first == ["q00", "q04", "q08", "q12", "q16"]
    more = [r.query_id for r in L.sample_queries(q, 8, ["q19", "q03"]).orderBy("position").collect()]
    assert more[:2] == ["q19", "q03"] and len(set(more)) == 8
    assert [r.query_id for r in L.sample_queries(q, 1, ["q19", "q03"]).collect()] == ["q19"]


def test_rankings_are_validated(spark):
    run, rels = run_of(spark, "a", "b"), rels_of(spark, a=1)
    a, b = E.validated(run, rels)
    assert a.count() == 2 and b.count() == 1
    with pytest.raises(Exception, match="twice"):
        E.validated(run_of(spark, "a", "a"), rels)[0].collect()
    with pytest.raises(Exception, match="non-negative"):
        E.validated(run, rels_of(spark, a=-1))[1].collect()


def test_value_accuracy(spark):
    s = spark.createDataFrame([("x", str(i), i % 2 == 0) for i in range(10)] + [("x", "n", None)], "arm string, query_id string, value_correct boolean")
    r = A.value_accuracy(s, 200).first()
    assert (r.point, r.n) == (0.5, 10) and r.low < 0.5 < r.high


def test_bm25_beyond_the_vocabulary_limit(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", f"w{i % 7} w{i % 3} x, y z{i}") for i in range(40)], "chunk_id string, text string")
    q = spark.createDataFrame([("a", "w1 w1 x"), ("b", "z5 w2")], "query_id string, text string")
    want = sorted(map(tuple, R.bm25(chunks, q, 10).collect()))
    monkeypatch.setattr(R, "MOST_TERMS", 1)
    assert sorted(map(tuple, R.bm25(chunks, q, 10).collect())) == want


def test_runner(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    docs = spark.createDataFrame([(f"d{i}", f"{words[i]} {words[i + 1]} stands here.\nThe other line has {words[i + 2]}.") for i in range(10)], "doc_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"{words[i]} {words[i + 1]}", i / 10) for i in range(10)], "query_id string, text string, lexical_overlap double")
    gold = spark.createDataFrame([(f"q{i}", f"d{i}", 0, 10, 2) for i in range(10)], "query_id string, doc_id string, start int, end int, gain int")
    base = G.Config("base", "baseline", "lines")
    dense = spark.createDataFrame([(f"d{i}#00000000-{len(t):08d}", [float(i == j) for j in range(10)]) for i, t in enumerate(f"{words[i]} {words[i + 1]} stands here." for i in range(10))], "chunk_id string, embedding array<double>")
    asked = queries.select("query_id", "text").withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: (F.substring("query_id", 2, 1).cast("int") == j).cast("double")))
    configs = [
        base, G.replace(base, name="dense", axis="retrieval", retrieval="dense", embedding="m"), G.replace(base, name="hybrid", axis="retrieval", retrieval="hybrid", embedding="m"),
        G.replace(base, name="partly", axis="interaction", retrieval="dense", embedding="half"), G.replace(base, name="meaning", axis="chunking", chunker="semantic95"),
        G.replace(base, name="sentences", axis="table_rendering", table_rendering="row_sentences"), G.replace(base, name="ranked", axis="reranking", reranker="none"),
    ]
    inputs = N.Inputs(queries, {"markdown": (docs, gold)}, vectors={("m", "lines"): dense, ("half", "lines"): dense}, query_vectors={"m": asked, "half": asked.limit(5)})
    results, per_query = N.run_ablation(configs, inputs, resamples=50)
    got = {r.config: r for r in results.collect()}
    assert len(got) == 7 and {n for n, r in got.items() if r.measured} == {"base", "dense", "hybrid"}
    assert all((r.reason is None) == r.measured and (r.ndcg_common is None) != r.measured for r in got.values())
    assert "5 of 10" in got["partly"].reason and "sentence vectors" in got["meaning"].reason and "row_sentences" in got["sentences"].reason
    assert got["dense"].ndcg_common == 1.0 and got["dense"].n_common == 10 and got["base"].fraction == 1.0
    tests = {r.name: r for r in N.significance(per_query, "base", 100).collect()}
    assert set(tests) == {"dense", "hybrid"} and all(0 < r.p <= r.p_holm <= 1 for r in tests.values())
    with pytest.raises(ValueError, match="more than"):
        G.check([base, G.replace(base, name="x", axis="chunking", candidate_k=5)])
    G.check(G.grid())
