"""The engine's queries by name, and the SQL that each must agree with."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
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

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def lines(spark, sf) -> DataFrame:
    return C.chunks(docs(spark, sf), C.line_spans)


def passages(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark, sf) -> DataFrame:
    return E.gold_spans(docs(spark, sf).select("doc_id", "text"), passages(spark, sf))


# ---- the same tables in DuckDB

TOKEN = r"[a-z]+(?:''[a-z]+)?|\d[\d,]*(?:\.\d+)?%?"
TOKENS = (
    "flatten(list_transform(regexp_extract_all(lower({0}), '" + TOKEN + "'), lambda x: "
    "case when contains(x, ',') and not ends_with(x, '%') then [x, replace(x, ',', '')] else [x] end))"
)
LINES = """parts as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
placed as (select doc_id, line, (sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1)::bigint pos from parts),
chunks as (select printf('%s#%08d-%08d', doc_id::varchar, pos + length(line) - length(ltrim(line)), pos + length(rtrim(line))) chunk_id, doc_id,
  pos + length(line) - length(ltrim(line)) "start", pos + length(rtrim(line)) "end", trim(line) text from placed where trim(line) <> '')"""
GOLD = """gold as (select item_id query_id, doc_id, strpos(d.text, b.text) - 1 "start", strpos(d.text, b.text) - 1 + length(b.text) "end", 2 gain
  from documents d join benchmark b on strpos(d.text, b.text) > 0)"""
QRELS = """covered as (select query_id, chunk_id, gain, greatest(0, least(c."end", g."end") - greatest(c."start", g."start"))::double / (g."end" - g."start") cov
  from chunks c join gold g using (doc_id)), qrels as (select query_id, chunk_id, max(gain) gain from covered where cov >= 0.5 group by all)"""
BM25 = (
    f"tok as (select chunk_id, {TOKENS.format('text')} t from chunks), post as (select chunk_id, len(t) length, unnest(t) term from tok), "
    "tf as (select chunk_id, length, term, count(*) tf from post group by all), stats as (select count(*) n, avg(len(t)) avgdl from tok), "
    "dfs as (select term, count(*) df from tf group by 1), "
    f"qt as (select query_id, term, count(*) qtf from (select item_id query_id, unnest({TOKENS.format('text')}) term from benchmark) group by all), "
    "scored as (select query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 9) score "
    "from qt join tf using (term) join dfs using (term), stats group by all), "
    "run as (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from scored qualify rank <= 50)"
)
VECTORS = """v as (select vec_id, embedding::double[] e from embeddings), q as (select vec_id query_id, e q from v where vec_id % 50 = 0),
dense as (select query_id, vec_id chunk_id, round(list_cosine_similarity(q, e), 9) score from q, v), drun as (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from dense qualify rank <= 20)"""
METRICS = """ideal as (select query_id, sum(case when i <= 10 then (pow(2, gain) - 1) / log2(i + 1) end) idcg, count(*) relevant
  from (select *, row_number() over (partition by query_id order by gain desc, chunk_id) i from qrels where gain > 0) group by 1),
hit as (select query_id, sum(case when rank <= 10 then (pow(2, gain) - 1) / log2(rank + 1) end) dcg, count(*) filter (rank <= 50) found, min(rank) first
  from run join qrels using (query_id, chunk_id) where gain > 0 group by 1),
per as (select item_id query_id, case when relevant is not null then round(coalesce(dcg, 0) / idcg, 9) end ndcg,
  case when relevant is not null then round(coalesce(found, 0) / relevant, 9) end recall,
  case when relevant is not null then round(coalesce(1 / first, 0), 9) end rr
  from benchmark b left join ideal i on b.item_id = i.query_id left join hit h on b.item_id = h.query_id)"""


# ---- text and chunks


@query(f"select doc_id, len({TOKENS.format('text')}) n_tokens, len(list_distinct({TOKENS.format('text')})) n_distinct, array_to_string({TOKENS.format('text')}[1:5], ' ') head from documents")
def tokenize_counts(spark, sf):
    t = T.tokens("text")
    return docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query("select doc_id, greatest(1, round_even(length(text) / 4.0, 0))::int approx_tokens from documents")
def approx_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.approx_tokens("text").alias("approx_tokens"))


@query(f'with {LINES} select chunk_id, doc_id, "start", "end", text from chunks')
def line_chunks(spark, sf):
    return lines(spark, sf)


CHUNKED = """select printf('%s#%08d-%08d', doc_id::varchar, "start", "end") chunk_id, doc_id, "start", "end", substr(text, "start" + 1, "end" - "start") text"""
# Greedy windows: where each word's window would end and where the next would begin, then the chain from the first word.
FIXED = """a0 as (select doc_id, text, unnest(regexp_extract_all(text, '\\S+')) w, unnest(regexp_extract_all(text, '\\s*\\S+')) sw, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 i from documents),
atoms as (select doc_id, i, greatest(1, round_even(length(w) / 4.0, 0))::bigint c, (sum(length(sw)) over (partition by doc_id order by i))::bigint e, (sum(length(sw)) over (partition by doc_id order by i) - length(w))::bigint s,
  (sum(greatest(1, round_even(length(w) / 4.0, 0))) over (partition by doc_id order by i))::bigint upto from a0),
ends as (select a.doc_id, a.i, greatest(coalesce(b.i, a.i), a.i) + 1 last, a.upto - a.c before from atoms a asof left join atoms b on a.doc_id = b.doc_id and a.upto - a.c + 512 >= b.upto),
tops as (select e.*, t.upto from ends e join atoms t on t.doc_id = e.doc_id and t.i = e.last - 1),
nexts as (select t.doc_id, t.i, t.last, greatest(coalesce(b.i, 0), t.i + 1) nxt from tops t asof left join (select doc_id, i, upto - c cum from atoms) b on t.doc_id = b.doc_id and t.upto - 64 >= b.cum),
sizes as (select doc_id, max(i) + 1 n from atoms group by 1),
chain as (select doc_id, i, last, nxt from nexts where i = 0 union all select n.doc_id, n.i, n.last, n.nxt from chain c join sizes z on z.doc_id = c.doc_id and c.last < z.n join nexts n on n.doc_id = c.doc_id and n.i = c.nxt),
chunks as (select c.doc_id, f.s "start", l.e "end" from chain c join atoms f on f.doc_id = c.doc_id and f.i = c.i join atoms l on l.doc_id = c.doc_id and l.i = c.last - 1)"""


@query(f"with recursive {FIXED} {CHUNKED} from chunks join documents using (doc_id)")
def fixed_chunks(spark, sf):
    return C.chunk_corpus(docs(spark, sf), "fixed512o64").select("chunk_id", "doc_id", "start", "end", "text")


SENTENCES = """cut as (select doc_id, string_split(regexp_replace(text, '([.!?])(\\s+)([A-Z0-9])', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1)) p from documents),
parts as (select doc_id, unnest(p) part, generate_subscripts(p, 1) i from cut),
placed as (select doc_id, part, (sum(length(part)) over (partition by doc_id order by i) - length(part))::bigint pos from parts),
chunks as (select doc_id, pos + length(part) - length(regexp_replace(part, '^\\s+', '')) "start", pos + length(regexp_replace(part, '\\s+$', '')) "end" from placed where regexp_matches(part, '\\S'))"""


@query(f"with {SENTENCES} {CHUNKED} from chunks join documents using (doc_id)")
def sentence_chunks(spark, sf):
    return C.chunks(docs(spark, sf), C.chunker("sentences"))


@query(f'with {LINES} select chunk_id, doc_id, "start", "end", text from chunks')
def replayed_chunks(spark, sf):
    return C.replay(docs(spark, sf), lines(spark, sf).select("doc_id", "start", "end"))


@query(f'with {LINES} select count(*) filter (greatest(1, round_even(length(text) / 4.0, 0)) > 100) oversize, max(greatest(1, round_even(length(text) / 4.0, 0)))::bigint largest from chunks')
def oversize_report(spark, sf):
    return C.oversize(lines(spark, sf), 100)


@query()
def page_text_blocks(spark, sf):
    x = H.documents(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html"))
    return x.select("doc_id", "text", F.size("blocks").alias("n_blocks"), "error")


@query()
def struct_chunks(spark, sf):
    return C.struct_chunks(H.documents(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html")), 128)


@query("with u as (select label doc_id, vec_id pos, embedding::double[] e, lag(embedding::double[]) over (partition by label order by vec_id) b from embeddings), d as (select doc_id, pos, round(1 - list_cosine_similarity(e, b), 9) distance from u), l as (select doc_id, quantile_cont(distance, 0.95) l from d group by 1) select doc_id, pos, distance, (sum(coalesce((distance > l)::int, 0)) over (partition by doc_id order by pos))::bigint part from d join l using (doc_id)")
def sentence_breakpoints(spark, sf):
    return C.breakpoints(table(spark, sf, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), "embedding"))


# ---- retrieval


@query(f"with {LINES}, tok as (select chunk_id, {TOKENS.format('text')} t from chunks), post as (select chunk_id, unnest(t) term from tok) select term, count(distinct chunk_id) df, count(*) cf from post group by 1")
def postings_stats(spark, sf):
    return R.term_stats(lines(spark, sf))


@query(f"with {LINES}, tok as (select chunk_id, {TOKENS.format('text')} t from chunks), dfs as (select term, count(*) df from (select distinct chunk_id, unnest(t) term from tok) group by 1), n as (select count(*) n from tok) select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) idf from dfs, n order by idf desc, term limit 100")
def idf_report(spark, sf):
    return R.idf_report(lines(spark, sf), 100)


def bm25_run(spark, sf) -> DataFrame:
    return R.bm25(lines(spark, sf), passages(spark, sf))


@query(f"with {LINES}, {BM25} select query_id, chunk_id, rank::int rank, round(score, 6) score from run")
def bm25_topk(spark, sf):
    return bm25_run(spark, sf).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def dense_run(spark, sf, k: int = 20) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return R.dense(v, v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), k)


@query(f"with {VECTORS} select query_id, chunk_id, rank::int rank, round(score, 6) score from drun")
def dense_topk(spark, sf):
    return dense_run(spark, sf).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def label_run(spark, sf) -> DataFrame:
    """A second run: vectors of the query's label by hashed order."""
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    score = F.conv(F.substring(F.sha2(F.concat_ws("|", "query_id", "vec_id"), 256), 1, 8), 16, 10).cast("double")
    return R.top_k(q.join(v, "label").select("query_id", F.col("vec_id").alias("chunk_id"), score.alias("score")), 20, "label")


LABEL = """l as (select q.vec_id query_id, v.vec_id chunk_id, ('0x' || substr(sha256(q.vec_id || '|' || v.vec_id), 1, 8))::bigint::double score from embeddings q join embeddings v using (label) where q.vec_id % 50 = 0),
lrun as (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from l qualify rank <= 20)"""


@query(f"with {VECTORS}, {LABEL}, both_runs as (select query_id, chunk_id, rank, 'dense' source from drun union all select query_id, chunk_id, rank, 'label' from lrun), fused as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) score, array_to_string(list_sort(list(source)), '+') source from both_runs group by all) select query_id, chunk_id, (row_number() over (partition by query_id order by score desc, chunk_id))::int rank, score, source from fused qualify rank <= 20")
def rrf_hybrid(spark, sf):
    return R.hybrid(dense_run(spark, sf), label_run(spark, sf), 20)


@query(f"with {VECTORS}, {LABEL}, x as (select d.query_id, d.chunk_id, d.rank first, l.score s, case when d.rank <= 10 and l.score is not null then 0 when d.rank <= 10 then 1 else 2 end tier from drun d left join lrun l using (query_id, chunk_id)) select query_id, chunk_id, (row_number() over (partition by query_id order by tier, case when tier = 0 then -s end, case when tier > 0 then first end, chunk_id))::int rank, case when tier = 0 then s end score from x qualify rank <= 15")
def rerank_two_tier(spark, sf):
    return R.rerank(dense_run(spark, sf), label_run(spark, sf), 10, 15).select("query_id", "chunk_id", "rank", "score")


# ---- relevance


@query(f'with {GOLD} select query_id, doc_id::varchar || \':\' || "start" || \'-\' || "end" passage_id, doc_id, "start", "end", gain from gold')
def gold_spans(spark, sf):
    return gold(spark, sf)


@query(f"with {LINES}, {GOLD}, {QRELS} select * from qrels")
def qrels(spark, sf):
    return E.qrels(lines(spark, sf), gold(spark, sf))


@query(f"with {LINES}, {GOLD}, {QRELS}, best as (select query_id, max(cov) cov from covered group by 1) select m min_coverage, count(*) filter (cov >= m) reachable, count(*) n_gold from best, (values (0.3::double), (0.5), (0.7), (1.0)) t(m) group by 1")
def coverage_sweep(spark, sf):
    return E.coverage_sweep(lines(spark, sf), gold(spark, sf))


@query(f"with {LINES}, {GOLD}, {QRELS}, q as (select distinct query_id from gold) select count(*) n_gold, count(*) filter (query_id in (select query_id from qrels)) n_reachable, count(*) filter (query_id in (select query_id from qrels)) / count(*) fraction from q")
def reachability(spark, sf):
    g = gold(spark, sf)
    return E.reachability(g, E.qrels(lines(spark, sf), g))


@query(f"with {LINES}, {GOLD}, {QRELS} select query_id from qrels intersect select query_id from covered where cov >= 1.0")
def common_subset(spark, sf):
    c, g = lines(spark, sf), gold(spark, sf)
    both = E.qrels(c, g).withColumn("config", F.lit("half")).unionByName(E.qrels(c, g, 1.0).withColumn("config", F.lit("whole")))
    return E.common_judgeable(both)


@query(f"with {LINES}, {GOLD}, {QRELS}, {BM25}, first as (select q.query_id, min(rank) first from qrels q left join run using (query_id, chunk_id) group by 1) select k depth, avg((coalesce(first, 1000) <= k)::int::double) ceiling, count(*) judged from first, (values (1), (5), (25), (50)) t(k) group by 1")
def recall_ceiling(spark, sf):
    return R.recall_ceiling(bm25_run(spark, sf), E.qrels(lines(spark, sf), gold(spark, sf)), [1, 5, 25, 50])


def scores(spark, sf) -> DataFrame:
    return E.per_query(bm25_run(spark, sf), E.qrels(lines(spark, sf), gold(spark, sf)), passages(spark, sf))


@query(f"with {LINES}, {GOLD}, {QRELS}, {BM25}, {METRICS} select * from per")
def per_query_scores(spark, sf):
    return scores(spark, sf)


@query(f"with {LINES}, {GOLD}, {QRELS}, {BM25}, {METRICS}, long as (select 'ndcg' name, ndcg v from per union all select 'recall', recall from per union all select 'rr', rr from per) select name, round(avg(v), 6) \"value\", count(v) n_scored, count(*) - count(v) n_skipped from long group by 1")
def score_run(spark, sf):
    return E.summary(scores(spark, sf))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda w: length(w) > 2 and not list_contains(" + STOP + ", w))"


@query(f"select item_id, round(len(list_intersect({CONTENT.format('b.text')}, {CONTENT.format('d.text')})) / nullif(len({CONTENT.format('b.text')}), 0), 6) overlap from benchmark b join documents d on d.doc_id = b.item_id")
def lexical_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"))
    d = docs(spark, sf).select(F.col("doc_id").alias("item_id"), F.col("text").alias("p"))
    return b.join(d, "item_id").select("item_id", F.round(T.lexical_overlap("q", "p"), 6).alias("overlap"))


@query(f"with {LINES}, {GOLD}, {QRELS}, {BM25}, {METRICS}, o as (select item_id query_id, round(len(list_intersect({CONTENT.format('b.text')}, {CONTENT.format('d.text')})) / nullif(len({CONTENT.format('b.text')}), 0), 6) overlap from benchmark b join documents d on d.doc_id = b.item_id) select round(avg(case when overlap < 0.4 then ndcg end), 6) low, round(avg(case when overlap >= 0.4 then ndcg end), 6) high from per join o using (query_id)")
def overlap_split(spark, sf):
    return E.overlap_split(scores(spark, sf), lexical_overlap(spark, sf).withColumnRenamed("item_id", "query_id"))


@query("with x as (select doc_id, text, min(source) over (partition by text) a, max(source) over (partition by text) b from documents) select doc_id query_id from x where a <> b")
def ambiguous_queries(spark, sf):
    return L.ambiguous(docs(spark, sf).select(F.col("doc_id").alias("query_id"), "text", F.col("source").alias("passage_id")))


@query("with h as (select doc_id, source, lang, sha256('42|' || doc_id) h from documents), g as (select * from h qualify row_number() over (partition by source order by h, doc_id) <= 5), s as (select *, row_number() over (partition by lang order by h, doc_id) s from g) select doc_id, source, lang, (row_number() over (order by s, lang))::int position from s qualify position <= 60")
def stratified_sample(spark, sf):
    return L.stratified_sample(docs(spark, sf).select("doc_id", "source", "lang"), "doc_id", "source", "lang", 5, 60)


@query("with x as (select doc_id, row_number() over (order by doc_id) - 1 i, count(*) over () n from documents) select doc_id from x where i % greatest(1, n // 40) = 0 and i // greatest(1, n // 40) < 40")
def spaced_sample(spark, sf):
    return L.spaced_sample(docs(spark, sf).select("doc_id"), ["doc_id"], 40)


@query("select lang kind, source verification, count(*) n, round(avg(length(text)), 6) overlap, count(distinct doc_id) docs from documents group by all")
def summarise(spark, sf):
    x = docs(spark, sf).select(F.col("lang").alias("kind"), F.col("source").alias("verification"), F.length("text").alias("lexical_overlap"), "doc_id")
    return L.summarise(x)


# ---- statistics

DRAW = "('0x' || substr(sha256({0}), 1, 15))::bigint"
RUNNER = f"{LINES}, {GOLD}, {QRELS}, {BM25}, {METRICS}"
# Two configurations over the lines: BM25 to rank 50, and the same reranked by the chunks' hashes.
HASHED = "('0x' || substr(sha256(query_id || '|' || chunk_id), 1, 8))::bigint"
RERUN = (
    f"{RUNNER}, other as (select query_id, chunk_id, row_number() over (partition by query_id order by case when rank <= 10 then 0 else 1 end, case when rank <= 10 then -{HASHED} end, rank) rank from run), "
    "ohit as (select query_id, sum(case when rank <= 10 then (pow(2, gain) - 1) / log2(rank + 1) end) dcg, count(*) filter (rank <= 50) found, min(rank) first from other join qrels using (query_id, chunk_id) where gain > 0 group by 1), "
    "oper as (select i.query_id, round(coalesce(dcg, 0) / idcg, 9) ndcg, round(coalesce(found, 0) / relevant, 9) recall, round(coalesce(1 / first, 0), 9) rr from ideal i left join ohit h using (query_id)), "
    "both_configs as (select 'bm25-lines' config, query_id, ndcg, recall, rr from per where ndcg is not null union all select 'rerank-hash-10', query_id, ndcg, recall, rr from oper)"
)


def ablation(spark, sf):
    """Three configurations over the documents' lines; the third lacks its vectors."""
    base = G.Config("bm25-lines", "baseline", "lines")
    configs = [base, replace(base, name="rerank-hash-10", axis="reranking", reranker="hash", candidate_k=10), replace(base, name="dense-none", axis="interaction", retrieval="dense", embedding="none")]
    asked = passages(spark, sf)
    overlap = F.when(F.length("text") % 2 == 0, 0.2).otherwise(0.6)
    first = bm25_run(spark, sf).where("rank <= 10").select("query_id", "chunk_id").persist()
    score = F.conv(F.substring(F.sha2(F.concat_ws("|", "query_id", "chunk_id"), 256), 1, 8), 16, 10).cast("double")
    scores = asked.join(first, "query_id", "left").select("query_id", F.col("text").alias("query_text"), "chunk_id", score.alias("score"))
    inputs = N.Inputs(asked.withColumn("lexical_overlap", overlap), {"markdown": (docs(spark, sf).select("doc_id", "text"), gold(spark, sf).persist())}, scores={"hash": scores})
    return N.run_ablation(configs, inputs, resamples=1000)


@query(
    f"with {RERUN}, m as (select config, round(avg(ndcg), 6) ndcg_common, round(avg(recall), 6) recall_common, round(avg(rr), 6) rr_common, count(*) n_common, "
    "round(avg(case when length(text) % 2 = 0 then ndcg end), 6) ndcg_low_overlap, round(avg(case when length(text) % 2 = 1 then ndcg end), 6) ndcg_high_overlap "
    "from both_configs join benchmark on item_id = query_id group by 1), g as (select count(distinct query_id) n from gold), q as (select count(distinct query_id) n from qrels), "
    "top10 as (select q.query_id, coalesce(min(rank) <= 10, false) ok from (select distinct query_id from qrels) q left join (select r.query_id, rank from run r join qrels using (query_id, chunk_id)) r using (query_id) group by 1) "
    "select t.config, t.measured, t.reason, ndcg_common, recall_common, rr_common, n_common, ndcg_low_overlap, ndcg_high_overlap, case when measured then (select q.n / g.n from q, g) end fraction, "
    "case when t.config = 'rerank-hash-10' then (select avg(ok::int::double) from top10) end ceiling "
    "from (values ('bm25-lines', true, null), ('rerank-hash-10', true, null), ('dense-none', false, 'no vectors of none for lines')) t(config, measured, reason) left join m using (config)"
)
def ablation_results(spark, sf):
    names = ["config", "measured", "reason", "ndcg_common", "recall_common", "rr_common", "n_common", "ndcg_low_overlap", "ndcg_high_overlap", "fraction", "ceiling"]
    return ablation(spark, sf)[0].select(*names)


PAIRED = (
    "x as (select query_id, a.ndcg a, b.ndcg b from (select * from both_configs where config = 'bm25-lines') a join (select * from both_configs where config <> 'bm25-lines') b using (query_id)), "
    f"s as (select f, round(abs(avg(case when {DRAW.format(chr(39) + '42|' + chr(39) + ' || f || ' + chr(39) + '|' + chr(39) + ' || query_id')} % 2 = 0 then b - a else a - b end)), 9) s from x, range(10000) t(f) group by 1), "
    "g as (select round(avg(a), 9) mean_base, round(avg(b), 9) mean_system, round(avg(b - a), 9) delta, count(*) n from x), "
    "tested as (select g.*, (select (count(*) filter (s >= abs(delta)) + 1) / 10001.0::double from s) p from g)"
)


@query(f"with {RERUN}, {PAIRED} select 'rerank-hash-10' \"name\", *, round(p, 9) p_holm, round(p, 9) < 0.05 significant from tested")
def significance(spark, sf):
    return N.significance(ablation(spark, sf)[1], "bm25-lines")


@query(
    f"with {RUNNER}, v as (select query_id, ndcg, row_number() over (order by query_id) - 1 i from per where ndcg is not null), n as (select count(*) n from v), "
    f"d as (select b, {DRAW.format(chr(39) + '42|' + chr(39) + ' || b || ' + chr(39) + '|' + chr(39) + ' || i')} % n j from v, n, range(10000) t(b)), m as (select b, avg(ndcg) m from d join v on v.i = d.j group by 1) "
    "select (select round(avg(ndcg), 9) from v) point, (select n from n) n, round(quantile_cont(m, 0.025), 9) low, round(quantile_cont(m, 0.975), 9) high from m"
)
def bootstrap_ci(spark, sf):
    return E.bootstrap_ci(scores(spark, sf).select("query_id", F.col("ndcg").alias("value"))).select("point", "n", "low", "high")


@query(f"with {RERUN}, {PAIRED} select * from tested")
def paired_test(spark, sf):
    x = ablation(spark, sf)[1]
    value = lambda name: x.where(F.col("config") == name).select("query_id", F.col("ndcg").alias("value"))
    return E.paired_test(value("bm25-lines"), value("rerank-hash-10"))


@query("with t as (select o_orderpriority || o_orderstatus \"name\", (count(*) % 97) / 1000.0::double p from orders group by 1), r as (select *, row_number() over (order by p, name) r, count(*) over () m from t), h as (select name, p, round(max(least(1, (m - r + 1) * p)) over (order by p, name rows unbounded preceding), 9) p_holm from r) select *, p_holm < 0.05 significant from h")
def holm(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("name"))
    return E.holm(o.agg((F.count("*") % 97 / F.lit(1000.0)).alias("p")))


# ---- answers

# Answers made of orders: refusals, numbers in several forms, citations within and beyond the context.
DUCK_ANSWERS = """a as (select o_orderkey::varchar query_id, case when o_orderkey % 2 = 0 then 'rag' else 'long' end arm,
  case when o_orderkey % 11 = 0 then 'This is NOT in context.' when o_orderkey % 7 = 0 then 'A loss of (' || o_custkey || '.50) [2]'
    else 'It was ' || o_custkey || ' in 1998 [' || o_orderkey % 4 || '][' || o_custkey % 3 || '][' || o_orderkey % 4 || ']' end answer,
  (['a', 'b', 'c'])[1:1 + o_orderkey % 3] context_ids,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 7 = 0 then '(' || o_custkey || '.5)' else (o_custkey + (o_orderkey % 5 = 0)::int)::varchar end expected,
  case when o_orderkey % 9 = 0 then null when o_orderkey % 9 = 1 then [] else ['b'] end gold_ids,
  o_custkey % 1000 prompt_tokens, o_orderkey % 50 output_tokens, (o_orderkey % 97) / 10.0::double latency_seconds, o_orderkey % 3 = 0 from_cache from orders)"""
NUMBER_LIST = "list_transform(regexp_extract_all({0}, '-?\\d[\\d,]*(?:\\.\\d+)?'), lambda x: case when contains(x, '.') then rtrim(rtrim(replace(x, ',', ''), '0'), '.') else replace(x, ',', '') end)"
CANONICAL = """m as (select *, replace(regexp_extract(replace(raw, ' ', ''), '-?\\d[\\d,]*(?:\\.\\d+)?'), ',', '') v from t),
signed as (select *, case when contains(raw, '(') and contains(raw, ')') and not starts_with(v, '-') then '-' || v else v end s from m),
canon as (select *, case when replace(s, '-', '') = '' then null when contains(s, '.') then rtrim(rtrim(s, '0'), '.') else s end canonical from signed)"""
SCORED = (
    f"{DUCK_ANSWERS}, t as (select *, expected raw from a), {CANONICAL}, "
    "n as (select *, list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::int)) c, contains(lower(answer), 'not in context') refused, replace(answer, ' ', '') clean from canon), "
    "k as (select *, list_transform(list_filter(c, lambda x: x between 1 and len(context_ids)), lambda x: context_ids[x]) cited, list_filter(c, lambda x: not x between 1 and len(context_ids)) wrong, not refused and gold_ids is not null known from n), "
    f"scored as (select query_id, arm, refused, case when not refused and expected is not null then len(list_filter({NUMBER_LIST.format('clean')}, lambda x: x = canonical or (contains(clean, '(') and contains(clean, ')') and '-' || x = canonical))) > 0 end value_correct, "
    "case when known and len(cited) > 0 then len(list_intersect(cited, gold_ids)) / len(cited) when known and len(gold_ids) > 0 then 0.0 end citation_precision, "
    "case when known and len(gold_ids) > 0 then len(list_intersect(cited, gold_ids)) > 0 end citation_recall, len(wrong) > 0 cited_a_hallucinated_passage from k)"
)


def answers(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) query_id", "if(o_orderkey % 2 = 0, 'rag', 'long') arm",
        """case when o_orderkey % 11 = 0 then 'This is NOT in context.' when o_orderkey % 7 = 0 then concat('A loss of (', o_custkey, '.50) [2]')
           else concat('It was ', o_custkey, ' in 1998 [', o_orderkey % 4, '][', o_custkey % 3, '][', o_orderkey % 4, ']') end answer""",
        "slice(array('a', 'b', 'c'), 1, cast(1 + o_orderkey % 3 as int)) context_ids",
        "case when o_orderkey % 13 = 0 then null when o_orderkey % 7 = 0 then concat('(', o_custkey, '.5)') else cast(o_custkey + if(o_orderkey % 5 = 0, 1, 0) as string) end expected",
        "case when o_orderkey % 9 = 0 then null when o_orderkey % 9 = 1 then cast(array() as array<string>) else array('b') end gold_ids",
        "o_custkey % 1000 prompt_tokens", "o_orderkey % 50 output_tokens", "(o_orderkey % 97) / 10.0D latency_seconds", "o_orderkey % 3 = 0 from_cache",
    )


@query(f"with {SCORED} select query_id, len(cited)::int n_valid, len(wrong)::int n_invalid, refused from k")
def citations(spark, sf):
    x = A.cited(answers(spark, sf))
    return x.select("query_id", F.size("cited_ids").alias("n_valid"), F.size("invalid_citations").alias("n_invalid"), T.refused("answer").alias("refused"))


RAW = "case o_orderkey % 5 when 0 then '$ ' || o_custkey when 1 then '(' || o_custkey || ',415)' when 2 then o_custkey % 100 || '.' || o_custkey % 10 || '0 %' when 3 then 'none' else '-' || o_custkey || '.0 (x)' end"


@query(f"with t as (select o_orderkey, {RAW} raw from orders), {CANONICAL} select o_orderkey, raw, canonical from canon")
def number_match(spark, sf):
    x = table(spark, sf, "orders").selectExpr("o_orderkey", f"{RAW} raw")
    return x.select("o_orderkey", "raw", T.normalise_number("raw").alias("canonical"))


@query(f"with {SCORED} select * exclude (arm) from scored")
def answer_scores(spark, sf):
    return A.score(answers(spark, sf)).drop("arm")


@query(f"with {DUCK_ANSWERS} select arm, count(*) n, round((sum(prompt_tokens) * 0.3 + sum(output_tokens) * 2.5)::double / 1e6, 6) \"cost\", round((sum(prompt_tokens) * 0.3 + sum(output_tokens) * 2.5)::double / 1e6 / count(*), 8) cost_per_query, round(avg(prompt_tokens), 1) mean_prompt_tokens from a group by 1")
def token_cost(spark, sf):
    return A.token_cost(answers(spark, sf), 0.3, 2.5)


@query(f"with {DUCK_ANSWERS}, l as (select arm, list_sort(list(latency_seconds) filter (not from_cache)) l from a group by 1) select arm, len(l)::int n_live, l[len(l) // 2 + 1] p50, l[least(len(l) - 1, floor(len(l) * 0.95))::int + 1] p95 from l")
def latency_index_pct(spark, sf):
    return A.latency(answers(spark, sf))


@query(f"with {SCORED} select arm, count(*) n, round(avg(refused::int), 6) refusal_rate, round(count(*) filter (value_correct) / nullif(count(value_correct), 0), 6) accuracy_answered, round(count(*) filter (value_correct) / count(*), 6) accuracy_all, round(avg(citation_precision), 6) citation_precision, round(avg(citation_recall::int), 6) citation_recall from scored group by 1")
def arm_summary(spark, sf):
    return A.by_arm(A.score(answers(spark, sf)))


# Each gold document is expected to say its number's last digit: other lines of it that do are no gold but right.
EXPECTED = f"expected as (select distinct query_id, doc_id, (doc_id % 10)::varchar \"value\" from gold), more as (select distinct query_id, chunk_id from chunks join expected using (doc_id) where list_contains({NUMBER_LIST.format(chr(34) + 'text' + chr(34))}, \"value\"))"


def expected(gold_rows) -> DataFrame:
    return gold_rows.select("query_id", "doc_id", (F.col("doc_id") % 10).cast("string").alias("value")).distinct()


@query(f"with {LINES}, {GOLD}, {QRELS}, {EXPECTED} select query_id, chunk_id, gain from qrels union all select query_id, chunk_id, 1 from more anti join qrels using (query_id, chunk_id)")
def lenient_qrels(spark, sf):
    c, g = lines(spark, sf), gold(spark, sf)
    return E.lenient_qrels(E.qrels(c, g), c, expected(g))


@query(
    f"with {LINES}, {GOLD}, {QRELS}, {BM25}, {EXPECTED}, top as (select * from run where rank <= 10), hits as (select query_id, count(*) hits from top join more using (query_id, chunk_id) anti join qrels using (query_id, chunk_id) group by 1), "
    "good as (select distinct query_id, 1 good from top join qrels using (query_id, chunk_id)) select count(*) affected, coalesce(sum(hits), 0)::bigint unjudged_hits, count(*) filter (good is null) false_zeros from hits left join good using (query_id)"
)
def unjudged(spark, sf):
    c, g = lines(spark, sf), gold(spark, sf)
    return E.unjudged(bm25_run(spark, sf), E.qrels(c, g), c, expected(g))


# ---- tables

# A filing for each customer: orders by priority and year, as an HTML table.
FILINGS = """n as (select o_custkey doc_id, o_orderpriority p, count(*) filter (year(o_orderdate) = 1997) a, count(*) filter (year(o_orderdate) = 1998) b from orders group by all),
l as (select doc_id, 'Number of orders ' || p row_label, case when a > 0 then a::varchar else 'n/a' end a, case when b > 0 then b::varchar else 'n/a' end b, row_number() over (partition by doc_id order by p) i from n),
t as (select *, '| ' || row_label || ' | ' || a || ' | ' || b || ' |' passage from l),
placed as (select *, (39 + sum(length(passage) + 1) over (partition by doc_id order by i) - length(passage) - 1)::bigint "start" from t)"""


def filings(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("p"))
    year = lambda y: F.count_if(F.year("o_orderdate") == y)
    cell = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise("n/a")
    row = F.concat(F.lit("<tr><td>Number of orders "), "p", F.lit("</td><td>"), cell("a"), F.lit("</td><td>"), cell("b"), F.lit("</td></tr>"))
    x = o.agg(year(1997).alias("a"), year(1998).alias("b")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p", row.alias("r")))).alias("rows"))
    head = F.lit("<table><tr><td></td><td>1997</td><td>1998</td></tr>")
    return x.select("doc_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["r"]), ""), F.lit("</table>")).alias("html"))


def facts(spark, sf) -> DataFrame:
    parsed = H.documents(filings(spark, sf))
    blocks = parsed.select("doc_id", F.explode("blocks").alias("b")).where("b.kind = 'table'")
    tables = blocks.select("doc_id", "b.block_id", F.concat(F.lit("Customer "), "doc_id").alias("company"), F.lit("markdown").alias("rendering"), "b.table.caption", "b.table.n_header_rows", "b.table.rows")
    return L.located(L.table_facts(tables), parsed)


@query(f"with {FILINGS} select doc_id, 't00000' block_id, row_label, case when a <> 'n/a' then '1997' else '1998' end period, case when a <> 'n/a' then a else b end \"value\", (i + 1)::int line, \"start\", \"start\" + length(passage) \"end\" from placed where a <> 'n/a' or b <> 'n/a'")
def table_facts(spark, sf):
    return facts(spark, sf).select("doc_id", "block_id", "row_label", "period", "value", "line", "start", "end")


ASKED = """f as (select doc_id, row_label, case when a <> 'n/a' then '1997' else '1998' end period, case when a <> 'n/a' then a else b end expected, "start", length(passage) n, doc_id % 4 sector from placed where a <> 'n/a' or b <> 'n/a'),
h as (select *, 'q-' || substr(sha256(doc_id || '|' || row_label || '|' || period), 1, 12) query_id from f), hh as (select *, sha256('42|' || query_id) h from h),
g as (select * from hh qualify row_number() over (partition by doc_id order by h, query_id) <= 3), s as (select *, row_number() over (partition by sector order by h, query_id) s from g),
pos as (select *, row_number() over (order by s, sector) position from s qualify position <= 50)"""


@query(
    f"with {FILINGS}, {ASKED} select query_id, case position % 5 when 1 then 'What was Customer ' || doc_id || chr(39) || 's ' || lower(row_label) || ' for ' || period || '?' when 2 then 'How much did Customer ' || doc_id || ' report for ' || lower(row_label) || ' in ' || period || '?' "
    "when 3 then 'In ' || period || ', what amount did Customer ' || doc_id || ' record as ' || lower(row_label) || '?' when 4 then 'Report Customer ' || doc_id || chr(39) || 's ' || lower(row_label) || ' figure for the ' || period || ' fiscal year.' else 'Customer ' || doc_id || ' ' || lower(row_label) || ' ' || period end \"text\", "
    "doc_id, doc_id || ':' || \"start\" || '-' || (\"start\" + n) passage_id, 2 gain, expected from pos"
)
def eval_queries(spark, sf):
    x = facts(spark, sf).withColumns({"company": F.concat(F.lit("customer "), "doc_id"), "sector": F.col("doc_id") % 4})
    return L.build_queries(x, 50, 3).select("query_id", "text", "doc_id", "passage_id", "gain", "expected")


# ---- sources


@query("select doc_id, sha256(text) sha256, length(text)::bigint n_chars, coalesce(source, '') source from documents")
def corpus_manifest(spark, sf):
    return S.manifest(docs(spark, sf))


@query("with o as (select doc_id, sha256(text) a from documents), n as (select doc_id, sha256(replace(text, chr(10), ' ')) b from documents union all select -1 - item_id, sha256(text) from benchmark) select case when a is null then 'added' when b is null then 'removed' when a <> b then 'changed' else 'same' end state, count(*) n from o full join n using (doc_id) group by 1")
def drift(spark, sf):
    d = docs(spark, sf)
    new = d.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), "source")
    new = new.unionByName(table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text", F.lit("benchmark").alias("source")))
    return S.drift(S.manifest(d), S.manifest(new))


@query("select doc_id, length(text)::bigint n_chars from documents")
def verified_corpus(spark, sf):
    d = docs(spark, sf)
    return S.verified(d, S.manifest(d)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("select count(*) filter (d.doc_id is not null and v.vec_id is not null) matched, count(*) filter (v.vec_id is null) missing, count(*) filter (d.doc_id is null) unmatched, count(*) filter (d.doc_id is not null and v.vec_id is not null) / count(d.doc_id) coverage from documents d full join embeddings v on d.doc_id = v.vec_id")
def vector_alignment(spark, sf):
    return S.align_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id")), docs(spark, sf).select(F.col("doc_id").alias("chunk_id")))


@query("with x as (select 'k' || (o_orderkey % 5) ticker, o_orderdate::date::varchar report_date, o_orderkey from orders), one as (select * from x qualify row_number() over (partition by ticker, report_date order by o_orderkey desc) = 1) select ticker, report_date, o_orderkey accession from one qualify row_number() over (partition by ticker order by report_date desc, o_orderkey desc) <= 4")
def latest_filings(spark, sf):
    o = table(spark, sf, "orders")
    date = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    x = o.select(F.concat(F.lit("k"), (F.col("o_orderkey") % 5).cast("string")).alias("ticker"), date.alias("report_date"), date.alias("filing_date"), F.col("o_orderkey").alias("accession"), F.lit("10-K").alias("form"))
    return S.latest_filings(x, 4).select("ticker", "report_date", "accession")
