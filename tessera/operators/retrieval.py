"""Lexical and dense retrieval, fusion and reranking. A run has query_id, chunk_id, rank, score, source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import tokens


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf, length (tokens, repeats included). A chunk is one row, so its terms are counted inside it."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, tf, length = _counted(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), term, pa.array(tf), pa.array(length[row])], ["chunk_id", "term", "tf", "length"])

    return chunks.select("chunk_id", tokens("text").alias("tokens")).mapInArrow(run, f"chunk_id {kind}, term string, tf bigint, length int")


def _counted(lists: pa.Array):
    """(row, term, tf) of each distinct term of a row's list, and the lists' lengths."""
    import numpy as np

    length = np.diff(lists.offsets.to_numpy()).astype(np.int32)
    coded = lists.flatten().dictionary_encode()
    names = len(coded.dictionary) or 1
    key = np.repeat(np.arange(len(length)), length) * names + coded.indices.to_numpy()
    key, tf = np.unique(key, return_counts=True)
    return key // names, coded.dictionary.take(pa.array(key % names)), tf.astype(np.int64), length


def term_stats(chunks: DataFrame) -> DataFrame:
    """term, df, cf: in how many chunks a term is, and how often. Only partial sums are shuffled."""
    return postings(chunks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def collection(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length."""
    n = F.size(tokens("text"))
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avgdl"))


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.ln(1 + (n - df + 0.5) / (df + 0.5)))


def idf_report(chunks: DataFrame, top: int) -> DataFrame:
    """The rarest terms."""
    df = term_stats(chunks)
    x = df.crossJoin(F.broadcast(collection(chunks).select("n")))  # one row
    return x.select("term", "df", F.round(idf(F.col("df"), F.col("n")), 9).alias("idf")).orderBy(F.desc("idf"), "term").limit(top)


def top_k(scores: DataFrame, k: int, source: str) -> DataFrame:
    """The k best per query, by score and then chunk_id: a total order."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    out = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "chunk_id", "rank", "score", F.lit(source).alias("source"))


MOST_TERMS = 1 << 20


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, block: int = 1024) -> DataFrame:
    """Okapi BM25 with query-term multiplicity.

    One pass over the chunks keeps of each its length and the counts of the queries' terms, cached and spilled by the
    executors; collection statistics and the scores of any number of queries come from that. Up to 2**20 distinct query
    terms, queries are scored in blocks against batches of chunks, and only local top-k lists are shuffled; beyond, by a
    join of postings."""
    kinds = [queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType]
    asked = queries.select("query_id", tokens("text").alias("tokens"))
    vocabulary = [r.term for r in asked.select(F.explode("tokens").alias("term")).distinct().limit(MOST_TERMS + 1).collect()]
    if len(vocabulary) > MOST_TERMS:
        return top_k(_bm25_joined(chunks, asked, k1, b), k, "bm25")
    index = _hits(chunks, sorted(vocabulary)).persist(StorageLevel.MEMORY_AND_DISK)
    stats = index.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).first()
    df = {r.term: r.n for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    at = {t: i for i, t in enumerate(sorted(vocabulary))}
    out: DataFrame | None = None
    held: list = []

    def score() -> DataFrame:
        weights: dict[int, list[tuple[int, float]]] = {}
        for i, q in enumerate(held):
            for t in q.tokens:
                if n := df.get(at[t]):
                    weights.setdefault(at[t], []).append((i, max(0.0, math.log(1 + (stats.n - n + 0.5) / (n + 0.5)))))
        part = _scores(index, weights, [q.query_id for q in held], stats.avgdl or 1.0, k, k1, b, kinds)
        return part if out is None else out.unionByName(part)

    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = score(), []
    if held:
        out = score()
    if out is None:
        empty = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, rank int, score double, source string"
        return chunks.sparkSession.createDataFrame([], empty)
    return top_k(out, k, "bm25")


def _hits(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """chunk_id, length (tokens), terms (positions in the vocabulary, ascending) and tf of each chunk."""
    sent = chunks.sparkSession.sparkContext.broadcast(vocabulary)  # MOST_TERMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = pa.array(sent.value, pa.string())
        for b in batches:
            lists = b.column(1)
            length = np.diff(lists.offsets.to_numpy())
            term = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy()
            size = max(1, len(known))
            key, tf = np.unique((np.repeat(np.arange(len(length)), length) * size + term)[term >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(key // size, np.arange(len(length) + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32)))
            counts = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length.astype(np.int32)), terms, counts], ["chunk_id", "length", "terms", "tf"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", tokens("text").alias("tokens")).mapInArrow(run, f"chunk_id {kind}, length int, terms array<int>, tf array<int>")


def _scores(index: DataFrame, weights: dict, ids: list, avgdl: float, k: int, k1: float, b: float, kinds: list) -> DataFrame:
    """query_id, chunk_id, score: candidates that hold each query's k best."""
    sent = index.sparkSession.sparkContext.broadcast((weights, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        weights, ids = sent.value
        names = pa.array(ids, to_arrow_type(kinds[0]))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                n = part.num_rows
                order = np.argsort(np.array(part.column(0).to_pylist()), kind="stable")  # ties go to smaller ids
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                term = part.column(2).flatten().to_numpy()
                doc = np.repeat(place, np.diff(part.column(2).offsets.to_numpy()))
                tf, length = part.column(3).flatten().to_numpy().astype(np.float64), part.column(1).to_numpy()[order]
                by = np.lexsort((doc, term))
                term, doc, tf = term[by], doc[by], tf[by]
                value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avgdl))
                score = np.zeros((len(ids), n))
                cuts = np.flatnonzero(np.diff(term, prepend=-1))
                for lo, hi in zip(cuts, np.append(cuts, len(term))[1:], strict=True):
                    for i, w in weights.get(int(term[lo]), ()):
                        score[i, doc[lo:hi]] += w * value[lo:hi]
                score = np.round(score, 9)
                best = np.argpartition(-score, min(k, n) - 1, axis=1)[:, : min(k, n)] if n > k else np.broadcast_to(np.arange(n), (len(ids), n))
                least = np.take_along_axis(score, best, 1).min(axis=1)
                query, col = np.nonzero((score >= least[:, None]) & (score > 0))  # with all ties of the k-th
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(query)), part.column(0).take(pa.array(order[col])), pa.array(score[query, col])],
                    ["query_id", "chunk_id", "score"],
                )

    return index.mapInArrow(run, f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double")


def _bm25_joined(chunks: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """query_id, chunk_id, score by joins of postings, for any number of queries and terms."""
    post = postings(chunks)
    terms = asked.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(collection(chunks))  # one row
    x = terms.join(df, "term").join(post, "term").crossJoin(stats)
    part = F.col("qtf") * idf(F.col("df"), F.col("n")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    return x.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def dense(vectors: DataFrame, queries: DataFrame, k: int = 50, block: int = 1024) -> DataFrame:
    """Exact cosine top-k: vectors (chunk_id, embedding) meet blocks of queries (query_id, embedding) as one matrix
    product per batch with local top-k, so only k rows per query and batch are shuffled. Negative scores are kept."""
    import numpy as np

    spark = vectors.sparkSession
    ids, rows = [], []
    out: DataFrame | None = None

    def part(ids, rows) -> DataFrame:
        q = np.array(rows, np.float64)
        q /= np.where((n := np.linalg.norm(q, axis=1, keepdims=True)) == 0, 1, n)
        names = pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType))
        sent = spark.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                x /= np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
                order = np.argsort(np.array(b.column(0).to_pylist()), kind="stable")
                s = np.round(q @ x[order].T, 9)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, best, 1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.repeat(np.arange(len(q)), best.shape[1]))), b.column(0).take(pa.array(order[best].ravel())), pa.array(score)],
                    ["query_id", "chunk_id", "score"],
                )

        kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()]
        return vectors.select("chunk_id", "embedding").mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")

    for r in queries.select("query_id", "embedding").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.embedding)
        if len(ids) == block:
            out = part(ids, rows) if out is None else out.unionByName(part(ids, rows))
            ids, rows = [], []
    if ids or out is None:
        if not ids:
            return spark.createDataFrame([], "query_id string, chunk_id string, rank int, score double, source string")
        out = part(ids, rows) if out is None else out.unionByName(part(ids, rows))
    return top_k(out, k, "dense")


def rrf(runs: list[DataFrame], k: int = 50, weights: list[float] | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion; source names the components."""
    weights = weights or [1.0] * len(runs)
    tagged = [r.select("query_id", "chunk_id", "source", (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for r, w in zip(runs, weights, strict=True) if w]
    x = tagged[0]
    for t in tagged[1:]:
        x = x.unionByName(t)
    x = x.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", "source")


def hybrid(lexical: DataFrame, vector: DataFrame, k: int, candidate_k: int = 100) -> DataFrame:
    depth = max(candidate_k, k)
    return rrf([lexical.where(F.col("rank") <= depth), vector.where(F.col("rank") <= depth)], k)


def rerank(run: DataFrame, scores: DataFrame, candidate_k: int, k: int) -> DataFrame:
    """Scored shortlist by score, then unscored shortlist and tail in first-stage order; queries without any scores stay."""
    x = run.join(scores.select("query_id", "chunk_id", F.col("score").alias("_s")), ["query_id", "chunk_id"], "left")
    tier = F.when((F.col("rank") <= candidate_k) & F.col("_s").isNotNull(), 0).when(F.col("rank") <= candidate_k, 1).otherwise(2)
    x = x.withColumn("_tier", tier).withColumn("_first", F.col("rank"))
    w = W.partitionBy("query_id").orderBy("_tier", F.when(F.col("_tier") == 0, -F.col("_s")), F.when(F.col("_tier") > 0, F.col("_first")), "chunk_id")
    x = x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return x.select("query_id", "chunk_id", "rank", F.when(F.col("_tier") == 0, F.col("_s")).alias("score"), "source")


def recall_ceiling(run: DataFrame, qrels: DataFrame, depths: list[int]) -> DataFrame:
    """Share of judged queries with a relevant chunk within each depth."""
    judged = qrels.where("gain > 0").select("query_id", "chunk_id")
    first = judged.join(run.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("first"))
    each = first.select("first", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    return each.groupBy("depth").agg(F.avg(F.coalesce((F.col("first") <= F.col("depth")).cast("double"), F.lit(0.0))).alias("ceiling"), F.count("*").alias("judged"))
