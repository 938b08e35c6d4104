"""Runs the experiment grid: chunks and labels once per index, then one plan over all configurations.

Configurations that cannot run - no sentence vectors, no query vectors for every wording, scores of other wordings -
are reported with the reason and no number. All are compared on the queries that each of them can answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chunking, evaluation, retrieval
from tessera.plans.grid import Config, by_index, check, union_of_runs

SCHEMA = "config string, axis string, chunker string, retrieval string, embedding string, reranker string, candidate_k int, table_rendering string"


@dataclass
class Inputs:
    """queries: query_id, text, lexical_overlap. corpora: by rendering, (documents, gold: query_id, doc_id, start, end,
    gain). sentences: by embedding, doc_id, pos, embedding. vectors: by embedding and chunker, chunk_id, embedding.
    query_vectors: by embedding, query_id, text, embedding. scores: by reranker, query_id, query_text, chunk_id, score."""

    queries: DataFrame
    corpora: dict[str, tuple[DataFrame, DataFrame]]
    sentences: DataFrame | None = None
    vectors: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    query_vectors: dict[str, DataFrame] = field(default_factory=dict)
    scores: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Group:
    """What configurations of one index share."""

    chunks: DataFrame | None = None
    rels: DataFrame | None = None
    gold: DataFrame | None = None
    reason: str | None = None
    depth: int = 0
    runs: dict[tuple, DataFrame] = field(default_factory=dict)  # first stages, to the depth that the deepest needs


def prepare(configs: list[Config], inputs: Inputs, top_k: int) -> Group:
    """Chunks and labels, cached and spilled by the executors, for configurations of one index."""
    config = configs[0]
    if config.table_rendering not in inputs.corpora:
        return Group(reason=f"no corpus rendered as {config.table_rendering}")
    docs, gold = inputs.corpora[config.table_rendering]
    if config.chunker.startswith("semantic") and inputs.sentences is None:
        return Group(reason="semantic chunking needs sentence vectors")
    chunks = chunking.chunk_corpus(docs, config.chunker, inputs.sentences).persist()
    return Group(chunks, evaluation.qrels(chunks, gold).persist(), gold, depth=max(top_k, *(c.candidate_k for c in configs)))


def _covered(queries: DataFrame, held: DataFrame, text: str) -> tuple[int, int]:
    """How many of the queries `held` covers in the wording asked, and how many there are."""
    same = held.select("query_id", F.col(text).alias("text")).distinct()
    return queries.join(same, ["query_id", "text"], "left_semi").count(), queries.count()


def _first_stage(config: Config, group: Group, inputs: Inputs) -> DataFrame | str:
    lexical = dense = None
    if config.retrieval != "dense":
        lexical = retrieval.bm25(group.chunks, inputs.queries, group.depth)
    if config.retrieval != "bm25":
        vectors = inputs.vectors.get((config.embedding, config.chunker))
        asked = inputs.query_vectors.get(config.embedding)
        if vectors is None or asked is None:
            return f"no vectors of {config.embedding} for {'queries' if vectors is not None else config.chunker}"
        have, all_ = _covered(inputs.queries, asked, "text")
        if have < all_:
            return f"query vectors of {config.embedding} cover {have} of {all_} queries as worded"
        known = vectors.join(group.chunks.select("chunk_id"), "chunk_id", "left_semi")
        asked = asked.join(inputs.queries.select("query_id", "text"), ["query_id", "text"])
        dense = retrieval.dense(known, asked.select("query_id", "embedding"), group.depth)
    return retrieval.hybrid(lexical, dense, group.depth) if config.retrieval == "hybrid" else lexical if dense is None else dense


def build_run(config: Config, group: Group, inputs: Inputs, top_k: int) -> DataFrame | str:
    """The configuration's run, or why there is none."""
    if group.reason:
        return group.reason
    key = config.retrieval, config.embedding
    if key not in group.runs:
        first = _first_stage(config, group, inputs)
        if isinstance(first, str):
            return first
        group.runs[key] = first.persist()
    run = group.runs[key]
    if config.reranker:
        scores = inputs.scores.get(config.reranker)
        if scores is None:
            return f"no scores of {config.reranker}"
        have, all_ = _covered(inputs.queries, scores, "query_text")
        if have < all_:
            return f"scores of {config.reranker} cover {have} of {all_} queries as worded"
        worded = scores.join(inputs.queries.select("query_id", F.col("text").alias("query_text")), ["query_id", "query_text"])
        return retrieval.rerank(run, worded.select("query_id", "chunk_id", "score"), config.candidate_k, top_k)
    return run.where(F.col("rank") <= top_k)


def _tagged(frames: dict[str, DataFrame]) -> DataFrame | None:
    return union_of_runs(frames)[0] if frames else None


def run_ablation(configs: list[Config], inputs: Inputs, top_k: int = 50, resamples: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(results, per_query). results: a row for each configuration with its axes, measured, reason, the mean metrics over
    the common queries and over all it can answer, nDCG's interval and split by overlap, reachability and, with a
    reranker, the first stage's recall ceiling. per_query: config, query_id, ndcg, recall, rr over the common queries."""
    check(configs)
    spark = inputs.queries.sparkSession
    groups = {key: prepare(some, inputs, top_k) for key, some in by_index(configs).items()}
    ran, reasons, rels, gold, ceilings = {}, {}, {}, {}, {}
    for c in configs:
        group = groups[c.index_key]
        run = build_run(c, group, inputs, top_k)
        if isinstance(run, str):
            reasons[c.name] = run
            continue
        ran[c.name], rels[c.name], gold[c.name] = run, group.rels, group.gold
        if c.reranker:
            first = build_run(replace(c, reranker=None), group, inputs, max(top_k, c.candidate_k))
            ceilings[c.name] = retrieval.recall_ceiling(first, group.rels, [c.candidate_k]).select("ceiling")
    listed = [(c.name, c.axis, c.chunker, c.retrieval, c.embedding, c.reranker, c.candidate_k, c.table_rendering) for c in configs]
    out = spark.createDataFrame(listed, SCHEMA).withColumn("measured", F.col("config").isin(list(ran)))
    why = spark.createDataFrame(list(reasons.items()) or [("", "")], "config string, reason string")
    out = out.join(F.broadcast(why), "config", "left")
    if not ran:
        return out, spark.createDataFrame([], "config string, query_id string, ndcg double, recall double, rr double")
    scores = {name: evaluation.per_query(run, rels[name], inputs.queries) for name, run in ran.items()}
    every = _tagged(scores).persist()
    common = evaluation.common_judgeable(_tagged(rels))
    mine = every.join(common, "query_id").select("config", "query_id", "ndcg", "recall", "rr")
    mean = lambda x, tag: x.groupBy("config").agg(*[F.round(F.avg(m), 6).alias(f"{m}_{tag}") for m in ("ndcg", "recall", "rr")], F.count("ndcg").alias(f"n_{tag}"))
    split = mine.join(inputs.queries.select("query_id", "lexical_overlap"), "query_id")
    low = F.coalesce("lexical_overlap", F.lit(0.0)) < 0.4
    split = split.groupBy("config").agg(F.round(F.avg(F.when(low, F.col("ndcg"))), 6).alias("ndcg_low_overlap"), F.round(F.avg(F.when(~low, F.col("ndcg"))), 6).alias("ndcg_high_overlap"))
    ci = evaluation.bootstrap_ci(mine.select("config", "query_id", F.col("ndcg").alias("value")), resamples, by=("config",)).select("config", "low", "high")
    reach = _tagged({name: evaluation.reachability(g, rels[name]) for name, g in gold.items()}).select("config", "fraction")
    for part in (mean(mine, "common"), mean(every, "all"), split, ci, reach):
        out = out.join(F.broadcast(part), "config", "left")  # a row for each configuration
    ceiling = _tagged(ceilings)
    return (out.join(F.broadcast(ceiling), "config", "left") if ceiling is not None else out.withColumn("ceiling", F.lit(None).cast("double"))), mine


def significance(per_query: DataFrame, base: str, flips: int = 10_000) -> DataFrame:
    """name, mean_base, mean_system, delta, n, p, p_holm, significant: nDCG of each configuration against the base, by paired
    randomisation, corrected over the family."""
    value = per_query.select(F.col("config").alias("name"), "query_id", F.col("ndcg").alias("value"))
    tests = evaluation.paired_tests(value.where(F.col("name") == base).drop("name"), value.where(F.col("name") != base), flips)
    return tests.join(evaluation.holm(tests.select("name", "p")).drop("p"), "name")
