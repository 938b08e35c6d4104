"""Relevance by span coverage, ranking metrics and statistics. NULL means not measured, never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import contains_value, span_coverage


def gold_spans(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Where each passage (query_id, text) first stands in a document: query_id, passage_id, doc_id, start, end, gain.

    Passages meet only documents that hold one of their five-word shingles, not all documents."""
    words = lambda t: F.split(t, " ")
    n = F.size("w")
    five = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.array_join(F.slice("w", i, 5), " ")))
    # A passage's inner shingle has whole words on both sides, so the document has it among its own.
    key = F.array_join(F.slice("w", 2, 5), " ")
    p = passages.select("query_id", F.col("text").alias("passage"), words(F.col("text")).alias("w"))
    near = p.where(n >= 7).select("query_id", "passage", key.alias("key"))
    d = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(five)).alias("key"))
    met = d.join(near, "key").select("query_id", "passage", "doc_id").distinct()
    few = p.where(n < 7).select("query_id", "passage")
    out = met.join(docs.select("doc_id", "text"), "doc_id")
    short = docs.select("doc_id", "text").join(few, F.expr("instr(text, passage) > 0"))
    out = out.select("query_id", "passage", "doc_id", "text").unionByName(short.select("query_id", "passage", "doc_id", "text"))
    at = F.expr("instr(text, passage)").cast("long")
    out = out.withColumn("start", at - 1).where("start >= 0").withColumn("end", F.col("start") + F.length("passage"))
    return out.select("query_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end")).alias("passage_id"), "doc_id", "start", "end", F.lit(2).alias("gain"))


def qrels(chunks: DataFrame, gold: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """query_id, chunk_id, gain: the largest gain of the gold spans that a chunk covers well enough."""
    if not 0 < min_coverage <= 1:
        raise ValueError("min_coverage must be in (0, 1]")
    c = chunks.select("chunk_id", "doc_id", F.col("start").alias("cs"), F.col("end").alias("ce"))
    x = c.join(gold, "doc_id").where(span_coverage("cs", "ce", "start", "end") >= min_coverage)
    return x.groupBy("query_id", "chunk_id").agg(F.max("gain").alias("gain"))


def coverage_sweep(chunks: DataFrame, gold: DataFrame, thresholds=(0.3, 0.5, 0.7, 1.0)) -> DataFrame:
    c = chunks.select("chunk_id", "doc_id", F.col("start").alias("cs"), F.col("end").alias("ce"))
    best = c.join(gold, "doc_id").withColumn("cov", span_coverage("cs", "ce", "start", "end")).groupBy("query_id").agg(F.max("cov").alias("cov"))
    each = best.select("cov", F.explode(F.array(*map(F.lit, thresholds))).alias("min_coverage"))
    return each.groupBy("min_coverage").agg(F.count_if(F.col("cov") >= F.col("min_coverage")).alias("reachable"), F.count("*").alias("n_gold"))


def reachability(gold: DataFrame, rels: DataFrame) -> DataFrame:
    """n_gold, n_reachable, fraction (0 without gold) over queries."""
    q = gold.select("query_id").distinct().join(rels.where("gain > 0").select("query_id", F.lit(1).alias("r")).distinct(), "query_id", "left")
    n, r = F.count("*"), F.count("r")
    return q.agg(n.alias("n_gold"), r.alias("n_reachable"), F.when(n > 0, r / n).otherwise(0.0).alias("fraction"))


def common_judgeable(rels: DataFrame) -> DataFrame:
    """Queries with a relevant chunk under every config of rels (config, query_id, chunk_id, gain)."""
    has = rels.where("gain > 0").select("config", "query_id").distinct()
    per = has.groupBy("query_id").agg(F.count("*").alias("c"))
    return per.join(F.broadcast(rels.select("config").distinct().agg(F.count("*").alias("all"))), F.col("c") == F.col("all")).select("query_id")


def lenient_qrels(strict: DataFrame, chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """strict, and gain 1 for other chunks of the gold document (expected: query_id, doc_id, value) that hold the value."""
    more = chunks.join(expected, "doc_id").where(contains_value("text", "value")).select("query_id", "chunk_id").distinct()
    more = more.join(strict, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.lit(1).alias("gain"))
    return strict.select("query_id", "chunk_id", "gain").unionByName(more)


def unjudged(run: DataFrame, strict: DataFrame, chunks: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Hits that hold the value but are no gold: affected queries, hits, and queries that score zero for it."""
    hits = run.where(F.col("rank") <= k).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(expected, ["query_id", "doc_id"])
    hits = hits.where(contains_value("text", "value")).join(strict, ["query_id", "chunk_id"], "left_anti")
    per = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    good = run.where(F.col("rank") <= k).join(strict.where("gain > 0"), ["query_id", "chunk_id"], "left_semi").select("query_id").distinct()
    per = per.join(good.withColumn("good", F.lit(1)), "query_id", "left")
    return per.agg(F.count("*").alias("affected"), F.coalesce(F.sum("hits"), F.lit(0)).alias("unjudged_hits"), F.count_if(F.col("good").isNull()).alias("false_zeros"))


def validated(run: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """run and rels again; reading fails on a chunk twice in a ranking and on a negative gain."""
    bad = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("ranking holds a chunk twice: "), F.col("chunk_id").cast("string"))).cast("boolean")).otherwise(False)
    n = F.count("*").over(W.partitionBy("query_id", "chunk_id"))
    low = F.when(F.col("gain") < 0, F.raise_error(F.lit("relevance gains must be non-negative")).cast("boolean")).otherwise(False)
    return run.withColumn("_n", n).where(~bad).drop("_n"), rels.where(~low)


def per_query(run: DataFrame, rels: DataFrame, queries: DataFrame, k: int = 10, recall_k: int = 50, rr_k: int | None = None) -> DataFrame:
    """query_id, ndcg, recall, rr; NULL where a query has nothing relevant, 0 where nothing relevant is retrieved."""
    power = F.pow(F.lit(2.0), F.col("gain")) - 1
    ideal = rels.where("gain > 0").withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain"), "chunk_id")))
    ideal = ideal.groupBy("query_id").agg(
        F.sum(F.when(F.col("i") <= k, power / F.log2(F.col("i") + 1))).alias("idcg"), F.count("*").alias("relevant")
    )
    hit = run.join(rels.where("gain > 0"), ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, power / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count_if(F.col("rank") <= recall_k).alias("found"),
        F.min(F.when(F.lit(True) if rr_k is None else F.col("rank") <= rr_k, F.col("rank"))).alias("first"),
    )
    x = queries.select("query_id").distinct().join(ideal, "query_id", "left").join(hit, "query_id", "left")
    judged = F.col("relevant").isNotNull()
    return x.select(
        "query_id",
        F.when(judged, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 9)).alias("ndcg"),
        F.when(judged, F.round(F.coalesce("found", F.lit(0)) / F.col("relevant"), 9)).alias("recall"),
        F.when(judged, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9)).alias("rr"),
    )


def summary(scores: DataFrame) -> DataFrame:
    """name, value (NULL if nothing is scored), n_scored, n_skipped for each metric."""
    long = scores.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in ("ndcg", "recall", "rr")])))
    return long.groupBy("name").agg(F.round(F.avg("v"), 6).alias("value"), F.count("v").alias("n_scored"), (F.count("*") - F.count("v")).alias("n_skipped"))


def overlap_split(scores: DataFrame, overlap: DataFrame, at: float = 0.4) -> DataFrame:
    x = scores.join(overlap, "query_id")
    return x.agg(F.round(F.avg(F.when(F.col("overlap") < at, F.col("ndcg"))), 6).alias("low"), F.round(F.avg(F.when(F.col("overlap") >= at, F.col("ndcg"))), 6).alias("high"))


def _draw(*parts):
    """A portable uniform integer of 60 bits, by hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def bootstrap_ci(values: DataFrame, resamples: int = 10_000, seed: int = 42, level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """point, low, high, n of the mean of `value`, by percentile bootstrap, for each group of the columns `by`. The
    values are one per query; NULL ones are not measured and do not count."""
    v = values.where("value is not null").select(*by, "query_id", "value")
    v = v.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("query_id")) - 1).withColumn("n", F.count("*").over(W.partitionBy(*by)))
    draws = v.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    pick = draws.select(*by, "b", (_draw(F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string")) % F.col("n")).alias("j"))
    means = pick.join(v.select(*by, F.col("i").alias("j"), "value"), [*by, "j"]).groupBy(*by, "b").agg(F.avg("value").alias("m"))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    ci = means.groupBy(*by).agg(F.round(F.percentile("m", F.lit(lo)), 9).alias("low"), F.round(F.percentile("m", F.lit(hi)), 9).alias("high"))
    point = v.groupBy(*by).agg(F.round(F.avg("value"), 9).alias("point"), F.count("*").alias("n"))
    return point.join(ci, list(by)) if by else point.crossJoin(ci)


def paired_tests(base: DataFrame, systems: DataFrame, flips: int = 10_000, seed: int = 42) -> DataFrame:
    """Two-sided paired randomisation tests of systems (name, query_id, value) against base (query_id, value), each over
    the queries both have measured: name, mean_base, mean_system, delta, p, n."""
    x = systems.select("name", "query_id", F.col("value").alias("b")).join(base.select("query_id", F.col("value").alias("a")), "query_id")
    x = x.where("a is not null and b is not null").withColumn("d", F.col("b") - F.col("a"))
    sign = F.when(_draw(F.lit(str(seed)), F.col("f").cast("string"), F.col("query_id").cast("string")) % 2 == 0, 1.0).otherwise(-1.0)
    each = x.select("name", "query_id", "d", F.explode(F.sequence(F.lit(0), F.lit(flips - 1))).alias("f"))
    sums = each.groupBy("name", "f").agg(F.round(F.abs(F.avg(sign * F.col("d"))), 9).alias("s"))
    seen = x.groupBy("name").agg(F.round(F.avg("a"), 9).alias("mean_base"), F.round(F.avg("b"), 9).alias("mean_system"), F.round(F.avg("d"), 9).alias("delta"), F.count("*").alias("n"))
    p = sums.join(F.broadcast(seen.select("name", "delta")), "name").groupBy("name")  # a row for each system
    p = p.agg(((F.count_if(F.col("s") >= F.abs("delta")) + 1) / F.lit(flips + 1.0)).alias("p"))
    return seen.join(p, "name")


def paired_test(base: DataFrame, system: DataFrame, flips: int = 10_000, seed: int = 42) -> DataFrame:
    """paired_tests() of one system: mean_base, mean_system, delta, n, p."""
    return paired_tests(base, system.select(F.lit("system").alias("name"), "query_id", "value"), flips, seed).drop("name")


def holm(tests: DataFrame) -> DataFrame:
    """tests (name, p): adds p_holm and significant (below 0.05)."""
    order = W.orderBy("p", "name")
    x = tests.withColumns({"r": F.row_number().over(order), "m": F.count("*").over(W.partitionBy())})
    x = x.withColumn("adj", F.least(F.lit(1.0), (F.col("m") - F.col("r") + 1) * F.col("p")))
    x = x.withColumn("p_holm", F.round(F.max("adj").over(order.rowsBetween(W.unboundedPreceding, 0)), 9))
    return x.select("name", "p", "p_holm", (F.col("p_holm") < 0.05).alias("significant"))
