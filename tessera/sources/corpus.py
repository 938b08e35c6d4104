"""Corpus sources and sinks: filings, manifests, verified loads, artifacts aligned by id and by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_queries(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON Lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name without its ending), html, of pre-fetched documents."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("doc_id"), F.col("content").alias("html"))


def filing_rows(pages: DataFrame, form: str = "10-K") -> DataFrame:
    """Columnar submissions (parallel arrays) to rows: the exact form, HTML documents only."""
    cols = ["form", "accession", "report_date", "filing_date", "document"]
    x = pages.select("cik", "ticker", F.inline(F.arrays_zip(*cols)))
    return x.where((F.col("form") == form) & F.lower("document").rlike(r"\.html?$"))


def latest_filings(rows: DataFrame, n: int) -> DataFrame:
    """The latest n per ticker, one per report date (the latest filed), oldest first; doc_id is ticker-form-date."""
    one = W.partitionBy("ticker", "report_date").orderBy(F.desc("filing_date"), F.desc("accession"))
    x = rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    last = W.partitionBy("ticker").orderBy(F.desc("filing_date"), F.desc("accession"))
    x = x.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")
    return x.withColumn("doc_id", F.lower(F.concat_ws("-", "ticker", "form", "report_date")))


def gaps(expected: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Tickers with fewer than n filings."""
    x = expected.join(found.groupBy("ticker").agg(F.count("*").alias("c")), "ticker", "left")
    return x.select("ticker", F.coalesce("c", F.lit(0)).alias("found")).where(F.col("found") < n)


def manifest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"), F.coalesce("source", F.lit("")).alias("source"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of added, removed, changed and unchanged documents between two manifests."""
    o, n = old.select("doc_id", F.col("sha256").alias("a")), new.select("doc_id", F.col("sha256").alias("b"))
    x = o.join(n, "doc_id", "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return x.groupBy(kind.alias("state")).agg(F.count("*").alias("n"))


def verified(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's documents; reading fails on a missing document or another digest."""
    x = manifest.select("doc_id", "sha256").join(docs.withColumn("_here", F.lit(True)), "doc_id", "left")
    bad = F.col("_here").isNull() | ~F.sha2("text", 256).eqNullSafe(F.col("sha256"))  # a text may be null in both
    return x.where(~F.when(bad, F.raise_error(F.concat(F.lit("document missing or changed: "), F.col("doc_id").cast("string"))).cast("boolean")).otherwise(False)).drop("sha256", "_here")


def align_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """matched, missing (chunks without a vector), unmatched (vectors without a chunk), coverage: by id."""
    x = chunks.select("chunk_id", F.lit(1).alias("c")).join(vectors.select("chunk_id", F.lit(1).alias("v")), "chunk_id", "full_outer")
    m = F.count_if(F.col("c").isNotNull() & F.col("v").isNotNull())
    return x.agg(m.alias("matched"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("unmatched"), F.when(F.count("c") > 0, m / F.count("c")).otherwise(0.0).alias("coverage"))


def best_artifact(artifacts: DataFrame, queries: DataFrame) -> DataFrame:
    """artifact, covered: the artifact whose recorded texts match most queries; the first name wins ties."""
    x = artifacts.join(queries.select("query_id", F.col("text").alias("query_text")), ["query_id", "query_text"])
    return x.groupBy("artifact").agg(F.count("*").alias("covered")).orderBy(F.desc("covered"), "artifact").limit(1)


def usage(calls: DataFrame) -> DataFrame:
    """calls, cached, tokens and the index-form p95 of live latency (null without live calls)."""
    n = F.count_if(~F.col("from_cache"))
    live = F.sort_array(F.collect_list(F.when(~F.col("from_cache"), F.col("latency_seconds"))))
    p95 = F.when(n > 0, F.get(live, F.least(n - 1, F.floor(n * 0.95)).cast("int")))
    return calls.agg(F.count("*").alias("calls"), F.count_if(F.col("from_cache")).alias("cached"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), p95.alias("p95"))


def publishable(old: DataFrame, new: DataFrame) -> DataFrame:
    """Arms (arm, scored) whose counts would fall; publish only if there are none."""
    x = old.join(new.withColumnRenamed("scored", "now"), "arm", "left")
    return x.select("arm", "scored", F.coalesce("now", F.lit(0)).alias("now")).where("now < scored")
