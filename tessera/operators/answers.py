"""Prompts, citations and scoring of generated answers. NULL is not applicable, never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import citations, contains_value, refused


def prompts(contexts: DataFrame) -> DataFrame:
    """query_id, prompt: passages (array<string>) numbered from 1, and the question."""
    body = F.array_join(F.transform("passages", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")
    return contexts.select("query_id", F.concat(body, F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


def cited(answers: DataFrame) -> DataFrame:
    """answers with cited_ids and invalid_citations, from answer and context_ids."""
    c = citations("answer")
    ok = F.filter(c, lambda n: (n >= 1) & (n <= F.size("context_ids")))
    return answers.withColumns({
        "cited_ids": F.transform(ok, lambda n: F.get("context_ids", n - 1)),
        "invalid_citations": F.filter(c, lambda n: (n < 1) | (n > F.size("context_ids"))),
    })


def score(answers: DataFrame) -> DataFrame:
    """answers: query_id, arm, answer, context_ids, expected, gold_ids (null: unknown)."""
    x = cited(answers).withColumn("refused", refused("answer"))
    n, gold = F.size("cited_ids"), F.col("gold_ids")
    good = F.size(F.array_intersect("cited_ids", gold))
    known = ~F.col("refused") & gold.isNotNull()
    return x.select(
        "query_id", "arm", "refused",
        F.when(~F.col("refused") & F.col("expected").isNotNull(), contains_value("answer", "expected")).alias("value_correct"),
        F.when(known & (n > 0), good / n).when(known & (F.size(gold) > 0), 0.0).alias("citation_precision"),
        F.when(known & (F.size(gold) > 0), good > 0).alias("citation_recall"),
        (F.size("invalid_citations") > 0).alias("cited_a_hallucinated_passage"),
    )


def faithfulness(reply: str):
    """1, 0.5 or 0 for the first of supported, partial, unsupported; else null."""
    word = F.regexp_extract(F.lower(F.col(reply)), r"\b(supported|partial|unsupported)\b", 1)
    return F.when(word == "supported", 1.0).when(word == "partial", 0.5).when(word == "unsupported", 0.0)


def by_arm(scores: DataFrame) -> DataFrame:
    right = F.count_if(F.col("value_correct"))
    return scores.groupBy("arm").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("refused").cast("double")), 6).alias("refusal_rate"),
        F.round(right / F.nullif(F.count("value_correct"), F.lit(0)), 6).alias("accuracy_answered"),
        F.round(right / F.count("*"), 6).alias("accuracy_all"),
        F.round(F.avg("citation_precision"), 6).alias("citation_precision"),
        F.round(F.avg(F.col("citation_recall").cast("double")), 6).alias("citation_recall"),
    )


def token_cost(answers: DataFrame, prompt_price: float, output_price: float) -> DataFrame:
    cost = (F.sum("prompt_tokens") * prompt_price + F.sum("output_tokens") * output_price) / 1e6
    return answers.groupBy("arm").agg(F.count("*").alias("n"), F.round(cost, 6).alias("cost"), F.round(cost / F.count("*"), 8).alias("cost_per_query"), F.round(F.avg("prompt_tokens"), 1).alias("mean_prompt_tokens"))


def latency(answers: DataFrame) -> DataFrame:
    """Index-form percentiles of live answers; null where an arm has none. An arm's live calls are few by nature."""
    live = F.sort_array(F.collect_list(F.when(~F.col("from_cache"), F.col("latency_seconds"))))
    x = answers.groupBy("arm").agg(live.alias("l"))
    at = lambda i: F.when(F.size("l") > 0, F.get("l", i.cast("int")))
    n = F.size("l")
    return x.select("arm", n.alias("n_live"), at(F.floor(n / 2)).alias("p50"), at(F.least(n - 1, F.floor(n * 0.95))).alias("p95"))


def compare_arms(costs: DataFrame, times: DataFrame, base: str, other: str) -> DataFrame:
    """Cost and latency of `other` over `base`; the latency ratio only where both are measured."""
    x = costs.join(times, "arm")
    one = lambda arm, tag: x.where(F.col("arm") == arm).select(F.col("cost_per_query").alias(f"c{tag}"), F.col("p95").alias(f"p{tag}"))
    both = one(base, 0).crossJoin(one(other, 1))  # a row each
    ratio = F.round(F.col("p1") / F.col("p0"), 1)
    return both.select(F.round(F.col("c1") / F.col("c0"), 1).alias("cost_ratio"), ratio.alias("latency_ratio"), F.when(ratio.isNull(), "an arm has no live latency").alias("reason"))


def resolve_context(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, passages in order; null if any id is unknown."""
    x = answers.select("query_id", F.posexplode("context_ids").alias("i", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    x = x.groupBy("query_id").agg(F.bool_and(F.col("text").isNotNull()).alias("ok"), F.sort_array(F.collect_list(F.struct("i", "text"))).alias("p"))
    return x.select("query_id", F.when(F.col("ok"), F.transform("p", lambda s: s["text"])).alias("passages"))


def stuff_document(docs: DataFrame, most: int = 800_000) -> DataFrame:
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("#fulldoc")).alias("chunk_id"), "doc_id", F.substring("text", 1, most).alias("text"))


def value_accuracy(scores: DataFrame, resamples: int = 10_000) -> DataFrame:
    """arm, point, n, low, high of value_correct, where it applies."""
    from tessera.operators.evaluation import bootstrap_ci

    return bootstrap_ci(scores.select("arm", "query_id", F.col("value_correct").cast("double").alias("value")), resamples, by=("arm",))
