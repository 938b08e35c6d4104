"""Evaluation-set construction: table facts, query synthesis, sampling, paraphrases, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import PERIOD, lexical_overlap, rewrite_problem, verdict

# Fixed values.
QUANTITY = r"^[$(\-\s]*\d[\d,]*(?:\.\d+)?[)%\s]*$"
LABEL = r"^[A-Za-z][A-Za-z0-9 ,'\-/&().]{9,90}$"
FOOTNOTE = r"(?<=[a-z\)])\s?\d{1,2}$"
HEADINGS = (
    "total", "assets", "liabilities", "total assets", "total liabilities", "current assets", "non-current assets",
    "current liabilities", "shareholders equity",
)


def table_facts(tables: DataFrame) -> DataFrame:
    """doc_id, block_id, row_label, period, value, line: the first qualifying period of each data row.

    tables: doc_id, block_id, company, rendering, caption, n_header_rows, rows array<array<string>>. The line of a row in
    its rendered block depends on the rendering: row sentences have neither header lines nor a delimiter."""
    more = [c for c in ("company", "sector") if c in tables.columns]
    x = tables.where((F.size("rows") > F.col("n_header_rows")) & (F.col("n_header_rows") > 0))
    x = x.withColumn("header", F.element_at("rows", F.col("n_header_rows")))
    x = x.select("doc_id", "block_id", *more, "rendering", "caption", "n_header_rows", "header", F.posexplode("rows").alias("i", "row")).where(F.col("i") >= F.col("n_header_rows"))
    raw = F.regexp_replace(F.trim(F.element_at("row", 1)), ":+$", "")
    x = x.withColumn("row_label", F.trim(F.regexp_replace(raw, FOOTNOTE, "")))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    mine, theirs = words(F.col("row_label")), words(F.col("company"))
    entity = (F.size(mine) > 0) & (F.size(theirs) > 0) & ((F.size(F.array_except(mine, theirs)) == 0) | (F.size(F.array_except(theirs, mine)) == 0))
    x = x.where(F.col("row_label").rlike(LABEL) & ~F.lower("row_label").isin(*HEADINGS) & ~entity)
    cells = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.size("header"), F.size("row")))),
        lambda i: F.struct(F.regexp_extract(F.get("header", i - 1), PERIOD, 0).alias("period"), F.trim(F.get("row", i - 1)).alias("value")),
    )
    good = F.filter(cells, lambda c: (c["period"] != "") & c["value"].rlike(QUANTITY))
    x = x.withColumn("fact", F.get(good, F.lit(0))).where("fact is not null")
    offset = F.col("i") - F.col("n_header_rows")
    line = F.when(F.col("rendering") == "row_sentences", F.when(F.col("caption").isNull(), 0).otherwise(0) + offset).otherwise(
        F.when(F.col("caption").isNull(), 0).otherwise(1) + F.col("n_header_rows") + 1 + offset
    )
    return x.select("doc_id", "block_id", "row_label", "fact.period", "fact.value", line.cast("int").alias("line"), *more)


# The forms that questions take in turn.
TEMPLATES = (
    "What was {company}'s {label} for {period}?",
    "How much did {company} report for {label} in {period}?",
    "In {period}, what amount did {company} record as {label}?",
    "Report {company}'s {label} figure for the {period} fiscal year.",
    "{company} {label} {period}",
)


def located(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """facts with start, end and passage: the characters of the row's line in its block. docs: doc_id, text, blocks. Facts
    of lines that are not there or have under eight characters go."""
    blocks = docs.select("doc_id", "text", F.explode("blocks").alias("b")).select("doc_id", F.col("b.block_id").alias("block_id"), F.col("b.start").alias("_a"), F.col("b.end").alias("_z"), "text")
    x = facts.join(blocks, ["doc_id", "block_id"])
    lines = F.split(F.substring("text", F.col("_a").cast("int") + 1, (F.col("_z") - F.col("_a")).cast("int")), "\n")
    x = x.withColumn("_l", lines).withColumn("passage", F.get("_l", F.col("line"))).where(F.length("passage") >= 8)
    before = F.aggregate(F.slice("_l", 1, F.col("line")), F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 1)
    x = x.withColumn("start", F.col("_a") + before)
    return x.withColumn("end", F.col("start") + F.length("passage")).drop("_a", "_z", "_l", "text")


def build_queries(facts: DataFrame, n: int = 220, per_doc: int = 40, seed: int = 42) -> DataFrame:
    """query_id, text, doc_id, passage_id, start, end, gain, kind, verification, lexical_overlap, period, expected: n
    questions about facts (of located(), with company and sector), at most per_doc of a document, evenly over sectors."""
    x = query_ids(facts).dropDuplicates(["query_id"])
    x = stratified_sample(x, "query_id", "doc_id", "sector", per_doc, n, seed)
    forms = F.array(*map(F.lit, TEMPLATES))
    text = F.element_at(forms, ((F.col("position") - 1) % len(TEMPLATES) + 1).cast("int"))
    for name, value in (("company", F.initcap("company")), ("label", F.lower("row_label")), ("period", F.col("period"))):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    span = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    x = x.withColumn("text", text)
    return x.select(
        "query_id", "text", "doc_id", span.alias("passage_id"), "start", "end", F.lit(2).alias("gain"), F.lit("table_lookup").alias("kind"),
        F.lit("generated").alias("verification"), F.round(lexical_overlap("text", "passage"), 6).alias("lexical_overlap"), "period", F.col("value").alias("expected"),
    )


def relocated(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, doc_id, start, end, gain of the queries' facts in another rendering (facts of located())."""
    return query_ids(facts).dropDuplicates(["query_id"]).join(queries.select("query_id", "gain"), "query_id").select("query_id", "doc_id", "start", "end", "gain")


def sample_queries(queries: DataFrame, n: int, pinned: list[str] = ()) -> DataFrame:
    """n queries (query_id, lexical_overlap): the pinned ones first, then evenly spaced over the others by overlap, so a
    larger sample holds the smaller one that is pinned. Adds position."""
    order = {q: i for i, q in enumerate(dict.fromkeys(pinned))}
    pins = queries.sparkSession.createDataFrame(list(order.items()), "query_id string, pin int") if order else None
    x = queries.join(F.broadcast(pins), "query_id", "left") if order else queries.withColumn("pin", F.lit(None).cast("int"))
    kept = x.where("pin is not null").withColumn("position", F.row_number().over(W.orderBy("pin"))).where(F.col("position") <= n)
    rest = n - kept.count()
    if rest <= 0:
        return kept.drop("pin")
    other = x.where("pin is null").withColumn("_o", F.coalesce("lexical_overlap", F.lit(0.0)))
    other, all_ = positions(other, ["_o", "query_id"])
    other = other.drop("_o")
    if rest < all_:
        step = all_ / rest
        other = other.where(F.col("_i").isin([min(all_ - 1, int(i * step)) for i in range(rest)]))
    other = other.withColumn("position", F.lit(n - rest) + F.row_number().over(W.orderBy("_i"))).drop("_i")
    return kept.unionByName(other).drop("pin")


def query_ids(facts: DataFrame) -> DataFrame:
    return facts.withColumn("query_id", F.concat(F.lit("q-"), F.substring(F.sha2(F.concat_ws("|", "doc_id", "row_label", "period"), 256), 1, 12)))


def stratified_sample(rows: DataFrame, key: str, group: str, stratum: str, cap: int, n: int, seed: int = 42) -> DataFrame:
    """At most `cap` rows per group, then round-robin over strata to n, in hashed order. Adds position."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    x = rows.withColumn("_h", h).withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy("_h", key))).where(F.col("_g") <= cap)
    x = x.withColumn("_s", F.row_number().over(W.partitionBy(stratum).orderBy("_h", key))).where(F.col("_s") <= n)
    x = x.withColumn("position", F.row_number().over(W.orderBy("_s", stratum))).where(F.col("position") <= n)
    return x.drop("_h", "_g", "_s")


def positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with _i, their place from 0 in the order, and how many there are. Ranges of the order are numbered each in
    its own task, after the sizes of the ranges before (a row each) are added up."""
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).persist()
    sizes = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())
    heads, total = [], 0
    for p, n in sizes:
        heads.append((p, total))
        total += n
    heads = rows.sparkSession.createDataFrame(heads, "_p int, _head long")
    x = ranged.join(F.broadcast(heads), "_p")
    return x.withColumn("_i", F.col("_head") + F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1).drop("_p", "_head"), total


def spaced_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows evenly spaced over the order."""
    x, total = positions(rows, order)
    step = max(1, total // n)
    return x.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < n)).drop("_i")


def merge_preserving(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows as they are, and new ids."""
    return existing.unionByName(new.join(existing.select("query_id"), "query_id", "left_anti"))


def apply_paraphrases(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """queries: query_id, text, company, period, passage; rewrites: query_id, rewritten."""
    x = queries.join(rewrites, "query_id", "left").withColumn("problem", rewrite_problem("rewritten", "company", "period"))
    kept = F.col("problem").isNull()
    text = F.when(kept, F.col("rewritten")).otherwise(F.col("text"))
    return x.select("query_id", text.alias("text"), "problem", F.round(lexical_overlap("text", "passage"), 6).alias("overlap_before"), F.when(kept, F.round(lexical_overlap("rewritten", "passage"), 6)).alias("overlap_after"))


def apply_verdicts(queries: DataFrame, replies: DataFrame) -> DataFrame:
    """verification after the judge's replies; human_verified and rejected are never overwritten."""
    x = queries.join(replies.select("query_id", verdict("reply").alias("v")), "query_id", "left")
    fixed = F.col("verification").isin("human_verified", "rejected")
    new = F.when(fixed | F.col("v").isNull(), F.col("verification")).when(F.col("v") == "OK", "model_checked").otherwise("rejected")
    return x.withColumn("verification", new).drop("v")


def ambiguous(queries: DataFrame) -> DataFrame:
    """query_ids that share a text but not its passage."""
    bad = queries.groupBy("text").agg(F.min("passage_id").alias("a"), F.max("passage_id").alias("b")).where("a <> b").select("text")
    return queries.join(bad, "text", "left_semi").select("query_id")


def summarise(queries: DataFrame) -> DataFrame:
    return queries.groupBy("kind", "verification").agg(F.count("*").alias("n"), F.round(F.avg("lexical_overlap"), 6).alias("overlap"), F.count_distinct("doc_id").alias("docs"))
