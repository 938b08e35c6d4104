"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Each source is one stream of words: its documents in hashed order, cut into equal blocks of 32 words
or more, of which there are at most about 2**20 whatever the input (so tables of blocks are bounded). The sources' targets (a capped share of the whole) get blocks by highest Sainte-Lague quotients v / (2 s + 1);
each source's blocks then go to its shards (runs of `run` blocks) by the same rule, which gives an integer
quota per shard, and a seeded order within the shard selects the blocks. No block is taken more than
`most` times, so no document exceeds `most` times its size. A document's taken words are those of its blocks.
A source's words come within three blocks of its target: one seat by apportionment, and its last block, which
may be short, up to twice.

Streams are positioned by two running sums, over hashed buckets of a source and within a bucket, so a hot
source is spread over tasks. The tables that one task orders have a row per source.

Edge cases: null text counts as empty (size 0, taken 0); a null source is a source, after all others; null
ids and repeated rows take part (ties broken by size and row); an empty table gives an empty result; other columns
are ignored by mix() and passed on by take().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import free_name, materialise

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from source, source_size: water filling under caps of most * source_size.

    With sources by cap / weight, the level at which the shares add up lies where the running sums say, so
    no reshare is iterated. Spark orders strings by UTF-8 bytes, which is code-point order."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    x = x.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    level = F.when((F.col("capped") + F.col("ratio") * F.col("open")) >= F.col("total"), (F.col("total") - F.col("capped")) / F.col("open"))
    first = F.min(F.when(level.isNotNull(), F.struct("ratio", (-level).alias("below")))).over(everything)
    x = x.withColumn("level", -first["below"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return x.select("source", "source_size", target.alias("target"))


def sainte_lague(votes: DataFrame, seats: str, group: list[str], limit: str | None = None) -> DataFrame:
    """votes (group..., party columns, `votes` double, `seats` of the group): adds `won`, the seats by highest quotients.

    Rounded shares of the seats differ from the apportionment by no more than half the number of parties in
    proportion to the votes, so only the quotients about them are ranked."""
    w = W.partitionBy(*group)
    x = votes.withColumns({"_all": F.sum("votes").over(w), "_parties": F.count("*").over(w)})
    part = F.when(F.col("_all") > 0, F.col("votes") / F.col("_all")).otherwise(0.0)
    x = x.withColumn("_near", F.floor(part * F.col(seats) + 0.5)).withColumn("_slack", F.ceil(part * F.col("_parties")) + 2)
    x = x.withColumn("_low", F.greatest(F.lit(0), F.col("_near") - F.col("_slack")).cast("long"))
    x = x.withColumn("_open", F.col(seats) - F.sum("_low").over(w))
    tried = x.select("*", F.explode(F.sequence(F.col("_low"), (F.col("_near") + F.col("_slack")).cast("long"))).alias("_s"))
    keys = [c for c in votes.columns if c not in ("votes", seats)]
    quotient = F.col("votes") / (2 * F.col("_s") + 1)
    ranked = tried.withColumn("_rank", F.row_number().over(w.orderBy(quotient.desc(), *[F.col(k).asc_nulls_last() for k in keys], "_s")))
    return ranked.groupBy(*keys).agg((F.min("_low") + F.sum(((F.col("_rank") <= F.col("_open")) & (F.col("votes") > 0)).cast("long"))).alias("won"))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))


def place(docs: DataFrame, seed: int, rows_a_bucket: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): rows uid, doc_id, source, size, at - `at` is the row's first word in its source's stream -
    and source, source_size."""
    buckets = max(1, -(-docs.count() // rows_a_bucket))
    x = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    x = x.withColumn("key", _hash(F.lit(seed), F.col("doc_id")))
    # Buckets are ranges of the key, so the stream's order is that of the key.
    x = x.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int"))
    x = materialise(x, "mix-rows")  # fixes uid as well
    sums = materialise(x.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    head = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("words").over(head), F.lit(0)).alias("head"))
    inner = W.partitionBy("source", "bucket").orderBy("key", "size", "uid").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    x = x.join(heads, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    return x.select("uid", "doc_id", "source", "size", (F.col("head") + F.col("within")).alias("at")), sizes


def mix_rows(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42, resolution: int = 1 << 20, least: int = 32, run: int = 1024
) -> DataFrame:
    """uid, doc_id, source, size, source_size, target, passes (times the whole row is taken), spans (its further
    words, array<struct<first, n>>) and taken. A block has at least `least` words (fewer only where all sources
    together have few) and there are at most about `resolution` of them; run: blocks in a shard."""
    rows, sizes = place(docs, seed)
    goal = materialise(targets(sizes, weights, share, most), "mix-targets")
    total = goal.agg(F.sum("source_size"), F.sum("target")).first()
    words = total[0] or 0
    block = max(1, min(least, -(-words // 4096)), -(-words // resolution))
    seats = round((total[1] or 0) / block)

    blocks = F.ceil(F.col("source_size") / block).cast("long")
    won = sainte_lague(goal.select("source", F.col("target").alias("votes"), F.lit(seats).alias("seats")), "seats", [])
    plan = goal.withColumn("blocks", blocks).join(won.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.withColumn("won", F.least("won", F.col("blocks") * int(most)))
    plan = plan.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("won") / F.col("blocks"))).otherwise(0))
    plan = materialise(plan.withColumn("extra", F.col("won") - F.col("passes") * F.col("blocks")), "mix-plan")

    shards = plan.where("extra > 0").select("source", "extra", "blocks", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / run))).alias("shard"))
    shards = shards.withColumn("votes", F.least(F.lit(run), F.col("blocks") - F.col("shard") * run).cast("double"))
    quota = sainte_lague(shards.select("source", "shard", "votes", "extra"), "extra", ["source"]).where("won > 0")
    quota = quota.withColumnRenamed("source", "_s").join(plan.select("source", "blocks"), F.col("_s").eqNullSafe(F.col("source")))
    last = F.least((F.col("shard") + 1) * run, F.col("blocks")) - 1
    inside = quota.select("source", "shard", "won", F.explode(F.sequence(F.col("shard") * run, last)).alias("block"))
    order = W.partitionBy("source", "shard").orderBy(_hash(F.lit(seed), F.col("source"), F.col("block")), "block")
    chosen = inside.withColumn("rank", F.row_number().over(order)).where("rank <= won").select(F.col("source").alias("_source"), F.col("block").alias("_block"))

    end = F.col("at") + F.col("size")
    first = F.floor(F.col("at") / block)
    each = rows.withColumn("block", F.explode(F.sequence(first, F.greatest(first, F.floor((end - 1) / block)))))
    each = each.join(chosen, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    start = F.greatest(F.col("block") * block, F.col("at"))
    n = F.when(F.col("_block").isNotNull(), F.least((F.col("block") + 1) * block, end) - start)
    span = F.when(n > 0, F.struct((start - F.col("at")).alias("first"), n.alias("n")))
    spans = each.groupBy("uid", "doc_id", "source", "size").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "passes")
    out = spans.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, F.col("source").eqNullSafe(F.col("_source")))
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return out.withColumn("taken", F.col("passes") * F.col("size") + extra).drop("_source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs."""
    return mix_rows(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, with the taken words as text (whole passes, then the further words)
    and n_chars, where there is one, counted anew. Rows of which nothing is taken go."""
    key, passes, spans = (free_name(docs.columns, c) for c in ("_row", "_passes", "_spans"))
    held = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "mix-docs")
    plan = mix_rows(held.select(F.col(key).alias("doc_id"), "source", "text"), **options)
    plan = plan.where("taken > 0").select(F.col("doc_id").alias(key), F.col("passes").alias(passes), F.col("spans").alias(spans))
    words = F.when(F.size(spans) > 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)))
    cut = lambda w, s: F.array_join(F.slice(w, (s["first"] + 1).cast("int"), s["n"].cast("int")), "")
    # The words are a lambda's variable, so they are found once a row and not once a span.
    cuts = F.element_at(F.transform(F.array(words), lambda w: F.transform(F.col(spans), lambda s: cut(w, s))), 1)
    parts = F.concat(F.array_repeat(F.col("text"), F.col(passes).cast("int")), F.coalesce(F.when(F.size(spans) > 0, cuts), F.array().cast("array<string>")))
    x = held.join(plan, key).withColumn("text", F.array_join(parts, "\n"))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return x.select(*docs.columns)


def op9_sainte_lague_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
