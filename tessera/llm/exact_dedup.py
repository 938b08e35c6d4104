"""Exact deduplication with a log-structured merge index over text digests.

Level 0: every task keeps a memtable of digests; when it is full it is flushed as a run sorted by digest
(digest, best id, rows with that id, rows). Compaction brings the runs of a digest range together, merges
the sorted runs and keeps one identifier per digest - the smallest, or the largest with keep="largest".
A filter over the digests that occur more than once, one bitmap block per digest range, of 128 bits a digest or more up to
2**27 bits in all (16 MB, so what is broadcast is bounded), tells most rows that they are alone, without a shuffle of
their text; the rest look their digest up in the compacted level and every hit is compared byte for byte with the
text that stays. Beyond some millions of repeated digests more rows pass the filter, at the cost of shuffling them.
Should different texts share a digest, all rows of that digest are grouped by their whole texts instead.

Edge cases: null text counts as empty; ids are of any ordered type, and a null id is smaller than all others; of
repeated rows with the id that stays exactly one is kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import lean, materialise, partitions

MOST_BITS = 27


def _run_schema(ids: DataFrame) -> str:
    return f"digest binary, best {ids.schema.fields[1].dataType.simpleString()}, n_best bigint, n bigint"


def _fold(table: pa.Table, largest: bool) -> pa.Table:
    """One row per digest of a table sorted by digest and then id, the wanted id first."""
    import numpy as np

    if not table.num_rows:
        return table
    digest = table.column("digest").combine_chunks()
    new = np.ones(table.num_rows, bool)
    new[1:] = pc.not_equal(digest.slice(1), digest.slice(0, len(digest) - 1)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    best = table.column("best").combine_chunks()
    n_best, n = (table.column(c).to_numpy() for c in ("n_best", "n"))
    first = best.take(pa.array(np.repeat(at, np.diff([*at, len(new)]))))
    same = pc.or_(pc.fill_null(pc.equal(best, first), False), pc.and_(pc.is_null(best), pc.is_null(first))).to_numpy(zero_copy_only=False)
    return pa.table({
        "digest": digest.take(pa.array(at)),
        "best": best.take(pa.array(at)),
        "n_best": np.add.reduceat(np.where(same, n_best, 0), at),
        "n": np.add.reduceat(n, at),
    })


def _sorted(table: pa.Table, largest: bool) -> pa.Table:
    keys = [("digest", "ascending"), ("best", "descending" if largest else "ascending")]
    return _fold(table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end" if largest else "at_start")), largest)


def flush_runs(rows: DataFrame, memtable: int, largest: bool) -> DataFrame:
    """Level 0: sorted runs of at most `memtable` entries each, from rows (digest, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for b in batches:
            one = pa.array([1] * b.num_rows, pa.int64())
            held.append(pa.table({"digest": b.column(0), "best": b.column(1), "n_best": one, "n": one}))
            count += b.num_rows
            if count >= memtable:
                table = _sorted(pa.concat_tables(held), largest)
                held, count = [table], table.num_rows
                if count > memtable // 2:  # few repeats: the memtable is full
                    yield from table.to_batches()
                    held, count = [], 0
        if held:
            yield from _sorted(pa.concat_tables(held), largest).to_batches()

    return rows.mapInArrow(lean(run), _run_schema(rows))


def compact(runs: DataFrame, largest: bool) -> DataFrame:
    """Level 1: one entry per digest. Tasks own digest ranges and merge their sorted runs as a stream."""
    order = F.col("best").desc() if largest else F.col("best").asc()
    dealt = runs.repartition(partitions(runs.sparkSession), F.xxhash64("digest")).sortWithinPartitions("digest", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]).select(["digest", "best", "n_best", "n"])
            table = _fold(table if tail is None else pa.concat_tables([tail, table]).combine_chunks(), largest)
            tail = table.slice(table.num_rows - 1)
            yield from table.slice(0, table.num_rows - 1).to_batches()
        if tail is not None:
            yield from tail.to_batches()

    return dealt.mapInArrow(lean(run), _run_schema(runs))


def _bit(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(1 << bits))


def repeats_filter(level: DataFrame, bits: int) -> DataFrame:
    """(block, bitmap): at most 2**bits / 32768 rows of 4 kB, whatever the input."""
    at = _bit(F.col("digest"), bits)
    return level.where("n > 1").groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def dedup(
    docs: DataFrame,
    keep: str = "smallest",
    digest: Column | None = None,
    memtable: int = 200_000,
    filter_bits: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_bytes and the columns `carry`; one row for each row of docs.

    digest: another digest of the column `text` than SHA-256, as binary (tests force collisions with it)."""
    largest = keep == "largest"
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    sha = F.sha2("text", 256)
    rows = raw.select("doc_id", "text", *carry, (F.unhex(sha) if digest is None else digest).alias("digest"))

    runs = flush_runs(rows.select("digest", "doc_id"), memtable, largest)
    level = materialise(compact(runs, largest), "lsm-level")
    if filter_bits is None:
        filter_bits = min(MOST_BITS, max(15, (128 * level.where("n > 1").count()).bit_length()))
    seen = materialise(repeats_filter(level, filter_bits), "lsm-filter")

    at = _bit(F.col("digest"), filter_bits)
    word = F.conv(F.hex(F.expr("substring(bitmap, int(pos div 8) + 1, 1)")), 16, 10).cast("int")
    tested = (
        rows.withColumns({"block": F.bitmap_bucket_number(at), "pos": F.bitmap_bit_position(at).cast("long")})
        .join(F.broadcast(seen), "block", "left")
        .withColumn("hit", F.coalesce(word.bitwiseAND(F.expr("shiftleft(1, int(pos % 8))")) != 0, F.lit(False)))
    )
    alone = tested.where("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256"), F.octet_length("text").cast("long").alias("text_bytes"), *carry)

    # The keeper's text is fetched by (digest, id), which no hot group shares; then one join on the digest, whose
    # large side Spark can split. False positives of the filter find no keeper and need no comparison.
    hits = tested.where("hit").select("doc_id", "text", "digest", *carry)
    known = level.where("n > 1").withColumnRenamed("digest", "_digest")
    stays = hits.select("doc_id", "text", "digest").join(known, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("best")))
    stays = stays.select("digest", "best", "n_best", "n", F.col("text").alias("other"))
    repeated = not level.where("n > 1 and n_best > 1").isEmpty()
    if repeated:  # repeated rows: one of them is enough to compare with
        stays = stays.groupBy("digest", "best", "n_best", "n").agg(F.min("other").alias("other"))
    best = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best"))
    checked = hits.join(stays, "digest", "left").select(
        "doc_id", "digest", best.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"),
        (F.col("n").isNull() | F.coalesce(F.col("text") == F.col("other"), F.lit(False))).alias("same"),
        sha.alias("text_sha256"), F.octet_length("text").cast("long").alias("text_bytes"), *carry,
    )
    checked = materialise(checked, "lsm-hits")
    cols = ["doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256", "text_bytes", *carry]
    bad = checked.where("not same").select("digest").distinct()
    exact = None
    good = checked
    if not bad.isEmpty():
        good = checked.join(bad, "digest", "left_anti")
        clash = rows.join(bad, "digest", "left_semi")
        order = F.max("doc_id") if largest else F.when(F.count("doc_id") == F.count("*"), F.min("doc_id"))
        groups = clash.groupBy("text").agg(order.alias("best"), F.count("*").alias("n"))
        exact = clash.join(groups, "text").withColumns({"keep_id": F.col("best"), "text_sha256": sha, "text_bytes": F.octet_length("text").cast("long")})
        exact = _one_kept(exact, F.col("text_sha256"), True).select(*cols)
    out = alone.unionByName(_one_kept(good, F.col("digest"), repeated).select(*cols))
    out = out if exact is None else out.unionByName(exact)
    return out


def _one_kept(rows: DataFrame, group: Column, repeated: bool) -> DataFrame:
    """kept: the row with the id that stays, and only one of repeated rows with that id."""
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not repeated:
        return rows.withColumn("kept", own)
    first = F.row_number().over(W.partitionBy(group, "doc_id").orderBy("text_bytes"))
    some = rows.where(own).withColumn("kept", first == 1)
    return rows.where(~own).withColumn("kept", F.lit(False)).unionByName(some)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
