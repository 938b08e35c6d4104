"""Shared helpers: shared-folder tables, bounded Arrow slices and distributed connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local
    mode (tests), and an error on a cluster, whose machines share no such folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            drop_table(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write to a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_table(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def made_since(mark: int) -> list[str]:
    """Paths of the tables made since made_since(0) had `mark` entries."""
    return [path for _, path in _made[mark:]]


def forget(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    drop_table(df.sparkSession, df._tessera_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined with table, which has one row a key and in `n` the key's rows among the `total` of rows.

    Keys with over a 4p-th of all rows, for p partitions, are fewer than 4p, whatever the data: those are broadcast, so
    none of them falls to one task. rows is read twice and should be a table."""
    least = max(64, total // (4 * partitions(rows.sparkSession)))
    hot, cold = table.where(F.col(n) > least), table.where(F.col(n) <= least)
    if hot.isEmpty():
        return rows.join(table, key)
    hot = F.broadcast(hot)
    names = [key] if isinstance(key, str) else key
    return rows.join(hot, key).unionByName(rows.join(hot.select(*names), key, "left_anti").join(cold, key))


def crc_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices whose named text column holds about `most` bytes (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        del batch, col  # else it is held while the next one is read


def give_back() -> None:
    """Return what Arrow's and C's allocators hold unused to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that gives unused memory back when its task ends: Python workers wait for further tasks
    beside the JVM, which may need it in stages without Python."""

    @wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (u, v) as (node, root), by randomised contraction.

    Every round hooks each node to the neighbour (or itself) with the least salted hash and contracts the
    graph; nodes fall by a constant factor whatever the ids, so rounds grow as the logarithm of the input.
    All state is in tables of the shared folder; hubs meet only map-side combined minima and splittable joins.
    """
    pairs = edges.where("u is not null and v is not null and u <> v").selectExpr("least(u, v) u", "greatest(u, v) v")
    now = materialise(pairs.distinct(), f"{name}-edges")
    kind = now.schema["u"].dataType
    levels: list[DataFrame] = []
    while not now.isEmpty():
        salt = F.lit(len(levels))
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", salt).alias("h"), F.col("v").alias("v"))).alias("m"), F.count("*").alias("n"))
        hook = near.select(
            F.col("u").alias("node"),
            F.when(F.col("m.h") < F.xxhash64("u", salt), F.col("m.v")).otherwise(F.col("u")).alias("root"),
            "n",
        )
        full = materialise(hook, f"{name}-hook")
        hook, total = full.select("node", "root"), now.count()
        left = materialise(hot_join(now, full.select(F.col("node").alias("u"), F.col("root").alias("ru"), "n"), "u", total).drop("n"), f"{name}-half")
        both = hot_join(left, full.select(F.col("node").alias("v"), F.col("root").alias("rv"), "n"), "v", total)
        after = both.where("ru <> rv").selectExpr("least(ru, rv) u", "greatest(ru, rv) v").distinct()
        after = materialise(after, f"{name}-edges")
        forget(now)
        forget(left)
        levels.append(hook)
        now = after
    if not levels:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    out = levels[0]
    for hook in levels[1:]:
        step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out if len(levels) == 1 else materialise(out, name)
