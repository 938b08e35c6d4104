"""A corpus pipeline of five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, mixing, packing, simhash_dedup
from tessera.llm.common import drop_table, free_name, made_since, materialise

_run: list[str] = []  # the run() whose stages are being built
_left: dict[tuple[str, str, str], list[str]] = {}  # by run, folder and stage: the tables that it made


def _stage(f):
    """A stage begins when its predecessor's result is written: tables that only led there go, unless docs reads them.

    Stages called by run() clear up after that run alone, so results of other runs stay readable."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [stage.__name__ for _, stage in STAGES]
        key = lambda i: (_run[-1] if _run else "", sf_dir, names[i])
        at = names.index(f.__name__)
        left = _left.pop(key(at - 1), []) if at else []
        read = docs.inputFiles() if left else []
        kept = [path for path in left if any(path.rpartition("/")[2] in file for file in read)]
        for path in left:
            if path not in kept:
                drop_table(spark, path)
        mark = len(made_since(0))
        out = f(spark, docs, sf_dir)
        _left.setdefault(key(at), []).extend([*kept, *made_since(mark)])
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network recognises, a null lang filled in: those without letters (`und`) and
    those whose likeliest language is hardly likelier than chance go. Null or empty texts go; null ids and repeated rows
    are judged each for itself; with no labelled rows all texts with letters stay; an empty table gives an empty one."""
    return language_id.recognised(docs, language_id.train(docs))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, in a table, so that decisions apply to rows, whatever their ids; its column."""
    key = free_name(docs.columns, "_row")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows"), key


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays. Null texts count as empty, null ids as the smallest; of
    repeated rows one stays; an empty table gives an empty one."""
    rows, key = _numbered(docs)
    kept = exact_dedup.dedup(rows.select("doc_id", "text", F.col(key).alias("_row")), keep="largest", carry=("_row",)).where("kept")
    return rows.join(kept.select(F.col("_row").alias(key)), key, "left_semi").select(*docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked as near copies (five-word shingles with a Jaccard similarity of 0.8 or more), the one
    with the smallest doc_id stays. Simhash fingerprints of eight seeds make the clusters within which texts are joined.
    Texts without words are copies of each other; null ids count as the largest; an empty table gives an empty one."""
    rows, key = _numbered(docs)
    found = simhash_dedup.near_copies(rows.select(F.col(key).alias("row"), "text"))
    ids = materialise(found.join(rows.select(F.col(key).alias("row"), "doc_id"), "row"), "pipeline-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stays = ids.groupBy("component").agg(first).select(F.col("first.row").alias("row"))
    drop = ids.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(key))
    return rows.join(drop, key, "left_anti").select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, as its text. A null source is a source of its own; documents of
    which nothing is taken go, as those without words do; an empty table gives an empty one."""
    return mixing.take(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows. Null and empty texts have only the closing id; an empty table gives no pieces."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained network and fingerprints can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _run.append(uuid.uuid4().hex)
    try:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            _left[_run[-1], sf_dir, stage.__name__].append(docs._tessera_path)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        mine = _run.pop()
        for key in [k for k in _left if k[0] == mine]:
            del _left[key]
