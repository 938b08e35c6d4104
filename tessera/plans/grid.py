"""The experiment grid: configurations that differ from their reference on one axis, and their joint plan."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    name: str
    axis: str
    chunker: str
    retrieval: str = "bm25"
    embedding: str | None = None
    reranker: str | None = None
    candidate_k: int = 100
    table_rendering: str = "markdown"

    def __post_init__(self):
        if self.retrieval not in ("bm25", "dense", "hybrid"):
            raise ValueError(f"unknown retrieval {self.retrieval}")
        if (self.retrieval == "bm25") == bool(self.embedding):
            raise ValueError("an embedding belongs to dense and hybrid retrieval")

    @property
    def index_key(self) -> tuple:
        return self.chunker, self.table_rendering, self.embedding


BASE = Config("baseline-bm25-fixed512", "baseline", "fixed512o64")


def grid() -> list[Config]:
    # Names and axes of the configurations.
    struct = replace(BASE, name="struct", axis="chunking", chunker="struct512")
    out = [BASE]
    out += [replace(BASE, name=f"chunk-{c}", axis="chunking", chunker=c) for c in ("fixed256o32", "semantic95", "struct512")]
    out.append(replace(struct, name="tables-row-sentences", axis="table_rendering", table_rendering="row_sentences"))
    out.append(replace(struct, name="retrieval-dense-bge", axis="retrieval", retrieval="dense", embedding="bge-m3"))
    out.append(replace(struct, name="retrieval-hybrid-rrf", axis="retrieval", retrieval="hybrid", embedding="bge-m3"))
    out.append(replace(struct, name="retrieval-bm25-struct", axis="retrieval"))
    out += [replace(struct, name=f"embed-{m}", axis="embedding", retrieval="dense", embedding=m) for m in ("e5-base", "e5-base-v2")]
    ranked = replace(struct, reranker="bge-reranker-v2-m3")
    out.append(replace(ranked, name="rerank-bm25-100", axis="reranking"))
    out += [replace(ranked, name=f"rerank-candidates-{k}", axis="candidates", candidate_k=k) for k in (25, 50, 200)]
    out.append(replace(ranked, name="hybrid-plus-rerank", axis="interaction", retrieval="hybrid", embedding="bge-m3"))
    return out


def changed(a: Config, b: Config) -> set[str]:
    return {f.name for f in fields(Config) if f.name not in ("name", "axis") and getattr(a, f.name) != getattr(b, f.name)}


AXES = {"chunking": {"chunker"}, "table_rendering": {"table_rendering"}, "retrieval": {"retrieval", "embedding"}, "embedding": {"embedding", "retrieval"}, "reranking": {"reranker", "candidate_k"}, "candidates": {"candidate_k", "reranker"}}


def check(configs: list[Config]) -> None:
    """Names are unique, and each configuration differs from the baseline, or from the baseline over structure-aware chunks, only on
    its own axis; interactions may differ on several."""
    if len({c.name for c in configs}) != len(configs):
        raise ValueError("configuration names must be unique")
    base = next((c for c in configs if c.axis == "baseline"), BASE)
    references = [base, replace(base, chunker="struct512")]
    for c in configs:
        if c.axis in AXES and not any(changed(r, c) <= AXES[c.axis] for r in references):
            raise ValueError(f"{c.name} differs on more than {c.axis}: {sorted(changed(base, c))}")


def by_index(configs: list[Config]) -> dict[tuple, list[Config]]:
    """Configurations that share chunks and indexes."""
    out: dict[tuple, list[Config]] = defaultdict(list)
    for c in configs:
        out[c.index_key].append(c)
    return dict(out)


def union_of_runs(runs: dict[str, DataFrame | str]) -> tuple[DataFrame, dict[str, str]]:
    """All runs as one plan tagged with config, and why the others were skipped."""
    skipped = {name: r for name, r in runs.items() if isinstance(r, str)}
    tagged = [r.withColumn("config", F.lit(name)) for name, r in runs.items() if not isinstance(r, str)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out, skipped


def search(run: DataFrame, chunks: DataFrame, k: int = 10, most: int = 100) -> DataFrame:
    """Ranked passages, k of each query, with section, scores and scores relative to the query's best, four decimals."""
    from pyspark.sql import Window as W

    if not 1 <= k <= most:
        raise ValueError(f"k must be in [1, {most}]")
    top = F.max("score").over(W.partitionBy("query_id"))
    more = [c for c in ("section_path", "contains_table") if c in chunks.columns]
    x = run.where(F.col("rank") <= k).join(chunks.select("chunk_id", "doc_id", "text", *more), "chunk_id")
    relative = F.when(top > 0, F.round(F.col("score") / top, 4)).otherwise(0.0)
    return x.select("query_id", "rank", "chunk_id", "doc_id", "text", *more, F.round("score", 4).alias("score"), relative.alias("relative"))
