"""Chunkers: documents to ordered character spans. All are narrow: one pass per partition, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import dot, l2_normalize

ATOM = re.compile(r"\S+")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")
Span = tuple[int, int]


def cost(text: str) -> int:
    return max(1, round(len(text) / 4))


def fixed_spans(text: str, target: int = 512, overlap: int = 64, count: Callable[[str], int] = cost, at: int = 0) -> list[Span]:
    """Greedy windows of whitespace-separated atoms within `target` tokens, each beginning `overlap` tokens back."""
    if not 0 <= overlap < target:
        raise ValueError("overlap must be in [0, target)")
    atoms = [(m.start(), m.end(), count(m[0])) for m in ATOM.finditer(text)]
    spans, first = [], 0
    while first < len(atoms):
        last, used = first, 0
        while last < len(atoms) and used + atoms[last][2] <= target:
            used += atoms[last][2]
            last += 1
        last = max(last, first + 1)  # an atom over the budget stands alone
        spans.append((at + atoms[first][0], at + atoms[last - 1][1]))
        if last == len(atoms):
            break
        back, first_next = 0, last
        while first_next > first + 1 and back < overlap:
            first_next -= 1
            back += atoms[first_next][2]
        first = first_next
    return spans


def line_spans(text: str) -> list[Span]:
    """Non-blank lines without their outer spaces."""
    out, at = [], 0
    for line in text.split("\n"):
        body = line.strip(" ")
        if body:
            start = at + len(line) - len(line.lstrip(" "))
            out.append((start, start + len(body)))
        at += len(line) + 1
    return out


def sentence_spans(text: str, at: int = 0) -> list[Span]:
    out, start = [], 0
    for m in [*SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[start:end].strip():
            out.append((at + start, at + end))
        start = m.end() if m else end
    return out


def struct_spans(blocks: list[dict], text: str, target: int = 512, most: int | None = None, count=cost, split: bool = True) -> list[Span]:
    """Blocks grouped within a section up to `target`; tables whole; prose over `most` split on its own span alone."""
    most = most or 4 * target
    if most < target:
        raise ValueError("most must be at least target")
    out: list[Span] = []
    group: list[Span] = []
    used, section = 0, None

    def flush():
        nonlocal used
        if group:
            out.append((group[0][0], group[-1][1]))
        group.clear()
        used = 0

    for b in blocks:
        if b["kind"] == "boilerplate":
            continue
        a, z = b["start"], b["end"]
        n = count(text[a:z])
        if b["section_path"] != section:
            flush()
            section = b["section_path"]
        if split and b["kind"] != "table" and n > most:
            flush()
            out += fixed_spans(text[a:z], target, 0, count, at=a)
            continue
        if group and used + n > target:
            flush()
        group.append((a, z))
        used += n
    flush()
    return out


def semantic_spans(units: list[Span], distances: list[float], percentile: float, tokens: list[int], most: int = 1024) -> list[Span]:
    """Groups of units, broken where the distance exceeds the percentile of all, or at `most` tokens."""
    import numpy as np

    if not 50 <= percentile < 100:
        raise ValueError("percentile must be in [50, 100)")
    if not units:
        return []
    limit = np.quantile(distances, percentile / 100) if len(distances) else 0.0
    out, first, used = [], 0, tokens[0]
    for i in range(1, len(units)):
        if distances[i - 1] > limit or used + tokens[i] > most:
            out.append((units[first][0], units[i - 1][1]))
            first, used = i, 0
        used += tokens[i]
    return [*out, (units[first][0], units[-1][1])]


def chunks(docs: DataFrame, splitter: Callable[[str], list[Span]]) -> DataFrame:
    """chunk_id, doc_id, start, end, text: blank spans dropped, others cut to their non-space extent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for start, end in splitter(text or ""):
                    body = text[start:end]
                    start += len(body) - len(body.lstrip())
                    if body := body.strip():
                        rows.append((f"{doc}#{start:08d}-{start + len(body):08d}", doc, start, start + len(body), body))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), b.column(0).type, pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chunk_id", "doc_id", "start", "end", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"chunk_id string, doc_id {kind}, start bigint, end bigint, text string")


def chunker(name: str) -> Callable[[str], list[Span]]:
    """Text chunkers by name: fixedN, fixedNoM, lines, sentences."""
    if m := re.fullmatch(r"fixed(\d+)(?:o(\d+))?", name):
        return lambda text, n=int(m[1]), o=int(m[2] or 0): fixed_spans(text, n, o)
    if name not in ("lines", "sentences"):
        raise ValueError(f"unknown chunker {name}")
    return {"lines": line_spans, "sentences": sentence_spans}[name]


def _distances(vectors: list[list[float]]) -> list[float]:
    """Cosine distances of neighbours; a zero vector is at distance 1 from all."""
    import numpy as np

    x = np.array(vectors, np.float64)
    x /= np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    return np.round(1 - (x[1:] * x[:-1]).sum(1), 9).tolist()


def splitter(name: str) -> Callable[[str, list[dict], list | None], list[Span]]:
    """A chunker by its name, of (text, blocks, sentence vectors): those of chunker(), structN and semanticP. A text
    without blocks has its lines as paragraphs of one section."""
    if m := re.fullmatch(r"struct(\d+)", name):
        n = int(m[1])
        plain = lambda text: [{"kind": "paragraph", "start": a, "end": z, "section_path": []} for a, z in line_spans(text)]
        return lambda text, blocks, _: struct_spans(blocks or plain(text), text, n)
    if m := re.fullmatch(r"semantic(\d+(?:\.\d+)?)", name):
        limit = float(m[1])

        def semantic(text, blocks, vectors):
            units = sentence_spans(text)
            if len(vectors or []) != len(units):
                raise ValueError(f"{len(vectors or [])} vectors for {len(units)} sentences")
            return semantic_spans(units, _distances(vectors) if len(units) > 1 else [], limit, [cost(text[a:z]) for a, z in units])

        return semantic
    of = chunker(name)
    return lambda text, blocks, _: of(text)


BLOCKS = "array<struct<kind: string, start: bigint, `end`: bigint, section_path: array<string>>>"


def chunk_corpus(docs: DataFrame, name: str, vectors: DataFrame | None = None) -> DataFrame:
    """chunk_id, doc_id, start, end, text, section_path, contains_table of documents (doc_id, text, perhaps blocks) by the
    chunker of that name. vectors: doc_id, pos, embedding of the sentences, which semantic chunkers need. A chunk's
    section is that of its first block. One narrow pass; a document's sentence vectors come in one row."""
    split = splitter(name)
    if name.startswith("semantic") and vectors is None:
        raise ValueError("semantic chunks need sentence vectors")
    part = F.col("blocks").cast(BLOCKS) if "blocks" in docs.columns else F.lit(None).cast(BLOCKS)
    if "blocks" in docs.columns:
        part = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), b["section_path"].alias("section_path")))
    x = docs.select("doc_id", "text", part.alias("blocks"))
    if name.startswith("semantic"):
        own = vectors.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "embedding"))).alias("v"))
        x = x.join(own.select("doc_id", F.transform("v", lambda r: r["embedding"].cast("array<double>")).alias("vectors")), "doc_id", "left")
    else:
        x = x.withColumn("vectors", F.lit(None).cast("array<array<double>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, blocks, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                blocks = blocks or []
                for start, end in split(text or "", blocks, own):
                    body = text[start:end]
                    start += len(body) - len(body.lstrip())
                    if body := body.strip():
                        end = start + len(body)
                        held = [x for x in blocks if x["start"] < end and start < x["end"]]
                        section = held[0]["section_path"] if held else []
                        rows.append((f"{doc}#{start:08d}-{end:08d}", doc, start, end, body, section, any(x["kind"] == "table" for x in held)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), b.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_()]
            names = ["chunk_id", "doc_id", "start", "end", "text", "section_path", "contains_table"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"chunk_id string, doc_id {kind}, start bigint, end bigint, text string, section_path array<string>, contains_table boolean")


def replay(docs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Chunks again from recorded spans; spans of unknown documents give none."""
    x = boundaries.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    text = F.substring("_t", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return x.select(F.format_string("%s#%08d-%08d", "doc_id", "start", "end").alias("chunk_id"), "doc_id", "start", "end", text.alias("text"))


def oversize(chunks: DataFrame, target: int) -> DataFrame:
    """How many chunks are above the target, and the largest, over all documents."""
    n = F.greatest(F.lit(1), F.bround((F.col("end") - F.col("start")) / F.lit(4.0)))
    return chunks.agg(F.count_if(n > target).alias("oversize"), F.max(n).cast("long").alias("largest"))


def corpus_digest(docs: DataFrame) -> DataFrame:
    """SHA-256 over sorted doc:length pairs, folded in two levels so that no task holds all documents."""
    part = F.format_string("%s:%d;", "doc_id", F.length("text"))
    byte = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 4)
    folded = docs.groupBy(byte.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ""), 256).alias("d"))
    return folded.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.count("*").alias("parts"))


def breakpoints(units: DataFrame, percentile: float = 95) -> DataFrame:
    """doc_id, pos, distance (to the unit before), part: units (doc_id, pos, embedding) grouped where the cosine
    distance exceeds the document's percentile. NULL distance at a document's first unit."""
    v = l2_normalize("embedding")
    order = W.partitionBy("doc_id").orderBy("pos")
    x = units.select("doc_id", "pos", v.alias("v")).withColumn("before", F.lag("v").over(order))
    x = x.select("doc_id", "pos", F.when(F.col("before").isNotNull(), F.round(1 - dot("v", "before"), 9)).alias("distance"))
    limit = F.percentile("distance", F.lit(percentile / 100)).over(W.partitionBy("doc_id"))
    x = x.withColumn("cut", F.coalesce((F.col("distance") > limit).cast("int"), F.lit(0)))
    return x.select("doc_id", "pos", "distance", F.sum("cut").over(order).alias("part"))


def struct_chunks(parsed: DataFrame, target: int = 512) -> DataFrame:
    """chunk_corpus() of documents with blocks, by structure."""
    return chunk_corpus(parsed.where("blocks is not null"), f"struct{target}")
