"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: each byte adds its gear value to the hash shifted by two bits,
modulo 2**32, so the hash knows the last 16 bytes only. Of every `window` words in a row, the start with the least
hash before it (the last of equals) is a boundary, so boundaries are at most `window` words apart, whatever the text,
and depend on nearby words only: an insertion moves only the chunks it touches. From each boundary on, the fewest
whole chunks that have at least `words` words are a variable chunk that is looked up by its digest (96 bits) over the
whole corpus: one that another document also holds is repeated, as a whole and in that one document. Repeated chunks
of a row that overlap are one passage, so every stretch of `words` words of a passage stands in some other document;
short matches with several documents side by side make no passage.

A passage that stands in two documents has 16 bytes (8 words at most) and the windows across its ends in which the
documents may choose otherwise: under 8 + 2 * window words are lost before the first common boundary and under
2 * window after the last, and a chunk has under words + window words. With windows of 5 words, 20 words finds all
passages of over 50, also those of short or repeated words. A filter of fixed size over the repeated digests keeps
most chunks out of the join with them. boundaries() is the same hash's rule for bytes, which no query uses.

Edge cases: null and empty texts have no chunks; documents are told apart by doc_id (null ids are one document), so
repeated rows of one id repeat nothing by themselves, but each row has its own passages; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import forget, hot_join, materialise, slices

AVERAGE, LEAST, MOST, WINDOW, WORDS, FILTER_BITS = 32, 12, 512, 5, 20, 26


def gear_table():
    """256 values from the splitmix64 rule with seed 0x6765_6172; upper halves."""
    import numpy as np

    z = np.uint64(0x67656172) + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 257, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: bytes):
    """The gear hash after each byte."""
    import numpy as np

    h = gear_table()[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # doubling: after these, h sums the last 16 bytes' gears by age
        if len(h) <= step:
            break
        older = h[:-step] << np.uint32(2 * step)
        h = h.copy()
        h[step:] += older
    return h


def word_boundaries(data: bytes, starts, window: int = WINDOW):
    """Ends of the chunks of one text whose words have these starts, the last of them its length."""
    import numpy as np

    if not data:
        return np.zeros(0, np.int64)
    at = starts[starts > 0]
    if len(at) < window:
        return np.array([len(data)])
    seen = np.lib.stride_tricks.sliding_window_view(gear_hashes(data)[at - 1], window)
    pick = np.arange(len(seen)) + window - 1 - seen[:, ::-1].argmin(1)
    return np.append(at[np.unique(pick)], len(data))


def boundaries(data: bytes, average: int = AVERAGE, least: int = LEAST, most: int = MOST):
    """Ends of the chunks of one text, the last of them its length."""
    import numpy as np

    if not data:
        return np.zeros(0, np.int64)
    h = gear_hashes(data)
    bits = average.bit_length() - 1
    ends = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends = ends[np.diff(ends, prepend=-least) >= least]  # locally decided: any candidate just before suppresses one
    ends = np.append(ends[ends < len(data)], len(data))
    starts = np.append(0, ends[:-1])
    extra = (ends - starts - 1) // most
    if extra.any():
        at = np.repeat(np.arange(len(ends)), extra)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        ends = np.sort(np.concatenate([ends, starts[at] + nth * most]))
    return ends


def chunks(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """row (a number of the row), doc_id, start and length (bytes), word (number of the first), words (how many), digest
    and mark (64 and 32 bits of the chunk's hash) of the variable chunks of at least `words` words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b as hash_of

        import numpy as np

        blank = np.zeros(256, bool)
        blank[[32, *range(9, 14)]] = True
        names = ["row", "doc_id", "start", "length", "word", "words", "digest", "mark"]
        for batch in slices(batches, "text"):
            of, start, length, word, count, digest = [], [], [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                space = blank[np.frombuffer(data, np.uint8)]
                first = ~space & np.append(True, space[:-1])[: len(data)]
                ends = word_boundaries(data, np.flatnonzero(first), window)
                if not len(ends):
                    continue
                begins = np.append(0, ends[:-1])
                upto = np.cumsum(np.add.reduceat(first, begins, dtype=np.int64))
                before = np.append(0, upto[:-1])
                last = np.searchsorted(upto, before + words)
                whole = last < len(ends)
                begins, before, last = begins[whole], before[whole], last[whole]
                of.append(np.full(len(begins), i))
                start.append(begins)
                length.append(ends[last] - begins)
                word.append(before)
                count.append(upto[last] - before)
                digest += [hash_of(data[a:b], digest_size=12).digest() for a, b in zip(begins.tolist(), ends[last].tolist(), strict=True)]
            if of:
                at = pa.array(np.concatenate(of))
                cols = [batch.column(0).take(at), batch.column(1).take(at)]
                cols += [pa.array(np.concatenate(x).astype(np.int32)) for x in (start, length, word, count)]
                both = np.frombuffer(b"".join(digest), np.dtype([("digest", "<i8"), ("mark", "<i4")]))
                cols += [pa.array(both["digest"].copy()), pa.array(both["mark"].copy())]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row bigint, doc_id {kind}, start int, length int, word int, words int, digest bigint, mark int")


def _in_several(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, low (the least doc_id) and n (rows) of the keys that several documents hold; null ids are one document."""
    known = rows.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("ids"), F.count("*").alias("n"))
    return known.where("low < high or (ids > 0 and ids < n)").select(*key, "low", "n")


def repeated_passages(docs: DataFrame, words: int = WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, start, end (bytes of the UTF-8 text), chunks, words, first_doc_id (the least that holds its first
    chunk), first (whether that is this document) and digest: passages that other documents hold as well."""
    every = materialise(chunks(docs, window, words), "cdc-chunks", "zstd")
    known = materialise(_in_several(every, ["digest"]).select("digest"), "cdc-known")
    bit = F.pmod(F.xxhash64("digest"), F.lit(1 << FILTER_BITS))
    seen = known.groupBy(F.bitmap_bucket_number(bit).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    tested = every.withColumns({"block": F.bitmap_bucket_number(bit), "at": F.bitmap_bit_position(bit)}).join(F.broadcast(seen), "block")
    byte = F.conv(F.hex(F.expr("substring(bitmap, int(at div 8) + 1, 1)")), 16, 10).cast("int")
    maybe = tested.where(byte.bitwiseAND(F.expr("shiftleft(1, int(at % 8))")) != 0).select(*every.columns)
    maybe = materialise(maybe, "cdc-maybe", "zstd")
    # The few rows that the filter lets pass are counted again, by the whole hash, so equal digests of other texts go.
    forget(every)
    sure = materialise(_in_several(maybe, ["digest", "mark"]), "cdc-sure")
    held = hot_join(maybe, sure, ["digest", "mark"], maybe.count())
    end = F.col("start") + F.col("length")
    order = W.partitionBy("row").orderBy("start")
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = held.withColumn("new", (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("int"))
    found = apart.withColumn("run", F.sum("new").over(order)).groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").cast("long").alias("start"),
        F.max(end).cast("long").alias("end"),
        F.count("*").alias("chunks"),
        (F.max(F.col("word") + F.col("words")) - F.min("word")).cast("long").alias("words"),
        F.min_by("low", "start").alias("first_doc_id"),
        F.lpad(F.lower(F.hex(F.min_by("digest", "start"))), 16, "0").alias("digest"),
    )
    return found.drop("row", "run").withColumn("first", F.col("doc_id").eqNullSafe(F.col("first_doc_id")))


def op8_cdc_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
