"""Language identification by a byte convolutional network trained in numpy.

Texts are cut into windows of `window` bytes. Filters of widths 2, 3 and 4 over one-hot bytes are max-pooled
over the window and feed a softmax; a document's distribution is the byte-weighted mean over all its
windows. For inference the filters become tables over byte pairs, so a filter bank costs one or two gathers.

Training rows are bounded: `sample` documents (least hashes of their id, as many of each language) of those with a
language outside the held-out fold, with `windows` seeded windows each; the bounds are parameters. Everything else covers all
rows and whole texts.

Edge cases: null text or a text without letters: `und`, score 0; no training rows: `und` everywhere; repeated
rows and null ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import crc_fold, lean, slices

WIDTHS = (2, 3, 4)


class ByteCNN:
    """One-hot byte convolutions of several widths, max pooling and a softmax layer."""

    def __init__(self, labels: list[str], filters: int = 16, window: int = 256, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.labels, self.filters, self.window = labels, filters, window
        self.conv = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * filters, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * filters, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        self._pairs = None

    def _pool(self, x):
        """x: uint8 [n, window + 3], zero-padded; pooled responses and where they were found."""
        import numpy as np

        n, size = len(x), self.window
        pooled, where = [], []
        for w, table in zip(WIDTHS, self.conv, strict=True):
            r = table[0][x[:, :size]]
            for k in range(1, w):
                r = r + table[k][x[:, k : size + k]]
            at = r.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
        return np.concatenate(pooled, 1), where

    def fit(self, x, y, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 7) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        params = [*self.conv, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                b = order[i : i + batch]
                xb = x[b]
                raw, where = self._pool(xb)
                h = np.maximum(raw + self.bias, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), y[b]] -= 1
                p /= len(b)
                dh = (p @ self.out.T) * (h > 0)
                grads = []
                for j, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
                    g = np.zeros((w, 256, self.filters), np.float32)
                    part = dh[:, j * self.filters : (j + 1) * self.filters]
                    col = np.broadcast_to(np.arange(self.filters), at.shape)
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(xb, at + k, 1), col), part)
                    grads.append(g)
                grads += [dh.sum(0), h.T @ p, p.sum(0)]
                t += 1
                step = rate * (1 - epoch / epochs)
                for q, g, a, s in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    q -= step * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self._pairs = None

    def _tables(self):
        if self._pairs is None:
            two, three, four = self.conv
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, self.filters)
            self._pairs = (pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3]))
        return self._pairs

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def probabilities(self, x, step: int = 128):
        """Softmax of windows x (uint8 [n, window + 3])."""
        import numpy as np

        two, three, third, front, back = self._tables()
        size, out = self.window, []
        for i in range(0, len(x), step):
            part = x[i : i + step]
            code = part[:, :-1].astype(np.intp) << 8 | part[:, 1:]
            pooled = [
                two[code[:, :size]].max(1),
                (three[code[:, :size]] + third[part[:, 2 : size + 2]]).max(1),
                (front[code[:, :size]] + back[code[:, 2 : size + 2]]).max(1),
            ]
            h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            z = h @ self.out + self.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def windows(self, texts: list[bytes]):
        """Fixed-length windows over whole texts; (x, text of each window, bytes in each)."""
        import numpy as np

        size = self.window
        count = np.array([-(-len(t) // size) for t in texts], np.int64)
        padded = b"".join(t + bytes(-len(t) % size) for t in texts)
        body = np.frombuffer(padded, np.uint8).reshape(-1, size)
        of = np.repeat(np.arange(len(texts)), count)
        x = np.zeros((len(body), size + 3), np.uint8)
        x[:, :size] = body
        inside = np.flatnonzero(of[1:] == of[:-1])
        x[inside, size:] = body[inside + 1, :3]  # filters see across the window's end within a text
        first = np.cumsum(count) - count
        length = np.minimum(size, np.array([len(t) for t in texts], np.int64)[of] - (np.arange(len(of)) - first[of]) * size)
        return x, of, length

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import numpy as np

        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if lettered:
            x, of, length = self.windows([texts[i].encode("utf-8", "surrogatepass") for i in lettered])
            p = self.probabilities(x) * length[:, None]
            total = np.zeros((len(lettered), len(self.labels)))
            for c in range(len(self.labels)):
                total[:, c] = np.bincount(of, p[:, c], len(lettered))
            total /= total.sum(1, keepdims=True)
            for i, row in zip(lettered, total, strict=True):
                best = int(row.argmax())
                names[i], scores[i] = self.labels[best], min(1.0, float(row[best]))
        return names, scores


def train(docs: DataFrame, sample: int = 4000, windows: int = 2, chars: int = 240, window: int = 256) -> ByteCNN | None:
    """A network from a bounded sample of labelled rows outside the held-out fold; None if there are none."""
    import numpy as np

    mine = docs.where((crc_fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    h = F.xxhash64("doc_id", "n")
    keyed = mine.select("doc_id", "lang", "text", F.length("text").alias("n")).withColumn("h", h)
    # As many of each language, so that rare ones are known too. A language's hashes spread evenly, so those below a
    # share of it that holds four times as many come first to the window, whatever its size.
    sizes = mine.groupBy("lang").agg(F.count("*").alias("all"))
    languages = sizes.count()
    if not languages:
        return None
    each = max(1, sample // languages)
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "doc_id"))
    low = keyed.select("h", "lang", "doc_id").join(F.broadcast(sizes.orderBy("lang").limit(sample)), "lang").where(F.shiftrightunsigned("h", 1) / F.lit(2.0**63) * F.col("all") <= 4 * each + 16)
    least = low.withColumn("nth", nth).where(F.col("nth") <= each).groupBy("lang").agg(F.max(F.shiftrightunsigned("h", 1)).alias("last"))
    start = lambda i: F.pmod(F.xxhash64("h", i), F.greatest(F.col("n") - chars, F.lit(1))).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(F.col("text"), start(i), F.lit(chars)))
    # One row a language, `sample` of them at most, so broadcast; repeated rows share a hash and would add to the sample.
    rows = keyed.join(F.broadcast(least.orderBy("lang").limit(sample)), "lang").where(F.shiftrightunsigned("h", 1) <= F.col("last")).dropDuplicates(["h", "lang"])
    rows = rows.select("h", "lang", cut.alias("cut")).orderBy("h", "lang").limit(sample).collect()
    labels = sorted({r.lang for r in rows})
    model = ByteCNN(labels, window=window)
    rng = np.random.default_rng(11)
    x, y = [], []
    for r in rows:
        for i, t in enumerate(r.cut):
            b = t.encode("utf-8", "surrogatepass")[:window]
            if i == 1:  # short texts must be known too
                b = b[: int(rng.integers(8, window))]
            x.append(np.frombuffer(b.ljust(window + 3, b"\0"), np.uint8))
            y.append(labels.index(r.lang))
    model.fit(np.array(x), np.array(y))
    return model


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            names, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
            cols = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, model: ByteCNN | None, least: float = 0.35) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with a score of `least` or more (little above chance,
    which is a quarter for four languages, so that clean texts stay); a null lang becomes the one predicted. With no
    model all rows with letters stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column(names.index("text")).to_pylist()
            if model:
                found, scores = model.predict(texts)
                keep = [name != "und" and score >= least for name, score in zip(found, scores, strict=True)]
                if "lang" in names and pa.types.is_string(batch.column(i := names.index("lang")).type):
                    batch = batch.set_column(i, "lang", pc.coalesce(batch.column(i), pa.array(found, pa.string())))
            else:
                keep = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
