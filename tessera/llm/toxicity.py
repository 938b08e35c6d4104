"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training rows are those with a label outside the held-out fold; a bounded sample of them (`sample` documents, least
hashes of their id, half of them toxic if there are as many) serves as the examples. Every word of theirs is a
term. Its weight in a text is (1 + log tf) * idf * phi: idf counts all documents, and phi is the correlation of the
word's presence with the label over the examples (the root of chi-square over their number), so that words which
say nothing of the label hardly count, without a cut. The examples, ordered so that like vectors stand together,
are cut into blocks; the block maxima of a query's terms bound its similarity to each block. The best blocks are
scored first, then all those whose bound reaches the k-th similarity found, so results are exact. Votes are weighted
by distance, and a logistic curve fitted on leave-one-out votes of all examples, weighted to the share of toxic
ones among all labels, calibrates the score. The neighbours and their similarities are the evidence.

Edge cases: null or empty text, or none of the words: the score of examples without words, and no evidence; no
labels of one of both kinds: 0 for all; ties between neighbours go to the earlier example; repeated rows and null
ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_fold, slices

TERM = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> list[str]:
    """Words in lower case."""
    return TERM.findall((text or "").lower())


class BlockMaxIndex:
    """Unit vectors of the examples as inverted lists in blocks of examples, with each list's maximum by block.

    vectors: a dict {term: weight} each, or a pair of arrays."""

    def __init__(self, vectors: list, labels: list[int], terms: int, block: int = 64):
        import numpy as np

        pairs = [(np.array(list(v), np.int64), np.array(list(v.values()), np.float64)) if isinstance(v, dict) else v for v in vectors]
        # Examples with the same heaviest terms stand together, which makes block maxima tight.
        heavy = [ids[np.lexsort((ids, -w))[:4]].tolist() for ids, w in pairs]
        self.order = sorted(range(len(pairs)), key=lambda i: (heavy[i], i))
        pairs = [pairs[i] for i in self.order]
        self.labels = np.array([labels[i] for i in self.order], np.float64)
        self.block, self.n, self.terms = block, len(pairs), terms
        self.blocks = -(-self.n // block)
        self.size = np.array([len(ids) for ids, _ in pairs], np.int64)
        self.term = np.concatenate([np.zeros(0, np.int64), *[ids for ids, _ in pairs]]).astype(np.int32)
        self.weight = np.concatenate([np.zeros(0), *[w for _, w in pairs]])
        self._lists = None

    def __getstate__(self):
        return self.__dict__ | {"_lists": None}

    @property
    def vectors(self) -> list[dict[int, float]]:
        import numpy as np

        cuts = np.cumsum(self.size)[:-1]
        pairs = zip(np.split(self.term, cuts), np.split(self.weight, cuts), strict=True)
        return [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in pairs] if self.n else []

    def _inverted(self):
        """Offsets, documents and weights of the lists; block maxima; rows of the longest lists, written out."""
        import numpy as np

        if self._lists is None:
            doc = np.repeat(np.arange(self.n), self.size)
            by = np.argsort(self.term, kind="stable")
            held, docs, weights = self.term[by], doc[by], self.weight[by]
            ptr = np.searchsorted(held, np.arange(self.terms + 1))
            maxima = np.zeros((self.terms, self.blocks), np.float32)
            np.maximum.at(maxima, (held, docs // self.block), np.nextafter(weights.astype(np.float32), np.float32(np.inf)))
            long = np.flatnonzero(np.diff(ptr) > max(16, self.n // 16))
            row = np.full(self.terms, -1)
            row[long] = np.arange(len(long))
            full = np.zeros((len(long), self.n), np.float32)
            on = row[held] >= 0
            full[row[held[on]], docs[on]] = weights[on]
            self._lists = ptr, docs, weights, maxima, row, full, np.append(0, np.cumsum(self.size)), np.zeros(self.terms)
        return self._lists

    def nearest(self, query, k: int, without: int = -1):
        """The k nearest examples with similarity above zero, as (example, similarity), nearest first. Similarities have
        six decimals; what is equal so far is a tie."""
        import numpy as np

        terms, q = (np.array(list(query), np.int64), np.array(list(query.values()), np.float64)) if isinstance(query, dict) else query
        if not len(terms) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        ptr, docs, weights, maxima, row, full, begin, dense = self._inverted()
        bound = q @ maxima[terms] + 1e-6
        order = np.argsort(-bound, kind="stable")
        dense[terms] = q

        def score(b):
            lo, hi = b * self.block, min(self.n, (b + 1) * self.block)
            part = slice(begin[lo], begin[hi])
            return np.arange(lo, hi), np.add.reduceat(dense[self.term[part]] * self.weight[part], begin[lo:hi] - begin[lo])

        def best(found):
            ids, sims = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
            some = sims > 0
            if 0 <= without:
                some &= ids != without
            if len(sims) > 4 * k:  # sort only what may be among the k
                held = np.where(some, sims, 0.0)
                some &= held >= np.partition(held, len(held) - k)[-k] - 1e-6
            ids, sims = ids[some], np.round(sims[some], 6)
            first = np.lexsort((ids, -sims))[:k]
            return ids[first], sims[first]

        at, many = max(1, -(-(k + 1) // self.block)), max(4, self.blocks // 8)
        # Where bounds differ little, hardly a block will be left out.
        flat = np.count_nonzero(bound >= 0.5 * bound[order[0]]) > many
        found = [] if flat else [score(b) for b in order[:at]]
        ids, sims = (None, np.zeros(0)) if flat else best(found)
        least = sims[-1] if len(sims) == k else 0.0
        live = order if flat else order[at:][bound[order[at:]] >= least - 1e-6]
        if len(live) > many:  # the lists of all terms at once are cheaper
            rows = row[terms]
            long = rows >= 0
            total = (q[long].astype(np.float32) @ full[rows[long]]).astype(np.float64)
            short, w = terms[~long], q[~long]
            first = ptr[short]
            n = ptr[short + 1] - first
            ends = np.cumsum(n)
            place = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            total += np.bincount(docs[place], weights[place] * np.repeat(w, n), self.n)
            ids, sims = best([(np.arange(self.n), total)])
        elif len(live):
            ids, sims = best([*found, *(score(b) for b in live)])
        dense[terms] = 0
        return ids, sims


class Neighbours:
    """Vocabulary, term weights, index and calibration.

    bags: the examples as {word: count}; idf: of each word over all documents; toxic: their share among all labels."""

    def __init__(self, idf: dict[str, float], bags: list[dict[str, int]], labels: list[int], k: int = 15, ids: list | None = None, toxic: float = 0.5):
        import numpy as np

        self.names = {t: i for i, t in enumerate(sorted(idf))}
        self.k = k
        label = np.array(labels, np.int64)
        present = [np.array([self.names[w] for w in b if w in self.names], np.int64) for b in bags]
        n, n1 = len(bags), int(label.sum())
        a, b = (np.bincount(np.concatenate([np.zeros(0, np.int64), *[p for p, y in zip(present, labels, strict=True) if y == v]]), minlength=len(self.names)) for v in (1, 0))
        a, b = a.astype(float), b.astype(float)
        c, d = n1 - a, n - n1 - b
        under = (a + b) * (c + d) * n1 * (n - n1)
        self.phi = np.abs(a * d - b * c) / np.sqrt(np.where(under > 0, under, 1)) * (under > 0)
        self.weight = np.array([idf[t] for t in sorted(idf)] or [0.0]) * (self.phi if len(idf) else 0.0)
        vectors = [self.vector(b) for b in bags]
        some = [i for i, v in enumerate(vectors) if len(v[0])]
        self.index = BlockMaxIndex([vectors[i] for i in some], [labels[i] for i in some], len(self.names))
        self.ids = [(ids or list(range(n)))[some[i]] for i in self.index.order]
        rest = [labels[i] for i in range(n) if not len(vectors[i][0])]
        self.empty = (sum(rest) + toxic) / (len(rest) + 1) if labels else 0.0
        self.a, self.b = self._calibrate(toxic)

    def vector(self, bag: dict[str, int]):
        """Terms and their weights, of length one; words of no weight are left out."""
        import numpy as np

        terms = np.fromiter(map(self.names.get, bag, repeat(-1)), np.int64, len(bag))
        n = np.fromiter(bag.values(), np.float64, len(bag))
        w = (1 + np.log(n)) * np.where(terms >= 0, self.weight[terms], 0.0)
        some = w > 0
        terms, w = terms[some], w[some]
        return terms, w / (math.sqrt(w @ w) or 1.0)

    def vote(self, ids, sims) -> float:
        """Share of toxic neighbours, weighted by distance, with one doubtful neighbour more."""
        w = 1.0 / (1.0 - sims.clip(0, 1) + 0.05)
        return float((w @ self.index.labels[ids] + 0.5) / (w.sum() + 1.0))

    def _calibrate(self, toxic: float) -> tuple[float, float]:
        """Slope and offset of a logistic curve over leave-one-out votes."""
        import numpy as np

        y = self.index.labels
        if self.index.n < 10 or len(set(y.tolist())) < 2:
            return 8.0, -4.0
        cuts = np.cumsum(self.index.size)[:-1]
        pairs = zip(np.split(self.index.term, cuts), np.split(self.index.weight, cuts), strict=True)
        x = np.array([self.vote(*self.index.nearest(pair, self.k, i)) for i, pair in enumerate(pairs)])
        share = y.mean()
        v = np.where(y == 1, toxic / share, (1 - toxic) / (1 - share))
        a, b = 8.0, -4.0
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(v * (p - y)) @ x + 1e-2 * (a - 8), (v * (p - y)).sum() + 1e-2 * (b + 4)])
            s = v * p * (1 - p)
            h = np.array([[s @ (x * x) + 1e-2, s @ x], [s @ x, s.sum() + 1e-2]])
            da, db = np.linalg.solve(h, g)
            a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
        return a, b

    def judge(self, text: str | None) -> tuple[float, list, list[float]]:
        """The score, the ids of the neighbours and their similarities."""
        vector = self.vector(Counter(terms_of(text)))
        if not len(vector[0]):
            return self.empty, [], []
        ids, sims = self.index.nearest(vector, self.k)
        return 1 / (1 + math.exp(-max(-50, min(50, self.a * self.vote(ids, sims) + self.b)))), [self.ids[i] for i in ids.tolist()], sims.tolist()

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, k: int = 15) -> Neighbours | None:
    """Examples from a bounded sample of labelled rows outside the held-out fold."""
    kind = docs.schema["doc_id"].dataType
    ours = labels.where((crc_fold(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast(kind).alias("doc_id"), "toxic").where("doc_id is not null")
    share = ours.agg(F.avg("toxic")).first()[0]
    h = F.xxhash64("doc_id")
    picked = []
    for toxic in (0, 1):
        picked += ours.where(F.col("toxic") == toxic).select("doc_id", "toxic", h.alias("h")).orderBy("h", "doc_id").limit(sample // 2).collect()
    if len({r.toxic for r in picked}) < 2:
        return None
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], f"doc_id {kind.simpleString()}, toxic int").dropDuplicates(["doc_id"])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [sorted(Counter(terms_of(t)).items()) for t in batch.column(2).to_pylist()]
            words = pa.array([[w for w, _ in r] for r in rows], pa.list_(pa.string()))
            count = pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, count], ["doc_id", "toxic", "words", "n"])

    # Bounded by `sample`, so broadcast. Repeated rows of an id would break the bound: one row for each id.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(bags, f"doc_id {kind.simpleString()}, toxic int, words array<string>, n array<int>")
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min(F.struct("words", "n")).alias("bag"))
    rows = rows.select("doc_id", "toxic", "bag.words", "bag.n").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    pool: dict[str, str] = {}  # a string for each word, however many examples have it
    pairs = zip(rows.column("words"), rows.column("n"), strict=True)
    examples = [{pool.setdefault(w, w): n for w, n in zip(ws.as_py(), ns.as_py(), strict=True)} for ws, ns in pairs]
    names, toxic_of, ids = set(pool), rows.column("toxic").to_pylist(), rows.column("doc_id").to_pylist()
    del rows, pairs

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents and how many of them have each word of the vocabulary."""
        count, total = Counter(), 0
        for batch in slices(batches, "text"):
            for t in batch.column(0).to_pylist():
                total += 1
                count.update(names.intersection(terms_of(t)))
        words = sorted(count)
        yield pa.RecordBatch.from_arrays([pa.array(["", *words]), pa.array([total, *[count[w] for w in words]], pa.int64())], ["word", "n"])

    # As many rows as the sample's texts have words.
    found = docs.select("text").mapInArrow(held, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))
    total = df.pop("", 0)
    idf = {w: math.log(1 + total / max(1, df.get(w, 0))) for w in names}
    del found, df
    return Neighbours(idf, examples, toxic_of, k, ids, float(share))


def score(docs: DataFrame, model: Neighbours | None) -> DataFrame:
    """doc_id, score, predicted, neighbours (ids of the nearest examples, nearest first) and similarities."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [model.judge(t) if model else (0.0, [], []) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([s for s, _, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _, _ in found], pa.int32())]
            cols += [pa.array([i for _, i, _ in found], pa.list_(batch.column(0).type)), pa.array([d for _, _, d in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "predicted", "neighbours", "similarities"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, neighbours array<{kind}>, similarities array<double>")


def op10_toxicity_knn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "neighbours", "similarities")
