"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Each task packs its own rows as they come, a bounded number of tokens at a time, so nothing is shuffled. A
document gives whole windows of `capacity` ids and a tail; the tails are partitioned into windows by
multiway differencing: partial partitions (one subset per window, by size) are merged, the two with the
largest spread first and with opposing imbalances, until one near-equal partition is left.

Without cutting (pack_whole), the window count rises whenever a window exceeds the capacity. With cutting,
as in pack(), the tokens beyond a multiple of the capacity are first set apart in windows of powers of two,
and the little that differencing leaves above the capacity is cut off and moved to the windows below it: no
window is padded.

Edge cases: null or empty text has only the closing id; repeated rows and null ids are packed each for
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from unicodedata import is_normalized

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, lean, slices

TOKENIZER = "word_bpe_49k.json"
_tokenizers: dict[str, WordTokens] = {}


class WordTokens:
    """Token ids of texts, by a tokenizers file that drops white space and never looks across it.

    Texts are cut at ASCII white space and before closing punctuation - both are ends of the tokenizer's own
    words - and each distinct piece is tokenized once. New pieces of letters only are tokenized in one
    line, told apart by the ids that end words. Where a text could be read differently in pieces (combining
    marks, special tokens), its batch is cut at white space only."""

    CLOSING = "!#$%&()*+,-./:;=?@[\\]^`{|}~"

    def __init__(self, path: str, most: int = 200_000):
        import os

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.most = Tokenizer.from_file(path), most
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.code: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _one_word(s: str) -> bool:
        if s.isascii():
            return s.isalpha()
        return s.isalpha() and is_normalized("NFC", s) and s.lower().isalpha()

    def _add(self, new: list[str], ids, size) -> None:
        import numpy as np

        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def _learn(self, pieces: list[str]) -> None:
        import numpy as np

        code = self.code
        new = [w for w in pieces if w not in code]
        if len(code) + len(new) > self.most:
            self.forget()
            code, new = self.code, pieces
        line = [w for w in new if self._one_word(w)]
        if line:
            ids = np.array(self.model.encode(" ".join(line), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(line):
                self._add(line, ids, np.diff(at, prepend=-1))
                new = [w for w in new if w not in self.code]
        if new:
            each = [e.ids for e in self.model.encode_batch(new, add_special_tokens=False)]
            size = np.fromiter(map(len, each), np.int64, len(each))
            self._add(new, np.array([i for x in each for i in x], np.uint32), size)

    def _pieces(self, words: pa.Array) -> pa.Array:
        """Each word as two pieces: up to its closing punctuation, and that."""
        import numpy as np

        words = pa.concat_arrays([words])
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
        start, end = offsets[:-1], offsets[1:]
        cut = start + pc.binary_length(pc.ascii_rtrim(words, self.CLOSING)).to_numpy()
        last, before = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
        ascii_word = (last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 48) & (last <= 57)
        latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)  # the letters of Latin-1
        cut = np.where((cut > start) & (ascii_word | latin), cut, end)
        both = np.empty(2 * len(words) + 1, np.int32)
        both[0:-1:2], both[1::2], both[-1] = start, cut, offsets[-1]
        return pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(both), words.buffers()[2])

    def encode(self, texts: pa.Array):
        """(ids of all texts, offsets of the texts in them)."""
        import numpy as np

        texts = texts.fill_null("").cast(pa.string())
        odd = pc.or_(pc.match_substring_regex(texts, r"\p{M}"), pc.match_substring(texts, "<|"))
        plain = not pc.any(odd).as_py()
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if plain else texts)
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        words = split.flatten()
        if plain and len(words):
            words, offsets = self._pieces(words), 2 * offsets
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        self._learn(names)
        code = self.code
        own = np.fromiter((code[w] for w in names), np.int64, len(names))
        at = own[coded.indices.to_numpy()] if len(names) else own
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])
        return self.pool[where], ends[offsets]


def tokens_of(path: str | None) -> WordTokens:
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: items (by index) in k subsets of near-equal sums."""
    import numpy as np

    if not sizes:
        return [[] for _ in range(k)]
    kids: list[tuple[int, int]] = []
    n = len(sizes)

    def single(i: int):
        s, x = np.zeros(k, np.int64), np.full(k, -1)
        s[0], x[0] = sizes[i], i
        return s, x

    heap: list = [(-s if k > 1 else 0, i, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        (s, x), (t, y) = a or single(i), b or single(j)
        t, y = t[::-1], y[::-1]
        s, both = s + t, np.flatnonzero((x >= 0) & (y >= 0))
        node = np.maximum(x, y)
        node[both] = n + len(kids) + np.arange(len(both))
        kids += zip(x[both].tolist(), y[both].tolist(), strict=True)
        order = np.argsort(-s, kind="stable")
        s, node = s[order], node[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), count, (s, node)))
        count += 1
    _, i, a = heap[0]
    out = []
    for top in (a or single(i))[1].tolist():
        items, todo = [], [top] if top >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += kids[x - n]
        out.append(sorted(items))
    return out


def pack_whole(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of whole items; the count rises until none exceeds the capacity. No item may exceed it."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while k:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1
    return []


def pack_cut(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length), each window full or a power of two. No item may exceed the capacity."""
    rest = sum(sizes) % capacity
    left = list(sizes)
    apart: list[tuple[int, int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if not rest:
            break
        n = min(rest, left[i])
        left[i] -= n
        rest -= n
        apart.append((i, left[i], n))
    items = [i for i, n in enumerate(left) if n]
    k = sum(left) // capacity
    windows: list[list[tuple[int, int, int]]] = []
    spare: list[tuple[int, int, int]] = []
    for members in differencing([left[i] for i in items], k) if k else []:
        window, room = [], capacity
        for j in members:
            i = items[j]
            n = min(left[i], room)
            if n:
                window.append((i, 0, n))
            if n < left[i]:
                spare.append((i, n, left[i] - n))
            room -= n
        windows.append(window)
    spare = _fill(windows, [capacity - sum(n for _, _, n in w) for w in windows], spare)
    total = sum(n for _, _, n in apart)
    small = [1 << b for b in reversed(range(capacity.bit_length())) if total >> b & 1]
    tail: list[list[tuple[int, int, int]]] = [[] for _ in small]
    _fill(tail, small, apart)
    return windows + tail


def _fill(windows: list[list], rooms: list[int], pieces: list[tuple[int, int, int]]) -> list:
    """Cut the pieces into the rooms; their sums agree."""
    todo = list(reversed(pieces))
    for window, room in zip(windows, rooms, strict=True):
        while room:
            i, start, n = todo.pop()
            if n > room:
                todo.append((i, start + room, n - room))
                n = room
            window.append((i, start, n))
            room -= n
    return todo


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, close: int = 1, buffer: int = 1 << 20) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length.

    tokenizer: path of a tokenizers file that drops white space. buffer: tail tokens packed at a time."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        model = tokens_of(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        tails: list[tuple] = []
        held = 0

        def put(doc, start, ids, total, offset, length):
            rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset, length))

        def flush():
            nonlocal sequence
            for window in pack_cut([len(ids) for _, _, ids, _ in tails], capacity):
                offset, length = 0, sum(n for _, _, n in window)
                for i, a, n in window:
                    doc, start, ids, total = tails[i]
                    put(doc, start + a, ids[a : a + n], total, offset, length)
                    offset += n
                sequence += 1

        def batch():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [doc_kind, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"]
        doc_kind = pa.int64()
        for part in slices(batches, "text", 1 << 20):
            doc_kind = part.column(0).type
            flat, offsets = model.encode(part.column(1))
            for doc, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = np.append(flat[a:b], np.uint32(close))
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    put(doc, start, ids[start : start + capacity], len(ids), 0, capacity)
                    sequence += 1
                if whole < len(ids):
                    tails.append((doc, whole, ids[whole:], len(ids)))
                    held += len(ids) - whole
                if held >= buffer:
                    flush()
                    tails, held = [], 0
                    give_back()
                if len(rows) >= 2000:
                    yield batch()
            del part, flat
        flush()
        if rows:
            yield batch()
        model.forget()  # a task meets more pieces than are kept, so its successors gain little by them

    return docs.select("doc_id", "text").mapInArrow(
        lean(run),
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint",
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op7_kk_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
