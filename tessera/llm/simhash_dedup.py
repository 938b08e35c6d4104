"""SimHash near-duplicates: majority fingerprints of word shingles, linked through shard BK-trees.

Fingerprints within `radius` differing bits share at least one of radius + 1 bit blocks exactly, so every
fingerprint is dealt to the shards of its block values; equal texts are one fingerprint from here on. A
shard holds at most `shard` fingerprints: a larger block value is split into shards by hash, and the tree of
one shard meets the members of the other, so memory is bounded and no link is lost. Each shard's BK-tree
(children keyed by integer Hamming distance to the parent) is built and probed level by level in numpy,
following only edges within the radius; the trees travel with the shuffle to their probes instead of a
broadcast, as their number grows with the data. A shard gives its links as a spanning star of each local
component, never as all pairs. Components over all shards come from common.components. near_copies clusters texts by
fingerprints of several seeds and links those of a cluster whose word shingles are alike.

Edge cases: null text counts as empty; no words: fingerprint zero, linked like any other; fewer words than
the shingle: the whole sequence is the one shingle; null ids take part and count as larger than all others;
repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm.common import components, forget, hot_join, lean, materialise, partitions, slices


def fingerprints_of(text: str | None, width: int = 3, seeds: int = 1) -> list[int]:
    """64-bit majority fingerprints, unsigned, of ASCII-lower-cased word shingles (repeats count).

    The first takes the shingles' XXH64 as they are; further ones mix them anew and so are independent."""
    import numpy as np
    import xxhash

    # bytes.lower and bytes.split know exactly A-Z and \x20\x09-\x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * seeds
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    to = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), to.tolist(), strict=True)]), ">u8")
    out = []
    for seed in range(seeds):
        if seed:
            z = (h.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            bits = (z ^ (z >> np.uint64(32))).astype(">u8")
        else:
            bits = h
        bits = bits.view(np.uint8).reshape(n, 8)
        # At most 2**16 shingles at a time keep the unpacked bits small for very long texts.
        ones = sum(np.unpackbits(bits[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, 65536))
        out.append(int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, width: int = 3, carry: tuple[str, ...] = (), seeds: int = 1) -> DataFrame:
    """doc_id, the columns `carry`, fp (the fingerprint as a signed long) and more (those of further seeds)."""
    out = docs.select("doc_id", *carry)
    schema = StructType([*out.schema.fields, StructField("fp", LongType()), StructField("more", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, "text"):
            rows = [fingerprints_of(t.as_py(), width, seeds) for t in batch.column(batch.num_columns - 1)]
            fp = np.array(rows, np.uint64).view(np.int64).reshape(len(rows), seeds)
            more = pa.array(fp[:, 1:].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp[:, 0].copy()), more], schema.names)

    return docs.select("doc_id", *carry, "text").mapInArrow(lean(run), schema)


def _popcount(x):
    import numpy as np

    return np.bitwise_count(x).astype(np.int64)


class BKForest:
    """BK-trees of several groups at once, as arrays; the least row of a group is its root."""

    def __init__(self, values, groups):
        import numpy as np

        self.values = values
        n = len(values)
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        names, first, inverse = np.unique(groups, return_index=True, return_inverse=True)
        self.names, self.roots = names, first
        at = first[inverse]  # the node where each item stands
        items = np.flatnonzero(at != np.arange(n))
        at = at[items]
        while len(items):
            d = _popcount(values[items] ^ values[at])
            _, lead, inv = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = items[lead]  # the first item at a new distance becomes the child node
            self.parent[child], self.edge[child] = at[lead], d[lead]
            rest = np.ones(len(items), bool)
            rest[lead] = False
            at, items = child[inv][rest], items[rest]
        order = np.lexsort((self.edge, self.parent))
        self.kids = order[self.parent[order] >= 0]
        self.keys = self.parent[self.kids] * 65 + self.edge[self.kids]

    def within(self, probes, groups, radius: int, step: int = 65536) -> Iterator[tuple]:
        """Chunks (probe, node) of matches, following only edges from d - radius to d + radius."""
        import numpy as np

        where = np.searchsorted(self.names, groups)
        where = np.minimum(where, max(0, len(self.names) - 1))
        live = np.flatnonzero(self.names[where] == groups) if len(self.names) else np.zeros(0, np.int64)
        todo = [(live[i : i + step], self.roots[where[live[i : i + step]]]) for i in range(0, len(live), step)]
        while todo:
            p, node = todo.pop()
            d = _popcount(probes[p] ^ self.values[node])
            hit = d <= radius
            if hit.any():
                yield p[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            # The frontier is split, so memory stays bounded when many probes follow many edges.
            cuts = np.searchsorted(ends, np.arange(step, total, step)) + 1 if total > step else []
            for part in np.split(np.arange(len(p)), cuts):
                k = n[part]
                if s := int(k.sum()):
                    offset = np.arange(s) - np.repeat(np.cumsum(k) - k, k)
                    todo.append((np.repeat(p[part], k), self.kids[np.repeat(lo[part], k) + offset]))


def _union(root, a, b) -> None:
    """Join the sets of a[i] and b[i]; root is flat: each item points at the least item of its set."""
    import numpy as np

    while True:
        x, y = root[a], root[b]
        if not (x != y).any():
            return
        hi, lo = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def link_groups(fp, group, tree, probe, radius: int):
    """Spanning stars (u, v), as positions, of the fingerprints linked within each group.

    fp: uint64; group: int64; tree, probe: which rows are in the group's tree, and which are looked up."""
    import numpy as np

    root = np.arange(len(fp))
    t, q = np.flatnonzero(tree), np.flatnonzero(probe)
    forest = BKForest(fp[t], group[t])
    for p, node in forest.within(fp[q], group[q], radius):
        _union(root, q[p], t[node])
    v = np.flatnonzero(root != np.arange(len(fp)))
    return root[v], v


def _met(fps: DataFrame, radius: int, shard: int) -> DataFrame:
    """fps (fp and perhaps more, one of them seed) dealt to the shards of their block values; own tells a row's shard."""
    blocks = radius + 1
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    seed = F.col("seed") if "seed" in fps.columns else F.lit(0)
    keys, at = [], 0
    for i, w in enumerate(width):
        mask = (1 << w) - 1
        keys.append(F.struct((seed * blocks + i).alias("block"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(mask)).alias("part")))
        at += w
    rest = [c for c in fps.columns if c != "seed"]
    dealt = fps.select(*rest, F.inline(F.array(*keys)))
    size = dealt.groupBy("block", "part").count().where("count > 1")
    size = size.select("block", "part", F.ceil(F.col("count") / shard).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    met = dealt.join(size, ["block", "part"]).withColumn("own", own)
    met = met.select(*rest, "block", "part", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    met = met.select(*rest, "block", "part", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own")
    key = ["block", "part", "i", "j"]
    return met.repartition(partitions(fps.sparkSession), *key).sortWithinPartitions(*key, *rest[::-1])


def _groups(table):
    """group (a number by block value and pair of shards), tree and probe of the rows, sorted by them."""
    import numpy as np

    key = [table.column(c).to_numpy() for c in ("block", "part", "i", "j")]
    new = np.zeros(table.num_rows, np.int64)
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    own = table.column("own").to_numpy()
    return np.cumsum(new), own == key[2], own == key[3]


def _by_group(solve, most: int, key: tuple[str, ...] = ("block", "part", "i", "j"), weight: str | None = None):
    """A mapInArrow function that gives `solve` tables of whole groups, of about `most` rows (or sum of `weight`) or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        size = lambda t: int(np.sum(t.column(weight).to_numpy())) if weight else t.num_rows
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += size(b)
            if count >= most:
                table = pa.Table.from_batches(held)
                keys = [table.column(c).to_numpy() for c in key]
                same = np.all([k == k[-1] for k in keys], axis=0)
                cut = int(np.argmax(same))  # where the last, perhaps unfinished, group begins
                if cut:
                    yield solve(table.slice(0, cut))
                    rest = table.slice(cut)
                    held, count = rest.to_batches(), size(rest)
        if count or held:
            yield solve(pa.Table.from_batches(held))

    return lean(run)


def links(fps: DataFrame, radius: int = 3, shard: int = 20_000) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (column fp, distinct by column seed, if there is one) within the radius:
    between the fingerprints, or the values of column `row` where there is one."""
    name = "row" if "row" in fps.columns else "fp"

    def solve(table):
        fp, of = table.column("fp").to_numpy().view("uint64"), table.column(name).to_numpy()
        u, v = link_groups(fp, *_groups(table), radius)
        return pa.RecordBatch.from_arrays([pa.array(of[u]), pa.array(of[v])], ["u", "v"])

    return _met(fps, radius, shard).mapInArrow(_by_group(solve, 2 * shard), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, shard: int = 20_000) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) and linked (whether the fingerprint has links); one
    row for each row of docs."""
    fps = materialise(fingerprints(docs, width).drop("more"), "simhash-fp")
    least = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-least")
    comp = components(links(least.select("fp"), radius, shard), "simhash")
    roots = comp.join(least.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    of = comp.join(roots, "root").select(F.col("node").alias("fp"), "root", "component_id")
    of = least.join(of, "fp", "left").select(
        "fp",
        "n",
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("root").isNotNull().alias("linked"),
    )
    return hot_join(fps, of, "fp", fps.count()).select("doc_id", "fp", "component_id", "linked")


def shingle_hashes(docs: DataFrame, width: int) -> DataFrame:
    """row, cluster, grams (the distinct hashes of a text's word shingles, sorted; fewer words: the whole sequence; none:
    none) and n, their number and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in slices(batches, "text"):
            grams = []
            for text in batch.column(2):
                w = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                n = max(1, len(w) - width + 1) if w else 0
                grams.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(n)), np.uint64, n)).view(np.int64))
            size = pa.array([len(g) + 1 for g in grams], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.list_(pa.int64())), size], ["row", "cluster", "grams", "n"])

    return docs.select("row", "cluster", "text").mapInArrow(lean(run), "row bigint, cluster bigint, grams array<bigint>, n bigint")


def alike_sets(grams, size, comp, tree, probe, least: float, step: int = 1 << 22):
    """Stars (u, v), as positions, that join the components of sets with a Jaccard similarity of `least` or more.

    grams: all sets' items in a row, size: of each set; comp: each set's component so far; tree, probe: pairs of a
    probe with one in the tree count. Exact: two such sets share one of the first size - ceil(least * size) + 1 items
    of each, by any common order; the rarest come first, so texts that are not alike seldom meet. Sets of one
    component are not compared, so a group of copies costs about a comparison each."""
    import numpy as np

    total = len(size)
    _, root, inverse = np.unique(comp, return_index=True, return_inverse=True)
    root = root[inverse]
    begin = root.copy()
    none = np.flatnonzero(size == 0)
    if len(none) > 1:  # texts without words are equal
        root[np.isin(root, root[none])] = root[none].min()
    item = np.repeat(np.arange(total), size)
    _, code, df = np.unique(grams, return_inverse=True, return_counts=True)
    place = np.empty(len(df), np.int64)
    place[np.argsort(df, kind="stable")] = np.arange(len(df))
    rank = place[code]
    order = np.lexsort((rank, item))
    ends = np.cumsum(size)
    starts = ends - size
    nth = np.arange(len(order)) - np.repeat(starts, size)
    prefix = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    use = (nth < prefix[item]) & (df[code[order]] > 1)
    word, holder = rank[order][use], item[use]
    held = np.cumsum(use)
    upto = np.where(size > 0, held[np.maximum(ends - 1, 0)], 0) if len(held) else np.zeros(total, np.int64)
    upto = np.maximum.accumulate(upto) if total else upto
    in_tree = tree[holder]
    by_word = np.lexsort((holder[in_tree], word[in_tree]))
    post, key = holder[in_tree][by_word], word[in_tree][by_word]
    both = tree & probe
    left = len(np.unique(root))
    mark = np.zeros(len(df), bool)
    for a in np.flatnonzero(probe):
        if left == 1:
            break
        mine = word[(upto[a - 1] if a else 0) : upto[a]]
        if not len(mine):
            continue
        lo, hi = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
        found = np.unique(np.concatenate([post[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]))
        found = found[(root[found] != root[a]) & ~(both[found] & both[a] & (found < a))]
        found = found[np.minimum(size[found], size[a]) >= least * np.maximum(size[found], size[a]) - 1e-9]
        while len(found):
            some = found[: max(1, int(np.searchsorted(np.cumsum(size[found]), step)))]
            found = found[len(some) :]
            n = size[some]
            at = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mark[code[starts[a] : ends[a]]] = True
            shared = np.add.reduceat(mark[code[at]], np.cumsum(n) - n, dtype=np.int64)
            mark[code[starts[a] : ends[a]]] = False
            for b in some[shared >= least * (n + size[a] - shared) - 1e-9]:
                if root[a] != root[b]:
                    x, y = sorted((root[a], root[b]))
                    root[root == y] = x
                    left -= 1
            found = found[root[found] != root[a]]
    v = np.flatnonzero((root != begin) & (begin == np.arange(total)))
    return root[v], v


def _alike(dealt: DataFrame, key: tuple[str, ...], least: float, budget: int) -> DataFrame:
    """Edges (u, v) of the groups of dealt: key columns, row, grams, n, comp, tree, probe."""

    def solve(table):
        import numpy as np

        keys = [table.column(c).to_numpy() for c in key]
        cuts = np.flatnonzero(np.any([np.append(True, k[1:] != k[:-1]) for k in keys], axis=0)).tolist()
        row, comp = table.column("row").to_numpy(), table.column("comp").to_numpy()
        tree, probe = (table.column(c).to_numpy() for c in ("tree", "probe"))
        column = table.column("grams").combine_chunks()
        grams, size = column.flatten().to_numpy(), table.column("n").to_numpy() - 1
        ends = np.append(0, np.cumsum(size))
        u, v = [], []
        for a, b in zip(cuts, [*cuts[1:], len(row)], strict=True):
            if b - a > 1:
                x, y = alike_sets(grams[ends[a] : ends[b]], size[a:b], comp[a:b], tree[a:b], probe[a:b], least)
                u.append(row[a:b][x])
                v.append(row[a:b][y])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *u])), pa.array(np.concatenate([none, *v]))], ["u", "v"])

    dealt = dealt.repartition(partitions(dealt.sparkSession), *key).sortWithinPartitions(*key, "row")
    return dealt.select(*key, "row", "grams", "n", "comp", "tree", "probe").mapInArrow(_by_group(solve, budget, key, "n"), "u bigint, v bigint")


def _shares(rows: DataFrame, budget: int) -> DataFrame:
    """cluster, k: how many shares of about `budget` shingles a cluster's rows make; rows: its rows."""
    return rows.groupBy("cluster").agg(F.ceil(F.sum("n") / budget).cast("int").alias("k"), F.count("*").alias("rows"))


def _within_shares(rows: DataFrame, least: float, budget: int, salt: int) -> DataFrame:
    shares = _shares(rows, budget)
    dealt = hot_join(rows, shares, "cluster", rows.count(), "rows")
    yes = F.lit(True)
    dealt = dealt.withColumns({"i": F.pmod(F.xxhash64("row", F.lit(salt)), F.col("k")).cast("int"), "comp": F.col("row"), "tree": yes, "probe": yes})
    return _alike(dealt, ("cluster", "i"), least, budget)


def alike(rows: DataFrame, least: float, budget: int) -> DataFrame:
    """Edges (u, v) that connect all rows of a cluster (rows: row, cluster, grams, n; a table) whose sets are alike.

    Clusters of up to `budget` shingles are one group. Of a larger one, shares are joined each for itself, then one
    row of each component found, as long as that leaves fewer of them: what holds many copies of a text becomes one
    component. Only rows outside a cluster's largest component then meet all its shares, which makes the join whole."""
    edges = materialise(_within_shares(rows, least, budget, 0), "near-links")
    # Each holds over `budget` shingles, so there are at most that part of all shingles of them.
    big = materialise(_shares(rows, budget).where("k > 1").select("cluster"), "near-big")
    if big.isEmpty():
        return edges
    rows = materialise(rows.join(F.broadcast(big), "cluster", "left_semi"), "near-large")
    before, salt = None, 0
    while True:
        comp = components(edges, "near-comp").select(F.col("node").alias("row"), F.col("root").alias("comp"))
        of = materialise(rows.select("row", "cluster", "n").join(comp, "row", "left").withColumn("comp", F.coalesce("comp", "row")), "near-of")
        first = materialise(of.groupBy("cluster", "comp").agg(F.min("row").alias("row"), F.count("*").alias("rows")), "near-first")
        now = first.count()
        if before is not None and now > 0.8 * before:
            break
        before, salt = now, salt + 1
        few = materialise(rows.join(first.select("row"), "row", "left_semi"), "near-few")
        more = materialise(_within_shares(few, least, budget, salt), "near-links")
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
    main = first.groupBy("cluster").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"))
    placed = of.join(F.broadcast(main), "cluster").withColumn("rest", F.col("comp") != F.col("main"))
    shares = placed.groupBy("cluster").agg(
        F.ceil(F.sum("n") / budget).cast("int").alias("k"), F.ceil(F.sum(F.when(F.col("rest"), F.col("n"))) / budget).cast("int").alias("p")
    )
    placed = placed.join(F.broadcast(shares.where("p > 0")), "cluster")
    h = F.xxhash64("row")
    i, part = F.pmod(h, F.col("k")).cast("int"), F.pmod(h, F.col("p")).cast("int")
    cells = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    member = cells("p", lambda x: F.struct(i.alias("i"), x.alias("part"), F.lit(True).alias("tree"), F.lit(False).alias("probe")))
    probe = cells("k", lambda x: F.struct(x.alias("i"), part.alias("part"), F.lit(False).alias("tree"), F.lit(True).alias("probe")))
    probe = F.when(F.col("rest"), probe).otherwise(F.slice(probe, 1, 0))
    dealt = placed.select("row", "comp", F.inline(F.concat(member, probe))).join(rows, "row")
    return edges.unionByName(materialise(_alike(dealt, ("cluster", "i", "part"), least, budget), "near-links"))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, seeds: int = 8, radius: int = 3, shard: int = 20_000, budget: int = 1 << 21) -> DataFrame:
    """row, component: rows of docs (row, text) that are near copies of others, with their group.

    Fingerprints of two-word shingles, by several seeds (an edit changes fewer of them than of longer ones, so more
    copies come within the radius), are linked as in near_duplicates; what they connect is a cluster. Within a cluster
    two texts link if their distinct `width`-word shingles have a Jaccard similarity of `least` or more, found by an
    exact set join (alike), so no pair of a cluster is missed and none is emitted. Two texts without words are equal.
    budget: shingles that a task holds at a time. Rows without a link are left out."""
    fps = fingerprints(docs.select(F.col("row").alias("doc_id"), "row", "text"), 2, carry=("row",), seeds=seeds)
    fps = materialise(fps.select("row", F.posexplode(F.concat(F.array("fp"), "more")).alias("seed", "fp")), "near-fp")
    first = materialise(fps.groupBy("seed", "fp").agg(F.min("row").alias("row"), F.count("*").alias("n")), "near-first")
    # Rows of one fingerprint link to its first row, the first rows to each other.
    again = first.where("n > 1").select(F.struct("seed", "fp").alias("key"), F.col("row").alias("u"), "n")
    same = hot_join(fps.select(F.struct("seed", "fp").alias("key"), "row"), again, "key", fps.count())
    same = same.where("u <> row").select("u", F.col("row").alias("v"))
    edges = links(first.select("seed", "fp", "row"), radius, shard).unionByName(same)
    close = components(edges, "near-clusters").select(F.col("node").alias("row"), F.col("root").alias("cluster"))
    grams = materialise(shingle_hashes(docs.select("row", "text").join(close, "row"), width), "near-grams")
    forget(fps)
    comp = components(alike(grams, least, budget), "near")
    return comp.select(F.col("node").alias("row"), F.col("root").alias("component"))


def op3_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
