"""Near duplicates by an LSH forest over MinHash signatures, with every link confirmed on full shingle sets.

1. One pass over the texts makes, for each document, the size of its set of word shingles, a digest of its word sequence and a
   MinHash signature. Documents of equal sequences become one node, named by the digest.
2. Each tree of the forest sorts the nodes by another order of their signature values (a range-partitioned sort, which splits
   groups of any size). Neighbours with a common prefix of at least `depth` values are candidates: the nearest `near`
   neighbours, and all pairs of a region, where a region is the longest prefix that a pair shares, if it has at most `region`
   members. A larger region so goes deeper until it fits, each region to its own depth.
3. Candidates are confirmed on the full sets. First those that share most with each node; what joins by these needs no further
   confirming, and all other candidates between different components follow.
4. Regions of the least depth that are larger than `region` and still hold several components are compared in full across
   components: signatures first, then, in the same task, the full shingle sets of the pairs whose signatures agree in `least` of
   their values. A region of more than `block` nodes is dealt to blocks, and each pair of blocks is a group of its own, so that
   no task holds more than two blocks. A region of more than `deep` nodes goes deeper instead: its nodes are planted in
   `deep_trees` further orders of twice the depth, whose regions are compared in the same way. A group of copies has joined by
   now and costs nothing here.
5. Components by contraction: each round joins nodes to their least neighbours and is a written table.

A link is missed only if none of the trees gives its ends, or a chain of links between them, a common prefix, with probability
(1 - 0.8**4)**16 = 0.0002 at similarity 0.8 and the defaults, or (1 - 0.8**8)**48 = 0.0002 in regions that went deeper, or, in
step 4, if its signatures agree in less than `least` of their values (0.0007 at 0.8). Partitions of the sorted trees cut regions
at their borders: of R rows a task (ROWS at least), a region of m rows is cut in a tree with probability m / R or less, which
costs it that tree alone, (1 - 0.8**4)**15 instead of 16; regions of step 4 are not cut.

Empty or null texts have no shingles and link with nothing. Texts of fewer words than a shingle are one shingle. Rows without
doc_id link by their text, but their id is no component's name unless all its rows lack one (then null; kept is true). Repeated
rows share a component and are all marked as kept if the first is. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import kept, slices, small, sole, texts_of, with_columns

#: Words held by a Python worker; beyond, it starts anew.
HELD = 250_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Rows of the sorted trees that a task holds, about.
ROWS = 400_000


@dataclass(frozen=True)
class Forest:
    """shingle: words in a shingle. percent: least 100 * intersection / union of a link. trees, depth: see the module."""

    shingle: int = 4
    percent: int = 80
    trees: int = 16
    depth: int = 4
    levels: int = 8
    near: int = 3
    region: int = 16
    first: int = 2
    least: float = 0.64
    block: int = 256
    deep: int = 2048
    deep_trees: int = 48

    @property
    def values(self) -> int:
        return self.trees * self.depth


class Shingles:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width, self.held = width, {}

    def words(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").lower().split()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.held) > HELD:
            self.held.clear()
        held = self.held
        try:
            ids = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in held:
                    held[w] = xxhash.xxh3_64_intdigest(w)
            ids = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(ids))
        n = len(ids) - width + 1
        mixed = np.full(n, np.uint64(width))
        for k in range(width):
            mixed = (mixed ^ ids[k : k + n]) * MULTIPLY
            mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        return mixed[np.r_[True, mixed[1:] != mixed[:-1]]]


def shingles(width: int) -> Shingles:
    return sole(("shingles", width), lambda: Shingles(width))


@lru_cache(4)
def hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240229))
    return r.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, np.uint64)


def signature(found: np.ndarray, n: int) -> np.ndarray:
    """The least values of n hash functions over a set, as unsigned 32-bit numbers."""
    a, b = hashes(n)
    least = np.full(n, np.uint64(2**64 - 1))
    for k in range(0, len(found), 1024):
        np.minimum(least, (a[:, None] * found[k : k + 1024] + b[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def facts(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, text_key, n_shingles, node (null without words), signature."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingles(forest.shingle)
        for batch in slices(batches):
            sizes, nodes, signatures = [], [], []
            for text in texts_of(batch):
                words = sets.words(text)
                found = sets(words)
                sizes.append(len(found))
                nodes.append(blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                signatures.append(signature(found, forest.values).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())], names)

    names = ["doc_id", "text_key", "n_shingles", "node", "signature"]
    keyed = with_columns(docs, {"doc_id": "long", "text": "string"}).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(find, "doc_id long, text_key long, n_shingles long, node binary, signature binary")


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return raw.view(kind).reshape(-1, width)


def orders(forest: Forest) -> list[list[int]]:
    """Which signature values each tree of the forest takes first."""
    return [[t * forest.depth + k for k in range(forest.depth)] for t in range(forest.trees)]


def deeper(forest: Forest) -> list[list[int]]:
    """Further orders, of twice the depth."""
    r = np.random.Generator(np.random.PCG64(20240301))
    return [r.permutation(forest.values)[: 2 * forest.depth].tolist() for _ in range(forest.deep_trees)]


def planted(nodes: DataFrame, order: list[list[int]], width: int) -> DataFrame:
    """tree, prefix (the first values of the tree's order, big-endian), node: a row for each node and tree."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, "signature"):
            values = _matrix(batch.column("signature"), width, np.uint32)
            for tree, at in enumerate(order):
                raw = np.ascontiguousarray(values[:, at].astype(">u4")).tobytes()
                keys = [raw[k : k + 4 * len(at)] for k in range(0, len(raw), 4 * len(at))]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(keys), pa.int32()), pa.array(keys, pa.binary()), batch.column("node")], ["tree", "prefix", "node"])

    return nodes.select("node", "signature").mapInArrow(plant, "tree int, prefix binary, node binary")


def candidates(nodes: DataFrame, forest: Forest) -> DataFrame:
    """a, b, shared: pairs of nodes with the sum of their common prefixes over the trees that found them."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        keys = _matrix(rows.column("prefix"), forest.levels, ">u4")
        keys = np.c_[rows.column("tree").to_numpy().astype(np.uint32), keys.astype(np.uint32)]
        n, names = len(keys), rows.column("node").to_pylist()
        changes = np.logical_or.accumulate(keys[1:] != keys[:-1], axis=1)
        sizes = []  # members of each row's region, by depth
        for depth in range(forest.levels + 1):
            starts = np.flatnonzero(np.r_[True, changes[:, depth]])
            size = np.diff(np.r_[starts, n])
            sizes.append(np.repeat(size, size))
        sizes = np.array(sizes)
        for lag in range(1, min(forest.region, n)):
            same = np.flatnonzero((keys[:-lag, : forest.depth + 1] == keys[lag:, : forest.depth + 1]).all(1))
            if not len(same):
                continue
            depth = np.logical_and.accumulate(keys[same, 1:] == keys[same + lag, 1:], axis=1).sum(1)
            if lag > forest.near:
                fits = sizes[depth, same] <= forest.region
                same, depth = same[fits], depth[fits]
            pairs = [(min(names[i], names[i + lag]), max(names[i], names[i + lag])) for i in same.tolist()]
            for k in range(0, len(pairs), 1 << 16):
                part = pairs[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.binary()), pa.array([p[1] for p in part], pa.binary()), pa.array(depth[k : k + (1 << 16)].astype(np.int64))], ["a", "b", "depth"])

    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * forest.trees // ROWS)
    order = [[(t * forest.depth + k) % forest.values for k in range(forest.levels)] for t in range(forest.trees)]
    in_order = planted(nodes, order, forest.values).repartitionByRange(n, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    return in_order.mapInArrow(neighbours, "a binary, b binary, depth long").groupBy("a", "b").agg(F.sum("depth").alias("shared"))


def confirmed(pairs: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: node, text."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingles(forest.shingle)
        last, found = None, None
        for batch in slices(batches, 256, "a_text"):
            kept_a, kept_b = [], []
            for a, b, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text")), strict=True):
                if a != last:
                    last, found = a, sets(sets.words(s))
                other = sets(sets.words(t))
                both = np.concatenate([found, other])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= forest.percent * (len(both) - common):
                    kept_a.append(a)
                    kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.binary()), pa.array(kept_b, pa.binary())], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(compare, "a binary, b binary")


def sets_of(wanted: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """node, shingles (the sorted hashes of its full set) of wanted's node, doc_id, text_key. docs: doc_id, text, text_key."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingles(forest.shingle)
        for batch in slices(batches):
            found = [sets(sets.words(t)).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.large_binary()).cast(pa.binary())], ["node", "shingles"])

    return texts_of_nodes(wanted, docs).mapInArrow(hashed, "node binary, shingles binary")


def texts_of_nodes(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_key") == F.col("w.text_key"))
    return docs.alias("t").join(small(wanted).alias("w"), same).select("w.node", "t.text").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked(labels: np.ndarray, signatures: np.ndarray, first: np.ndarray, sets: list[np.ndarray], tree: int, order: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Links between rows of different labels that join them all as far as their sets are similar.

    first: which rows are of the first block; a pair has one of either block, or both of the only one. A pair that shares an
    earlier tree's prefix is met there. The likeliest pairs are confirmed first, and pairs that have joined by then are done.
    """
    alone, low, found = first.all(), [], []
    for i in np.flatnonzero(first).tolist():
        to = np.flatnonzero((labels != labels[i]) & (~first if not alone else np.arange(len(labels)) > i))
        agree = (signatures[to] == signatures[i]).sum(1)
        keep = agree >= forest.least * forest.values
        to, agree = to[keep], agree[keep]
        if tree and len(to):
            early = (signatures[to][:, order[:tree]] == signatures[i][order[:tree]]).all(2).any(1)
            to, agree = to[~early], agree[~early]
        low += zip((-agree).tolist(), [i] * len(to), to.tolist(), strict=True)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    for _, i, j in sorted(low):
        a, b = top(int(labels[i])), top(int(labels[j]))
        if a != b and similar(sets[i], sets[j], forest.percent):
            up[a] = b
            found.append((i, j))
    return found


def across(nodes: DataFrame, labels: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """a, b: links between different components, confirmed, in regions of the least depth that are large (step 4)."""
    named = kept(nodes.select("node", "doc_id", "text_key", "signature").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")

    def crowded(rows: DataFrame, least: int) -> DataFrame:
        """tree, prefix, n, node of the rows whose region has more than `least` nodes and several components."""
        parts = rows.join(named.select("node", "label"), "node").groupBy("tree", "prefix", "label").agg(F.count("*").alias("n"))
        regions = parts.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.count("*").alias("labels"))
        regions = kept(regions.where((F.col("n") > least) & (F.col("labels") > 1)).drop("labels"), "regions")
        return kept(rows.join(small(regions), ["tree", "prefix"]), "crowded")

    first = crowded(planted(nodes, orders(forest), forest.values), forest.region)
    wanted = kept(named.join(first.select("node").distinct(), "node", "left_semi"), "wanted")
    known = kept(wanted.select("node", "label", "signature").join(sets_of(wanted.select("node", "doc_id", "text_key"), docs, forest), "node"), "sets")
    far = wanted.join(first.where(F.col("n") > forest.deep).select("node").distinct(), "node", "left_semi")
    second = crowded(planted(far, deeper(forest), forest.values), 1)

    def met(members: DataFrame, order: list[list[int]]) -> DataFrame:
        order = np.array(order)

        def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            names = group.column("node").to_pylist()
            _, label = np.unique(np.array([x.hex() for x in group.column("label").to_pylist()]), return_inverse=True)
            values = _matrix(group.column("signature"), forest.values, np.uint32)
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            pairs = linked(label, values, group.column("own").to_numpy() == key[2].as_py(), sets, key[0].as_py(), order, forest)
            return pa.table({"a": pa.array([min(names[i], names[j]) for i, j in pairs], pa.binary()), "b": pa.array([max(names[i], names[j]) for i, j in pairs], pa.binary())})

        blocks = F.ceil(F.col("n") / forest.block).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("tree", "prefix", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node").join(known, "node")
        return dealt.select("tree", "prefix", "low", "high", "own", "node", "label", "signature", "shingles").groupBy("tree", "prefix", "low", "high").applyInArrow(compare, "a binary, b binary")

    return met(first.where(F.col("n") <= forest.deep), orders(forest)).union(met(second, deeper(forest))).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of one task."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((top(a), top(b)))
            up[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.binary()), pa.array([top(x) for x in up], pa.binary())], ["node", "label"])


def components(edges: DataFrame, alone: int = 15_000) -> DataFrame:
    """node, label: a name of the component of each node of the edges (a, b), the same for all of its nodes.

    Each round joins every node to its least neighbour and goes on with the edges between what remains, which are ever fewer.
    Names are digests, so chains of ever lesser neighbours are short. At most `alone` edges are finished by one task.
    """
    edges = kept(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        n = edges.count()
        if n <= alone:
            to = edges.repartition(1).mapInArrow(_united, "node binary, label binary")
        else:
            least = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
            least = kept(least, "least")
            to = least.join(least.select(F.col("node").alias("label"), F.col("label").alias("above")), "label").select("node", F.col("above").alias("label"))
        to = kept(to, "to")
        if labels is None:
            labels = to
        elif n:
            labels = kept(labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("above")), "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")
        if n <= alone:
            return labels
        at = lambda end: to.select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("a_to != b_to")
        edges = kept(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reached over links), kept (doc_id = component_id) for each row."""
    known = kept(facts(docs, forest), "facts")
    firsts = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("one")
    nodes = kept(known.where("node is not null").groupBy("node").agg(firsts, F.first("signature").alias("signature")).select("node", "one.doc_id", "one.text_key", "signature"), "nodes")
    pairs = kept(candidates(nodes, forest), "pairs")
    read = with_columns(docs, {"doc_id": "long", "text": "string"}).withColumn("text_key", F.xxhash64("text"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = kept(nodes.join(ends, "node", "left_semi").select("node", "doc_id", "text_key"), "wanted")
    texts = kept(texts_of_nodes(wanted, read), "texts")
    each = pairs.select("a", "b", "shared").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    first = kept(each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= forest.first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first")
    links = kept(confirmed(first, texts, forest), "links")
    labels = components(links)
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    rest = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").where("a_label is null or b_label is null or a_label != b_label").select("a", "b")
    more = kept(confirmed(rest, texts, forest), "links")
    links = links.union(more)
    if not more.isEmpty():
        labels = components(links)
    left = kept(across(nodes, labels, read, forest), "across")
    if not left.isEmpty():
        labels = components(links.union(left))
    joined = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = joined.join(joined.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("node", "component_id")
    found = known.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    named_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", named_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(True)))
