"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Documents are sets of SHINGLE-word shingles (lower-cased, cut at white space). Every document has a path of MAX_DEPTH MinHash
labels in each of TREES prefix tries. The recall target says how far a matched prefix is shortened at most: to the longest depth
at which a pair at the threshold shares a node of some trie with probability TARGET or more. Documents that share no such node
with any other are done.

The others are sorted along each trie, so those with the longest common prefixes stand next to each other. From MAX_DEPTH down to
that depth, the documents of a node are compared by the share of labels that agree in all tries, and joined if it may be that of
a pair at the threshold (REACH standard deviations below it, which loses one pair in a thousand million). A document's prefix is
shortened only towards documents that it has not been joined with by a longer one. Nodes of more than NODE documents join all of
theirs without that look, by one edge each.

Documents with the same set are one class from the start. The connected parts of what the forest joins are verified as wholes by
the exact Jaccard similarity of whole shingle sets: all their members against each other, in blocks of at most BLOCK by BLOCK, in
memory. Tasks return a row a member (its links, its part's smallest), never a row a pair. So a
group of thousands of near copies costs its comparisons but no row for each, and a large group is spread over many tasks.

Defined results: one row a doc_id with class_id (the smallest id of its group of linked documents) and n_links (documents,
copies included, at the threshold or above). Null and empty texts have no shingles and no links, texts of fewer than SHINGLE
words one shingle; rows that repeat an id count as links of each other only if their texts do as documents would, and the id's
row holds the smallest class and the most links; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET = 32, 8, 0.9999
#: Documents of a node that are compared by their labels, and standard deviations below the threshold that are still joined.
NODE, REACH = 256, 6.0
#: Members of one side of a block of comparisons, and shingles of it compared at once; both bound memory alone.
BLOCK, COLUMNS = 512, 8192
_MOST_WORDS = 1 << 18


def prefix_depth(trees: int = TREES, threshold: float = THRESHOLD, target: float = TARGET, longest: int = MAX_DEPTH) -> int:
    """The longest prefix that finds pairs at the threshold in one of the trees with probability target."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return found


_words = _Words()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's shingles."""
    words = text.lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    found = np.full(n, np.uint64(min(len(h), size)))
    for j in range(min(size, len(h))):
        found = (found ^ (found >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(found ^ (found >> np.uint64(32)))


_random = np.random.default_rng(11)
_FACTORS = (_random.integers(0, 2**32, TREES * MAX_DEPTH, np.uint64) | 1).astype(np.uint32)
_OFFSETS = _random.integers(0, 2**32, TREES * MAX_DEPTH, np.uint64).astype(np.uint32)


def labels(found: np.ndarray) -> np.ndarray:
    """TREES paths of MAX_DEPTH MinHash labels."""
    columns = TREES * MAX_DEPTH
    low = np.full(columns, 0xFFFFFFFF, np.uint32)
    x32 = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    for s in range(0, len(x32), 2048):
        x = x32[s : s + 2048, None] * _FACTORS + _OFFSETS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(axis=0), out=low)
    return low.reshape(TREES, MAX_DEPTH)


def node_keys(paths: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key for the node at a depth of each trie."""
    key = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(depth):
        key = (key ^ (key >> np.uint64(29)) ^ paths[:, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def signed(docs: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """doc_id, set_key (128 bits; null without shingles), keys (the node at depth in each trie), paths (a byte of each label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets, keys, paths = [], [], []
            for t in b["text"]:
                found = shingles(t)
                own = labels(found) if len(found) else None
                sets.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(None if own is None else node_keys(own, depth))
                paths.append(None if own is None else own.astype(np.uint8).tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "set_key": sets, "keys": keys, "paths": paths})

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("doc_id").isNotNull())
    return narrow.mapInPandas(run, "doc_id string, set_key binary, keys array<long>, paths binary").select(F.col("doc_id").cast("long").alias("doc_id"), "set_key", "keys", "paths")


def joined_within(node: np.ndarray, key: np.ndarray, tail: np.ndarray, paths: np.ndarray, depth: int, least: float) -> np.ndarray:
    """For each row the smallest row of its node that it is joined with, through others or directly.

    Rows are sorted by (key, tail): a trie below its nodes at depth; tail holds the labels behind it. node tells documents apart.
    """
    n = len(node)
    root = np.arange(n)
    for length in range(tail.shape[1], -1, -1):
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (tail[1:, :length] != tail[:-1, :length]).any(axis=1)
        begins = np.flatnonzero(new)
        end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
        edges = []
        for step in range(1, int((end - np.arange(n)).max(initial=1))):
            i = np.flatnonzero(np.arange(n) + step < end)
            i = i[root[i] != root[i + step]]
            for s in range(0, len(i), 1 << 15):
                some = i[s : s + (1 << 15)]
                edges.append(some[(paths[some] == paths[some + step]).mean(axis=1) >= least])
                edges[-1] = np.stack([edges[-1], edges[-1] + step])
        if edges:
            a, b = np.concatenate(edges, axis=1)
            while True:
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, before[a], low)
                np.minimum.at(root, before[b], low)
                root = root[root]
                if (root == before).all():
                    break
    return root


def forest_edges(rows: DataFrame, depth: int, threshold: float) -> DataFrame:
    """a, b: documents that the nodes of rows (key, tree, node, paths) join. A node's rows are one task's, NODE at most."""
    least = threshold - REACH * (threshold * (1 - threshold) / (TREES * MAX_DEPTH)) ** 0.5

    def done(b: pd.DataFrame) -> pd.DataFrame:
        paths = np.frombuffer(b"".join(b["paths"]), np.uint8).reshape(len(b), TREES, MAX_DEPTH)
        tail = paths[np.arange(len(b)), b["tree"].to_numpy(), depth:]
        key, node = b["key"].to_numpy(), b["node"].to_numpy()
        order = np.lexsort((node, *tail.T[::-1], key))
        key, tail, node = key[order], tail[order], node[order]
        root = joined_within(node, key, tail, paths.reshape(len(b), -1)[order], depth, least)
        some = np.flatnonzero(node != node[root])
        return pd.DataFrame({"a": node[some], "b": node[root[some]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            whole = held["key"] != held["key"].iloc[-1] if len(held) else []
            if len(held) and whole.any():
                yield done(held[whole])
                held = held[~whole]
        if held is not None and len(held):
            yield done(held)

    return rows.select("key", "tree", "node", "paths").repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node of its part) for the nodes of edges (a, b), by alternating large and small stars.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path. Only sums of hashes
    come to the driver, to tell when nothing changes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, name)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        now = written(joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), name)
        after = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Shingles that one member alone holds are left out, the rest taken COLUMNS at a time."""
    sizes = np.array([len(s) for s in sets])
    value, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    member = member[shared]
    column = np.cumsum(count > 1)[column[shared]] - 1
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [s, s + COLUMNS])
        x = np.zeros((len(sets), int(column[b - 1]) - s + 1), np.float32)
        x[member[a:b], column[a:b] - s] = 1
        out += x @ x.T
    out[np.arange(len(sets)), np.arange(len(sets))] = sizes
    return out


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which members are at the threshold or above; none with itself."""
    both, sizes = overlaps(sets), np.array([len(s) for s in sets])
    found = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    np.fill_diagonal(found, False)
    return found


def verify(group: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Rows (node, near: the smallest linked node, links) of one block of comparisons; several parts may share it."""
    out = []
    for _, part in group.drop_duplicates(["part", "node"]).groupby("part", sort=False):
        if len(part) < 2:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        found = linked(sets, threshold)
        node, copies, side = part["node"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
        if (i := part["i"].iloc[0]) != part["j"].iloc[0]:
            found &= side[:, None] != side[None, :]
        del i
        links = found @ copies
        # The smallest node that each reaches within the block.
        root = node.copy()
        while True:
            new = np.minimum(root, np.where(found, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == root).all():
                break
            root = new
        some = links > 0
        out.append(pd.DataFrame({"node": node[some], "near": root[some], "links": links[some]}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "near": [], "links": []}).astype("int64")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links."""
    depth = prefix_depth(threshold=threshold)
    signs = written(signed(docs, doc_id, text, depth), "signs")
    classes = written(signs.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("copies"), F.first("keys").alias("keys"), F.first("paths").alias("paths")), "classes")
    keyed = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    nodes = written(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "low", "n"), "nodes")
    shared = keyed.join(nodes.hint("merge"), "key")
    few = shared.where(F.col("n") <= NODE).join(classes.select("node", "paths").hint("merge"), "node")
    many = shared.where((F.col("n") > NODE) & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b"))
    stars = written(forest_edges(few, depth, threshold).unionByName(many).distinct(), "edges")
    parts = written(components(stars, "candidates"), "parts")
    sizes = written(parts.groupBy(F.col("root").alias("part")).agg(F.count("*").alias("size")), "sizes")
    members = written(parts.withColumnRenamed("root", "part").join(sizes, "part").join(classes.select("node", "copies", "set_key"), "node"), "members")
    total = members.count()
    verified = blocks(docs, members, doc_id, text, max(1, total // BLOCK)).groupBy("bucket", "i", "j").applyInPandas(lambda g: verify(g, threshold), "node long, near long, links long")
    verified = written(verified, "verified")
    groups = components(verified.select(F.col("node").alias("a"), F.col("near").alias("b")), "groups")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("set_key", "node", "copies").join(groups, "node", "left").join(links, "node", "left")
    known = known.select("set_key", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    found = signs.select("doc_id", "set_key").join(known, "set_key", "left")
    return found.groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"))


def blocks(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """The nodes with their shingles, once for each block of comparisons that they are in: bucket, i, j, side.

    Parts of up to BLOCK members share buckets; larger ones have blocks (i, j) of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, b["set_key"], strict=True)]
            b = b.drop(columns=["text", "set_key"])
            b["shingles"] = [s.tobytes() for s in sets]
            yield b[same]

    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    # nodes grow with the corpus: joined by a shuffle at every size, never broadcast.
    held = texts.join(nodes.hint("merge"), "node").mapInPandas(run, "node long, part long, size long, copies long, shingles binary")
    n = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    side = F.pmod(F.xxhash64("node"), n).cast("int")
    bucket = F.when(n > 1, -1 - F.pmod(F.col("part"), F.lit(2**62))).otherwise(F.pmod(F.xxhash64("part"), F.lit(buckets)))
    spread = held.withColumn("n", n).withColumn("side", side).withColumn("bucket", bucket).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return spread.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "part", "node", "copies", "shingles")


def stage(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that another stands for: of each group the one of the smallest id stays."""
    found = join(docs, doc_id, text)
    name = free("__gone", {c.lower() for c in docs.columns})
    gone = written(found.where("doc_id <> class_id").select(F.col("doc_id").alias(name)), "gone")
    return docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col(name), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
