"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that makes all of them unit vectors, so the largest inner
product with a query is the smallest distance. Each of TABLES hash tables keys a vector by ``bits`` p-stable projections,
floor((a.x + b) / w). A query visits its own bucket and those next to it in estimated success order: sets of borders to cross,
by the expected sum of squared distances to them, as the ranks of a query's own border distances tell. What the tables find is
ranked by the exact inner product in double precision.

All sizes are hashed alike. The number of projections and of probes is fitted: SAMPLE_QUERIES queries are searched exactly, in
blocks; for each number of projections the probes that find TARGET of their neighbours are taken, and of these the cheapest by
the rows of a sample that they visit. Every row is indexed in every table.

Equal vectors are one class with its smallest ids, which is all that a result can show of it, so copies make no hot bucket.
Buckets are dealt to shards of about PART rows by their key. A shard with more rows, or with more than ASKED queries, is split
both ways, so one hot bucket becomes many tasks. Queries that find fewer than they should are searched exactly, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or candidate;
shorter vectors count as filled up with zeros; repeated ids count once a distinct vector; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

TABLES, MOST_PROBES, LEAST_BITS, MOST_BITS = 6, 512, 4, 24
#: Rows of a shard, and queries in one task of it; both bound memory alone.
PART, ASKED = 16384, 16384
#: Rows that w and the visited share are fitted on, and queries that bits and probes are; both are chosen by hash of the id.
SAMPLE, SAMPLE_QUERIES, TARGET = 2000, 128, 0.94
#: w in standard deviations of a projection; number of rows whose visit costs as much as one probe.
WIDTH, PROBE_COST = 3.0, 4
TOP = 20
KEYED = "tab int, shard long, key long, class_id long, vector binary"
PROBED = "tab int, shard long, keys binary, class_id long, vector binary"
NEAR = "query long, best array<struct<s:double,c:long>>"


def fit_projections(sample: np.ndarray, bits: int, tables: int = TABLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Planes (already divided by w) and shifts; w is WIDTH standard deviations of the sample's projections.

    As far as the dimension allows, a table's planes are made orthogonal, so no two of them tell the same.
    """
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, bits, sample.shape[1]))
    for t in range(tables):
        free = min(bits, sample.shape[1])
        planes[t, :free] = np.linalg.qr(planes[t, :free].T)[0].T
    spread = np.maximum(1e-9, np.std(np.einsum("nd,tbd->ntb", sample, planes), axis=0))
    planes /= WIDTH * spread[:, :, None]
    return planes, rng.random((tables, bits))


@functools.lru_cache(maxsize=64)
def probe_sets(bits: int, most: int) -> np.ndarray:
    """The first ``most`` probes as rows of 0 and 1 over the 2 * bits borders in the order of their distance.

    The border at rank j has the expected squared distance j (j + 1) / (4 (bits + 1) (bits + 2)) in units of w, and for ranks
    above bits the expectation of (1 - z) squared; rank j and its mirror belong to one projection, so no set holds both.
    """
    m = bits
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + near[::-1]
    d = np.concatenate([near, far]).tolist()
    heap, found = [(d[0], (0,))], [()]
    while heap and len(found) < most:
        score, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - d[last] + d[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + d[last + 1], (*ranks, last + 1)))
    out = np.zeros((len(found), 2 * m), np.float32)
    for i, ranks in enumerate(found):
        out[i, list(ranks)] = 1
    return out


def mixed(cells: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit key a row of whole numbers."""
    h = np.full(cells.shape[0], (0x9E3779B97F4A7C15 * (table + 1)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(cells.shape[1]):
        h = (h ^ cells[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def own_keys(x: np.ndarray, planes: np.ndarray, shifts: np.ndarray, table: int) -> np.ndarray:
    return mixed(np.floor(x @ planes[table].T + shifts[table]), table)


def probe_keys(x: np.ndarray, planes: np.ndarray, shifts: np.ndarray, table: int, most: int) -> np.ndarray:
    """A row of keys for each query: the buckets that it visits, best first."""
    at = x @ planes[table].T + shifts[table]
    cell = np.floor(at)
    n, bits = at.shape
    sets = probe_sets(bits, most)
    order = np.argsort(np.concatenate([at - cell, 1 - (at - cell)], axis=1), axis=1, kind="stable")
    step = np.zeros((n, 2 * bits, bits), np.float32)
    np.put_along_axis(step, (order % bits)[:, :, None], np.where(order < bits, -1, 1)[:, :, None].astype(np.float32), axis=2)
    moved = cell[:, None, :] + np.einsum("sr,nrb->nsb", sets, step)
    return mixed(moved.reshape(-1, bits), table).reshape(n, len(sets))


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow in between."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((x / most) ** 2).sum(axis=1))


def as_queries(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)


def as_rows(x: np.ndarray, scale: float) -> np.ndarray:
    x = x / scale
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def classes(vectors: DataFrame, vec_id: str, embedding: str, every: int) -> DataFrame:
    """vector, class_id, ids (the smallest TOP + 1 of the class), queries (whether it holds one), dim, norm.

    A class's ids are gathered in two steps, the first dealt by a hash of the id, so copies of one vector meet in no single task.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector")).where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    # Adding 0.0 makes the two zeros one.
    rows = rows.where(F.exists("vector", lambda x: x != 0)).withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(element_type(vectors, embedding))))
    smallest = lambda c: F.slice(F.sort_array(F.array_distinct(c)), 1, TOP + 1)
    part = rows.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part")).agg(smallest(F.collect_list("id")).alias("ids"), F.max(F.pmod("id", F.lit(every)) == 0).alias("queries"))
    whole = part.groupBy("vector").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("queries").alias("queries"))
    top = F.greatest(F.array_max("vector"), -F.array_min("vector")).cast("double")
    # The largest part is bound once, not computed again for every part.
    norm = F.transform(F.array(top), lambda m: m * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / m) * (x / m))))[0]
    return whole.select("vector", F.element_at("ids", 1).alias("class_id"), "ids", "queries", F.size("vector").alias("dim"), norm.alias("norm"))


def element_type(vectors: DataFrame, embedding: str) -> str:
    """float stays float, which is exact and half as wide; everything else is held as double."""
    return "float" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "double"


def filled(vectors: pd.Series, dim: int, dtype: type) -> np.ndarray:
    """One row a vector, shorter ones filled up with zeros."""
    found = list(vectors)
    if all(len(v) == dim for v in found):
        return np.stack(found).astype(dtype, copy=False) if found else np.zeros((0, dim), dtype)
    out = np.zeros((len(found), dim), dtype)
    for i, v in enumerate(found):
        out[i, : len(v)] = v
    return out


def stacked(column: pd.Series, dim: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(-1, dim)


def best_of(q: np.ndarray, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, slack: float, take: int) -> list[dict]:
    """The ``take`` best of the rows x for one query, ties to smaller ids.

    ``rough`` scores choose those that can be among them; these are summed anew in double precision and in one fixed order,
    so a pair has the same score wherever it is found.
    """
    kept = np.flatnonzero(rough >= np.partition(rough, len(ids) - take)[len(ids) - take] - slack) if len(ids) > take else np.arange(len(ids))
    score, at = (x[kept].astype(np.float64) * q.astype(np.float64)).sum(axis=1), ids[kept]
    order = np.lexsort((at, -score))[:take]
    return [{"s": -a, "c": b} for a, b in zip(score[order].tolist(), at[order].tolist(), strict=True)]


def slack_of(q: np.ndarray, x: np.ndarray) -> float:
    """Twice what sums in the vectors' own precision can be off."""
    return 4 * q.shape[-1] * float(np.finfo(x.dtype).eps) * float(norms(q).max() * norms(x).max()) if len(q) and len(x) else 0.0


def ranked(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, take: int = TOP + 1) -> pd.DataFrame:
    """NEAR: the ``take`` best of all rows x for each query."""
    best, slack = [], slack_of(q, x)
    for s in range(0, len(q), 256):
        best += [best_of(one, ids, x, rough, slack, take) for one, rough in zip(q[s : s + 256], q[s : s + 256] @ x.T, strict=True)]
    return pd.DataFrame({"query": query_ids, "best": best})


def probed(asked: pd.DataFrame, rows: pd.DataFrame, dim: int, dtype: type, take: int = TOP + 1) -> pd.DataFrame:
    """NEAR: the ``take`` best of the rows in the buckets that each query visits in one shard."""
    rows = rows.sort_values("key", kind="stable")
    key, begins, sizes = np.unique(rows["key"].to_numpy(), return_index=True, return_counts=True)
    ids, x = rows["class_id"].to_numpy(), stacked(rows["vector"], dim, dtype)
    query_ids, best = [], []
    q = stacked(asked["vector"], dim, dtype)
    slack = slack_of(q, x)
    for i, one, keys in zip(asked["class_id"].to_numpy(), q, asked["keys"], strict=True):
        visits = np.frombuffer(keys, np.int64)
        place = np.minimum(np.searchsorted(key, visits), len(key) - 1)
        place = np.unique(place[key[place] == visits])
        if not len(place):
            continue
        n = sizes[place]
        found = np.repeat(begins[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        there = x[found]
        query_ids.append(i)
        best.append(best_of(one, ids[found], there, there @ one, slack, take))
    return pd.DataFrame({"query": np.array(query_ids, np.int64), "best": pd.Series(best, dtype=object)})


def merged(near: DataFrame) -> DataFrame:
    """query, best: over all shards and tables. Each list is short, and a query visits a bounded number of shards."""
    ordered = near.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    first = F.filter("best", lambda x, i: (i == 0) | (x != F.get("best", i - 1)))
    return ordered.select("query", F.slice(first, 1, TOP + 1).alias("best"))


def exact(rows: DataFrame, ids: np.ndarray, q: np.ndarray, dim: int, dtype: type) -> DataFrame:
    """NEAR for a bounded list of queries against all rows: each task ranks its own, in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield ranked(ids, q, b["class_id"].to_numpy(), filled(b["vector"], dim, dtype))

    return merged(rows.select("class_id", "vector").mapInPandas(run, NEAR))


def fit(sample: np.ndarray, queries: np.ndarray, neighbours: list[np.ndarray], scale: float, n: int, tables: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Planes, shifts and probes a table that find TARGET of the neighbours, and of all numbers of projections the cheapest.

    A number of projections that MOST_PROBES don't serve is left out; if none is left, the smallest takes MOST_PROBES.
    """
    rows, asked = as_rows(sample, scale), as_queries(queries)
    near = as_rows(np.concatenate(neighbours), scale)
    of = np.repeat(np.arange(len(neighbours)), [len(x) for x in neighbours])
    choices = []
    for bits in range(LEAST_BITS, max(LEAST_BITS, min(MOST_BITS, round(math.log2(n)))) + 1, 2):
        planes, shifts = fit_projections(rows, bits, tables)
        first, visited = np.full(len(near), MOST_PROBES + 1), np.zeros(MOST_PROBES)
        for t in range(tables):
            keys = probe_keys(asked, planes, shifts, t, MOST_PROBES)
            hit = keys[of] == own_keys(near, planes, shifts, t)[:, None]
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, MOST_PROBES + 1))
            there, count = np.unique(own_keys(rows, planes, shifts, t), return_counts=True)
            place = np.minimum(np.searchsorted(there, keys), len(there) - 1)
            held = np.where(there[place] == keys, count[place], 0).mean(axis=0)
            visited[: len(held)] += held
        probes = int(np.quantile(first, TARGET, method="higher"))
        if probes <= MOST_PROBES:
            cost = visited[:probes].sum() / len(rows) * n + PROBE_COST * probes * tables
            choices.append((cost, bits, planes, shifts, probes))
    if not choices:
        planes, shifts = fit_projections(rows, LEAST_BITS, tables)
        return planes, shifts, MOST_PROBES
    return min(choices, key=lambda c: c[:2])[2:]


def search(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, top: int = TOP, tables: int = TABLES, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id is divisible by ``every``."""
    if top > TOP:
        raise ValueError(f"top is at most {TOP}")
    spark = vectors.sparkSession
    found = written(classes(vectors, vec_id, embedding, every), "vectors")
    dtype = np.float32 if element_type(vectors, embedding) == "float" else np.float64
    whole = found.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("dim").alias("dim")).first()
    n, scale, dim = whole["n"], whole["norm"], whole["dim"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_hash = (F.xxhash64("class_id"), F.col("class_id"))
    sample = filled(pd.Series([r["vector"] for r in found.orderBy(*by_hash).limit(SAMPLE).select("vector").collect()]), dim, dtype).astype(np.float64)
    some = found.where("queries").orderBy(*by_hash).limit(SAMPLE_QUERIES).select("class_id", "vector").collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some_ids, some_vectors = np.array([r["class_id"] for r in some], np.int64), filled(pd.Series([r["vector"] for r in some]), dim, dtype)
    seen = exact(found, some_ids, some_vectors, dim, dtype).select("query", F.explode("best").alias("b")).select("query", F.col("b.c").alias("class_id")).where("query <> class_id")
    near: dict[int, list] = {int(i): [] for i in some_ids}
    for r in seen.join(found.select("class_id", "vector"), "class_id").select("query", "vector").collect():
        near[r["query"]].append(r["vector"])
    if any(near.values()):
        planes, shifts, probes = fit(sample, some_vectors.astype(np.float64), [filled(pd.Series(near[int(i)], dtype=object), dim, dtype).astype(np.float64) for i in some_ids], scale, n, tables)
    else:
        (planes, shifts), probes = fit_projections(as_rows(sample, scale), LEAST_BITS, tables), 1
    shards = max(1, round(n / part))

    def index(vector: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = filled(b["vector"], dim, dtype)
                    held = [v.tobytes() for v in x] if vector else None
                    for t in range(tables):
                        key = own_keys(as_rows(x.astype(np.float64), scale), planes, shifts, t)
                        yield pd.DataFrame({"tab": t, "shard": key % shards, "key": key, "class_id": b["class_id"].to_numpy(), "vector": held})

        return run

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 512):
                x, ids = filled(b["vector"].iloc[s : s + 512], dim, dtype), b["class_id"].to_numpy()[s : s + 512]
                held = [v.tobytes() for v in x]
                for t in range(tables):
                    keys = probe_keys(as_queries(x.astype(np.float64)), planes, shifts, t, probes)
                    query, keys = np.repeat(np.arange(len(x)), keys.shape[1]), keys.reshape(-1)
                    order = np.lexsort((keys % shards, query))
                    query, keys = query[order], keys[order]
                    starts = np.flatnonzero(np.diff(query, prepend=-1).astype(bool) | np.diff(keys % shards, prepend=-1).astype(bool))
                    who = query[starts]
                    yield pd.DataFrame({"tab": t, "shard": keys[starts] % shards, "keys": [k.tobytes() for k in np.split(keys, starts[1:])], "class_id": ids[who], "vector": [held[i] for i in who]})

    narrow, queries = found.select("class_id", "vector"), found.where("queries").select("class_id", "vector")
    asked = queries.mapInPandas(probe, PROBED)
    held = narrow.mapInPandas(index(False), KEYED).groupBy("tab", "shard").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("parts"))
    waiting = asked.groupBy("tab", "shard").agg(F.ceil(F.count("*") / F.lit(ASKED)).cast("int").alias("turns"))
    loads = bounded(written(held.join(waiting, ["tab", "shard"]), "loads"))
    cut = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    rows = narrow.mapInPandas(index(True), KEYED).join(loads, ["tab", "shard"]).withColumn("part", mine("parts")).withColumn("turn", cut("turns")).drop("parts", "turns")
    asked = asked.join(loads, ["tab", "shard"]).withColumn("turn", mine("turns")).withColumn("part", cut("parts")).drop("parts", "turns")
    place = ["tab", "shard", "part", "turn"]

    def nearest(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "best": pd.Series([], dtype=object)})
        return probed(here, there, dim, dtype)

    best = written(merged(asked.groupBy(*place).cogroup(rows.groupBy(*place)).applyInPandas(nearest, NEAR)), "best")
    missing = written(queries.withColumnRenamed("class_id", "query").join(best.where(F.size("best") >= min(TOP + 1, n)), "query", "left_anti"), "missing")
    if missing.count():
        best = best.join(missing, "query", "left_anti").unionByName(all_rows(missing, narrow, dim, dtype, max(1, math.ceil(n / part))))
    # Members of the classes found, then the query ids of each query's class.
    pairs = best.select("query", F.explode("best").alias("b")).select("query", F.col("b.c").alias("class_id"), F.col("b.s").alias("s"))
    members = pairs.join(found.select("class_id", "ids"), "class_id").groupBy("query").agg(F.collect_list(F.struct("s", "ids")).alias("found"))
    flat = F.sort_array(F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("id"))))))
    results = members.select(F.col("query").alias("class_id"), F.slice(flat, 1, top + 1).alias("found"))
    kind = element_type(vectors, embedding)
    ids = vectors.select(F.col(vec_id).cast("long").alias("query_id"), F.transform(F.col(embedding), lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(kind)).alias("vector")).where(F.pmod("query_id", F.lit(every)) == 0).distinct()
    asked_ids = ids.join(found.where("queries").select("vector", "class_id"), "vector").select("query_id", "class_id")
    own = asked_ids.join(results, "class_id").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, top)).alias("rank", "x"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def all_rows(queries: DataFrame, rows: DataFrame, dim: int, dtype: type, blocks: int) -> DataFrame:
    """NEAR for queries against all rows, in blocks of each: for the few whose buckets held too little."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    here = queries.select("query", "vector", spread.alias("b"))
    there = rows.select("class_id", "vector", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int").alias("b"))

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "best": pd.Series([], dtype=object)})
        return ranked(asked["query"].to_numpy(), filled(asked["vector"], dim, dtype), held["class_id"].to_numpy(), filled(held["vector"], dim, dtype))

    return merged(here.groupBy("b").cogroup(there.groupBy("b")).applyInPandas(nearest, NEAR))
