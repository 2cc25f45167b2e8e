"""Suffix-array deduplication: bytes of SPAN-byte strings that also start in a document of a smaller id are removed.

The suffixes of all documents need not be sorted together: two equal SPAN-byte strings have the same anchor at the same place,
the smallest of the hashes of their GRAM-byte pieces (the first of equal ones). So the strings are dealt by anchor:

1. Each anchor of a text owns a run of string starts, and the owned text is what those strings cover. (anchor, hash of the owned
   text, document) is one narrow row, once a document. Windows over the anchor give the smallest document of each owned text.
   Owned texts that a smaller document has are removed as they are; the first of several different owned texts of one anchor
   (the edges of what documents share) need a closer look.
2. Only those edges' bytes move, dealt by anchor. Within a task their suffixes are sorted by a mergesort that compares two
   suffixes by their longest common extension, found by binary search over prefix polynomial hashes; neighbours whose
   extension reaches SPAN are verified byte by byte, and each class's smallest document is kept.
3. Both are marked in the texts, overlapping strings are united, and the rest is hashed.

Strings are judged on the input. Shuffle files go after each step; every step's result is a table in the shared folder.

Defined results: null texts are empty; texts shorter than SPAN lose nothing; rows with one id aren't smaller than each other,
so neither loses to the other; rows with a null id lose nothing and remove nothing; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPAN, GRAM = 50, 20
#: Bytes of text hashed at once, and suffixes sorted at once by a task; both bound memory alone.
CHUNK, MOST_SUFFIXES = 1 << 18, 1 << 17
#: Rows of an Arrow batch that are worked on, and given on, at once.
ROWS = 500
#: Anchors with more rows than this are dealt by string, so that no task holds them whole.
HOT_ROWS = 4096
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: np.ndarray | None = None
_inverses: np.ndarray | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if _powers is None or len(_powers) < n:
        size = max(n, CHUNK + SPAN)
        _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]).cumprod(dtype=np.uint64)
        _inverses = np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]).cumprod(dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum over j < i of (data[j] + 1) * base**j, so a substring's hash is (P[b] - P[a]) * base**-a."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=out[1:])
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text: anchor position, first and last string start that it owns, anchor hash, hash of the owned text.

    Long texts are taken in chunks. A run of starts that a chunk's end divides becomes two owned texts of one anchor, which
    are compared as edges.
    """
    parts = [(s, _anchors(data[s : s + CHUNK + SPAN - 1])) for s in range(0, max(1, len(data) - SPAN + 1), CHUNK)]
    if len(parts) == 1:
        return parts[0][1]
    return tuple(np.concatenate([p[k] + s if k < 3 else p[k] for s, p in parts]) for k in range(5))


def _anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < SPAN:
        return none, none, none, none, none
    prefix = prefix_hashes(data)
    _, inverse = powers(n + 1)
    gram = stirred((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1])
    # The smallest of the SPAN - GRAM + 1 pieces of each string, the first of equal ones, by doubling.
    low, at, width, need = gram, np.arange(len(gram)), 1, SPAN - GRAM + 1
    while width < need:
        step = min(width, need - width)
        right = low[step:]
        left = low[: len(right)]
        take = right < left
        low, at = np.where(take, right, left), np.where(take, at[step:], at[: len(right)])
        width += step
    # at is the anchor of each start; it never moves back.
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    end = last + SPAN
    own = (prefix[end] - prefix[first]) * inverse[first]
    # The owned text, its length and where its anchor lies are one identity.
    own = stirred(own ^ stirred((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - first).astype(np.uint64)))
    return place, first, last, gram[place].view(np.int64), own.view(np.int64)


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def text_key(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def few_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for s in range(0, len(b), ROWS):
            yield b.iloc[s : s + ROWS]


def owned(docs: DataFrame) -> DataFrame:
    """doc, anchor, own: once a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in few_rows(batches):
            ids, hs, os = [], [], []
            for doc, text in zip(b["doc"], b["text"], strict=True):
                _, _, _, h, o = anchors(np.frombuffer(_bytes(text), np.uint8))
                if len(h):
                    o, at = np.unique(o, return_index=True)
                    ids.append(np.full(len(o), int(doc)))
                    hs.append(h[at])
                    os.append(o)
            if ids:
                yield pd.DataFrame({"doc": np.concatenate(ids), "anchor": np.concatenate(hs), "own": np.concatenate(os)})

    return docs.where("doc is not null").select("doc", "text").mapInPandas(run, "doc long, anchor long, own long")


def flags(rows: DataFrame) -> DataFrame:
    """doc, gone (owned texts that a smaller document has), edge (owned texts to compare with others of their anchor)."""
    by_own, by_anchor = Window.partitionBy("anchor", "own"), Window.partitionBy("anchor")
    seen = rows.withColumn("low", F.min("doc").over(by_own)).withColumn("least", F.min("own").over(by_anchor)).withColumn("most", F.max("own").over(by_anchor)).withColumn("first", F.min("doc").over(by_anchor)).withColumn("final", F.max("doc").over(by_anchor))
    gone = F.col("low") < F.col("doc")
    edge = ~gone & (F.col("least") < F.col("most")) & (F.col("first") < F.col("final"))
    picked = seen.where(gone | edge).select("doc", "own", gone.alias("is_gone"))
    return picked.groupBy("doc").agg(F.collect_list(F.when(F.col("is_gone"), F.col("own"))).alias("gone"), F.collect_list(F.when(~F.col("is_gone"), F.col("own"))).alias("edge"))


def edges(texts: DataFrame) -> DataFrame:
    """anchor, doc, key (of the text), start, back (from the anchor to start), body (the owned text) of the edges of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in few_rows(batches):
            out = []
            for doc, text, edge in zip(b["doc"], b["text"], b["edge"], strict=True):
                raw = _bytes(text)
                place, first, last, h, o = anchors(np.frombuffer(raw, np.uint8))
                key = text_key(raw)
                wanted = np.flatnonzero(np.isin(o, edge))
                # A text may hold an owned text more than once; every place is told.
                out += [(int(h[i]), int(doc), key, int(first[i]), int(place[i] - first[i]), raw[first[i] : last[i] + SPAN]) for i in wanted]
            if out:
                yield pd.DataFrame(out, columns=["anchor", "doc", "key", "start", "back", "body"])

    return texts.select("doc", "text", "edge").mapInPandas(run, "anchor long, doc long, key long, start int, back int, body binary")


def common(prefix: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The longest common extension of the suffixes at x and y, up to SPAN, by binary search over prefix hashes."""
    _, inverse = powers(len(prefix))
    low, high = np.zeros(len(x), np.int64), np.full(len(x), SPAN, np.int64)
    ix, iy, px, py = inverse[x], inverse[y], prefix[x], prefix[y]
    for _ in range(SPAN.bit_length()):
        mid = (low + high + 1) >> 1
        same = (prefix[x + mid] - px) * ix == (prefix[y + mid] - py) * iy
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def before(data: np.ndarray, prefix: np.ndarray, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether the SPAN bytes at x sort before those at y (or are equal)."""
    length = common(prefix, x, y)
    inside = np.minimum(length, SPAN - 1)
    return np.where(length == SPAN, or_equal, data[x + inside] < data[y + inside])


def sorted_suffixes(data: np.ndarray, prefix: np.ndarray, group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``at`` by (group, SPAN bytes): a stable mergesort of all groups at once.

    Each round merges neighbouring runs of a group. An element's place is its own rank plus its rank in the other run, found by
    binary search with hash comparisons.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begins, [len(g)]]))
    start, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    rank = np.arange(len(g)) - start
    run = 1
    while len(g) and run < sizes.max():
        block = rank // run
        other = block ^ 1
        low, high = np.minimum(other * run, size), np.minimum((other + 1) * run, size)
        base = low.copy()
        live = np.flatnonzero(high > low)
        x, left = at[order], (block & 1) == 0
        while len(live):
            mid = (low[live] + high[live]) >> 1
            # Elements of the left run go before equal ones of the right run.
            ahead = np.empty(len(live), bool)
            l = left[live]
            other_at = at[order[start[live] + mid]]
            own_at = x[live]
            ahead[l] = before(data, prefix, other_at[l], own_at[l], False)
            ahead[~l] = before(data, prefix, other_at[~l], own_at[~l], True)
            low[live] = np.where(ahead, mid + 1, low[live])
            high[live] = np.where(ahead, high[live], mid)
            live = live[high[live] > low[live]]
        to = start + np.minimum(block, other) * run + (rank - block * run) + (low - base)
        new = np.empty_like(order)
        new[to] = order
        order = new
        run *= 2
    return order


def verified(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the SPAN bytes at x and y are the same, byte by byte."""
    same = np.ones(len(x), bool)
    for k in range(SPAN):
        same &= data[x + k] == data[y + k]
    return same


def compared(rows: pd.DataFrame) -> pd.DataFrame:
    """doc, key, start, stop: byte ranges covered by strings that a smaller document's row of the same anchor has too."""
    bodies = rows["body"].to_list()
    lengths = np.array([len(x) for x in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    count = lengths - SPAN + 1
    row = np.repeat(np.arange(len(rows)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offset[row] + k
    # A group: strings of one anchor with the same distance to it.
    anchor = np.unique(rows["anchor"].to_numpy(), return_inverse=True)[1]
    group = anchor[row] * np.int64(2 * SPAN) + (rows["back"].to_numpy().astype(np.int64)[row] - k + SPAN)
    doc = rows["doc"].to_numpy()[row]
    prefix = prefix_hashes(data)
    order = sorted_suffixes(data, prefix, group, at)
    a, b = order[:-1], order[1:]
    near = group[a] == group[b]
    same = np.zeros(len(a), bool)
    pair = np.flatnonzero(near)
    pair = pair[common(prefix, at[a[pair]], at[b[pair]]) == SPAN]
    same[pair] = verified(data, at[a[pair]], at[b[pair]])
    classes = np.cumsum(np.concatenate([[True], ~same])) - 1
    least = np.full(classes[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, classes, doc[order])
    removed = np.zeros(len(row), bool)
    removed[order] = doc[order] > least[classes]
    hit = np.flatnonzero(removed)
    if not len(hit):
        return pd.DataFrame({"doc": [], "key": [], "start": [], "stop": []}).astype("int64")
    # Neighbouring strings of one row make one range.
    new = np.concatenate([[True], (np.diff(hit) > 1) | (row[hit[1:]] != row[hit[:-1]])])
    begin, end = hit[new], hit[np.concatenate([new[1:], [True]])]
    r, first = row[begin], rows["start"].to_numpy().astype(np.int64)
    return pd.DataFrame({"doc": rows["doc"].to_numpy()[r], "key": rows["key"].to_numpy()[r], "start": first[r] + k[begin], "stop": first[r] + k[end] + SPAN})


def strings(edge_rows: DataFrame) -> DataFrame:
    """The ranges of rows of hot anchors, one a string: strings meet by their bytes instead of their anchor, which spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                some = b.slice(s, ROWS)
                bodies = some["body"].to_pylist()
                lengths = np.array([len(x) for x in bodies], np.int64)
                count, data = lengths - SPAN + 1, np.frombuffer(b"".join(bodies), np.uint8)
                n = int(count.sum())
                k = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(np.cumsum(lengths) - lengths, count) + k
                cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SPAN)[at])
                found = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * SPAN).astype(np.int32)), pa.py_buffer(cut)])
                doc, key, start = (np.repeat(some[c].to_numpy(), count).astype(np.int64) for c in ("doc", "key", "start"))
                yield pa.RecordBatch.from_arrays([found, pa.array(doc), pa.array(key), pa.array(start + k)], ["string", "doc", "key", "start"])

    rows = edge_rows.select("doc", "key", "start", "body").mapInArrow(run, "string binary, doc long, key long, start long")
    least = rows.groupBy("string").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("string", "low")
    return rows.join(least, "string").where("doc > low").select("doc", "key", "start", (F.col("start") + SPAN).alias("stop"))


def ranges(edge_rows: DataFrame) -> DataFrame:
    """The ranges of all edges. Tasks take whole anchors in order and compare about MOST_SUFFIXES strings at once."""
    hot = written(edge_rows.groupBy("anchor").count().where(F.col("count") > HOT_ROWS).select("anchor"), "hot")
    if hot.head(1):
        return sorted_ranges(edge_rows.join(hot, "anchor", "left_anti")).unionByName(strings(edge_rows.join(hot, "anchor")))
    return sorted_ranges(edge_rows)


def sorted_ranges(edge_rows: DataFrame) -> DataFrame:

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += int(b["body"].map(len).sum()) - (SPAN - 1) * len(b)
            if size >= MOST_SUFFIXES:
                whole = pd.concat(held, ignore_index=True)
                # The last anchor may go on in the next batch.
                done = whole["anchor"] != whole["anchor"].iloc[-1]
                if done.any():
                    yield compared(whole[done].reset_index(drop=True))
                    held = [whole[~done]]
                    size = int(held[0]["body"].map(len).sum()) - (SPAN - 1) * len(held[0])
        if held:
            yield compared(pd.concat(held, ignore_index=True))

    return edge_rows.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(run, "doc long, key long, start long, stop long")


def removed_mask(raw: bytes, gone, cuts) -> np.ndarray:
    """Runs [start, stop) to remove: rows of an array, disjoint and maximal."""
    parts = [np.array([[c["start"], c["stop"]] for c in cuts], np.int64)] if cuts is not None and len(cuts) else []
    if gone is not None and len(gone):
        _, first, last, _, o = anchors(np.frombuffer(raw, np.uint8))
        hit = np.isin(o, gone)
        parts.append(np.stack([first[hit], last[hit] + SPAN], axis=1))
    if not parts:
        return np.zeros((0, 2), np.int64)
    both = np.concatenate(parts)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.concatenate([[True], both[1:, 0] > reach[:-1]])
    return np.stack([both[new, 0], reach[np.concatenate([new[1:], [True]])]], axis=1)


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed [start, stop) in bytes); with keep_text also kept (binary)."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    flagged = written(flags(owned(named)), "flags")
    edge_rows = written(edges(named.join(flagged.where(F.size("edge") > 0).select("doc", "edge"), "doc")), "edges")
    found = written(ranges(edge_rows), "ranges")
    cuts = found.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "stop")).alias("cuts"))
    marks = written(flagged.where(F.size("gone") > 0).select("doc", "gone").join(cuts, "doc", "full"), "marks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in few_rows(batches):
            out = []
            for doc, t, gone, cut_rows in zip(b["doc"], b["text"], b["gone"], b["cuts"], strict=True):
                raw = _bytes(t)
                if cut_rows is not None and len(cut_rows):
                    key = text_key(raw)
                    cut_rows = [c for c in cut_rows if c["key"] == key]
                spans = removed_mask(raw, gone, cut_rows)
                edge = [0, *spans.ravel().tolist(), len(raw)]
                kept = b"".join(raw[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2))
                row = (doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": z} for a, z in spans.tolist()])
                out.append((*row, kept) if keep_text else row)
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if keep_text else [])])

    joined = named.join(marks, "doc", "left").select(F.col("doc").cast("string").alias("doc"), "text", "gone", "cuts")
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>" + (", kept binary" if keep_text else "")
    return joined.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
