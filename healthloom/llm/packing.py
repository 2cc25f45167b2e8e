"""Packing: order-preserving dynamic programming over document and sentence boundaries.

The documents of a block (consecutive rows of one input partition, up to ``block_tokens`` ids) form one stream of ids, each
document followed by the end id. The stream is cut into windows of at most ``window`` ids. Cuts fall at ends of documents (free)
and ends of sentences or lines (a truncation penalty). Only a stretch of more than ``window`` ids without such an end, which no
window holds, may be cut inside: at every GRID ids of it, at a higher penalty. The cuts minimise penalties plus padding (and a
small cost a window), where a window whose length is a power of two isn't padded.

With f(i) the least cost up to boundary i, f(j) = penalty(j) + window - p(j) + min over p(j) - window <= p(i) < p(j) of
f(i) + p(i): the minimum of a sliding window, held by a monotone queue. Powers of two add one look-up each.

No row is shuffled: a partition packs its own rows in their order. A lost executor's partitions are packed again to the same
result, as windows depend on the partition's rows alone.

Defined results: null text is empty (the end id alone); rows of one id are packed each by itself; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encoder, vocabulary

#: GRID: steps of the cuts inside a stretch that no window holds.
WINDOW, END_ID, GRID = 1024, 0, 64
#: Ids in one block: 4 MB, and as many bytes again for its boundaries.
BLOCK_TOKENS = 1 << 20
#: Costs of a cut, and of any window, in padding ids.
SENTENCE_PENALTY, INNER_PENALTY, WINDOW_COST = 4.0, 32.0, 2.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions where the stream may be cut, and the penalty of each. 0 is the first."""
    cost = np.full(int(max(doc_ends[-1:].max(initial=0), sentence_ends[-1:].max(initial=0))) + 1, -1.0)
    cost[sentence_ends] = SENTENCE_PENALTY
    cost[doc_ends] = cost[0] = 0.0
    ends = np.flatnonzero(cost >= 0)
    for i in np.flatnonzero(np.diff(ends) > window):
        cost[ends[i] + grid : ends[i + 1] : grid] = INNER_PENALTY
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The positions that end the windows of least cost, in order; the last is the end of the stream."""
    n = len(at)
    if n < 2:
        return at[:0]
    place = np.full(int(at[-1]) + 1, -1, np.int32)
    place[at] = np.arange(n, dtype=np.int32)
    # Boundaries a power of two before each, as one list with a start for each boundary.
    pairs = [(np.flatnonzero(at >= w), at[at >= w] - w) for w in (1 << k for k in range(window.bit_length()))]
    to, source_at = np.concatenate([j for j, _ in pairs]), place[np.concatenate([p for _, p in pairs])]
    to, source_at = to[source_at >= 0], source_at[source_at >= 0]
    by_to = np.argsort(to, kind="stable")
    before, begins = source_at[by_to].tolist(), np.searchsorted(to[by_to], np.arange(n + 1)).tolist()
    pos, pen = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    value = [0.0] * n
    for j in range(1, n):
        p = pos[j]
        low = p - window
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best, source = value[i] - low, i
        for k in before[begins[j] : begins[j + 1]]:
            if cost[k] < best:
                best, source = cost[k], k
        cost[j] = c = best + pen[j] + WINDOW_COST
        back[j] = source
        value[j] = v = c + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    found, j = [], n - 1
    while j:
        found.append(pos[j])
        j = back[j]
    return np.array(found[::-1], np.int64)


def pieces(doc_ends: np.ndarray, window_ends: np.ndarray) -> pd.DataFrame:
    """Where windows and documents cut the stream: from, to, index of document and window."""
    to = np.sort(np.concatenate([doc_ends, window_ends]))
    to = to[np.diff(to, prepend=0) > 0]
    start = np.concatenate([[0], to[:-1]]).astype(np.int64)
    return pd.DataFrame({"from": start, "to": to, "doc": np.searchsorted(doc_ends, to), "window": np.searchsorted(window_ends, to)})


def sentence_table(tokens: list[bytes]) -> np.ndarray:
    """For each id, whether a sentence or line may end with it."""
    table = np.zeros(len(tokens), bool)
    for i, token in enumerate(tokens):
        t = token.decode("utf-8", "replace")
        # What closes a sentence, and what may stand behind it.
        table[i] = t.endswith("\n") or t.rstrip("\"')]»”").endswith((".", "!", "?", "…", "。", "！", "？"))
    return table


def pack_partition(batches: Iterator[pd.DataFrame], files: tuple[str, str | None], window: int, block_tokens: int, part: int) -> Iterator[pd.DataFrame]:
    enc = encoder(*files)
    table = sentence_table(enc.tokens())
    end = np.array([END_ID], "<u4").tobytes()
    first = part << 40

    def closed(ids: list[int | None], texts: list[bytes]) -> pd.DataFrame:
        nonlocal first
        stream = b"".join(texts)
        lengths = np.array([len(t) // 4 for t in texts], np.int64)
        doc_ends = np.cumsum(lengths)
        tokens = np.frombuffer(stream, "<u4")
        sentences = np.flatnonzero(table[tokens]).astype(np.int64) + 1
        window_ends = cuts(*boundaries(doc_ends, sentences, window), window)
        out = pieces(doc_ends, window_ends)
        view = memoryview(stream)
        a, b, doc, seq = (out[c].to_numpy() for c in ("from", "to", "doc", "window"))
        window_starts = np.concatenate([[0], window_ends[:-1]])
        result = pd.DataFrame({
            "doc_id": pd.array([ids[i] for i in doc], "Int64"), "start": a - (doc_ends - lengths)[doc], "length": b - a,
            "ids_crc32": [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
            "doc_tokens": lengths[doc], "sequence_id": first + seq, "offset": a - window_starts[seq], "sequence_tokens": (window_ends - window_starts)[seq],
        })
        first += len(window_ends)
        return result

    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            encoded = enc.encode(text if isinstance(text, str) else None) + end
            if size and size + len(encoded) // 4 > block_tokens:
                yield closed(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            texts.append(encoded)
            size += len(encoded) // 4
    if ids:
        yield closed(ids, texts)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a piece: SCHEMA. sequence_id holds the partition's number in its upper bits; sequence_tokens is its sequence's length."""
    files = vocabulary(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return pack_partition(batches, files, window, block_tokens, TaskContext.get().partitionId())

    return docs.selectExpr(f"cast(cast(`{doc_id}` as long) as string) as doc_id", f"`{text}` as text").mapInPandas(run, SCHEMA)
