"""Token-id output: best-fit-decreasing packing into fixed rows of ids.

Documents longer than a row are split losslessly into full rows and a rest. The pieces of a block are placed longest first, each
into the fullest row that still has room; a segment tree over capacities finds that row in log(width) steps. Each row comes
with its ids padded to the width, the cumulative lengths of its segments and positions that start anew in every segment.

A block is a run of rows of one input partition up to ``block_tokens`` ids, so memory is bounded and nothing is shuffled.

Defined results: null text is empty (the end id alone); rows of one id are placed each by itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .packing import BLOCK_TOKENS, END_ID, WINDOW
from .tokens import encoder, vocabulary

PAD_ID = 0
SCHEMA = "row_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, input_ids array<int>, position_ids array<int>"


class Capacities:
    """Rows by the room they have left; leaf c counts the rows with room c, and a node the rows below it."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of need or more, removed, with its room."""
        node, tree = need + self.leaves, self.tree
        if not tree[node]:
            # Up to the first right sibling that holds rows, then down to its leftmost leaf.
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not tree[2 * node])
        room = node - self.leaves
        self._count(room, -1)
        return self.rows[room].pop(), room

    def _count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Indices of lengths (each at most width) by row."""
    rows: list[list[int]] = []
    room = Capacities(width)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[i]
        if found := room.take(need):
            row, left = found
        else:
            row, left = len(rows), width
            rows.append([])
        rows[row].append(i)
        room.add(left - need, row)
    return rows


def lists(rows: list[np.ndarray] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list a row, of one flat buffer."""
    sizes = [len(r) for r in rows]
    flat = rows.reshape(-1) if isinstance(rows, np.ndarray) else np.concatenate(rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def pack_block(ids: list[int | None], texts: list[bytes], width: int, first: int) -> pa.RecordBatch:
    parts = []  # (document, start, ids)
    for i, t in enumerate(texts):
        tokens = np.frombuffer(t, "<u4").astype(np.int32)
        parts += [(i, s, tokens[s : s + width]) for s in range(0, len(tokens), width)]
    packed = best_fit_decreasing([len(p[2]) for p in parts], width)
    matrix, positions = np.full((len(packed), width), PAD_ID, np.int32), np.zeros((len(packed), width), np.int32)
    count = np.arange(width, dtype=np.int32)
    ends = []
    for r, row in enumerate(packed):
        at = 0
        reached = [0]
        for k in row:
            n = len(parts[k][2])
            matrix[r, at : at + n], positions[r, at : at + n] = parts[k][2], count[:n]
            at += n
            reached.append(at)
        ends.append(np.array(reached, np.int32))
    sizes = np.concatenate([[0], np.cumsum([len(row) for row in packed])])
    nested = lambda values: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int64()))
    doc_ids, starts = nested([ids[parts[k][0]] for row in packed for k in row]), nested([parts[k][1] for row in packed for k in row])
    columns = [pa.array(np.arange(first, first + len(packed)), pa.int64()), doc_ids, starts, lists(ends, pa.int32()), pa.array([int(e[-1]) for e in ends], pa.int32()), lists(matrix, pa.int32()), lists(positions, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["row_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", "input_ids", "position_ids"])


def pack_partition(batches: Iterator[pa.RecordBatch], files: tuple[str, str | None], width: int, block_tokens: int, part: int) -> Iterator[pa.RecordBatch]:
    enc, end, first = encoder(*files), np.array([END_ID], "<u4").tobytes(), part << 40
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            encoded = enc.encode(text) + end
            if size and size + len(encoded) // 4 > block_tokens:
                yield (made := pack_block(ids, texts, width, first))
                first += made.num_rows
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(encoded)
            size += len(encoded) // 4
    if ids:
        yield pack_block(ids, texts, width, first)


def matrices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, width: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a packed row of ids: SCHEMA. starts are the segments' places in their documents."""
    files = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_partition(batches, files, width, block_tokens, TaskContext.get().partitionId())

    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """The packed rows as Parquet: ids as little-endian 32-bit binaries, one row group reader away from a matrix."""
    made = matrices(docs, **options)

    def binary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in ("input_ids", "position_ids", "cu_seqlens"):
                b[c] = [np.asarray(x, "<i4").tobytes() for x in b[c]]
            yield b

    made.mapInPandas(binary, "row_id long, doc_ids array<long>, starts array<long>, cu_seqlens binary, n_tokens int, input_ids binary, position_ids binary").write.parquet(path)


def documents(rows: DataFrame) -> DataFrame:
    """doc_id, ids: the documents back from matrices(), for ids that occur once. The round trip that shows nothing is lost."""
    parts = rows.selectExpr("posexplode(doc_ids) as (k, doc_id)", "starts", "cu_seqlens", "input_ids").selectExpr("doc_id", "starts[k] as start", "slice(input_ids, cu_seqlens[k] + 1, cu_seqlens[k + 1] - cu_seqlens[k]) as ids")
    return parts.groupBy("doc_id").agg(_in_order())


def _in_order():
    from pyspark.sql import functions as F

    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])).alias("ids")
