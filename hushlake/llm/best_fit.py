"""Packed matrices of token ids by best fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hushlake.llm.token_ids import TOKENIZER, encoded

CAPACITY = 2048  # ids of a row of the matrix
END = 49407  # id after each document
PAD = 49407  # id that fills a row
BLOCK = 1 << 22  # tokens that are packed together
SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
)


class Capacities:
    """Rooms of open rows, with a segment tree over the rooms that finds the least one that suffices."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << capacity.bit_length()
        self._tree = [0] * (2 * self._leaves)  # open rows under each node
        self._rows: dict[int, list[int]] = {}

    def _count(self, room: int, by: int) -> None:
        node = room + self._leaves
        while node:
            self._tree[node] += by
            node >>= 1

    def add(self, room: int, row: int) -> None:
        if room:
            self._rows.setdefault(room, []).append(row)
            self._count(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a row with the smallest room of at least ``least``: its room and number."""
        node, tree = least + self._leaves, self._tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up to the first right neighbour with rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self._leaves
        self._count(room, -1)
        return room, self._rows[room].pop()


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Rows of ``document, start, length``: documents cut at the capacity, from the longest piece down into the fullest row
    that takes it whole, else into a new row."""
    pieces = [(d, s, min(capacity, int(size) - s)) for d, size in enumerate(lengths) for s in range(0, int(size), capacity)]
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    rows: list[list[tuple[int, int, int]]] = []
    rooms = Capacities(capacity)
    for piece in pieces:
        found = rooms.take(piece[2])
        if found is None:
            found = (capacity, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(piece)
        rooms.add(room - piece[2], row)
    return rows


def matrices(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END, pad: int = PAD) -> DataFrame:
    """A row for each packed row of ids.

    ``ids`` and ``position_ids`` hold ``capacity`` little-endian unsigned 16-bit numbers (ids must be under 65,536); positions
    start again at 0 in every piece and in the padding. ``cu_seqlens`` has the ends of the pieces after a 0; ``doc_ids`` and
    ``starts`` say which part of which document each piece is, so documents can be put together again. Every text ends
    with ``end``; a null or empty text is that id alone, and a repeated row is packed again. Every task packs the texts
    it reads, a block of tokens at a time: no shuffle, and memory is bounded by a block and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        held, tokens = [], 0

        def matrix(rows: list[list[tuple[int, int, int]]], first: int) -> pa.RecordBatch:
            ids = np.full((len(rows), capacity), pad, "<u2")
            positions = np.zeros((len(rows), capacity), "<u2")
            ends = []
            for n, row in enumerate(rows):
                at = [0]
                for doc, start, length in row:
                    span = slice(at[-1], at[-1] + length)
                    ids[n, span] = held[doc][1][start : start + length]
                    positions[n, span] = np.arange(length)
                    at.append(span.stop)
                positions[n, at[-1] :] = np.arange(capacity - at[-1])
                ends.append(at)
            columns = {
                "sequence_id": pa.array(range(first, first + len(rows)), pa.int64()),
                "n_tokens": pa.array([at[-1] for at in ends], pa.int32()),
                "ids": pa.array([r.tobytes() for r in ids], pa.binary()),
                "position_ids": pa.array([r.tobytes() for r in positions], pa.binary()),
                "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                "doc_ids": pa.array([[held[d][0] for d, *_ in row] for row in rows], pa.list_(pa.int64())),
                "starts": pa.array([[s for _, s, _ in row] for row in rows], pa.list_(pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        def flush(first: int) -> Iterator[pa.RecordBatch]:
            rows = best_fit(np.array([len(ids) for _, ids in held]), capacity)
            for at in range(0, len(rows), 512):
                yield matrix(rows[at : at + 512], first + at)

        for doc_id, ids in encoded(batches, path):
            held.append((doc_id, np.append(ids, end).astype("<u2")))
            tokens += len(held[-1][1])
            if tokens >= BLOCK:
                for batch in flush(first):
                    yield batch
                    first += batch.num_rows
                held, tokens = [], 0
        if held:
            yield from flush(first)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
