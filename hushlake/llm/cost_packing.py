"""Packing of token sequences that balances the estimated cost of attention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hushlake.llm.token_ids import TOKENIZER, encoded

CAPACITY = 2048  # tokens of a sequence
END = 1  # id after each document
BLOCK = 1 << 22  # tokens that are packed together
LINEAR, QUADRATIC = 1.0, 1.0 / 512  # cost of a piece: for each token, and for each two tokens of it
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(length: np.ndarray | int) -> np.ndarray | float:
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``document, start, length, sequence, offset`` of pieces of documents with the given numbers of tokens.

    As many sequences are opened as the tokens need. Documents are cut at the capacity; from the longest piece down each
    goes to the cheapest sequence with room for it (ties: the first). Where none has, the piece is cut to fill the roomiest
    and its rest placed the same way, so that all sequences but one's worth of room are filled.
    """
    n = -(-int(lengths.sum()) // capacity)
    costs, room = np.zeros(n), np.full(n, capacity)
    pieces = [(d, s, min(capacity, int(size) - s)) for d, size in enumerate(lengths) for s in range(0, int(size), capacity)]
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    placed = []
    fresh = 0  # sequences before this one have been used
    for doc, start, length in pieces:
        while length:
            if fresh < n:  # an unused sequence costs nothing and has all its room
                to, fresh = fresh, fresh + 1
            else:
                fits = np.where(room >= length, costs, np.inf)
                to = int(fits.argmin())
                if fits[to] == np.inf:
                    to = int(room.argmax())
            part = min(length, int(room[to]))
            placed.append((doc, start, part, to, capacity - int(room[to])))
            costs[to] += cost(part)
            room[to] -= part
            start, length = start + part, length - part
    return placed


def packed(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit. Every task packs the texts it reads, a block of tokens at a time, so nothing
    is shuffled and memory is bounded by a block and the longest text; a sequence never spans two blocks. A null or
    empty text is the end id alone; a repeated row is packed again. ``sequence_id`` is unique, not dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        held, tokens = [], 0

        def flush(first: int) -> tuple[list[pa.RecordBatch], int]:
            placed = pack(np.array([len(ids) for _, ids in held]), capacity)
            out = []
            for at in range(0, len(placed), 4096):
                rows = placed[at : at + 4096]
                doc, start, length, sequence, offset = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                names = pa.array([held[d][0] for d, *_ in rows], pa.int64())
                sizes = pa.array([len(held[d][1]) for d, *_ in rows], pa.int64())
                blobs = pa.array([held[d][1][s : s + n].tobytes() for d, s, n, *_ in rows], pa.binary())
                sequence = pa.array(np.array(sequence) + first)
                fields = [names, start, length, blobs, sizes, sequence, offset]
                labels = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
                out.append(pa.RecordBatch.from_arrays(fields, labels))
            return out, first + 1 + max((p[3] for p in placed), default=-1)

        for doc_id, ids in encoded(batches, path):
            held.append((doc_id, np.append(ids, np.uint32(end)).astype("<u4")))
            tokens += len(held[-1][1])
            if tokens >= BLOCK:
                out, first = flush(first)
                yield from out
                held, tokens = [], 0
        if held:
            yield from flush(first)[0]

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
