"""A distributed LSD radix sort: stable counting-sort passes over the digits of a composite key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.plans.storage import materialize

DIGIT = 11  # bits
CHUNK = 1 << 16  # rows that a task counts and places together
CHUNKS = "chunk long, n int, ids binary, digits binary"


def _digits(batch: pa.RecordBatch, keys: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Digits of the keys ``(column, low, high, descending)``, most significant first, as columns of 16 bits."""
    columns = []
    for name, low, high, descending in keys:
        value = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        far = np.array([high - low], np.uint64)
        value = value - np.array([low], np.int64).view(np.uint64)  # modulo 2^64, so that no range overflows
        value = far - value if descending else value
        bits = (high - low).bit_length()
        for shift in reversed(range(0, bits, DIGIT)):
            columns.append(((value >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.uint16))
    return np.stack(columns, axis=1) if columns else np.empty((batch.num_rows, 0), np.uint16)


def _chunk(number: int, ids: np.ndarray, digits: np.ndarray) -> pa.RecordBatch:
    cells = [[number], pa.array([len(ids)], pa.int32()), [ids.tobytes()], [np.ascontiguousarray(digits).tobytes()]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], ["chunk", "n", "ids", "digits"])


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["digits"], np.uint16).reshape(row["n"], width)


def _pass(chunks: DataFrame, width: int, size: int) -> DataFrame:
    """One stable counting sort by the last of ``width`` digits: chunks of ``size`` rows in the new order, without that digit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, digits in _rows(batches, width):
            n = np.bincount(digits[:, -1])
            digit = np.flatnonzero(n)
            arrays = [pa.array(digit.astype(np.int32)), pa.array(np.full(len(digit), row["chunk"])), pa.array(n[digit].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["digit", "chunk", "rows"])

    counts = chunks.mapInArrow(count, "digit int, chunk long, rows long")
    earlier = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # 2^DIGIT rows at most
    base = counts.groupBy("digit").agg(F.sum("rows").alias("all"))
    base = base.select("digit", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    offsets = counts.join(base, "digit").withColumn("start", F.col("base") + F.col("before"))
    offsets = offsets.groupBy("chunk").agg(F.collect_list(F.struct("digit", "start")).alias("starts"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, digits in _rows(batches, width):
            start = np.zeros(1 << DIGIT, np.int64)
            for s in row["starts"]:
                start[s["digit"]] = s["start"]
            last = digits[:, -1]
            order = np.argsort(last, kind="stable")  # of 16-bit numbers: itself a counting sort
            sorted_ = last[order]
            first = np.searchsorted(sorted_, np.arange(1 << DIGIT))
            to = start[sorted_] + np.arange(len(order)) - first[sorted_]  # ascends
            cuts = [0, *(np.flatnonzero(np.diff(to // size)) + 1).tolist(), len(to)]
            ids, rest = ids[order], digits[order, :-1]
            pieces = [(int(to[a]) // size, (to[a:b] % size).astype(np.int32).tobytes(), ids[a:b].tobytes(), rest[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            chunk, at, ids, rest = (list(c) for c in zip(*pieces, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(at), pa.array(ids), pa.array(rest)], ["chunk", "at", "ids", "digits"])

    pieces = chunks.join(offsets, "chunk").mapInArrow(place, "chunk long, at binary, ids binary, digits binary")
    met = pieces.groupBy("chunk").agg(F.collect_list(F.struct("at", "ids", "digits")).alias("pieces"))  # one chunk: bounded

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = sum(len(p["at"]) for p in row["pieces"]) // 4
                ids, digits = np.empty(n, np.int64), np.empty((n, width - 1), np.uint16)
                for p in row["pieces"]:
                    at = np.frombuffer(p["at"], np.int32)
                    ids[at] = np.frombuffer(p["ids"], np.int64)
                    digits[at] = np.frombuffer(p["digits"], np.uint16).reshape(len(at), width - 1)
                yield _chunk(row["chunk"], ids, digits)

    return materialize(met.mapInArrow(gather, CHUNKS), "sorted")


def radix_ranked(rows: DataFrame, row: str, keys: list[tuple[str, bool]], most: int | None = None, size: int = CHUNK) -> DataFrame:
    """``row, rank`` (from 1) of ``rows`` along the composite key, for the first ``most`` ranks (None: all).

    ``row``: a long that identifies a row; ``keys``: columns of longs without nulls, most significant first, and whether
    they descend. Rows that are equal in all keys keep the order in which Spark reads ``rows``, which must be a written table.

    Keys are cut into digits of 11 bits, as many as their range needs. Each pass counts the digits of every chunk of rows, turns
    the counts into offsets (by digit, then by chunk) and sends rows to their destinations; a used digit travels no
    further. A task holds one chunk of ``size`` rows; what is counted is at most 2,048 sums a chunk.
    """
    names = [c for c, _ in keys]
    bounds = rows.agg(*(F.min(c) for c in names), *(F.max(c) for c in names)).first()
    ranged = [(c, bounds[i] or 0, bounds[len(keys) + i] or 0, descending) for i, (c, descending) in enumerate(keys)]
    width = sum(-(-(high - low).bit_length() // DIGIT) for _, low, high, _ in ranged)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's chunks are numbered in its order
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, digits = batch.column("_row").to_numpy(), _digits(batch, ranged)
            for at in range(0, len(ids), size):
                yield _chunk(number, ids[at : at + size], digits[at : at + size])
                number += 1

    chunks = rows.select(F.col(row).alias("_row"), *names).mapInArrow(pack, CHUNKS)
    chunks = materialize(chunks, "packed")
    if not width:  # all rows are equal, or there is no row: a pass by a digit that all share numbers them
        chunks = chunks.withColumn("digits", F.unhex(F.repeat(F.lit("0000"), F.col("n"))))
        width = 1
    for left in range(width, 0, -1):
        chunks = _pass(chunks, left, size)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, ids, _ in _rows(batches, 0):
            rank = found["chunk"] * size + 1 + np.arange(len(ids))
            wanted = slice(0, len(ids) if most is None else max(0, min(len(ids), most - found["chunk"] * size)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[wanted]), pa.array(rank[wanted])], ["row", "rank"])

    wanted = chunks if most is None else chunks.filter(F.col("chunk") < -(-most // size))
    return wanted.mapInArrow(ranks, "row long, rank long")
