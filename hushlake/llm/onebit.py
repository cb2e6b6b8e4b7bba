"""Largest inner products by one bit for each dimension of randomly rotated vectors, with reranking inside error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.plans.storage import materialize

BLOCK = 4096  # vectors of an index block, and of a query block
TOGETHER = 64  # index blocks that one search reads in turn, each with what the earlier ones have found
MOST_PARTITIONS = 20_000
BOUND = 3.0  # standard deviations of the estimate that count as possible
SEED = 10
FIELDS = "block long, dim int, ids binary, rows binary, codes binary, factors binary, vectors binary"
PAIRS = 1 << 16  # vectors that are scored together


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix for vectors of ``dim`` components, filled up to whole bytes of bits."""
    width = -(-dim // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:dim]


def codes_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors, and two scalars of each: its scale and its error.

    A vector of length ``n`` whose unit form has the inner product ``c`` with its code's unit form gets the estimate ``n / c``
    times the code's inner product with a query, which is unbiased over rotations; the estimate's standard deviation is
    ``n * sqrt((1 - c * c) / (c * c) / (width - 1))`` times the query's length.
    """
    turned = vectors @ rotation(vectors.shape[1])
    width = turned.shape[1]
    length = np.linalg.norm(turned, axis=1)
    match = np.abs(turned).sum(axis=1) / np.sqrt(width) / length
    spread = length * np.sqrt(np.maximum(1 - match**2, 0) / match**2 / max(width - 1, 1))
    return np.packbits(turned > 0, axis=1), np.stack([length / match, spread], axis=1)


def usable(vector: F.Column) -> F.Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(rows: DataFrame, coded: bool = True) -> DataFrame:
    """``rows`` (``row, vec_id, vector`` of doubles) as blocks of vectors of one length, with their codes if ``coded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims):
                picked = np.flatnonzero(dims == dim)
                for at in range(0, len(picked), BLOCK):
                    own = picked[at : at + BLOCK]
                    vectors = lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, dim)
                    ids, numbers = batch.column("vec_id").to_numpy()[own], batch.column("row").to_numpy()[own]
                    packed, factors = codes_of(vectors) if coded else (np.zeros(0, np.uint8), np.zeros(0))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([int(numbers[0])], pa.int64()), "dim": pa.array([dim], pa.int32()),
                            "ids": [ids.tobytes()], "rows": [numbers.tobytes()], "codes": [packed.tobytes()], "factors": [factors.tobytes()],
                            "vectors": [vectors.tobytes()],
                        }
                    )

    return rows.mapInArrow(run, FIELDS)


def scores(vectors: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, added from the first component to the last."""
    out = np.empty(len(row))
    columns, asked = np.ascontiguousarray(vectors.T), np.ascontiguousarray(queries.T)
    for at in range(0, len(row), PAIRS):
        r, q = row[at : at + PAIRS], query[at : at + PAIRS]
        total = np.zeros(len(r))
        for x, y in zip(columns, asked, strict=True):
            total += x[r] * y[q]
        out[at : at + PAIRS] = total
    return out


class Search:
    """The nearest found so far of the queries of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.rows, self._vectors, self._k = ids, rows, vectors, k
        self._turned = (vectors @ rotation(vectors.shape[1])).astype(np.float32)
        self._length = np.linalg.norm(vectors, axis=1).astype(np.float32)
        self.query, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _least(self) -> np.ndarray:
        """The k-th best score of each query so far, or minus infinity."""
        least = np.full(len(self.ids), -np.inf)
        sizes = np.bincount(self.query, minlength=len(self.ids))
        ends = np.cumsum(sizes)
        full = np.flatnonzero(sizes == self._k)
        least[full] = self.score[ends[full] - 1]
        return least

    def read(self, ids: np.ndarray, numbers: np.ndarray, codes: np.ndarray, factors: np.ndarray, vectors: np.ndarray) -> None:
        """Estimates all products from the bits, and scores the vectors that may be among the k nearest."""
        width = self._turned.shape[1]
        signs = np.unpackbits(codes, axis=1)[:, :width].astype(np.float32) * 2 - 1
        scale, spread = factors.astype(np.float32).T
        least = self._least()
        rows, queries = [], []
        for at in range(0, len(self.ids), 256):
            part = slice(at, at + 256)
            guess = (self._turned[part] @ signs.T) * (scale / np.float32(np.sqrt(width)))
            error = self._length[part, None] * spread * np.float32(BOUND)
            own = self.rows[part, None] == numbers[None, :]
            bar = least[part]
            if len(ids) > self._k:
                low = np.where(own, -np.inf, guess - error)
                bar = np.maximum(bar, np.partition(low, -self._k, axis=1)[:, -self._k])
            # float rounding must not cost a neighbour: the bar is lowered by its share
            slack = np.float32(1e-5) * self._length[part, None] * scale
            q, r = np.nonzero((guess + error + slack >= bar[:, None]) & ~own)
            rows.append(r)
            queries.append(q + at)
        row, query = np.concatenate(rows), np.concatenate(queries)
        query_all = np.concatenate([self.query, query])
        found = np.concatenate([self.found, ids[row]])
        score = np.concatenate([self.score, scores(vectors, self._vectors, row, query)])
        order = np.lexsort((found, -score, query_all))
        query_all = query_all[order]
        rank = np.arange(len(order)) - np.searchsorted(query_all, query_all)
        order = order[rank < self._k]
        self.query, self.found, self.score = query_all[rank < self._k], found[order], score[order]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product with each query.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own; ties go to the
    smaller vec_id. Rows without a vec_id, and vectors that are null, zero or hold a null or non-finite component take no
    part; vectors meet those of their own length only. Rows that repeat a vec_id are candidates, and queries, each of its own.
    Query blocks meet index blocks by a key of query block and group of index blocks; each search keeps k rows of a query.
    """
    rows = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # a row keeps its number
    index = materialize(blocks(rows), "onebit")
    asked = materialize(blocks(rows.filter(F.col("vec_id") % every == 0), coded=False), "asked")
    groups = max(1, index.count() // TOGETHER)
    group = F.pmod(F.xxhash64("block"), F.lit(groups))
    asked = asked.select(F.col("block").alias("search"), "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"))
    keys = asked.select("search", F.col("dim").alias("of_dim"))
    left = index.withColumn("group", group).join(keys, F.col("dim") == F.col("of_dim")).drop("of_dim")
    right = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    # a search takes long for its few bytes, so each gets a partition of its own instead of being coalesced by size
    key, n = ["search", "dim", "group"], max(1, min(asked.count() * groups, MOST_PARTITIONS))
    met = left.repartition(n, *key).join(right.repartition(n, *key), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, search = None, None

        def told() -> Iterator[pa.RecordBatch]:
            if search is not None and len(search.query):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(search.rows[search.query]), pa.array(search.ids[search.query]), pa.array(search.found), pa.array(search.score)],
                    ["query_row", "query_id", "vec_id", "score"],
                )

        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                dim = one["dim"].as_py()
                now = (one["search"].as_py(), dim, one["group"].as_py())
                if now != key:
                    yield from told()
                    ids = np.frombuffer(one["q_ids"].as_buffer(), np.int64)
                    numbers = np.frombuffer(one["q_rows"].as_buffer(), np.int64)
                    key, search = now, Search(ids, numbers, np.frombuffer(one["q_vectors"].as_buffer()).reshape(-1, dim), k)
                ids = np.frombuffer(one["ids"].as_buffer(), np.int64)
                codes = np.frombuffer(one["codes"].as_buffer(), np.uint8).reshape(len(ids), -1)
                factors = np.frombuffer(one["factors"].as_buffer()).reshape(-1, 2)
                search.read(ids, np.frombuffer(one["rows"].as_buffer(), np.int64), codes, factors, np.frombuffer(one["vectors"].as_buffer()).reshape(-1, dim))
        yield from told()

    part = met.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
