"""Importance resampling towards a target corpus: hashed word runs, array-scored weights, ranks by a distributed radix sort."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.components import keep_rows, text_hash
from hushlake.llm.crc import run_checksums
from hushlake.llm.radix import CHUNK, radix_ranked
from hushlake.plans.storage import materialize

BUCKETS = 10_000
LEAST_WORDS = 20  # of a document that can be drawn
PER_CENT = 5
SEED = 42
SCALE = 1000  # weights and scores are whole thousandths


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Word runs of the texts of ``rows`` in each bucket. A task adds up its own rows; the driver gets one sum a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, crc in run_checksums(batch.column(0)):
                total += np.bincount(crc % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of a bucket's smoothed share in the target to that in the source, in thousandths rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Seeded Gumbel noise of a document in thousandths, rounded down; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-SCALE * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight, score`` for every row of ``docs``; ``target`` has a column ``text``."""
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, runs, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, one, crc in run_checksums(batch.column("text")):
                low = text.min()
                at, size = text - low, text.max() - low + 1
                words[low : low + size] += np.bincount(at[one], minlength=size)
                runs[low : low + size] += np.bincount(at, minlength=size)
                # sums of whole numbers far below 2^53, so exact in doubles
                weight[low : low + size] += np.bincount(at, gains[crc % BUCKETS], size).astype(np.int64)
            ids = batch.column("doc_id")
            total = weight + np.fromiter((noise(i, seed) for i in ids.to_pylist()), np.int64, n)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("text_hash"), *map(pa.array, (words, runs, weight, total))],
                ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), docs["text"].alias("text"))
    return rows.mapInArrow(score, "doc_id long, text_hash long, n_words long, n_features long, weight long, score long")


def importance_ranks(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """The rows of :func:`scored` with ``rank``: 1, 2, 3 ... of those drawn by highest score, null for the others.

    A document's weight is the sum of its word runs' gains, its score the weight with Gumbel noise, so that the highest scores are a
    draw without replacement in proportion to the exponential of the weight. ``per_cent`` (rounded down) of the
    documents with 20 words or more are drawn; ties go to the smaller ``doc_id``, null last. Rows equal in both stand in the order they
    were written in. Null and empty texts have no run and weight 0, and are never drawn; repeated rows count each.
    """
    rows = materialize(scored(docs, target, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = rows.filter(F.col("n_words") >= LEAST_WORDS)
    most = able.count() * per_cent // 100
    keyed = able.select("row", "score", F.col("doc_id").isNull().cast("long").alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    drawn = radix_ranked(keyed, "row", [("score", True), ("unnamed", False), ("id", False)], most, chunk)
    return rows.join(drawn, "row", "left").drop("row")


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` that are drawn; rows equal in id and text are drawn together if one of them is."""
    return keep_rows(docs, importance_ranks(docs, target, **settings).filter("rank IS NOT NULL"))
