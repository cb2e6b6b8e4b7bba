"""Links within shared cells, and connected components of links, both without emitting all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.plans.storage import materialize

BLOCK = 1024  # members of a cell that one comparison block takes from each side


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes under the given edges."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut batches that arrive sorted by ``keys`` into tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change) + 1
        same = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if not len(cuts):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def cell_links(
    rows: DataFrame,
    links: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    attach: Callable[[DataFrame], DataFrame] = lambda shared: shared,
) -> DataFrame:
    """Edges ``a, b`` (long) that span the components which ``links`` finds in every cell.

    ``rows``: ``cell`` and ``id`` (long). Cells of one id go first, by a partial aggregate; ``attach`` adds to what is
    left (distinct ``cell, id``) the columns that ``links`` needs. ``links`` gets the rows of one block and returns
    positions of linked rows. A cell of over ``2 * BLOCK`` rows is dealt into chunks, and each pair of chunks is compared
    in a group of its own, so that no task holds a cell and every pair of rows still meets. A block returns a spanning
    forest, never its pairs.
    """
    many = rows.groupBy("cell").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("cell")
    shared = materialize(rows.join(many, "cell").distinct(), "cells")
    shared = attach(shared).join(shared.groupBy("cell").count(), "cell")
    k = F.when(F.col("count") > 2 * BLOCK, F.ceil(F.col("count") / BLOCK)).otherwise(F.lit(1))
    own = F.pmod(F.xxhash64("id"), F.col("chunks"))
    dealt = (
        shared.withColumn("chunks", k.cast("long"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("block", F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
        .drop("count", "chunks", "own", "other")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["cell", "block"]):
            cell, block = table.column("cell").to_numpy(), table.column("block").to_numpy()
            ids = table.column("id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])]))
            a, b = [], []
            for start, end in zip(starts, [*starts[1:], len(cell)], strict=True):
                if end - start < 2:
                    continue
                own_ids = ids[start:end]
                label = roots(end - start, *links(table.slice(start, end - start)))
                moved = np.flatnonzero(label != np.arange(end - start))
                a.append(own_ids[moved])
                b.append(own_ids[label[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return (
        dealt.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(run, "a long, b long").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of the edges ``a, b`` (long), by alternating stars.

    Each round first points every larger neighbour at a node's smallest neighbour, then every smaller one. Minima are
    partial aggregates, and the joins back on a hub's key are left for adaptive execution to split. Rounds are written
    tables; they end when the edges no longer change, after about log2 of the longest chain. Loops and null ends go.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    low = edges.groupBy("a").agg(F.min("b").alias("b"))
    return low.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        low.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as make them no column of ``docs``, whatever their case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``(doc_id, text)`` is in ``kept`` (``doc_id, text_hash``, as by :func:`text_hash`)."""
    of_id, of_hash = unused(docs, "_kept_id", "_kept_hash")
    kept = kept.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (text_hash(F.col("text")) == F.col(of_hash))
    return docs.join(kept, same, "left_semi")


def text_hash(text) -> F.Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(text)
