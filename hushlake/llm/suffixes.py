"""Removal of repeated byte strings by ranks of positions, doubled in length from round to round.

The rank of a position at length h names the h bytes that start there; the rank at 2h is named by the pair of ranks at
the position and h further. Names are hashes of that pair, so the task that holds a text doubles from 1 to 50 bytes without
asking anyone. From 50 bytes on Spark sorts and reranks, and positions whose rank is unique leave:

1. Ranks at 50 of sampled positions. From each 51 neighbouring positions that with the smallest rank is sampled, so the
   two places of a repeated 100-byte string have the same sample at the same distance. Unique ranks leave.
2. Rank triples at offsets -50, 0 and +50 of the samples left: the 150 bytes around. A sample whose triple occurs
   earlier has all its 100-byte strings repeated; the first of a triple goes on if its rank has several triples.
3. Rank pairs at offsets 0 and +50 of all positions that belong to the samples left: the 100-byte strings themselves.
   The new rank is the earliest position of the pair; a position that is not the earliest is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hushlake.llm.components import _groups, text_hash
from hushlake.plans.storage import materialize

HALF = 50
SPAN = 2 * HALF  # bytes of a string that counts as repeated
CROWD = 20_000  # first triples of one rank that one task handles
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)  # rank of each byte at length 1
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SPANS = "array<struct<start:int,end:int>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of a pair of ranks."""
    return _mix(left * _BASE + right)


def ranks(text: np.ndarray, length: int = HALF) -> np.ndarray:
    """Rank at ``length`` of every position of a text that has so many bytes after it, by doubling from 1."""
    rank, have = _BYTE[text], 1
    while have * 2 <= length:
        rank, have = _join(rank[:-have], rank[have:]), have * 2
    rest = length - have  # two overlapping strings name the rest
    return _join(rank[: len(rank) - rest], rank[rest:]) if rest else rank


def samples(rank: np.ndarray) -> np.ndarray:
    """Sampled position of each 100-byte string: the first of its 51 positions with the smallest rank. Never falls."""
    low, at, have = rank, np.arange(len(rank), dtype=np.int32), 1
    while have < HALF + 1:
        step = min(have, HALF + 1 - have)
        less = low[step:] < low[:-step]
        low, at = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    return at


def _around(rank: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Name of the 150 bytes around samples; where the text ends sooner, of what there is and how much that is."""
    left = np.where(at >= HALF, rank[np.maximum(at - HALF, 0)], _join(rank[:1], at.astype(np.uint64)))
    room = np.minimum(n - at, SPAN)
    right = np.where(room == SPAN, rank[np.minimum(at + HALF, len(rank) - 1)], _join(rank[-1:], room.astype(np.uint64)))
    return _join(left, _join(rank[at], right))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column("text").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for row in range(len(column)):
        yield row, data[ends[row] : ends[row + 1]]


def _firsts(keys: list[np.ndarray], doc: pa.Array, twin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks the rows at the earliest position of each distinct key; rows that repeat that position are all marked."""
    null = doc.is_null().to_numpy(zero_copy_only=False)
    place = [~null, doc.fill_null(0).to_numpy(zero_copy_only=False), twin, at]  # nulls first
    by = np.lexsort((*place[::-1], *keys[::-1]))

    def change(columns: list[np.ndarray]) -> np.ndarray:
        new = np.ones(len(by), bool)
        new[1:] = False
        for column in columns:
            new[1:] |= column[by][1:] != column[by][:-1]
        return new

    key, spot = np.cumsum(change(keys)), np.cumsum(change([*keys, *place]))
    lead = np.flatnonzero(np.diff(key, prepend=0))
    first = np.zeros(len(by), bool)
    first[by] = spot == spot[lead][key - 1] if len(by) else False
    return first


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _lists(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Rows that occur, and the merged intervals of each."""
    rows, lists = np.unique(row), []
    for r in rows:
        own = slice(*np.searchsorted(row, [r, r + 1]))  # rows come in order
        begin, stop = _merged(start[own], end[own])
        lists.append([{"start": a, "end": b} for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
    return pa.array(rows), pa.array(lists, _SPANS)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples with their ranks. Those that an earlier one in the same batch repeats are settled at once, as spans of a
    row with a ``rank`` of its own, so that what many texts share is sent on once a batch."""
    names = ["doc_id", "twin", "rank", "around", "at", "spans"]
    for whole in batches:
        for cut in range(0, whole.num_rows, 1024):
            batch = whole.slice(cut, 1024)
            parts = []
            for row, text in _texts(batch):
                if len(text) >= SPAN:
                    rank = ranks(text)
                    at = np.unique(samples(rank))
                    parts.append((np.full(len(at), row), rank[at], _around(rank, at, len(text)), at))
            if not parts:
                continue
            row, rank, around, at = map(np.concatenate, zip(*parts, strict=True))
            doc, twin = batch.column("doc_id").take(pa.array(row)), batch.column("twin").to_numpy()[row]
            go = _firsts([rank, around], doc, twin, at)
            fields = [
                doc.filter(pa.array(go)), pa.array(twin[go]), pa.array(rank[go].view(np.int64)),
                pa.array(around[go].view(np.int64)), pa.array(at[go]), pa.nulls(int(go.sum()), _SPANS),
            ]
            yield pa.RecordBatch.from_arrays(fields, names)
            if not go.all():
                rows, spans = _lists(row[~go], np.maximum(at[~go] - HALF, 0), at[~go] + SPAN)
                doc, twin = batch.column("doc_id").take(rows), batch.column("twin").take(rows)
                spread = _join(doc.fill_null(0).to_numpy().astype(np.uint64), twin.to_numpy().astype(np.uint64))
                fields = [doc, twin, pa.array(spread.view(np.int64)), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32()), spans]
                yield pa.RecordBatch.from_arrays(fields, names)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each open sample of a text, the names of its own 100-byte strings and where the first one starts."""
    for batch in batches:
        wanted = batch.column("open")
        for row, text in _texts(batch):
            rank = ranks(text)
            own = samples(rank)
            name = _join(rank[: len(own)], rank[HALF : HALF + len(own)])
            at, crowded = (np.array(v) for v in zip(*sorted((o["at"], o["crowded"]) for o in wanted[row].as_py()), strict=True))
            start, end = np.searchsorted(own, at), np.searchsorted(own, at, side="right")
            blobs = [name[a:b].tobytes() for a, b in zip(start, end, strict=True)]
            same = pa.array(np.full(len(at), row))
            fields = [
                batch.column("doc_id").take(same), batch.column("twin").take(same),
                pa.array(rank[at].view(np.int64)), pa.array(at.astype(np.int32)),
                pa.array((start - at).astype(np.int32)), pa.array(crowded), pa.array(blobs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(fields, ["doc_id", "twin", "rank", "at", "shift", "crowded", "names"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of a rank's samples that are not the earliest of their name; whole ranks arrive together, sorted."""
    for group in _groups(batches, ["rank"]):
        table = group.combine_chunks().to_batches()[0]
        doc, twin, rank = table.column("doc_id"), table.column("twin"), table.column("rank").to_numpy()
        row, start, names = _strings(table)
        first = _firsts([rank[row], names], doc.take(pa.array(row)), twin.to_numpy()[row], start)
        if not first.all():
            rows, spans = _lists(row[~first], start[~first], start[~first] + SPAN)
            yield pa.RecordBatch.from_arrays([doc.take(rows), twin.take(rows), spans], ["doc_id", "twin", "spans"])


def _strings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and name of each 100-byte string of the batch's samples."""
    names = np.frombuffer(b"".join(batch.column("names").to_pylist()), np.int64)
    count = pc.binary_length(batch.column("names")).to_numpy().astype(np.int64) // 8
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(names)) - np.repeat(np.cumsum(count) - count, count)
    start = batch.column("at").to_numpy()[row] + batch.column("shift").to_numpy()[row] + nth
    return row, start.astype(np.int32), names


def _crowded_repeats(paired: DataFrame) -> DataFrame:
    """As :func:`_repeats` for ranks with many samples: strings as rows, the earliest by a partial minimum, joined back."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, names = _strings(batch)
            fields = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "twin", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*fields, pa.array(names), pa.array(start)], ["doc_id", "twin", "rank", "name", "start"]
            )

    rows = paired.mapInArrow(strings, "doc_id long, twin int, rank long, name long, start int")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "twin", "start")
    first = rows.groupBy("rank", "name").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = rows.join(first, ["rank", "name"]).filter(~place.eqNullSafe(F.col("first")))
    return again.select("doc_id", "twin", F.array(F.struct("start", (F.col("start") + SPAN).alias("end"))).alias("spans"))


def _same(left: DataFrame, right: DataFrame) -> F.Column:
    return left["doc_id"].eqNullSafe(right["of"]) & (left["twin"] == right["of_twin"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, twin, text, rest, spans`` of every row; ``spans`` holds intervals of bytes to remove, null if none.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller doc_id, or earlier in the same document.
    A null doc_id comes before all others. Rows with the same doc_id and different texts are documents in the order
    of a hash of the text (``twin``); rows that repeat both are one document and get the same spans. Null texts are empty.
    Intervals may overlap and reach beyond the text. All that is ever grouped by document is bounded by its length.
    ``rest`` is a struct of the other columns.
    """
    twin = F.shiftrightunsigned(text_hash(docs["text"]), 33).cast("int").alias("twin")
    rest = F.struct(F.lit(0).alias("_"), *(docs[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")))
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), twin, docs["text"], rest.alias("rest"))
    sampled = source.select("doc_id", "twin", "text").mapInArrow(
        _sampled, f"doc_id long, twin int, rank long, around long, at int, spans {SPANS}"
    )
    place = [F.col("doc_id").asc_nulls_first(), "twin", "at"]
    nth = F.rank().over(Window.partitionBy("rank", "around").orderBy(*place))
    of_rank = Window.partitionBy("rank")
    ranked = (
        sampled.repartition("rank")  # serves both windows
        .withColumn("nth", nth)
        .withColumn("several", F.min("around").over(of_rank) != F.max("around").over(of_rank))
        .withColumn("firsts", F.count_if(F.col("nth") == 1).over(of_rank))
        .filter("spans is not null or nth > 1 or several")
    )
    around = F.array(F.struct(F.greatest(F.col("at") - HALF, F.lit(0)).alias("start"), (F.col("at") + SPAN).alias("end")))
    ranked = materialize(
        ranked.select(
            "doc_id", "twin", "at", (F.col("firsts") > CROWD).alias("crowded"),
            F.coalesce("spans", F.when(F.col("nth") > 1, around)).alias("spans"),
        ), "ranked",
    )
    open_ = ranked.filter("spans is null").groupBy(F.col("doc_id").alias("of"), F.col("twin").alias("of_twin"))
    open_ = open_.agg(F.collect_set(F.struct("at", "crowded")).alias("open"))
    paired = source.join(open_, _same(source, open_)).select("doc_id", "twin", "text", "open")
    paired = paired.mapInArrow(_paired, "doc_id long, twin int, rank long, at int, shift int, crowded boolean, names binary")
    crowds = not ranked.filter("spans is null and crowded").isEmpty()
    paired = materialize(paired, "paired") if crowds else paired
    few = paired.filter("not crowded") if crowds else paired
    few = few.drop("crowded").repartition("rank").sortWithinPartitions("rank")
    found = few.mapInArrow(_repeats, f"doc_id long, twin int, spans {SPANS}")
    found = found.unionByName(_crowded_repeats(paired.filter("crowded"))) if crowds else found
    found = found.unionByName(ranked.filter("spans is not null").select("doc_id", "twin", "spans"))
    spans = found.groupBy(F.col("doc_id").alias("of"), F.col("twin").alias("of_twin"))
    spans = spans.agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return source.join(spans, _same(source, spans), "left").select("doc_id", "twin", "text", "rest", "spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for cut in range(0, whole.num_rows, 1024):
            batch = whole.slice(cut, 1024)
            lists = batch.column("spans")
            ends, flat = lists.offsets.to_numpy(), lists.values
            starts, stops = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            sizes, removed, runs, kept = [], [], [], []
            for row, text in _texts(batch):
                own = slice(ends[row], ends[row + 1])
                begin, stop = _merged(starts[own], np.minimum(stops[own], len(text)))
                sizes.append(len(text))
                removed.append(int((stop - begin).sum()))
                runs.append(len(begin))
                parts = zip([0, *stop.tolist()], [*begin.tolist(), len(text)], strict=True)
                kept.append(b"".join(text[a:b].tobytes() for a, b in parts))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            fields = [batch.column("doc_id"), *numbers, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row of ``docs``; see :func:`repeated_spans`."""
    spans = repeated_spans(docs).select("doc_id", "text", "spans")
    return spans.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@F.arrow_udf(StringType())
def _left(texts: pa.Array, spans: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts, spans], ["doc_id", "text", "spans"])
    kept = [b.decode("utf-8", "ignore") for part in _cut(iter([batch])) for b in part.column("kept").to_pylist()]
    return pa.array(kept, pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text`` and ``n_chars`` counted anew.

    Cuts fall on bytes; what is left of a character that a cut goes through is dropped. A text of which nothing is left stays
    as an empty text, and a null text stays null.
    """
    cut = repeated_spans(docs).withColumn("text", _left("text", "spans"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*(own[c].alias(c) if c in own else F.col("rest")[c].alias(c) for c in docs.columns))
