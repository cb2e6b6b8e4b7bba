"""Repeated and nearly repeated paragraphs and passages across documents, by banded MinHash of word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hushlake.llm.components import cell_links, components, unused
from hushlake.plans.storage import materialize

SHINGLE = 5  # words
SIMILAR = 0.8  # Jaccard similarity of two paragraphs' shingles from which on they are near copies
FEW = 3  # so many shingles or fewer are similar to equal ones only: 3 of 4 are under 0.8
ROWS = 2  # minima of a band
BANDS = 7  # at similarity 0.8 some band agrees with probability 1 - (1 - 0.8 ** 2) ** 7 > 0.999
PASSAGE = 51  # so many words in a row that two texts share, wherever they stand, hold a unit of both
UNIT = 16  # words of a unit of running text; a paragraph of fewer is a brief one
WINDOW = PASSAGE - UNIT + 1  # shingles; the least of them marks where a unit begins
PIECE = 1 << 20  # bytes of text that are cut into words together
BUCKETS = 1 << 20  # bound of the set that keeps unshared paragraphs out of a shuffle
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[int], list[int], list[int], list[list[bytes]]]]:
    """For pieces of a batch: doc_ids, and of every line with a word its row, number, first word's number and lower-cased words."""
    for batch in batches:
        first, size = 0, 0
        row, place, start, words = [], [], [], []
        for r, text in enumerate(batch.column("text").cast(pa.large_binary())):
            blob = (text.as_py() or b"").lower()  # of bytes: lowers A-Z only
            at = 0
            for n, line in enumerate(blob.split(b"\n")):
                if parts := line.split():
                    row.append(r - first)
                    place.append(n)
                    start.append(at)
                    words.append(parts)
                    at += len(parts)
            size += len(blob)
            if size >= PIECE or r == batch.num_rows - 1:
                if words:
                    yield batch.column("doc_id").slice(first, r + 1 - first), row, place, start, words
                first, size = r + 1, 0
                row, place, start, words = [], [], [], []


def digests(words: list[list[bytes]]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words), np.uint64, len(words))


def _hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each list has."""
    counts = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for w in words for x in w), np.uint64, int(counts.sum())), counts


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words that begin at each word, as far as so many follow."""
    n = max(0, len(hashes) - length + 1)
    run = hashes[:n]
    for k in range(1, length):
        run = _mix(run * _STEP + hashes[k : n + k])
    return run


def shingles_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all paragraphs, and where each paragraph's start."""
    hashes, counts = _hashes(words)
    ends = np.cumsum(counts)
    run = _runs(hashes, SHINGLE)
    inside = np.ones(len(hashes), bool)  # shingles do not go over a paragraph's end
    for n in range(1, SHINGLE):
        inside[ends - n] = False
    return run[inside[: len(run)]], np.concatenate([[0], np.cumsum(counts - SHINGLE + 1)[:-1]])


def minima(shingles: np.ndarray, starts: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """The cells of each set of shingles, one for every band of minima."""
    random = np.random.default_rng(5).integers(0, 2**64, (2, rows * bands), dtype=np.uint64)
    cells = np.zeros((len(starts), bands), np.uint64)
    for n in range(rows * bands):
        low = np.minimum.reduceat(_mix(shingles * (random[0, n] | np.uint64(1)) + random[1, n]), starts)
        cells[:, n // rows] = _mix(cells[:, n // rows] * _STEP + low + np.uint64(n))
    return cells.view(np.int64)


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (a minimum or maximum) of every ``width`` neighbouring values."""
    size = 1
    while 2 * size <= width:
        values, size = least(values[:-size], values[size:]), 2 * size
    return least(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def unit_starts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units begin among the words of several texts that end at ``ends``.

    The MinHash of a stretch of ``WINDOW`` shingles is its least one (all of them, if equal); every stretch of a text marks
    that word. Marks depend on the words of a stretch alone, so ``PASSAGE`` words that two texts share mark the same ones.
    """
    run = _runs(hashes, SHINGLE)
    if len(run) < WINDOW:
        return np.zeros(0, np.int64)
    low = _sliding(run, WINDOW, np.minimum)
    at = np.arange(len(low))
    low[at + WINDOW + SHINGLE - 1 > ends[np.searchsorted(ends, at, "right")]] = 0  # over the end of a text
    edge = np.zeros(WINDOW - 1, np.uint64)
    # no stretch around a shingle has a least one above it, so it is the least of one if the greatest of those is its own
    high = _sliding(np.concatenate([edge, low, edge]), WINDOW, np.maximum)
    starts = np.flatnonzero((high == run) & (high > 0))
    return starts[starts + UNIT <= ends[np.searchsorted(ends, starts, "right")]]


def _told(words: list[list[bytes]], hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """Ids of paragraphs, and which have more than ``FEW`` shingles, with the shingles of those.

    Equal ids are one text: the same words, or the same shingles where they are few. Only the others need cells.
    """
    ids, run = digests(words), _runs(hashes, SHINGLE)
    many, sets = [], []
    for n, (w, end) in enumerate(zip(words, ends.tolist(), strict=True)):
        if len(w) < SHINGLE:
            continue
        own = run[end - len(w) : end - SHINGLE + 1]
        if len(own) <= FEW or len(set(w)) < SHINGLE + FEW:  # each further shingle brings one new word at most
            distinct = np.unique(own)
            if len(distinct) <= FEW:
                ids[n] = xxhash.xxh3_64_intdigest(distinct.tobytes(), 1)
                continue
        many.append(n)
        sets.append(own)
    return ids, many, sets


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs with their cells, and units (without a line number and without cells)."""
    names = ["doc_id", "paragraph", "start", "n_words", "id", "cells"]
    for doc_id, rows, place, start, words in _paragraphs(batches):
        hashes, counts = _hashes(words)
        ends, row, start = np.cumsum(counts), np.array(rows), np.array(start, np.int32)
        ids, many, sets = _told(words, hashes, ends)
        firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
        flat = minima(np.concatenate(sets), firsts).ravel() if sets else np.zeros(0, np.int64)
        sizes = np.zeros(len(words), np.int32)
        sizes[many] = BANDS
        cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        numbers = [pa.array(place, pa.int32()), pa.array(start), pa.array(counts.astype(np.int32)), pa.array(ids.view(np.int64))]
        yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(row)), *numbers, cells], names)
        at = unit_starts(hashes, ends[np.append(row[1:] != row[:-1], True)])
        if not len(at):
            continue
        line = np.searchsorted(ends, at, "right")
        ids = np.zeros(len(at), np.uint64)
        for k in range(UNIT):
            ids = _mix(ids * _STEP + hashes[at + k])
        begin = (start[line] + at - (ends - counts)[line]).astype(np.int32)
        numbers = [pa.nulls(len(at), pa.int32()), pa.array(begin), pa.array(np.full(len(at), UNIT, np.int32)), pa.array(ids.view(np.int64))]
        yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(row[line])), *numbers, pa.nulls(len(at), cells.type)], names)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each distinct paragraph of a piece of a batch that can have cells."""
    for *_, words in _paragraphs(batches):
        lines = {b" ".join(w) for w in words if len(w) >= SHINGLE + FEW}
        ids = np.fromiter((xxhash.xxh3_64_intdigest(line) for line in lines), np.uint64, len(lines))
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(list(lines), pa.binary())], ["of", "line"])


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked sets of shingles of a block, enough of them to span the components of its links.

    Each set is held against one more of each component until it joins it; sets of too different sizes are passed over.
    """
    order = sorted(range(len(sets)), key=lambda n: len(sets[n]))
    groups: list[list[int]] = []  # members of each component so far, from small to large sets
    left, right = [], []
    for n in order:
        own = sets[n]
        joined = []
        for at, group in enumerate(groups):
            for m in reversed(group):
                if len(sets[m]) < SIMILAR * len(own):
                    break
                both = len(np.intersect1d(own, sets[m], assume_unique=True))
                if both >= SIMILAR * (len(own) + len(sets[m]) - both):
                    left.append(n)
                    right.append(m)
                    joined.append(at)
                    break
        merged = sorted((m for at in joined for m in groups[at]), key=lambda m: len(sets[m]))
        groups = [g for at, g in enumerate(groups) if at not in joined] + [[*merged, n]]
    return np.array(left, np.int64), np.array(right, np.int64)


def _similar_lines(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return similar([np.unique(shingles_of([line.as_py().split()])[0]) for line in block.column("line")])


def _repeats(docs: DataFrame) -> DataFrame:
    """Every repeated paragraph and unit but the first of its cluster, and whether its document has ``company`` for it."""
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    kinds = "doc_id long, paragraph int, start int, n_words int, id long, cells array<long>"
    found = materialize(source.mapInArrow(_signed, kinds), "paragraphs")

    def with_lines(shared: DataFrame) -> DataFrame:
        ids = materialize(shared.select("id").distinct(), "shared")
        bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS))
        marks = F.broadcast(ids.select(bucket("id").alias("bucket")).distinct())  # BUCKETS rows at most
        lines = source.select("text").withColumn("doc_id", F.lit(0)).mapInArrow(_lines, "of long, line binary")
        lines = lines.join(marks, bucket("of") == F.col("bucket"), "left_semi").join(ids, F.col("of") == F.col("id"), "left_semi")
        lines = lines.groupBy("of").agg(F.first("line").alias("line"))
        return shared.join(lines, shared["id"] == lines["of"]).drop("of")

    cells = found.filter("paragraph IS NOT NULL").select(F.explode("cells").alias("cell"), "id")
    grown = components(cell_links(cells, _similar_lines, with_lines))
    placed = found.drop("cells")
    paragraphs = placed.filter("paragraph IS NOT NULL").join(grown, F.col("id") == F.col("node"), "left")
    paragraphs = paragraphs.withColumn("class", F.coalesce("component", "id")).drop("id", "node", "component")
    named = paragraphs.unionByName(placed.filter("paragraph IS NULL").withColumnRenamed("id", "class"))
    place = F.struct("doc_id", "start", "paragraph")
    first = named.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialize(first, "first")  # a plain table: the join can split a class that holds many of the rows
    repeated = named.join(first, "class").filter(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "paragraph", "start", "n_words", F.col("first.doc_id").alias("cluster_doc_id"),
        F.col("first.paragraph").alias("cluster_paragraph"), F.col("first.start").alias("cluster_start"),
    )
    repeated = materialize(repeated, "repeated")
    strong = repeated.filter(F.col("paragraph").isNull() | (F.col("n_words") >= UNIT)).select(F.col("doc_id").alias("_strong")).distinct()
    strong = strong.withColumn("company", F.lit(True))
    joined = repeated.join(strong, F.col("doc_id").eqNullSafe(F.col("_strong")), "left").drop("_strong")
    return joined.withColumn("company", F.coalesce("company", F.lit(False)))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, start, n_words, cluster_doc_id, cluster_paragraph, cluster_start`` of what repeats earlier text.

    *Paragraphs* are lines with a word; ``paragraph`` is the line's number, ``start`` the number of its first word in the
    text, both from 0. Words are cut at ASCII blanks, A-Z lowered. Paragraphs of the same words are one text, and texts
    whose five-word shingles have a Jaccard similarity of 0.8 or more are linked (under five words only the same words
    meet); a cluster is a component of links. *Units* are ``UNIT`` words of running text, over line ends, that begin
    where a sliding MinHash says (``paragraph`` is null): any ``PASSAGE`` words in a row that stand in two places share
    a unit, also within longer lines. One other word within leaves a unit under 0.8 unless it is near its edge, so
    units cluster by equal words. Equal words are told by 64 bits.

    The first place of a cluster (smallest doc_id, nulls first, then start) stays and is named by the ``cluster_`` columns;
    every other one is a row here. Brief paragraphs (under ``UNIT`` words: menus, greetings, licence lines) recur in
    documents that have nothing else in common, so they are returned only for documents that also repeat a longer
    paragraph or a unit; :func:`brief_paragraphs` returns all others. Documents that share nothing do not appear.
    Repeated rows repeat their paragraphs; of equal places none is returned unless an earlier place has the same.
    Null and empty texts have no paragraphs; rows with a null doc_id count as one document.
    """
    return _repeats(docs).filter("company").drop("company")


def brief_paragraphs(docs: DataFrame) -> DataFrame:
    """The repeated brief paragraphs that :func:`repeated_paragraphs` leaves alone, with the same columns and rules."""
    return _repeats(docs).filter("NOT company").drop("company")


def _left(text: bytes, places: list[dict]) -> bytes:
    """What of a text is in none of the places; a word takes the blanks behind it along, and a line that loses all words goes."""
    lines = {p["paragraph"] for p in places if p["paragraph"] is not None}
    gone = {k for p in places if p["paragraph"] is None for k in range(p["start"], p["start"] + p["n_words"])}
    kept, at = [], 0
    for n, line in enumerate(text.split(b"\n")):
        cuts = [m.start() for m in _WORD.finditer(line)]
        held = [k for k in range(len(cuts)) if at + k not in gone]
        at += len(cuts)
        if n in lines or (cuts and not held):
            continue
        if len(held) < len(cuts):
            ends = [*cuts[1:], len(line)]
            line = line[: cuts[0]] + b"".join(line[cuts[k] : ends[k]] for k in held)
        kept.append(line)
    return b"\n".join(kept)


@F.arrow_udf(StringType())
def _without(texts: pa.Array, places: pa.Array) -> pa.Array:
    pairs = zip(texts.cast(pa.large_binary()), places, strict=True)
    return pa.array([t.as_py() if not (p := g.as_py()) else _left(t.as_py(), p) for t, g in pairs], pa.large_binary()).cast(pa.string())


def drop_repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``docs`` whose ``text`` lacks the places of :func:`repeated_paragraphs`; rows whose doc_id is null keep theirs."""
    of, lost = unused(docs, "_of", "_gone")
    gone = repeated_paragraphs(docs).filter("doc_id is not null").groupBy(F.col("doc_id").alias(of))
    gone = gone.agg(F.collect_set(F.struct("paragraph", "start", "n_words")).alias(lost))
    joined = docs.join(gone, F.col("doc_id") == F.col(of), "left")
    return joined.withColumn("text", _without("text", lost)).select(*docs.columns)
