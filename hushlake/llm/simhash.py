"""SimHash fingerprints of word shingles, linked through tables of distances to reference fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from hushlake.llm.components import cell_links, components, keep_rows, text_hash, unused
from hushlake.llm.near_copies import near_copies
from hushlake.plans.storage import materialize

SEED = 42
BITS = 3  # fingerprints link at so many differing bits or fewer
PIVOTS = 24  # reference fingerprints
#: First bits of the five blocks of a fingerprint. Three bits touch three blocks at most, so two blocks agree.
CUTS = (0, 13, 26, 39, 52, 64)


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of the lower-cased three-word shingles of a text; 0 without words."""
    words = text.lower().split()  # of bytes: lowers A-Z and cuts at ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(line, SEED)
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(blanks[:-2] + 1).tolist()], [*blanks[2:].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bits of a long text are unpacked piece by piece
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The 64 bits as a signed long; null texts have fingerprint 0."""
    blobs = texts.cast(pa.large_binary())
    bits = np.fromiter((fingerprint(b.as_py() or b"") for b in blobs), np.uint64, len(blobs))
    return pa.array(bits.view(np.int64))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, spread by a generator with a fixed seed."""
    return np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64)


def near(prints: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of fingerprints that differ in ``bits`` bits or fewer.

    The distances to the reference fingerprints of two such fingerprints differ by ``bits`` at most in every coordinate.
    Rows are sorted by the first coordinate, so that only a window of rows is looked at; the other coordinates discard
    pairs of the window, and what survives is verified.
    """
    table = np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    table = table[order]
    first = table[:, 0]
    ends = np.searchsorted(first, first + bits, side="right")
    width = ends - np.arange(len(first)) - 1
    left_out, right_out = [], []
    for start in range(0, len(first), 256):
        counts = width[start : start + 256]
        left = np.repeat(np.arange(start, start + len(counts)), counts)
        right = left + 1 + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        for coordinate in range(1, table.shape[1]):
            if len(left) < 64:
                break
            alike = np.abs(table[left, coordinate] - table[right, coordinate]) <= bits
            left, right = left[alike], right[alike]
        alike = np.abs(table[left] - table[right]).max(axis=1, initial=0) <= bits
        left, right = order[left[alike]], order[right[alike]]
        close = np.bitwise_count(prints[left] ^ prints[right]) <= bits
        left_out.append(left[close])
        right_out.append(right[close])
    return np.concatenate(left_out), np.concatenate(right_out)


def _cells(value: F.Column) -> F.Column:
    """The cells of a fingerprint: for each two of its five blocks, which two they are and their bits."""
    cells = []
    for n, (i, j) in enumerate(combinations(range(5), 2)):
        key = F.lit(0).cast("long")
        for block in (i, j):
            width = CUTS[block + 1] - CUTS[block]
            bits = F.shiftrightunsigned(value, CUTS[block]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        cells.append(key + F.lit(n << 32).cast("long"))
    return F.array(*cells)


def _fingerprint_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, text_hash, bits`` of ``docs``, and their fingerprints ``bits, first, class``.

    ``first`` is the smallest doc_id of a fingerprint, ``class`` the smallest fingerprint reachable over links of at most three differing bits.
    """
    marked = materialize(
        docs.select("doc_id", text_hash(docs["text"]).alias("text_hash"), fingerprints(docs["text"]).alias("bits")), "prints"
    )
    distinct = marked.groupBy("bits").agg(F.min("doc_id").alias("first"))
    cells = distinct.select(F.explode(_cells(F.col("bits"))).alias("cell"), F.col("bits").alias("id"))
    grown = components(cell_links(cells, lambda rows: near(rows.column("id").to_numpy().view(np.uint64))))
    classes = distinct.join(grown, distinct["bits"] == grown["node"], "left").select(
        "bits", "first", F.coalesce("component", "bits").alias("class")
    )
    return marked, materialize(classes, "classes")


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, bits, component_id`` for every row of ``docs``.

    ``bits`` is the fingerprint as a signed long, ``component_id`` the smallest doc_id reachable over links of at most
    three differing bits. Equal fingerprints are folded before anything is compared, so a group of copies is one row.
    Two fingerprints can only link if they share a cell; in each cell the distance table to the reference fingerprints
    discards pairs and the rest is verified, which finds every link. Null and empty texts have fingerprint 0 and link
    like others; rows that repeat a doc_id count each; a null doc_id never names a component unless all ids are null.
    """
    marked, classes = _fingerprint_classes(docs)
    named = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    ids = classes.join(named, "class").select("bits", "component_id")
    return marked.join(ids, "bits").select("doc_id", "text_hash", "bits", "component_id")


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, class`` for every row of ``docs``: components over the links of fingerprints and those of :func:`near_copies`."""
    marked, prints = _fingerprint_classes(docs)
    copies = materialize(near_copies(docs), "copies")
    # A text is in one class of each kind. The classes of texts of one fingerprint class become one.
    own = marked.join(prints.withColumnRenamed("class", "print"), "bits").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "print").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    pairs = materialize(copies.distinct().join(own, same).select("print", "class").distinct(), "pairs")
    low = pairs.groupBy("print").agg(F.min("class").alias("low"))
    grown = components(pairs.join(low, "print").select(F.col("class").alias("a"), F.col("low").alias("b")))
    return copies.join(grown, copies["class"] == grown["node"], "left").select("doc_id", "text_hash", F.coalesce("component", "class").alias("class"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class of :func:`near_classes`: the smallest doc_id (nulls last; of its rows, the
    smallest text). Rows of one doc_id that are in different classes are told apart.

    Texts are linked by their fingerprints, as in the components above. Three bits miss most edited copies, so texts of a
    verified Jaccard similarity are linked too.
    """
    found = materialize(near_classes(docs), "classes")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("first"))
    heads = found.join(first, "class").filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).drop("first")
    sizes = heads.groupBy("class").agg(F.count("*").alias("n"))
    heads = materialize(heads.join(sizes, "class").distinct(), "heads")
    # most classes have one row of their first doc_id: it is known before any text moves, and others are compared by text
    alone = keep_rows(docs, heads.filter("n = 1"))
    of_class, of_id, of_hash, copy = unused(docs, "_class", "_kept_id", "_kept_hash", "_copy")
    tied = heads.filter("n > 1").select(F.col("class").alias(of_class), F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (text_hash(F.col("text")) == F.col(of_hash))
    order = Window.partitionBy(of_class).orderBy("text")
    tied = docs.join(tied, same).withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1)
    return alone.union(tied.select(*docs.columns))
