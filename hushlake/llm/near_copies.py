"""Near copies among whole documents: banded MinHash of five-word shingles, verified Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.components import cell_links, components, keep_rows, text_hash
from hushlake.llm.paragraphs import SHINGLE, digests, minima, shingles_of, similar
from hushlake.plans.storage import materialize

PIECE = 1 << 20  # bytes of text that are cut into words together
ROWS = 3  # minima of a band
BANDS = 10  # at similarity 0.8 some band agrees with probability 1 - (1 - 0.8 ** 3) ** 10 > 0.999


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Pieces of the batches with the lower-cased words of each text."""
    for batch in batches:
        start, size, words = 0, 0, []
        for n, text in enumerate(batch.column("text").cast(pa.large_binary())):
            blob = text.as_py() or b""
            words.append(blob.lower().split())  # of bytes: lowers A-Z and cuts at ASCII blanks only
            size += len(blob)
            if size >= PIECE or n == batch.num_rows - 1:
                yield batch.slice(start, n + 1 - start), words
                start, size, words = n + 1, 0, []


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece, words in _pieces(batches):
        long = [w for w in words if len(w) >= SHINGLE]
        flat = minima(*shingles_of(long), ROWS, BANDS).ravel() if long else np.zeros(0, np.int64)
        ends = np.cumsum([0, *(BANDS if len(w) >= SHINGLE else 0 for w in words)], dtype=np.int32)
        cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        fields = [piece.column("doc_id"), piece.column("text_hash"), pa.array(digests(words).view(np.int64)), cells]
        yield pa.RecordBatch.from_arrays(fields, ["doc_id", "text_hash", "id", "cells"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words in _pieces(batches):
        words = [w for w in words if len(w) >= SHINGLE]
        if words:
            shingles, starts = shingles_of(words)
            blobs = [np.unique(s).tobytes() for s in np.split(shingles, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(digests(words).view(np.int64)), pa.array(blobs, pa.binary())], ["of", "shingles"])


def _similar_texts(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return similar([np.frombuffer(b, np.uint64) for b in block.column("shingles").to_pylist()])


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, class`` for every row of ``docs``; rows of a class are copies or near copies.

    Texts of the same words (cut at ASCII blanks, A-Z lowered) are one text. Texts whose five-word shingles have a Jaccard
    similarity of 0.8 or more are linked, and a class is a component of links. Candidates share a band of MinHash, which
    a pair at 0.8 does with a probability over 0.999; each link is verified on the shingles themselves. Texts under five
    words have no shingle and only equal ones meet; null, empty and blank texts are one text without words.
    """
    source = docs.select("doc_id", text_hash(docs["text"]).alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(source.mapInArrow(_signed, f"doc_id {kind}, text_hash long, id long, cells array<long>"), "signed")

    def with_sets(shared: DataFrame) -> DataFrame:
        # cells of the same members find the same links: one of them is enough
        members = shared.groupBy("cell").agg(F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        shared = shared.join(members.groupBy("x", "y").agg(F.min("cell").alias("cell")).select("cell"), "cell")
        ids = shared.select("id").distinct()
        named = signed.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
        texts = keep_rows(docs.select("doc_id", "text"), named.select("row.*")).select("text")
        sets = texts.mapInArrow(_sets, "of long, shingles binary").groupBy("of").agg(F.first("shingles").alias("shingles"))
        return shared.join(sets, shared["id"] == sets["of"]).drop("of")

    cells = signed.select(F.explode("cells").alias("cell"), "id")
    grown = components(cell_links(cells, _similar_texts, with_sets))
    named = signed.join(grown, signed["id"] == grown["node"], "left")
    return named.select("doc_id", "text_hash", F.coalesce("component", "id").alias("class"))
