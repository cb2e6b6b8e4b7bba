"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from hushlake.plans.storage import materialize

WIDTH = 4096  # hashed n-grams
PER_LANGUAGE = 400  # labelled documents of each language that a model is fitted on, at most
CENTROIDS = 4  # of each language, at most
LEAST_TEXTS = 0.05  # share of a language's drawn texts that each of its centroids has at least
MAX_LANGUAGES = 1000  # distinct labels; more of them fail, as a model of 16 KB a centroid is held whole
SEED = 42
LEAST_SHARE = 0.25  # of a centroid's first percentile of own similarities, below which a text is rejected
SPREAD = 16
SLAB = 1 << 20  # bytes looked at together
RESULT = StructType(
    [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
)

#: Bytes of words stay, all others become one blank.
_WORD = np.zeros(256, np.uint8) + 32
_WORD[97:123] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray  # least similarity that each centroid accepts


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Hashed counts of the two- and three-byte grams of every lower-cased text."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    counts = np.zeros((len(texts), WIDTH), np.float32)
    if not len(texts) or offsets[-1] == offsets[0]:
        return counts
    data = _WORD[np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]]
    for start in range(int(offsets[0]), int(offsets[-1]), SLAB):
        end = min(start + SLAB, int(offsets[-1]))
        doc = np.searchsorted(offsets, np.arange(start, end), side="right") - 1
        left = offsets[doc + 1] - np.arange(start, end)  # bytes up to the end of the document
        codes = np.zeros(end - start + 2, np.uint32)
        codes[: min(len(data), end + 2) - start] = data[start : end + 2]
        first = doc[0]
        for n, code in ((2, codes[:-2] | codes[1:-1] << 8), (3, codes[:-2] | codes[1:-1] << 8 | codes[2:] << 16)):
            whole = (left >= n) & (codes[:-2] + codes[1:-1] != 64)  # runs of blanks say nothing
            cell = (code[whole] + np.uint32(n << 24)) * np.uint32(2654435761) >> np.uint32(20)
            flat = np.bincount((doc[whole] - first) * WIDTH + cell, minlength=(doc[-1] - first + 1) * WIDTH)
            counts[first : doc[-1] + 1] += flat.reshape(-1, WIDTH)
    return counts


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(norms > 0, norms, 1)


def _spread(vectors: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Starts drawn one by one, each with a probability that grows with the distance to those before it."""
    picked = [int(draw.integers(len(vectors)))]
    for _ in range(k - 1):
        apart = np.clip(1 - (vectors @ vectors[picked].T).max(axis=1).astype(float), 0, None)
        apart[apart < 1e-6] = 0  # repeats of a start
        if not apart.any():
            break
        picked.append(int(draw.choice(len(vectors), p=apart / apart.sum())))
    return vectors[picked]


def _clusters(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from seeded, spread-out starts; centroids of length 1 and each vector's similarity to all of them.

    A cluster of under ``LEAST_TEXTS`` of the vectors says little of a language: its centroid goes, and its vectors join
    the nearest of the others.
    """
    centroids = _spread(vectors, k, np.random.default_rng(SEED))
    while True:
        for _ in range(12):
            own = (vectors @ centroids.T).argmax(axis=1)
            sums = np.stack([vectors[own == c].sum(axis=0) for c in range(len(centroids))])
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
        likeness = vectors @ centroids.T
        sizes = np.bincount(likeness.argmax(axis=1), minlength=len(centroids))
        smallest = int(sizes.argmin())
        if len(centroids) == 1 or sizes[smallest] >= LEAST_TEXTS * len(vectors):
            return centroids, likeness
        centroids = np.delete(centroids, smallest, axis=0)


def held_out(doc_id: F.Column) -> F.Column:
    """Documents that a model is never fitted on; rows without a doc_id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Centroids from at most ``per_language`` labelled texts of each language, drawn by a hash of the doc_id.

    Drawn texts without a letter and rows without text or ``lang`` are not learned from; of rows that repeat a doc_id the
    smallest text is. More than ``MAX_LANGUAGES`` distinct labels raise ``ValueError``. The counts of a drawn
    text and the clusters of a language are made in tasks; the driver gets document frequencies and centroids only.
    """
    keys = docs.select(docs["lang"].alias("label"), F.xxhash64(docs["doc_id"]).alias("draw"), "doc_id", "text")
    keys = keys.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    # a language's draws are dealt to SPREAD tasks, and only the first of each meet in one
    last = keys.select("label", "draw", F.pmod("draw", F.lit(SPREAD)).alias("deal")).distinct()
    for by in (("label", "deal"), ("label",)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("draw"))
        last = last.withColumn("place", place).filter(F.col("place") <= per_language)
    last = materialize(last.groupBy("label").agg(F.max("draw").alias("last")), "last")
    if last.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct values of lang")
    drawn = keys.join(F.broadcast(last), "label")  # at most MAX_LANGUAGES rows
    drawn = drawn.filter((F.col("draw") <= F.col("last")) & F.col("text").rlike(r"\p{L}"))
    chosen = drawn.groupBy("label", "draw").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                blobs = [row.tobytes() for row in gram_counts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(blobs, pa.binary())], ["label", "grams"])

    sample = materialize(chosen.select("label", "text").mapInArrow(count, "label string, grams binary"), "grams")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, has = 0, np.zeros(WIDTH, np.int64)
        for batch in batches:
            for blob in batch.column("grams"):
                rows, has = rows + 1, has + (np.frombuffer(blob.as_py(), np.float32) > 0)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([has.tobytes()], pa.binary())], ["n", "has"])

    # a sum a task, at most SPREAD of them
    parts = sample.coalesce(SPREAD).mapInArrow(seen, "n long, has binary").collect()
    rows = sum(p["n"] for p in parts)
    has = sum((np.frombuffer(p["has"], np.int64) for p in parts), np.zeros(WIDTH, np.int64))
    idf = (np.log((1 + rows) / (1 + has)) + 1).astype(np.float32)

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = np.stack([np.frombuffer(b, np.float32) for b in sorted(group["grams"])])
        centroids, likeness = _clusters(_vectors(counts, idf), CENTROIDS)
        own = likeness.argmax(axis=1)
        used = np.unique(own)
        floors = [LEAST_SHARE * np.quantile(likeness[own == c, c], 0.01) for c in used]
        blobs = [centroids[c].astype(np.float32).tobytes() for c in used]
        return pd.DataFrame({"label": key[0], "centroid": blobs, "floor": floors})

    found = sample.groupBy("label").applyInPandas(cluster, "label string, centroid binary, floor double").collect()
    found.sort(key=lambda r: (r["label"], r["centroid"]))
    centroids = [np.frombuffer(r["centroid"], np.float32) for r in found]
    return Model(
        [r["label"] for r in found], idf, np.stack(centroids) if found else np.zeros((0, WIDTH), np.float32),
        np.array([r["floor"] for r in found]),
    )


def predictor(model: Model):
    """Column function from a text to ``lang_pred, score, rejected``."""
    langs = np.array(model.langs, object)

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        preds, scores, out = [], [], []
        for at in range(0, len(texts), 64):
            part = texts.slice(at, 64)
            letter = has_letter(part)
            if not len(langs):
                letter[:] = False
                likeness, best = np.zeros(len(part)), None
            else:
                all_ = _vectors(gram_counts(part), model.idf) @ model.centroids.T
                best = all_.argmax(axis=1)
                likeness = np.clip(all_[np.arange(len(part)), best].astype(float), 0, 1)
            preds.extend(langs[best[i]] if ok else "und" for i, ok in enumerate(letter))
            scores.append(np.where(letter, likeness, 0.0))
            out.append(~letter if best is None else ~letter | (likeness < model.floors[best]))
        arrays = [
            pa.array(preds, pa.string()),
            pa.array(np.concatenate(scores) if scores else [], pa.float64()),
            pa.array(np.concatenate(out) if out else [], pa.bool_()),
        ]
        return pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs``.

    ``score`` is the cosine to the nearest centroid. A text is ``rejected`` if it is null, has no letter (then
    ``lang_pred`` is ``und`` and the score 0), or lies further from its nearest centroid than that one accepts; such a
    text still gets its nearest language. A repeated row is predicted again. Without any labelled text all is ``und``.
    """
    said = predictor(model or fit(docs))(docs["text"]).alias("said")
    return docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), said).select("doc_id", "held_out", "said.*")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is not rejected: null, letterless and far texts go, repeated rows are judged alike.

    All columns stay, whatever their names.
    """
    return docs.filter(~predictor(fit(docs))(docs["text"])["rejected"])
