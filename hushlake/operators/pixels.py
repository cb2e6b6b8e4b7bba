"""Pixel checks over ``(frame_id, x, y, ...)`` rows, and painting masks into images.

Pixel rows of a frame need not sit together: every check is a partial aggregation
per frame, and joins are keyed by the pixel itself, so no frame is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.operators.masks import MASK_RGB, SHIFT, aligned, word_of
from hushlake.plans.storage import materialize

HALF = 1 << SHIFT  # places of a word, half the bits of a long


def inside(x: Column, y: Column, box: dict) -> Column:
    """Pixel lies in ``left, top, right, bottom`` (right and bottom exclusive)."""
    return (x >= box["left"]) & (x < box["right"]) & (y >= box["top"]) & (y < box["bottom"])


def painted(rgb: Column, covered: Column) -> Column:
    """Colour after masking: opaque, whatever was below."""
    return F.when(covered, F.lit(MASK_RGB)).otherwise(rgb)


def frame_pixels(images: DataFrame) -> DataFrame:
    """Image rows ``(frame_id, width, height, channels, data)`` to pixel rows ``(frame_id, x, y, rgb)``; bytes are B, G, R.

    One image is unpacked at a time, whole columns of numbers at once. Images without area have no pixel.
    """
    kind = dict(images.dtypes)["frame_id"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, height, channels = (batch.column(c)[i].as_py() for c in ("width", "height", "channels"))
                if not width or not height or width < 1 or height < 1:
                    continue
                data = np.frombuffer(batch.column("data")[i].as_py(), np.uint8)[: width * height * channels].reshape(-1, channels).astype(np.int32)
                rgb = data[:, 0] * 65793 if channels == 1 else data[:, 2] << 16 | data[:, 1] << 8 | data[:, 0]
                at = np.arange(width * height, dtype=np.int32)
                frame = batch.column("frame_id")[i : i + 1].take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays([frame, pa.array(at % width), pa.array(at // width), pa.array(rgb)], ["frame_id", "x", "y", "rgb"])

    return images.select("frame_id", "width", "height", "channels", "data").mapInArrow(unpack, f"frame_id {kind}, x int, y int, rgb int")


def mask_independence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Masked pixels of two protected captures ``(frame_id, x, y, rgb, covered)`` that depend on what was below the masks.

    The captures differ below the masks only, so any masked pixel that is not the same in both, or is missing from one,
    shows something of it.

    A word of 32 places is one row of bit maps, the first capture in the low half and the second in the high one: which places there are,
    which are covered, and which colours are the mask's or above it. They tell all pixels apart but those that are of another
    colour than the mask's in both captures and on the same side of it. Frames with such a pixel below a mask are compared colour by colour.
    """
    wanted = ["frame_id", "x", "y", "rgb", "covered"]
    first, second = first.select(*wanted), second.select(*wanted)
    bit = lambda half: F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(F.col("x"), F.lit(0)).cast("int").bitwiseAND(HALF - 1) + half)
    side = lambda df, half: df.select("frame_id", "y", word_of(F.col("x")).alias("word"), "rgb", "covered", bit(half).alias("bit"))
    none = F.lit(0).cast("long")
    bits = lambda condition: F.coalesce(F.bit_or(F.when(condition, F.col("bit")).otherwise(none)), none)
    words = side(first, 0).unionByName(side(second, HALF)).groupBy("frame_id", "y", "word").agg(
        F.bit_or("bit").alias("there"), bits(F.col("covered")).alias("over"),
        bits(F.col("rgb") > MASK_RGB).alias("above"), bits(F.col("rgb") == MASK_RGB).alias("mask"),
    )
    # of colours at one place the highest counts, as in ``aligned``
    words = words.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not("above")))
    low = lambda c: F.col(c).bitwiseAND((1 << HALF) - 1)
    high = lambda c: F.call_function("shiftrightunsigned", F.col(c), F.lit(HALF))
    apart = lambda c: low(c).bitwiseXOR(high(c))
    over = low("over").bitwiseOR(high("over"))
    differs = apart("there").bitwiseOR(apart("above")).bitwiseOR(apart("mask"))
    alike = F.bitwise_not(differs.bitwiseOR(low("mask")))
    counted = lambda c: F.coalesce(F.sum(F.bit_count(c)), F.lit(0)).cast("long")
    frames = words.groupBy("frame_id").agg(
        counted(over).alias("masked"), counted(over.bitwiseAND(differs)).alias("dependent"), counted(over.bitwiseAND(alike)).alias("alike")
    )
    frames = materialize(frames, "frames")
    told = frames.filter("alike = 0").select("frame_id", "masked", "dependent")
    rest = frames.filter("alike > 0").select("frame_id")
    return told if rest.isEmpty() else told.unionByName(_independence(first, second, rest))


def _independence(first: DataFrame, second: DataFrame, frames: DataFrame) -> DataFrame:
    """The same for some frames, by the colours themselves."""
    both = aligned(first, second, ["frame_id", "x", "y"], frames=frames)
    covered = F.coalesce(F.col("a_covered"), F.lit(False)) | F.coalesce(F.col("b_covered"), F.lit(False))
    differs = ~F.col("in_a") | ~F.col("in_b") | ~F.col("a_rgb").eqNullSafe(F.col("b_rgb"))
    return both.groupBy("frame_id").agg(
        F.count_if(covered).alias("masked"), F.count_if(covered & differs).alias("dependent")
    )


def same_field(first: DataFrame, second: DataFrame, box: dict) -> DataFrame:
    """Frames whose field pixels are equal in two captures; a missing pixel is a difference."""
    x, y = F.col("x"), F.col("y")
    a, b = (df.filter(inside(x, y, box)).select("frame_id", "x", "y", "rgb") for df in (first, second))
    both = aligned(a, b, ["frame_id", "x", "y"])
    differs = ~F.col("in_a") | ~F.col("in_b") | ~F.col("a_rgb").eqNullSafe(F.col("b_rgb"))
    return both.groupBy("frame_id").agg(F.count_if(differs).alias("different")).withColumn("same", F.col("different") == 0)


def paint_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Fill the masks ``(frame_id, kind, x, y, width, height)`` of each frame into its image ``(frame_id, width, height, channels, data)``.

    Masks of a frame are clipped to it and brought to its image as one list; a mask outside the image, without area or
    with a NULL is none, and equal masks are one. Images without masks stay as they are; a NULL frame id is a frame like any other. One image
    is painted at a time.
    """
    kind = dict(images.dtypes)["frame_id"]
    edge = lambda at, size: F.greatest(F.lit(0), F.least(at, F.col(size)))
    sized = images.select(F.col("frame_id").alias("_frame"), F.col("width").alias("_w"), F.col("height").alias("_h")).distinct()
    known = masks.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull())
    cut = known.join(sized, known["frame_id"].eqNullSafe(sized["_frame"])).select(
        "_frame", "_w", "_h", edge(F.col("x"), "_w").cast("int").alias("left"), edge(F.col("y"), "_h").cast("int").alias("top"),
        edge(F.col("x") + F.col("width"), "_w").cast("int").alias("right"), edge(F.col("y") + F.col("height"), "_h").cast("int").alias("bottom"),
    )
    cut = cut.filter("left < right AND top < bottom").groupBy("_frame", "_w", "_h").agg(F.collect_set(F.struct("left", "top", "right", "bottom")).alias("_masks"))
    on = images["frame_id"].eqNullSafe(cut["_frame"]) & (images["width"] == cut["_w"]) & (images["height"] == cut["_h"])
    met = images.join(cut, on, "left").select(*(images[c] for c in ("frame_id", "width", "height", "channels", "data")), cut["_masks"])
    colour = {1: [MASK_RGB >> 16], 3: [MASK_RGB & 255, MASK_RGB >> 8 & 255, MASK_RGB >> 16], 4: [MASK_RGB & 255, MASK_RGB >> 8 & 255, MASK_RGB >> 16, 255]}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                boxes = row.column("_masks")[0].as_py()
                data = row.column("data")
                if boxes:
                    height, width, channels = (row.column(c)[0].as_py() for c in ("height", "width", "channels"))
                    pixels = np.frombuffer(data[0].as_py(), np.uint8).reshape(height, width, channels).copy()
                    for m in boxes:
                        pixels[m["top"] : m["bottom"], m["left"] : m["right"]] = colour[channels]
                    data = pa.array([pixels.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("frame_id", "width", "height", "channels")), data], ["frame_id", "width", "height", "channels", "data"])

    return met.mapInArrow(fill, f"frame_id {kind}, width int, height int, channels int, data binary")
