"""Captured frames: PNG files or a table with PNG bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.records import PNG_SIGNATURE


def read_png_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of every PNG below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true")
    return files.load(folder).select("path", "content")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images of a folder: ``(path, width, height, channels, data)``."""
    image = F.col("image")
    return spark.read.format("image").option("dropInvalid", "false").load(folder).select(
        image["origin"].alias("path"), image["width"].alias("width"), image["height"].alias("height"),
        image["nChannels"].alias("channels"), image["data"].alias("data"),
    )


def frame_scan(frames: DataFrame, content: str = "content") -> DataFrame:
    """Size and SHA-256 of each frame, read from the PNG header; anything else is an error row."""
    png = F.col(content)
    valid = (F.hex(F.substring(png, 1, 8)) == PNG_SIGNATURE) & (F.length(png) >= 24)
    word = lambda at: F.conv(F.hex(F.substring(png, at, 4)), 16, 10).cast("long")
    return frames.select(
        "*",
        F.when(valid, "ok").otherwise("not_png").alias("status"),
        F.when(valid, word(17)).alias("width"),
        F.when(valid, word(21)).alias("height"),
        F.sha2(png, 256).alias("raw_hash"),
    )
