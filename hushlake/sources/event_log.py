"""The activity log: messages are scrubbed before they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.functions.patterns import pattern_scrub


def event_log(raw: DataFrame) -> DataFrame:
    """``(…, kind, message)`` rows, batch or stream, with a scrubbed message."""
    return raw.withColumn("message", pattern_scrub(F.col("message")))
