"""Hook for a pluggable recogniser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ("text", "x", "y", "width", "height", "confidence")
SCHEMA = (
    "session_id long, frame_id long, status string, region_id long, text string, "
    "x double, y double, width double, height double, confidence double"
)


def run_detector(frames: DataFrame, recognize: Callable[[bytes], list[dict]]) -> DataFrame:
    """Regions of every frame ``(session_id, frame_id, png)`` from a user function.

    Any failure becomes one row with ``status = 'error'`` and nothing else: never an
    empty success, and never the text of the exception.  A frame without text gives
    one ``ok`` row without a region.
    """

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for frame in batch.itertuples():
                key = (frame.session_id, frame.frame_id)
                try:
                    regions = [tuple(r.get(c) for c in COLUMNS) for r in recognize(bytes(frame.png))]
                    rows += [(*key, "ok", n, *r) for n, r in enumerate(regions)] or [(*key, "ok", None, *[None] * 6)]
                except Exception:
                    rows.append((*key, "error", None, *[None] * 6))
            yield pd.DataFrame(rows, columns=names)

    return frames.select("session_id", "frame_id", "png").mapInPandas(detect, SCHEMA)
