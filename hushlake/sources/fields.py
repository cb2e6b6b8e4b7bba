"""Annotated private fields of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def private_field_scan(fields: DataFrame, view_width: int, view_height: int) -> DataFrame:
    """Fields with a value, clipped to the viewport; what is left has a positive area."""
    left, top = F.greatest(F.lit(0), F.col("x")), F.greatest(F.lit(0), F.col("y"))
    right = F.least(F.lit(view_width), F.col("x") + F.col("width"))
    bottom = F.least(F.lit(view_height), F.col("y") + F.col("height"))
    clipped = fields.withColumns(
        {"x": left, "y": top, "width": right - left, "height": bottom - top}
    )
    return clipped.filter((F.col("value") != "") & (F.col("width") > 0) & (F.col("height") > 0))
