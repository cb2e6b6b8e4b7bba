"""Box geometry in screenshot pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlake.functions.patterns import KINDS

PAD = 3  # fixed value: pixels added around recognised text


def finite(col: Column) -> Column:
    """Present, not NaN and not infinite."""
    c = col.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def all_finite(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [finite(c) for c in cols])


def edges(frame_width, frame_height) -> tuple[Column, Column, Column, Column]:
    """Box rounded outwards and clamped to the frame, while it is still DOUBLE: no coordinate is too far off."""
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    fw, fh = (c if isinstance(c, Column) else F.lit(c) for c in (frame_width, frame_height))
    within = lambda c, high: F.greatest(F.lit(0.0), F.least(high.cast("double"), c))
    return F.floor(within(x, fw)), F.floor(within(y, fh)), F.ceil(within(x + w, fw)), F.ceil(within(y + h, fh))


def box_reason(kind: str, value: str, frame_width, frame_height) -> Column:
    """Reason code of a finding's box; ``ok`` when it can be masked."""
    left, top, right, bottom = edges(frame_width, frame_height)
    named = F.coalesce(F.col(kind).isin(*KINDS) & (F.col(value) != ""), F.lit(False))
    return (
        F.when(~named, "invalid_finding")
        .when(~all_finite(*[F.col(c) for c in ("x", "y", "width", "height")]), "invalid_coordinates")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "invalid_dimensions")
        .when((left >= right) | (top >= bottom), "outside_frame")
        .otherwise("ok")
    )


def round_clip(frame_width, frame_height) -> Column:
    """Integer mask box that covers the finding completely inside the frame."""
    left, top, right, bottom = edges(frame_width, frame_height)
    return F.struct(
        left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")
    )


def pad_polygon(points: Column, frame_width: int, frame_height: int) -> Column:
    """Bounding box of a text polygon, padded and clamped; ``status`` names an empty result."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    whole = lambda c, high: F.greatest(F.lit(-PAD - 1.0), F.least(F.lit(high + PAD + 1.0), c))  # before it is cast
    clamp = lambda c, high: F.greatest(F.lit(0), F.least(F.lit(high), c))
    left = clamp(F.floor(whole(F.array_min(xs), frame_width)) - PAD, frame_width)
    top = clamp(F.floor(whole(F.array_min(ys), frame_height)) - PAD, frame_height)
    right = F.greatest(left, F.least(F.lit(frame_width), F.ceil(whole(F.array_max(xs), frame_width)) + PAD))
    bottom = F.greatest(top, F.least(F.lit(frame_height), F.ceil(whole(F.array_max(ys), frame_height)) + PAD))
    return F.struct(
        left.alias("x"),
        top.alias("y"),
        (right - left).alias("width"),
        (bottom - top).alias("height"),
        F.when((right <= left) | (bottom <= top), "empty_region").otherwise("ok").alias("status"),
    )


def css_to_pixels(png_width: Column, png_height: Column, view_width: Column, view_height: Column) -> Column:
    """CSS box scaled to PNG pixels, rounded outwards; partly outside or broken boxes are rejected."""
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "width", "height"))
    reason = (
        F.when((view_width <= 0) | (view_height <= 0), "missing_viewport")
        .when(~all_finite(x, y, w, h) | (w <= 0) | (h <= 0), "invalid_geometry")
        .when((x < 0) | (y < 0) | (x + w > view_width) | (y + h > view_height), "partly_outside")
        .otherwise("ok")
    )
    sx = F.when(view_width > 0, png_width / F.when(view_width > 0, view_width))
    sy = F.when(view_height > 0, png_height / F.when(view_height > 0, view_height))
    ok = reason == "ok"
    return F.struct(
        F.when(ok, F.floor(x * sx)).alias("left"),
        F.when(ok, F.floor(y * sy)).alias("top"),
        F.when(ok, F.ceil((x + w) * sx)).alias("right"),
        F.when(ok, F.ceil((y + h) * sy)).alias("bottom"),
        reason.alias("reason"),
    )


def field_visibility(metrics: dict[str, Column]) -> Column:
    """Whether a field shows its complete text; reasons say what is missing or clipped."""
    names = ("content_width", "content_height", "text_width", "text_height", "scroll_left", "scroll_top")
    m = {n: metrics[n].cast("double") for n in names}
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in m.values()])
    fits = (
        (m["content_width"] > 0)
        & (m["content_height"] > 0)
        & (m["text_width"] > 0)
        & (m["text_width"] <= m["content_width"])
        & (m["text_height"] > 0)
        & (m["text_height"] <= m["content_height"])
        & (m["scroll_left"] == 0)
        & (m["scroll_top"] == 0)
    )
    return (
        F.when(missing, "missing_measurements")
        .when(~all_finite(*m.values()), "nonfinite_measurements")
        .when(fits, "fits")
        .otherwise("clipped_or_scrolled")
    )
