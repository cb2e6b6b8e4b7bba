"""Runs of password dots near a password label.

Labels meet components by tiles of the frame, and a start meets the components of its own row and size a run's reach
ahead. No array holds the components of a label, and what a start folds is bounded by the pixels of a strip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions import patterns as P

# ---- fixed values -----------------------------------------------------------
SIZE = (2, 14)
ASPECT = (0.65, 1.55)
FILL = (0.25, 1.0)
CENTER = 0.7
AREA = (0.7, 1.3)
SHAPE = 0.8
RUN = (3, 32)
SPAN = 320
PAD = 3
STEP = (3, 4)  # widths and pixels from one dot to the next at most
# -----------------------------------------------------------------------------
TILE = 256  # pixels
AHEAD = SPAN + STEP[0] * SIZE[1] + STEP[1]  # a run that gets further than this is too long already
NEAR = ["frame_id", "label_id", "polarity", "confidence"]
GLYPH = ["x", "y", "w", "h", "area", "shape"]


def is_password_label(text: Column) -> Column:
    return P.strip(text).rlike(P.PASSWORD_LABEL)


def candidates(labels: DataFrame, components: DataFrame, frame_width: int, frame_height: int) -> DataFrame:
    """Small, filled components below or right of a label, a row for each with its label.

    ``labels(frame_id, label_id, label_x, label_y, label_width, label_height, confidence)``,
    ``components(frame_id, polarity, x, y, w, h, area, fill_center[, shape])``.
    """
    lx, ly = F.col("label_x").cast("double"), F.col("label_y").cast("double")
    lw, lh = F.col("label_width").cast("double"), F.col("label_height").cast("double")
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    shaped = components.filter(
        w.between(*SIZE)
        & h.between(*SIZE)
        & (w / h).between(*ASPECT)
        & (F.col("area") / (w * h)).between(*FILL)
        & (F.col("fill_center") >= CENTER)
    )
    left = F.greatest(F.lit(0), (lx - 8).cast("int"))
    top = F.greatest(F.lit(0), (ly - 4).cast("int"))
    right = F.least(F.lit(frame_width), (lx + F.greatest(lw + 320, F.lit(400.0))).cast("int"))
    bottom = F.least(F.lit(frame_height), (ly + lh + F.greatest(F.lit(70.0), lh * 3)).cast("int"))
    in_crop = (x >= left) & (y >= top) & (x + w <= right) & (y + h <= bottom)
    beside = (x >= lx + lw - 2) & (F.abs((y + h / 2) - (ly + lh / 2)) <= F.greatest(F.lit(10.0), lh * 0.6))
    below = (y >= ly + lh - 2) & (x >= lx - 8)
    shape = F.col("shape") if "shape" in components.columns else F.lit(None).cast("array<tinyint>")
    tile = lambda c: F.floor(c / TILE)
    tiles = lambda low, high: F.explode(F.sequence(tile(low), tile(F.greatest(low, high))))
    # clipped to the frame, so a label has as many tiles as the frame at most
    looking = labels.withColumn("_tx", tiles(F.least(left, F.lit(frame_width)), right)).withColumn("_ty", tiles(F.least(top, F.lit(frame_height)), bottom))
    placed = shaped.withColumn("_tx", tile(x)).withColumn("_ty", tile(y))
    met = looking.join(placed, ["frame_id", "_tx", "_ty"]).filter(in_crop & (beside | below))
    return met.withColumn("shape", shape).select(*NEAR, *GLYPH)


def _agrees(c: Column, first: Column) -> Column:
    """Shapes agree on enough pixels after scaling to the first one's size (nearest pixel)."""

    def at(i):
        row = F.floor(F.floor(i / first["w"]) * c["h"] / first["h"]).cast("int")
        col = F.floor(F.pmod(i, first["w"]) * c["w"] / first["w"]).cast("int")
        return (F.get(c["shape"], row * c["w"] + col) == F.get(first["shape"], i)).cast("int")

    cells = F.sequence(F.lit(0), first["w"] * first["h"] - 1)
    same = F.aggregate(F.transform(cells, at), F.lit(0), lambda a, b: a + b)
    return c["shape"].isNull() | first["shape"].isNull() | (same >= SHAPE * first["w"] * first["h"])


def _alike(c: Column, first: Column) -> Column:
    """On the same row, of the same size and shape."""
    near = lambda name: F.abs(c[name] - first[name]) <= 1
    return near("y") & near("w") & near("h") & (c["area"] / first["area"]).between(*AREA) & _agrees(c, first)


def _run_from(first: Column, glyphs: Column) -> Column:
    """Follow one start through the sorted glyphs that are like it and collect its run."""
    state = lambda run, pitch, done: F.struct(run.alias("run"), pitch.cast("int").alias("pitch"), done.alias("done"))

    def step(s, c):
        dx = c["x"] - F.element_at(s["run"], -1)["x"]
        too_far = dx > first["w"] * STEP[0] + STEP[1]
        fits = (dx >= first["w"] + 1) & (s["pitch"].isNull() | (F.abs(dx - s["pitch"]) <= 1))
        grown = state(F.concat(s["run"], F.array(c)), F.coalesce(s["pitch"], dx), F.lit(False))
        return (
            F.when(s["done"] | too_far, state(s["run"], s["pitch"], F.lit(True)))
            .when(fits, grown)
            .otherwise(state(s["run"], s["pitch"], F.lit(False)))
        )

    return F.aggregate(glyphs, state(F.array(first), F.lit(None), F.lit(False)), step, lambda s: s["run"])


def glyph_runs(near: DataFrame) -> DataFrame:
    """Regular runs of the rows of :func:`candidates`, one row per start; ``order`` is the order in which starts are tried.

    A start meets what is like it by bins of its row and of the strips that a run can reach.
    """
    strip, row = F.floor(F.col("x") / AHEAD), F.floor("y")
    nth = Window.partitionBy(*NEAR).orderBy(*GLYPH)
    starts = (
        near.withColumn("n", F.row_number().over(nth) - 1)
        .select(*NEAR, "n", F.struct(*GLYPH).alias("first"), F.explode(F.sequence(row - 1, row + 1)).alias("_row"), F.array(strip, strip + 1).alias("_strip"))
        .withColumn("_strip", F.explode("_strip"))
    )
    others = near.select(*[F.col(k).alias(f"_{k}") for k in NEAR], F.struct(*GLYPH).alias("c"), row.alias("_at"), strip.alias("_in"))
    own = (F.col("_row") == F.col("_at")) & (F.col("_strip") == F.col("_in"))
    for k in NEAR:
        own = own & F.col(k).eqNullSafe(F.col(f"_{k}"))
    c, first = F.col("c"), F.col("first")
    ahead = (c["x"] > first["x"]) & (c["x"] - first["x"] <= AHEAD)
    met = starts.join(others, own & ahead & _alike(c, first))
    runs = met.groupBy(*NEAR, "n").agg(F.first("first").alias("first"), F.array_sort(F.collect_list("c")).alias("glyphs"))
    runs = runs.withColumn("run", _run_from(F.col("first"), F.col("glyphs"))).drop("glyphs", "first")
    span = F.element_at("run", -1)["x"] - F.element_at("run", 1)["x"]
    return (
        runs.filter(F.size("run").between(*RUN) & (span <= SPAN))
        .withColumn("order", F.struct("label_id", "polarity", "n"))
        .drop("label_id", "polarity", "n")
    )


def drop_prose(runs: DataFrame, prose: DataFrame) -> DataFrame:
    """Runs without a glyph centre inside recognised text.

    ``prose(frame_id, px, py, pwidth, pheight)``.
    """
    centre_in = F.exists(
        "run",
        lambda c: (F.col("px") <= c["x"] + c["w"] / 2)
        & (c["x"] + c["w"] / 2 < F.col("px") + F.col("pwidth"))
        & (F.col("py") <= c["y"] + c["h"] / 2)
        & (c["y"] + c["h"] / 2 < F.col("py") + F.col("pheight")),
    )
    inner = prose.withColumnRenamed("frame_id", "_pf")
    return runs.join(inner, (F.col("frame_id") == F.col("_pf")) & centre_in, "left_anti")


def glyph_regions(runs: DataFrame, frame_width: int, frame_height: int) -> DataFrame:
    """Padded boxes of runs; a box inside an earlier one of the frame is dropped."""
    low = lambda name: F.array_min(F.transform("run", lambda c: c[name]))
    high = lambda a, b: F.array_max(F.transform("run", lambda c: c[a] + c[b]))
    left = F.greatest(F.lit(0), F.element_at("run", 1)["x"] - PAD)
    box = F.struct(
        "order",
        left.alias("x"),
        F.greatest(F.lit(0), low("y") - PAD).alias("y"),
        F.least(F.lit(frame_width), high("x", "w") + PAD).alias("right"),
        F.least(F.lit(frame_height), high("y", "h") + PAD).alias("bottom"),
        F.size("run").alias("length"),
        "confidence",
    )
    # Boxes already known from another start of the same frame are folded before they are compared.
    distinct = runs.select("frame_id", box.alias("b")).groupBy("frame_id", "b.x", "b.y", "b.right", "b.bottom").agg(F.min("b").alias("b"))
    frames = distinct.groupBy("frame_id").agg(F.array_sort(F.collect_list("b")).alias("boxes"))
    contained = lambda b, q: (b["x"] >= q["x"]) & (b["y"] >= q["y"]) & (b["right"] <= q["right"]) & (b["bottom"] <= q["bottom"])
    kept = F.filter("boxes", lambda b, i: ~F.exists(F.slice("boxes", F.lit(1), i), lambda q: contained(b, q)))
    out = frames.select("frame_id", F.explode(kept).alias("b"))
    return out.select(
        "frame_id",
        F.repeat(F.lit("•"), F.col("b.length")).alias("text"),
        "b.x",
        "b.y",
        (F.col("b.right") - F.col("b.x")).alias("width"),
        (F.col("b.bottom") - F.col("b.y")).alias("height"),
        "b.confidence",
    )
