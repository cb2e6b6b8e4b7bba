"""Pair labels with the regions that hold their values.

Regions of a frame are keyed by ``(session, frame, level, band)``: the level is that of
their own height, a band of level n a strip of ``BAND * 2 ** n`` pixels.  A label looks at
each level with the reach that regions of this level have, so one very tall region costs
the labels of its frame a band or two, and only labels right above it look past it.  No
task therefore holds a whole session or a whole frame, and no frame is paired with
itself in full.  Of the regions near a label only the few that can take part in
the result (``CHAIN`` below, the nearest one to the right, the first masked one)
survive a per-label rank, which Spark prunes before the shuffle.  Text rules about
neighbours are evaluated on those few only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions import patterns as P
from hushlake.operators.joins import deal_by, dealt, same_deal, tasks_for

# ---- fixed values -----------------------------------------------------------
CHAIN = 5  # regions below a label
ADDRESS_CHAIN = 4  # further regions of an address
STREET_CHAIN = 2  # further regions of a street line
ADDRESS_LINES = 4
RIGHT_GAP = 240
MIN_X_SLACK = 32
MIN_GAP = 36
GAP_RATIO = 2.8
# -----------------------------------------------------------------------------
BAND = 256  # height of a band of the lowest level, which holds regions up to that height
TOP_LEVEL = 40
STRIP = 8192  # more than a start of at most BAND pixels reaches along low regions, which is about 4,900

KEY = ["session_id", "frame_id"]


def clean(regions: DataFrame) -> DataFrame:
    """Trimmed, non-blank regions with a confidence."""
    r = regions.withColumn("text", P.strip(F.col("text"))).filter(F.col("text") != "")
    confidence = F.col("confidence").cast("double") if "confidence" in r.columns else F.lit(1.0)
    return r.select(*KEY, "region_id", "text", "x", "y", "width", "height", confidence.alias("confidence"))


def anchors_of(cleaned: DataFrame) -> DataFrame:
    """Label rows and street rows; secret labels that are only help text are left out."""
    text = F.col("text")
    rows = (
        cleaned.withColumn("label", P.label_of(text))
        .withColumn("street", P.has_street(text))
        .filter((F.col("label") != "") | F.col("street"))
        .withColumn("is_label", F.col("label") != "")
        .withColumn("label_kind", F.when(F.col("is_label"), P.kind_of_label(F.col("label"))))
        .withColumn("label_value", P.label_value(text))
        .withColumn("explicit", F.col("is_label") & (F.col("label_kind") == "SECRET") & P.is_explicit(text))
    )
    help_text = (F.col("label_kind") == "SECRET") & ~F.col("explicit") & P.is_helper(text)
    return rows.filter(~F.coalesce(help_text, F.lit(False))).withColumn("start", own_item())


def own_item() -> Column:
    """A region as its own contribution to a finding; sorts by reading order."""
    return F.struct("y", "x", "region_id", "text", "width", "height", "confidence")


def _chain(items: Column, height: Column, bottom: Column, limit: int) -> Column:
    """Longest prefix of regions below, each close enough to the one kept before it."""
    gap = F.greatest(F.lit(MIN_GAP), height * GAP_RATIO)
    state = lambda edge, done, size: F.struct(edge.cast("double").alias("edge"), done.alias("done"), size.alias("size"))
    kept = F.aggregate(
        items,
        state(bottom, F.lit(False), F.lit(0)),
        lambda s, r: F.when(
            s["done"] | (r["y"] - s["edge"] > gap) | (P.label_of(r["text"]) != ""), state(s["edge"], F.lit(True), s["size"])
        ).otherwise(state(r["y"] + r["height"], F.lit(False), s["size"] + 1)),
        lambda s: s["size"],
    )
    return F.slice(items, 1, F.least(kept, F.lit(limit)))


def _level(height: Column) -> Column:
    """Smallest level whose bands are as high as a region; a millionth more, as logarithms are not exact."""
    high = F.ceil(F.log2(height / F.lit(BAND)) + 1e-6)
    return F.when(height > BAND, F.least(high, F.lit(TOP_LEVEL))).otherwise(0).cast("int")


def _size(level: Column) -> Column:
    return F.when(level < TOP_LEVEL, BAND * F.pow(F.lit(2.0), level)).otherwise(F.lit(float("inf")))


def _band(y: Column, level: Column) -> Column:
    return F.floor(y / (BAND * F.pow(F.lit(2.0), level))).cast("long")


def _strips(y: Column, count: int) -> Column:
    """Bits of ``count`` strips from the one of ``y`` on; strips 64 apart share a bit."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(y / STRIP) + k, F.lit(64)).cast("int")) for k in range(count)]
    return bits[0] if count == 1 else bits[0].bitwiseOR(bits[1])


def probes_of(starts: DataFrame, regions: DataFrame, limit: int = CHAIN, sideways: bool = True, tasks: int = 0) -> DataFrame:
    """Cells of the grid that each start looks into: ``region_id, s, a, _level, _band``.

    ``s`` is what the search needs of a start; ``a``, the whole row, is on the one row without a cell.
    """
    # of each frame: one huge region does not make the labels of other frames look further
    y, is_tall = F.col("y").cast("double"), F.col("height") > BAND
    extent = F.struct(
        F.min(y).alias("top"),
        F.max(y).alias("bottom"),
        F.max("height").cast("double").alias("tall"),
        F.max(F.when(~is_tall, F.col("height"))).cast("double").alias("low"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _level(F.col("height")))).alias("levels"),
        F.min(F.when(is_tall, y)).alias("tall_from"),
        F.max(F.when(is_tall, y)).alias("tall_to"),
        F.bit_or(F.when(is_tall, _strips(y, 1))).alias("tall_strips"),
    )
    levels = F.filter(F.sequence(F.lit(0), F.lit(TOP_LEVEL)), lambda k: F.call_function("shiftright", F.col("_page.levels"), k) % 2 == 1)
    pages = regions.groupBy(*KEY).agg(extent.alias("_page")).withColumn("_levels", levels).withColumnsRenamed({k: f"_page_{k}" for k in KEY})
    # null keys have a page like others, and a row without a page keeps its own value
    own_page = F.col("session_id").eqNullSafe(F.col("_page_session_id")) & F.col("frame_id").eqNullSafe(F.col("_page_frame_id"))
    a = F.col("s")
    gap = F.greatest(F.lit(MIN_GAP), a["height"] * GAP_RATIO)
    tall = F.col("_page.tall")
    reach = lambda taken: a["y"] + a["height"] + limit * gap + (limit - 1) * taken
    # Without a tall region that starts in reach of a chain of low ones, no chain goes further than that.
    low = reach(F.coalesce("_page.low", F.lit(0.0)))
    in_reach = (F.col("_page.tall_from") <= low) & (F.col("_page.tall_to") >= a["y"])
    in_reach = in_reach & (F.col("_page.tall_strips").bitwiseAND(_strips(a["y"], 2)) != 0)
    far = F.coalesce(in_reach, F.lit(False)) | (a["height"] > BAND)
    down = F.when(far, reach(tall)).otherwise(low)
    secret = F.coalesce(F.col("label_kind") == "SECRET", F.lit(False)) if sideways else F.lit(False)
    slim = F.struct(*[F.col("start")[c].alias(c) for c in ("y", "x", "width", "height", "region_id")], secret.alias("secret"))

    # Bands of one level that a region of this level can lie in, beside the start or below it; those above the first or
    # below the last region of the frame hold nothing.
    level = F.col("_level")
    half = 0.5 * F.greatest(a["height"].cast("double"), F.least(tall, _size(level))) if sideways else F.lit(0.0)
    first = _band(F.greatest(a["y"] - half, F.col("_page.top")), level)
    last = F.greatest(first, _band(F.least(F.greatest(down, a["y"] + half), F.col("_page.bottom")), level))
    known = level.isNotNull() & first.isNotNull() & last.isNotNull() & a["y"].isNotNull()
    # One row without a level carries the whole start row; the rows that look around are slim.
    none = F.lit(None).cast("long")
    rows = starts.select(*KEY, "region_id", slim.alias("s"), F.struct(*[c for c in starts.columns if c not in KEY]).alias("a"))
    if tasks:
        rows = deal_by(rows, tasks, "_frame", s=F.col("session_id"), f=F.col("frame_id"))
        pages = deal_by(pages, tasks, "_page_frame", s=F.col("_page_session_id"), f=F.col("_page_frame_id"))
        own_page = same_deal("_frame", "_page_frame")
    return (
        rows.join(dealt(pages), own_page, "left")
        .withColumn("_level", F.explode(F.concat(F.array(F.lit(None).cast("int")), F.coalesce("_levels", F.array().cast("array<int>")))))
        .withColumn("a", F.when(level.isNull(), F.col("a")))
        .withColumn("_band", F.explode(F.when(known, F.sequence(first, last)).when(level.isNull(), F.array(none)).otherwise(F.array().cast("array<long>"))))
        .select(*KEY, "region_id", "s", "a", "_level", "_band")
    )


def neighbours(starts: DataFrame, regions: DataFrame, limit: int = CHAIN, sideways: bool = True, tasks: int = 0) -> DataFrame:
    """Add ``below`` (ordered chain), and with ``sideways`` also ``right`` and ``masked_right``.

    Every row of ``starts`` has a ``region_id`` and a ``start`` region to look from; a
    NULL start keeps the row and finds nothing.  ``right`` is the leftmost non-label
    region on the same line; for a secret label helper text is no candidate, and
    ``masked_right`` is the first masked one.  With ``tasks`` (see ``tasks_for``) every
    exchange deals its rows to as many.
    """
    a, n = F.col("s"), F.col("n")
    left = probes_of(starts, regions, limit, sideways, tasks)
    own = _level(F.col("height"))
    right = regions.select(
        F.col("session_id").alias("_s"), F.col("frame_id").alias("_f"), own.alias("_l"), _band(F.col("y"), own).alias("_b"), own_item().alias("n")
    )
    is_below = (n["y"] >= a["y"] + a["height"] * 0.5) & (
        F.abs(n["x"] - a["x"]) <= F.greatest(F.lit(MIN_X_SLACK), a["height"] * 2)
    )
    beside = (
        F.lit(sideways)
        & (n["x"] >= a["x"] + a["width"])
        & (F.abs(n["y"] - a["y"]) <= F.greatest(a["height"], n["height"]) * 0.5)
        & (n["x"] - a["x"] - a["width"] <= RIGHT_GAP)
    )
    if tasks:
        # a level of -1 or -2 is none; without NULL both structs are of one type
        place = lambda level, band, none: {"l": F.coalesce(F.col(level), F.lit(none)), "b": F.coalesce(F.col(band), F.lit(0).cast("long"))}
        left = deal_by(left, tasks, "_cell", s=F.col("session_id"), f=F.col("frame_id"), **place("_level", "_band", -1))
        right = deal_by(right, tasks, "_n_cell", s=F.col("_s"), f=F.col("_f"), **place("_l", "_b", -2))
        cell = ["_cell_hash", "_cell"]
        same_cell = same_deal("_cell", "_n_cell") & F.col("_band").isNotNull() & F.col("_b").isNotNull()
    else:
        cell = []
        same_cell = (
            F.col("session_id").eqNullSafe(F.col("_s"))
            & F.col("frame_id").eqNullSafe(F.col("_f"))
            & (F.col("_level") == F.col("_l"))
            & (F.col("_band") == F.col("_b"))
        )
    near_by = same_cell & (n["region_id"] != a["region_id"]) & (is_below | beside)
    pairs = left.join(dealt(right), near_by, "left").filter(F.col("a").isNotNull() | n.isNotNull()).select(*KEY, "region_id", "s", "a", "n", *cell)
    some = lambda cond, role: F.when(cond, F.array(F.lit(role))).otherwise(F.array().cast("array<string>"))
    roles = some(is_below, "below")
    if sideways:
        wanted = beside & (P.label_of(n["text"]) == "") & ~(a["secret"] & P.is_helper(n["text"]))
        roles = F.concat(roles, some(wanted, "right"), some(wanted & a["secret"] & P.is_masked(n["text"]), "masked"))
    roles = F.when(n.isNull(), F.array(F.lit("self"))).otherwise(roles)
    ranked_rows = pairs.select(*KEY, "region_id", "a", "n", *cell, F.explode(roles).alias("role"))
    by_x = F.col("role") == "right"
    nearest = [F.when(by_x, n["x"]).otherwise(n["y"]), F.when(by_x, n["y"]).otherwise(n["x"]), n["region_id"]]
    near = lambda *by: F.row_number().over(Window.partitionBy(*by, *KEY, "region_id", "role").orderBy(*nearest))
    if tasks:
        # a cell's own nearest are found where the join left them; only these move
        ranked_rows = ranked_rows.withColumn("_rank", near(*cell)).filter(F.col("_rank") <= limit).drop(*cell, "_rank")
        ranked_rows = ranked_rows.repartition(tasks, *KEY, "region_id")
    few = ranked_rows.withColumn("_rank", near()).filter(F.col("_rank") <= limit)
    first = lambda role: F.first(F.when((F.col("role") == role) & (F.col("_rank") == 1), n), ignorenulls=True)
    grouped = few.groupBy(*KEY, "region_id").agg(
        F.first("a", ignorenulls=True).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "below", n))).alias("_below"),
        *([first("right").alias("right"), first("masked").alias("masked_right")] if sideways else []),
    )
    start = F.col("a.start")
    chain = F.when(start.isNotNull(), _chain(F.col("_below"), start["height"], start["y"] + start["height"], limit))
    out = [F.col(c) if c in KEY else F.col("a")[c].alias(c) for c in starts.columns]
    return grouped.select(*out, chain.alias("below"), *(["right", "masked_right"] if sideways else []))


def pair_labels(cleaned: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every usable label row and street row with its chain and the value it selects.

    Adds ``below`` and ``selected`` (the region the value comes from, NULL for none).
    """
    tasks = tasks_for(cleaned) if tasks is None else tasks
    near = neighbours(anchors_of(cleaned), cleaned, tasks=tasks)
    secret = F.col("label_kind") == "SECRET"
    following = F.when(secret, F.filter("below", lambda r: ~P.is_helper(r["text"]))).otherwise(F.col("below"))
    masked_below = F.filter(following, lambda r: P.is_masked(r["text"]))
    masked = F.when(secret, F.coalesce("masked_right", F.get(masked_below, 0)))
    apart = F.coalesce(masked, F.col("right"), F.get(following, 0))
    selected = F.when(F.col("is_label"), F.when(F.col("label_value") != "", F.col("start")).otherwise(apart))
    return near.withColumn("selected", selected)


def _add_lines(first_text: Column, first: Column, more: Column, keep) -> Column:
    """Fold following regions into ``(value, items)`` while ``keep(value, region)`` holds."""
    state = lambda value, items, done: F.struct(value.alias("value"), items.alias("items"), done.alias("done"))
    return F.aggregate(
        more,
        state(first_text, F.array(first), F.lit(False)),
        lambda s, r: F.when(s["done"] | ~keep(s["value"], r), state(s["value"], s["items"], F.lit(True))).otherwise(
            state(F.concat(s["value"], F.lit("\n"), r["text"]), F.concat(s["items"], F.array(r)), F.lit(False))
        ),
    )


def street_block() -> Column:
    """A street row with up to two postal or unit lines right below it."""
    more = F.slice("below", 1, STREET_CHAIN)
    extra = lambda value, r: r["text"].rlike(P.CITY_POSTAL) | r["text"].rlike(P.UNIT_LINE)
    return F.when(F.col("street"), _add_lines(F.col("text"), F.col("start"), more, extra))


def _address(text: Column, first: Column, below: Column) -> Column:
    lines = lambda v: F.size(F.split(v, P.LINE_END, -1))
    open_end = lambda value, r: ~value.rlike(P.CITY_POSTAL) & (lines(value) < ADDRESS_LINES)
    return _add_lines(text, first, F.slice(below, 1, ADDRESS_CHAIN), open_end)


def label_blocks(cleaned: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pairs plus ``street_block`` and ``address_block`` = ``(value, items)``, NULL where there is none.

    An address runs from its first line to the postal code, four lines or the next
    label.  The following lines are looked up from that first line, which may stand
    apart from the label; rows without an address pass the second lookup untouched.
    """
    tasks = tasks_for(cleaned) if tasks is None else tasks
    paired = pair_labels(cleaned, tasks)
    address = (F.col("label_kind") == "ADDRESS") & F.col("selected").isNotNull()
    ready = (
        paired.withColumn("street_block", street_block())
        .withColumn("start", F.when(address, F.col("selected")))
        .drop("below", "right", "masked_right")
    )
    looked = neighbours(ready, cleaned, ADDRESS_CHAIN, sideways=False, tasks=tasks)
    text = F.when(F.col("label_value") != "", F.col("label_value")).otherwise(F.col("selected.text"))
    block = F.when(F.col("start").isNotNull(), _address(text, F.col("selected"), F.col("below")))
    return looked.withColumn("address_block", block).drop("start", "below")
