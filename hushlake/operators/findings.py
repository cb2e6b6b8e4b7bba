"""From regions to findings: the whole classifier as one DataFrame pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions import patterns as P
from hushlake.operators import pairing as G
from hushlake.operators.joins import tasks_for
from hushlake.operators.vault import known_kind, vault_rematch
from hushlake.plans.storage import delete_shuffles, materialize

KEY = G.KEY
# Order in which one region's sources are read.
PATTERN, VAULT, GREETING, LABELLED, STREET = range(5)


def region_scan(regions: DataFrame) -> DataFrame:
    """Regions with trimmed text and a status; blank ones are dropped, impossible ones are errors."""
    numbers = [F.col(c).cast("double") for c in ("x", "y", "width", "height")]
    finite = reduce(lambda a, b: a & b, [n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")) for n in numbers])
    status = (
        F.when(~finite, "not_finite")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "empty_region")
        .otherwise("ok")
    )
    text = P.strip(F.col("text"))
    return regions.withColumn("text", text).filter(F.col("text") != "").withColumn("status", status)


def fail_closed(scanned: DataFrame) -> DataFrame:
    """Keep only frames without a single bad region; one error withholds its whole frame, also one with NULL keys."""
    bad = scanned.filter(F.col("status") != "ok").select(*(F.col(k).alias(f"_bad_{k}") for k in KEY)).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_bad_{k}")) for k in KEY])
    return scanned.join(bad, same, "left_anti").drop("status")


def reading_order(regions: DataFrame) -> DataFrame:
    """Position of each region in its frame, top to bottom, then left to right.

    Regions of a frame are ordered in bands of rows, so a huge frame is shared out.
    """
    from hushlake.operators.ordered import ordered

    band = F.floor(F.col("y") / F.lit(G.BAND)).cast("long")
    return ordered(regions, KEY, ["y", "x", "region_id"], band, number="position")


def finding_merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Union box and lowest confidence of the regions that make up one finding."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return parts.groupBy(*by).agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (right - F.min("x")).alias("width"),
        (bottom - F.min("y")).alias("height"),
        F.min("confidence").alias("confidence"),
    )


def _merged(items: Column) -> list[Column]:
    """The same for an array of paired regions."""
    left = F.array_min(F.transform(items, lambda r: r["x"]))
    top = F.array_min(F.transform(items, lambda r: r["y"]))
    right = F.array_max(F.transform(items, lambda r: r["x"] + r["width"]))
    bottom = F.array_max(F.transform(items, lambda r: r["y"] + r["height"]))
    return [
        left.alias("x"),
        top.alias("y"),
        (right - left).alias("width"),
        (bottom - top).alias("height"),
        F.array_min(F.transform(items, lambda r: r["confidence"])).alias("confidence"),
    ]


def trim_value(value: Column) -> Column:
    return F.trim(value, F.lit(P.VALUE_TRIM))


def _order(rank: int, sub: Column | None = None) -> Column:
    """Scan position of a finding: its region in reading order, then the source."""
    return F.struct(
        F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("region_id").alias("r"),
        F.lit(rank).alias("s"), (F.lit(0) if sub is None else sub).cast("long").alias("n"),
    )


def _hit(kind, value, source, rank, box, sub=None, explicit=None) -> Column:
    """One finding as a struct of the region row it is read from."""
    return F.struct(
        _order(rank, sub).alias("order"),
        kind.alias("kind"),
        trim_value(value).alias("value"),
        F.lit(source).alias("source"),
        (F.lit(False) if explicit is None else explicit).alias("explicit_secret"),
        *box,
    )


def _own_box() -> list:
    return ["x", "y", "width", "height", "confidence"]


def _explode(rows: DataFrame, hits: Column) -> DataFrame:
    """Non-null findings of every row."""
    return rows.select(*KEY, F.inline(F.array_compact(hits)))


def line_findings(cleaned: DataFrame) -> DataFrame:
    """What single lines give away by themselves: email, phone and secret shapes, greetings."""
    text = F.col("text")

    def tagged(kind, base):
        return lambda m, i: _hit(F.lit(kind), m, "local-pattern", PATTERN, _own_box(), sub=i.cast("long") + F.lit(base))

    # Matches of a kind follow those of the kind before; no line can have 2**40 matches.
    shapes = [
        F.transform(P.matches(text, pattern), tagged(kind, k << 40)) for k, (kind, pattern) in enumerate(P.REGISTRY)
    ]
    name = P.greeting_name(text)
    greeting = F.when(name.isNotNull(), _hit(F.lit("NAME"), name, "visible-greeting", GREETING, _own_box()))
    return _explode(cleaned, F.concat(*shapes, F.array(greeting)))


def vault_findings(cleaned: DataFrame, known: DataFrame) -> DataFrame:
    """Earlier discoveries seen again."""
    hits = vault_rematch(cleaned, known)
    return _explode(hits, F.array(_hit(F.col("kind"), F.col("value"), "local-vault", VAULT, _own_box())))


def label_findings(cleaned: DataFrame, tasks: int | None = None) -> DataFrame:
    """Values announced by labels, and street lines."""
    rows = G.label_blocks(cleaned, tasks)
    selected = F.col("selected")
    value = F.when(F.col("label_value") != "", F.col("label_value")).otherwise(selected["text"])
    plain = _hit(
        F.col("label_kind"),
        value,
        "visible-label",
        LABELLED,
        [selected[c].alias(c) for c in _own_box()],
        explicit=F.coalesce("explicit", F.lit(False)),
    )
    block = lambda name, source, rank: F.when(
        F.col(name).isNotNull(),
        _hit(F.lit("ADDRESS"), F.col(name)["value"], source, rank, _merged(F.col(name)["items"])),
    )
    single = F.when((F.col("label_kind") != "ADDRESS") & selected.isNotNull(), plain)
    address = block("address_block", "visible-label", LABELLED)
    street = block("street_block", "local-street-pattern", STREET)
    return _explode(rows, F.array(single, address, street))


def finding_dedup(findings: DataFrame, tasks: int = 0) -> DataFrame:
    """One finding per kind, value and box; the first source in scan order wins.

    An explicit label also marks equal secrets that were found before it in the frame.
    """
    same = [*KEY, "kind", "value"]
    named = findings.filter(F.col("value") != "")
    named = named.repartition(tasks, *same) if tasks else named
    last_explicit = F.max(F.when(F.col("explicit_secret"), F.col("order"))).over(Window.partitionBy(*same))
    marked = named.withColumn("explicit_secret", F.coalesce(F.col("order") <= last_explicit, F.lit(False)))
    first = F.struct("order", "source", "confidence")
    return (
        marked.groupBy(*same, "x", "y", "width", "height")
        .agg(F.min(first).alias("_first"), F.bool_or("explicit_secret").alias("explicit_secret"))
        .select(
            *same,
            P.kind_title(F.col("kind")).alias("label"),
            "x",
            "y",
            "width",
            "height",
            F.col("_first.confidence").alias("confidence"),
            F.col("_first.source").alias("source"),
            "explicit_secret",
            F.col("_first.order").alias("order"),
        )
    )


def classify_frames(regions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All findings of all frames.

    ``regions(session_id, frame_id, region_id, text, x, y, width, height[, confidence])``
    must be clean (see ``region_scan`` / ``fail_closed``).  ``known`` adds earlier
    discoveries of the session.
    """
    cleaned, tasks = G.clean(regions), tasks_for(regions)
    found = line_findings(cleaned).unionByName(label_findings(cleaned, tasks))
    if known is not None:
        found = found.unionByName(vault_findings(cleaned, known))
    return finding_dedup(found, tasks)


def detect_sessions(regions: DataFrame) -> DataFrame:
    """Findings of every frame, where values discovered in a frame are re-found in later frames.

    A value counts as known after the first frame it was found in.
    """
    # Read twice below: the classifier runs once.
    direct = materialize(classify_frames(regions), "findings")
    delete_shuffles(regions.sparkSession)
    at = direct.withColumn("seq", F.struct("frame_id", "order"))
    known = known_kind(at, extra=[F.min("frame_id").alias("since")])
    again = vault_findings(G.clean(regions), known)
    delete_shuffles(regions.sparkSession)  # again: what Spark had yet to report on was still held the first time
    return finding_dedup(direct.drop("label").unionByName(again))


def detector_quality(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Per kind: expected values found, expected values missed, and values nobody expected.

    ``truth(session_id, kind, value)``; values are compared without white space.
    """
    bare = F.regexp_replace("value", r"(?U)\s+", "")
    side = lambda df, flag: df.select("session_id", "kind", bare.alias("value")).distinct().withColumn(flag, F.lit(True))
    both = side(truth, "expected").join(side(findings, "found"), ["session_id", "kind", "value"], "full_outer")
    e, f = F.col("expected").isNotNull(), F.col("found").isNotNull()
    return both.groupBy("kind").agg(
        F.count_if(e & f).alias("hits"), F.count_if(e & ~f).alias("misses"), F.count_if(~e & f).alias("extras")
    )
