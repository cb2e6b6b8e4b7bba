"""Ordered (window-like) computations that split a hot key over many tasks.

A plain ``Window.partitionBy(session)`` puts a session's whole history into one
task.  Here the history is cut into chunks of the order column: a small
per-chunk summary (partial aggregation) carries counts, tails and totals from
one chunk to the next, and the row-level window runs per ``(key, chunk)``.
Results equal the plain window; NULL keys are a group like any other, and rows
without an order value come first.

``even_chunk`` cuts where the rows are, whatever the order column looks like: bursts, gaps, strays and sparse numbers.
Chunks number at most one for every ``rows`` rows of the table, so the step that carries from chunk to chunk is that
much smaller than the table, also for a key that owns all of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 1_000_000
SAMPLES = 200  # rows a chunk that its bounds are taken from
SEED = 42


def seq_chunk(order: Column, width: int = ROWS_PER_CHUNK) -> Column:
    """Chunk number of a dense integer position; a unique position bounds a chunk by ``width`` rows."""
    return ((order - F.pmod(order, F.lit(width))) / F.lit(width)).cast("long")


def _number(df: DataFrame, name: str) -> Column:
    """An order column as a number that ascends with it."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(F.col(name)).cast("double")
    if kind not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        raise ValueError(f"no even chunks along a column of type {kind}")
    return F.col(name).cast("double")


def place_among(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are not above ``value`` (a double; NaN is above all, NULL stays NULL): a binary search."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0).cast("long"))
    bounds, state = F.lit(np.array(cuts, dtype=np.float64)), lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = F.get(bounds, middle) <= value
        return F.when(s["low"] >= s["high"], s).when(above, state(middle + 1, s["high"])).otherwise(state(s["low"], middle))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    found = F.aggregate(steps, state(F.lit(0), F.lit(len(cuts))), halve, lambda s: s["low"].cast("long"))
    return F.when(value.isNotNull(), found)


def _cuts(sample: DataFrame, name: str, chunks: int) -> list[float]:
    """Bounds of ``chunks`` equally full ranges, repeated where one value fills several."""
    if chunks < 2:
        return []
    return sample.approxQuantile(name, [n / chunks for n in range(1, chunks)], 1 / (4 * chunks))


def even_chunk(df: DataFrame, keys: list[str], order: list[str], rows: int = ROWS_PER_CHUNK) -> Column | None:
    """Chunk number along ``order``: ascending, and about ``rows`` rows of the table in each, twice as many at most.

    ``order``: numbers, dates or timestamps; the first column is cut. Where one key has more rows at a single value than
    a chunk should hold, these are cut along the second column. Bounds come from quantiles of a seeded sample of 200 rows a
    chunk; the driver gets one number for each chunk. A table of up to ``rows`` rows is only counted: None, no chunks.
    """
    n = df.count()
    chunks = -(-n // rows)
    if chunks < 2:
        return None
    at = _number(df, order[0])
    then = _number(df, order[1]) if len(order) > 1 else F.lit(None).cast("double")
    share = min(1.0, chunks * SAMPLES / n)
    sample = df.select(*keys, at.alias("_at"), then.alias("_then"))
    sample = sample.sample(share, SEED) if share < 1 else sample
    cuts = _cuts(sample.select("_at"), "_at", chunks)
    bounds = sorted(set(cuts))
    first = F.coalesce(place_among(at, bounds), F.lit(-1).cast("long"))
    if len(order) < 2:
        return first
    # values that fill a chunk of one key alone (NULL among them) lie at the start of their chunk, if it is a bound
    most = rows * share
    full = sample.groupBy(*keys, "_at").count().filter((F.col("count") > most) & (F.col("_at").isNull() | F.col("_at").isin(bounds)))
    heavy = [r[0] for r in full.select("_at").distinct().collect()]  # a chunk each at least
    if not heavy:
        return first
    known = sorted(v for v in heavy if v is not None)
    is_heavy = lambda c: (c.isin(known) if known else F.lit(False)) | (c.isNull() if None in heavy else F.lit(False))
    inside = sample.filter(F.coalesce(is_heavy(F.col("_at")), F.lit(False)))
    more = sorted(set(_cuts(inside.select("_then"), "_then", max(2, round(inside.count() / most)))))
    second = F.coalesce(place_among(then, more), F.lit(-1).cast("long")) + 1
    beyond = len(more) + 2
    return first * (beyond + 1) + F.when(F.coalesce(is_heavy(at), F.lit(False)), second).otherwise(F.lit(beyond).cast("long"))


def time_chunk(df: DataFrame, ts: str, rows: int = ROWS_PER_CHUNK) -> Column | None:
    """Time slices that hold about ``rows`` rows each."""
    return even_chunk(df, [], [ts], rows)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None,
    *,
    number: str | None = None,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``, computed per ``keys`` along ``order``.

    number  row number from 1
    lag     value of the preceding row
    lead    value of the following row
    last    last non-null value among the preceding rows
    total   running sum including the row itself

    Without chunks (None: the whole table is no more than a chunk should hold) these are plain windows.
    """
    lag, lead, last, total = lag or {}, lead or {}, last or {}, total or {}
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        prior, upto = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, 0)
        out = [F.row_number().over(whole).cast("long").alias(number)] if number else []
        out += [F.lag(c).over(whole).alias(n) for n, c in lag.items()] + [F.lead(c).over(whole).alias(n) for n, c in lead.items()]
        out += [F.last(c, ignorenulls=True).over(prior).alias(n) for n, c in last.items()]
        return df.select("*", *out, *(F.sum(c).over(upto).alias(n) for n, c in total.items()))
    at = F.struct(*order)
    data = df.withColumn("_chunk", chunk)
    source = {}
    for name, col in {**lag, **lead, **last, **total}.items():
        source[name] = f"_src_{name}"
        data = data.withColumn(source[name], F.struct(col.alias("v")) if name in lag or name in lead else col)

    parts = [F.count(F.lit(1)).alias("_rows")]
    for name in lag:
        parts.append(F.max_by(source[name], at).alias(f"_c_{name}"))
    for name in lead:
        parts.append(F.min_by(source[name], at).alias(f"_c_{name}"))
    for name in last:
        seen = F.col(source[name]).isNotNull()
        parts.append(F.max_by(source[name], F.when(seen, at)).alias(f"_c_{name}"))
    for name in total:
        parts.append(F.sum(source[name]).alias(f"_c_{name}"))
    summary = data.groupBy(*keys, "_chunk").agg(*parts)

    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows")]
    carry += [F.lag(f"_c_{n}").over(across).alias(f"_c_{n}") for n in lag]
    carry += [F.lead(f"_c_{n}").over(across).alias(f"_c_{n}") for n in lead]
    carry += [F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last]
    carry += [F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in total]
    carried = summary.select(F.struct(*keys, "_chunk").alias("_part"), *carry)

    # structs are equal where their NULLs are
    joined = data.withColumn("_part", F.struct(*keys, "_chunk")).join(carried, "_part", "left")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = [F.col(c) for c in df.columns]
    if number:
        out.append((F.row_number().over(inside) + F.coalesce("_rows", F.lit(0))).cast("long").alias(number))
    for n in lag:
        out.append(F.coalesce(F.lag(source[n]).over(inside), F.col(f"_c_{n}"))["v"].alias(n))
    for n in lead:
        out.append(F.coalesce(F.lead(source[n]).over(inside), F.col(f"_c_{n}"))["v"].alias(n))
    for n in last:
        out.append(F.coalesce(F.last(source[n], ignorenulls=True).over(prior), F.col(f"_c_{n}")).alias(n))
    for n in total:
        out.append((F.sum(source[n]).over(upto) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n))
    return joined.select(*out)
