"""Observation history and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.operators.ordered import ROWS_PER_CHUNK, even_chunk, ordered, seq_chunk

# ---- fixed values -----------------------------------------------------------
HISTORY_ENTRIES = 128
HISTORY_BYTES = 64 * 1024 * 1024
EVENT_TAIL = 15
ALWAYS_KEPT = ("agent", "navigate", "open")
TERMINAL = ("completed", "stopped", "error")
# -----------------------------------------------------------------------------
SESSION = ["session_id"]


def _seq(width: int) -> Column:
    return seq_chunk(F.col("seq"), width)


def observation_steps(observations: DataFrame, masks: Column, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Successful observations with their step, frames and masks so far."""
    ready = observations.filter(F.col("status") == "ready")
    chunk = even_chunk(ready, SESSION, ["seq"], rows)
    return ordered(ready, SESSION, ["seq"], chunk, number="step", total={"masks": masks.cast("long")})


def frame_reuse(observations: DataFrame, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """``reused`` is true when a frame equals the last successfully protected one before it."""
    good = F.when(F.col("status") == "ready", F.col("frame_hash"))
    seen = ordered(observations, SESSION, ["seq"], even_chunk(observations, SESSION, ["seq"], rows), last={"_last": good})
    return seen.withColumn("reused", F.coalesce(F.col("_last") == F.col("frame_hash"), F.lit(False))).drop("_last")


def history_dedup(observations: DataFrame, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """History entries: unchanged idle polls fold into the entry before them, failures add none.

    ``entry`` numbers the kept entries; every folded poll carries its entry's number.
    """
    ready = observations.filter(F.col("status") == "ready")
    chunk = even_chunk(ready, SESSION, ["seq"], rows)
    prior = ordered(ready, SESSION, ["seq"], chunk, lag={"_prev": F.col("frame_hash")})
    kept = F.col("reason").isin(*ALWAYS_KEPT) | ~F.col("_prev").eqNullSafe(F.col("frame_hash"))
    flagged = prior.withColumn("kept", kept).drop("_prev")
    return ordered(flagged, SESSION, ["seq"], chunk, total={"entry": F.col("kept").cast("long")})


def history_retention(entries: DataFrame, max_entries: int = HISTORY_ENTRIES, max_bytes: int = HISTORY_BYTES) -> DataFrame:
    """Newest entries that fit both limits, where equal images are stored once.

    Only the newest ``max_entries`` rows of a session are ever ordered together.
    ``dropped`` counts the evicted entries of the session.
    """
    newest = Window.partitionBy(*SESSION).orderBy(F.desc("seq"))
    recent = entries.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= max_entries)
    same_image = Window.partitionBy(*SESSION, "frame_hash").orderBy("age")
    fresh = recent.withColumn("_new", F.when(F.row_number().over(same_image) == 1, F.col("n_bytes")).otherwise(0))
    running = Window.partitionBy(*SESSION).orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    kept = fresh.withColumn("unique_bytes", F.sum("_new").over(running)).filter(F.col("unique_bytes") <= max_bytes)
    sizes = entries.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_all"))
    shown = kept.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_kept"))
    dropped = sizes.join(shown, SESSION, "left").select(
        *SESSION, (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("dropped")
    )
    return kept.drop("_new").join(dropped, SESSION)


def events_tail(events: DataFrame, count: int = EVENT_TAIL) -> DataFrame:
    """The newest events of every session, newest first."""
    newest = Window.partitionBy(*SESSION).orderBy(F.desc("seq"))
    return events.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= count)


def run_stats(observations: DataFrame, requests: DataFrame, masks: Column, resolved: Column) -> DataFrame:
    """Frames, masks, resolved tokens and model calls per session."""
    ready = F.col("status") == "ready"
    seen = observations.groupBy(*SESSION).agg(F.count_if(ready).alias("frames"), F.sum(F.when(ready, masks)).alias("masks"))
    calls = requests.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("model_calls"), F.sum(resolved).alias("resolved"))
    both = seen.join(calls, SESSION, "full_outer")
    return both.fillna(0, ["frames", "masks", "model_calls", "resolved"])


def detector_latency(observations: DataFrame) -> DataFrame:
    """Processing time per session, frames served from the cache apart."""
    ms = F.col("latency_ms")
    return observations.groupBy(*SESSION, "reused").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(ms).alias("total_ms"),
        F.max(ms).alias("max_ms"),
        F.percentile(ms, F.lit(0.5)).alias("p50_ms"),
        F.percentile(ms, F.lit(0.9)).alias("p90_ms"),
    )


SLICE = "1 hour"
KEPT_BITS = 7  # of a number after its first: its bucket is at most 1/128 below it


def bucket_of(number: Column) -> Column:
    """A non-negative whole number with all but its first 8 binary digits cleared; whole arithmetic, so equal on every engine."""
    dropped = F.greatest(F.lit(0), F.length(F.bin(number)) - (KEPT_BITS + 1)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", number.cast("long"), dropped), dropped)


def latency_slices(observations: DataFrame, ts: str = "ts", size: str = SLICE) -> DataFrame:
    """Sketches of processing times to be stored: ``session_id, reused, slice, bucket, frames, total_ms, max_ms``.

    One row for each bucket in use of a session's time slice, at most 7,300 a slice whatever the number of frames. Slices of any span merge
    by adding up (:func:`latency_of`), without the frames. Rows without a time or a latency are not in it; negative times count as 0.
    """
    known = observations.filter(F.col(ts).isNotNull() & F.col("latency_ms").isNotNull())
    ms = F.greatest(F.lit(0), F.col("latency_ms")).cast("long")
    slices = F.window(F.col(ts).cast("timestamp"), size)["start"].alias("slice")
    return known.groupBy(*SESSION, "reused", slices, bucket_of(ms).alias("bucket")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms")
    )


def latency_of(slices: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Merged sketches: ``by``, exact ``frames, total_ms, max_ms``, and the quantiles ``shares`` (name to share).

    A quantile is the bucket of the smallest time that at least this share of the frames does not exceed: at most 1/128
    below the exact one, and exact below 256 ms.
    """
    merged = slices.groupBy(*by, "bucket").agg(*(f(c).alias(c) for f, c in ((F.sum, "frames"), (F.sum, "total_ms"), (F.max, "max_ms"))))
    upto = Window.partitionBy(*by).orderBy("bucket")  # buckets of one key: 7,300 at most
    whole = Window.partitionBy(*by)
    ranked = merged.withColumn("_upto", F.sum("frames").over(upto)).withColumn("_all", F.sum("frames").over(whole))
    quantile = lambda share: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * share), F.col("bucket")))
    return ranked.groupBy(*by).agg(
        F.sum("frames").alias("frames"), F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"),
        *(quantile(share).alias(name) for name, share in shares.items()),
    )


def trace_review(events: DataFrame, halt_at: int = 3) -> DataFrame:
    """Counts of value-free event kinds; repeated denials halt, some warn."""
    counts = events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("kind") == "denied").alias("denials"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )
    action = F.when(F.col("denials") >= halt_at, "halt").when(F.col("denials") + F.col("errors") > 0, "warn").otherwise("continue")
    reason = (
        F.when(action == "halt", "REPEATED_DENIALS").when(action == "warn", "SOME_FAILURES").otherwise("NO_FINDINGS")
    )
    return counts.withColumn("action", action).withColumn("reason_code", reason)


def run_outcome(events: DataFrame) -> DataFrame:
    """Latest terminal status of each run and the step it was reached; NULL while it is open."""
    # Position and status as one number, so that the aggregation stays a hash aggregation.
    names = F.array(*[F.lit(n) for n in TERMINAL])
    code = F.array_position(names, F.col("kind"))
    latest = F.max(F.when(code > 0, F.col("seq") * (len(TERMINAL) + 1) + code))
    ended = events.groupBy(*SESSION).agg(latest.alias("_l"))
    return ended.select(
        *SESSION,
        F.coalesce(F.get(names, (F.col("_l") % (len(TERMINAL) + 1) - 1).cast("int")), F.lit("open")).alias("status"),
        F.floor(F.col("_l") / (len(TERMINAL) + 1)).alias("seq"),
    )


def tab_select(snapshots: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Active tab of every snapshot: the only focused one, else the only visible one, else the previous.

    ``snapshots(session_id, seq, tab_id, visible, focused)``, one row per tab.
    """
    focused = F.col("visible") & F.col("focused")
    per = snapshots.groupBy(*SESSION, "seq").agg(
        F.count_if(focused).alias("_f"),
        F.max(F.when(focused, F.col("tab_id"))).alias("_ft"),
        F.count_if("visible").alias("_v"),
        F.max(F.when(F.col("visible"), F.col("tab_id"))).alias("_vt"),
    )
    clear = F.when(F.col("_f") == 1, F.col("_ft")).when(F.col("_v") == 1, F.col("_vt"))
    known = per.select(*SESSION, "seq", clear.alias("_clear"))
    carried = ordered(known, SESSION, ["seq"], _seq(width), last={"_before": F.col("_clear")})
    return carried.select(*SESSION, "seq", F.coalesce("_clear", "_before").alias("active_tab"))


def history_receipts(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """History entries with the request that names them; an equal image alone links nothing."""
    receipts = requests.select("observation_id", "request_id", "response_id", "transmitted")
    return entries.join(receipts, "observation_id", "left")


def submitted_proof(checks: DataFrame, requests: DataFrame, width: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per pixel check: the first answered request at or after it that carries the same frame.

    A forward as-of join without pairing: both sides are merged in one descending
    order and the latest request seen is carried along.
    ``checks(run_id, check_id, start_step, frame_hash)``.
    """
    keys = ["run_id", "frame_hash"]
    sent = requests.filter(F.col("status") == "responded").select(
        *keys,
        (-F.col("step")).alias("_at"),
        F.lit(0).alias("_side"),
        F.struct("step", "request_id", "response_id").alias("_request"),
        F.lit(None).cast(checks.schema["check_id"].dataType).alias("check_id"),
    )
    asked = checks.select(
        *keys,
        (-F.col("start_step")).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(sent.schema["_request"].dataType).alias("_request"),
        "check_id",
    )
    merged = sent.unionByName(asked)
    carried = ordered(merged, keys, ["_at", "_side", "check_id"], seq_chunk(F.col("_at"), width), last={"_proof": F.col("_request")})
    return carried.filter(F.col("_side") == 1).select(
        "run_id",
        "check_id",
        F.col("_proof.step").alias("request_step"),
        F.col("_proof.request_id").alias("request_id"),
        F.col("_proof.response_id").alias("response_id"),
    )
