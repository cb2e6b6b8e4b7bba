"""Observation history, run statistics and links to requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.operators import history as H
from hushlake.plans import fixture_sql as S
from hushlake.plans import fixtures as X
from hushlake.plans.registry import query
from hushlake.plans.storage import materialize
from hushlake.plans.text_queries import scrub_sql

OBS = S.with_ctes(S.OBSERVATIONS)


def _masks():
    return F.col("latency_ms") % 7



@query(
    "observation_steps",
    OBS
    + """SELECT session_id, seq, row_number() OVER w AS step, (sum(latency_ms % 7) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS masks
      FROM observations WHERE status = 'ready' WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
)
def observation_steps(spark, sf):
    return H.observation_steps(X.observations(spark, sf), _masks()).select("session_id", "seq", "step", "masks")


@query(
    "frame_reuse",
    OBS
    + """SELECT session_id, seq, coalesce(frame_hash = last_value(CASE WHEN status = 'ready' THEN frame_hash END IGNORE NULLS)
      OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reused FROM observations""",
)
def frame_reuse(spark, sf):
    return H.frame_reuse(X.observations(spark, sf)).select("session_id", "seq", "reused")


DEDUP = """kept AS (
  SELECT *, reason IN ('agent', 'navigate', 'open') OR frame_hash IS DISTINCT FROM lag(frame_hash) OVER (PARTITION BY session_id ORDER BY seq) AS kept
  FROM observations WHERE status = 'ready'),
history AS (SELECT *, (sum(kept::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS entry FROM kept)"""


@query("history_dedup", S.with_ctes(S.OBSERVATIONS, DEDUP) + "SELECT session_id, seq, kept, entry FROM history")
def history_dedup(spark, sf):
    return H.history_dedup(X.observations(spark, sf)).select("session_id", "seq", "kept", "entry")


RETAIN = """ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS age, count(*) OVER (PARTITION BY session_id) AS n FROM observations WHERE status = 'ready'),
  fresh AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, frame_hash ORDER BY age) = 1 THEN n_bytes ELSE 0 END AS nb FROM ranked),
  run AS (SELECT *, (sum(nb) OVER (PARTITION BY session_id ORDER BY age ROWS UNBOUNDED PRECEDING))::BIGINT AS unique_bytes FROM fresh),
  fit AS (SELECT * FROM run WHERE age <= 128 AND unique_bytes <= 67108864)"""


@query(
    "history_retention",
    S.with_ctes(S.OBSERVATIONS, RETAIN)
    + "SELECT session_id, seq, age, unique_bytes, n - count(*) OVER (PARTITION BY session_id) AS dropped FROM fit",
)
def history_retention(spark, sf):
    entries = X.observations(spark, sf).filter(F.col("status") == "ready")
    return H.history_retention(entries).select("session_id", "seq", "age", "unique_bytes", "dropped")


@query(
    "events_tail",
    OBS + "SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS position FROM observations QUALIFY position <= 15",
)
def events_tail(spark, sf):
    return H.events_tail(X.observations(spark, sf)).select("session_id", "event_id", "position")


@query(
    "event_log_scan",
    "SELECT event_id, event_type AS kind, "
    + scrub_sql("concat('Saw user', user_id, '@example.net via ', event_type, chr(10), 'Phone: ', event_id)")
    + " AS message FROM events",
)
def event_log_scan(spark, sf):
    """Event log rows, scrubbed on entry."""
    from hushlake.sources.event_log import event_log

    raw = X.spread(X.table(spark, sf, "events")).select(
        "event_id",
        F.col("event_type").alias("kind"),
        F.concat(
            F.lit("Saw user"), X.text(F.col("user_id")), F.lit("@example.net via "), "event_type", F.lit("\nPhone: "), X.text(F.col("event_id"))
        ).alias("message"),
    )
    return event_log(raw)


def _session_requests(spark, sf):
    return X.requests(spark, sf).withColumn("session_id", F.col("run_id") % 50)


@query(
    "run_stats",
    S.with_ctes(S.OBSERVATIONS, S.REQUESTS)
    + """, o AS (SELECT session_id, count(*) FILTER (status = 'ready') AS frames, sum(latency_ms % 7) FILTER (status = 'ready') AS masks FROM observations GROUP BY 1),
    r AS (SELECT run_id % 50 AS session_id, count(*) AS model_calls, sum(output_tokens % 3) AS resolved FROM requests GROUP BY 1)
    SELECT session_id, coalesce(frames, 0) AS frames, coalesce(masks, 0)::BIGINT AS masks, coalesce(model_calls, 0) AS model_calls, coalesce(resolved, 0)::BIGINT AS resolved FROM o FULL JOIN r USING (session_id)""",
)
def run_stats(spark, sf):
    return H.run_stats(X.observations(spark, sf), _session_requests(spark, sf), _masks(), F.col("output_tokens") % 3)


@query(
    "detector_latency",
    OBS
    + """, u AS (SELECT *, coalesce(frame_hash = last_value(CASE WHEN status = 'ready' THEN frame_hash END IGNORE NULLS)
      OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reused FROM observations)
    SELECT session_id, reused, count(*) AS frames, sum(latency_ms)::BIGINT AS total_ms, max(latency_ms) AS max_ms, quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.9) AS p90_ms FROM u GROUP BY ALL""",
)
def detector_latency(spark, sf):
    return H.detector_latency(H.frame_reuse(X.observations(spark, sf)))


@query(
    "detector_latency_sketch",
    OBS
    + """, u AS (SELECT *, coalesce(frame_hash = last_value(CASE WHEN status = 'ready' THEN frame_hash END IGNORE NULLS)
      OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reused FROM observations),
    b AS (SELECT session_id, reused, date_trunc('day', ts) AS day, latency_ms, (latency_ms >> greatest(0, length(bin(latency_ms)) - 8)) << greatest(0, length(bin(latency_ms)) - 8) AS bucket FROM u),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, reused, day ORDER BY bucket) AS place, count(*) OVER (PARTITION BY session_id, reused, day) AS n FROM b)
    SELECT session_id, reused, day, count(*) AS frames, sum(latency_ms)::BIGINT AS total_ms, max(latency_ms) AS max_ms,
      min(bucket) FILTER (place >= ceil(n * 0.5::DOUBLE)) AS p50_ms, min(bucket) FILTER (place >= ceil(n * 0.9::DOUBLE)) AS p90_ms FROM r GROUP BY 1, 2, 3""",
)
def detector_latency_sketch(spark, sf):
    """Days merged from stored hours: the frames are not read again."""
    hours = materialize(H.latency_slices(H.frame_reuse(X.observations(spark, sf))), "latency")
    days = hours.withColumn("day", F.date_trunc("day", "slice").cast("timestamp_ntz"))
    return H.latency_of(days, ["session_id", "reused", "day"], {"p50_ms": 0.5, "p90_ms": 0.9})


EVENT_KINDS = """kinds AS (SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'completed' WHEN 'click' THEN 'action'
  WHEN 'purchase' THEN CASE WHEN latency_ms % 40 = 0 THEN 'denied' ELSE 'stopped' END ELSE 'preview' END AS kind FROM observations)"""


def _kinds(spark, sf):
    stop = F.when(F.col("latency_ms") % 40 == 0, "denied").otherwise("stopped")
    kind = X.pick(F.col("event_type"), {"error": "error", "signup": "completed", "click": "action", "purchase": stop}, "preview")
    return X.observations(spark, sf).withColumn("kind", kind)


@query(
    "trace_review",
    S.with_ctes(S.OBSERVATIONS, EVENT_KINDS)
    + """, c AS (SELECT session_id, count(*) AS events, count(*) FILTER (kind = 'denied') AS denials, count(*) FILTER (kind = 'error') AS errors FROM kinds GROUP BY 1)
    SELECT *, CASE WHEN denials >= 2 THEN 'halt' WHEN denials + errors > 0 THEN 'warn' ELSE 'continue' END AS action,
      CASE WHEN denials >= 2 THEN 'REPEATED_DENIALS' WHEN denials + errors > 0 THEN 'SOME_FAILURES' ELSE 'NO_FINDINGS' END AS reason_code FROM c""",
)
def trace_review(spark, sf):
    return H.trace_review(_kinds(spark, sf), halt_at=2)


@query(
    "run_outcome",
    S.with_ctes(S.OBSERVATIONS, EVENT_KINDS)
    + """SELECT session_id, coalesce(arg_max(kind, seq) FILTER (kind IN ('completed', 'stopped', 'error')), 'open') AS status,
      max(seq) FILTER (kind IN ('completed', 'stopped', 'error')) AS seq FROM kinds GROUP BY 1""",
)
def run_outcome(spark, sf):
    return H.run_outcome(_kinds(spark, sf))


@query(
    "tab_select",
    OBS
    + """, tabs AS (SELECT session_id, seq, t AS tab_id, (event_id + t) % 3 = 0 OR event_id % 7 = 0 AS visible, ((event_id + t) % 3 = 0 OR event_id % 7 = 0) AND (event_id + t) % 2 = 0 AS focused
      FROM observations, (VALUES (0), (1), (2)) v(t)),
    per AS (SELECT session_id, seq, CASE WHEN count(*) FILTER (focused) = 1 THEN max(tab_id) FILTER (focused) WHEN count(*) FILTER (visible) = 1 THEN max(tab_id) FILTER (visible) END AS clear FROM tabs GROUP BY 1, 2)
    SELECT session_id, seq, last_value(clear IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS active_tab FROM per""",
)
def tab_select(spark, sf):
    tab, event = F.col("tab_id"), F.col("event_id")
    visible = ((event + tab) % 3 == 0) | (event % 7 == 0)
    tabs = X.observations(spark, sf).select("session_id", "seq", "event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tab_id"))
    tabs = tabs.select("session_id", "seq", "tab_id", visible.alias("visible"), ((event + tab) % 2 == 0).alias("focused"))
    return H.tab_select(tabs)


@query(
    "history_receipt_link",
    S.with_ctes(S.OBSERVATIONS, S.REQUESTS)
    + """SELECT o.session_id, o.seq, o.event_id AS observation_id, r.request_id, r.response_id, r.status = 'responded' AS transmitted FROM observations o
      LEFT JOIN requests r ON o.event_id = r.run_id * 8 + r.step WHERE o.status = 'ready'""",
)
def history_receipt_link(spark, sf):
    entries = X.observations(spark, sf).filter(F.col("status") == "ready").withColumn("observation_id", F.col("event_id"))
    req = X.requests(spark, sf).select(
        (F.col("run_id") * 8 + F.col("step")).alias("observation_id"), "request_id", "response_id", (F.col("status") == "responded").alias("transmitted")
    )
    return H.history_receipts(entries, req).select("session_id", "seq", "observation_id", "request_id", "response_id", "transmitted")


@query(
    "submitted_proof",
    S.with_ctes(S.REQUESTS)
    + """, checks AS (SELECT run_id, step AS check_id, step AS start_step, payload_hash AS frame_hash FROM requests)
    SELECT c.run_id, c.check_id, min(r.step) AS request_step, arg_min(r.request_id, r.step) AS request_id, arg_min(r.response_id, r.step) AS response_id
    FROM checks c LEFT JOIN requests r ON r.run_id = c.run_id AND r.frame_hash = c.frame_hash AND r.step >= c.start_step AND r.status = 'responded' GROUP BY 1, 2""",
)
def submitted_proof(spark, sf):
    req = X.requests(spark, sf)
    checks = req.select("run_id", F.col("step").alias("check_id"), F.col("step").alias("start_step"), F.col("payload_hash").alias("frame_hash"))
    return H.submitted_proof(checks, req)
