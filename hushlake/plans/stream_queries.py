"""Streaming operators run to the end of the given tables, in three micro-batches each."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.plans import fixture_sql as S
from hushlake.plans import fixtures as X
from hushlake.plans import text_queries as T
from hushlake.plans.registry import query
from hushlake.plans.storage import work_dir
from hushlake.streaming import operators as O
from hushlake.streaming import stores as W
from hushlake.streaming.runner import run_batches, run_to_table, table_stream

LINES = r"""lines AS (SELECT session_id, frame_id, region_id, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS text FROM doc_regions)"""


def _hits(kind, pattern, group):
    return f"SELECT session_id, frame_id, region_id, '{kind}' AS kind, trim(unnest(regexp_extract_all(text, '{pattern}', {group})), ' :：') AS value, 'local-pattern' AS source FROM lines"


@query(
    "stream_findings",
    S.with_ctes(S.DOC_REGIONS, LINES)
    + " UNION ALL ".join([_hits("EMAIL", T.EMAIL, 0), _hits("PHONE", T.PHONE_IN, 2), _hits("SECRET", T.SECRET_IN, 2)])
    + f""" UNION ALL SELECT session_id, frame_id, region_id, 'NAME', trim(regexp_extract(text, '{T.GREETING}', 1), ' :：'), 'visible-greeting' FROM lines
      WHERE regexp_matches(text, '{T.GREETING}') AND lower(regexp_extract(text, '{T.GREETING}', 1)) NOT IN ('there','guest','sign in')""",
)
def stream_findings(spark, sf):
    return run_to_table(O.stream_findings(X.regions_of(table_stream(spark, sf, "documents", F.col("doc_id")))), "findings")


@query("stream_vault", S.with_ctes(S.SIGHTINGS, S.VAULT) + "SELECT session_id, kind, value, token, first_seq, blocked FROM vault")
def stream_vault(spark, sf):
    path = work_dir(spark, "vault")
    seen = X.sightings_of(table_stream(spark, sf, "customer", F.col("c_custkey")))
    run_batches(W.first_sightings(seen), W.vault_writer(path), path, "update")
    return W.read_vault(spark, path)


OBS_STREAM = S.with_ctes(S.OBSERVATIONS)


def _ready(spark, sf):
    return X.observed(table_stream(spark, sf, "events", F.unix_micros(F.col("ts").cast("timestamp")))).filter(F.col("status") == "ready")


@query(
    "stream_frame_reuse",
    OBS_STREAM
    + """SELECT session_id, event_id, frame_hash FROM (SELECT *, lag(frame_hash) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM observations WHERE status = 'ready')
      WHERE prev IS DISTINCT FROM frame_hash""",
)
def stream_frame_reuse(spark, sf):
    path = work_dir(spark, "frames")
    stream = _ready(spark, sf).select("session_id", "event_id", "ts", "frame_hash")
    run_batches(stream, W.frame_change_writer(path), path)
    schema = "session_id BIGINT, event_id BIGINT, ts TIMESTAMP, frame_hash STRING, batch BIGINT"
    return spark.read.schema(schema).parquet(path).select("session_id", "event_id", "frame_hash")


HISTORY = "session_id BIGINT, seq BIGINT, frame_hash STRING, n_bytes BIGINT"


@query(
    "stream_history",
    OBS_STREAM
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS age FROM observations WHERE status = 'ready'),
    f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, frame_hash ORDER BY age) = 1 THEN n_bytes ELSE 0 END AS nb FROM r),
    t AS (SELECT *, sum(nb) OVER (PARTITION BY session_id ORDER BY age ROWS UNBOUNDED PRECEDING) AS unique_bytes FROM f)
    SELECT session_id, event_id AS seq, frame_hash, n_bytes FROM t WHERE age <= 128 AND unique_bytes <= 67108864""",
)
def stream_history(spark, sf):
    path = work_dir(spark, "history")
    stream = _ready(spark, sf).select("session_id", F.col("event_id").alias("seq"), "frame_hash", "n_bytes")
    run_batches(stream, W.history_writer(path, HISTORY), path)
    return W.history_table(path, HISTORY).read(spark)


def _timed_requests(spark, sf):
    """Requests with an event time: one second per turn."""
    r = X.requests_of(table_stream(spark, sf, "conversations", F.col("conv_id") * 8 + F.col("turn")))
    second = F.lit(1704067200) + F.col("run_id") * 8 + F.col("step")
    return r.withColumn("ts", F.timestamp_seconds(second))


@query("stream_request_dedup", S.with_ctes(S.REQUESTS) + "SELECT DISTINCT run_id, request_id FROM requests")
def stream_request_dedup(spark, sf):
    once = O.request_dedup(_timed_requests(spark, sf).select("run_id", "request_id", "ts"), "1 day")
    return run_to_table(once, "requests").select("run_id", "request_id")


@query("stream_status", S.with_ctes(S.REQUESTS) + "SELECT concat(run_id, '-', step) AS request_id, status FROM requests")
def stream_status(spark, sf):
    """Every request is first prepared; most get a final status a second later."""
    path = work_dir(spark, "status")
    final = F.when(F.col("status") != "prepared", F.struct((F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.col("status").alias("status")))
    steps = F.array_compact(F.array(F.struct("ts", F.lit("prepared").alias("status")), final))
    stream = _timed_requests(spark, sf).select(F.concat_ws("-", "run_id", "step").alias("request_id"), F.explode(steps).alias("s"))
    run_batches(stream.select("request_id", "s.*"), W.status_writer(path), path)
    return W.read_status(spark, path)


@query(
    "stream_event_counts",
    """WITH slots AS (SELECT event_type AS kind, time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes' * k AS window_start FROM events, (VALUES (0), (1)) v(k))
      SELECT window_start, window_start + INTERVAL '10 minutes' AS window_end, kind, count(*) AS n FROM slots
      WHERE window_start + INTERVAL '10 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY ALL""",
)
def stream_event_counts(spark, sf):
    """Windows that are final once the watermark has passed them."""
    events = table_stream(spark, sf, "events", F.unix_micros(F.col("ts").cast("timestamp"))).select("ts", F.col("event_type").alias("kind"))
    return run_to_table(O.event_counts(events, "10 minutes", "5 minutes", "1 hour"), "counts")


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id % 50 AS session_id, ts, ts - lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts) >= INTERVAL '3 hours' AS far FROM events),
      g AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM e)
      SELECT session_id, min(ts) AS started, max(ts) + INTERVAL '3 hours' AS ended, count(*) AS n FROM g GROUP BY session_id, grp
      HAVING max(ts) + INTERVAL '3 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
)
def stream_sessions(spark, sf):
    events = table_stream(spark, sf, "events", F.unix_micros(F.col("ts").cast("timestamp"))).select("ts", (F.col("user_id") % 50).alias("session_id"))
    return run_to_table(O.activity_sessions(events, "3 hours", "1 hour"), "sessions")


@query(
    "stream_chain",
    S.with_ctes(S.REQUESTS)
    + """SELECT f.run_id, f.step, r.step AS receipt_step, r.response_id AS receipt FROM requests f
      JOIN requests r ON r.run_id = f.run_id AND r.response_id = f.previous_response_id AND r.step <= f.step""",
)
def stream_chain(spark, sf):
    return run_to_table(O.chain_links(_timed_requests(spark, sf), "1 day", "1 HOUR"), "chain")
