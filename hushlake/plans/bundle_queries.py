"""Recorded workflows and skill packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.operators import bundles as U
from hushlake.plans import fixture_sql as S
from hushlake.plans import fixtures as X
from hushlake.plans.registry import query
from hushlake.sources import bundle as I
from hushlake.sources.tables import table

BUN = S.with_ctes(S.BUNDLE)


@query(
    "expected_values",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE '' END AS missing, c_custkey % 5 <> 0 AS verified FROM customer""",
)
def expected_values(spark, sf):
    """Receipts of posted forms; every fifth one lacks a value."""
    k = F.col("c_custkey")
    receipt = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(k % 5 != 0, F.col("c_mktsegment")).otherwise("-"))
    rows = table(spark, sf, "customer").select(
        "c_custkey", receipt.alias("receipt"), F.array("c_name", "c_mktsegment").alias("expected")
    )
    return U.expected_values(rows).select("c_custkey", F.array_join("missing", ",").alias("missing"), "verified")


@query(
    "action_observation_link",
    BUN
    + """SELECT a.recording_id, a.event_id, a.status, b.type AS before_type, c.type AS after_type FROM bundle a
      LEFT JOIN bundle b ON b.recording_id = a.recording_id AND b.event_id = a.before_event_id
      LEFT JOIN bundle c ON c.recording_id = a.recording_id AND c.event_id = a.after_event_id WHERE a.type = 'action'""",
)
def action_observation_link(spark, sf):
    out = U.action_links(X.bundle_events(spark, sf))
    return out.select("recording_id", "event_id", "status", "before_type", "after_type")


@query(
    "action_status_counts",
    BUN
    + """SELECT recording_id, 0 AS proposed, count(*) FILTER (status = 'executed') AS executed, 0 AS failed, count(*) FILTER (status = 'blocked') AS blocked
      FROM bundle WHERE type = 'action' GROUP BY 1""",
)
def action_status_counts(spark, sf):
    return U.action_status_counts(X.bundle_events(spark, sf))


MISSING = """missing AS (
  SELECT recording_id, event_id, 'before' AS reference, before_event_id::VARCHAR AS target FROM bundle a WHERE before_event_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM bundle b WHERE b.recording_id = a.recording_id AND b.event_id = a.before_event_id)
  UNION ALL SELECT recording_id, event_id, 'after', after_event_id::VARCHAR FROM bundle a WHERE after_event_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM bundle b WHERE b.recording_id = a.recording_id AND b.event_id = a.after_event_id)
  UNION ALL SELECT recording_id, event_id, 'frame', frame_id FROM bundle WHERE (recording_id + event_id % 200) % 37 = 0 OR event_id % 200 >= 190)"""


def _frames(events):
    """Frames present in the bundles. Ids are relative to a recording: one that is lost here is there in others."""
    number = F.col("event_id") % 200
    present = events.filter((number < 190) & ((F.col("recording_id") + number) % 37 != 0))
    return present.select("recording_id", "frame_id").distinct()


@query("evidence_refs", S.with_ctes(S.BUNDLE, MISSING) + "SELECT * FROM missing")
def evidence_refs(spark, sf):
    events = X.bundle_events(spark, sf)
    return U.missing_evidence(events, _frames(events))


LISTED = """listed AS (SELECT p_partkey % 50 AS recording_id, concat(CASE WHEN p_partkey % 23 = 0 THEN 'old/' ELSE 'frames/' END, p_partkey // 50, '.png') AS path, sha256(p_name) AS h FROM part),
  files AS (SELECT p_partkey % 50 AS recording_id, concat('frames/', p_partkey // 50, CASE WHEN p_partkey % 19 = 0 THEN '.tmp' ELSE '.png' END) AS path,
    sha256(CASE WHEN p_partkey % 17 = 0 THEN p_name || '!' ELSE p_name END) AS h FROM part)"""


@query(
    "frame_hash_check",
    S.with_ctes(LISTED)
    + """SELECT recording_id, path, CASE WHEN l.h IS NULL THEN 'unlisted' WHEN f.h IS NULL THEN 'missing_file' WHEN l.h <> f.h THEN 'mismatch' ELSE 'ok' END AS status
      FROM listed l FULL JOIN files f USING (recording_id, path)""",
)
def frame_hash_check(spark, sf):
    """Some files are listed under another folder, some have another suffix, some were altered; 50 recordings use the same paths."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    folder = F.when(k % 23 == 0, "old/").otherwise("frames/")
    suffix = F.when(k % 19 == 0, ".tmp").otherwise(".png")
    content = F.when(k % 17 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    rec, number = (k % 50).alias("recording_id"), X.text(F.floor(k / 50))
    listed = part.select(rec, F.concat(folder, number, F.lit(".png")).alias("path"), F.sha2("p_name", 256).alias("sha256"))
    files = part.select(rec, F.concat(F.lit("frames/"), number, suffix).alias("path"), F.sha2(content, 256).alias("sha256"))
    return U.frame_hashes(listed, files)


@query(
    "param_binding",
    BUN
    + """, roles AS (SELECT recording_id, token, count(DISTINCT role_hint) AS n, min(role_hint) AS role FROM bundle GROUP BY 1, 2),
    bound AS (SELECT *, CASE WHEN role = 'role_7' THEN NULL WHEN role = 'role_5' THEN 'ADDRESS_5' ELSE concat(role, '_', recording_id) END AS fresh FROM roles)
    SELECT recording_id, token, CASE WHEN n = 1 THEN role END AS role, CASE WHEN n = 1 AND role <> 'role_5' AND NOT (role = 'role_2' AND recording_id % 4 = 0) THEN fresh END AS fresh_token,
      CASE WHEN n > 1 THEN 'ambiguous_role' WHEN fresh IS NULL THEN 'missing_binding' WHEN role = 'role_2' AND recording_id % 4 = 0 THEN 'ambiguous_binding' WHEN role = 'role_5' THEN 'stale_token' ELSE 'bound' END AS status FROM bound""",
)
def param_binding(spark, sf):
    uses = X.bundle_events(spark, sf).select("recording_id", "token", "role_hint")
    roles = uses.select("recording_id", F.col("role_hint").alias("role")).distinct().filter(F.col("role") != "role_7")
    fresh = F.when(F.col("role") == "role_5", "ADDRESS_5").otherwise(F.concat_ws("_", "role", "recording_id"))
    bindings = roles.withColumn("fresh_token", fresh)
    second = bindings.filter((F.col("role") == "role_2") & (F.col("recording_id") % 4 == 0))
    return U.bind_parameters(uses, bindings.unionByName(second.withColumn("fresh_token", F.concat("fresh_token", F.lit("_b")))))


@query(
    "overlap_windows",
    BUN
    + """SELECT recording_id, event_id, w AS window_no, concat(recording_id, '-', w) AS window_id FROM (
      SELECT *, unnest(range(greatest(0, ceil((sequence - 10) / 7.0))::BIGINT, floor((sequence - 1) / 7.0)::BIGINT + 1)) AS w FROM bundle)""",
)
def overlap_windows(spark, sf):
    out = U.overlap_windows(X.bundle_events(spark, sf), 10, 3)
    return out.select("recording_id", "event_id", "window_no", "window_id")


VALID = """valid AS (
  SELECT recording_id, CASE WHEN recording_id IN (SELECT recording_id FROM missing) THEN 'invalid' ELSE 'valid' END AS structure,
    CASE WHEN count(*) FILTER (type = 'check') = 0 THEN 'unknown' WHEN count(*) FILTER (type = 'check' AND status = 'failed') > 0 THEN 'failed' ELSE 'supported' END AS outcome,
    CASE WHEN recording_id % 3 = 0 THEN 'reviewed' ELSE 'candidate' END AS review, CASE WHEN recording_id % 7 = 0 THEN 'validated_on_fixture' ELSE 'not_run' END AS rerun
  FROM bundle GROUP BY recording_id)"""


def _validation(spark, sf):
    events = X.bundle_events(spark, sf)
    k = F.col("recording_id")
    reviews = events.select("recording_id").distinct().select("recording_id", (k % 3 == 0).alias("reviewed"), (k % 7 == 0).alias("rerun"))
    return U.skill_validation(events, U.missing_evidence(events, _frames(events)), reviews), events


@query("skill_validation", S.with_ctes(S.BUNDLE, MISSING, VALID) + "SELECT * FROM valid")
def skill_validation(spark, sf):
    return _validation(spark, sf)[0]


@query(
    "skill_export",
    S.with_ctes(S.BUNDLE, MISSING, VALID)
    + """SELECT recording_id, 'workflow.json' AS file, sequence AS pos, '{"step":"' || event_id || '","status":"' || status || '","input":"{{' || role_hint || '}}"}' AS json FROM bundle WHERE type = 'action'
      UNION ALL SELECT recording_id, 'evidence-map.json', sequence, '{"step":"' || event_id || '","evidence":[' || concat_ws(',', '"' || before_event_id || '"', '"' || after_event_id || '"') || '],"basis":"observed"}' FROM bundle WHERE type = 'action'
      UNION ALL SELECT recording_id, 'validation.json', 0, '{"structure":"' || structure || '","outcome":"' || outcome || '","review":"' || review || '","rerun":"' || rerun || '"}' FROM valid""",
)
def skill_export(spark, sf):
    validation, events = _validation(spark, sf)
    return I.skill_lines(events, validation)


@query(
    "bundle_scan",
    """SELECT p_partkey::VARCHAR AS recording_id, CASE WHEN p_partkey % 11 = 10 THEN 'unsupported_schema' WHEN p_partkey % 13 = 12 THEN 'unapproved_source'
      WHEN p_partkey % 7 = 6 THEN 'unknown_capture_mode' WHEN p_partkey % 17 = 16 THEN 'path_outside_bundle'
      WHEN p_partkey % 19 = 5 THEN 'no_events' WHEN p_partkey % 23 = 3 THEN 'missing_frame' WHEN p_partkey % 29 = 4 THEN 'altered_frame' ELSE 'ok' END AS reason FROM part""",
)
def bundle_scan(spark, sf):
    """Manifests and events written as JSON and read back, with frame files of the same path in every recording; several
    bundles are refused, lack events or a frame, or hold an altered one."""
    k = F.col("p_partkey")
    path = F.when(k % 17 == 16, "frames/../../x.png").otherwise("frames/frame-0001.png")
    frame = F.struct(F.lit("frame-0001").alias("frame_id"), path.alias("path"), F.sha2("p_name", 256).alias("sha256"))
    manifests = table(spark, sf, "part").select(
        F.when(k % 11 == 10, "2.0").otherwise("1.0").alias("schema_version"),
        X.text(k).alias("recording_id"),
        F.col("p_name").alias("task"),
        F.when(k % 7 == 6, "video").otherwise("enriched").alias("capture_mode"),
        F.struct(F.lit("core").alias("producer"), F.when(k % 13 == 12, "raw").otherwise("sanitized").alias("data_class")).alias("provenance"),
        F.lit("events.jsonl").alias("events_file"),
        F.array(frame).alias("frames"),
        F.struct(F.lit("unknown").alias("status")).alias("outcome"),
    )
    part = table(spark, sf, "part")
    events = part.filter(k % 19 != 5).select(X.text(k).alias("recording_id"), F.lit("e1").alias("event_id"), F.lit("frame-0001").alias("frame_id"))
    content = F.when(k % 29 == 4, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    files = part.filter(k % 23 != 3).select(X.text(k).alias("recording_id"), path.alias("path"), F.sha2(content, 256).alias("sha256"))
    read = I.read_manifests(spark, I.write_manifests(manifests, spark))
    told = I.read_events(spark, I.write_manifests(events, spark))
    return U.bundle_reasons(read, told, files).select("recording_id", "reason")
