"""Recording bundles in, skill packages out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.operators.bundles import manifest_reason
from hushlake.plans.storage import work_dir

MANIFEST = (
    "schema_version STRING, recording_id STRING, task STRING, capture_mode STRING, "
    "provenance STRUCT<producer: STRING, data_class: STRING, privacy_policy_version: STRING>, events_file STRING, "
    "frames ARRAY<STRUCT<frame_id: STRING, path: STRING, sha256: STRING>>, outcome STRUCT<status: STRING, check_ids: ARRAY<STRING>>"
)
EVENTS = (
    "recording_id STRING, event_id STRING, sequence BIGINT, time_ms BIGINT, type STRING, frame_id STRING, app STRING, text STRING, "
    "action_id STRING, status STRING, before_event_id STRING, after_event_id STRING, check_id STRING, result STRING, "
    "source STRING, criterion STRING, evidence_ids ARRAY<STRING>, "
    "tokens ARRAY<STRUCT<token: STRING, class: STRING, role_hint: STRING>>"
)


def read_manifests(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Recording manifests with a ``reason`` for those that must be refused."""
    raw = spark.read.schema(MANIFEST).option("multiLine", multiline).json(path)
    return raw.withColumn("reason", manifest_reason(F.struct(*[F.col(c) for c in raw.columns])))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Timeline events of recordings, one JSON object per line; each names its recording."""
    return spark.read.schema(EVENTS).json(path)


def write_manifests(manifests: DataFrame, spark: SparkSession, folder: str | None = None) -> str:
    folder = folder or work_dir(spark, "manifests")
    manifests.write.json(folder)
    return folder


def skill_lines(events: DataFrame, validation: DataFrame) -> DataFrame:
    """Skill packages as ordered lines ``(recording_id, file, pos, json)``.

    Steps and their evidence are lines of their own, so a long recording is never one value.
    """
    rec = "recording_id"
    steps = events.filter(F.col("type") == "action")
    text = lambda c: F.col(c).cast("string")
    workflow = steps.select(
        rec,
        F.lit("workflow.json").alias("file"),
        F.col("sequence").alias("pos"),
        F.to_json(F.struct(text("event_id").alias("step"), "status", F.concat(F.lit("{{"), "role_hint", F.lit("}}")).alias("input"))).alias("json"),
    )
    refs = F.array_compact(F.array(text("before_event_id"), text("after_event_id")))
    evidence = steps.select(
        rec,
        F.lit("evidence-map.json").alias("file"),
        F.col("sequence").alias("pos"),
        F.to_json(F.struct(text("event_id").alias("step"), refs.alias("evidence"), F.lit("observed").alias("basis"))).alias("json"),
    )
    status = validation.select(
        rec,
        F.lit("validation.json").alias("file"),
        F.lit(0).cast("long").alias("pos"),
        F.to_json(F.struct("structure", "outcome", "review", "rerun")).alias("json"),
    )
    return workflow.unionByName(evidence).unionByName(status)
