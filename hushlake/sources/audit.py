"""Request records and evidence bundles as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.patterns import pattern_scrub
from hushlake.plans.storage import work_dir

REQUESTS = (
    "run_id BIGINT, step BIGINT, request_id STRING, status STRING, http_status INT, response_id STRING, "
    "previous_response_id STRING, input_tokens BIGINT, output_tokens BIGINT, frame_hash STRING, payload STRING"
)
EVIDENCE_SCHEMA = "evidence.v1"


def write_requests(requests: DataFrame, spark: SparkSession, folder: str | None = None) -> str:
    """Append records; ``payload`` may be any nested value and is stored as JSON text."""
    folder = folder or work_dir(spark, "requests")
    columns = [c.split()[0] for c in REQUESTS.split(", ")]
    out = requests.withColumn("payload", F.to_json("payload")) if "payload" in requests.columns else requests
    out.select(*[c for c in columns if c in out.columns]).write.mode("append").json(folder)
    return folder


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Records with fixed columns and the payload as VARIANT."""
    return spark.read.schema(REQUESTS).json(folder).withColumn("payload", F.parse_json("payload"))


def evidence_lines(requests: DataFrame, events: DataFrame, schema_name: str = EVIDENCE_SCHEMA) -> DataFrame:
    """Bundle of every run as ordered lines ``(run_id, part, pos, json)``.

    A run is never collected into one value, so its size does not matter; event
    messages are scrubbed on entry.
    """
    header = requests.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    lines = lambda df, part, pos, body: df.select("run_id", F.lit(part).alias("part"), pos.cast("long").alias("pos"), F.to_json(body).alias("json"))
    head = lines(header, "header", F.lit(0), F.struct(F.lit(schema_name).alias("schema"), "run_id", F.col("n").alias("requests")))
    body = [c for c in requests.columns if c not in ("run_id", "step")]
    sent = lines(requests, "request", F.col("step") + 1, F.struct(*body))
    log = lines(events, "event", F.col("step") + 1, F.struct("kind", pattern_scrub(F.col("message")).alias("message")))
    return head.unionByName(sent).unionByName(log)
