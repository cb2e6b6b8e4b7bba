"""Value-free outputs: protected observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions import boxes as B
from hushlake.functions import patterns as P
from hushlake.operators.joins import dealt
from hushlake.operators.ordered import ordered
from hushlake.plans.storage import materialize, work_dir

PROTECTED = (
    "frame_id BIGINT, status STRING, count INT, "
    "masks ARRAY<STRUCT<token: STRING, kind: STRING, x: BIGINT, y: BIGINT, width: BIGINT, height: BIGINT>>, "
    "manifest ARRAY<STRUCT<token: STRING, kind: STRING, label: STRING>>, session_id BIGINT"
)


def protect_frames(
    findings: DataFrame, frames: DataFrame, frame_width: int, frame_height: int, frames_per_chunk: int = 10_000
) -> DataFrame:
    """Masks and manifest of every frame; tokens are numbered per session in first-seen order.

    ``frames(session_id, frame_id)`` are all that were looked at: one without findings is ``ok`` with an empty manifest,
    so a clean frame cannot be taken for a lost one. A frame with one invalid finding gets ``status = 'error'`` and no output.
    """
    # Read twice below: the classifier behind it runs once.
    findings = materialize(findings, "findings")
    checked = findings.withColumn("_reason", B.box_reason("kind", "value", frame_width, frame_height)).withColumn(
        "_at", F.struct("frame_id", "order")
    )
    first = (
        checked.filter(F.col("_reason") == "ok")
        .groupBy("session_id", "kind", "value")
        .agg(F.min("_at").alias("_at"))
    )
    chunk = F.floor(F.col("_at.frame_id") / frames_per_chunk).cast("long")
    numbered = ordered(first, ["session_id", "kind"], ["_at"], chunk, number="_n")
    token = F.concat(F.lit("["), "kind", F.lit("_"), F.col("_n").cast("string"), F.lit("]"))
    tokens = numbered.select("session_id", "kind", "value", token.alias("token"))
    joined = checked.join(dealt(tokens), ["session_id", "kind", "value"], "left")
    clip = B.round_clip(frame_width, frame_height)
    ok = F.bool_and(F.col("_reason") == "ok")
    mask = F.struct("order", "token", "kind", clip.alias("box"))
    per_frame = joined.groupBy("session_id", "frame_id").agg(ok.alias("_ok"), F.array_sort(F.collect_list(mask)).alias("_m"))
    masks = F.transform(
        "_m",
        lambda m: F.struct(
            m["token"].alias("token"), m["kind"].alias("kind"), m["box"]["x"].alias("x"), m["box"]["y"].alias("y"),
            m["box"]["width"].alias("width"), m["box"]["height"].alias("height"),
        ),
    )
    manifest = F.array_distinct(
        F.transform("_m", lambda m: F.struct(m["token"].alias("token"), m["kind"].alias("kind"), P.kind_title(m["kind"]).alias("label")))
    )
    seen = frames.select("session_id", "frame_id").distinct().join(dealt(per_frame), ["session_id", "frame_id"], "left")
    per_frame = seen.withColumn("_ok", F.coalesce("_ok", F.lit(True))).withColumn("_m", F.coalesce("_m", F.array()))
    return per_frame.select(
        "frame_id",
        F.when(F.col("_ok"), "ok").otherwise("error").alias("status"),
        F.when(F.col("_ok"), F.size("_m")).alias("count"),
        F.when(F.col("_ok"), masks).alias("masks"),
        F.when(F.col("_ok"), manifest).alias("manifest"),
        "session_id",
    )


def write_protected(frames: DataFrame, spark: SparkSession, folder: str | None = None, buckets: int = 64) -> str:
    """Append protected frames under ``bucket=hash(session)``; returns the folder.

    Sessions are hashed into a fixed number of directories, so the folder count does
    not grow with the sessions; ``sortWithinPartitions`` keeps a session's rows together.
    """
    folder = folder or work_dir(spark, "protected")
    bucket = F.pmod(F.hash("session_id"), F.lit(buckets))
    frames.withColumn("bucket", bucket).sortWithinPartitions("bucket", "session_id", "frame_id").write.mode(
        "append"
    ).partitionBy("bucket").parquet(folder)
    return folder


def read_protected(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROTECTED + ", bucket INT").parquet(folder)
