"""Stateful streams: micro-batches whose small per-key state is a :class:`KeyedTable`.

What a batch does is a DataFrame job: a session that owns a third of a batch is split like in the batch operators, and only
one small row for each session crosses from batch to batch. A replayed batch number overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.operators.history import history_retention
from hushlake.operators.ordered import ROWS_PER_CHUNK, even_chunk, ordered
from hushlake.streaming.keyed import KeyedTable

VAULT = "session_id INT, kind STRING, value STRING, number BIGINT, first_seq BIGINT"
NUMBERS = "session_id INT, kind STRING, last BIGINT"
TAILS = "session_id BIGINT, frame_hash STRING, ts TIMESTAMP, event_id BIGINT"


def first_sightings(sightings: DataFrame) -> DataFrame:
    """The stream of values seen in a batch: ``session_id, kind, value, first_seq`` and ``since, now``, equal if the value is new to its session.

    Known values lie in the state store, keyed by the value itself, so that the values of a hot session are dealt over
    tasks, and a batch looks up its own values only. ``since`` and ``now`` are times of batches, which a replay repeats.
    """
    rows = sightings.withColumn("_at", F.current_timestamp())
    return rows.groupBy("session_id", "kind", "value").agg(
        F.min("seq").alias("first_seq"), F.min("_at").alias("since"), F.max("_at").alias("now")
    )


def _numbers(path: str) -> KeyedTable:
    return KeyedTable(f"{path}-numbers", NUMBERS, ("session_id", "kind"))


def vault_writer(path: str, rows: int = ROWS_PER_CHUNK) -> Callable[[DataFrame, int], None]:
    """Issue tokens for :func:`first_sightings`; numbers continue across batches.

    The last number of each (session, kind) is the only state a batch reads here; values issued before are not read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, ["session_id", "kind"]
        new = batch.filter("since = now").drop("since", "now").persist()
        try:
            last = _numbers(path).read(spark, number, new).select(F.struct(*keys).alias("_key"), "last")
            fresh = ordered(new, keys, ["first_seq"], even_chunk(new, keys, ["first_seq"], rows), number="_n")
            out = fresh.withColumn("_key", F.struct(*keys)).join(last, "_key", "left").select(
                *keys, "value", (F.col("_n") + F.coalesce("last", F.lit(0))).alias("number"), "first_seq"
            )
            out.write.mode("overwrite").parquet(f"{path}/batch={number}")
            issued = spark.read.schema(VAULT).parquet(f"{path}/batch={number}")
            _numbers(path).write(issued.groupBy(*keys).agg(F.max("number").alias("last")), number)
        finally:
            new.unpersist()

    return write


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """The vault as of the last batch; a later secret blocks every earlier token of its value."""
    rows = spark.read.schema(VAULT + ", batch BIGINT").parquet(path).drop("batch")
    secret = rows.groupBy("session_id", "value").agg(F.bool_or(F.col("kind") == "SECRET").alias("blocked"))
    secret = secret.select(F.struct("session_id", "value").alias("_key"), "blocked")
    token = F.concat(F.lit("["), "kind", F.lit("_"), F.col("number").cast("string"), F.lit("]"))
    return rows.withColumn("_key", F.struct("session_id", "value")).join(secret, "_key").select(
        "session_id", "kind", "value", token.alias("token"), "first_seq", "blocked"
    )


def frame_change_writer(path: str, expiry: str | None = None) -> Callable[[DataFrame, int], None]:
    """Keep a frame only when it differs from the one before it in its session, across batches.

    Inside a batch neighbours are found by the ordered operator; only the latest frame of each session crosses to the next. With
    ``expiry`` (an interval such as ``30 minutes``) a session's latest frame is forgotten when its next one is later than
    that, and the next one is kept whatever it shows.
    """
    tails = KeyedTable(f"{path}-tails", TAILS, ("session_id",))
    columns = ["session_id", "frame_hash", "ts", "event_id"]

    def write(batch: DataFrame, number: int) -> None:
        spark, order = batch.sparkSession, ["ts", "event_id"]
        batch = batch.persist()
        try:
            chunk = even_chunk(batch, ["session_id"], order)
            rows = ordered(batch, ["session_id"], order, chunk, lag={"_prev": F.struct("frame_hash", "ts")})
            before = tails.read(spark, number, batch)
            tail = before.select(F.struct("session_id").alias("_key"), F.struct("frame_hash", "ts").alias("_tail"))
            met = rows.withColumn("_key", F.struct("session_id")).join(tail, "_key", "left")
            previous = F.coalesce("_prev", "_tail")
            changed = previous.isNull() | ~previous["frame_hash"].eqNullSafe(F.col("frame_hash"))
            if expiry:
                changed = changed | F.coalesce(F.col("ts") > previous["ts"] + F.expr(f"INTERVAL {expiry}"), F.lit(False))
            met.filter(changed).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
            touched = batch.select("session_id").distinct().select(F.struct("session_id").alias("_key"))
            old = before.withColumn("_key", F.struct("session_id")).join(touched, "_key", "left_semi").drop("_key")
            latest = old.select(*columns).unionByName(batch.select(*columns)).groupBy("session_id").agg(
                F.max_by(F.struct("frame_hash", "ts", "event_id"), F.struct("ts", "event_id")).alias("t")
            )
            tails.write(latest.select("session_id", "t.*"), number)
        finally:
            batch.unpersist()

    return write


def history_table(path: str, schema: str) -> KeyedTable:
    return KeyedTable(path, schema, ("session_id",))


def history_writer(path: str, schema: str) -> Callable[[DataFrame, int], None]:
    """Bounded history: the stored suffix of the batch's own sessions plus the batch, cut to the limits again."""
    table = history_table(path, schema)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select(*[c.split()[0] for c in schema.split(", ")]).persist()
        try:
            touched = batch.select(F.struct("session_id").alias("_key")).distinct()
            stored = table.read(batch.sparkSession, number, batch).withColumn("_key", F.struct("session_id"))
            entries = stored.join(touched, "_key", "left_semi").drop("_key").unionByName(batch)
            table.write(history_retention(entries), number)
        finally:
            batch.unpersist()

    return write


STATUS = "request_id STRING, latest STRUCT<ts: TIMESTAMP, rank: BIGINT, status: STRING>"
STATUS_RANK = ("prepared", "responded", "failed")  # at equal times the later of these is the latest


def _latest() -> Column:
    rank = F.array_position(F.array(*map(F.lit, STATUS_RANK)), F.col("status"))
    return F.struct("ts", rank.alias("rank"), "status")


def status_table(path: str) -> KeyedTable:
    return KeyedTable(path, STATUS, ("request_id",))


def status_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Latest status per request: the batch's own requests are merged with what is stored of them."""
    table = status_table(path)

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("request_id").agg(F.max(_latest()).alias("latest")).persist()
        try:
            stored = table.read(batch.sparkSession, number, latest)
            ids = latest.select(F.struct("request_id").alias("_key"))
            stored = stored.withColumn("_key", F.struct("request_id")).join(ids, "_key", "left_semi").drop("_key")
            table.write(stored.unionByName(latest).groupBy("request_id").agg(F.max("latest").alias("latest")), number)
        finally:
            latest.unpersist()

    return write


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return status_table(path).read(spark).select("request_id", F.col("latest.status").alias("status"))
