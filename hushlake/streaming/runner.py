"""Running a stream to the end of its available input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.plans.storage import work_dir


#: State in RocksDB whose checkpoints hold the changes of a batch, not the whole store.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def table_stream(spark: SparkSession, folder: str, name: str, order: Column, batches: int = 3) -> DataFrame:
    """A table as a stream of ``batches`` micro-batches; timestamps without zone become event-time columns.

    The table is first written once as files along ``order`` (a number; rows whose order is null come first, NaN last), and
    the files get times in that order, as a stream reads files by their times.
    """
    static = spark.read.parquet(f"{folder}/{name}.parquet")
    path = work_dir(spark, f"{name}-stream")
    each = max(1, spark.sparkContext.defaultParallelism // 2)  # files of a micro-batch
    at = order.cast("double")
    static.repartitionByRange(batches * each, at.asc_nulls_first()).write.parquet(path)
    folder_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder_.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.listStatus(folder_) if s.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    start = spark._jvm.System.currentTimeMillis() - 1000 * (len(files) + 1)
    for n, file in enumerate(files):
        fs.setTimes(file, start + 1000 * n, -1)
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(path)
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in static.schema if f.dataType.typeName() == "timestamp_ntz"}
    return stream.withColumns(zoned) if zoned else stream


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Append everything that is available to a Parquet table and return it."""
    spark = stream.sparkSession
    path = work_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", path + "-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], path: str, mode: str = "append") -> None:
    """Feed every micro-batch to ``write(batch, number)``; a replayed number must overwrite itself.

    ``mode``: ``update`` where the stream aggregates. State of operators before it lies in RocksDB, beside the checkpoint
    in the shared folder.
    """
    conf = stream.sparkSession.conf
    other = {k: conf.get(k, None) for k in STATE}
    for k, v in STATE.items():  # read when the query starts
        conf.set(k, v)
    try:
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", path + "-checkpoint")
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in other.items():
            conf.unset(k) if v is None else conf.set(k, v)
