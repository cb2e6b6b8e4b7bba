"""Work folders and materialised intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []  # folders of this process that have not been deleted


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder the session names in ``spark.checkpoint.dir``.

    Only a single-machine session without that setting (tests) falls back to a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="hushlake-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def delete_work(spark: SparkSession) -> None:
    """Delete every folder that :func:`work_dir` has named in this process.

    They can hold private values in clear. Call it once the results that are read from them have been written elsewhere.
    """
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs whose DataFrames are gone.

    It does so when the driver collects its garbage, which in a long query with little of it may be after the last job. For use
    between two parts of a query that both shuffle much, where :func:`materialize` has cut the lineage.
    """
    gc.collect()
    spark._jvm.System.gc()
