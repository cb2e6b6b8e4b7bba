"""Tables laid out by frame, so that the operators that read them need no shuffle on session and frame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from hushlake.plans.storage import work_dir

KEY = ("session_id", "frame_id")


def lay_out(rows: DataFrame, buckets: int | None = None, name: str | None = None, folder: str | None = None) -> DataFrame:
    """``rows`` written as a table bucketed and sorted by session and frame, and read back.

    Grouping, windows and joins whose keys include both columns read it without an exchange; tables that are to be joined
    need equal ``buckets`` (by default ``spark.sql.shuffle.partitions``) and equal key types. A hot session is spread by
    its frames. NULL keys share a bucket and stay; repeated rows, empty tables and other columns are kept as they are. The table is an
    external one of the session's catalog under ``name`` (an existing table of that name is an error); without ``folder``
    its files lie in the work folder and go with :func:`hushlake.plans.storage.delete_work`.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"hushlake_{uuid.uuid4().hex}"
    # the shuffle deals rows as the buckets do: one file a bucket, however many tasks wrote the input
    dealt = rows.repartition(buckets, *KEY)
    path = folder or work_dir(spark, "layout")
    dealt.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
