"""How the harness reads small single-file tables; cluster inputs come in as many splits as their reader makes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Split an input that arrives in fewer partitions than there are cores.

    A large table already has more splits than cores and is left alone, so the
    extra exchange only happens for small single-file inputs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
