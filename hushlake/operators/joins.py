"""Joins of rows whose number Spark cannot tell beforehand, and how many tasks such rows need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(side: DataFrame) -> DataFrame:
    """One side of a join that deals both sides out by their keys, whatever size they seem to have.

    Spark takes the rows that ``explode`` and ``inline`` make for as few as their source has, and rows read from files for as large as
    these; what looks small is gathered in the driver and sent whole to every executor. A merge join holds neither
    side in memory, and adaptive execution splits its hot keys.
    """
    return side.hint("merge")


ROWS_A_TASK = 1 << 17


def tasks_for(rows: DataFrame) -> int:
    """Tasks that hold ``ROWS_A_TASK`` of ``rows`` each (they are counted), 0 where every core has one such task at most.

    ``spark.sql.shuffle.partitions`` does not follow the input, nor does the memory that adaptive execution allows the rows of one
    task. Operators that take ``tasks`` deal their rows to as many and leave the number to Spark where it is 0.
    """
    tasks = -(-rows.count() // ROWS_A_TASK)
    return tasks if tasks > rows.sparkSession.sparkContext.defaultParallelism else 0


def deal_by(rows: DataFrame, tasks: int, name: str, **keys: Column) -> DataFrame:
    """``rows`` dealt to ``tasks`` tasks by ``keys``; ``name`` and ``name_hash`` are added for a join with rows dealt in the same way.

    ``name`` holds the keys as one struct. Structs with NULL in the same places are equal, so a join on it is null-safe; the hash
    stands before it for sorting. Spark leaves both sides where they are only if the join has no other equal keys.
    """
    key = F.struct(*[c.alias(k) for k, c in keys.items()])
    return rows.withColumn(name, key).withColumn(f"{name}_hash", F.xxhash64(name)).repartition(tasks, f"{name}_hash", name)


def same_deal(left: str, right: str) -> Column:
    """Condition of such a join."""
    return (F.col(f"{left}_hash") == F.col(f"{right}_hash")) & (F.col(left) == F.col(right))
