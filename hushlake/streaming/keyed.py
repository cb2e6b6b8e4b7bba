"""State of streams as a keyed table: a base, the changes of later batches, and a manifest that names what counts.

A batch writes the new state of the keys it touches and nothing else, so what it writes follows the batch and not the
store. Rows lie in folders by a hash bucket of the key, and a batch reads the buckets of its own keys only. After ``fold``
batches the changes are folded into a new base, so a reader opens a bounded number of folders whatever the number of
batches. What a manifest does not name is not there: a crash before the manifest is written leaves the state as it was,
and a replayed batch starts from the manifest of the batch before it and overwrites its own folder.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 16
FOLD = 8  # batches of changes that are kept beside a base


class Folder:
    """A folder of the shared store, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(""))] if self.fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a small file so that it is there whole or not at all."""
        stream = self.fs.create(self._at(f"_{name}.new"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self._at(name), False)
        if not self.fs.rename(self._at(f"_{name}.new"), self._at(name)):
            raise OSError(f"cannot commit {self.path}/{name}")

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema`` (a DDL string), any number for each value of ``keys``; a batch replaces all rows of the keys it brings."""

    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    fold: int = FOLD

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self, spark: SparkSession) -> list[int]:
        found = (re.fullmatch(r"manifest-(\d+)", n) for n in Folder(spark, self.path).names())
        return sorted(int(m[1]) for m in found if m)

    def _named(self, spark: SparkSession, batch: int | None) -> dict:
        """The newest manifest, or the newest before ``batch``."""
        numbers = [n for n in self._manifests(spark) if batch is None or n < batch]
        return json.loads(Folder(spark, self.path).read(f"manifest-{numbers[-1]}")) if numbers else {"base": None, "changes": []}

    def folders(self, spark: SparkSession, batch: int | None = None) -> list[str]:
        """Folders that a reader opens, oldest first."""
        named = self._named(spark, batch)
        return ([f"base-{named['base']}"] if named["base"] is not None else []) + [f"changes-{n}" for n in named["changes"]]

    def _newest(self, spark: SparkSession, folders: list[str], of: DataFrame | None = None) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        rows = None
        for age, name in enumerate(folders):
            part = spark.read.schema(f"{self.schema}, bucket INT").parquet(f"{self.path}/{name}").withColumn("_age", F.lit(age))
            rows = part if rows is None else rows.unionByName(part)
        if of is not None:
            touched = [r[0] for r in of.select(self._bucket().alias("b")).distinct().collect()]  # bounded by the number of buckets
            rows = rows.filter(F.col("bucket").isin(touched)) if touched else rows.filter(F.lit(False))
        last = F.max("_age").over(Window.partitionBy("bucket", *self.keys))
        return rows.withColumn("_last", last).filter("_age = _last").drop("_age", "_last", "bucket")

    def read(self, spark: SparkSession, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The state after the last committed batch, or as it was before batch ``before``; ``of``: rows whose keys are wanted (their buckets are read)."""
        return self._newest(spark, self.folders(spark, before), of)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Replace the rows of the keys in ``rows`` as of ``batch``, and commit."""
        spark = rows.sparkSession
        columns = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", self.schema)]
        self._store(rows.select(*columns), f"changes-{batch}")
        named = self._named(spark, batch)
        named = {"base": named["base"], "changes": [*named["changes"], batch]}
        if len(named["changes"]) > self.fold:
            # everything up to this batch; only the manifest makes it count
            self._store(self._newest(spark, ([f"base-{named['base']}"] if named["base"] is not None else []) + [f"changes-{n}" for n in named["changes"]]), f"base-{batch}")
            named = {"base": batch, "changes": []}
        self.commit(spark, batch, named)

    def _store(self, rows: DataFrame, name: str) -> None:
        placed = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def commit(self, spark: SparkSession, batch: int, named: dict) -> None:
        """Name what counts from now on, and delete what neither this batch nor a replay of it needs."""
        folder = Folder(spark, self.path)
        folder.put(f"manifest-{batch}", json.dumps(named))
        numbers = [n for n in self._manifests(spark) if n <= batch]
        kept = {f"manifest-{n}" for n in numbers[-2:]}
        for n in numbers[-2:]:
            m = json.loads(folder.read(f"manifest-{n}"))
            kept |= {f"base-{m['base']}", *(f"changes-{c}" for c in m["changes"])}
        for name in folder.names():
            found = re.fullmatch(r"(?:base|changes|manifest)-(\d+)", name)
            if found and int(found[1]) <= batch and name not in kept:
                folder.drop(name)
