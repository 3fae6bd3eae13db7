"""A table kept up by key: a merge writes again only the files that hold a changed key.

The rows lie in Parquet files, each a range of keys when it was written. What counts is the newest manifest, a small file that names the live files and
appears by a rename. A merge stages the newest change of each key, finds the files that hold one of those keys (a scan of the key columns alone), writes these
files' rows and the changes anew, and names the new files beside the untouched ones. A merge that is cut off at any step leaves files that no manifest names: the
next merge writes over them. Files that a merge has replaced are deleted one merge later, when readers of the version before are gone.

Cases: of rows with one key the greatest by the order columns counts, then by the other columns, so repeated rows, ties and late changes end the same in any order
of arrival; a withdrawn key stays as a mark, so that a late change does not bring it back; rows with a null in a key are dropped; an empty change makes a version
without new files; a batch number that was taken before is not taken again. Columns must be of types that can be ordered. The driver holds names of files, no rows.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import remove

#: Rows of a file.
FILE_ROWS = 1_000_000
GONE = "__gone"


class KeyedTable:
    """The table under ``path`` as of its newest manifest; ``order``: the columns that tell which row of a key is newer."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], file_rows: int = FILE_ROWS):
        self.spark, self.path, self.keys, self.order, self.file_rows = spark, path.rstrip("/"), keys, order, file_rows
        self.there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.there(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._newest()

    def _newest(self) -> dict:
        found = self.fs.globStatus(self.there(f"{self.path}/manifest-*.json")) or []
        if not len(found):
            return {"version": 0, "batch": None, "schema": None, "files": [], "replaced": []}
        last = max(f.getPath().getName() for f in found)
        return json.loads(self.spark.read.text(f"{self.path}/{last}", wholetext=True).first()[0])

    def _commit(self, state: dict) -> None:
        out = self.fs.create(self.there(f"{self.path}/_manifest.tmp"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        name = f"{self.path}/manifest-{state['version']:012d}.json"
        if self.fs.exists(self.there(name)) or not self.fs.rename(self.there(f"{self.path}/_manifest.tmp"), self.there(name)):
            raise RuntimeError(f"{name} is there already: two writers at once")
        for old in self.state["replaced"]:
            self.fs.delete(self.there(f"{self.path}/{old}"), False)
        remove(self.spark, f"{self.path}/manifest-{state['version'] - 2:012d}.json")
        self.state = state

    def _files(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def read(self) -> DataFrame:
        """The rows of all keys that are not withdrawn."""
        if self.state["schema"] is None:
            raise FileNotFoundError(self.path)
        return self._files(self.state["files"], T.StructType.fromJson(self.state["schema"])).filter(~F.col(GONE)).drop(GONE)

    def _newer(self, rows: DataFrame) -> DataFrame:
        """One row per key. A maximum combines before the shuffle, so a hot key is a row per task."""
        rest = [c for c in rows.columns if c not in {*self.keys, *self.order}]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *rest)).alias("__best"))
        return best.select(*self.keys, "__best.*").select(*rows.columns)

    def touched(self, changed: DataFrame) -> list[str]:
        """The live files that hold a key of ``changed``."""
        if not self.state["files"]:
            return []
        held = self._files(self.state["files"], T.StructType.fromJson(self.state["schema"])).select(*self.keys, F.col("_metadata.file_path").alias("__file"))
        bounds = changed.agg(*[g(c).alias(f"{n}_{c}") for c in self.keys for n, g in (("lo", F.min), ("hi", F.max))]).first()
        if bounds[0] is None:
            return []
        within = [F.col(c).between(F.lit(bounds[f"lo_{c}"]), F.lit(bounds[f"hi_{c}"])) for c in self.keys]
        found = held.filter(reduce(Column.__and__, within)).join(changed.select(*self.keys), self.keys, "left_semi").select("__file").distinct()
        return sorted("/".join(r[0].split("/")[-2:]) for r in found.collect())

    def merge(self, rows: DataFrame, gone: Column | None = None, batch: int | None = None) -> bool:
        """Takes changes (key, order and data columns; ``gone``: the change withdraws its key). False if ``batch`` was taken before."""
        if batch is not None and self.state["batch"] is not None and batch <= self.state["batch"]:
            return False
        version, told = self.state["version"] + 1, Observation()
        rows = rows.withColumn(GONE, F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).dropna(subset=self.keys)
        staged = f"{self.path}/_staged"
        self._newer(rows).observe(told, F.count("*").alias("n")).write.mode("overwrite").parquet(staged)
        changed = self.spark.read.schema(rows.schema).parquet(staged)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        old, made, n = self.touched(changed), [], told.get["n"]
        if n:
            held = self._files(old, schema)
            files = -(-(n + (held.count() if old else 0)) // self.file_rows)
            folder = f"data-{version:012d}"
            whole = self._newer(held.unionByName(changed)).repartitionByRange(files, *self.keys).sortWithinPartitions(*self.keys)
            whole.write.mode("overwrite").parquet(f"{self.path}/{folder}")
            found = self.fs.globStatus(self.there(f"{self.path}/{folder}/part-*"))
            made = sorted(f"{folder}/{f.getPath().getName()}" for f in found)
        untouched = [f for f in self.state["files"] if f not in set(old)]
        taken = self.state["batch"] if batch is None else batch
        self._commit({"version": version, "batch": taken, "schema": schema.jsonValue(), "files": untouched + made, "replaced": old})
        remove(self.spark, staged)
        return True
