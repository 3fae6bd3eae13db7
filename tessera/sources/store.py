"""Keyed sinks and scans over parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "key string, value string, load_seq long"


def last_wins(rows: DataFrame, keys: list[str], order: str = "load_seq") -> DataFrame:
    """One row per key, the last loaded."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the first loaded."""
    w = Window.partitionBy(*keys).orderBy(*(order or ("load_seq",)))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def keyset_page(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The ``n`` rows after a key (from the start for None)."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(n)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def open_table(spark: SparkSession, path: str, schema: T.StructType | str, create: bool = False) -> DataFrame:
    """A parquet table; missing: empty if it may be created, else an error."""
    recover(spark, path)
    if not exists(spark, path):
        if not create:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Merges ``rows`` (with load_seq) into the table at ``path`` by writing its next version beside
    it and swapping. The old version is put aside, not deleted, until the new one has its place: after a crash
    between the steps ``open_table`` finishes the swap or undoes it."""
    old = open_table(spark, path, rows.schema, create=True)
    last_wins(old.unionByName(rows), keys).write.mode("overwrite").parquet(f"{path}.next")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(fs_path(f"{path}.old"), True)
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(f"{path}.old"))
    fs.rename(fs_path(f"{path}.next"), fs_path(path))
    fs.delete(fs_path(f"{path}.old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a swap that was cut off: the next version if it was written whole, else the old one."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for version, whole in ((f"{path}.next", f"{path}.next/_SUCCESS"), (f"{path}.old", f"{path}.old")):
        if not fs.exists(fs_path(path)) and fs.exists(fs_path(f"{path}.old")) and fs.exists(fs_path(whole)):
            fs.rename(fs_path(version), fs_path(path))


def set_state(spark: SparkSession, path: str, key: str, value: str, seq: int) -> None:
    upsert(spark, path, spark.createDataFrame([(key, value, seq)], STATE), ["key"])


def get_state(spark: SparkSession, path: str, key: str) -> str | None:
    row = open_table(spark, path, STATE, create=True).filter(F.col("key") == key).first()
    return row["value"] if row else None


def reset(spark: SparkSession, path: str) -> None:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs_path(path), True)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """q, expect_doc, expect_dieu from a JSON array."""
    return spark.read.schema("q string, expect_doc string, expect_dieu string").json(path, multiLine=True)


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that the table does not have yet, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
