"""Resumable ingestion: file streams, at-least-once appends made exactly-once by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.segments import SegmentedIndex
from tessera.sources.store import first_wins, get_state, set_state

#: Rows that an embedding build encodes between two savings of its cursor.
EMBED_ROWS = 1_000_000


def ingest(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, pattern: str = "*.parquet") -> int:
    """Takes every file of ``source`` that the checkpoint does not know, appends the result to
    ``sink`` with its batch number, and returns the number of batches run."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("load_seq", F.lit(number).cast("long")).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def read_once(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The sink without the rows that a repeated batch wrote again."""
    return first_wins(spark.read.parquet(sink), keys)


def embed_new(
    rows: DataFrame, kind: str, encode: Callable[[Column], Column], sink: str, state: str, model: str = "default", batch_rows: int = EMBED_ROWS, most: int | None = None
) -> tuple[int, int]:
    """Encodes the rows (ref, text; ref a number) beyond the kind's and model's cursor and appends (vid, kind, ref, vector,
    load_seq) to ``sink``, in batches of rising refs. The cursor is saved after each append: a run that was cut off
    goes on there, and ``read_once`` by vid leaves out what its last batch wrote twice. Rows without a ref or with a ref at or below
    the cursor are not taken. ``most`` ends the run after so many batches. Returns (batches run, rows of the kind in all)."""
    spark, name = rows.sparkSession, f"embed_cursor_{kind}_{model}"
    rows = rows.select(F.col("ref").cast("long").alias("ref"), "text").filter("ref is not null")
    after = get_state(spark, state, name)
    left = rows if after is None else rows.filter(F.col("ref") > int(after))
    total, n, last = *rows.agg(F.count("*")).first(), *left.agg(F.count("*"), F.max("ref")).first()
    if not n:
        return 0, total
    parts = -(-n // batch_rows)
    stops = sorted({int(x) for x in left.approxQuantile("ref", [i / parts for i in range(1, parts)], 0.1 / parts)} - {last}) if parts > 1 else []
    low = None if after is None else int(after)
    todo = [*stops, last][:most]
    for stop in todo:
        part = left.filter(F.col("ref") <= stop)
        part = part if low is None else part.filter(F.col("ref") > low)
        vectors = part.select(F.concat(F.lit(f"{kind}:"), "ref").alias("vid"), F.lit(kind).alias("kind"), "ref", encode(F.col("text")).alias("vector"), F.lit(stop).cast("long").alias("load_seq"))
        vectors.write.mode("append").parquet(sink)
        set_state(spark, state, name, str(stop), stop)
        low = stop
    return len(todo), total


def index_new(spark: SparkSession, source: str, schema: T.StructType, to_units: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, pattern: str = "*.parquet") -> int:
    """Takes every file of ``source`` that the checkpoint does not know into the segmented index at ``path``; ``to_units`` makes (ref,
    field, text) of a batch's rows. A batch that runs again after a crash is taken once. Returns the batches run."""

    def take(batch: DataFrame, number: int) -> None:
        SegmentedIndex(spark, path).upsert(to_units(batch), batch=number)

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def unfinished(files: DataFrame, finished: DataFrame) -> DataFrame:
    """Shards (name) still to be done, for batch jobs without a stream."""
    return files.join(finished, "name", "left_anti")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; works on streams, late rows beyond the watermark dropped, and on tables."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
