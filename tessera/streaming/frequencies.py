"""Document frequencies kept up by a stateful stream of changes.

Changes (ref, seq, gone, text) are keyed by ref; the state of a ref is the seq of its newest change and the distinct tokens of its text. A newer change gives the
tokens that the document gains and loses, and only those are counted: a batch costs what its documents hold. Counts of a batch are a run of their own, named by its batch number, so that
a batch that runs again after a crash writes over what it wrote before. Where FANOUT runs of equal length stand last, they are added up into one; a reader adds up the runs.

Cases: a change that is late (a seq at or below the held one) or repeated changes nothing; of several changes of a ref in one batch the greatest seq counts, ties to the greater list of
tokens; a withdrawn ref keeps its seq, so that late changes do not bring it back; null texts and texts without a token hold none; rows without a ref or a seq are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import tokens
from tessera.runtime import remove

#: Runs of equal length that are added up into one.
FANOUT = 4
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "tok string, n long"


class Held(StatefulProcessor):
    """The newest seq and the tokens of a ref."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seq long, toks array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max((int(s), sorted(t)) for frame in rows for s, t in zip(frame["seq"], frame["toks"], strict=True))
        there = self.held.get() if self.held.exists() else None
        if there is not None and newest[0] <= there[0]:
            return
        self.held.update(newest)
        new, old = set(newest[1]), set(there[1] if there is not None else ())
        if new != old:
            yield pd.DataFrame({"added": [sorted(new - old)], "removed": [sorted(old - new)]})

    def close(self) -> None:
        pass


def deltas(changes: DataFrame) -> DataFrame:
    """added, removed: the tokens that each changed ref of the stream gains and loses."""
    told = F.array_distinct(tokens(F.col("text")))
    toks = F.when(F.coalesce("gone", F.lit(False)) | told.isNull(), F.array().cast("array<string>")).otherwise(told)
    rows = changes.select("ref", F.col("seq").cast("long").alias("seq"), toks.alias("toks")).dropna(subset=["ref", "seq"])
    return rows.groupBy("ref").transformWithStateInPandas(Held(), "added array<string>, removed array<string>", "Update", "None")


def _runs(spark: SparkSession, sink: str) -> list[tuple[int, int]]:
    """The whole runs (first batch, last batch), without those that a longer one holds."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = there(sink).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there(f"{sink}/run-*/_SUCCESS")) or []
    spans = [tuple(map(int, re.findall(r"\d+", f.getPath().getParent().getName()))) for f in found]
    kept: list[tuple[int, int]] = []
    for lo, hi in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or lo > kept[-1][1]:
            kept.append((lo, hi))
    return kept


def _name(sink: str, lo: int, hi: int) -> str:
    return f"{sink}/run-{lo:012d}-{hi:012d}"


def _summed(spark: SparkSession, sink: str, runs: list[tuple[int, int]]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(*[_name(sink, *r) for r in runs]).groupBy("tok").agg(F.sum("n").alias("n")).filter("n <> 0")


def _fold(spark: SparkSession, sink: str, fanout: int) -> None:
    """Adds up the last runs while they are ``fanout`` of equal length; the parts go once the sum is whole."""
    while len(runs := _runs(spark, sink)) >= fanout and len({hi - lo for lo, hi in runs[-fanout:]}) == 1:
        last = runs[-fanout:]
        _summed(spark, sink, last).write.mode("overwrite").parquet(_name(sink, last[0][0], last[-1][1]))
        for part in last:
            remove(spark, _name(sink, *part))


def keep(changes: DataFrame, sink: str, checkpoint: str, fanout: int = FANOUT) -> int:
    """Takes the changes (a streaming table of ref, seq, gone, text) that the checkpoint does not know; the batches run. The state is in RocksDB,
    on the executors' disks and in the checkpoint; its partitions are the shuffle partitions of the first start."""
    spark = changes.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        # Batches before this one are committed, so none of their runs is written again.
        _fold(batch.sparkSession, sink, fanout)
        each = lambda c, n: F.transform(c, lambda t: F.struct(t.alias("tok"), F.lit(n).cast("long").alias("n")))
        counts = batch.select(F.explode(F.concat(each("added", 1), each("removed", -1))).alias("c")).groupBy("c.tok").agg(F.sum("c.n").alias("n"))
        counts.filter("n <> 0").write.mode("overwrite").parquet(_name(sink, number, number))

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = deltas(changes).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()
    return len(query.recentProgress)


def frequencies(spark: SparkSession, sink: str) -> DataFrame:
    """tok, df: the documents that hold each token, as of the last whole batch."""
    return _summed(spark, sink, _runs(spark, sink)).select("tok", F.col("n").alias("df"))
