"""An index that is kept up: immutable segments, marks of dead units, a geometric merge.

Each batch of added or changed units becomes a segment, an index of its own, and the refs that it replaces or withdraws are marked dead
in the segments that hold them, with the frequencies that they take along. Nothing else is written, so an upsert costs what its batch and
the dead units hold. Where FANOUT segments stand on one level, their live postings are merged into one of the next level, so that a
posting is written again once per level. A reader adds up frequencies and bounds over segments, less what is dead, and ranks as over
a full rebuild.

What counts is the newest manifest, a small file that appears by a rename: an upsert that is cut off before leaves folders that the next one
writes over. Folders that a merge has replaced go one upsert later, when readers of the version before are gone. A unit's rows all
come in one batch; a batch number that was taken before is not taken again.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import index
from tessera.runtime import remove

#: Segments of a level that are merged into one of the next.
FANOUT = 4


class SegmentedIndex:
    """The segments under ``path``, as of the newest manifest. For standing questions, ``asked`` (tok, the same ones at every opening) are the
    only tokens that are posted; lengths, totals and what is dead are of all units."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, asked: DataFrame | None = None):
        self.spark, self.path, self.fanout, self.asked = spark, path.rstrip("/"), fanout, asked
        self.state = self._newest()

    # The manifest

    def _fs(self):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return there(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _newest(self) -> dict:
        fs, there = self._fs()
        found = fs.globStatus(there(f"{self.path}/manifest-*.json")) or []
        if not len(found):
            return {"version": 0, "made": 0, "batch": None, "ref": None, "segments": [], "dead": [], "replaced": []}
        last = max(f.getPath().getName() for f in found)
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{last}", wholetext=True).collect()))

    def _commit(self, state: dict) -> None:
        fs, there = self._fs()
        name = f"{self.path}/manifest-{state['version']:012d}.json"
        out = fs.create(there(f"{self.path}/_manifest.tmp"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(there(f"{self.path}/_manifest.tmp"), there(name)):
            raise RuntimeError(f"{name} is there already: two writers at once")
        for old in self.state["replaced"]:
            remove(self.spark, f"{self.path}/{old}")
        remove(self.spark, f"{self.path}/manifest-{state['version'] - 2:012d}.json")
        self.state = state

    # Reading

    def _ref(self, state: dict) -> T.DataType:
        return T.StructType.fromJson(state["ref"])["ref"].dataType

    def _all(self, state: dict, what, names: list[str] | None = None) -> DataFrame | None:
        """The union of ``what`` of each segment's index, with the segment's name."""
        parts = [what(f"{self.path}/{s['name']}").withColumn("segment", F.lit(s["name"])) for s in state["segments"] if names is None or s["name"] in names]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _marks(self, state: dict, kind: str, schema: str) -> DataFrame | None:
        """The rows of all mark tables that concern segments that are still there."""
        if not state["dead"]:
            return None
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}-{n}" for n in state["dead"]])
        return rows.filter(F.col("segment").isin([s["name"] for s in state["segments"]]))

    def _live(self, state: dict, rows: DataFrame) -> DataFrame:
        dead = self._marks(state, "dead", f"segment string, ref {self._ref(state).simpleString()}")
        return rows if dead is None else rows.join(dead, ["segment", "ref"], "left_anti")

    def view(self) -> index.Index:
        """What rankings read: all live units."""
        s = self.state
        if not s["segments"]:
            raise ValueError("the index has no segment yet")
        part = lambda name: self._all(s, lambda path: getattr(index.opened(self.spark, path, self._ref(s)), name))
        words, pairs, length = (self._live(s, part(name)).drop("segment") for name in ("words", "pairs", "lengths"))
        bounds = part("bounds").groupBy("shelf", "tok", "block").agg(F.sum("df").alias("df"), F.max("n").alias("n"), F.min("len").alias("len"))
        counts, less = part("frequencies"), self._marks(s, "less", "segment string, tok string, df long")
        if less is not None:
            counts = counts.unionByName(less.withColumn("df", -F.col("df")))
        counts = counts.groupBy("tok").agg(F.sum("df").alias("df")).filter("df > 0")
        return index.Index(words, pairs, bounds, length, counts, length.agg(F.count("*").alias("units"), F.avg("len").alias("avgdl")))

    # Writing

    def upsert(self, u: DataFrame | None, withdrawn: DataFrame | None = None, batch: int | None = None) -> bool:
        """Takes units (ref, field, text), which replace those of the same ref, and withdraws others (ref). False if ``batch`` was taken before."""
        if batch is not None and self.state["batch"] is not None and batch <= self.state["batch"]:
            return False
        s = json.loads(json.dumps(self.state))
        s |= {"version": s["version"] + 1, "made": s["made"] + 1, "batch": s["batch"] if batch is None else batch, "replaced": []}
        given = [d.select("ref") for d in (u, withdrawn) if d is not None]
        if given and s["segments"]:
            self._mark(s, reduce(DataFrame.unionByName, given).filter("ref IS NOT NULL").distinct())
        if u is not None:
            s["ref"] = T.StructType([T.StructField("ref", u.schema["ref"].dataType)]).jsonValue()
            name = f"segment-{s['made']}"
            made = index.build(u, f"{self.path}/{name}", self.asked)
            if made.totals.first()["units"]:
                s["segments"].append({"name": name, "level": 0})
            else:
                s["replaced"].append(name)
        while level := next((x["level"] for x in s["segments"] if sum(y["level"] == x["level"] for y in s["segments"]) >= self.fanout), -1) + 1:
            self._merge(s, level)
        self._commit(s)
        return True

    def _mark(self, s: dict, refs: DataFrame) -> None:
        """Writes which units are dead from now on, and the frequencies that go with them."""
        opened = lambda path: index.opened(self.spark, path, self._ref(s))
        held = self._live(s, self._all(s, lambda path: opened(path).lengths)).join(refs, "ref", "left_semi")
        held.select("segment", "ref").write.mode("overwrite").parquet(f"{self.path}/dead-{s['made']}")
        dead = self.spark.read.schema(f"segment string, ref {self._ref(s).simpleString()}").parquet(f"{self.path}/dead-{s['made']}")
        names = [r["segment"] for r in dead.select("segment").distinct().collect()]
        if not names:
            remove(self.spark, f"{self.path}/dead-{s['made']}")
            return
        words = self._all(s, lambda path: opened(path).words, names).select("segment", "tok", "ref")
        less = words.join(dead, ["segment", "ref"], "left_semi").distinct().groupBy("segment", "tok").agg(F.count("*").alias("df"))
        less.write.mode("overwrite").parquet(f"{self.path}/less-{s['made']}")
        s["dead"].append(s["made"])

    def _merge(self, s: dict, level: int) -> None:
        """The segments below ``level`` on their level become one, without their dead units."""
        names = [x["name"] for x in s["segments"] if x["level"] == level - 1]
        s["made"] += 1
        name = f"segment-{s['made']}"
        posted = self._all(s, lambda path: index.postings_of(self.spark, path, self._ref(s)), names)
        index.lay(f"{self.path}/{name}", self._live(s, posted).drop("segment"))
        s["segments"] = [x for x in s["segments"] if x["name"] not in names] + [{"name": name, "level": level}]
        s["replaced"] += names
        left = {x["name"] for x in s["segments"]}
        for n in list(s["dead"]):
            # Marks go when no segment that they concern is left.
            held = self.spark.read.schema("segment string").parquet(f"{self.path}/dead-{n}").select("segment").distinct().collect()
            if not left & {r["segment"] for r in held}:
                s["dead"].remove(n)
                s["replaced"] += [f"dead-{n}", f"less-{n}"]
