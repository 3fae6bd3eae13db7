"""Incremental secret scan over a content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger is two
parquet tables in a folder: ``scanned`` (blob, rules: which blob was scanned under which
rule version) and ``findings`` (blob, rules, kind, order, start, stop). A commit scans
only the blobs whose (blob, rule version) pair the ledger lacks, each distinct text once,
appends, and joins the findings back to all paths.

Offsets are code points, the end exclusive. All matches of a pattern are found natively:
the pieces between the matches (split) and the matches (regexp_extract_all) alternate, so
running sums of their lengths give the offsets.

Cases: null text is an empty text; empty texts have no findings; overlapping findings of
different kinds all stay, of equal starts in the order of the kinds; repeated rows and exact copies share one scan; a very
long text is scanned whole, a kind at a time; an empty table
gives an empty result; a ledger that does not exist yet counts as empty; other columns of
the input do not take part, and names that start with
``__`` and are used here are dropped or replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import scratch


@dataclass(frozen=True)
class Kind:
    """``hints``: lower-case strings one of which every match holds (a cheap first look);
    ``group``: the capture group whose length must reach ``least``."""

    name: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    base: bool = False


#: The base kinds in their listed order, then the kinds that this method adds.
KINDS: tuple[Kind, ...] = (
    Kind(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, ("password", "passwd", "secret", "token", "api"), True,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",), True),
    Kind("hex", r"[0-9a-f]+", 0, 24, (), True),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, ("eyj",)),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, ("xox",)),
    Kind("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39, ("aiza",)),
)
RULE_VERSION = "1"
#: Code points of the blocks that a text with findings is cut into for redaction.
BLOCK = 2048
PAIRS = "blob string, rules string"
FINDINGS = "blob string, rules string, kind string, ord int, start long, stop long"


def _present(kind: Kind, text: Column, lower: Column) -> Column:
    """Whether a scan for ``kind`` can find anything that counts."""
    if kind.hints:
        found = F.lit(False)
        for h in kind.hints:
            found = found | F.contains(lower, F.lit(h))
        return found
    return F.rlike(text, F.lit(f"{kind.pattern[:-1]}{{{kind.least}}}"))


def _cell(i: int):
    return lambda c, j: F.struct(F.lit(i).alias("ord"), j.alias("j"), c["gap"].alias("gap"), c["hit"].alias("hit"))


def scan(blobs: DataFrame, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """blob, kind, ord, start, stop for each finding in ``blobs`` (blob, text)."""
    t, low = F.col("text"), F.lower("text")
    arms = []
    for i, k in enumerate(kinds):
        cells = F.arrays_zip(
            F.split(t, k.pattern, -1).alias("gap"), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0)).alias("hit")
        )
        arms.append(F.when(_present(k, t, low), F.transform(cells, _cell(i))))
    empty = F.array().cast("array<struct<ord:int,j:int,gap:string,hit:string>>")
    # A row per kind first, so that one pass over a text holds one kind's pieces.
    cells = blobs.select("blob", F.explode(F.array(*[F.coalesce(a, empty) for a in arms])).alias("cells")).filter(F.size("cells") > 1)
    cells = cells.select("blob", F.explode("cells").alias("c")).select("blob", "c.*").filter(F.col("hit").isNotNull())
    hit = F.col("hit")
    value = F.lit(0)
    for i, k in reversed(list(enumerate(kinds))):
        value = F.when(F.col("ord") == i, F.char_length(F.regexp_extract(hit, k.pattern, k.group)) >= k.least).otherwise(
            value if i < len(kinds) - 1 else F.lit(False)
        )
    run = Window.partitionBy("blob", "ord").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("blob", "ord", "j", F.char_length("gap").alias("g"), F.char_length("hit").alias("h"), value.alias("counts"))
    cells = cells.withColumn("stop", F.sum(F.col("g") + F.col("h")).over(run)).filter("counts")
    names = F.array(*[F.lit(k.name) for k in kinds])
    return cells.select("blob", F.element_at(names, F.col("ord") + 1).alias("kind"), "ord", (F.col("stop") - F.col("h")).alias("start"), "stop")


def _ledger(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A ledger table; empty if there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def commit(docs: DataFrame, ledger: str, text: str = "text", rules: str = RULE_VERSION, kinds: Sequence[Kind] = KINDS) -> int:
    """Scans what the ledger has not seen under ``rules`` and appends it; the number of blobs scanned.

    Findings are written before the pairs: after a loss in between, the pairs are unseen
    still, and ``findings`` drops the repeated rows.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(F.sha2(t, 256).alias("blob"), t.alias("text"))
    seen = _ledger(spark, ledger, "scanned", PAIRS).filter(F.col("rules") == rules).select("blob")
    # Copies are one row per map task before anything is dealt by blob.
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")
    found = scan(blobs, kinds).withColumn("rules", F.lit(rules))
    found.select(*[c.split()[0] for c in FINDINGS.split(", ")]).write.mode("append").parquet(f"{ledger}/findings")
    fresh = docs.select(F.sha2(t, 256).alias("blob")).distinct().join(seen, "blob", "left_anti")
    told = Observation()
    fresh.withColumn("rules", F.lit(rules)).observe(told, F.count("*").alias("n")).write.mode("append").parquet(f"{ledger}/scanned")
    return told.get["n"]


def findings(spark: SparkSession, ledger: str, rules: str = RULE_VERSION) -> DataFrame:
    """blob, spans (sorted array of structs start, ord, stop, kind) of the blobs with findings."""
    f = _ledger(spark, ledger, "findings", FINDINGS).filter(F.col("rules") == rules)
    return f.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "ord", "stop", "kind"))).alias("spans"))


def paths(docs: DataFrame, ledger: str, text: str = "text", rules: str = RULE_VERSION) -> DataFrame:
    """``docs`` with ``__spans``: the findings of its text (empty array: none), joined by blob.

    The text itself does not go through the join; call it with only the columns needed.
    """
    blob = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = docs.withColumn("__blob", blob)
    found = findings(docs.sparkSession, ledger, rules).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    empty = F.array().cast("array<struct<start:bigint,ord:int,stop:bigint,kind:string>>")
    return keyed.join(found, "__blob", "left").withColumn("__spans", F.coalesce("__spans", empty)).drop("__blob")


def joined(spans: Column, base_only: bool) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    base = len([k for k in KINDS if k.base])
    kept = F.filter(spans, lambda s: s["ord"] < base) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def gaps(spark: SparkSession, ledger: str, rules: str = RULE_VERSION) -> DataFrame:
    """blob, gaps (array of structs start, stop: what stands before each run of overlapping spans), stop (where
    the last run ends) of the blobs with findings. Work is linear in the findings of a blob."""
    f = _ledger(spark, ledger, "findings", FINDINGS).filter(F.col("rules") == rules)
    # Dealt by blob once: repeats, the running stop and the array all keep that partitioning.
    spans = f.select("blob", "start", "stop").repartition("blob").distinct()
    before = F.max("stop").over(Window.partitionBy("blob").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("before", F.coalesce(before, F.lit(0)))
    gap = F.when(F.col("start") >= F.col("before"), F.struct(F.col("before").alias("start"), F.col("start").alias("stop")))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("stop").alias("stop"))


def redacted(docs: DataFrame, ledger: str, text: str = "text", mark: str = "<secret>", rules: str = RULE_VERSION) -> DataFrame:
    """``docs`` with each run of overlapping findings replaced by ``mark`` and ``__n``, the runs replaced. A slice of a long string
    is searched from its start, so a text with findings is first cut into blocks, and a gap is sliced from its own: linear in the text."""
    keyed = docs.drop("__gaps", "__stop").withColumn("__blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    found = gaps(docs.sparkSession, ledger, rules).select(F.col("blob").alias("__blob"), F.col("gaps").alias("__gaps"), F.col("stop").alias("__stop"))
    rows = keyed.join(found, "__blob", "left")
    blocks = F.when(F.col("__gaps").isNotNull(), F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def piece(start: Column, stop: Column) -> Column:
        first, last = F.floor(start / BLOCK), F.floor(stop / BLOCK)
        own = F.array_join(F.slice("__blocks", (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.substr(own, (start - first * BLOCK + 1).cast("int"), (stop - start).cast("int"))

    kept = F.transform("__gaps", lambda g: F.concat(piece(g["start"], g["stop"]), F.lit(mark)))
    whole = F.concat(F.array_join(kept, ""), piece(F.col("__stop"), F.char_length(text)))
    clean = F.when(F.col("__gaps").isNotNull(), whole).otherwise(F.col(text))
    out = rows.withColumn("__blocks", blocks).withColumn("__n", F.coalesce(F.array_size("__gaps"), F.lit(0)))
    return out.withColumn(text, clean).drop("__blob", "__blocks", "__gaps", "__stop")


def op10_secret_scans(spark, sf_dir):
    """Findings of every document, through a ledger that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = scratch(spark, "secret-ledger")
    commit(docs, ledger)
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    keyed = docs.select("doc_id", blob.alias("__blob"))
    found = findings(spark, ledger).select(F.col("blob").alias("__blob"), "spans")
    n = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    per_blob = found.select(
        "__blob", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("spans"), True), 256).alias("base_sha256"), joined(F.col("spans"), False).alias("spans")
    )
    out = keyed.join(per_blob, "__blob", "left").drop("__blob").fillna(0, ["n_assign", "n_access", "n_hex"])
    return out.withColumns({"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))})


def _sql() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    arms = " UNION ALL ".join(
        f"""SELECT rid, {i} AS ord, {lit(k.name)} AS kind, unnest(range(1, len(h) + 1)) AS j, unnest(list_transform(h, lambda x: length(x))) AS hl,
        unnest(list_transform(h, lambda x: length(regexp_extract(x, {lit(k.pattern)}, {k.group})) >= {k.least})) AS ok,
        unnest(list_transform(p[1:len(h)], lambda x: length(x))) AS gl
        FROM (SELECT rid, regexp_extract_all(t, {lit(k.pattern)}) AS h, string_split_regex(t, {lit(k.pattern)}) AS p FROM d)"""
        for i, k in enumerate(KINDS)
    )
    base = len([k for k in KINDS if k.base])
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
c AS ({arms}),
s AS (SELECT rid, ord, kind, ok, hl, sum(gl + hl) OVER (PARTITION BY rid, ord ORDER BY j) AS stop FROM c),
f AS (SELECT rid, ord, kind, kind || ':' || (stop - hl)::BIGINT || ':' || stop::BIGINT AS span, (stop - hl)::BIGINT AS start FROM s WHERE ok),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {base}) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans
      FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


OP10_SQL = _sql()
