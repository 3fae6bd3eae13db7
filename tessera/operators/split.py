"""Documents into citable articles, and long articles into parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import LEGAL, Profile
from tessera.functions.arrays import let, offsets, settle
from tessera.functions.text import normalize, strip


def truncate_tail(text: Column, profile: Profile = LEGAL) -> Column:
    """Cuts at the first annex line if it stands late in the text, then at the length limit."""
    if profile.annex:
        before = F.regexp_extract(text, rf"(?mds)\A(.*?)(?=^{profile.annex})", 1)
        at = F.when(F.rlike(text, F.lit(f"(?md)^{profile.annex}")), F.char_length(before)).otherwise(F.lit(0))
        late = (at > profile.annex_after) & (at > 0.4 * F.char_length(text))
        text = F.when(late, before).otherwise(text)
    return F.substring(text, 1, profile.doc_chars)


def boundaries(text: Column, pattern: str) -> Column:
    """Offsets at which ``pattern`` (given with its anchor) matches, 0 excluded."""
    at = offsets(F.transform(F.split(text, f"(?md)(?={pattern})", -1), lambda p: F.char_length(p)))
    return F.filter(at, lambda x: x > 0)


def _line_starts(text: Column) -> Column:
    """Offsets of the line feeds, 0 excluded: a part begins with the line feed that ends the one before."""
    at = offsets(F.transform(F.split(text, "\n", -1), lambda p: F.char_length(p) + 1))
    return F.filter(F.transform(at, lambda x: x - 1), lambda x: x > 0)


def greedy_cuts(n: Column, bounds: Column, limit: int) -> Column:
    """Starts of the parts: each part goes to the farthest boundary within ``limit`` of its
    start; where there is none it is cut hard at ``limit``. Only a cut touches the list of cuts."""
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("last"), F.array(F.lit(0)).alias("cuts"))

    def step(a: Column, b: Column) -> Column:
        far = (b - a["start"] > limit) & (a["last"] > a["start"])
        begin = F.when(far, a["last"]).otherwise(a["start"])
        cuts = F.when(far, F.array_append(a["cuts"], a["last"])).otherwise(a["cuts"])
        more = F.greatest(F.ceil((b - begin) / limit).cast("int") - 1, F.lit(0))
        hard = F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda k: (begin + k * limit).cast("int"))
        past = F.struct((begin + more * limit).cast("int").alias("start"), b.cast("int").alias("last"), F.when(more > 0, F.concat(cuts, hard)).otherwise(cuts).alias("cuts"))
        on = F.struct(a["start"].alias("start"), b.cast("int").alias("last"), a["cuts"].alias("cuts"))
        return F.when(b - a["start"] <= limit, on).otherwise(past)

    return F.aggregate(F.array_append(bounds, n), start, step)["cuts"]


def split_long(text: Column, limit: int, clause: str | None) -> Column:
    """Parts of a text of at most ``limit`` characters; blank ones are dropped."""

    def cut(t: Column) -> Column:
        n = F.char_length(t)
        if clause:
            first = lambda at: (F.size(at) > 0) & (F.coalesce(F.get(at, F.lit(0)), F.lit(0)) <= limit)
            bounds = let(boundaries(t, f"^{clause}"), lambda at: F.when(first(at), at).otherwise(_line_starts(t)))
        else:
            bounds = _line_starts(t)

        def parts(cuts: Column) -> Column:
            ends = F.concat(F.slice(cuts, 2, F.greatest(F.size(cuts), F.lit(1))), F.array(n))
            return F.filter(F.zip_with(cuts, ends, lambda s, e: F.substr(t, s + 1, e - s)), lambda p: strip(p) != "")

        return let(greedy_cuts(n, bounds, limit), parts)

    return F.when(F.char_length(text) <= limit, F.array(text)).otherwise(let(text, cut))


def books(articles: DataFrame, doc: str = "doc_id", order: str = "piece", number: str = "no") -> DataFrame:
    """Adds ``book``: how often the article numbers began anew (a low number after a higher one).

    The running state after number n is n itself for n <= 2, else the maximum since the
    last such n; two windows give it without a fold. A first piece without a number counts for nothing.
    """
    w = Window.partitionBy(doc).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    a = articles.withColumn("__seg", F.sum((F.col(number) <= 2).cast("int")).over(upto))
    a = a.withColumn("__hi", F.max(number).over(Window.partitionBy(doc, "__seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("__p", F.coalesce(F.lag("__hi", 1).over(w), F.lit(-1)))
    fresh = (F.col("__p") >= 1) & (F.col(number) <= 2) & (F.col(number) < F.col("__p"))
    return a.withColumn("book", F.sum(fresh.cast("int")).over(upto)).drop("__seg", "__hi", "__p")


def pieces(docs: DataFrame, profile: Profile = LEGAL, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, body, no (article number, null: preamble), chapter (nearest above), pieces (of the document) per piece of the normalized text."""
    # Whole texts are normalized once and cut once, whatever looks at them after.
    rows = settle(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("t")), "t", normalize(F.coalesce("t", F.lit(""))))
    rows = settle(rows, "t", truncate_tail(F.col("t"), profile)).filter(F.char_length("t") >= profile.least_chars)
    if not profile.article:
        return rows.select("doc_id", F.lit(0).alias("piece"), F.col("t").alias("body"), F.lit("").alias("no"), F.lit("").alias("chapter"), F.lit(1).alias("pieces"))
    cut = F.split("t", f"(?md)(?=^{profile.article})", -1)
    rows = rows.select("doc_id", cut.alias("cut")).select("doc_id", F.size("cut").alias("pieces"), F.posexplode("cut").alias("piece", "body"))
    rows = rows.withColumn("no", F.nullif(F.regexp_extract("body", f"(?md)\\A{profile.article}", 1), F.lit("")))
    own = F.regexp_extract_all("body", F.lit(f"(?md)^({profile.chapter})"), F.lit(1))
    rows = rows.withColumn("__own", F.try_element_at(own, F.lit(-1)))
    above = Window.partitionBy("doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    chapter = F.last("__own", ignorenulls=True).over(above)
    return rows.withColumn("chapter", F.coalesce(strip(F.regexp_replace(chapter, r"(?U)\s+", " ")), F.lit(""))).drop("__own")


def split_documents(docs: DataFrame, profile: Profile = LEGAL, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """chunk_id, doc_id, seq, book, chapter, article_no, article_title, part, n_parts, text.

    Of chunks with one id the first of the document stays, and leaves its later
    namesakes' places in ``seq`` empty.
    """
    p = settle(pieces(docs, profile, doc, text), "body", strip("body"))
    if profile.article:
        # The beginning and the articles in one pass: numbers begin anew among articles alone, and the beginning has no number.
        p = p.filter("no is not null or piece = 0").withColumn("n", F.regexp_extract("no", r"^(\d+)", 1).cast("long"))
        p = books(p, number="n").filter(F.char_length("body") >= profile.least_chars)
        # Before articles it is stripped, then cut; of a text without articles the beginning is cut, then stripped.
        pre, head = F.col("no").isNull(), F.substring("body", 1, profile.preamble_chars)
        p = p.withColumn("body", F.when(~pre, F.col("body")).when(F.col("pieces") > 1, head).otherwise(strip(head)))
        p = p.filter(~pre | (F.col("pieces") > 1) | (F.char_length("body") >= profile.least_chars))
        title = F.substring(strip(F.split("body", "\n", 2)[0]), 1, profile.title_chars)
        of = lambda at_first, else_: F.when(pre, at_first).otherwise(else_)
        rows = p.select(
            "doc_id", of(F.lit(-1), F.col("piece")).alias("piece"), of(F.lit(0), F.col("book")).alias("book"), of(F.lit(""), F.col("chapter")).alias("chapter"),
            F.coalesce("no", F.lit("")).alias("no"), of(F.lit(""), title).alias("title"), "body", of(F.array("body"), split_long(F.col("body"), profile.chunk_chars, profile.clause)).alias("parts"),
        )
    else:
        rows = p.select("doc_id", "piece", F.lit(0).alias("book"), "chapter", "no", F.lit("").alias("title"), "body").withColumn("parts", split_long(F.col("body"), profile.chunk_chars, None))
    rows = settle(rows, "parts", F.col("parts")).withColumn("n_parts", F.size("parts")).select("doc_id", "piece", "book", "chapter", "no", "title", "n_parts", F.posexplode("parts").alias("part", "text"))
    rows = rows.withColumn("text", F.when(F.col("piece") < 0, F.col("text")).otherwise(strip("text"))).filter((F.col("n_parts") == 1) | (F.char_length("text") >= profile.least_chars))
    if profile.article:
        rows = rows.withColumn("text", F.when((F.col("part") > 0) & (F.col("title") != ""), F.concat(F.lit(profile.continued), "title", F.lit("\n"), "text")).otherwise(F.col("text")))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("piece", "part")) - 1)
    named = F.concat(
        F.col("doc_id").cast("string"), F.lit("#"),
        F.when(F.col("piece") < 0, F.lit("pre")).otherwise(F.concat(F.when(F.col("book") > 0, F.concat(F.lit("b"), "book")).otherwise(F.lit("")), F.lit("d"), "no")),
        F.when(F.col("n_parts") > 1, F.concat(F.lit("."), "part")).otherwise(F.lit("")),
    )
    rows = rows.withColumn("chunk_id", named)
    once = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("seq"))
    rows = rows.withColumn("__once", once).filter("__once = 1")
    return rows.select("chunk_id", "doc_id", "seq", "book", "chapter", F.col("no").alias("article_no"), F.col("title").alias("article_title"), "part", "n_parts", "text")


def label(no: Column, part: Column, n_parts: Column, with_part: bool = True) -> Column:
    """How a chunk is cited."""
    whole = F.concat(F.lit("Điều "), no)
    if with_part:
        whole = F.when(n_parts > 1, F.concat(whole, F.lit(" (phần "), (part + 1).cast("string"), F.lit("/"), n_parts.cast("string"), F.lit(")"))).otherwise(whole)
    return F.when(F.coalesce(no, F.lit("")) == "", F.lit("Phần mở đầu")).otherwise(whole)
