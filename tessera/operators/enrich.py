"""Metadata from preambles: numbers, titles, years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import squeeze, strip, strip_marks

#: Patterns of numbers, dates, kinds and the ends of titles.
NUMBER_LINE = r"(?iuU)\bSố:?\s*([0-9][^\n]{0,60})"
FULL = r"(?U)^\s*([0-9]+[a-zA-Z]?)\s*/\s*([0-9]{2,4})\s*/\s*(\S.*)$"
SHORT = r"(?U)^\s*([0-9]+[a-zA-Z]?)\s*([/-])\s*([A-ZĐ]\S*)$"
TITLE_END = r"(?iuU)\b(?:Căn\s+cứ|Theo\s+đề\s+nghị|Xét\s+đề\s+nghị|Để\s+thực\s+hiện|QUYẾT\s+ĐỊNH:|Điều\s+1\s*\.)"
DATE_LINE = r"(?iuU)ngày\s+\d{1,2}\s*\n?\s*tháng\s+\d{1,2}\s+năm\s+\d{4}"
KINDS = (
    r"(?iuU)^\s*(?:LUẬT|BỘ\s*LUẬT|PHÁP\s*LỆNH|NGHỊ\s*ĐỊNH|NGHỊ\s*QUYẾT|THÔNG\s*TƯ(?:\s*LIÊN\s*TỊCH)?|QUYẾT\s*ĐỊNH|CHỈ\s*THỊ|HIẾN\s*PHÁP|SẮC\s*LỆNH|"
    r"VĂN\s*BẢN\s*HỢP\s*NHẤT|LỆNH|THÔNG\s*BÁO|CÔNG\s*VĂN|QUY\s*CHẾ|QUY\s*ĐỊNH)\s*$"
)
HALF_WORDS = ("TƯ", "ĐỊNH", "QUYẾT", "LỆNH", "PHÁP", "LUẬT", "THỊ", "NHẤT", "SỰ")
NOT_TITLES = ("số:", "so:", "căn cứ", "quốc hội", "chính phủ")
NOT_IN_HEAD = ("hà nội, ngày", "độc lập - tự do")
PROPER = (
    "Việt Nam", "Chính phủ", "Quốc hội", "Thủ tướng", "Nhà nước", "Hiến pháp", "Bộ luật", "Luật", "Nghị định", "Thông tư",
    "Nghị quyết", "Pháp lệnh", "Quyết định", "Chỉ thị", "Hà Nội", "Trung ương",
)
JOINT = ("TTLT", "TTLB", "NQLT")


def trim_suffix(rest: Column) -> Column:
    """The agency code: of the first word two dash groups (four of joint texts) within 24 characters."""
    word = F.when(strip(rest) == "", rest).otherwise(F.split(strip(rest), r"(?U)\s+", 2)[0])
    groups = F.filter(F.split(word, "-", -1), lambda g: g != "")
    first = F.upper(F.get(groups, F.lit(0)))
    joint = F.lit(False)
    for j in JOINT:
        joint = joint | F.startswith(first, F.lit(j))
    few = F.slice(groups, F.lit(1), F.when(joint, F.lit(4)).otherwise(F.lit(2)))
    # Prefixes grow, so those within the limit are the first ones.
    kept = F.filter(F.transform(few, lambda g, i: F.array_join(F.slice(few, F.lit(1), i + 1), "-")), lambda p: F.char_length(p) <= 24)
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), word)


def clean_number(raw: Column, preamble: Column) -> Column:
    """The document number, from the preamble if it has one, else from the raw one."""
    printed = squeeze(F.regexp_extract(F.coalesce(preamble, F.lit("")), NUMBER_LINE, 1))
    out = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("")).otherwise(F.split(raw, "-", 2)[0])
    for c in (strip(F.coalesce(raw, F.lit(""))), printed):
        full = [F.regexp_extract(c, FULL, i) for i in (1, 2, 3)]
        short = [F.regexp_extract(c, SHORT, i) for i in (1, 2, 3)]
        out = (
            F.when(F.rlike(c, F.lit(FULL)), F.concat(full[0], F.lit("/"), full[1], F.lit("/"), trim_suffix(full[2])))
            .when(F.rlike(c, F.lit(SHORT)), F.concat(short[0], short[1], trim_suffix(short[2])))
            .otherwise(out)
        )
    return out


def capital_share(text: Column) -> Column:
    """Capitals over letters; 0 without letters."""
    letters = F.char_length(F.regexp_replace(text, r"\P{L}", ""))
    return F.when(letters > 0, F.char_length(F.regexp_replace(text, r"\P{Lu}", "")) / letters).otherwise(F.lit(0.0))


def sentence_case(title: Column) -> Column:
    """First letter capital, the rest lower, proper nouns back in capitals (in list order)."""
    out = F.concat(F.upper(F.substring(title, 1, 1)), F.lower(F.substring(title, 2, 1 << 30)))
    for name in PROPER:
        out = F.regexp_replace(out, rf"(?U)\b{name.lower()}\b", name)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))


def extract_title(preamble: Column) -> Column:
    """The title between the kind line (or the date line) and the first end marker; empty if nothing fits."""
    p = F.coalesce(preamble, F.lit(""))
    seg = F.split(p, TITLE_END, 2)[0]
    lines = F.transform(F.split(seg, "\n", -1), strip)
    at = F.array_max(F.transform(lines, lambda x, i: F.when(F.rlike(x, F.lit(KINDS)), i)))
    after = F.slice(lines, at + 2, F.greatest(F.size(lines), F.lit(1)))
    half = F.array(*[F.lit(w) for w in HALF_WORDS])
    wrapped = F.coalesce(F.array_contains(half, F.upper(F.get(after, F.lit(0)))), F.lit(False))
    after = F.when(wrapped, F.slice(after, 2, F.greatest(F.size(after), F.lit(1)))).otherwise(after)
    # After the first date line; the whole segment if there is none.
    dated = F.element_at(F.split(seg, DATE_LINE, 2), -1)
    body = F.when(at.isNotNull(), F.array_join(after, " ")).otherwise(dated)
    title = F.regexp_replace(squeeze(body), r"(?U)^[-–—:.\s]+", "")
    low = F.lower(title)
    bad = (F.char_length(title) < 6) | (F.char_length(title) > 400)
    for s in NOT_TITLES:
        bad = bad | F.startswith(low, F.lit(s))
    for s in NOT_IN_HEAD:
        bad = bad | F.contains(F.substring(low, 1, 120), F.lit(s))
    return F.when(bad, F.lit("")).when(capital_share(title) > 0.7, sentence_case(title)).otherwise(title)


def full_title(doc_type: Column, title: Column) -> Column:
    """The title with its kind in front, once."""
    named = F.concat(doc_type, F.lit(" "), F.lower(F.substring(title, 1, 1)), F.substring(title, 2, 1 << 30))
    plain = (F.coalesce(doc_type, F.lit("")) == "") | F.startswith(strip_marks(title), strip_marks(doc_type)) | (F.char_length(title) <= 1)
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("")).when(plain, title).otherwise(named)


def infer_year(number: Column, issue_date: Column, current: Column) -> Column:
    """The known year, else the one in the number, else the first in the date text."""
    year = lambda text, pattern: F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("")), F.lit("9999")).cast("int")
    return F.coalesce(F.nullif(current.cast("int"), F.lit(0)), year(number, r"^[0-9]+[a-zA-Z]?/((?:19|20)[0-9]{2})/"), year(issue_date, r"(?U)\b((?:19|20)[0-9]{2})\b"))


def enrich(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, title_vi, number_vi, year of the documents (id, doc_number, doc_type, year, issue_date, has_text) with text, from
    their first chunk (doc_id, seq 0, text); what is not found is null."""
    first = chunks.filter("seq = 0").select(F.col("doc_id").alias("id"), F.col("text").alias("__pre"))
    rows = docs.filter("has_text = 1").join(first, "id")
    pre = F.col("__pre")
    number = clean_number(F.col("doc_number"), pre)
    return rows.select(
        "id", F.nullif(full_title(F.col("doc_type"), extract_title(pre)), F.lit("")).alias("title_vi"), F.nullif(number, F.lit("")).alias("number_vi"),
        infer_year(number, F.col("issue_date"), F.col("year")).alias("year"),
    )


def enriched(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``enrich``: titles and numbers as found, years replaced, all by key."""
    for c in ("title_vi", "number_vi"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    return keyed_update(docs, changes, "id", ["title_vi", "number_vi", "year"])


def coverage(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: documents worked on, titles extracted, years filled in that were missing."""
    both = changes.join(docs.select("id", F.col("year").alias("__old")), "id")
    return both.agg(F.count("*").alias("docs"), F.count("title_vi").alias("titles"), F.count_if(F.col("year").isNotNull() & F.col("__old").isNull()).alias("years"))


def keyed_update(docs: DataFrame, changes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``docs`` with ``cols`` taken from ``changes`` (one row per key) where it has the key, nulls included."""
    new = changes.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in cols])
    out = docs.join(new, docs[key] == new["__k"], "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in cols}).select(*docs.columns)
