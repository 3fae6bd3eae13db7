"""From ranked hits to prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

SEPARATOR = "\n\n---\n\n"
#: The strings of source blocks and prompts.
CHAPTER_INDENT = "    "
EXPIRED_BANNER, EXPIRED_END, NO_DATE = "    ⚠️ [ĐÃ HẾT HIỆU LỰC — ", "]", "không rõ ngày"
QA_HEAD, QA_END, NO_AREA = "Hỏi đáp pháp luật (", ") — ", "chung"
TERM_HEAD = "Thuật ngữ pháp lý: "
NO_TEXT = "    (chỉ có thông tin định danh, chưa có toàn văn trong cơ sở dữ liệu)"
SOURCES_HEAD, QUESTION_HEAD = "NGUỒN THAM KHẢO:\n\n", "\n\n" + "=" * 60 + "\n\nCÂU HỎI: "
CITE = "\n\nTrả lời dựa trên các nguồn trên, kèm số trích dẫn [n]."
PLAIN_QUESTION = "Câu hỏi: "
NOTHING_FOUND = (
    "\n\nKhông tìm thấy nguồn nào liên quan trong cơ sở dữ liệu. Hãy nói rõ điều đó với người dùng và gợi ý cách đặt câu hỏi cụ thể hơn "
    "(nêu tên luật, lĩnh vực, hoặc tình huống chi tiết). Không được tự suy đoán quy định."
)


def format_source(pos: Column, kind: Column, title: Column, label: Column, text: Column, doc_type: Column, number: Column, chapter: Column, expired: Column, status: Column, area: Column) -> Column:
    """One numbered source block of a prompt."""
    head = F.concat(F.lit("["), pos.cast("string"), F.lit("] "))
    some = lambda *c: F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in c])
    body = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\n{2,}", "\n")
    banner = F.concat(F.lit(EXPIRED_BANNER), F.coalesce(F.nullif(status, F.lit("")), F.lit(NO_DATE)), F.lit(EXPIRED_END))
    chunk = F.concat_ws(
        "\n",
        strip(F.concat(head, some(doc_type, number), F.lit(" — "), title)),
        F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(F.lit(CHAPTER_INDENT), chapter)),
        F.when(F.coalesce(expired, F.lit(0)) != 0, banner),
        body,
    )
    qa = F.concat(head, F.lit(QA_HEAD), F.coalesce(F.nullif(area, F.lit("")), F.lit(NO_AREA)), F.lit(QA_END), title, F.lit("\n"), body)
    term = F.concat(head, F.lit(TERM_HEAD), title, F.lit("\n"), body)
    doc = F.concat_ws("\n", F.concat(head, some(label, number), F.lit(" — "), title), F.lit(NO_TEXT), body)
    return F.when(kind == "chunk", chunk).when(kind == "qa", qa).when(kind == "term", term).otherwise(doc)


def pack(blocks: DataFrame, most: int = 24_000, by: str = "qid", pos: str = "pos", block: str = "block") -> DataFrame:
    """The blocks of each query's context: up to the first that would exceed ``most`` characters; the first always."""
    run = F.sum(F.char_length(block)).over(Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy(by).orderBy(pos))
    return blocks.withColumns({"used": run, "__n": first}).filter((F.col("used") <= most) | (F.col("__n") == 1)).drop("__n")


def join_blocks(packed: DataFrame, by: str = "qid", pos: str = "pos", block: str = "block") -> DataFrame:
    """One context per query."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(block).alias("b"))))
    return packed.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), SEPARATOR).alias("context"), F.count("*").alias("n_sources"))


def history(turns: DataFrame, last: int = 4, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Of the last ``last`` turns of each conversation those of user and assistant that say something, cut at 2000 characters."""
    r = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    kept = turns.withColumn("__r", r).filter(F.col("__r") <= last).filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return kept.withColumn("text", F.substring("text", 1, 2000)).drop("__r")


def prompt(question: Column, context: Column) -> Column:
    """The user message with its sources, or the one that says there are none."""
    found = F.concat(F.lit(SOURCES_HEAD), context, F.lit(QUESTION_HEAD), question, F.lit(CITE))
    none = F.concat(F.lit(PLAIN_QUESTION), question, F.lit(NOTHING_FOUND))
    return F.when(F.coalesce(context, F.lit("")) == "", none).otherwise(found)


def messages(system: str, past: Column, question: Column, context: Column) -> Column:
    """Array of (role, content): system, the turns of ``past`` (an array of the same type), the user's prompt."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.array(say("system", F.lit(system))), F.coalesce(past, empty), F.array(say("user", prompt(question, context))))


def citations(answer: Column, n_sources: Column) -> Column:
    """Distinct source numbers that an answer cites and has."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n_sources))))


def parse_stream(lines: DataFrame, line: str = "line", order: str = "n", stream: str = "stream") -> DataFrame:
    """stream, order, content of NDJSON model output: blank and broken lines skipped, nothing of a stream after its first line that says done.
    Lines without a column ``stream`` are one stream."""
    if stream not in lines.columns:
        lines = lines.withColumn(stream, F.lit(0))
    got = F.from_json(F.col(line), "message struct<content:string>, done boolean")
    rows = lines.withColumn("__j", got).filter(F.trim(line) != "")
    rows = rows.withColumn("__done", F.coalesce(F.col("__j.done"), F.lit(False)).cast("int"))
    over = F.coalesce(F.sum("__done").over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__over", over).filter("__over = 0")
    return rows.select(stream, order, F.col("__j.message.content").alias("content")).filter(F.coalesce("content", F.lit("")) != "")
