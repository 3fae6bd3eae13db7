"""Quality rules as a short-circuit cascade.

Every rule's cost (seconds, the measure that it needs included) and selectivity (share of rows that it
rejects) are estimated on a bounded sample; the cascade then asks the rules in the order of
rejection per cost and stops at the first that rejects. The order decides how much is
computed, never which documents are kept. ``cascade`` returns the measures of every row and so computes
them for all; ``judge`` returns the verdict alone, and there a measure is computed only where
a rule that needs it is reached.

The sample is the first ``SAMPLE_ROWS`` rows of a single reader that stops there, so it moves no more
rows however many partitions there are; it is asked ``TIMES`` times over, so that a rule's time stands out from the job's own.

Cases: a null text has no words; an empty or short text fails the base rule; ties and
repeated rows are judged row by row; a very long text is measured whole, in memory linear in its
length; an empty table gives an empty result and the rules
keep the order in which they are written; other columns of the input stay as they are
(columns of the same names as the added ones are replaced).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.llm.words import GAP, words
from tessera.runtime import cut

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The bounds of the estimate's sample: rows, files that they come from, how often they are asked.
SAMPLE_ROWS, SAMPLE_FILES, TIMES = 500, 16, 8


@dataclass(frozen=True)
class Given:
    """What a rule can ask of a row: its text and measures, as columns."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column
    n_lines: Column

    def count(self, pattern: str, *needs: str) -> Column:
        """Matches in the text; a text without any of ``needs`` has none."""
        found = F.regexp_count(self.text, F.lit(pattern))
        some = [F.contains(self.text, F.lit(x)) for x in needs]
        for c in some[1:]:
            some[0] |= c
        return F.when(some[0], found).otherwise(0) if some else found

    def chars(self, kind: str) -> Column:
        """Characters of a Unicode class."""
        return F.char_length(F.regexp_replace(self.text, rf"\P{{{kind}}}+", ""))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a Boolean column, never null, over what is given of a row."""

    name: str
    rejects: Callable[[Given], Column]


#: Thresholds are ratios as whole numbers, so that every engine agrees on the edges.
RULES: tuple[Rule, ...] = (
    Rule("word_length", lambda g: (g.word_chars < 2 * g.n_words) | (g.word_chars > 15 * g.n_words)),
    Rule("symbols", lambda g: 10 * g.n_symbols > g.n_words),
    Rule("repeat_words", lambda g: 100 * g.n_repeat_words > 30 * g.n_words),
    Rule("dup_lines", lambda g: (g.n_dup_lines > 3) & (100 * g.n_dup_lines > 30 * g.n_lines)),
    Rule("shouting", lambda g: 100 * g.chars("Lu") > 50 * g.chars("L")),
    Rule("few_letters", lambda g: 2 * g.chars("L") < g.word_chars),
    Rule("bullets", lambda g: 100 * g.count(r"(?m)^[\x20\x09]*[-*•]\x20", "- ", "* ", "• ") > 90 * g.n_lines),
    Rule("ellipsis", lambda g: 100 * g.count(r"(?m)(\.\.\.|…)[\x20\x09]*$", "...", "…") > 30 * g.n_lines),
)


def _lines(text: Column) -> Column:
    """Lines with a word in them."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def _windows(ws: Column) -> Column:
    """A hash of each 3-word window."""
    at = F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) >= 3, at).otherwise(F.array().cast("array<bigint>"))


def _sorted(h: Column) -> Column:
    """Windows with their places by hash; null if none is found twice: only other texts pay for the sort."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _places(s: Column) -> Column:
    """The places of windows found twice or more."""
    same = lambda p, k: p["h"].eqNullSafe(F.get(s, k)["h"])
    return F.sort_array(F.transform(F.filter(s, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))


def _covered(p: Column) -> Column:
    """How many words the windows at these places cover."""
    each = F.transform(p, lambda at, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - at), F.lit(3)))
    return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")


def _word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, GAP, "")).cast("long")


def _symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def _dup(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five measures. Each text is cut into words once; the window part stays
    inside the row (hash of each 3-word window, sort, neighbours), so nothing shuffles."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*MEASURES).withColumns({"__ws": words(F.col(text)), "__l": _lines(t)})
    out = out.withColumns({"n_words": F.size("__ws").cast("long"), "__h": _windows(F.col("__ws"))}).drop("__ws")
    out = out.withColumn("__s", _sorted(F.col("__h"))).drop("__h")
    out = out.withColumn("__p", _places(F.col("__s"))).drop("__s")
    return out.withColumns({
        "n_repeat_words": _covered(F.col("__p")),
        "word_chars": _word_chars(t),
        "n_symbols": _symbols(t),
        "n_dup_lines": _dup(F.col("__l")),
    }).drop("__p", "__l")


def given(text: str = "text") -> Given:
    """Over rows with their measures as columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    return Given(t, *[F.col(m) for m in MEASURES], F.size(_lines(t)))


def inline(text: str = "text") -> Given:
    """Over rows without measures: each is worked out where it is asked."""
    t = F.coalesce(F.col(text), F.lit(""))
    n_words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    repeat = let(words(t), lambda ws: let(_windows(ws), lambda h: let(_sorted(h), lambda s: let(_places(s), _covered))))
    return Given(t, n_words, _word_chars(t), _symbols(t), let(_lines(t), _dup), repeat, F.size(_lines(t)))


def base_failed(g: Given) -> Column:
    return (g.n_words < 50) | (100 * g.n_repeat_words > 50 * g.n_words)


def estimate(sample: DataFrame, rules: Sequence[Rule], text: str = "text", times: int = TIMES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a bounded sample, each rule with the measures that it needs."""
    rows = cut(sample.select(text))
    n = rows.count() * times
    asked = rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times))))
    g = inline(text)

    def run(c: Column) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            rejected = asked.agg(F.sum(c.cast("long")).alias("n")).first()["n"] or 0
            best = min(best, time.perf_counter() - began)
        return best, rejected

    # What the job, the reading and the rows themselves take.
    floor, _ = run(F.char_length(g.text) >= 0)
    found = []
    for rule in rules if n else ():
        took, rejected = run(rule.rejects(g))
        found.append((rule, max(took - floor, 1e-4), rejected / n))
    return found or [(rule, 1.0, 0.0) for rule in rules]


def order_rules(estimates: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejection per second first; ties as written."""
    return [r for r, _, _ in sorted(estimates, key=lambda e: -e[2] / e[1])]


def first_rows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample by one reader that stops when it has the rows: nothing is moved to cut it."""
    return docs.coalesce(1).limit(rows)


def _verdict(g: Given, base: Callable[[Given], Column], ordered: Sequence[Rule]) -> Column:
    out = F.when(base(g), F.lit("base"))
    for rule in ordered:
        out = out.when(rule.rejects(g), F.lit(rule.name))
    return out


def _ordered(docs: DataFrame, text: str, rules: Sequence[Rule], sample: DataFrame | None, sample_rows: int) -> list[Rule]:
    return order_rules(estimate(first_rows((docs if sample is None else sample).select(text), sample_rows), rules, text))


def cascade(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, base: Callable[[Given], Column] = base_failed, sample: DataFrame | None = None
) -> DataFrame:
    """``docs`` with the measures, base_failed, kept and rejected_by.

    ``sample_rows`` bounds the sample of the cost estimate (from ``sample``, by default ``docs``) and nothing else.
    ``rejected_by`` names the first rule of the cascade that rejected: of several that
    would, which one depends on the measured order.
    """
    ordered, g = _ordered(docs, text, rules, sample, sample_rows), given(text)
    out = measure(docs, text).withColumns({"base_failed": base(g), "rejected_by": _verdict(g, base, ordered)})
    return out.withColumn("kept", F.col("rejected_by").isNull())


def judge(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, base: Callable[[Given], Column] = base_failed, sample: DataFrame | None = None
) -> DataFrame:
    """``docs`` with kept and rejected_by alone: behind the first rule that rejects nothing more is computed."""
    ordered = _ordered(docs, text, rules, sample, sample_rows)
    out = docs.withColumn("rejected_by", _verdict(inline(text), base, ordered))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def some_files(spark, docs: DataFrame, most: int = SAMPLE_FILES) -> DataFrame:
    """The rows of a bounded number of a Parquet table's files, those of the smallest hash."""
    files = docs.inputFiles()
    if len(files) <= most:
        return docs
    return spark.read.schema(docs.schema).parquet(*sorted(files, key=lambda f: hashlib.sha256(f.encode()).digest())[:most])


def op6_quality_rules(spark, sf_dir):
    """Quality verdict of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cascade(docs, sample=some_files(spark, docs)).select("doc_id", *MEASURES, "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i,
         unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g
  FROM w WHERE len(ws) >= 3),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (
  SELECT d.doc_id, d.t, len(w.ws) AS n_words,
         length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l.ls) - len(list_distinct(l.ls)) AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l.ls) AS n_lines,
         len(regexp_extract_all(d.t, '\p{Lu}')) AS lu, len(regexp_extract_all(d.t, '\p{L}')) AS lt,
         len(regexp_extract_all(d.t, '(?m)^[\x20\x09]*[-*\x{2022}]\x20')) AS bl,
         len(regexp_extract_all(d.t, '(?m)(\.\.\.|\x{2026})[\x20\x09]*$')) AS el
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_repeat_words > 30 * n_words OR (n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * lu > 50 * lt
            OR 2 * lt < word_chars OR 100 * bl > 90 * n_lines OR 100 * el > 30 * n_lines) AS kept
FROM b
"""
