"""Word conventions that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The same white space as characters, for translate().
GAP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
