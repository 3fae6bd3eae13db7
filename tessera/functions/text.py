"""Text functions, Column to Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folding() -> tuple[str, str]:
    """Characters whose lower-cased decomposition is one base letter and marks, and that letter;
    combining marks at the end have no counterpart, so translate drops them."""
    src, dst = [], []
    for lo, hi in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for code in range(lo, hi):
            parts = [c for c in unicodedata.normalize("NFD", chr(code).lower()) if unicodedata.category(c) != "Mn"]
            if len(parts) == 1 and parts[0] != chr(code):
                src.append(chr(code))
                dst.append(parts[0])
    return "".join(src) + "".join(map(chr, range(0x0300, 0x0370))), "".join(dst)


_FROM, _TO = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics, as the index has it (the barred d stays). Only texts with
    other than ASCII characters pay for the translation."""
    low = F.lower(text)
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.translate(low, _FROM, _TO)).otherwise(low)


def strip_marks(text: Column) -> Column:
    """Like ``fold``, and the barred d becomes d: the form for comparing names."""
    return F.replace(fold(F.coalesce(text, F.lit(""))), F.lit("đ"), F.lit("d"))


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits, folded; none for null."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (all kinds, line feeds included)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize(text: Column, compose: bool = True) -> Column:
    """NFC, line ends to LF, blanks and no-break spaces to one space, at most one empty line, stripped.

    Spark has no built-in for NFC: it is an Arrow function, which gets only texts with characters outside
    the blocks that NFC leaves alone, and null for all others.
    """
    t = text
    if compose:
        # One range is looked through some ten times faster than three; most texts end there.
        odd = F.rlike(text, F.lit(r"[^\x{0000}-\x{02FF}]")) & F.rlike(text, F.lit(r"[^\x{0000}-\x{02FF}\x{1E00}-\x{1EFF}\x{2002}-\x{2125}]"))
        t = F.coalesce(_nfc(F.when(odd, text)), text)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, "[ \\t\u00a0]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def query_tokens(text: Column, chars: int = 2000, most: int = 24) -> Column:
    """The first ``most`` tokens of the first ``chars`` characters, in order."""
    return F.slice(tokens(F.substring(text, 1, chars)), 1, most)


def without_stop(toks: Column, stop: Sequence[str]) -> Column:
    """Tokens that are no function words; all of them if nothing else would be left."""
    words = F.array(*[F.lit(w) for w in stop])
    left = F.filter(toks, lambda x: ~F.array_contains(words, x))
    return F.when(F.size(left) == 0, toks).otherwise(left)


def content_key(text: Column) -> Column:
    """Key of near-equal texts: of the first 220 characters in lower case the letters and digits, at most 160; null if none."""
    head = F.regexp_replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 220)), r"[^0-9a-z\x{00e0}-\x{1ef9}]+", "")
    return F.nullif(F.substring(head, 1, 160), F.lit(""))


def asks_year(text: Column) -> Column:
    """Whether a year from 1900 to 2099 stands in the text as a word."""
    return F.coalesce(F.rlike(text, F.lit(r"(?U)\b(19|20)\d\d\b")), F.lit(False))


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def flatten_list(names: Column) -> Column:
    return F.array_join(F.coalesce(names, F.array().cast("array<string>")), ", ")


def expired_flag(status: Column, mark: str) -> Column:
    return F.coalesce(F.startswith(status, F.lit(mark)), F.lit(False)).cast("int")
