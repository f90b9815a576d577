"""Strings: ASCII-only case, white space of six kinds, literal search and replacement."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f\x0B]+"


def trim(s: Column) -> Column:
    return rtrim(ltrim(s))


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, "^" + BLANK, "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, BLANK + r"\z", "")


def ascii_upper(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def ascii_lower(s: Column) -> Column:
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def substring(s: Column, start: Column, length: Column) -> Column:
    """1-based; a start under 1 is 1, a negative length is an empty string."""
    return s.substr(F.greatest(start, F.lit(1)), F.greatest(length, F.lit(0)))


def full_match(s: Column, pattern: str) -> Column:
    """Whether the whole string matches."""
    return s.rlike(rf"\A(?:{pattern})\z")


def substitute(s: Column, pattern: str, to: str) -> Column:
    """All matches replaced; groups in the replacement are written \\1 to \\9."""
    import re

    return F.regexp_replace(s, pattern, re.sub(r"\\([1-9])", r"$\1", to))
