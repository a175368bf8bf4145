"""Text and scalar functions as Columns.

White space is the Unicode set (Java's ``(?U)\\s``): U+0085, U+00A0, U+2003 and
U+3000 count, U+200B and U+FEFF do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utrim(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def fold(c: Column) -> Column:
    """Trimmed, in lower case: how a probe is normalised."""
    return F.lower(utrim(c))


def dictionary_form(c: Column) -> Column:
    """Trimmed, in lower case, without white space: how a dictionary entry is normalised."""
    return squash(fold(c))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (utrim(c) == "")


def is_empty(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")


def joined_tail(tokens: Column, start: int) -> Column:
    """The tokens from position ``start`` (1-based) on, each trimmed, joined without separator."""
    return F.array_join(F.transform(F.slice(tokens, start, F.greatest(F.size(tokens), F.lit(0)) + 1), utrim), "")


def listed(values: Column) -> Column:
    """An ordered list as text."""
    return F.array_join(values, ", ")


def fixed(c: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, point as decimal mark."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def accuracy_text(score: Column) -> Column:
    return F.concat(F.lit("Accuracy: "), fixed(score * 100, 2), F.lit("%"))


def result_text(qr: Column, code: Column, size: Column, color: Column) -> Column:
    """Four lines, CRLF between them."""
    names = ("QR", "Mã áo", "Size áo", "Màu áo")
    return F.concat_ws("\r\n", *[F.concat(F.lit(f'{n}: "'), F.coalesce(v, F.lit("")), F.lit('"')) for n, v in zip(names, (qr, code, size, color))])


def debug_text(blocks: Column) -> Column:
    """One CRLF-ended line for each block (text, score) in order, blank ones included."""
    line = lambda b: F.concat(F.coalesce(utrim(b["text"]), F.lit("")), F.lit(" | Score: "), fixed(b["score"] * 100, 2), F.lit("%\r\n"))
    return F.array_join(F.transform(blocks, line), "")


def fps(ms: Column) -> Column:
    """Frames a second from whole milliseconds; 0 if none has passed."""
    return F.when(ms > 0, F.lit(1000.0) / ms).otherwise(F.lit(0.0))
