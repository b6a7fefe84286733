"""Lengths, offsets and slices in UTF-16 code units, the position unit of document trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that trimming removes at both ends of a text.
BLANKS_TEXT = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as a class of a pattern.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def u16_len(text: Column) -> Column:
    """Code units of a text; NULL for NULL.  ASCII texts need no encoding to tell."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(
        (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    )


def u16_slice(text: Column, start: Column, end: Column) -> Column:
    """Units [start, end) of a text, both clamped to it.

    A cut inside a surrogate pair gives U+FFFD for the half that remains, as a lone surrogate cannot be
    held in a Spark string.
    """
    start = F.greatest(start, F.lit(0))
    end = F.greatest(end, start)
    units = F.encode(text, "UTF-16BE")
    wide = F.decode(F.substring(units, (start * 2 + 1).cast("int"), ((end - start) * 2).cast("int")), "UTF-16BE")
    return F.when(u16_len(text) == F.length(text), F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(wide)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+\\z", "")


def strip_line_ends(text: Column) -> Column:
    """Without the blanks and tabs before line ends."""
    return F.regexp_replace(text, "[ \\t]+(?=[\\n\\r\\u2028\\u2029]|\\z)", "")


def py_len(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def py_slice(text: str, start: int, end: int | None = None) -> str:
    if text.isascii():
        return text[max(start, 0) : end]
    raw = text.encode("utf-16-le", "surrogatepass")
    return raw[2 * max(start, 0) : None if end is None else 2 * end].decode("utf-16-le", "surrogatepass")
