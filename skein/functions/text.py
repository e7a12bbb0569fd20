"""Line splitting and whitespace stripping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python treats as whitespace and as line ends.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NEWLINE = r"\n"
TEXT_MODE_NEWLINE = r"\r\n|\n|\r"
UNICODE_NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def right_strip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_lines(text: Column, line_end: str = NEWLINE) -> Column:
    """Lines of ``text``; a line end after the last line opens no further line."""
    parts = F.split(text, line_end, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column, line_end: str = NEWLINE) -> Column:
    parts = F.split(text, line_end, -1)
    return F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)


def line_blocks(text: Column, size: int) -> Column:
    """``text`` cut after every ``size`` lines, whichever of ``TEXT_MODE_NEWLINE`` ends them; an empty text has no block."""
    ended = F.when(text.rlike(r"[\r\n]\z"), text).otherwise(F.concat(text, F.lit("\n")))
    # possessive, so a line of any length is matched without going back
    blocks = F.regexp_extract_all(ended, F.lit(r"(?:[^\r\n]*+(?:\r\n?+|\n)){1,%d}+" % size), F.lit(0))
    return F.when(text != "", blocks)


def decode_utf8(content: Column) -> Column:
    """Bytes to text; each malformed sequence becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))
