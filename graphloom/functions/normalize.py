"""Spellings of ids, kinds and paths, brought to one form. A null or blank value becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space at either end of a value.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u200b"


def trimmed(c: Column | str) -> Column:
    """The value without white space at its ends; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    last = F.substring(c, -1, 1)
    clean = (c >= F.lit("!")) & (c < F.lit("\x7f")) & (last >= F.lit("!")) & (last < F.lit("\x7f"))
    # Nearly all values begin and end with a visible ASCII character, which is cheaper to see than to trim.
    return F.when(clean, c).otherwise(F.nullif(F.btrim(c, F.lit(WHITE)), F.lit("")))


def clean_id(c: Column | str) -> Column:
    return F.lower(trimmed(c))


def clean_kind(c: Column | str) -> Column:
    return F.upper(trimmed(c))


def clean_path(c: Column | str) -> Column:
    """Forward slashes, no leading ``./``; case is kept. A blank path is null, white space inside stays."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(trimmed(c).isNotNull(), F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", ""))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone (or in UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def packed_id(c: Column) -> Column:
    """A cleaned id as bytes: a marker, then 12 bytes for 24 hex digits, else the UTF-8 bytes."""
    digits = F.when(F.length(c) == 24, F.concat(F.lit(b"\x01"), F.unhex(c)))  # unhex of anything else is null
    return F.coalesce(digits, F.concat(F.lit(b"\x00"), c.cast("binary")))


def unpacked_id(c: Column) -> Column:
    """The inverse of packed_id."""
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
