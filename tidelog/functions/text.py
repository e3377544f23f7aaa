"""Scalar string functions (JVM side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.isspace() accepts, which str.strip()
# removes: U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_SPACE_CLASS = ("[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  "\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# The same code points as a plain character set, for btrim.
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")

# The universal newline split used by text files.
LINE_BREAK_RX = "\r\n|\r|\n"

# Ellipsis forms of the two previews.
PREVIEW_LONG = (100, 98, " … ")   # over 100 chars: first 98 + " … "
PREVIEW_SHORT = (80, 79, "…")     # over 80 chars: first 79 + "…"
MASK_PREFIX = "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxx"


def py_strip(c: Column) -> Column:
    """``str.strip()`` with Python's whitespace set (``trim`` strips spaces
    only).  ``btrim`` with a character set looks at the two ends only."""
    return F.btrim(c, F.lit(PY_SPACE_CHARS))


def split_lines(c: Column) -> Column:
    """Split text into lines on ``\\r\\n``, ``\\r`` or ``\\n``."""
    return F.split(c, LINE_BREAK_RX)


def mask_secret(c: Column) -> Column:
    """Every character but ``-`` becomes ``x``; null or empty gives ``'None'``."""
    m = F.regexp_replace(c, "[^-]", "x")
    return F.when(F.coalesce(F.length(m), F.lit(0)) > 0, m).otherwise(F.lit("None"))


def mask_keep_last4(c: Column, prefix: str = MASK_PREFIX) -> Column:
    """Fixed mask followed by the last four characters."""
    return F.concat(F.lit(prefix), F.substring(c, -4, 4))


def preview(c: Column, form: str = "long") -> Column:
    """Shorten a string for a log line: the two forms of the reference."""
    limit, keep, tail = PREVIEW_LONG if form == "long" else PREVIEW_SHORT
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(tail))).otherwise(c)


def normalise_collector_url(c: Column) -> Column:
    """Drop one trailing ``/`` from a collector URL."""
    return F.regexp_replace(c, "/$", "")


def normalise_file_target(c: Column, base_dir: str = "/tmp/") -> Column:
    """``file://`` prefix removed; a relative path is put under ``base_dir``."""
    p = F.regexp_replace(c, "^file://", "")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base_dir), p))
