"""Column -> Column text helpers for cleaning source rows.

All built-in expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

# Fixed values (must equal the reference for identical results) -----------------
# Delimiters between a client name and its job site: ":" and "--".
CLIENT_CUT_PATTERN = r":.*|--.*"
JOB_SITE_PATTERN = r".*?:|.*?--"
# Bill-to names starting (ignoring case) with one of these collapse to it.
DEFAULT_ROLLUP_PREFIXES = ("Dart Entities",)
# ------------------------------------------------------------------------------

# The characters the source's Trim() removes (Unicode white space:
# U+0009-U+000D, U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000). Trimming by character set needs no regex.
WS_CHARS = ("\t\n\u000b\u000c\r \u0085\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Trim every kind of white space (Spark ``trim`` strips only U+0020)."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    """Null, empty or white space only. (Only text whose first byte is no visible ASCII character is trimmed: other text is not blank.)"""
    c = col_(c).cast("string")
    return c.isNull() | (((c < "!") | (c > "~")) & (F.length(trim_ws(c)) == 0))


def text_cell(c) -> Column:
    """A spreadsheet text cell: null reads as empty, then trimmed."""
    return trim_ws(F.coalesce(col_(c).cast("string"), F.lit("")))


def _has_delimiter(c: Column) -> Column:
    return (F.instr(c, ":") > 0) | (F.instr(c, "--") > 0)


def clean_client_name(c) -> Column:
    """Cut the client name at the first ':' or '--', then trim.
    (Names without a delimiter skip the regex: it would return them unchanged.)"""
    c = col_(c)
    return trim_ws(F.when(_has_delimiter(c), F.regexp_replace(c, CLIENT_CUT_PATTERN, "")).otherwise(c))


def job_site(c) -> Column:
    """Text after the last delimiter; the whole name when there is none."""
    c = col_(c)
    return trim_ws(F.when(_has_delimiter(c), F.regexp_replace(c, JOB_SITE_PATTERN, "")).otherwise(c))


def full_name(first, last) -> Column:
    """A10: ``first + ' ' + last`` of trimmed parts; the result is not trimmed."""
    return F.concat(text_cell(first), F.lit(" "), text_cell(last))


def rollup_prefix(c, prefixes=DEFAULT_ROLLUP_PREFIXES) -> Column:
    """Values starting (case-insensitively) with a prefix become the prefix."""
    c = col_(c)
    out = c
    for p in reversed(list(prefixes)):
        out = F.when(F.lower(c).startswith(p.lower()), F.lit(p)).otherwise(out)
    return out


def previous_sunday(d) -> Column:
    """Most recent Sunday on or before the date (``dayofweek``: Sunday = 1)."""
    d = col_(d)
    return F.date_sub(d, F.dayofweek(d) - 1)


def money(c, dtype=None) -> Column:
    """Parse a money cell to DECIMAL(18,2), thousands separators allowed; unparsable -> NULL (row is then dropped).
    A numeric source column is cast directly (no text round trip)."""
    if dtype is not None and isinstance(dtype, NumericType):
        return col_(c).try_cast("decimal(18,2)")
    text = col_(c).cast("string")
    # plain numbers are cast as they stand; only what is left is trimmed and freed from separators
    return F.coalesce(text.try_cast("decimal(18,2)"), F.replace(trim_ws(text), F.lit(","), F.lit("")).try_cast("decimal(18,2)"))


#: text dates besides ISO, as the source's culture writes them
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a")


def try_date(c, dtype=None, formats=DATE_FORMATS) -> Column:
    """A date cell; date/timestamp sources are used as they are, text is parsed (ISO first, then ``formats``)."""
    if dtype is not None and isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return col_(c).cast("date")
    text = trim_ws(col_(c).cast("string"))
    return F.coalesce(text.try_cast("date"), *[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def format_n2(c) -> Column:
    """en-US ``N2``: thousands separators, two decimals, leading '-'."""
    return F.format_number(col_(c).cast("decimal(38,2)"), 2)


def format_currency(c) -> Column:
    """en-US currency text ``$1,234.56`` / ``-$1,234.56``."""
    c = col_(c)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"),
                    F.format_number(F.abs(c).cast("decimal(38,2)"), 2))
