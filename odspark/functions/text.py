"""Text normalisation expressions (JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's ``str.strip()`` removes (``str.isspace``), derived
# from that rule rather than listed; ``trim`` alone removes only U+0020.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c) -> Column:
    """Whitespace strip with the same character set as ``str.strip()``;
    ``btrim`` is a plain scan, no regular expression."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def remove_quotes(c) -> Column:
    return F.replace(_c(c), F.lit('"'), F.lit(""))


# Decimal notation with an optional exponent; type suffixes ('1d', '2f') and
# words (NaN, Infinity) that casts accept are not numbers here.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# The texts a data-frame CSV reader takes as missing by default.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def to_number(c) -> Column:
    """``to_numeric(errors='coerce')``: text that is not a finite decimal
    number becomes NULL (a plain cast raises under ANSI mode)."""
    text = strip(_c(c).cast("string"))
    d = F.when(text.rlike(NUMBER), text).try_cast("double")
    return F.when(F.abs(d) != float("inf"), d)


def missing_to_null(c, tokens=MISSING) -> Column:
    """NULL for the texts that stand for a missing value; others unchanged."""
    return F.when(~_c(c).isin(list(tokens)), _c(c))


def zfill(c, width: int = 5) -> Column:
    """Left-pad with zeros to ``width`` without truncating longer text
    (``lpad`` alone would cut '123456' to '12345')."""
    col = _c(c)
    return F.when(F.length(col) < width, F.lpad(col, width, "0")).otherwise(col)


def strip_first_char(c) -> Column:
    """Drop the first character (the location table carries a junk prefix)."""
    return F.substring(_c(c), 2, 1 << 30)


def date_label(c) -> Column:
    """``yyyyMMdd`` text to ``yyyy-MM-dd`` label."""
    return F.date_format(F.to_date(_c(c), "yyyyMMdd"), "yyyy-MM-dd")
