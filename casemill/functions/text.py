"""Text expressions: trimming, hashing, joining, masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Personal-data classes in the order they are masked. The order
# decides what bare digit runs become: ten are a phone, nine an SSN, and a run of
# seventeen is a VIN.
PII_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "VIN": r"\b[A-HJ-NPR-Z0-9]{17}\b",
    "SSN": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "CREDIT_CARD": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
}

# Without one of these a text holds none of the classes after EMAIL.
_NUMBER_GATE = r"(?U)\d{3}|[A-HJ-NPR-Z0-9]{17}"

# Python's word boundary, digit and space classes cover all of Unicode.
_UNICODE = "(?U)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def join_text(separator: str, columns: Sequence[Column | str]) -> Column:
    """Join columns; a null leaves its separators in place."""
    return F.concat_ws(separator, *[blank_if_null(c) for c in columns])


def content_hash(subject: Column | str = "subject", description: Column | str = "description") -> Column:
    parts = [trim_unicode(F.lower(blank_if_null(c))) for c in (subject, description)]
    return F.md5(F.concat_ws("\n", *parts).cast("binary"))


def mask_pii(c: Column | str) -> Column:
    """Replace every personal-data match by its class name in brackets.

    Most texts hold no ``@`` and no long digit run, so two cheap gates decide which
    of the patterns run. Both are read from the unmasked text: a mask adds neither
    digits nor long runs, so a text closed at the gate stays without a match.
    """
    text = _col(c)
    has_at = F.contains(text, F.lit("@"))
    has_number = text.rlike(_NUMBER_GATE)
    without_email = _mask(text, "EMAIL")
    numbers = F.when(has_at, without_email).otherwise(text)
    for name in list(PII_PATTERNS)[1:]:
        numbers = _mask(numbers, name)
    return F.when(has_number, numbers).when(has_at, without_email).otherwise(text)


def _mask(text: Column, name: str) -> Column:
    return F.regexp_replace(text, _UNICODE + PII_PATTERNS[name], f"[{name}]")


def count_pii(c: Column | str, name: str) -> Column:
    return F.regexp_count(_col(c), F.lit(_UNICODE + PII_PATTERNS[name])).cast("bigint")


def truncate(c: Column | str, length: int) -> Column:
    text = _col(c)
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def words(c: Column | str, min_length: int = 2) -> Column:
    """Lower-cased word tokens in order."""
    pattern = rf"(?U)\w{{{min_length},}}"
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), F.lit(0))


def preferred(df: DataFrame, name: str) -> Column:
    """``name``'s redacted form if the table has it, else the raw column, else ''."""
    for candidate in (f"{name}_redacted", name):
        if candidate in df.columns:
            return F.col(candidate)
    return F.lit("")


def composite_text(df: DataFrame) -> Column:
    """Subject and description on two lines, trimmed."""
    return trim_unicode(join_text("\n", [preferred(df, "subject"), preferred(df, "description")]))
