"""Text column expressions: cleaning, previews and the "is there anything to send" predicates.

All are plain Catalyst expressions, so they stay inside whole-stage codegen
and are pushed through projections like any built-in.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Python's str.strip() whitespace set, written as one regex class that Java and RE2 both read.
WS_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP_PATTERN = rf"\A{WS_CLASS}+|{WS_CLASS}+\z"
# the same set as plain characters, for btrim (scans only the two ends of the string)
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Remove leading/trailing whitespace exactly as Python ``str.strip()`` does."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def clean_text(c: str | Column) -> Column:
    """NULL -> ''; strip; one left-to-right pass of 3 newlines -> 2; tab -> space."""
    s = py_strip(F.coalesce(_col(c).cast("string"), F.lit("")))
    s = F.replace(s, F.lit("\n\n\n"), F.lit("\n\n"))
    return F.replace(s, F.lit("\t"), F.lit(" "))


def has_data(c: str | Column) -> Column:
    """Not NULL and not blank after cleaning (the replaces never change blankness, so only strip is needed)."""
    return _col(c).isNotNull() & (py_strip(_col(c).cast("string")) != F.lit(""))


def has_any_data(cols: Sequence[str | Column]) -> Column:
    """True when any of the columns holds a non-blank value."""
    preds = [_col(c).isNotNull() & (py_strip(_col(c).cast("string")) != F.lit("")) for c in cols]
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def pending(result_col: str | Column) -> Column:
    """A row still needs an answer: result NULL or empty string."""
    c = _col(result_col)
    return c.isNull() | (c == F.lit(""))


def preview(c: str | Column, n: int, always_ellipsis: bool = True) -> Column:
    """First ``n`` characters + '...'; with ``always_ellipsis=False`` only when cut."""
    s = _col(c).cast("string")
    cut = F.concat(F.substring(s, 1, n), F.lit("..."))
    if always_ellipsis:
        return cut
    return F.when(F.length(s) > n, cut).otherwise(s)


def render_value(c: str | Column) -> Column:
    """A column value as prompt text; NULL renders as 'N/A'."""
    return F.coalesce(_col(c).cast("string"), F.lit(fixed.MISSING_VALUE))


def as_item(cols: Sequence[str], row: Column | None = None) -> Column:
    """Row -> ordered array<struct<name, value>> of the selected columns (value as text).
    With ``row`` the values are read from that struct column instead of the frame."""
    get = (lambda c: row[c]) if row is not None else F.col
    return F.array(*[F.named_struct(F.lit("name"), F.lit(c), F.lit("value"), render_value(get(c))) for c in cols])


def tag_no_data(flag: Column) -> Column:
    """Status for rows that have nothing to send."""
    return F.when(~flag, F.lit("NO_DATA"))
