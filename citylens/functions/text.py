"""Text cleaning, numeric text, labels and natural ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str) -> Column:
    """Strip white space of any kind at both ends and upper-case; a missing value stays missing."""
    return F.upper(F.btrim(_c(value), F.lit(" \t\n\r\f\v")))


def without_commas(value: Column | str) -> Column:
    return F.replace(_c(value), F.lit(","), F.lit(""))


def cast_commas(value: Column | str, dtype: str = "double") -> Column:
    """``"1,234.5"`` to a number; bad text raises."""
    return without_commas(value).cast(dtype)


def text_to_int(value: Column | str) -> Column:
    """Numeric text to the nearest int (halves away from zero); anything else gives NULL."""
    # a decimal cast takes plain and exponent notation only, where a double would also read "1d" or "NaN"
    return F.round(_c(value).try_cast("decimal(38,18)")).try_cast("int")


def try_int_commas(value: Column | str) -> Column:
    """``"1,234"`` to int, NULL when it is not a number."""
    return text_to_int(without_commas(value))


def split_index(value: Column | str, separator: str, n: int) -> Column:
    """The n-th piece (from 1) of a literal-separated text, NULL when there are fewer."""
    pieces = F.split(_c(value), "\\Q" + separator + "\\E")
    return F.try_element_at(pieces, F.lit(n))


def pad2(value: Column | str) -> Column:
    """Two digits with leading zero; longer numbers are kept whole."""
    text = _c(value).cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def thousands(value: Column | str) -> Column:
    """Whole part with thousands separators, fraction cut off (not rounded)."""
    return F.format_number(_c(value).cast("bigint"), 0)


def natural_name(value: Column | str) -> Column:
    """First sort key of a region label: the borough of a board, else the label itself."""
    text = _c(value)
    borough = F.regexp_extract(text, r"^(\w+) Community Board (\d+)", 1)
    return F.when(borough != "", borough).otherwise(text)


def natural_number(value: Column | str) -> Column:
    """Second sort key of a region label: the board number, 0 for anything else."""
    digits = F.regexp_extract(_c(value), r"^(\w+) Community Board (\d+)", 2)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def natural_order(value: Column | str) -> list[Column]:
    """Sort keys placing board 2 before board 10."""
    return [natural_name(value).asc_nulls_last(), natural_number(value)]
