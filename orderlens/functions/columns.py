"""Text, date, money and ratio expressions. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.schema import BANDS, MONEY, STATUSES

# ASCII words, each with one leading capital, digits and signs; single spaces between.
_WORD = r"(?:[A-Z][a-z]*+(?![A-Z])|[!-@\[-`{-~](?![a-z]))++"
TIDY = rf"^{_WORD}(?: {_WORD})*+\z"
WIDE = "decimal(26,2)"


def dbl(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def or_false(condition: Column) -> Column:
    """A comparison with a missing value counts as not met."""
    return F.coalesce(condition, F.lit(False))


def percent(part: Column | str, whole: Column | str) -> Column:
    """Unrounded percentage; NULL where the whole is zero or missing."""
    return F.try_divide(dbl(part), dbl(whole)) * 100


def ratio2(part: Column | str, whole: Column | str, scale: int = 1) -> Column:
    """``part / whole`` to two decimals, half away from zero, as double.

    The division is one of decimals with twelve digits behind the point: the quotient of
    two doubles would put exact half cents on either side.
    """
    part = (F.col(part) if isinstance(part, str) else part).cast(WIDE) * scale
    whole = (F.col(whole) if isinstance(whole, str) else whole).cast("decimal(22,2)")
    return dbl(F.round(part.cast(WIDE) / F.nullif(whole, F.lit(0).cast("decimal(22,2)")), 2))


def percent2(part: Column | str, whole: Column | str) -> Column:
    return ratio2(part, whole, 100)


def mean2(total: Column | str, count: Column | str) -> Column:
    return ratio2(total, count)


def strip(text: Column) -> Column:
    """Remove any Unicode white space at both ends, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title(text: Column) -> Column:
    """Capitalise a letter after anything that has no case (``o'neil-roy`` -> ``O'Neil-Roy``)."""
    pieces = F.split(F.lower(text), r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def strip_title(text: Column) -> Column:
    """Strip and title-case. Text already in that form, the usual case, costs one match."""
    return F.when(text.rlike(TIDY), text).otherwise(title(strip(text)))


def clean_status(text: Column) -> Column:
    return F.when(text.isin(*STATUSES), text).otherwise(title(strip(text)))


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMM")


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day))


def money(value: Column) -> Column:
    """Two decimals, halves to the even cent."""
    return F.bround(value, 2).cast(MONEY)


def order_margin(profit: Column, net: Column) -> Column:
    """Margin of one order in percent, two decimals, halves to the even digit."""
    return F.rint(F.try_divide(dbl(profit), dbl(net)) * 100 * 100) / 100


def band_by_bins(pct: Column) -> Column:
    """Right-closed bins (-1,0], (0,5], (5,10], (10,100]; NULL outside."""
    return (
        F.when((pct > -1) & (pct <= 0), BANDS[0])
        .when((pct > 0) & (pct <= 5), BANDS[1])
        .when((pct > 5) & (pct <= 10), BANDS[2])
        .when((pct > 10) & (pct <= 100), BANDS[3])
    )


def band_by_case(pct: Column) -> Column:
    """The report's own banding: zero, up to 5, up to 10, everything else (also missing)."""
    labels = [f"{i}) {band}" for i, band in enumerate(BANDS, 1)]
    return (
        F.when(pct == 0, labels[0])
        .when(pct <= 5, labels[1])
        .when(pct <= 10, labels[2])
        .otherwise(labels[3])
    )


def lakh_label(value: Column) -> Column:
    """Axis text in lakh (one lakh = 100,000 rupees)."""
    return F.format_string("₹%,.1fL", dbl(value) / 1e5)
