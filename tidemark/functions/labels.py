"""Growth bands, recodes and display texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timekeys import ColumnOrName, as_col

# Band codes and the display text of each.
GROWTH_BAND_LABELS = {
    "new": "신규지역",
    "decrease": "감소지역",
    "increase_0_10": "10%이하_증가지역",
    "increase_10_20": "10%초과_20%이하_증가지역",
    "increase_20_30": "20%초과_30%이하_증가지역",
    "increase_30_more": "30%_초과_증가지역",
}

# Display text of the three user types.
USER_TYPE_LABELS = {
    "all": "전체",
    "new": "신규유저",
    "returning": "재방문유저",
}


def growth_band(rate: ColumnOrName) -> Column:
    """Band of a growth rate; a region without a rate is new."""
    rate = as_col(rate)
    return (
        F.when(rate.isNull(), "new")
        .when(rate < 0, "decrease")
        .when(rate <= 0.1, "increase_0_10")
        .when(rate <= 0.2, "increase_10_20")
        .when(rate <= 0.3, "increase_20_30")
        .otherwise("increase_30_more")
    )


def recode(c: ColumnOrName, labels: Mapping[str, str]) -> Column:
    """Replace the values named in ``labels``; any other value stays as it is."""
    c = as_col(c)
    out = c
    for value, label in labels.items():
        out = F.when(c == value, label).otherwise(out)
    return out


def joined_key(*parts: ColumnOrName) -> Column:
    """``a-b`` key of several text columns; null where one of them is."""
    first, *rest = [as_col(p) for p in parts]
    return F.concat(first, *[F.concat(F.lit("-"), p) for p in rest])


def period_label(index: ColumnOrName) -> Column:
    """``M0``, ``M1``, … for an elapsed-period index."""
    return F.concat(F.lit("M"), as_col(index).cast("string"))


def count_text(c: ColumnOrName, unit: str = "명") -> Column:
    """``1,234명``."""
    return F.concat(F.format_number(as_col(c), 0), F.lit(unit))


def percent_text(c: ColumnOrName, digits: int = 1) -> Column:
    """``12.3%`` for 0.123, rounded half-up on the decimal digits of the rate."""
    percent = F.round(as_col(c).cast("decimal(20,6)") * 100, digits)
    return F.format_string(f"%.{digits}f%%", percent.cast("double"))


def month_text(c: ColumnOrName) -> Column:
    """``05월`` for a date in May."""
    return F.date_format(as_col(c), "MM'월'")
