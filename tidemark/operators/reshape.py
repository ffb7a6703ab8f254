"""Wide tables to long ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    variable: str = "variable",
    value: str = "value",
) -> DataFrame:
    """One row per id and measure.  Measures of different types become doubles."""
    types = {dict(df.dtypes)[v] for v in values}
    if len(types) > 1:
        df = df.withColumns({v: F.col(v).cast("double") for v in values})
    return df.unpivot(list(ids), list(values), variable, value)
