"""Computing expensive columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections do not re-evaluate.

    A filter on a projected column is pushed below the projection together with
    a copy of the whole expression.  Generated columns are not, so costly
    parsers are put behind a one-row generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
