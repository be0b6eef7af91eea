"""DataFrame operators: each takes DataFrames and returns a DataFrame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters use without computing it again.

    Catalyst copies a column's expression into a filter it pushes below; it does not
    push a filter on the output of an outer explode.
    """
    kept = [c for c in rows.columns if c != name]
    return rows.select(*kept, F.explode_outer(F.array(value)).alias(name))
