"""Vector columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are compared at this many places, so that equal vectors tie exactly
# however their sums were ordered; the row id breaks the tie.
RANK_PLACES = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def has_dimension(vector: Column, dim: int) -> Column:
    return F.coalesce(F.size(vector) == dim, F.lit(False))
