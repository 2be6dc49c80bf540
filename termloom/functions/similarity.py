"""Similarity of strings and vectors."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of matching characters; it depends on which text comes first."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio can't exceed, by lengths alone."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)


def letters_bound(a: Column, b: Column) -> Column:
    """What the ratio can't exceed, by how often each character is in both."""
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / both)


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
