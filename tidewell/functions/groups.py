"""Aggregates over groups that keep an order: distinct values by first place, and counts of values as a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_distinct(rows: DataFrame, by: list[str], value: str, ordinal: str, name: str = "values") -> DataFrame:
    """(by, name): the distinct values of each group in order of their first place; nulls are left out.

    Two aggregations, so that what repeats is merged into (least ordinal, value) before a group's values meet; values of one ordinal stand in their own order.
    """
    first = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(ordinal).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__at"), F.col(value).alias("v"))))
    return first.groupBy(*by).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def value_counts(rows: DataFrame, by: list[str], value: str, name: str = "counts") -> DataFrame:
    """(by, name): how often each value stands in a group, as a map in the values' order; null counts as ``unknown``."""
    key = F.coalesce(F.col(value).cast("string"), F.lit("unknown"))
    counted = rows.groupBy(*by, key.alias("__value")).agg(F.count("*").alias("__n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__value", "__n")))).alias(name))
