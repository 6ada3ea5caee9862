"""Turning array columns into rows.

The outer generators with a filter behind them give the same rows as the plain ones. For those
the optimizer adds a filter on the array's size below the generator, which repeats the text work
that builds the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, items: Column | str, name: str, *keep: str) -> DataFrame:
    """(keep, name): one row per element; elements are not null."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, items: Column | str, name: str, *keep: str) -> DataFrame:
    """(keep, pos, name): one row per element with its position from 0."""
    return df.select(*keep, F.posexplode_outer(items).alias("pos", name)).where(F.col("pos").isNotNull())


def bind(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda and nowhere else is moved into it by the optimizer and then
    computed again for every element; a bound one is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
