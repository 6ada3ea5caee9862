"""Deterministic pseudo-randomness from md5, so that every run, retry and engine agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ':'; a string argument names a column, an int is a literal."""
    cols = [F.lit(str(p)) if isinstance(p, int) else _col(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def md5_int(key: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex digits of an md5 as a bigint."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")
