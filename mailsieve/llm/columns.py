"""Columns of the input beside those that an operator adds or works with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but the ``used`` ones under a name that nothing else has, and what gives a frame its columns back as they came."""
    mark = uuid.uuid4().hex[:12]
    private = {c: f"_{i}_{mark}" for i, c in enumerate(docs.columns) if c not in used}

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(private.get(c, c)).alias(c) for c in docs.columns))

    return docs.withColumnsRenamed(private), restore
