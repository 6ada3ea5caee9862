"""Writing splits, metrics and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_splits(df: DataFrame, path: str, id_col: str = "doc_id", fmt: str = "parquet") -> None:
    """``path/corpus`` partitioned by split, so that readers prune, and ``path/index``."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(f"{path}/corpus")
    df.select(id_col, "split").write.mode("overwrite").format(fmt).save(f"{path}/index")


def write_results(metrics: DataFrame, path: str) -> None:
    """The metrics table as CSV with a header."""
    metrics.write.mode("overwrite").option("header", True).csv(path)


def write_explanations(records: DataFrame, path: str) -> None:
    """One JSON record per explanation, one folder per model."""
    records.write.mode("overwrite").partitionBy("model").json(path)
