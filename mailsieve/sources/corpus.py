"""Reading labelled corpora from any Spark source into ``(text, label)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.text import text_or_nan
from mailsieve.sources.splitcsv import PACKED_SUFFIX, files_of, scan_split_csv

DEFAULT_TEXT = "Email Text"
DEFAULT_LABEL = "Email Type"


def corpus_schema(text: str = DEFAULT_TEXT, label: str = DEFAULT_LABEL) -> T.StructType:
    return T.StructType([T.StructField(text, T.StringType()), T.StructField(label, T.IntegerType())])


def scan_corpus(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    fmt: str = "csv",
    multi_line: bool = True,
) -> DataFrame:
    """Scan a corpus; CSV fields may hold quotes and, with ``multi_line``, line breaks.

    With line breaks inside fields a first scan finds where records begin, so that large files are many tasks
    (``splitcsv``). Where a packed file is among them it can't be cut, and each file is one task.
    """
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    schema = schema if schema is not None else corpus_schema()
    if multi_line and files_of(spark, path).where(F.col("path").rlike(PACKED_SUFFIX)).isEmpty():
        return scan_split_csv(spark, path, schema)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def resolve_columns(df: DataFrame) -> tuple[str, str]:
    """Names of the text and label columns, found from the schema alone."""
    names = df.columns
    text = next((c for c in ("text", "email_text") if c in names), None)
    if text is None:
        text = next((f.name for f in df.schema if isinstance(f.dataType, T.StringType)), None)
    if text is None:
        raise ValueError("could not locate a text column")
    label = next((c for c in ("label", "is_phishing", "target") if c in names), None)
    if label is None:
        raise ValueError("could not locate a label column")
    return text, label


def project_rename(df: DataFrame, text: str, label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the text and label columns (and ``keep``), under their standard names."""
    return df.select(*keep, F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label"))


def standardize(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``resolve_columns`` followed by ``project_rename``."""
    return project_rename(df, *resolve_columns(df), keep=keep)


def cast_types(df: DataFrame) -> DataFrame:
    """Text as string with null spelled ``nan``, label as int."""
    return df.withColumns({"text": text_or_nan("text"), "label": F.col("label").cast("int")})


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches ``path`` on the file system Spark would read it from."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def union_frames(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Concatenate (tag, rows) by column name, absent columns null, with the tag as ``source``.

    A tag may come more than once; each entry gives its rows.
    """
    if not frames:
        raise ValueError("no sources to merge")
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_sources(
    spark: SparkSession, paths: list[str], schema: T.StructType | None = None, fmt: str = "csv"
) -> DataFrame:
    """Merge corpora, skipping paths that do not exist; a path listed twice is read twice."""
    present = [p for p in paths if path_exists(spark, p)]
    return union_frames([(p, scan_corpus(spark, p, schema, fmt)) for p in present])


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly when a scan has fewer splits than there are cores.

    Text work is heavy, and few splits give few tasks. A scan with enough splits is left as it is;
    only the plan is asked, no file is listed here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
