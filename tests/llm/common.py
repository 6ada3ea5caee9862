"""Fixtures and plain rebuilds that the tests compare against."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 4001}x{i}" for i in range(20_000))
EDGE = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, " \n\t ", "en", "s"),
    (4, "one Two", "en", "s"),
    (5, LONG, "en", "s"),
    (6, LONG, "de", None),
    (7, "a row that is here twice with the same id and text", "en", "s"),
    (7, "a row that is here twice with the same id and text", "en", "s"),
    (None, "a row without any id but with a good many words of its own", None, "t"),
    (8, "Ünïcode wörds, 漢字 and \U0001f600 emoji\x00nul", "xx", "t"),
]
# Names that the operators use for columns of their own.
CLASHING = "score predicted n_words hit_spans item_ids longest keys node chosen chunk flag n_tokens copy block position grp pair distance kept x0 cells".split()


def edge_docs(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


def no_docs(spark):
    return edge_docs(spark).limit(0)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOW))


def spaced(text: str | None) -> list[str]:
    return SPACED.findall((text or "").translate(LOW))


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
