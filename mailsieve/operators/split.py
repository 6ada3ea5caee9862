"""Reproducible shuffle, sample and stratified split by hash rank.

Rows are ordered by ``md5(id:seed)``, then id. Counts per hash bucket place every bucket in that
order without sorting the data; only the one bucket that holds a cut is sorted.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.hashing import md5_int, md5_key

SEED = 42
# 16 bits: 65,536 buckets, at most that many rows per stratum in the counting step.
BUCKET_DIGITS = 4
SPLITS = ("train", "validation", "test")


def shuffle_key(id_col: str = "doc_id", seed: int = SEED) -> Column:
    return md5_key(id_col, seed)


def _order_key(id_col: str, seed: int) -> Column:
    return F.struct(shuffle_key(id_col, seed).alias("hash"), F.col(id_col).alias("id"))


def _bucket_offsets(keyed: DataFrame, strata: list[str]) -> DataFrame:
    """(strata, bucket, before, size, n): rows of the stratum in earlier buckets, here, in all."""
    sizes = keyed.groupBy(*strata, "bucket").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(*strata)
    before = F.sum("size").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(
        *strata,
        "bucket",
        F.coalesce(before, F.lit(0)).alias("before"),
        "size",
        F.sum("size").over(w).alias("n"),
    )


def _keyed(df: DataFrame, id_col: str, seed: int, strata: list[str]) -> DataFrame:
    key = _order_key(id_col, seed)
    return df.select(*strata, key.alias("key")).withColumn(
        "bucket", md5_int(F.col("key.hash"), BUCKET_DIGITS)
    )


def _cut_keys(
    df: DataFrame, id_col: str, seed: int, strata: list[str], cuts: dict[str, Column]
) -> DataFrame:
    """One row per stratum with, for every cut, the key of the row at that rank.

    ``cuts`` maps a name to a rank as an expression of ``n``, the size of the stratum. A cut of
    rank 0 gives a null key.
    """
    keyed = _keyed(df, id_col, seed, strata)
    offsets = _bucket_offsets(keyed, strata)
    holds = [(F.col("before") < rank) & (rank <= F.col("before") + F.col("size")) for rank in cuts.values()]
    holders = offsets.where(sum((h.cast("int") for h in holds[1:]), holds[0].cast("int")) > 0)
    # At most one bucket per cut and stratum.
    near = keyed.join(F.broadcast(holders), [*strata, "bucket"])
    rank_in = F.row_number().over(Window.partitionBy(*strata, "bucket").orderBy("key"))
    ranked = near.withColumn("rank", F.col("before") + rank_in)
    picked = [
        F.max(F.when(F.col("rank") == rank, F.col("key"))).alias(name) for name, rank in cuts.items()
    ]
    return ranked.groupBy(*strata).agg(*picked)


def check_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Fail the job on a label other than 0 or 1."""
    ok = F.col(label).isin(0, 1)
    message = F.concat(F.lit(f"{label} must be 0 or 1, found "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
    return df.withColumn(label, F.when(ok, F.col(label)).otherwise(F.raise_error(message).cast("int")))


def stratified_split(
    df: DataFrame,
    id_col: str = "doc_id",
    label: str = "label",
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split``: train, validation or test, each label cut in the same proportions.

    The rows themselves never move: two cut keys per label are found first and every row then
    compares its own key with them. ``id_col`` must be unique.
    """
    df = check_labels(df, label)
    val, test = Fraction(str(val_size)), Fraction(str(test_size))
    train = 1 - val - test
    if min(val, test, train) < 0:
        raise ValueError("split sizes must be between 0 and 1")
    n = F.col("n")

    def rank(share: Fraction) -> Column:
        return F.expr(f"(n * {share.numerator}L) div {share.denominator}L")

    cuts = _cut_keys(df, id_col, seed, [label], {"train_end": rank(train), "val_end": rank(train + val)})
    key = _order_key(id_col, seed)
    split = (
        F.when(key <= F.col("train_end"), "train")
        .when(key <= F.col("val_end"), "validation")
        .otherwise("test")
    )
    # One row per label, and labels are 0 or 1.
    return (
        df.join(F.broadcast(cuts), label, "left")
        .withColumn("split", split)
        .select(*df.columns, "split")
    )


def split_index(split_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return split_df.select(id_col, "split")


def split_summary(split_df: DataFrame) -> DataFrame:
    """Rows and percent per split."""
    counts = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    # Three rows at most.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("split", "n", F.round(100 * F.col("n") / total, 6).alias("pct"))


def corpus_profile(split_df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per split and label, the label's share of its split, and the corpus size."""
    counts = split_df.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    in_split = F.sum("n").over(Window.partitionBy("split"))
    # One row per split and label.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(
        "split", label, "n", F.round(F.col("n") / in_split, 6).alias("share"), total.alias("n_corpus")
    )


def seeded_shuffle(df: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """All rows in hash order (a distributed sort)."""
    return df.orderBy(shuffle_key(id_col, seed), id_col)


def shuffle_rank(df: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(id, shuffle_rank): 1-based place of each row in hash order, ranked bucket by bucket."""
    keyed = _keyed(df, id_col, seed, [])
    # One row per bucket, so at most 65,536.
    offsets = F.broadcast(_bucket_offsets(keyed, []).select("bucket", "before"))
    rank_in = F.row_number().over(Window.partitionBy("bucket").orderBy("key"))
    return (
        keyed.withColumn("rank_in", rank_in)
        .join(offsets, "bucket")
        .select(F.col("key.id").alias(id_col), (F.col("before") + F.col("rank_in")).alias("shuffle_rank"))
    )


def seeded_sample(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``min(n, rows)`` rows, the first ones in hash order, whatever the size of the sample.

    The key of the last row is found from bucket counts; every row then compares its own key.
    """
    cuts = _cut_keys(df, id_col, seed, [], {"end": F.least(F.lit(n), F.col("n"))})
    return df.where(_order_key(id_col, seed) <= cuts.select("end").scalar())
