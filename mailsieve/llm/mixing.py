"""Mixing sources by temperature, realised as budgeted permutations of blocks.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is found by
repeated section of [0, 1] (each pass over the table of sources tries 32 values): the one whose weights
have a target entropy, or the least one under which no source repeats more often than a limit.

A weight times the total is a source's budget. It is met by going through the source's blocks of
documents again and again, in another order each time; whole rounds take every document once, and the last
round ends in the block and at the document where the budget is used up, never beyond it. Without
a total, the least one is taken that holds every document at least once.

Documents join blocks by hash and a source has at most ``MAX_BLOCKS`` of them, so running sums go over
blocks, not documents, and a source with a third of all rows is spread like any other. Only the documents
of the one block where a budget ends are ordered one by one.

Defined cases: documents without words cost nothing and are taken once; a null source is a source of its own;
repeated rows are mixed each; a null doc_id is placed by its text; an empty table gives an empty result. Extra columns
pass through ``mix`` unless they are named like the added ones (n_tokens, copy, block, position).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.columns import set_aside
from mailsieve.operators.durable import durable

BLOCK_TOKENS = 1 << 18
MAX_BLOCKS = 4096
MAX_REPEATS = 1.5
SEED = 42
_TRIES, _PASSES = 32, 6
_KEY = "_source_key"


def word_count(text: Column | str = "text") -> Column:
    """Words of a text between white space (tab to carriage return and blank)."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def source_sizes(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """(source key, tokens) per source with any; a written table."""
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias(_KEY)).agg(F.sum(tokens).alias("tokens"))
    return durable(sizes.where("tokens > 0"), "sources")


def find_exponent(sizes: DataFrame, entropy: float | None = None, max_repeats: float | None = None, total: float | None = None) -> float:
    """The exponent for a target entropy (nats) or a repetition limit, to six places.

    A limit that even the exponent 1 breaks (a total above limit times all tokens) is an error, and so is
    giving both targets or none. An entropy out of reach gives the nearest end.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either entropy or max_repeats")
    n, least, most = sizes.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return 1.0
    n, least, most = float(n), float(least), float(most)
    if max_repeats is not None and max_repeats < (total or n) / n:
        raise ValueError(f"{total} tokens need more than {max_repeats} rounds of {n}")
    low, high = 0.0, 1.0
    log_share = F.log(F.col("tokens") / n)
    for _ in range(_PASSES):
        tries = [low + (high - low) * k / _TRIES for k in range(_TRIES + 1)]
        rows = sizes.select(log_share.alias("s"), F.explode(F.array(*(F.lit(a) for a in tries))).alias("a"))
        sums = rows.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("s"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("s")) * F.col("s")).alias("zs"))
        met = {}
        for a, z, zs in sums.collect():
            if entropy is not None:
                # Entropy falls as the exponent grows.
                met[a] = math.log(z) - a * zs / z <= entropy
            elif total is None:
                met[a] = (most / least) ** (1 - a) <= max_repeats
            else:
                met[a] = total / n / z * (least / n) ** (a - 1) <= max_repeats
        good = [a for a in tries if met[a]]
        high = good[0] if good else high
        low = max([a for a in tries if a < high], default=low)
    return math.ceil(round(high * 1e6, 3)) / 1e6


def budgets(sizes: DataFrame, exponent: float, total: float | None = None) -> DataFrame:
    """(source key, tokens, weight, budget, rounds, rest): whole rounds and the tokens left for the last one."""
    n, most = sizes.agg(F.sum("tokens"), F.max("tokens")).first()
    n, most = float(n or 1), float(most or 1)
    share = F.pow(F.col("tokens") / n, F.lit(exponent))
    z = sizes.agg(F.sum(share)).first()[0] or 1.0
    # The largest source repeats least; without a total its budget is one round.
    total = total if total is not None else n * z * (most / n) ** (1 - exponent)
    weighed = sizes.select(_KEY, "tokens", F.round(share / z, 12).alias("weight"))
    planned = weighed.withColumn("budget", F.floor(F.round(F.col("weight") * total, 3) + 0.5))
    rounds = F.floor(F.col("budget") / F.col("tokens"))
    return planned.withColumn("rounds", rounds).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("tokens"))


def _fraction(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def mix(
    docs: DataFrame,
    source: str = "source",
    tokens: Column | None = None,
    entropy: float | None = None,
    max_repeats: float | None = None,
    total: float | None = None,
    seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row of ``docs`` per copy that the mixture takes, with n_tokens, copy (round), block and position.

    position lies in [0, 1); reading copies in its order goes through all sources at their weights.
    """
    if entropy is None and max_repeats is None:
        max_repeats = MAX_REPEATS
    own = F.coalesce(F.col(source).cast("string"), F.lit("\x00"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    docs = docs.drop("n_tokens", "copy", "block", "position")
    counted = docs.withColumns({"n_tokens": word_count() if tokens is None else tokens, _KEY: own, "_number": number})
    # Sizes need two numbers per document, not its text.
    narrow = durable(counted.select(_KEY, "_number", "n_tokens"), "sizes")
    sizes = source_sizes(narrow, _KEY, "n_tokens")
    plan = budgets(sizes, find_exponent(sizes, entropy, max_repeats, total), total)
    plan = durable(plan.withColumn("blocks", F.least(F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)), F.lit(MAX_BLOCKS)).cast("int")), "plan")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("_number")), F.col("blocks").cast("long")).cast("int")
    placed = narrow.join(plan.select(_KEY, "blocks"), _KEY).withColumn("block", block)
    sums = durable(placed.groupBy(_KEY, "block").agg(F.sum("n_tokens").alias("held")), "blocks")
    # At most MAX_BLOCKS rows of a source and round: the order of its blocks and the tokens before each.
    turns = sums.join(plan, _KEY).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds"))))
    order = Window.partitionBy(_KEY, "copy").orderBy(F.xxhash64(F.lit(seed), "copy", "block"), "block")
    turns = turns.withColumn("before", F.sum("held").over(order) - F.col("held"))
    last = F.col("copy") == F.col("rounds")
    turns = turns.where(~last | (F.col("before") < F.col("rest")))
    cut = last & (F.col("before") + F.col("held") > F.col("rest"))
    turns = durable(turns.select(_KEY, "block", "copy", "held", "before", "tokens", "budget", cut.alias("cut"), (F.col("rest") - F.col("before")).alias("left")), "turns")
    # The one block of a source where its budget ends: its documents in order of their places.
    ends = turns.where("cut").select(_KEY, "block", "copy", "left")
    inside = placed.join(ends, [_KEY, "block"]).withColumn("place", _fraction(F.lit(seed), F.col("copy"), F.col("_number")))
    along = Window.partitionBy(_KEY).orderBy("place", "_number", "n_tokens").rangeBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("upto", F.sum("n_tokens").over(along)).where("upto <= left")
    taken = durable(fits.select(F.col(_KEY).alias("_k"), F.col("_number").alias("_n"), F.lit(True).alias("fits")).distinct(), "taken")
    turns = turns.select(F.col(_KEY).alias("_t"), F.col("block").alias("_b"), "copy", "held", "before", "tokens", "budget", "cut", "left")
    blocks = plan.select(F.col(_KEY).alias("_p"), "blocks")
    every = counted.join(blocks, F.col(_KEY) == F.col("_p"), "left")
    # Documents without words belong to no block: they cost nothing and are taken once.
    wordless = F.col("n_tokens") == 0
    every = every.withColumn("block", F.when(wordless, -1).otherwise(block))
    every = every.join(turns, (F.col(_KEY) == F.col("_t")) & (F.col("block") == F.col("_b")), "left")
    # Most copies lie in whole blocks; the others are looked up by their numbers.
    whole = every.where(wordless | ~F.col("cut"))
    ended = every.where("cut").join(taken, (F.col(_KEY) == F.col("_k")) & (F.col("_number") == F.col("_n")), "left_semi")
    place = _fraction(F.lit(seed), F.col("copy"), F.col("_number"))
    room = F.when(F.col("cut"), F.col("left")).otherwise(F.col("held"))
    position = (F.col("copy") * F.col("tokens") + F.col("before") + place * room) / F.col("budget")
    out = whole.unionByName(ended)
    out = out.withColumns({"copy": F.coalesce("copy", F.lit(0).cast("long")), "position": F.coalesce(position, F.lit(0.0))})
    return out.select(*docs.columns, "n_tokens", "copy", "block", "position")


def mixed_copies(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """The copies of ``docs`` that the mixture takes, columns as they came whatever their names."""
    own, restore = set_aside(docs, "doc_id", "text", source)
    return restore(mix(own, source, **options))
