"""SpotSigs fingerprints: chains of content words after common words, in DataFrame functions alone.

Anchors are the words that stand in ``ANCHOR_SHARE`` of all documents or more (and in ``ANCHOR_DOCS``) and, so that a text in a language of few
documents has enough of them, one word in ``ANCHOR_EVERY`` by its hash; all other words are content. Each place of an anchor
gives a signature: the anchor and the ``CHAIN`` content words after it, ``DISTANCE`` apart. The start of a text counts as an anchor,
and a text of anchors alone has one signature of all its words, so every text with a word has a signature. A fingerprint is the set of a text's
signatures as 64-bit hashes, written as 16 hex digits each in ascending order; two texts are as alike as the Jaccard similarity of their sets.

``similar_sets`` joins fingerprints. Sets are partitioned by length, so that sets of a similarity of ``threshold`` lie in the same or neighbouring partitions;
their signatures are ordered by how many sets have them, the rarest first, and only the first n - ceil(threshold * n) + 1 of n are joined, because two
similar sets share one of those; a pair goes on only if what follows the shared signature can still reach the threshold, and is then compared
in full. Equal sets are compared once, by their least id. So no link between different sets is lost, and a signature that a whole group shares
comes last and isn't joined.

The neighbour of a document in the order of ids is found without a global sort: cuts from approximate percentiles deal the rows to
buckets, each bucket is ordered in its own task, and borrows the first row of the bucket that follows it.

Bounds: a document has d distinct words on average, so at most d / ANCHOR_SHARE words are anchors, whatever the size of the corpus. They
are collected, checked against ``BROADCAST_ROWS`` and put into the plan as a table of hash slots. Buckets are at most ``MAX_BUCKETS``, with
one borrowed row each.

Defined cases: words are lower-cased runs of letters and digits; a null or empty text, or one without words, has the fingerprint "" and is only like
another of those (1, else 0). Ids are integers, null ids come after all others; rows with the same id are ordered by their texts, descending. The
document after the last is the first; a single document follows itself. Repeated rows each count; an empty table gives none. Only the id and
the text are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.functions.arrays import bind
from mailsieve.operators.durable import durable
from mailsieve.operators.joins import BROADCAST_ROWS, skew_lookup

ANCHOR_SHARE, ANCHOR_DOCS, ANCHOR_EVERY = 0.05, 20, 16
CHAIN, DISTANCE = 2, 1
NO_WORD = r"[^\p{L}\p{N}]+"
BUCKET_BYTES, MAX_BUCKETS = 8 << 20, 16_384
THRESHOLD = 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def anchor_hashes(docs: DataFrame, text: str = "text", share: float = ANCHOR_SHARE, least: int = ANCHOR_DOCS) -> list[int]:
    """Hashes of the words that stand in a share of all documents, in ascending order."""
    n = docs.count()
    seen = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    common = seen.groupBy("word").count().where(F.col("count") >= max(share * n, least))
    found = common.select(F.xxhash64("word").alias("h")).distinct().limit(BROADCAST_ROWS + 1).collect()
    if len(found) > BROADCAST_ROWS:
        raise ValueError("too many common words for a plan; raise the share of documents")
    return sorted(r.h for r in found)


def _constant(numbers: list) -> Column:
    """Integers, or lists of them, as a constant array of the plan."""
    kind = "array<array<bigint>>" if numbers and isinstance(numbers[0], list) else "array<bigint>"
    return F.from_json(F.lit(json.dumps(numbers)), kind)


def _is_anchor(anchors: list[int]) -> Callable[[Column], Column]:
    """Looks a hash up among twice as many slots as there are anchors, so that it is compared with about one."""
    n = max(1, 2 * len(anchors))
    dealt: list[list[int]] = [[] for _ in range(n)]
    for h in anchors:
        dealt[h % n].append(h)
    slots = _constant(dealt)
    return lambda h: (F.pmod(h, F.lit(ANCHOR_EVERY)) == 0) | F.array_contains(F.get(slots, F.pmod(h, F.lit(n)).cast("int")), h)


def spot_signatures(text: Column, anchors: list[int], chain: int = CHAIN, distance: int = DISTANCE) -> Column:
    """The set of a text's signatures as an ascending array of hashes."""
    is_anchor = _is_anchor(anchors)

    def spots(both: Column) -> Column:
        anchor, content = both["anchor"], both["content"]
        after = lambda at: [F.get(content, at + i * distance) for i in range(chain)]
        # As many content words precede the k-th anchor at place i as i - k.
        chained = lambda x, k: F.when(x["i"] - k < F.size(content), F.xxhash64(x["h"], *after(x["i"] - k)))
        first = F.array(F.xxhash64(F.lit("start of text"), *after(F.lit(0))))
        some = F.filter(F.concat(first, F.transform(anchor, chained)), lambda s: s.isNotNull())
        alone = F.array(F.xxhash64(F.transform(anchor, lambda x: x["h"])))
        return F.when(F.size(content) > 0, F.array_sort(F.array_distinct(some))).otherwise(alone)

    def chains(marked: Column) -> Column:
        anchor, content = F.filter(marked, lambda x: x["a"]), F.filter(marked, lambda x: ~x["a"])
        both = F.struct(anchor.alias("anchor"), F.transform(content, lambda x: x["h"]).alias("content"))
        return F.when(F.size(marked) > 0, bind(both, spots)).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return bind(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"), is_anchor(h).alias("a"))), chains)


def fingerprint(spots: Column | str) -> Column:
    return F.array_join(F.transform(spots, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; pairs whose lengths alone keep them below ``least`` get 0 without a comparison."""
    shared = F.size(F.array_intersect(a, b))
    ratio = bind(shared, lambda k: k / (F.size(a) + F.size(b) - k))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < least * large), F.lit(0.0)).otherwise(ratio)


def _bucket(order: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``order``, by bisection; null ids come first."""
    if not cuts:
        return F.lit(0)
    table = _constant(cuts)
    low, high = F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = F.get(table, middle) <= order
        done = at["low"] >= at["high"]
        return F.when(done, at).otherwise(F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"), F.when(right, at["high"]).otherwise(middle).alias("high")))

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    return F.when(order.isNull(), 0).otherwise(F.aggregate(steps, F.struct(low, high), halve)["low"])


def _dealt(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """(id, text, bucket, borrowed): rows dealt to ranges of ids, each with the first row, in descending order, of the range below it.

    ``borrowed`` rows come last in their bucket; the lowest bucket borrows from the highest.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    wanted = min(MAX_BUCKETS, size.n, math.ceil((size.bytes or 0) / bucket_bytes))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = docs.agg(F.percentile_approx("id", shares, max(10_000, 20 * wanted))).first()[0] if shares else []
    dealt = docs.withColumn("bucket", _bucket(F.col("id"), sorted(set(cuts or []))))
    tops = dealt.groupBy("bucket").agg(F.max("id").alias("top"))
    known = sorted(((r.bucket, r.top) for r in tops.collect()), reverse=True)
    if not known:
        return dealt.withColumn("borrowed", F.lit(False))
    # The bucket before a range in descending order; the highest follows the lowest.
    tops = json.dumps([{"bucket": b, "top": t, "to": known[i - 1][0]} for i, (b, t) in enumerate(known)])
    listed = F.inline(F.from_json(F.lit(tops), "array<struct<bucket:int,top:bigint,to:int>>"))
    lender = docs.sparkSession.range(1).select(listed)
    same = (dealt["bucket"] == lender["bucket"]) & dealt["id"].eqNullSafe(lender["top"])
    heads = dealt.join(F.broadcast(lender), same).select("id", "text", F.col("to").alias("bucket"))
    heads = heads.groupBy("bucket", "id").agg(F.max("text").alias("text")).select("id", "text", "bucket", F.lit(True).alias("borrowed"))
    return dealt.withColumn("borrowed", F.lit(False)).unionByName(heads)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_chars, edited_sha256, spots, edited_spots, near_edited, near_next) of every whole text.

    The edited text has its last floor(n / 2) of n characters replaced by as many first ones of the next document in descending
    order of ids, or by all that document has.
    """
    anchors = anchor_hashes(docs, text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("borrowed", F.col("id").desc_nulls_last(), F.col("text").desc())
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    joined = _dealt(rows, bucket_bytes).withColumn("next", F.lead("text").over(order)).withColumn("edited", F.when(~F.col("borrowed"), edited))
    signed = joined.select(
        "id", "bucket", "borrowed", "text", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spot_signatures(F.col("text"), anchors).alias("spots"), spot_signatures(F.col("edited"), anchors).alias("edited_spots"),
    )
    found = signed.withColumn("next_spots", F.lead("spots").over(order)).where("NOT borrowed")
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "spots", "edited_spots",
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def digest(compared: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    prints = [fingerprint("spots").alias("fingerprint"), fingerprint("edited_spots").alias("edited_fingerprint")]
    return compared.select(id_col, "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


def _prefix_entries(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, n, i, spot): the rarest signatures of each set, at their place in the order of rarity."""
    each = sets.select("key", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    counts = each.groupBy("spot").agg(F.count(F.lit(1)).alias("sets"))
    ranked = each.join(counts, "spot").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "spot"))).alias("order"))
    longest = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    taken = ranked.select("key", "n", F.posexplode(F.slice("order", F.lit(1), longest)).alias("i", "entry"))
    # What a single set has joins nothing.
    return taken.where("entry.sets > 1").select("key", "n", "i", F.col("entry.spot").alias("spot"))


def similar_sets(prints: DataFrame, id_col: str = "doc_id", spots: str = "spots", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b, likeness) of all different sets at or above ``threshold``, named by the least id of each, and
    (id, class_id): each row's set. Sets without a signature are equal to one another and similar to nothing else.
    """
    name = F.md5(fingerprint(F.col(spots)).cast("binary"))
    rows = durable(prints.select(F.col(id_col).alias("id"), F.col(spots).alias("spots"), name.alias("key")), "prints")
    sets = durable(rows.groupBy("key").agg(F.min("id").alias("class_id"), F.first("spots").alias("spots")), "sets")
    entries = durable(_prefix_entries(sets, threshold), "entries")
    by_ratio = F.floor(F.log(F.col("n").cast("double")) * (1 / math.log(1 / threshold)) + 1e-9).cast("int") if threshold < 1 else F.col("n")
    held = entries.withColumn("part", by_ratio)
    # The longer set looks into its own partition of lengths and the one below.
    asks = held.select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("i").alias("i_b"), "spot", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    both = held.join(asks, ["spot", "part"])
    ordered = (F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("key") < F.col("key_b")))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_b")) - 1e-9
    reach = F.least("i", "i_b") + F.least(F.col("n") - F.col("i"), F.col("n_b") - F.col("i_b"))
    able = both.where(ordered & (F.col("n") >= F.lit(threshold) * F.col("n_b") - 1e-9) & (reach >= need))
    pairs = able.select("key", "key_b").distinct()
    left = sets.select("key", F.col("class_id").alias("a"), F.col("spots").alias("spots_a"))
    right = sets.select(F.col("key").alias("key_b"), F.col("class_id").alias("b"), F.col("spots").alias("spots_b"))
    compared = pairs.join(left, "key").join(right, "key_b").withColumn("likeness", likeness(F.col("spots_a"), F.col("spots_b"), threshold - 1e-9))
    kept = compared.where(F.col("likeness") >= threshold - 1e-9).select("a", "b", "likeness")
    members = skew_lookup(rows.select("id", "key"), sets.select("key", "class_id"), "key").select(F.col("id").alias(id_col), "class_id")
    return kept, members
