"""Near-duplicate groups by DartMinHash signatures, banding and exact verification.

A text is the set of its five-word shingles (lower-cased words of letters, digits and characters above 0x7F; a text
of fewer words is one shingle). DartMinHash throws hashed darts at the weighted shingles: each shingle and
weight region has its own stream of darts, a dart has a rank and a coordinate, and a coordinate keeps its dart of
least rank. Darts are thrown up to a rank that leaves about ``k (ln k + 2)`` of them however many
shingles a text has, so a signature costs the same for long and short texts, and two signatures agree in a
coordinate with the chance of their weighted Jaccard similarity.

25 bands of 5 coordinates miss a pair at a similarity of 0.8 with a chance of 5e-5, and less above it. Links
are exact, on whole shingle sets, and no component is torn: the most central text of a bucket is compared with all others, which settles groups
of copies by one comparison each, and what that leaves open goes through an exact prefix join (see ``near_links``). Pairs that other links already tie
aren't listed.

Texts are told apart by a fingerprint of their words, never by id: equal texts (same words) are one node, whatever their ids, and
different texts under one id are different nodes.

Defined cases: a text without words (null, empty) is a class of its own; rows without an id take part like others, and a class of such rows alone has a
negative number derived from its words; repeated rows are each reported with their class; extra columns aren't read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm import bytewords as bw
from mailsieve.llm.components import components
from mailsieve.operators.durable import durable
from mailsieve.operators.joins import skew_lookup

SHINGLE = 5
#: A character of a word, as ``bytewords.ALNUM`` says for bytes.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences) sorted and distinct per text, and two 64-bit fingerprints of all its words."""
    data = bw.LOWER[data]
    start, end, first = bw.word_spans(data, offsets, bw.ALNUM)
    words, n = bw.word_hashes(data, start, end), len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    full = bw.join_hashes(words, size)
    full_doc = doc[: len(full)]
    inside = bw.whole(first, size, len(full))
    docs, cells = [full_doc[inside]], [full[inside]]
    for short in range(1, size):
        few = np.flatnonzero(np.diff(first) == short)
        value = np.zeros(len(few), np.uint64)
        for d in range(short):
            value = value * bw.BASE + words[first[few] + d]
        docs.append(few)
        cells.append(bw.mix(value + np.uint64(short)))
    doc_all, cell = np.concatenate(docs), np.concatenate(cells) >> np.uint64(32)
    both, count = np.unique((doc_all.astype(np.uint64) << np.uint64(32)) | cell, return_counts=True)
    sums = np.zeros((2, len(words) + 1), np.uint64)
    up, down = bw.powers(len(words) + 1)
    for k in range(2):
        np.cumsum(bw.mix(words + np.uint64(k)) * up[: len(words)], out=sums[k, 1:])
    prints = [bw.mix((s[first[1:]] - s[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64)) for s in sums]
    return (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF), count, *prints


def dart_signatures(doc: np.ndarray, cell: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n rows of k dart ids for the weighted elements (doc, cell, weight); rows without elements are 0."""
    out = np.zeros((n, k), np.uint64)
    mass = np.bincount(doc, weight, n)
    limit = np.divide(k * (np.log(k) + 2), mass, out=np.zeros(n), where=mass > 0)
    todo = mass > 0
    while todo.any():
        mine = todo[doc]
        streams = []
        # Weight regions [0, 1), [1, 2), [2, 4), ...: a region of width w gets darts at rate w.
        low, width = 0.0, 1.0
        d, c, x = doc[mine], cell[mine].astype(np.uint64), weight[mine]
        region = 0
        while len(d):
            streams.append((d, bw.mix(c * _STEP + np.uint64(region + 1)), x, np.full(len(d), low), np.full(len(d), width)))
            low, width, region = low + width, max(1.0, low + width), region + 1
            more = x > low
            d, c, x = d[more], c[more], x[more]
        d, seed, x, lows, widths = (np.concatenate(v) for v in zip(*streams))
        rank = np.zeros(len(d))
        slots, ranks, ids = [], [], []
        live, step = np.arange(len(d)), 0
        while len(live):
            step += 1
            dart = bw.mix(seed[live] + np.uint64((int(_STEP) * step) % (1 << 64)))
            rank[live] -= np.log1p(-((dart >> np.uint64(11)).astype(float) * 2.0**-53)) / widths[live]
            inside = rank[live] < limit[d[live]]
            live, dart = live[inside], bw.mix(dart[inside])
            hit = lows[live] + widths[live] * ((dart & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32) < x[live]
            at, dart = live[hit], dart[hit]
            slots.append(d[at] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
            ranks.append(rank[at])
            ids.append(dart)
        slot, rank_all, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)
        order = np.argsort((slot.astype(np.uint64) << np.uint64(32)) | rank_all.astype(np.float32).view(np.uint32))
        slot = slot[order]
        least = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        out.reshape(-1)[slot[least]] = np.maximum(dart[order][least], np.uint64(1))
        # A coordinate may stay empty (about one text in eight); those texts throw on, to twice the rank.
        todo &= (out == 0).any(axis=1)
        out[todo] = 0
        limit[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), np.uint64)
    for band in range(bands):
        value = np.full(len(signatures), band + 1, np.uint64)
        for r in range(rows):
            value = value * bw.BASE + signatures[:, band * rows + r]
        keys[:, band] = bw.mix(value)
    return keys


def _node(print_a: np.ndarray, print_b: np.ndarray) -> np.ndarray:
    return bw.mix(print_a * bw.BASE + print_b)


def sign_texts(bands: int, rows: int, weights: str):
    """Rows (doc_id, row, node, keys); texts without words have no keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in bw.text_blocks(batches):
            n = len(offsets) - 1
            doc, cell, count, print_a, print_b = shingle_sets(data, offsets)
            weight = count.astype(float) if weights == "count" else np.ones(len(doc))
            keys = band_keys(dart_signatures(doc, cell, weight, n, bands * rows), bands, rows)
            some = np.bincount(doc, minlength=n) > 0
            upto = np.concatenate([[0], np.cumsum(some) * bands]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), bw.long_list(keys[some].reshape(-1)))
            columns = [batch.column(0), batch.column(2), bw.long_list(_node(print_a, print_b)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "keys"])

    return run


def set_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, cells, counts): the sorted shingles of a text and their occurrences as packed numbers."""
    for _, data, offsets in bw.text_blocks(batches):
        doc, cell, count, print_a, print_b = shingle_sets(data, offsets)
        upto = np.searchsorted(doc, np.arange(len(offsets)))
        packed = [
            pa.Array.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer((upto * 4).astype(np.int64)), pa.py_buffer(v.astype(np.uint32))])
            for v in (cell, count)
        ]
        yield pa.RecordBatch.from_arrays([bw.long_list(_node(print_a, print_b)), *(p.cast(pa.binary()) for p in packed)], names=["node", "cells", "counts"])


def _similarity(a: tuple[bytes, ...], b: tuple[bytes, ...], counted: bool) -> float:
    """Jaccard similarity of two sets (cells,); of two multisets (cells, counts) where ``counted``."""
    (x, *m), (y, *n) = ([np.frombuffer(v, np.uint32) for v in pair] for pair in (a, b))
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    both = both[order]
    pair = np.flatnonzero(both[1:] == both[:-1])
    if not counted:
        return len(pair) / max(1, len(both) - len(pair))
    counts = np.concatenate([*m, *n])[order].astype(np.int64)
    shared = int(np.minimum(counts[pair], counts[pair + 1]).sum())
    return shared / max(1, int(counts.sum()) - shared)


def compare_rows(counted: bool):
    width = len(_set_columns(counted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    rows = zip(*(c.to_pylist() for c in part.columns[2:]))
                    sim = [_similarity(r[:width], r[width:], counted) for r in rows]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim, pa.float64())], names=["node", "hub", "sim"])
        finally:
            bw.give_back()

    return run


def _set_columns(counted: bool) -> list[str]:
    """Occurrences move only where they count."""
    return ["cells", "counts"] if counted else ["cells"]


def _judge(pairs: DataFrame, sets: DataFrame, counted: bool) -> DataFrame:
    """(node, hub, sim) for pairs of nodes from their whole shingle sets."""
    columns = _set_columns(counted)
    own = sets.select("node", *columns)
    other = sets.select(F.col("node").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in columns))
    sides = pairs.join(own, "node").join(other, "hub").select("node", "hub", *columns, *(f"hub_{c}" for c in columns))
    return durable(sides.mapInArrow(compare_rows(counted), "node long, hub long, sim double"), "similarities")


def _tokens(counted: bool):
    """(node, component, n, token): the shingles of a set one by one; of a multiset each occurrence is a token of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    node, component, cells, *counts = (c[at].as_py() for c in batch.columns)
                    token = np.frombuffer(cells, np.uint32).astype(np.int64)
                    if counted:
                        times = np.frombuffer(counts[0], np.uint32).astype(np.int64)
                        turn = bw.take_ranges(np.zeros(len(times), np.int64), times)
                        token = bw.mix(np.repeat(token, times).astype(np.uint64) * bw.BASE + turn.astype(np.uint64)).view(np.int64)
                    same = lambda v: pa.array(np.full(len(token), v))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(node), same(component), same(len(token)), pa.array(token)], names=["node", "component", "n", "token"])
        finally:
            bw.give_back()

    return run


def prefix_pairs(open_: DataFrame, sets: DataFrame, similarity: float, counted: bool) -> DataFrame:
    """(node, hub): all pairs of ``open_`` (node, component) of different components that may be similar.

    Shingles are ordered by how many of the open sets have them, the rarest first. Two sets at ``similarity`` share one of the first
    n - ceil(similarity * n) + 1 of each, and a pair sharing the i-th of n and the j-th of m goes on only if min(n - i, m - j), the most that can follow,
    reaches similarity / (1 + similarity) * (n + m). A shingle that a whole group shares comes behind each text's own, so it joins
    next to nothing. The larger sets look into classes of lengths, those alone that a shingle of their place can still match. Among the sets that hold a shingle the
    component with most of them is not joined with itself, nor is any other.
    """
    share = similarity / (1 + similarity)
    columns = _set_columns(counted)
    each = open_.join(sets.select("node", *columns), "node").select("node", "component", *columns)
    each = durable(each.mapInArrow(_tokens(counted), "node long, component long, n long, token long"), "tokens")
    frequent = each.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    common = each.join(frequent, "token")
    held = common.groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("order"))
    # Shingles of a single set are counted but not listed; they come before all others.
    alone = F.col("n") - F.size("order")
    longest = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    first = F.slice("order", F.lit(1), F.greatest(longest - alone, F.lit(0)).cast("int"))
    entries = held.select("node", "component", "n", alone.alias("alone"), F.posexplode(first).alias("at", "entry"))
    entries = entries.select("node", "component", "n", (F.col("alone") + F.col("at")).alias("i"), F.col("entry.token").alias("token"))
    entries = durable(entries, "entries")
    parts = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
    most = parts.agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    entries = durable(entries.join(most.select("token", F.col("m.component").alias("largest")), "token"), "joined-entries")
    step = math.log(1.05)
    length_class = lambda m: F.floor(F.log(m.cast("double")) / step).cast("int")
    right = entries.select("token", length_class(F.col("n")).alias("length"), F.col("node").alias("b"), F.col("component").alias("component_b"), F.col("n").alias("m"), F.col("i").alias("j"), "largest")
    # The longest partner that the shingles behind this one allow.
    most_m = F.least(F.col("n") / similarity, (F.col("n") - F.col("i")) / share - F.col("n")) + 1e-6
    least_m = F.greatest(F.col("n") * similarity - 1e-6, F.lit(1.0))
    asks = entries.where((F.col("component") != F.col("largest")) & (most_m >= least_m))
    left = asks.select("token", F.explode(F.sequence(length_class(least_m), length_class(most_m))).alias("length"), F.col("node").alias("a"), "component", "n", "i")
    reach = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    fits = (reach >= share * (F.col("n") + F.col("m")) - 1e-9) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9)
    # Two askers meet once.
    once = (F.col("component_b") == F.col("largest")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, ["token", "length"]).where((F.col("component") != F.col("component_b")) & once & fits)
    return pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("hub")).distinct()


def near_links(buckets: DataFrame, sets: DataFrame, similarity: float, counted: bool) -> tuple[DataFrame, DataFrame] | None:
    """(links (a, b), classes (node, component)) for nodes that share a bucket; None without any link.

    ``buckets`` (key, node) and ``sets`` are written tables. First the most central node of each bucket, its
    pivot, is compared with all others; that settles groups of near copies, however large. Then the pairs without a pivot are open in
    buckets whose other nodes are in several components; ``prefix_pairs`` finds all of them that may still be similar and aren't tied, and one more
    comparison decides those.
    """
    # A node that shares large buckets stands amid its copies; most of them are similar to it.
    sized = durable(buckets.join(durable(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes"), "key"), "sized")
    central = sized.groupBy("node").agg((-F.sum("n")).alias("rank"))
    ranked = sized.select("key", "node").join(durable(central, "central"), "node")
    pivots = ranked.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("p")).select("key", F.col("p.node").alias("hub"))
    meets = durable(buckets.join(durable(pivots, "pivots"), "key").where("node <> hub"), "meets")
    sims = _judge(meets.select("node", "hub").distinct(), sets, counted)
    links = sims.where(F.col("sim") >= similarity).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    classes = components(links)
    named = meets.select("key", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = durable(named, "named")
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = durable(named.join(several, "key", "left_semi").select("node", "component").distinct(), "open")
    found = _judge(prefix_pairs(open_, sets, similarity, counted), sets, counted)
    found = found.where(F.col("sim") >= similarity).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    if not found.isEmpty():
        links = links.unionByName(found)
        classes = components(found.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return None if links.isEmpty() else (links, classes)


def _classified(docs: DataFrame, similarity: float, bands: int, rows: int, weights: str) -> DataFrame:
    """(doc_id, row, node, class, n_links) per row; ``row`` is a hash of the text as it came, ``class`` a node, null for texts without words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    signed = durable(texts.mapInArrow(sign_texts(bands, rows, weights), "doc_id long, row long, node long, keys array<long>"), "signed")
    worded = signed.where(F.size("keys") > 0)
    nodes = durable(worded.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "nodes")
    keys = durable(nodes.select("node", "doc_id", F.explode_outer("keys").alias("key")).where("key IS NOT NULL"), "keys")
    shared = durable(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    buckets = durable(keys.join(shared, "key").select("key", "node", "doc_id"), "buckets")
    wanted = durable(buckets.select("node", "doc_id").distinct(), "wanted")
    # A text of each node that shares a bucket, found by id; the fingerprint tells which of the texts of one id it is.
    # The same plan at every size: the texts move once, by id.
    by_id = wanted.where("doc_id IS NOT NULL").select("doc_id").distinct().hint("merge")
    named = texts.where("doc_id IS NOT NULL").join(by_id, "doc_id", "left_semi")
    sets = named.select("doc_id", "text").mapInArrow(set_rows, "node long, cells binary, counts binary")
    if not wanted.where("doc_id IS NULL").isEmpty():
        unnamed = texts.where("doc_id IS NULL").select("doc_id", "text")
        sets = sets.unionByName(unnamed.mapInArrow(set_rows, "node long, cells binary, counts binary"))
    sets = sets.select("node", *_set_columns(weights == "count"))
    sets = durable(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    linked = near_links(buckets.select("key", "node"), sets, similarity, weights == "count")
    plain = signed.select("doc_id", "row", "node", (F.size("keys") > 0).alias("worded"))
    own = F.when(F.col("worded"), F.col("node"))
    if linked is None:
        return plain.select("doc_id", "row", "node", own.alias("class"), F.lit(0).cast("long").alias("n_links"))
    links = durable(linked[0].distinct(), "near-links")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    counted = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = durable(linked[1].join(counted, "node"), "classes")
    found = skew_lookup(plain, classes, "node")
    return found.select("doc_id", "row", "node", F.coalesce("component", own).alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "presence") -> DataFrame:
    """(doc_id, class_id, n_links): one row per row of ``docs`` (doc_id, text).

    class_id is the least doc_id of the group; n_links counts the direct links found for the row's text.
    ``weights="count"`` weighs a shingle by its occurrences (the similarity is then that of multisets).
    """
    found = durable(_classified(docs, similarity, bands, rows, weights), "classified")
    nameless = -F.abs(F.shiftrightunsigned("class", 1)) - 1
    names = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")).select("class", F.coalesce("least", nameless).alias("class_id"))
    named = skew_lookup(found, durable(names, "class-names"), "class")
    return named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "presence") -> DataFrame:
    """One document of each group, the one of the least doc_id (rows without an id come last); columns as they came.

    A row is known by its id and its text as it came, so another text under the same id stays. Rows without words all stay.
    """
    found = durable(_classified(docs, similarity, bands, rows, weights), "classified")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    chosen = found.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("k")).select("k.doc_id", "k.row").distinct()
    names = {c: f"_{c}_{uuid.uuid4().hex[:8]}" for c in ("id", "row", "kept_id", "kept_row")}
    keyed = docs.withColumns({names["id"]: F.col("doc_id").cast("long"), names["row"]: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = durable(chosen.select(F.col("doc_id").alias(names["kept_id"]), F.col("row").alias(names["kept_row"])), "kept")
    same = (keyed[names["row"]] == kept[names["kept_row"]]) & keyed[names["id"]].eqNullSafe(kept[names["kept_id"]])
    # Repeated rows agree in id and text, so any of them will do.
    one = keyed.join(kept, same, "left_semi").dropDuplicates([names["id"], names["row"]])
    wordless = keyed.where(~F.coalesce("text", F.lit("")).rlike(WORD))
    return one.unionByName(wordless).select(*docs.columns)
