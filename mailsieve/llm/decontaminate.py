"""Benchmark decontamination with suffix arrays over the training documents.

Documents are read in shards of a few megabytes. Each shard gets a suffix array over its words; every
suffix of every benchmark item is then looked up in it by binary search, one word deeper per step, which
gives the places of all verbatim matches that are long enough. Nothing is shuffled and documents never
meet each other, so the plan is one scan; the benchmark travels to the tasks in blocks of bounded size.

Words: ASCII letters are lower-cased, a word is a run of letters, digits and characters above 0x7F. A window
is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Suffixes
whose first words begin no window cannot match and are left out of the array.

Defined cases: a null or empty text has no words and is clean; a null item text is an item without
words; a null item_id counts as an empty id; items that share an id count once; repeated rows are each
reported; an empty benchmark marks nothing. Extra columns pass through under any name
but those added: n_words, n_hit, hit_spans, item_ids, longest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.llm import bytewords as bw
from mailsieve.llm.columns import set_aside
from mailsieve.operators.durable import durable

WINDOW = 10
#: Words of the benchmark that one pass over the documents carries: about 100 MB in each task.
PASS_WORDS = 4_000_000
SHARD_BYTES = 1 << 21
#: Leading words that decide whether a suffix can match at all.
LEAD = 3


def suffix_ranks(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes that begin at each word and reach to the end of its item, by prefix doubling; equal ones tie."""
    place = np.arange(len(words))
    rank = np.unique(words, return_inverse=True)[1] + 1
    size, longest = 1, int((end - place).max(initial=0))
    while size < longest:
        behind = np.where(place + size < end, rank[np.minimum(place + size, len(words) - 1)], 0)
        order = np.lexsort([behind, rank])
        new = np.ones(len(words), bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (behind[order][1:] != behind[order][:-1])
        rank = np.empty(len(words), np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        size *= 2
    return rank


class TestSet:
    """The windows of some benchmark items, ready to be searched for."""

    __test__ = False

    def __init__(self, ids: list[str], words: list[np.ndarray], window: int):
        self.ids, self.window = ids, window
        self.words = np.concatenate([*words, np.zeros(window, np.uint64)]) if words else np.zeros(window, np.uint64)
        ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
        starts, lengths, items = [], [], []
        for item, (w, end) in enumerate(zip(words, ends)):
            size = min(window, len(w))
            n = len(w) - size + 1 if len(w) else 0
            starts.append(np.arange(end - len(w), end - len(w) + n))
            lengths.append(np.full(n, size))
            items.append(np.full(n, item))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        start, length, item = join(starts), join(lengths), join(items)
        self.item_end = ends[item] if len(item) else item
        # Windows with the same words are searched for once.
        cells = np.zeros((len(start), window), np.uint64)
        for d in range(window):
            cells[:, d] = np.where(d < length, self.words[np.minimum(start + d, len(self.words) - 1)], 0)
        _, first, same = np.unique(cells, axis=0, return_index=True, return_inverse=True)
        self.start, self.length, self.cells = start[first], length[first], cells[first]
        # The places of a window are in order of what follows there, so a longer match is a narrower range of them.
        order = np.argsort(same.ravel(), kind="stable")
        if len(first) < len(start):
            ranks = suffix_ranks(self.words[: ends[-1]], np.repeat(ends, [len(w) for w in words]))
            order = np.lexsort([ranks[start], same.ravel()])
        self.items, self.place, self.place_end = item[order], start[order], self.item_end[order]
        self.item_from = np.searchsorted(same.ravel()[order], np.arange(len(first) + 1))
        self.item_start = (ends - np.array([len(w) for w in words], np.int64)) if words else ends
        self.lead = int(min(LEAD, self.length.min())) if len(first) else 1
        lead = np.zeros(len(first), np.uint64)
        for d in range(self.lead):
            lead = lead * bw.BASE + self.cells[:, d]
        self.leads = np.unique(bw.mix(lead))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.leads & np.uint64((1 << 20) - 1)).astype(np.int64)] = True


def _bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    """Vectorised binary search for each key between its own low and high."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        seen = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((seen <= key) if right else (seen < key))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def find_windows(words: np.ndarray, first: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """(place, window): every occurrence of a test window among the words of a shard's texts."""
    none = np.zeros(0, np.int64)
    n = len(words) - tests.lead + 1
    if n <= 0 or not len(tests.start):
        return none, none
    lead = bw.join_hashes(words, tests.lead)
    able = tests.table[(lead & np.uint64((1 << 20) - 1)).astype(np.int64)] & bw.whole(first, tests.lead, n)
    places = np.flatnonzero(able)
    near = np.minimum(np.searchsorted(tests.leads, lead[places]), len(tests.leads) - 1)
    places = places[tests.leads[near] == lead[places]]
    if not len(places):
        return none, none
    last = np.repeat(first[1:], np.diff(first))[places]
    columns = [np.where(places + d < last, words[np.minimum(places + d, len(words) - 1)], 0) for d in range(tests.window)]
    order = np.lexsort(columns[::-1])
    low, high = np.zeros(len(tests.start), np.int64), np.full(len(tests.start), len(places))
    for d in range(tests.window):
        live = np.flatnonzero((tests.length > d) & (low < high))
        if not len(live):
            break
        column, key = columns[d][order], tests.cells[live, d]
        low[live], high[live] = (_bound(column, low[live], high[live], key, r) for r in (False, True))
    found = np.flatnonzero(low < high)
    count = (high - low)[found]
    return places[order[bw.take_ranges(low[found], count)]], np.repeat(found, count)


def _longest(words: np.ndarray, last: np.ndarray, place: np.ndarray, window: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that each occurrence shares at most with an item that holds its window, and the range of places that share them."""
    length = tests.length[window].copy()
    low, high = tests.item_from[window].copy(), tests.item_from[window + 1].copy()

    def bound(low: np.ndarray, high: np.ndarray, depth: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = np.minimum(mid, len(tests.place) - 1)
            there = tests.place[at] + depth
            # No word has the number 0, which stands for the end of an item.
            seen = np.where(there < tests.place_end[at], tests.words[np.minimum(there, len(tests.words) - 1)], np.uint64(0))
            up = open_ & ((seen <= key) if right else (seen < key))
            low = np.where(up, mid + 1, low)
            high = np.where(open_ & ~up, mid, high)
        return low

    live = np.arange(len(place))
    while len(live):
        live = live[place[live] + length[live] < last[live]]
        key = words[place[live] + length[live]]
        a, b = (bound(low[live], high[live], length[live], key, right) for right in (False, True))
        more = a < b
        live = live[more]
        low[live], high[live] = a[more], b[more]
        length[live] += 1
    return length, low, high


LONGEST = "struct<n_words:long,doc_word:long,item_word:long,item_id:string>"
ADDED = f"n_words long, hit_spans array<struct<first:long,last:long>>, item_ids array<string>, longest {LONGEST}"


def match_shard(data: np.ndarray, offsets: np.ndarray, tests: TestSet) -> tuple[list, list, list, list]:
    """For each text: word count, hit runs [first, last], ids of items found, the longest match."""
    data = bw.LOWER[data]
    start, end, first = bw.word_spans(data, offsets, bw.ALNUM)
    words = bw.word_hashes(data, start, end)
    place, window = find_windows(words, first, tests)
    n = len(offsets) - 1
    counts, spans, ids, longest = np.diff(first).tolist(), [[] for _ in range(n)], [[] for _ in range(n)], [None] * n
    if len(place):
        delta = np.zeros(len(words) + 1, np.int64)
        np.add.at(delta, place, 1)
        np.add.at(delta, place + tests.length[window], -1)
        hit = np.cumsum(delta[:-1]) > 0
        edge = np.zeros(len(words) + 1, bool)
        edge[first] = True
        begins = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
        ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
        doc = np.searchsorted(first, begins, "right") - 1
        for d, a, b in zip(doc.tolist(), (begins - first[doc]).tolist(), (ends - first[doc]).tolist()):
            spans[d].append({"first": a, "last": b})
        doc = np.searchsorted(first, place, "right") - 1
        pairs = np.unique(np.stack([doc, window], 1), axis=0)
        count = np.diff(tests.item_from)[pairs[:, 1]]
        item = tests.items[bw.take_ranges(tests.item_from[pairs[:, 1]], count)]
        for d, i in np.unique(np.stack([np.repeat(pairs[:, 0], count), item], 1), axis=0).tolist():
            ids[d].append(tests.ids[i])
        length, low, high = _longest(words, first[doc + 1], place, window, tests)
        best = np.lexsort([window, place, -length, doc])
        best = best[np.concatenate([[True], np.diff(doc[best]) > 0])]
        for k in best.tolist():
            # Of equal matches the first item's.
            start = tests.place[low[k] : high[k]].min()
            item = np.searchsorted(tests.item_start, start, "right") - 1
            at = {"n_words": length[k], "doc_word": place[k] - first[doc[k]], "item_word": start - tests.item_start[item]}
            longest[doc[k]] = {c: int(v) for c, v in at.items()} | {"item_id": tests.ids[item]}
    return counts, spans, ids, longest


def _merge(old: list, new: list) -> list:
    """The union of two lists of runs of one text."""
    out: list[dict] = []
    for run in sorted([*(old or []), *new], key=lambda r: r["first"]):
        if out and run["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], run["last"])
        else:
            out.append(dict(run))
    return out


def _matcher(tests, text: str, again: bool) -> Callable:
    added = T._parse_datatype_string(ADDED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added]
        for rows, data, offsets in bw.text_blocks(batches, text, SHARD_BYTES):
            found = list(match_shard(data, offsets, tests.value))
            if again:
                old = [rows.column(rows.schema.get_field_index(f.name)).to_pylist() for f in added]
                found[1] = [_merge(a, b) for a, b in zip(old[1], found[1])]
                found[2] = [[*a, *b] for a, b in zip(old[2], found[2])]
                found[3] = [max((x for x in (a, b) if x), key=lambda x: x["n_words"], default=None) for a, b in zip(old[3], found[3])]
                rows = rows.select([c for c in rows.schema.names if c not in added.names])
            columns = [pa.array(v, k) for v, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *added.names])

    return run


def item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, words) with the words as hashes."""
    for rows, data, offsets in bw.text_blocks(batches, "text"):
        data = bw.LOWER[data]
        start, end, first = bw.word_spans(data, offsets, bw.ALNUM)
        words = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), bw.long_list(bw.word_hashes(data, start, end)))
        yield pa.RecordBatch.from_arrays([rows.column(0), words], names=["item_id", "words"])


def match_benchmark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pass_words: int = PASS_WORDS,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (runs of hit words), item_ids (found) and longest match.

    The benchmark is dealt into blocks of about ``pass_words`` words by item. One block is one scan of the
    documents; with more blocks each pass carries the marks of those before it.
    """
    spark = docs.sparkSession
    hashed = durable(
        items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).alias("text"))
        .mapInArrow(item_words, "item_id string, words array<long>"),
        "benchmark-words",
    )
    total = hashed.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // pass_words))
    clash = [c for c in docs.columns if c in T._parse_datatype_string(ADDED).names]
    docs = docs.drop(*clash)
    schema = T.StructType([*docs.schema, *T._parse_datatype_string(ADDED)])
    for block in range(blocks):
        # About pass_words words; the largest single item is the only excess.
        rows = hashed.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).collect()
        tests = TestSet([r.item_id for r in rows], [np.array(r.words, np.int64).view(np.uint64) for r in rows], window)
        docs = docs.mapInArrow(_matcher(spark.sparkContext.broadcast(tests), text, block > 0), schema)
        if block + 1 < blocks:
            docs = durable(docs, "benchmark-pass")
    return docs


def n_hit() -> F.Column:
    """Hit words of a matched document."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, columns as they came whatever their names."""
    own, restore = set_aside(docs, options.get("text", "text"))
    return restore(match_benchmark(own, items, **options).where(F.size("hit_spans") == 0))


def digest(matched: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of matched documents."""
    ids = F.sort_array(F.array_distinct("item_ids"))
    return matched.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size(F.array_distinct("item_ids")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
