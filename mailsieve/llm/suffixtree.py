"""Language-model scores from a probabilistic suffix tree over words.

A text is its words (runs of bytes that are not white space, ASCII letters lower-cased) and one end symbol.
The tree's states are contexts of preceding words, read backwards from the symbol. The symbol at the start of a text
is a word of its own kind, with nothing before it.

Every context of one or two words with at least ``LEAST`` occurrences in the training texts is a candidate, and so is every
longer one whose suffix, a word shorter, was retained; the number is fixed, so the tree grows with the corpus. A
context is retained when its next-symbol distribution diverges from that of its parent, the longest retained
context that is a suffix of it: the gain of log-likelihood over its occurrences, each predicted from all others, must
exceed ``gain`` nats and ``divergence`` nats per occurrence. A distribution is smoothed by ``mass``
occurrences of the parent's distribution, the mass chosen from a few by the same gain. The root is
the unigram distribution with half a count added to every known word and to one unknown symbol. Lengths are
tried one after another until one retains nothing.

Counts are gathered by ``chunks``: a chunk asks for its words, then length by length for its words after candidate
contexts. Its tokens are written once. What changes is written beside them from length to length: at first the counts of its words, then the tokens
whose contexts are still candidates, their probabilities, and sums of the scores of all others. Both tables lie in buckets of the
chunks' numbers, so a length moves its own asks and replies alone. The range of a (context, word) adds up its count and
its part of the context's gains; the range of the context adds up the parts, judges, and answers the chunks that hold the
context. Words, contexts and states are never collected or broadcast; the driver learns how many states a length has.

A score takes the longest retained context of each token. Defined cases: a null or empty text is its end symbol;
a null doc_id is trained on; without training texts every token has the probability of the unknown
symbol, which is 1; repeated rows each count; extra columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm import bytewords as bw
from mailsieve.llm import chunks as ch
from mailsieve.operators.durable import discard, durable, shuffles_dropped, small_batches

LEAST = 20
GAIN, DIVERGENCE = 10.0, 0.002
MASSES = (10.0, 100.0, 1000.0, 10000.0)
#: Names of the symbols at the start and the end of a text, which no word has but by chance.
START, END = np.uint64(0x5374617274000001), np.uint64(0x456E640000000003)
#: Kinds of replies: words, and for each part of a length the counts and the verdicts on contexts.
WORDS = 1
#: So many chunks bring a range of their own, which bounds what a range holds.
CHUNKS_A_RANGE = 2
#: So many ranges have one range of contexts between them, as a context is a small part of what is asked for with it.
RANGES_A_JUDGE = 4
#: So many shuffle partitions are one bucket of chunks: starting a task costs as much as going through some chunks.
PARTITIONS_A_BUCKET = 2


#: Nearly every token has short contexts. They are asked for in this many parts by their names, so that only a part is shuffled at a time.
PARTS = {1: 3, 2: 2}


def kinds(part: int) -> tuple[int, int]:
    return 2 * part + 2, 2 * part + 3


@dataclass
class Root:
    """Sizes of the training corpus, and the least occurrences of a context and of each word of a longer one."""

    tokens: int
    distinct: int
    least: float = LEAST
    word_least: float = 0.0

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


@dataclass
class Tree(Root):
    """The root and the verdicts on contexts, one table for each length that has states; ``tables`` are all written ones that are kept."""

    levels: list[DataFrame] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)

    def states(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, occurrences and masses of the states of a length. Collects them: for looking at small trees."""
        found = [ch.unpack(r.reply) for r in self.levels[depth - 1].where("chunk IS NULL").collect()] if depth <= len(self.levels) else []
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))

    @property
    def mass(self) -> np.ndarray:
        return self.states(1)[2]

    @property
    def pairs(self) -> np.ndarray:
        return self.states(2)[0]


class Tokens:
    """A chunk's tokens in order, each text closed by its end symbol; ``state`` is what was written beside them.

    Only tokens that are asked for are looked up, so a length with few open ones costs little more than them.
    """

    def __init__(self, chunk: ch.Chunk):
        self.number, self.doc_ids, self.flags, self.first = chunk.number, chunk.doc_ids, chunk.flags, chunk.offsets
        self.chunk, self.state = chunk, [] if chunk.state is None else ch.unpack(chunk.state)
        self.n = np.diff(self.first)

    @functools.cached_property
    def _unpacked(self) -> list[np.ndarray]:
        return ch.unpack(self.chunk.data)

    @property
    def keys(self) -> np.ndarray:
        return self._unpacked[0]

    @property
    def ids(self) -> np.ndarray:
        return self._unpacked[1]

    def words(self, at: np.ndarray) -> np.ndarray:
        """The symbols of the tokens ``at``. A chunk without open tokens is never unpacked."""
        return self.keys[self.ids[at]] if len(at) else np.zeros(0, np.uint64)

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of the tokens ``at``, which are in order, and their places in them."""
        doc = np.repeat(np.arange(len(self.n), dtype=np.int32), np.diff(np.searchsorted(at, self.first)))
        return doc, (at - self.first[doc]).astype(np.int32)

    def back(self, at: np.ndarray, place: np.ndarray, steps: int) -> np.ndarray:
        """The symbols that many steps before the tokens ``at``, which lie at least ``steps - 1`` words into their texts."""
        return np.where(place == steps - 1, START, self.words(np.maximum(at - steps, 0)))

    def total(self, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums over texts of values of tokens in the texts ``doc``."""
        return np.bincount(doc, values, len(self.n))


#: What is written beside the tokens of a chunk.
STATES = "chunk long, state binary"


def state_row(number: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "state": pa.array([ch.squeeze(*arrays)], pa.binary())})


def token_row(number: int, doc_ids: list, flags: np.ndarray, n: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """A row of a table like that of chunks, with tokens a text for its length and packed arrays for the texts."""
    packed = zstandard.ZstdCompressor(level=1).compress(ch.squeeze(*arrays))
    columns = [[number], [doc_ids], [flags.tolist()], [n.tolist()], [packed]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["chunk", "doc_ids", "flags", "lengths", "text"])


def tokenize(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
    """The chunk's distinct words, sorted, and which of them each token is, so that no later pass reads texts."""
    data = bw.LOWER[chunk.data]
    start, end, first = bw.word_spans(data, chunk.offsets, bw.SPACED)
    token = np.insert(bw.word_hashes(data, start, end), first[1:], END)
    keys, _, ids = bw.distinct_hashes(token)
    yield token_row(chunk.number, chunk.doc_ids, chunk.flags, np.diff(first) + 1, keys, ids.astype(np.uint32))
    bw.give_back()


def index_of(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Contexts:
    """A chunk's open tokens ``at``, whose contexts of a length are candidates.

    ``p`` is by the longest retained context so far. No more than ``limit`` occurrences has the context a word longer
    than the candidate. ``common`` tells which of the chunk's words may stand in contexts of two words and more; empty
    if all may. Tokens that aren't open any more are in the texts' sums, unless those aren't ``summed``.
    """

    def __init__(self, t: Tokens, root: Root, depth: int, summed: bool = True):
        self.t, self.root, self.depth, self.summed = t, root, depth, summed
        if len(t.state) == 1:
            self._start(*t.state)
            return
        self.common, self.n_known, self.base, self.score, steps, self.p, limit = t.state
        self.at, self.limit = np.cumsum(steps, dtype=np.int64), limit.astype(np.int64)
        self.doc, self.place = t.places(self.at)

    def _start(self, known: np.ndarray) -> None:
        """From the counts of the chunk's words: all that contexts of one word need."""
        t, known = self.t, known.astype(np.int64)
        # A start is as frequent as an end.
        ends = known[np.searchsorted(t.keys, END)]
        self.at = np.arange(len(t.ids))
        self.doc, self.place = t.places(self.at)
        count, p = known[t.ids], self.root.root(known)
        self.limit = np.where(self.place == 0, ends, np.concatenate([count[:1], count[:-1]]))
        self.common = (np.append(known, ends) >= self.root.word_least).astype(np.uint8) if self.root.word_least else np.zeros(0, np.uint8)
        if self.summed:
            self.n_known, self.base, self.score = t.total(self.doc, count > 0), t.total(self.doc, np.log10(p)[t.ids]), np.zeros(len(t.n))
        self.p, self.depth = p[t.ids], 0
        self.close(np.ones(len(t.ids), bool), self.limit)

    def _usable(self, steps: int) -> np.ndarray:
        """Whether the word that many steps before may stand in a context of two words and more."""
        if not len(self.common) or not len(self.at):
            return np.ones(len(self.at), bool)
        return self.common[np.where(self.place == steps - 1, len(self.common) - 1, self.t.ids[np.maximum(self.at - steps, 0)])] > 0

    def _after_open(self) -> np.ndarray:
        """Which open tokens, beside the first, follow the one open before them directly."""
        return np.flatnonzero(self.at[1:] == self.at[:-1] + 1) + 1

    def close(self, keep: np.ndarray, bound: np.ndarray) -> None:
        """Goes on to contexts a word longer, with ``bound`` occurrences at most, of the tokens kept; the others get their scores."""
        self.depth += 1
        able = keep & (self.place >= self.depth - 1) & (bound >= self.root.least)
        for steps in {1: (), 2: (1, 2)}.get(self.depth, (self.depth,)):
            able &= self._usable(steps)
        limit, after = bound.copy(), self._after_open()
        # What stands before the word before ends in the context of that word.
        limit[after] = np.minimum(bound[after], bound[after - 1])
        if self.summed:
            self.score = self.score + self.t.total(self.doc[~able], np.log10(self.p[~able]))
        self.at, self.doc, self.place, self.p, self.limit = (v[able] for v in (self.at, self.doc, self.place, self.p, limit))

    def contexts(self) -> np.ndarray:
        """Names of the open tokens' contexts."""
        found = self.t.back(self.at, self.place, 1)
        for steps in range(2, self.depth + 1):
            found = bw.mix(found * bw.BASE + self.t.back(self.at, self.place, steps))
        return found

    def find(self, contexts: np.ndarray, part: int) -> None:
        """The distinct (context, word) ``keys`` and distinct contexts ``names`` of the open tokens ``mine``, whose contexts are of a part."""
        self.mine = np.flatnonzero(contexts % np.uint64(PARTS.get(self.depth, 1)) == part)
        context = contexts[self.mine]
        self.keys, entry, self.which = bw.distinct_hashes(bw.mix(context * bw.BASE + self.t.words(self.at[self.mine])))
        self.entry, self.context = self.mine[entry], context[entry]
        self.names, _, name = bw.distinct_hashes(self.context)
        self.name = name[self.which]

    def take(self, replies: dict) -> None:
        """Moves ``p`` to the retained contexts of this length and goes on to the next."""
        contexts = self.contexts()
        count, verdict = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        for part in range(PARTS.get(self.depth, 1)):
            self.find(contexts, part)
            counts, verdicts = (replies.get(k, np.zeros(0, np.int64)) for k in kinds(part))
            count[self.mine], verdict[self.mine] = counts[self.which], verdicts[self.name]
        n, choice = verdict >> 3, verdict & 7
        mass = np.array([0.0, *MASSES])[choice]
        kept = choice > 0
        self.p = np.where(kept, (count + mass * self.p) / np.maximum(n + mass, 1.0), self.p)
        # The next longer context of the token after is this context and this token.
        bound, after = self.limit.copy(), self._after_open()
        bound[after] = np.minimum(bound[after], count[after - 1])
        # All pairs that are frequent enough are candidates, longer contexts below retained ones.
        self.close(kept if self.depth > 1 else np.ones(len(kept), bool), bound)

    def row(self) -> pa.RecordBatch:
        # Steps from one open token to the next and bounds of four bytes are short when packed.
        limit = self.limit.astype(np.uint32) if self.limit.max(initial=0) < 1 << 32 else self.limit
        steps = np.diff(self.at, prepend=0).astype(np.uint32)
        return state_row(self.t.number, self.common, self.n_known, self.base, self.score, steps, self.p, limit)


def token_asks(ranges: int):
    def run(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
        t = Tokens(chunk)
        trained = np.repeat(~t.flags, t.n)
        yield ch.ask_batch(chunk.number, ranges, t.keys, np.bincount(t.ids, trained, len(t.keys)).astype(np.uint32), form=ch.squeeze)

    return run


def token_answer(arrays: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
    """Totals per word; the summary holds the numbers of known words and of tokens."""
    bw.give_back()  # what the group before held
    keys, counts, _ = arrays
    distinct, _, which = bw.distinct_hashes(keys)
    total = np.bincount(which, counts, len(distinct)).astype(np.int64)
    return total[which], ch.squeeze(np.array([np.count_nonzero(total), total.sum()]))


def opened(number: int, replies: dict) -> pa.RecordBatch:
    """A chunk's state before contexts of one word: the counts of its words."""
    known = replies[WORDS]
    return state_row(number, known.astype(np.uint32) if known.max(initial=0) < 1 << 32 else known)


def advanced(root: Root, depth: int):
    """A chunk's state after the verdicts on contexts of a length."""

    def run(chunk: ch.Chunk, replies: dict) -> Iterator[pa.RecordBatch]:
        bw.give_back()
        c = Contexts(Tokens(chunk), root, depth)
        c.take(replies)
        yield c.row()

    return run


def context_asks(root: Root, depth: int, part: int, ranges: int, judges: int):
    """Entries (key, trained count, the parent's probability, context); and, in ranges behind the others, the contexts alone."""

    def run(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
        bw.give_back()
        t = Tokens(chunk)
        c = Contexts(t, root, depth, summed=False)
        c.find(c.contexts(), part)
        trained = np.bincount(c.which, ~t.flags[c.doc[c.mine]], len(c.keys)).astype(np.uint32)
        yield ch.ask_batch(chunk.number, ranges, c.keys, trained, c.p[c.entry].astype(np.float32), c.context, form=ch.squeeze)
        names = ch.ask_batch(chunk.number, judges, c.names, form=ch.squeeze)
        behind = pa.array(names.column(0).to_numpy() + np.int32(ranges))
        yield pa.RecordBatch.from_arrays([behind, *names.columns[1:]], names=names.schema.names)

    return run


def context_answer(arrays: list[np.ndarray]) -> tuple[np.ndarray, bytes | None]:
    """Totals per entry; the summary has for each context its occurrences and gains within this range.

    Contexts alone are handed on to their verdicts.
    """
    bw.give_back()
    if len(arrays) == 2:
        return arrays[0], None
    keys, counts, parents, contexts, _ = arrays
    distinct, first, which = bw.distinct_hashes(keys)
    total = np.bincount(which, counts, len(distinct)).astype(np.int64)
    used = np.flatnonzero(total > 0)
    parent = parents[first[used]].astype(float)
    names, _, at = bw.distinct_hashes(contexts[first[used]])
    c = total[used].astype(float)
    gains = [np.bincount(at, c * np.log((c - 1 + m * parent) / parent), len(names)) for m in MASSES]
    # bincount of nothing is an array of integers.
    return total[which], ch.squeeze(names, *(v.astype(float) for v in (np.bincount(at, c, len(names)), *gains)))


def _retained(names_n: np.ndarray, gains: np.ndarray, gain: float, divergence: float) -> tuple[np.ndarray, np.ndarray]:
    """(is the state kept, which mass) from occurrences and sums of gains, one column per mass."""
    masses = np.array(MASSES)
    total = gains - names_n[:, None] * np.log(np.maximum(names_n[:, None] - 1 + masses, 1e-12))
    best = total.argmax(axis=1) if len(total) else np.zeros(0, np.int64)
    won = total[np.arange(len(total)), best] if len(total) else np.zeros(0)
    return (won > gain) & (won > divergence * names_n), best


def verdicts(after: DataFrame, ranges: int, judges: int, part: int, least: float, gain: float, divergence: float) -> DataFrame:
    """A written table of replies: for each context a chunk asked for 8 * occurrences + 1 + which mass, 0 where it isn't retained.

    The summary of a range has names, occurrences and masses of its states.
    """

    def deal(batches):
        for batch in batches:
            for from_range, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Numbers below zero tell parts of sums from the chunks' asks.
                yield ch.ask_batch(-1 - from_range, judges, *ch.unpack(packed), form=ch.squeeze)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pieces = sorted(zip(rows.column("chunk").to_pylist(), rows.column("ask").to_pylist()))
        sums = [ch.unpack(a) for c, a in pieces if c < 0]
        names, n, *gains = (np.concatenate(v) for v in zip(*sums)) if sums else [np.zeros(0, np.uint64), *[np.zeros(0)] * (1 + len(MASSES))]
        distinct, _, at = bw.distinct_hashes(names)
        n, *gains = (np.bincount(at, v, len(distinct)).astype(float) for v in (n, *gains))
        kept, best = _retained(n, np.stack(gains, 1), gain, divergence)
        kept &= n >= least
        names, choice = distinct[kept], best[kept]
        code = np.append(n[kept].astype(np.int64) * 8 + 1 + choice, 0)
        chunks = [c for c, _ in pieces if c >= 0]
        packed = [ch.squeeze(code[index_of(names, ch.unpack(a)[0])]) for c, a in pieces if c >= 0]
        packed.append(ch.squeeze(names, n[kept], np.array(MASSES)[choice]))
        return ch.reply_table([*chunks, None], key[0].as_py(), kinds(part)[1], packed)

    sums = after.where("chunk IS NULL").select("range", "reply").mapInArrow(deal, ch.ASKS)
    asks = after.where(F.col("range") >= ranges).select((F.col("range") - F.lit(ranges)).alias("range"), "chunk", F.col("reply").alias("ask"))
    return durable(sums.unionByName(asks).groupBy("range").applyInArrow(run, ch.REPLIES), "verdicts", packed=True)


def _sums(replies: DataFrame) -> list[int]:
    """Over the ranges' summaries, whose first array is taken: its length and the first two numbers, added up."""

    def run(batches):
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                first = ch.unpack(packed)[0]
                one, two = [*first[:2].view(np.int64).tolist(), 0, 0][:2]
                yield pa.RecordBatch.from_pydict({"size": [len(first)], "one": [one], "two": [two]})

    found = replies.where("chunk IS NULL").select("reply").mapInArrow(run, "size long, one long, two long")
    return [sum(column) for column in zip(*found.collect())] or [0, 0, 0]


def grow_tree(
    table: DataFrame, ranges: int, share: float = 0.0, pair_share: float = 0.0, gain: float = GAIN, divergence: float = DIVERGENCE
) -> tuple[Tree, DataFrame]:
    """The tree of the texts without a flag, and the chunks joined with the state that their scores are read from.

    A ``share`` of the tokens raises the least occurrences of a context, a ``pair_share`` those of the words of longer ones.
    There are at least ``ranges`` ranges, and one for every ``CHUNKS_A_RANGE`` chunks.
    """
    tokenized = durable(ch.each_chunk(table, tokenize, ch.CHUNKS), "tokens", packed=True, buckets=_buckets(ranges))
    # Only now: batches of texts tell how large the chunks are.
    with small_batches(tokenized.sparkSession, ch.BATCH_BYTES):
        return _grow(tokenized, ranges, share, pair_share, gain, divergence)


def _buckets(ranges: int) -> tuple[int, str]:
    return max(1, ranges // PARTITIONS_A_BUCKET), "chunk"


def _grow(tokenized: DataFrame, ranges: int, share: float, pair_share: float, gain: float, divergence: float) -> tuple[Tree, DataFrame]:
    buckets = _buckets(ranges)
    ranges = max(ranges, -(-tokenized.count() // CHUNKS_A_RANGE))
    judges = -(-ranges // RANGES_A_JUDGE)
    words = ch.merge(ch.each_chunk(tokenized, token_asks(ranges), ch.ASKS), WORDS, token_answer, ch.squeeze)
    _, distinct, tokens = _sums(words)
    root = Root(tokens, distinct, max(LEAST, share * tokens), pair_share * tokens)
    state = durable(ch.answered(words, opened, STATES), "state", packed=True, buckets=buckets)
    discard(words)
    levels, tables, upto, depth = [], [], 0, 0
    # Both short lengths are tried whatever the first retains.
    while tokens and (depth < 2 or upto == depth):
        depth += 1
        counted, judged, chunks = [], [], tokenized.join(state, "chunk")
        for part in range(PARTS.get(depth, 1)):
            counted.append(ch.merge(ch.each_chunk(chunks, context_asks(root, depth, part, ranges, judges), ch.ASKS), kinds(part)[0], context_answer, ch.squeeze))
            judged.append(verdicts(counted[-1], ranges, judges, part, root.least, gain, divergence))
        tables += judged
        levels.append(reduce(DataFrame.unionByName, judged))
        upto = depth if _sums(levels[-1])[0] else upto
        if upto == depth or depth == 1:
            before, counts = state, [t.where(F.col("range") < ranges) for t in counted]
            state = durable(ch.with_replies(chunks, [*counts, *judged], advanced(root, depth), STATES), "state", packed=True, buckets=buckets)
            discard(before)
        discard(*counted)
    return Tree(root.tokens, root.distinct, root.least, root.word_least, levels[:upto], [tokenized, state, *tables]), tokenized.join(state, "chunk")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(root: Root):
    def run(chunk: ch.Chunk) -> Iterator[pa.RecordBatch]:
        t = Tokens(chunk)
        c = Contexts(t, root, 0)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(t.doc_ids, pa.int64()), "held_out": t.flags, "n_tokens": t.n.astype(np.int64), "n_known": c.n_known.astype(np.int64),
            "train_tokens": np.full(len(t.n), root.tokens), "base_score": c.base, "score": c.score + t.total(c.doc, np.log10(c.p)),
        })

    return run


def score_texts(
    docs: DataFrame, held_out: Column, share: float = 0.0, pair_share: float = 0.0, gain: float = GAIN, divergence: float = DIVERGENCE
) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) from a tree of the rows that aren't held out."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        tree, state = grow_tree(ch.packed_chunks(docs, held_out), ranges, share, pair_share, gain, divergence)
        root = Root(tree.tokens, tree.distinct, tree.least, tree.word_least)
        with small_batches(spark, ch.BATCH_BYTES):
            scores = durable(ch.each_chunk(state, score_chunk(root), SCORES), "scores")
    discard(*tree.tables)
    return scores
