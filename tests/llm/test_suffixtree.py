import math
import random
import zlib
from collections import Counter

import common as c
import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import chunks as ch
from mailsieve.llm import queries, suffixtree as st
from mailsieve.operators.durable import small_batches


def base(rows, held):
    tokens = {i: [*c.spaced(t), None] for i, t in rows}
    count = Counter(w for i, t in rows if not held(i) for w in [*c.spaced(t), None])
    n, v = sum(count.values()), len(count)
    log = lambda w: math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
    return {i: (len(t), sum(count[w] > 0 for w in t), n, sum(map(log, t))) for i, t in tokens.items()}


def test_base_scores(spark, sf):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = [(r.doc_id, r.text) for r in c.documents(spark, sf).select("doc_id", "text").collect()]
    want = base(rows, held)
    got = queries.op9_suffix_tree(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score <= 0


@pytest.fixture(scope="module")
def markov():
    """Texts in which the next word depends on one or two words before it."""
    rng = random.Random(0)
    letters = "abcdefgh"
    one = {x: rng.sample(letters, 3) for x in letters}
    two = {("a", x): rng.choice(letters) for x in letters}
    texts = []
    for _ in range(400):
        words = ["a"]
        for _ in range(rng.randrange(5, 40)):
            before = tuple(words[-2:])
            words.append(two[before] if before in two and rng.random() < 0.9 else rng.choice(one[words[-1]]))
        texts.append(" ".join(words))
    return texts


def grown(spark, texts, held=lambda i: i % 5 == 1):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = ch.write_chunks(docs.repartition(3), F.col("doc_id") % 5 == 1)
    return docs, st.grow_tree(table, 4, 1e-4, 1e-3, st.GAIN, st.DIVERGENCE)[0]


def test_contexts_are_found_and_help_unseen_texts(spark, markov):
    docs, tree = grown(spark, markov)
    assert np.count_nonzero(tree.mass) >= 6 and len(tree.pairs) >= 3
    rows = st.score_texts(docs, F.col("doc_id") % 5 == 1).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.2


def test_independent_words_keep_the_root_alone(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(400)]
    _, tree = grown(spark, texts)
    # Only the start and what leads to the end can tell anything here.
    assert np.count_nonzero(tree.mass) <= 1 and len(tree.pairs) == 0


def test_probabilities_add_up(spark, markov):
    """Over all one-word continuations of a context, and one unknown word."""
    symbols = [*"abcdefgh", "unknownword"]
    held = [" ".join(["a", "b", "c", x]) for x in symbols]
    texts = [t for t in markov] + held + ["a b c"]
    flags = [False] * len(markov) + [True] * (len(held) + 1)
    docs = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(texts, flags))], "doc_id long, text string, f boolean")
    rows = {r.doc_id: r for r in st.score_texts(docs, F.col("f")).collect()}
    n = len(markov)
    # P(text with x) = P(a b c) P(x | a b c) P(end | b c x); take P(end | ...) out with a further scoring.
    more = [" ".join(["a", "b", "c", x, y]) for x in symbols for y in symbols]
    docs2 = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(texts + more, flags + [True] * len(more)))], "doc_id long, text string, f boolean")
    rows2 = {r.doc_id: r for r in st.score_texts(docs2, F.col("f")).collect()}
    assert all(rows[i].score == pytest.approx(rows2[i].score) for i in rows)
    total_end = 10 ** rows[n + len(held)].score
    # Mass of all texts that begin with "a b c": the end here, or a symbol and then the end or another symbol ...
    prefix_mass = total_end + sum(10 ** rows[n + k].score for k in range(len(symbols)))
    deeper = sum(10 ** rows2[len(texts) + k].score for k in range(len(more)))
    assert prefix_mass < prefix_mass + deeper < 1
    assert tree_sums_to_one(spark, markov)


def tree_sums_to_one(spark, markov):
    _, tree = grown(spark, markov)
    trained = [t for i, t in enumerate(markov) if i % 5 != 1]
    count, after = Counter(), Counter()
    for t in trained:
        w = [*c.spaced(t), None]
        count.update(w)
        after.update(zip(w, w[1:]))
    root = {w: float(tree.root(np.array([n]))[0]) for w, n in count.items()}
    unknown = float(tree.root(np.array([0]))[0])
    ok = abs(sum(root.values()) + unknown - 1) < 1e-12
    for v in "abcdefgh":
        for m in st.MASSES:
            total = sum((after[v, w] + m * p) / (count[v] + m) for w, p in root.items()) + m * unknown / (count[v] + m)
            ok &= abs(total - 1) < 1e-12
    return ok


def test_edges(spark):
    held = F.coalesce(F.col("doc_id") == 8, F.lit(False))
    rows = st.score_texts(c.edge_docs(spark), held).collect()
    assert len(rows) == len(c.EDGE)
    count = Counter(w for i, t, *_ in c.EDGE if i != 8 for w in [*c.spaced(t), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_tokens, r.n_known) == (1, 1)
            assert r.base_score == pytest.approx(math.log10((count[None] + 0.5) / (n + 0.5 * (v + 1))))
    assert st.score_texts(c.no_docs(spark), F.lit(False)).count() == 0
    alone = st.score_texts(c.edge_docs(spark), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 == r.base_score for r in alone)


def rebuilt(train, texts):
    """Log scores by the definition, and the number of states of each length."""
    tokens = [["<start>", *c.spaced(x), None] for x in train]
    count = Counter(w for x in tokens for w in x[1:])
    n, v = sum(count.values()), len(count)
    root = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    states, sizes = {}, []

    def p(words, w, upto):
        value = root(w)
        for d in range(1, min(upto, len(words)) + 1):
            if words[-d:] in states:
                after, total, mass = states[words[-d:]]
                value = (after[w] + mass * value) / (total + mass)
        return value

    for depth in range(1, 99):
        after = {}
        for x in tokens:
            for i in range(depth, len(x)):
                after.setdefault(tuple(x[i - depth : i]), Counter())[x[i]] += 1
        found = {}
        for words, following in after.items():
            total = sum(following.values())
            if total < 20 or (depth > 2 and words[1:] not in states):
                continue
            gain = lambda m: sum(k * math.log((k - 1 + m * p(words, w, depth - 1)) / ((total - 1 + m) * p(words, w, depth - 1))) for w, k in following.items())  # noqa: B023, E731
            best = max(st.MASSES, key=gain)
            if gain(best) > max(st.GAIN, st.DIVERGENCE * total):
                found[words] = following, total, best
        states |= found
        sizes.append(len(found))
        if depth > 1 and not found:
            break
    score = lambda x: sum(math.log10(p(tuple(x[:i]), x[i], 99)) for i in range(1, len(x)))
    return [score(["<start>", *c.spaced(x), None]) for x in texts], sizes


def test_scores_equal_the_definition_at_every_length(spark):
    """A context of three words tells what those of two can't; a group of copies ends by itself."""
    rng = random.Random(3)
    filler = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(filler, k=20)) for _ in range(300)]
    for k in range(80):
        texts += [f"{rng.choice(filler)} k{i} u v y{i} {rng.choice(filler)}" for i in (1, 2)]
        texts.append(f"{rng.choice(filler)} t v z")
    texts += ["all of these words stand here in each copy of one text"] * 40
    held = ["w1 k1 u v y1 w2", "w1 k1 u v y2 w2", "all of these words stand there", ""]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(held)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f boolean").repartition(5)
    got = {r.doc_id: r.score for r in st.score_texts(docs, F.col("f")).collect()}
    want, sizes = rebuilt(texts, [t for _, t, _ in rows])
    assert len(sizes) > 3 and sizes[2] > 0
    for (i, _, _), s in zip(rows, want):
        assert got[i] == pytest.approx(s, rel=1e-9, abs=1e-9)
    assert got[1000] - got[1001] > 0.5


def test_rare_contexts_stay_candidates_in_a_large_corpus(spark):
    """A word in less than 1e-4 of the tokens, and a pair of words below 1e-3, tell what follows them."""
    rng = random.Random(4)
    filler = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choices(filler, k=500)) for _ in range(800)]
    texts += ["rare next", "one pair yes", "two pair no"] * 30
    held = ["rare next", "one pair yes", "one pair no"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(held)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f boolean")
    got = {r.doc_id: r for r in st.score_texts(docs, F.col("f")).collect()}
    assert 30 / got[0].train_tokens < 1e-4
    # The start of the text, "next" and the end are all but certain after "rare".
    assert got[1000].score - got[1000].base_score > 6
    assert got[1001].score - got[1002].score > 0.3


def test_large_rows_travel_in_small_batches(spark):
    """Spark holds a batch outside its heap, so one never has many rows of a megabyte."""
    import pyarrow as pa

    wide = pa.RecordBatch.from_pydict({"range": pa.array(range(64), pa.int32()), "ask": pa.array([bytes([k]) * 100_000 for k in range(64)])})
    cut = list(ch.slices(wide))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([wide])) and max(b.nbytes for b in cut) <= ch.BATCH_BYTES
    assert list(ch.slices(wide.slice(0, 0))) == [] and len(ch.reply_table([], 1, 1, [])) == 0

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    with small_batches(spark, ch.BATCH_BYTES):
        rows = spark.range(8, numPartitions=1).select(F.expr("cast(repeat('x', 700000) as binary)").alias("b")).mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in rows) == 8 and max(r.n for r in rows) <= 2
    assert spark.conf.get(name, None) == before


def test_packed_columns_are_not_compressed_again(spark, markov):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(markov[:40])], "doc_id long, text string")
    tree, state = st.grow_tree(ch.write_chunks(docs), 2, 1e-4, 1e-3, st.GAIN, st.DIVERGENCE)
    for table in (state, *tree.tables):
        for path in table.inputFiles():
            meta = pq.ParquetFile(path.removeprefix("file://")).metadata
            assert {meta.row_group(0).column(k).compression for k in range(meta.num_columns)} == {"UNCOMPRESSED"}


def test_tokens_lie_still(spark, markov, monkeypatch):
    """Tokens are written once and never shuffled: a length moves asks and replies, and writes only what it changes beside them."""
    written, plans = [], []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plain, replied = st.durable, ch.with_replies

    def kept(df, name="table", *args, **kwargs):
        table = plain(df, name, *args, **kwargs)
        written.append((name, table.columns))
        return table

    def planned(*args):
        df = replied(*args)
        plans.append(plan(df))
        return df

    monkeypatch.setattr(st, "durable", kept)
    monkeypatch.setattr(ch, "with_replies", planned)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree, state = st.grow_tree(ch.packed_chunks(spark.createDataFrame(list(enumerate(markov)), "doc_id long, text string")), 4)
        assert "SortMergeJoin" in plan(state) and "Exchange" not in plan(state)
        # One for the replies, none for the chunks.
        assert len(plans) > 1 and all(p.count("Exchange hashpartitioning") == 1 for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [n for n, _ in written].count("tokens") == 1
    assert len([n for n, _ in written if n == "state"]) > 1 and all("text" not in columns for n, columns in written if n == "state")
    names = [t.durable_table for t in tree.tables if hasattr(t, "durable_table")]
    st.discard(*tree.tables)
    assert len(names) == 2 and not any(spark.catalog.tableExists(n) for n in names)
