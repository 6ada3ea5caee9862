import random
from collections import Counter, defaultdict

import common as c
import numpy as np
import pytest

from mailsieve.llm import components as cc
from mailsieve.llm import neardup as nd


def shingles(text):
    w = c.words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=0.8):
    """Least id of each group, links by exact similarity over all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    where, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            shared.update((j, i) for j in where[g])
            where[g].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: top(i) for i in sets}


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_classes_equal_brute_force(spark, sf):
    docs = c.documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert classes(nd.near_duplicates(docs)) == brute(rows)


def test_large_group_and_chains(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    texts = []
    for _ in range(60):  # near copies of one text, most of them different
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for step in range(12):  # each is similar to the next, the ends are not
        chain = list(chain)
        chain[step * 16] = f"step{step}"
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(40)]
    texts += [texts[0].upper() + " !"] * 30
    want = brute(list(enumerate(texts)))
    got = classes(nd.near_duplicates(c.frame(spark, texts)))
    assert got == want
    assert len({want[i] for i in range(60, 72)}) == 1


def test_components_that_only_meet_away_from_their_hubs(spark):
    """Two groups whose least members aren't similar, tied by a pair of members that are."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(400)]

    def edit(text, n, name):
        out = list(text)
        for k, at in enumerate(rng.sample(range(0, 400, 5), n)):
            out[at] = f"{name}{k}"
        return out

    far = edit(base, 16, "q")  # too far from base, near to half-way texts
    half = [w if k % 2 else v for k, (v, w) in enumerate(zip(base, far))]
    texts = [base, far, edit(base, 5, "r"), edit(far, 5, "s"), half, *(edit(half, n % 9, f"t{n}") for n in range(60))]
    texts = [" ".join(t) for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts)))):
        rows = [texts[i] for i in order]
        assert classes(nd.near_duplicates(c.frame(spark, rows))) == brute(list(enumerate(rows)))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 2**32, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    a[:60], b[240:] = 0, 0
    doc = np.concatenate([np.zeros(np.sum(a > 0), int), np.ones(np.sum(b > 0), int)])
    both = np.concatenate([cells[a > 0], cells[b > 0]])
    sig = nd.dart_signatures(doc, both, np.concatenate([a[a > 0], b[b > 0]]), 3, 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (sig[2] == 0).all() and (sig[:2] > 0).all()


def test_counted_weights_compare_multisets(spark):
    once = " ".join(f"t{i}" for i in range(60))
    docs = c.frame(spark, [once, " ".join([once] * 4)])
    assert set(classes(nd.near_duplicates(docs)).values()) == {0}
    assert set(classes(nd.near_duplicates(docs, weights="count")).values()) == {0, 1}


def test_edges(spark):
    got = [tuple(r) for r in nd.near_duplicates(c.edge_docs(spark)).select("doc_id", "class_id").collect()]
    assert len(got) == len(c.EDGE)
    by = dict(got)
    assert {i: by[i] for i in range(1, 9)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert by[None] < 0
    assert nd.near_duplicates(c.no_docs(spark)).count() == 0
    kept = nd.keep_one(c.edge_docs(spark))
    assert kept.columns == c.edge_docs(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8)] + [(True, 0)]


@pytest.mark.parametrize("n", [1, 2, 30])
def test_components_of_paths_and_stars(spark, n):
    path = [(i, i + 1) for i in range(n)]
    star = [(1000, 1001 + i) for i in range(n)]
    links = spark.createDataFrame([*path, *star, (5000, 5000), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in cc.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n + 1)}}


def test_no_links_have_no_components(spark):
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_are_told_apart_by_their_words_not_by_id(spark):
    """Two texts under one id, copies under other ids and without any."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (3, b), (None, a), (None, b + "!"), (None, "only without any id"), (5, a.upper()), (1, a), (4, ""), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in nd.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, "only without any id"), (4, ""), (4, None), (None, "")], key=str)
    got = sorted(((r.doc_id or 0, r.class_id) for r in nd.near_duplicates(docs).where("doc_id IS NOT NULL").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (3, 1), (5, 1), (1, 1), (4, 4), (4, 4)], key=str)
    nameless = [r.class_id for r in nd.near_duplicates(docs.where("doc_id IS NULL")).where("class_id IS NOT NULL").collect()]
    assert len(set(nameless)) == 3 and max(nameless) < 0


def exact_classes(texts):
    """Classes by comparing all pairs, from matrices of shared shingles."""
    sets = [shingles(t) for t in texts]
    names = {g: k for k, g in enumerate(set().union(*sets))}
    holds = np.zeros((len(texts), len(names)), np.float32)
    for i, s in enumerate(sets):
        holds[i, [names[g] for g in s]] = 1
    shared, size = holds @ holds.T, holds.sum(1)
    near = shared * 5 >= 4 * (size[:, None] + size - shared)
    label = np.arange(len(texts))
    while True:
        least = np.where(near, label, len(texts)).min(1)
        if (least == label).all():
            return label.tolist(), near
        label = least


@pytest.mark.parametrize("most", [8, 20])
def test_a_large_group_of_different_near_copies(spark, most):
    """Copies at all distances around the limit of 0.8; what the central one doesn't tie goes through the prefix join."""
    rng = random.Random(most)
    base = [f"v{i}" for i in range(300)]
    texts = []
    for k in range(600):
        copy = list(base)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(300)] = f"x{rng.randrange(60) if k % 3 else rng.random()}"
        texts.append(" ".join(copy[: rng.choice([300, 300, 300, 280, 260])]))
    want, near = exact_classes(texts)
    rows = {r.doc_id: r for r in nd.near_duplicates(c.frame(spark, texts)).collect()}
    assert [rows[i].class_id for i in range(len(texts))] == want
    # Whatever its number, each link is one; a text without any link has none.
    alone = near.sum(1) == 1
    assert all((rows[i].n_links == 0) == alone[i] for i in range(len(texts)) if texts.count(texts[i]) == 1)


def test_prefix_pairs_lose_no_pair(spark):
    rng = random.Random(7)
    pool = [rng.getrandbits(32) for _ in range(400)]
    bases = [rng.sample(pool, rng.randrange(1, 60)) for _ in range(12)]
    sets = []
    for _ in range(250):
        cells = set(rng.choice(bases))
        for _ in range(rng.randrange(9)):
            cells.add(rng.choice(pool)) if rng.random() < 0.6 else cells.discard(rng.choice(sorted(cells) or [0]))
        sets.append(sorted(cells | {rng.getrandbits(32)}))
    packed = [(i, bytearray(np.array(x, np.uint32).tobytes()), bytearray(np.array([1 + (v + i) % 2 for v in x], np.uint32).tobytes())) for i, x in enumerate(sets)]
    table = spark.createDataFrame(packed, "node long, cells binary, counts binary")
    for groups in (250, 3):
        open_ = spark.createDataFrame([(i, i % groups) for i in range(250)], "node long, component long")
        for counted in (False, True):
            bags = [Counter({v: 1 + (v + i) % 2 if counted else 1 for v in x}) for i, x in enumerate(sets)]
            want = {
                (i, j) for i in range(250) for j in range(i)
                if i % groups != j % groups and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())
            }
            got = {(r.node, r.hub) for r in nd.prefix_pairs(open_, table, 0.8, counted).collect()}
            assert want <= got and len(want) > 50 and len(got) < 12 * len(want)
