import hashlib
import random

import common as c
import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import queries
from mailsieve.llm import vectorcodes as v


def rebuild(rows, entries=256, rounds=4):
    """{id: (codes, error)} and codebooks by a full search in Python integers."""
    x = {i: [int(np.floor(1024.0 * float(a))) for a in e] for i, e in rows if e is not None and all(a is not None and np.isfinite(a) for a in e)}
    width = -(-max(map(len, x.values()), default=0) // 4)
    x = {i: (e + [0] * (4 * width))[: 4 * width] for i, e in x.items()}
    parts = {i: [e[p * width : (p + 1) * width] for p in range(4)] for i, e in x.items()}
    books = [[parts[i][p] for i in sorted(x)[:entries]] for p in range(4)]

    def assign():
        return {i: [min((sum((a - b) ** 2 for a, b in zip(e[p], entry)), k) for k, entry in enumerate(books[p])) for p in range(4)] for i, e in parts.items()}

    for _ in range(rounds):
        found = assign()
        for p in range(4):
            for k in range(len(books[p])):
                mine = [parts[i][p] for i in x if found[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(column) // len(mine) for column in zip(*mine)]
    return {i: ([k for _, k in e], sum(d for d, _ in e)) for i, e in assign().items()}, books


def clustered(n, dim, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[rng.integers(12)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, i % 3 if i is not None and i % 5 else None) for i, e in rows], "vec_id long, embedding array<float>, label int")


def check(spark, rows, **options):
    df = frame(spark, rows)
    got, books = v.compress(df, **options)
    floats = [(i, None if e is None else [None if a is None else float(np.float32(a)) for a in e]) for i, e in rows]
    want, want_books = rebuild(floats, options.get("entries", 256), options.get("rounds", 4))
    assert {r.vec_id: (r.codes, r.error) for r in got.collect()} == want
    assert books.entries.tolist() == want_books


@pytest.mark.parametrize("listed", [1, 2, 5, 40])
def test_bounds_give_the_full_search(spark, listed):
    check(spark, clustered(150, 8, listed), entries=30, listed=listed)


def test_ties_go_to_the_lower_index(spark):
    rng = random.Random(5)
    check(spark, [(i, [rng.choice([0.0, 0.25, 0.5]) for _ in range(8)]) for i in range(200)], entries=40, listed=3, rounds=6)


def test_far_components_and_odd_lengths(spark):
    rows = [(i, [float(10 ** (i % 5))] * (5 + i % 3)) for i in range(40)]
    check(spark, rows, entries=8, listed=2)


def test_huge_components_count_as_the_largest(spark):
    got, books = v.compress(frame(spark, [(1, [1e30, -1e30, 0.0, 0.0]), (2, [0.5, 0.5, 0.5, 0.5])]))
    assert books.entries[:2, 0, 0].tolist() == [v.LARGEST, -v.LARGEST]
    assert {r.vec_id: r.error for r in got.collect()} == {1: 0, 2: 0}


def test_distances_of_large_integers_are_exact():
    rng = np.random.default_rng(1)
    x, e = rng.integers(-v.LARGEST, v.LARGEST, (50, 16)), rng.integers(-v.LARGEST, v.LARGEST, (20, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in e] for r in x]
    assert v.distances(x, e).tolist() == want
    near, low = v._full(x, e, 4)
    assert near.tolist() == [sorted(range(20), key=lambda k: (w[k], k))[:4] for w in want]
    assert np.allclose(low, [np.sqrt(np.array(sorted(w)[1:5], float)) for w in want])


def test_few_parts_need_the_full_search():
    """On clustered parts whose entries hardly move the lists decide, and the result is that of the search."""
    rng = np.random.default_rng(3)
    books = rng.integers(-500, 500, (64, 16))
    x = books[rng.integers(64, size=3000)] + rng.integers(-20, 20, (3000, 16))
    near, low = v._full(x, books, 8)
    shift = rng.integers(-3, 4, books.shape)
    moved = np.sqrt(np.square(shift).sum(1)) * (1 + 1e-9) + 1e-9
    got, bounds, best, used = v.reassign(x, books + shift, moved, near, v._rounded_down(low), 4)
    d = v.distances(x, books + shift)
    assert (got[:, 0] == d.argmin(1)).all() and (best == d.min(1)).all()
    assert (used == 8).mean() < 0.05 and got.shape == bounds.shape == (3000, 4)
    listed = np.take_along_axis(d, got[:, 1:], 1)
    assert (v._rounded_down(bounds[:, :3]) <= np.sqrt(listed)).all()
    np.put_along_axis(d, got, np.iinfo(np.int64).max, 1)
    assert (v._rounded_down(bounds[:, 3]) <= np.sqrt(d.min(1))).all()


def test_edges(spark):
    rows = [(1, None), (2, [0.1] * 8), (3, [0.1, None] * 4), (4, [float("nan")] * 8), (5, [float("inf")] * 8), (6, [0.3] * 7), (7, []), (None, [0.2] * 8), (2, [0.1] * 8), (2, [0.0] * 8)]
    df = frame(spark, rows).withColumns({x: F.lit("extra") for x in ("_ints", "codes", "error", "code", "_id")})
    got, books = v.compress(df, keep=("label",))
    assert sorted((r.vec_id or 0, r.error) for r in got.collect()) == [(0, 0), (2, 0), (2, 0), (2, 0), (6, 0), (7, 0)]
    assert books.entries[:, 0].tolist() == [[0, 0]] * 4 and books.entries[:, 5].tolist() == [[204, 204]] * 4
    digested = v.digest(got, books).collect()
    assert len(digested) == 6 and all(len(r.code) == 8 for r in digested)
    none, books = v.compress(frame(spark, rows).limit(0), keep=("label",))
    assert v.digest(none, books).count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    only_empty, _ = v.compress(frame(spark, [(1, []), (2, [])]))
    assert [(r.codes, r.error) for r in only_empty.collect()] == [([0] * 4, 0)] * 2


def test_query_equals_the_full_search(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = np.array([np.floor(1024.0 * np.array(e, np.float32).astype(float)) for _, e in sorted(rows)]).astype(np.int64).reshape(len(rows), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()
    for step in range(5):
        near = np.stack([v.distances(x[:, p], books[p]).argmin(1) for p in range(4)], 1)
        if step < 4:
            for p in range(4):
                for k in np.unique(near[:, p]):
                    mine = x[near[:, p] == k, p]
                    books[p, k] = mine.sum(0) // len(mine)
    error = {i: int(sum(np.square(x[n, p] - books[p, near[n, p]]).sum() for p in range(4))) for n, (i, _) in enumerate(sorted(rows))}
    code = {i: "".join(f"{k:02x}" for k in near[n]) for n, (i, _) in enumerate(sorted(rows))}
    digest = hashlib.sha256(",".join(str(a) for a in books.ravel().tolist()).encode()).hexdigest()
    got = queries.op13_drake_hamerly(spark, sf).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == {i: (code[i], error[i]) for i in code}
    for r in got:
        assert r.label_error == sum(e for i, e in error.items() if labels[i] == labels[r.vec_id]) and r.codebooks_sha256 == digest
