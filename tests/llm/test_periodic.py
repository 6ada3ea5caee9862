import hashlib
import random
import zlib

import common as c
import numpy as np
import pytest

from mailsieve.llm import periodic as p
from mailsieve.llm import queries


def brute(words, least=24, times=3):
    """Every maximal run, by comparing all words ``q`` apart for every q."""
    ids = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, int)
    runs = []
    for q in range(1, len(words) // times + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edge = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = b - a + q
            if length < max(least, times * q):
                continue
            # A smaller period of so long a run divides q.
            if any(q % d == 0 and (ids[a + d : a + length] == ids[a : a + length - d]).all() for d in range(1, q)):
                continue
            runs.append((a, length, q))
    return sorted(runs)


def dropped(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % q] for i, w in enumerate(words)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, c.SPACED.findall(text or ""))
    runs = brute(words)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(dropped(words, runs)))


NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in c.documents(spark, sf).collect()}
    rows = queries.op12_periodic_runs(spark, sf).collect()
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in rows} == {i: expected(i, t) for i, t in texts.items()}
    assert sum(r.n_runs > 0 for r in rows) > 5


def structured(rng):
    """Words with runs, runs of runs, powers beside each other and noise."""
    words = [rng.choice("ab") for _ in range(rng.randrange(6))]
    for _ in range(rng.randrange(1, 5)):
        piece = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        words += piece * rng.randrange(1, 7) + piece[: rng.randrange(len(piece) + 1)]
        if rng.random() < 0.3:
            words = words * rng.randrange(1, 4)
        words += [f"n{rng.random()}" for _ in range(rng.randrange(3))]
    return words[:400]


@pytest.mark.parametrize("letters", ["a", "ab", "abc"])
def test_squares_of_random_words(letters):
    rng = random.Random(letters)
    for _ in range(400):
        words = [rng.choice(letters) for _ in range(rng.randrange(45))]
        found = p.squares_to_runs(words)
        assert sorted(found) == brute(words, 1, 2) and len(found) == len(set(found))


def test_structured_words_and_filter(spark):
    rng = random.Random(4)
    lists = [structured(rng) for _ in range(400)]
    rows = p.find_runs(c.frame(spark, [rng.choice([" ", "\n", " \t "]).join(w) for w in lists])).collect()
    some = 0
    for r in rows:
        want = brute(lists[r.doc_id])
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(lists[r.doc_id])
        assert r.collapsed == dropped(lists[r.doc_id], want)
        some += bool(want)
    assert some > 100


def test_fibonacci_and_single_letter():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    assert sorted(p.squares_to_runs(list(b))) == brute(list(b), 1, 2)
    assert p.squares_to_runs(["x"] * 5000) == [(0, 5000, 1)]


def test_filter_drops_texts_that_repeat_far_apart():
    rng = np.random.default_rng(0)
    passage = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
    words = np.concatenate([passage, rng.integers(1, 1 << 60, 100, dtype=np.uint64), passage, np.repeat(passage[:1], 30)])
    start, size = p.stretches(words, np.array([0, 60, len(words), len(words)]))
    assert list(zip(start.tolist(), size.tolist())) == [(len(words) - 30, 30)]


def test_words_are_split_at_white_space_only(spark):
    text = "é x ö\x0bz\x0cz \x1cq  " * 30
    row = p.find_runs(c.frame(spark, [text])).first()
    words = c.SPACED.findall(text)
    assert row.n_words == len(words) and [tuple(x) for x in row.runs] == brute(words) and row.runs


def test_edges(spark):
    docs = c.edge_docs(spark)
    rows = p.digest(p.find_runs(docs)).collect()
    assert len(rows) == len(c.EDGE)
    empty = (0, None, None, None, None, sha(""), sha(""))
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert tuple(r[n] for n in NAMES) == empty
        assert r.runs_sha256 and r.collapsed_sha256
    assert p.digest(p.find_runs(docs, text=p.planted_period())).count() == len(c.EDGE)
    assert p.digest(p.find_runs(c.no_docs(spark))).count() == 0
    # Ties of the exponent go to the run that starts first, exact fractions decide.
    text = " ".join(["a b"] * 15 + ["x"] + ["c d"] * 15 + ["y"] + ["e f g"] * 15)
    best = p.digest(p.find_runs(c.frame(spark, [text]))).first()
    assert (best.n_runs, best.start, best.length, best.period, best.exponent_milli) == (3, 0, 30, 2, 15000)
