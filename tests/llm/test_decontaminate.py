import hashlib
import random

import common as c
import pytest

from mailsieve.llm import decontaminate as dc


def brute(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = c.words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in rows:
        w, hit, ids = c.words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def same(df, want):
    assert sorted((tuple(r) for r in dc.digest(df).collect()), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(n) for n in (1, 2, 3, 9, 10, 11, 25, 40, 40)] + [[], make(12)]
    items.append(items[6][3:20] + make(5))
    texts = []
    for _ in range(60):
        item = rng.choice(items)
        cut = rng.randrange(len(item) + 1)
        texts.append(" ".join(make(rng.randrange(40)) + item[cut // 2 :] + make(3)))
    return list(enumerate(texts)), [(i, " ".join(w).title()) for i, w in enumerate(items)]


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("pass_words", [dc.PASS_WORDS, 40])
def test_equals_brute_force(spark, mixed, pass_words):
    docs, items = frames(spark, *mixed)
    same(dc.match_benchmark(docs, items, pass_words=pass_words), brute(*mixed))


def test_items_of_whole_windows_only(spark, mixed):
    rows, items = mixed[0], [i for i in mixed[1] if len(c.words(i[1])) >= 10]
    same(dc.match_benchmark(*frames(spark, rows, items)), brute(rows, items))


def test_longest_match_and_removal(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs, items = frames(spark, [(1, "x y " + " ".join(f"i{k}" for k in range(5, 22)) + " z"), (2, "clean words only")], [(9, item)])
    found = {r.doc_id: r for r in dc.match_benchmark(docs, items).collect()}
    assert tuple(found[1].longest) == (17, 2, 5, "9") and found[2].longest is None
    assert [tuple(s) for s in found[1].hit_spans] == [(2, 18)]
    assert [r.doc_id for r in dc.remove_contaminated(docs, items).collect()] == [2]


def test_edges(spark):
    items = [(1, "one two"), (2, None), (3, ""), (None, "unicode"), (4, c.LONG[:400]), (4, c.LONG[:400])]
    docs = c.edge_docs(spark)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    same(dc.match_benchmark(docs, benchmark), brute([r[:2] for r in c.EDGE], items))
    same(dc.match_benchmark(docs, benchmark.limit(0)), brute([r[:2] for r in c.EDGE], []))
    assert dc.match_benchmark(c.no_docs(spark), benchmark).count() == 0
    assert dc.remove_contaminated(docs, benchmark).columns == docs.columns


def brute_longest(text, items, window=10):
    """(words, place in the text) of the longest match, and all (id, place in the item) that share it."""
    w, found = c.words(text), {}
    for i, t in items:
        v = c.words(t)
        for a in range(len(w)):
            for b in range(len(v)):
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                if n >= min(window, len(v)):
                    found.setdefault((-n, a), []).append((str(i), b))
    return min(found.items()) if found else None


@pytest.mark.parametrize("pass_words", [dc.PASS_WORDS, 40])
def test_longest_match_is_the_longest_of_all_items(spark, mixed, pass_words):
    """Items begin alike and part; the text goes on with a later one."""
    rows, items = mixed
    head = [f"h{i}" for i in range(12)]
    more = [(100 + k, " ".join(head + [f"t{k}{i}" for i in range(8)])) for k in range(4)] + [(110, " ".join(head)), (111, "")]
    items = items + more
    rows = rows + [(1000 + k, f"x y {t} z") for k, (_, t) in enumerate(more)] + [(1010, " ".join(head[1:] + ["t20", "t21", "other"]))]
    docs, items_df = frames(spark, rows, items)
    found = {r.doc_id: r.longest for r in dc.match_benchmark(docs, items_df, pass_words=pass_words).collect()}
    assert (found[1003].n_words, found[1003].item_id) == (20, "103") and (found[1010].n_words, found[1010].item_id) == (13, "102")
    for i, t in rows:
        want = brute_longest(t, items)
        if want is None:
            assert found[i] is None
        elif pass_words == dc.PASS_WORDS:
            assert (-found[i].n_words, found[i].doc_word) == want[0] and (found[i].item_id, found[i].item_word) in want[1]
        else:
            assert -found[i].n_words == want[0][0]
