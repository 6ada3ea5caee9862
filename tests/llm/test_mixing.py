import math
import random
from collections import Counter

import common as c
import pytest

from mailsieve.llm import mixing as mx


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows, k = [], 0
    for source, n in (("big", 900), ("mid", 200), ("small", 60), ("tiny", 25)):
        for _ in range(n):
            rows.append((k, " ".join("w" for _ in range(rng.randrange(1, 40))), source))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def totals(df):
    out = Counter()
    for r in df.collect():
        out[r.source] += r.n_tokens
    return out


def sizes(df):
    out = Counter()
    for r in df.collect():
        out[r.source] += len(c.spaced(r.text))
    return out


def check(skewed, mixed, weights, total, longest=40):
    """Budgets are met but for less than one document, by whole rounds and a part of the last one."""
    have, got = sizes(skewed), totals(mixed)
    for s, w in weights.items():
        assert 0 <= total * w - got[s] + 0.51 <= longest + 1, s
    copies = Counter((r.doc_id, r.copy) for r in mixed.collect())
    assert max(copies.values()) == 1
    count = Counter(r.doc_id for r in mixed.collect())
    source = {r.doc_id: r.source for r in skewed.collect()}
    for d, s in source.items():
        assert count[d] - math.floor(total * weights[s] / have[s]) in (0, 1)


@pytest.mark.parametrize("limit, block", [(1.5, 1 << 18), (3.0, 100), (50.0, 7)])
def test_repetition_limit(skewed, limit, block):
    have = sizes(skewed)
    most, least, n = max(have.values()), min(have.values()), sum(have.values())
    exponent = max(0.0, 1 - math.log(limit) / math.log(most / least))
    z = sum((v / n) ** exponent for v in have.values())
    weights = {s: (v / n) ** exponent / z for s, v in have.items()}
    mixed = mx.mix(skewed, max_repeats=limit, block_tokens=block)
    check(skewed, mixed, weights, n * z * (most / n) ** (1 - exponent))
    assert len({r.doc_id for r in mixed.collect()}) == skewed.count()


def test_entropy_target_and_total(skewed):
    have = sizes(skewed)
    n = sum(have.values())
    entropy = lambda w: -sum(x * math.log(x) for x in w)
    weights = lambda a: [(v / n) ** a / sum((u / n) ** a for u in have.values()) for v in have.values()]
    target = (entropy(weights(1)) + entropy(weights(0))) / 2
    counted = skewed.withColumn("n_tokens", mx.word_count())
    table = mx.source_sizes(counted, "source", "n_tokens")
    found = mx.find_exponent(table, entropy=target)
    assert abs(entropy(weights(found)) - target) < 1e-4
    for block in (1 << 18, 300):
        mixed = mx.mix(skewed, entropy=target, total=5000.0, block_tokens=block)
        check(skewed, mixed, dict(zip(have, weights(found))), 5000.0)


def test_positions_spread_every_source(skewed):
    rows = mx.mix(skewed, max_repeats=3.0, block_tokens=50).collect()
    assert all(0 <= r.position < 1 for r in rows)
    for s in ("big", "tiny"):
        mine = [r.position for r in rows if r.source == s]
        assert abs(sum(mine) / len(mine) - 0.5) < 0.1


def test_rounds_have_orders_of_their_own_and_runs_agree(skewed):
    rows = mx.mix(skewed, max_repeats=50.0, block_tokens=20).collect()
    tiny = [[r.doc_id for r in sorted(rows, key=lambda r: r.position) if r.source == "tiny" and r.copy == k] for k in (0, 1)]
    assert sorted(tiny[0]) == sorted(tiny[1]) and tiny[0] != tiny[1]
    again = mx.mix(skewed.repartition(7), max_repeats=50.0, block_tokens=20).collect()
    assert {(r.doc_id, r.copy, r.position) for r in rows} == {(r.doc_id, r.copy, r.position) for r in again}


def test_impossible_targets(skewed):
    with pytest.raises(ValueError):
        mx.mix(skewed, max_repeats=1.5, total=1e9)
    with pytest.raises(ValueError):
        mx.mix(skewed, max_repeats=1.5, entropy=1.0)


def test_edges(spark):
    docs = c.edge_docs(spark)
    rows = mx.mix(docs).collect()
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in rows}) == [*((False, i) for i in range(1, 9)), (True, 0)]
    assert Counter(r.doc_id for r in rows)[7] >= 2 and Counter(r.doc_id for r in rows)[1] == 1
    mixed = mx.mix(docs)
    assert [x for x in docs.columns if x not in ("n_tokens", "copy", "block", "position")] == mixed.columns[:-4]
    assert mx.mix(c.no_docs(spark)).count() == 0
