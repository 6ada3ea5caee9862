import hashlib
import random
from collections import Counter

import common as c
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from mailsieve.llm import queries
from mailsieve.llm import spotsigs as s

WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text):
    return WORD.findall((text or "").lower())


def common_words(texts, share=s.ANCHOR_SHARE, least=s.ANCHOR_DOCS):
    seen = Counter(w for t in texts for w in set(words(t)))
    return {w for w, n in seen.items() if n >= max(share * len(texts), least)}


def signatures(text, anchors, chain=s.CHAIN, distance=s.DISTANCE):
    w = words(text)
    anchors = {x for x in w if x in anchors or xxhash.xxh64_intdigest(x.encode(), 42) % s.ANCHOR_EVERY == 0}
    content = [i for i, x in enumerate(w) if x not in anchors]
    if not content:
        return {tuple(w)} if w else set()
    out = set()
    for at in [-1, *(i for i, x in enumerate(w) if x in anchors)]:
        after = [w[i] for i in content if i > at][: (chain - 1) * distance + 1 : distance]
        if after:
            out.add(("" if at < 0 else w[at], *after))
    return out


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """{id: (n_chars, sha256 of the edited text, signatures, edited signatures, near_edited, near_next)}."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    anchors = common_words([t for _, t in rows])
    sets = [signatures(t, anchors) for _, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[after][1][:half]
        own = signatures(edited, anchors)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), sets[k], own, alike(sets[k], own), alike(sets[k], sets[after]))
    return out


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        n, sha, own, edited, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert len(r.fingerprint) == 16 * len(own) and len(r.edited_fingerprint) == 16 * len(edited)
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
    prints = {r.doc_id: r.fingerprint for r in rows}
    by_print, by_set = {}, {}
    for i, p in prints.items():
        by_print.setdefault(p, set()).add(i)
        by_set.setdefault(frozenset(want[i][2]), set()).add(i)
    assert sorted(map(sorted, by_print.values())) == sorted(map(sorted, by_set.values()))


def test_query_equals_brute_force(spark, sf):
    texts = [(r.doc_id, r.text) for r in c.documents(spark, sf).collect()]
    check(queries.op11_spotsigs(spark, sf).collect(), expected(texts))


@pytest.mark.parametrize("bucket_bytes", [200, 3000])
def test_neighbours_across_many_ranges(spark, bucket_bytes):
    rng = random.Random(bucket_bytes)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i * 7 - 90, " ".join(rng.choice(pool) for _ in range(rng.randrange(30)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(s.digest(s.compare_neighbours(docs, bucket_bytes=bucket_bytes)).collect(), expected(rows))


def test_only_dataframe_functions(spark, sf, capsys):
    queries.op11_spotsigs(spark, sf).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDD"))
    # One shuffle of the texts; the borrowed rows have one of their own.
    assert plan.count("Exchange hashpartitioning(bucket") == 2


def test_similar_sets_lose_no_link(spark):
    rng = random.Random(3)
    bases = [[rng.getrandbits(62) for _ in range(rng.randrange(1, 40))] for _ in range(25)]
    shared = [rng.getrandbits(62) for _ in range(30)]
    sets = []
    for i in range(400):
        base = set(rng.choice(bases)) | set(shared if i % 3 else [])
        for _ in range(rng.randrange(6)):
            base.discard(rng.choice(sorted(base) or [0])) if rng.random() < 0.5 else base.add(rng.getrandbits(62))
        sets.append(sorted(base))
    sets += [[], [], sets[0]]
    docs = spark.createDataFrame(list(enumerate(sets)), "doc_id long, spots array<long>")
    for threshold in (0.5, 0.8, 1.0):
        pairs, members = s.similar_sets(docs, threshold=threshold)
        least = {}
        for i, x in enumerate(sets):
            least.setdefault(tuple(x), i)
        assert {r.doc_id: r.class_id for r in members.collect()} == {i: least[tuple(x)] for i, x in enumerate(sets)}
        names = sorted(least.items(), key=lambda kv: kv[1])
        want = {}
        for x, (a, i) in enumerate(names):
            for b, j in names[x + 1 :]:
                k = alike(set(a), set(b))
                if a and b and k >= threshold:
                    want[i, j] = k
        got = {(min(r.a, r.b), max(r.a, r.b)): r.likeness for r in pairs.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_near_copies_are_alike_and_others_are_not(spark, sf):
    docs = c.documents(spark, sf).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and len(r.text) > 800]
    near = [(i + 1_000_000, t.replace(words(t)[20], "otherword", 1)) for i, t in rows[:40]]
    both = spark.createDataFrame(rows + near, "doc_id long, text string")
    pairs, members = s.similar_sets(s.compare_neighbours(both))
    of = {r.doc_id: r.class_id for r in members.collect()}
    found = {frozenset((r.a, r.b)) for r in pairs.collect()}
    assert sum(of[i] == of[i + 1_000_000] or frozenset((of[i], of[i + 1_000_000])) in found for i, _ in rows[:40]) >= 36


def test_edges(spark):
    docs = c.edge_docs(spark).withColumns({x: F.lit("extra") for x in ("id", "bucket", "borrowed", "next", "spots", "fingerprint")})
    rows = s.digest(s.compare_neighbours(docs)).collect()
    assert len(rows) == len(c.EDGE)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_chars == 0 and by[1].fingerprint == by[3].fingerprint == "" and by[4].fingerprint
    assert by[6].near_next == 1.0 and by[6].near_edited < 1 and by[5].fingerprint == by[6].fingerprint
    # After the first in ascending order comes the row without an id, then the last.
    assert by[1].near_next == 0.0 and by[2].near_next == 1.0 and by[3].near_next == 1.0
    assert by[None].near_next == 0.0 and all(0 <= r.near_edited <= 1 for r in rows)
    assert s.digest(s.compare_neighbours(c.no_docs(spark))).count() == 0
    one = s.digest(s.compare_neighbours(c.frame(spark, ["alone in the table"]))).first()
    assert one.near_next == 1.0 and one.n_chars == 18
    pairs, members = s.similar_sets(s.compare_neighbours(c.no_docs(spark)))
    assert pairs.count() == 0 and members.count() == 0
    nulls = spark.createDataFrame([(None, f"text {i}") for i in range(5)], "doc_id long, text string")
    assert s.compare_neighbours(nulls).count() == 5
