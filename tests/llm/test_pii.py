import hashlib
import random
import re
import time

import common as c
import numpy as np
import pytest

from mailsieve.llm import pii, queries

# The patterns as they are stated, without the forms that avoid rescanning.
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def fine(kind, span):
    digits = [int(x) for x in span if x.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, text or "") if fine(k, m.group())]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def flat(text):
    return [(k, a, b) for k, spans in pii.base_spans(text).items() for a, b in spans]


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    bits = ["4111111111111111", "@", "a.b", "x", ".", "1", "25", "300", "+1", " ", "-", "(", ")", "é", "5500 0000 0000 0004", "a@b.c", "%", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        assert flat(text) == brute(text), text


@pytest.mark.parametrize("text", ["a@b.c@d.e", "a@@b.c", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "0300.1.1.1 000255.1.1.1", "+1 (988) 555-2485)", "@a.b", "😀a@b.c"])
def test_base_spans_of_odd_texts(text):
    assert flat(text) == brute(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 200_000, "a.b@c-" * 40_000])
def test_long_runs_take_linear_time(text):
    start = time.time()
    base = pii.base_spans(text)
    list(pii.loose_spans(text, base))
    assert time.time() - start < 10


@pytest.mark.parametrize("at", ["(at)", "[at]", "{at}", " at ", " (at) ", " [at] ", " {at} "])
@pytest.mark.parametrize("dot", ["(dot)", "[dot]", "{dot}", " dot ", ".", " (dot) ", " [dot] ", " {dot} "])
def test_spelled_addresses_are_candidates_when_alone(at, dot):
    text = f"write to john{at}example{dot}com"
    assert list(pii.loose_spans(text, pii.base_spans(text))) == [("email", 9, len(text))]


@pytest.mark.parametrize(
    "text, start",
    [
        ("mail " + "x" * 80 + " (at) example.com", 5),
        ("john (AT) example (DOT) com", 0),
        ("to JOHN At Example dOt Org", 3),
        ("at " + "y" * 200 + "[aT]" + "z" * 90 + "{Dot}" + "w" * 70 + ".a1.b2.c3.d4.e5", 3),
    ],
)
def test_spelled_addresses_of_any_case_and_length(text, start):
    assert list(pii.loose_spans(text, pii.base_spans(text))) == [("email", start, len(text))]


@pytest.mark.parametrize("text", ["a" * 300_000 + " at", "a at " * 60_000, "a(at)b." * 40_000, "a(at)" * 60_000, "(at)" * 70_000 + "a.", ". at a dot " * 30_000])
def test_spelled_addresses_take_linear_time(text):
    start = time.time()
    list(pii.loose_spans(text, pii.base_spans(text)))
    assert time.time() - start < 5


def plain_estimate(found):
    """{(kind, votes): likelihood} by the update rules one candidate at a time; ``found`` lists (kind, votes, features) with repeats."""
    sign = {"+": 1, "-": -1, "0": 0}
    likely = {c[:2]: 1 / (1 + np.exp(-sum(w * sign[v] for w, v in zip(pii.START_WEIGHTS, c[1])))) for c in found}
    for _ in range(100):
        before, after = dict(likely), {}
        for kind in {c[0] for c in found}:
            mine = [c[1] for c in found if c[0] == kind]
            yes = sum(before[kind, v] for v in mine)
            no = len(mine) - yes
            for votes in set(mine):
                score = np.log((yes + 1) / (no + 1))
                for j, v in enumerate(votes):
                    told = sum(before[kind, m] for m in mine if m[j] == v)
                    score += np.log((told + 1) / (yes + 3)) - np.log((sum(m[j] == v for m in mine) - told + 1) / (no + 3))
                after[kind, votes] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        likely = after
        if max(abs(likely[k] - before[k]) for k in likely) < 1e-6:
            break
    return likely


def test_added_spans_equal_a_rebuild(spark):
    """Candidates, votes, likelihoods and the classifier again: EM by single candidates, the weights by plain gradient descent."""
    rng = random.Random(8)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    texts = [f"call {number()} now" for _ in range(25)] + [f"write to u{k} (AT) example (dot) com" for k in range(15)] + [f"mail u{k}@example.org" for k in range(20)]
    texts += [f"order no {rng.randrange(10**14, 10**15)}" for _ in range(25)] + [f"x at home.and so on {k}" for k in range(10)] + [f"id={number()}=" for _ in range(8)]
    scanned = []
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        spans = [(k, a, b, True) for k in pii.KINDS for a, b in base[k]] + [(*s, False) for s in pii.loose_spans(t, base)]
        scanned += [(i, s, pii.votes(t, *s), pii.features(t, *s[:3])) for s in spans]
    found = [(s[0], v, f) for _, s, v, f in scanned]
    likely = plain_estimate(found)
    target = np.array([likely[k, v] for k, v, _ in found])
    names = sorted({p for *_, f in found for p in pii.parts(f)})
    x = np.array([[1.0, *(p in pii.parts(f) for p in names)] for *_, f in found])
    w = np.zeros(x.shape[1])
    for _ in range(20_000):
        step = x.T @ (1 / (1 + np.exp(-(x @ w))) - target) + w
        w -= step / (0.25 * np.linalg.norm(x, 2) ** 2 + 1)
    verdict = x @ w
    assert np.abs(verdict).min() > 1e-3
    want = {i: [] for i in range(len(texts))}
    for (i, s, *_), z in zip(scanned, verdict):
        if s[3] or z >= 0:
            want[i].append(s[:3])
    order = lambda s: (pii.KINDS.index(s[0]), *s[1:])
    got = {r.doc_id: r.spans for r in pii.find_personal_data(c.frame(spark, texts)).collect()}
    assert got == {i: joined(sorted(s, key=order)) for i, s in want.items()}
    assert sum(not s[3] for _, s, *_ in scanned) > 50


def test_loose_addresses_of_random_texts():
    rng = random.Random(5)
    bits = ["john", "example", "com", "at", "dot", " at ", " dot ", "(at)", "[at]", "{at}", "(at", "(dot)", "[dot]", "{dot}", ".", " ", "-", "é", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(16)))
        want = [("email", *m.span()) for m in pii.LOOSE["email"].finditer(text)]
        assert list(pii.loose_spans(text, pii.base_spans(text))) == want, text


def test_query_equals_the_patterns(spark, sf):
    texts = {r.doc_id: r.text for r in c.documents(spark, sf).collect()}
    rows = queries.op5_weak_supervision(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))
        assert r.spans == joined(sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in filter(None, r.spans.split(",")))), key=lambda s: (pii.KINDS.index(s[0]), *s[1:])))


def test_estimation_finds_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.4
    right = [0.95, 0.9, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) * 2 - 1 for a in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    likely, rates = pii.estimate(np.full(len(patterns), 3), patterns, counts)
    assert np.abs(rates[3, :, 0] - right).max() < 0.03
    lookup = {tuple(p): v for p, v in zip(patterns.tolist(), likely)}
    assert np.mean([(lookup[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.95


def test_method_adds_what_the_patterns_miss(spark):
    rng = random.Random(0)
    base = [f"write to user{k}@mail.example.com or call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today" for k in range(200)]
    loose = [f"please call ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} today" for _ in range(60)]
    wrong = [f"invoice no {rng.randrange(10**15, 10**16)}7 section" for _ in range(60)]
    wrong = [w for w in wrong if not brute(w)]
    rows = {r.doc_id: r for r in pii.find_personal_data(c.frame(spark, base + loose + wrong)).collect()}
    assert all(rows[i].n_phone == 1 and rows[i].n_email == 1 for i in range(200))
    assert sum("phone" in rows[i].spans for i in range(200, 260)) >= 55
    assert not any(rows[i].spans for i in range(260, 260 + len(wrong)) if not pii.luhn(re.sub(r"\D", "", wrong[i - 260])))


def test_edges(spark):
    rows = pii.find_personal_data(c.edge_docs(spark)).collect()
    assert len(rows) == len(c.EDGE) and all(r.spans == "" and r.n_card == 0 for r in rows)
    assert pii.find_personal_data(c.no_docs(spark)).count() == 0
