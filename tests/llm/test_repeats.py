import hashlib
import random
import re
from collections import Counter

import common as c
import pytest

from mailsieve.llm import chunks as ch
from mailsieve.llm import repeats as rp


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return (row[0] is None, *(x if x is not None else 0 for x in row))


def same(got, want):
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_defaults_equal_brute_force(spark, sf):
    docs = c.documents(spark, sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same(rp.remove_repeats(docs).collect(), brute(rows, 200))


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("size", [1 << 12, 300])
def test_passages_overlaps_and_runs(spark, monkeypatch, seed, size):
    """Small alphabets, shared passages with different surroundings, and texts that repeat themselves."""
    rng = random.Random(seed)
    make = lambda n, letters="abé": "".join(rng.choice(letters) for _ in range(n))
    passages = [make(rng.randrange(15, 60)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [make(rng.randrange(20), "abcdefgh") for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(["", rng.choice(passages)[5:]]) + parts[2])
    texts += ["x" * 70, "xy" * 40, texts[0], texts[0], "", None, "short"]
    monkeypatch.setattr(rp, "SEGMENT", 64)
    monkeypatch.setattr(ch, "CHUNK_BYTES", size)
    docs = c.frame(spark, texts).repartition(3)
    same(rp.remove_repeats(docs, length=20, gram=8, group=5).collect(), brute(list(enumerate(texts)), 20))


def test_edges(spark):
    rows = [r[:2] for r in c.EDGE]
    same(rp.remove_repeats(c.edge_docs(spark)).collect(), brute_long(rows))
    assert rp.remove_repeats(c.no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        rp.remove_repeats(c.no_docs(spark), length=10, gram=20)


def brute_long(rows):
    """Only equal long texts repeat among the edge rows, so whole ones go."""
    count = Counter(t for _, t in rows)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = len(b) >= 200 and count[t] > 1
        out.append((i, len(b), len(b) if gone else 0, int(gone), hashlib.sha256(b"" if gone else b).hexdigest()))
    return out


def test_remaining_bytes(spark):
    text = "0123456789" * 3
    rows = rp.remove_repeats(c.frame(spark, ["<<" + text, text + ">>"]), length=25, gram=10, group=4, texts=True).collect()
    assert sorted(bytes(r.kept) for r in rows) == [b"<<", b">>"]
