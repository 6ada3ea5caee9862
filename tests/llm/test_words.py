import gc
import random
import re
import weakref

import common as c
import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from mailsieve.llm import bytewords as bw

TEXTS = ["", "a", "  a  b", "Ab-Cd", "É é", "x\n\ny\t z", "漢 字 k", "a.b", "\x00q", " ", "zZ9"]


@pytest.mark.parametrize("rule, pattern", [(bw.SPACED, c.SPACED), (bw.ALNUM, c.WORD)])
def test_words_equal_the_patterns(rule, pattern):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("aZ9 .,\né字\t-") for _ in range(rng.randrange(30))) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"text": [*texts, None]})
    seen = []
    for rows, data, offsets in bw.text_blocks([batch], "text", 64):
        low = bw.LOWER[data]
        start, end, first = bw.word_spans(low, offsets, rule)
        found = [low[a:b].tobytes().decode() for a, b in zip(start, end)]
        hashes = bw.word_hashes(low, start, end)
        seen += [(found[a:b], hashes[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    want = [pattern.findall(t.translate(c.LOW)) for t in texts] + [[]]
    assert [w for w, _ in seen] == want
    names = {w: h for ws, hs in seen for w, h in zip(ws, hs)}
    assert all(names[w] == h for ws, hs in seen for w, h in zip(ws, hs))
    assert len(set(names.values())) == len(names)


def test_sliced_and_wide_columns_give_the_same_blocks():
    texts = pa.array(["drop", "one two", None, "three"])
    for column in (texts.slice(1), texts.cast(pa.large_string()).slice(1)):
        got = [bytes(d) for _, d, _ in bw.text_blocks([pa.RecordBatch.from_arrays([column], names=["text"])], max_bytes=1)]
        assert got == [b"one two", b"", b"three"] or b"".join(got) == b"one twothree"


def test_joined_windows_are_equal_only_for_equal_words():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 500).astype(np.uint64)
    joined = bw.join_hashes(words, 4)
    by = {}
    for i, h in enumerate(joined.tolist()):
        by.setdefault(tuple(words[i : i + 4].tolist()), set()).add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_ranges_are_joined():
    assert bw.take_ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert re.fullmatch(r"\[\]", str(bw.take_ranges(np.array([], int), np.array([], int)).tolist()))


def test_what_a_task_set_aside_goes_with_the_next_one():
    """Every task has a copy of the library; the copies of ended tasks hold no memory."""

    class Held:
        pass

    class Running:
        get = staticmethod(lambda: True)

    packed, left = cloudpickle.dumps(bw.give_back), []
    try:
        for _ in range(4):
            copy = cloudpickle.loads(packed)
            held = Held()
            copy.__globals__.update(TaskContext=Running, own=copy, held=held)
            left.append(weakref.ref(held))
            copy()
            del copy, held
        assert [r() for r in left[:-1]] == [None] * 3
    finally:
        gc.unfreeze()
