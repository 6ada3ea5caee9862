"""Orders and distinct values of hashes, and the packed forms of arrays, against numpy's own."""

import numpy as np
import pytest

from mailsieve.functions import bytewords as bw
from mailsieve.llm import chunks as ch
from mailsieve.llm import suffixtree as st

RNG = np.random.default_rng(5)
HASHES = {
    "none": np.zeros(0, np.uint64),
    "one": np.array([2**64 - 1], np.uint64),
    "equal": np.full(9, 7, np.uint64),
    "far": RNG.integers(0, 2**64, 5000, dtype=np.uint64, endpoint=False),
    "repeated": RNG.choice(RNG.integers(0, 2**64, 40, dtype=np.uint64, endpoint=False), 5000),
    "same leading bits": np.uint64(1 << 63) + RNG.integers(0, 300, 5000).astype(np.uint64),
}


@pytest.mark.parametrize("name", HASHES)
def test_distinct_hashes(name):
    values = HASHES[name]
    expected = np.unique(values, return_index=True, return_inverse=True)
    for got, want in zip(bw.distinct_hashes(values), expected):
        assert np.array_equal(got, want)
    numbers, times = bw.distinct_sorted(values.view(np.int64))
    expected = np.unique(values.view(np.int64), return_counts=True)
    assert np.array_equal(numbers, expected[0]) and np.array_equal(times, expected[1])


@pytest.mark.parametrize("form", [ch.pack, ch.squeeze])
def test_packed_arrays(form):
    arrays = [RNG.random(3 * ch.TRIED), np.sort(HASHES["far"]), np.arange(2 * ch.TRIED, dtype=np.uint32), np.zeros(0), np.ones(3, np.uint8)]
    for got, want in zip(ch.unpack(form(*arrays)), arrays, strict=True):
        assert got.dtype == want.dtype and np.array_equal(got, want)


def test_open_tokens_alone_are_looked_up():
    """The texts and places of a few tokens of a chunk, without those of all its tokens."""
    n = [3, 1, 4, 2]
    row = st.token_row(5, [1, 2, 3, 4], np.zeros(4, bool), np.array(n), np.array([9, 11], np.uint64), np.array([0, 1] * 5, np.uint32))
    t = st.Tokens(ch.Chunk(row.to_pylist()[0]))
    doc, place = t.places(np.array([1, 2, 5, 9]))
    assert doc.tolist() == [0, 0, 2, 3] and place.tolist() == [1, 2, 1, 1]
    assert t.back(np.array([5, 9]), np.array([1, 1]), 1).tolist() == [9, 9]
    assert not hasattr(t, "token")
