import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import _suffix_array as sa


def plain(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


def shared(s, i, j):
    k = 0
    while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
        k += 1
    return k


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.booleans())
def test_as_sorted(body, by_bucket):
    s = [*body, 0]
    kept = sa._BY_BUCKET
    sa._BY_BUCKET = 1 << 20 if by_bucket else 0
    try:
        order = sa.suffix_array(np.array(s, dtype=np.uint16))
    finally:
        sa._BY_BUCKET = kept
    assert order.tolist() == plain(s)
    stop = len(s) - np.arange(len(s))
    got = sa.common_prefixes(np.array(s, dtype=np.uint16), order, stop, np.zeros(len(s), bool))
    assert [got[j] for j in order[1:]] == [shared(s, i, j) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]


@pytest.mark.parametrize("s", [[1] * 300, [1, 2] * 200, [2, 1] * 200, [3, 2, 1] * 100 + [1] * 50, list(range(1, 300)), list(range(300, 0, -1))])
def test_regular(s):
    assert sa.suffix_array(np.array([*s, 0], dtype=np.uint16)).tolist() == plain([*s, 0])


def test_random_long():
    rng = np.random.default_rng(2)
    s = np.append(rng.integers(1, 30, 200_000), 0).astype(np.uint16)
    s[100_000:150_000] = s[:50_000]
    order = sa.suffix_array(s)
    raw = s.astype(">u2").tobytes()
    assert sorted(order.tolist()) == list(range(len(s)))
    assert all(raw[2 * i : 2 * i + 120_000] < raw[2 * j : 2 * j + 120_000] for i, j in zip(order[:-1:97].tolist(), order[1::97].tolist(), strict=True))
