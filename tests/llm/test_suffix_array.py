"""Suffix arrays and common prefixes against sorting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pedolake.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_order_and_prefixes(letters):
    s = np.array(letters, np.uint16)
    order = suffix_array(s, 4)
    want = sorted(range(len(s)), key=lambda i: letters[i:])
    assert order.tolist() == want
    room = len(s) - np.arange(len(s))
    shared = common_prefixes(s.astype(np.uint8), order, room, 5)
    for a, b in zip(want, want[1:], strict=False):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert (shared[b] >= 5) == (n >= 5) and (n >= 5 or shared[b] == n)
