"""Suffix arrays around the width of their first sort, on texts with zero bytes and short texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from barloom.llm import suffix


@pytest.mark.parametrize("length", [1, 3, 6, 7, 8, 9, 20])
def test_windows_of_odd_texts(length):
    rng = random.Random(length)
    for _ in range(60):
        texts = [bytes(rng.choices(b"\0\0ab\xff", k=rng.randrange(0, 45))) for _ in range(rng.randrange(1, 7))]
        texts += [texts[0], texts[0][3:], b""]
        found = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, mask in zip(texts, suffix.repeated_windows(texts, length), strict=True):
            want = [i + length <= len(t) and found[t[i : i + length]] > 1 for i in range(len(t))]
            assert mask.tolist() == want


def test_first_bytes_sort_as_the_strings():
    texts = [b"abc", b"\0", b"ab\0ab\0ab\0ab", b"abcabcabcabc"]
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    left = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(len(data))
    strings = [bytes(data[i : i + n])[: suffix.WIDE] for i, n in enumerate(left.tolist())]
    packed = suffix.first_bytes(data, left)
    assert sorted(range(len(data)), key=lambda i: strings[i]) == sorted(range(len(data)), key=lambda i: int(packed[i]))
    assert len(set(packed.tolist())) == len(set(strings))
