"""Phrase search in slices of windows."""

import numpy as np
import pytest

from clumpwise.llm import phrase_index as I
from clumpwise.llm.textops import ALNUM, word_hashes, word_spans


def _postings(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = word_spans(data, np.asarray([0, len(data)]), ALNUM)
    h = word_hashes(data, start, end).view(np.int64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[cuts], np.append(cuts, len(h)), order.astype(np.int64)


@pytest.mark.parametrize("starts", [1, 7, 100, 1 << 17])
def test_slices_of_windows_find_the_same(monkeypatch, starts):
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in r.integers(0, 30, 3000)]
    words += words[200:260]  # a passage that stands twice
    moved = [*words[500:504], "w3", *words[505:520]]  # one word off: near in most places
    items = [("a", " ".join(words[200:240])), ("b", " ".join(moved)), ("c", "w1 w2"), ("d", "w0 nowhere w1")]
    q = I.windows_of(items)
    monkeypatch.setattr(I, "STARTS", starts)
    win, start, exact = I.matches(q, *_postings(words), I.SLOP)
    got = {(int(w), int(s)): bool(e) for w, s, e in zip(win, start, exact, strict=True)}
    assert len(got) == len(win)

    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    b, e, _ = word_spans(data, np.asarray([0, len(data)]), ALNUM)
    h = word_hashes(data, b, e).view(np.int64)
    at = {int(t): np.flatnonzero(h == t) for t in np.unique(h)}
    want = {}
    for w, row in enumerate(q["windows"]):
        terms = [int(q["terms"][t]) for t in row if t >= 0]
        for s in range(-I.SLOP, len(h) + I.SLOP):
            off = [np.abs(at.get(t, np.asarray([10**9])) - (s + k)).min() for k, t in enumerate(terms)]
            if max(off) <= I.SLOP:
                want[w, s] = max(off) == 0
    assert got == want and sum(want.values()) > 60
