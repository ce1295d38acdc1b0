"""Groups of near copies of which some members link with few others or none."""

import random

import numpy as np
import pytest

from clumpwise.llm import jaccard_join as J
from tests.llm.test_operators import brute_components


def edited(n):
    r = random.Random(n)
    out = []
    for _ in range(n):
        words = [f"w{k}" for k in range(150)]
        for p in r.sample(range(5, 145), r.randint(1, 5)):
            words[p] = f"e{r.randrange(1 << 40)}"
        out.append(" ".join(words))
    return out


def cut_short(n):
    """Copies of a text, and copies that end early in words of their own: these link with each other only and share no list that is theirs alone."""
    r = random.Random(n)
    base = [f"w{k}" for k in range(104)]
    whole = [" ".join([*base[: (p := r.randrange(30, 70))], f"e{r.randrange(1 << 40)}", *base[p + 1 :]]) for _ in range(2 * n // 3)]
    return whole + [" ".join([*base[:84], *(f"z{r.randrange(1 << 40)}" for _ in range(9))]) for _ in range(n // 3)]


@pytest.mark.parametrize(("make", "easy"), [(edited, 1024), (cut_short, 16)])
def test_pairs_of_a_group_grow_with_its_members(spark, monkeypatch, make, easy):
    rows = list(enumerate(make(360)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    seen, real = [], J.probed
    monkeypatch.setattr(J, "EASY", easy, raising=False)
    monkeypatch.setattr(J, "probed", lambda pairs, sets: seen.append(pairs.count()) or real(pairs, sets))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_copies(docs).collect()}
    assert got == brute_components(rows)[0]
    assert sum(seen) < 16 * len(rows), seen


def test_parities_bound_the_difference():
    r = np.random.default_rng(3)
    core = r.integers(0, 1 << 63, 600, np.uint64)
    length = {int(x): int(n) for x, n in zip(core, r.integers(0, 9, 600), strict=True)}
    for changed in (0, 5, 40, 150):
        a, b = (np.unique(np.concatenate([core[r.permutation(600)[changed:]], r.integers(0, 1 << 63, changed, np.uint64)])) for _ in range(2))
        la, lb = (np.asarray([length.get(int(x), 0) for x in s]) for s in (a, b))
        common = np.intersect1d(a, b)
        t = min(common.tolist(), key=lambda x: (length.get(x, 0), x))
        asked = np.asarray([common[-1], t, common[0]], np.uint64)
        (pa, sa), (pb, sb) = J.parities(a, la, asked), J.parities(b, lb, asked)
        for s, n, pos in ((a, la, pa), (b, lb, pb)):
            order = s[np.lexsort((s, n))].tolist()
            assert pos.tolist() == [order.index(x) for x in asked.tolist()]
        differ = int(pa[1] + pb[1]) + sum(int(x).bit_count() for x in (sa[1] ^ sb[1]).view(np.uint64))
        true = len(np.setxor1d(a, b))
        assert differ <= true and (changed > 40 or differ >= 0.7 * true)
