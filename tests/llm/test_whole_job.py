"""Cases in which an operator once did less than its whole job."""

import random


def keys(n, seed, low=0.0, high=1.0):
    """Random keys of base 62 whose p-values lie between ``low`` and ``high``."""
    from clumpwise.llm.secret_scan import _ALPHABETS, encoding_of, randomness

    r, letters, out = random.Random(seed), dict(_ALPHABETS)["base62"], []
    while len(out) < n:
        k = "".join(r.choices(letters, k=30))
        if encoding_of(k) == ("base62", letters) and low <= randomness(k, letters) <= high:
            out.append(k)
    return out


def flagged(spark, runs):
    from clumpwise.llm.secret_scan import scan_secrets

    docs = spark.createDataFrame([(k, f"see {x} there") for k, x in enumerate(runs)], "doc_id long, text string")
    return [r.doc_id for r in scan_secrets(docs).collect() if any(s.kind == "random" for s in r.spans)]


def test_copies_of_a_run_are_one_draw(spark):
    found = flagged(spark, [*keys(600, 5), *keys(1, 6, 0.25, 0.3) * 3000])
    assert sum(k >= 600 for k in found) == 3000
    assert sum(k < 600 for k in found) > 540


def test_few_runs_are_tested_too(spark):
    assert len(flagged(spark, keys(3, 7, 0.1, 0.45))) == 3  # none above 1/2
    assert flagged(spark, ["ab12" * 8, "a1" * 15]) == []


def test_sparse_strata_take_in_the_nearest_lengths():
    from clumpwise.llm.secret_scan import LEAST, STEPS, pooled

    many, few, none = [LEAST] + [0] * (STEPS - 1), [0] * (STEPS - 1) + [1], [3] * STEPS
    got = pooled({"hex:20": many, "hex:24": few, "hex:256": none, "base62:24": few})
    assert got["hex:20"] == many and got["base62:24"] == few
    assert got["hex:24"] == [a + b for a, b in zip(many, few, strict=True)]
    assert sum(got["hex:256"]) == 150 + 1 + LEAST
