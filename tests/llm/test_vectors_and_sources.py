"""Vector codes, scaled sketches and source audits against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clumpwise.llm import scaled_sketch, source_audit, vector_codes

# --- vector codes ------------------------------------------------------------


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """{row: (code, error)} and codebooks of (vec_id, ints) rows, by full scans in Python integers."""
    order = sorted(vectors, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    cut = lambda x: [x[k * len(x) // parts : (k + 1) * len(x) // parts] for k in range(parts)]
    books = [[list(cut(x)[p]) for _, x in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, x in order:
                held.setdefault(nearest(cut(x)[p], p), []).append(cut(x)[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    codes = [[nearest(q, p) for p, q in enumerate(cut(x))] for _, x in vectors]
    errors = [sum(far(q, books[p][c]) for p, (q, c) in enumerate(zip(cut(x), code, strict=True))) for (_, x), code in zip(vectors, codes, strict=True)]
    return ["".join(f"{c:02x}" for c in code) for code in codes], errors, books


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, code string, kind string")


def test_codes_against_full_scans(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (300, 16)) / 8.0  # coarse: many ties and equal distances
    x[:8] = x[0]  # equal first entries
    rows = [(int(k), [float(c) for c in v], int(k) % 3 or None, "a", "b", "c") for k, v in enumerate(x)]
    rows += [(500, None, 1, "", "", ""), (501, [1.0] * 15 + [None], 1, "", "", ""), (502, [float("nan")] + [0.0] * 15, 1, "", "", ""), (503, [float("inf")] + [0.0] * 15, 1, "", "", "")]
    rows += rows[40:60]
    found = vector_codes.compressed(vectors_of(spark, rows).repartition(3)).collect()
    kept = [(r[0], [int(np.floor(4096 * c)) for c in r[1]]) for r in rows if r[0] < 500]
    codes, errors, books = plain_codes(kept)
    assert sorted((r.vec_id, r.code, r.error) for r in found) == sorted(zip([k for k, _ in kept], codes, errors, strict=True))
    sums = Counter()
    for (k, _), e in zip(kept, errors, strict=True):
        sums[k % 3 or None] += e
    assert all(r.label_error == sums[r.vec_id % 3 or None] for r in found)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in found} == {sha}


def test_codes_of_few_none_and_uneven(spark):
    one = [(7, [0.5] * 8, None, "", "", "")]
    got = vector_codes.compressed(vectors_of(spark, one)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in got] == [(7, "00" * 8, 0, 0)]
    assert vector_codes.compressed(vectors_of(spark, [])).collect() == []
    assert vector_codes.compressed(vectors_of(spark, [(1, None, 1, "", "", "")])).collect() == []
    mixed = [(1, [0.5] * 8, 1, "", "", ""), (2, [0.5] * 16, 1, "", "", ""), (3, [0.5] * 7, 2, "", "", ""), (None, [], 2, "", "", "")]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compressed(vectors_of(spark, mixed)).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: (None, None, 0), 3: (None, None, None), None: (None, None, None)}
    with pytest.raises(Exception, match="leaves"):
        vector_codes.compressed(vectors_of(spark, [(1, [1e30] * 8, 1, "", "", "")])).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_never_change_a_result(seed):
    rng = np.random.default_rng(seed)
    wide = int(rng.integers(1, 5))
    x = rng.integers(-6, 7, (int(rng.integers(1, 200)), wide))
    book = vector_codes.Codebook.first(rng.integers(-6, 7, (int(rng.integers(1, 17)), wide)))
    code, upper, lower = vector_codes.assign(x, book)
    for _ in range(8):
        n = len(book.entries)
        sums = np.zeros((n, wide), np.int64)
        np.add.at(sums, code, x)
        book = book.after(sums, np.bincount(code, minlength=n))
        upper, lower = (a.astype(float) for a in vector_codes._outward(upper, lower))
        code, upper, lower, _ = vector_codes.reassign(x, book, code, upper, lower)
        assert (code == vector_codes.squared(x, book.entries).argmin(1)).all()


def test_bounds_spare_scans():
    rng = np.random.default_rng(0)
    centre = rng.integers(-2000, 2000, (16, 8))
    x = centre[rng.integers(0, 16, 4000)] + rng.integers(-100, 100, (4000, 8))
    book = vector_codes.Codebook.first(x[:16])
    code, upper, lower = vector_codes.assign(x, book)
    scans = []
    for _ in range(6):
        sums = np.zeros((16, 8), np.int64)
        np.add.at(sums, code, x)
        book = book.after(sums, np.bincount(code, minlength=16))
        code, upper, lower, n = vector_codes.reassign(x, book, code, upper, lower)
        scans.append(n)
    assert scans[-1] < 0.5 * 4000 * len(book.members)


# --- scaled sketches ---------------------------------------------------------


def plain_sketch(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if x]
    shingles = {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    h = sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles})
    return [x for x in h if x < "2"] or h[:1]


def plain_likeness(a, b):
    return float(len(a) == len(b)) if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))


def plain_audit(rows):
    """Rows of (doc_id, text) in their order to results, ties left to the given order."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(u)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def prose(rng, n):
    return " ".join(rng.choice(["Oak", "elm", "ash", "yew", "fir", "bay", "é\U0001f333", "box"]) + str(rng.randrange(40)) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, next string, sketch string")


def test_sketches_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(k * 7 - 300, prose(rng, rng.choice([0, 1, 3, 5, 40, 200]))) for k in range(150)]
    rows[10], rows[11], rows[12] = (rows[10][0], None), (rows[11][0], ""), (rows[12][0], prose(rng, 6000))
    rows.append((2**62 + 1, prose(rng, 30)))
    rows.append((2**62, prose(rng, 30)))  # differ beyond a double's digits
    want = plain_audit(sorted(rows, key=lambda r: -r[0]))
    got = scaled_sketch.audit(docs_of(spark, rows).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("ranges", [(1, 1 << 16), (4, 8), (1000, 5)])
def test_next_document_over_ranges_and_repeated_ids(spark, ranges):
    rng = random.Random(9)
    rows = [(k % 23 if k % 3 else 5, f"t{k % 31} {rng.random()}" if k % 4 else f"t{k % 3}") for k in range(120)] + [(None, "n1"), (None, "n2"), (None, None)]
    docs = docs_of(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r[1]]))
    want = Counter((a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    got = scaled_sketch.with_next(docs.repartition(4), (), *ranges).select("doc_id", "text", "next.text").collect()
    assert Counter(((r[0], r[1]), r[2]) for r in got) == want


def test_sketches_of_one_and_of_no_document(spark):
    assert [tuple(r) for r in scaled_sketch.audit(docs_of(spark, [(4, "a b c d e f")])).collect()] == plain_audit([(4, "a b c d e f")])
    assert scaled_sketch.audit(docs_of(spark, [])).collect() == []


def test_merged_sketches_estimate_containment(spark):
    rng = random.Random(1)
    a, b = prose(rng, 3000), prose(rng, 150)
    rows = scaled_sketch.with_sketch(scaled_sketch.with_sketch(docs_of(spark, [(0, a + " " + b)]).withColumn("b", F.lit(b)), "text", "s"), "b", "t")
    r = rows.select(scaled_sketch.containment(F.col("t"), F.col("s")), scaled_sketch.containment(F.col("s"), F.col("t")), scaled_sketch.merged(F.col("t"), F.col("s")) == F.col("s")).first()
    assert r[0] == 1.0 and r[1] < 0.15 and r[2]
    e = spark.range(1).select(scaled_sketch.merged(F.array(F.lit("9")), F.array(F.lit("8"))), scaled_sketch.merged(F.array(F.lit("9")), F.array(F.lit("1")))).first()
    assert e[0] == ["8"] and e[1] == ["1"]


# --- source audit ------------------------------------------------------------


def plain_sources(rows, least, top):
    import re

    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least]
        v = len(kept)
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + (10**9 * (c[t] + 2)) // (sum(c.values()) + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in count.items():
            pairs = [(o, sum(f(p(c, t), p(d, t)) for t in kept)) for o, d in count.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, value, k + 1) for k, (i, value) in enumerate(items)]
    return sorted(out)


def sources_of(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "text string, lang string, source string, term string, n int")


@pytest.mark.parametrize("size", [(256, 20_000), (3, 7)])
def test_divergences_against_a_plain_version(spark, size):
    rng = random.Random(2)
    vocabulary = ["Oak", "elm", "é", "ñandú", "yew", "ÉLAN", "a", "zz" * 40, "日本", "x" * 31]
    rows = [(" 1-".join(rng.choice(vocabulary[: rng.randrange(1, 11)]) for _ in range(rng.randrange(12))), rng.choice(["en", "fr"]), f"s{rng.randrange(8)}") for _ in range(300)]
    rows += [(None, "en", "s0"), ("oak elm", None, None), ("oak", None, "b"), (None, None, "c"), ("123", "de", "lone"), (None, "it", "a"), ("", "it", "b")]
    rows += [("oak " * 50 + "q" * 5000, "en", "hot")] * 40
    got = source_audit.audit(sources_of(spark, rows).repartition(4), 10, 10, *size)
    assert sorted(tuple(r) for r in got.collect()) == plain_sources(rows, 10, 10)


def test_divergences_of_no_document(spark):
    assert source_audit.audit(sources_of(spark, [])).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6))
def test_slice_hashes_are_xxh64(length, seed):
    x = np.random.default_rng(seed).integers(0, 256, (9, length), dtype=np.uint8)
    assert source_audit.slice_hashes(x).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in x]


def test_slices_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(source_audit, "slice_hashes", lambda s: s[:, 0].astype(np.uint64) % np.uint64(2))
    x = np.random.default_rng(0).integers(97, 103, (400, 2), dtype=np.uint8)
    first, group = source_audit.grouped(x)
    assert (x[first[group]] == x).all() and len({r.tobytes() for r in x[first]}) == len(first)


def test_probabilities_beyond_64_bits(spark):
    big = 9_000_000_000_000
    r = spark.range(1).select(source_audit.probability(F.lit(big - 1), F.lit(big), F.lit(1000))).first()[0]
    assert r == 1 + 10**9 * (big + 1) // (big + 2000)
