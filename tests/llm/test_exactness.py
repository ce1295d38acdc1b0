"""Results that must not depend on length, row order, batches or clashing ids; the registered queries against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import alnum, brute_components, brute_spans, brute_statistics

WORDS = [f"w{k}" for k in range(700)]


def prose(r, n):
    return " ".join(r.choices(WORDS, k=n))


def test_very_long_texts_repeat_nothing(spark):
    """Three million distinct words: hashes cut by the place in the text would meet by chance."""
    from clumpwise.llm.decision_lists import statistics

    text = " ".join(map(str, range(3_000_001)))
    docs = spark.createDataFrame([(1, text), (2, text[:2000] + " " + text[:2000])], "doc_id long, text string")
    got = {r.doc_id: r for r in statistics(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words) == (3_000_001, 0)
    assert got[2].n_repeat_words == brute_statistics(text[:2000] + " " + text[:2000])[4]


def test_repeated_words_at_many_lengths(spark):
    from clumpwise.llm.decision_lists import statistics

    r = random.Random(11)
    texts = [prose(r, n) + (" " + "a b c " * (n % 5)) for n in (0, 1, 2, 3, 4, 7, 8, 9, 63, 64, 65, 1000, 5000) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in statistics(docs).collect()}
    assert got == {k: brute_statistics(t) for k, t in enumerate(texts)}


def test_scores_of_licenses_do_not_see_other_rows(spark):
    from clumpwise.llm.license_templates import Automaton, scan_licenses

    texts = ["we ask for permission", "is hereby granted", "permission is hereby granted free of charge", "Permission is", "hereby granted"]
    rows = list(enumerate(texts))
    alone = {k: scan_licenses(spark.createDataFrame([(k, t)], "doc_id long, text string")).first().score for k, t in rows}
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = scan_licenses(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert {x.doc_id: x.score for x in got} == alone
    assert alone[0] == 0 and 0 < alone[2] < 1
    with pytest.raises(ValueError, match="plain words"):
        Automaton("[[maybe]] two words")


@pytest.mark.parametrize("mean", [0.05, 0.1, 0.15])
def test_false_discoveries_are_controlled(mean):
    """Truly random strings mixed with runs whose p-values fall off: the share of the latter above the threshold."""
    from clumpwise.llm.secret_scan import STEPS, least_random, randomness

    r, g = random.Random(8), np.random.default_rng(8)
    p = np.asarray([randomness("".join(r.choices("0123456789abcdef", k=40)), "0123456789abcdef") for _ in range(3000)])
    assert abs(2 * (p > 0.5).mean() - 1) < 0.08 and abs((p < 0.1).mean() - 0.1) < 0.03
    shares = []
    for _ in range(20):
        q = g.exponential(mean, 3000)
        q = q[q < 1]
        steps = np.minimum((np.concatenate([p, q]) * STEPS).astype(int), STEPS - 1)
        least = least_random(np.bincount(steps, minlength=STEPS).tolist(), 0.1)
        shares.append((q >= least).sum() / ((q >= least).sum() + (p >= least).sum()))
    assert np.mean(shares) <= 0.105


def test_many_spans_of_one_text_are_fast():
    import time

    from clumpwise.llm.secret_scan import all_spans, without_spans

    r = random.Random(4)
    text = " ".join("".join(r.choices("0123456789abcdef", k=40)) for _ in range(30_000))
    began = time.perf_counter()
    spans = all_spans(text, {})
    assert without_spans(text, spans, "#") == " ".join("#" * 30_000)
    assert time.perf_counter() - began < 60


def test_pipeline_keeps_distinct_rows_of_one_id(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    r = random.Random(2)
    a, b, c, leak = (prose(r, 120) for _ in range(4))
    near = c.split()
    near[5] = "changed"
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, b, "en", "s"), (3, c, "en", "s"), (4, " ".join(near), "en", "t"), (5, a + " " + leak, "en", "s"), (5, prose(r, 90), "en", "s"), (6, "", "en", "s"), (6, None, None, "s"), (None, prose(r, 80), "en", "s"), (3, c, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = C.one_of_each(spark, docs, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(x for k, x in enumerate(rows) if k not in (2, 4, 10))
    spark.createDataFrame([("x", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = C.without_leaks(spark, docs, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(x for x in rows if x[1] is None or leak not in x[1])


def test_shared_class_keys_come_apart(spark):
    from clumpwise.llm.jaccard_join import class_keys

    classes = spark.createDataFrame([(1, 5, 3), (1, 6, 3), (2, 7, 3), (5, 9, 3)], "fa long, fb long, n long")
    keys = class_keys(classes)
    made = [keys(r.fa, r.fb) for r in classes.collect()]
    assert len(set(made)) == 4 and made[2:] == [2, 5]
    assert sorted(made) == sorted(r[0] for r in classes.select(keys.column()).collect())


def test_heap_merge_counts_occurrences():
    from clumpwise.llm.jaccard_join import heap_merged

    r = random.Random(3)
    for _ in range(200):
        lists = [sorted(r.sample(range(20), r.randint(1, 7))) for _ in range(r.randint(1, 6))]
        ids = [x for one in lists for x in one]
        early = [r.randint(0, 1) for _ in ids]
        ends = np.cumsum([len(x) for x in lists]).tolist()
        want = collections.Counter(ids)
        soon = collections.Counter()
        for x, e in zip(ids, early, strict=True):
            soon[x] |= e
        assert heap_merged(ids, [x + 100 for x in ids], ends, early) == [(x, x + 100, want[x], soon[x]) for x in sorted(want)]


def brute_difference(sizes, shards):
    """The definition, with lists of groups in place of back pointers."""
    parts = [([s] + [0] * (shards - 1), [[k]] + [[] for _ in range(shards - 1)], k) for k, s in enumerate(sizes)]
    made = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(max(p[0]) - min(p[0])), p[2]))
        x, y = parts[:2]
        both = sorted(((a + b, k, g + h) for k, (a, b, g, h) in enumerate(zip(x[0], y[0][::-1], x[1], y[1][::-1], strict=True))), key=lambda z: (-z[0], z[1]))
        parts = [*parts[2:], ([z[0] for z in both], [z[2] for z in both], made)]
        made += 1
    return sorted(parts[0][0])


def test_differencing_is_that_of_the_definition():
    from clumpwise.llm.sharding import difference

    r = random.Random(6)
    for _ in range(60):
        sizes, shards = [r.randint(1, 90) for _ in range(r.randint(1, 30))], r.randint(2, 6)
        lanes = difference(sizes, shards)
        assert sorted(sum(s for s, k in zip(sizes, lanes, strict=True) if k == j) for j in range(shards)) == brute_difference(sizes, shards)


def test_grains_keep_groups_whole_and_bytes_even(spark):
    from pyspark.sql import functions as F

    from clumpwise.llm.sharding import shard_groups

    rows = spark.range(5000).select((F.col("id") % 1700).alias("g"), (F.col("id") % 97 + 1).alias("size"), "id")
    for grains in (200, 4000):  # most groups in grains, and all alone
        out = shard_groups(rows, F.col("g").cast("string"), F.col("size"), [F.col("id")], 8, grains).collect()
        sums, where = collections.Counter(), collections.defaultdict(set)
        for x in out:
            sums[x.shard] += x.size
            where[x.g].add(x.shard)
        assert len(out) == 5000 and all(len(s) == 1 for s in where.values())
        assert max(sums.values()) - min(sums.values()) <= 40


def test_site_posteriors_are_those_of_a_plain_version(spark):
    import re

    from pyspark.sql import functions as F

    from clumpwise.llm.linear import fit_logistic, logistic
    from clumpwise.llm.site_bayes import SITE_WEIGHT, STRENGTH, site_quality

    r = random.Random(9)
    rows = []
    for k in range(240):
        bad = r.random() < (0.1, 0.5, 0.9)[k % 3]
        rows.append((k, "spam " * r.randint(20, 60) if bad else prose(r, r.randint(30, 90)), f"h{k % 3}", f"h{k % 3}/{k % 2}", bad))
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(x[0], int(not x[4])) for x in rows if x[0] % 2], "doc_id long, quality int")
    got = {x.doc_id: x for x in site_quality(docs, labels, F.col("host"), F.col("path")).collect()}

    def features(t):
        n, chars, symbols, dup, repeat = brute_statistics(t)
        w = t.split()
        lines = max(len([x for x in t.split("\n") if x.strip()]), 1)
        c = max(chars, 1)
        return [n, chars / max(n, 1), symbols / c, dup / lines, repeat / max(n, 1), len(re.findall("[A-Z]", t)) / c, len(re.findall("[!?]", t)) / c, len(set(w)) / max(n, 1), sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(n, 1)]

    x = np.log1p(100 * np.asarray([features(t) for _, t, *_ in rows]))
    known = [k for k in range(240) if k % 2]
    mean, scale = x[known].mean(0), np.maximum(x[known].std(0), 1e-3)
    w = fit_logistic((x[known] - mean) / scale, np.asarray([int(not rows[k][4]) for k in known]))
    p = logistic(((x - mean) / scale) @ w[:-1] + w[-1])
    base = (p.sum() + 0.5) / (len(p) + 1)

    def strength(sites, centre):
        between = sum(len(v) * (v.mean() - centre[s]) ** 2 for s, v in sites.items())
        noise = sum(((v**2).sum() - len(v) * v.mean() ** 2) / (len(v) - 1) for v in sites.values())
        spread = (between - noise) / sum(map(len, sites.values()))
        unit = np.mean([centre[s] * (1 - centre[s]) for s in sites])
        return STRENGTH[1] if spread <= 0 else float(np.clip(unit / spread - 1, *STRENGTH))

    hosts = {h: p[[k for k in range(240) if rows[k][2] == h]] for h in {x[2] for x in rows}}
    paths = {h: p[[k for k in range(240) if rows[k][3] == h]] for h in {x[3] for x in rows}}
    k1 = strength(hosts, dict.fromkeys(hosts, base))
    p_host = {h: (v.sum() + k1 * base) / (len(v) + k1) for h, v in hosts.items()}
    k2 = strength(paths, {s: p_host[s.split("/")[0]] for s in paths})
    logit = lambda v: np.log(np.clip(v, 1e-6, 1 - 1e-6) / (1 - np.clip(v, 1e-6, 1 - 1e-6)))
    for k, _, host, path, _ in rows:
        h = (hosts[host].sum() - p[k] + k1 * base) / (len(hosts[host]) - 1 + k1)
        s = (paths[path].sum() - p[k] + k2 * h) / (len(paths[path]) - 1 + k2)
        good = 1 / (1 + np.exp(-(logit(p[k]) + SITE_WEIGHT * (logit(s) - logit(base)))))
        assert got[k].p_own == pytest.approx(p[k], abs=1e-6) and got[k].p_good == pytest.approx(good, abs=1e-6)
        assert got[k].kept == (got[k].p_good >= 0.5)


def test_chain_feeds_earlier_probabilities_to_later_models():
    from clumpwise.llm.linear import fit_logistic, logistic
    from clumpwise.llm.toxicity_chain import apply_chain, fit_chain

    g = np.random.default_rng(4)
    x = (g.random((600, 5)) < 0.4).astype(float)
    first = x[:, 0] > 0
    y = np.stack([first, first & (x[:, 1] > 0)], 1).astype(float)
    fold = np.arange(600) % 5
    models = fit_chain(x, y, fold)
    out = np.zeros(600)
    for f in range(5):
        w = fit_logistic(x[fold != f], y[fold != f, 0])
        out[fold == f] = logistic(x[fold == f] @ w[:-1] + w[-1])
    assert models[1] == pytest.approx(fit_logistic(np.column_stack([x, out]), y[:, 1]))
    p0 = logistic(x @ models[0][:-1] + models[0][-1])
    p1 = logistic(np.column_stack([x, p0]) @ models[1][:-1] + models[1][-1])
    assert apply_chain(models, x) == pytest.approx(np.column_stack([p0, p1]))


def test_samples_take_the_least_hashes(spark):
    from pyspark.sql import functions as F

    from clumpwise.llm.textops import sampled_ids

    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    want = [r[0] for r in ids.orderBy(F.xxhash64("doc_id")).limit(100).collect()]
    assert sorted(r[0] for r in sampled_ids(ids, 100).collect()) == sorted(want)
    assert sampled_ids(ids, 3000).count() == 3000


def test_one_label_on_many_rows_is_one_example(spark):
    from clumpwise.llm.toxicity_chain import CATEGORIES, _sampled

    docs = spark.createDataFrame([(1, "a b"), (1, "a b c"), (1, None), (2, None)] + [(3, "x")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, None, None), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, _sampled(docs, labels, CATEGORIES, 10).collect()))
    assert got == [(1, "a b c", 1, 1, 1), (2, None, 0, 0, 0), (3, "x", 0, 0, 0)]


def test_long_words_are_counted_within_bounds():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from clumpwise.llm import token_transducer as T

    path = public.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), T.WordCounter(open(path, encoding="utf-8").read())
    r, old = random.Random(1), T.STATES
    T.STATES = 500
    try:
        for text in ("".join(r.choices("abcdefgh", k=20_000)), "".join(r.choices("ab'1!é", k=20_000))):
            assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids)
            assert len(counter.transducer.keys) <= 502
    finally:
        T.STATES = old


def test_packed_cells_give_the_same_pieces():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from clumpwise.llm import trie_pieces as P

    path = public.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), P.PieceModel(open(path, "rb").read())
    r, old = random.Random(2), P.LONG
    some = [p.replace("▁", " ") for p in model.pieces[300:6000]]
    texts = ["".join(r.choices(some, k=r.randint(1, 14))) + r.choice(["", "é🙂", " x"]) for _ in range(400)]
    for P.LONG in (4, old):
        for text, ids in zip(texts, model.encode_all(texts), strict=True):
            assert ids.tolist() == library.encode(text)
        model.forget()


def test_near_matches_are_those_of_the_definition(spark):
    from clumpwise.llm.phrase_index import build_index, find_in, find_leaks
    from clumpwise.llm.textops import cut

    r = random.Random(12)
    few = [f"t{k}" for k in range(14)]
    texts = [" ".join(r.choices(few, k=r.randint(0, 60))) for _ in range(150)]
    items = [(k, " ".join(r.choices(few, k=n))) for k, n in enumerate((1, 2, 3, 4, 5, 12))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for k, t in enumerate(texts):
        w, near = t.split(), set()
        for i, x in items:
            x = x.split()
            for a in range(max(1, len(x) - 9)):
                v = x[a : a + 10]
                if any(all(v[j] in w[max(s + j - 2, 0) : max(s + j + 3, 0)] for j in range(len(v))) for s in range(-12, len(w) + 2)):
                    near.add(str(i))
        want[k] = sorted(near)
    assert {x.doc_id: x.near_items for x in find_leaks(docs, bench).collect()} == want
    index = cut(build_index(docs))  # one index serves two benchmarks
    assert {x.doc_id: x.near_items for x in find_in(index, bench).collect()} == want
    assert {x.doc_id: x.near_items for x in find_in(index, bench.where("item_id = 2")).collect()} == {k: [i for i in v if i == "2"] for k, v in want.items()}


def test_long_items_in_pieces_have_the_same_windows(spark):
    from clumpwise.llm import phrase_index as P

    r = random.Random(13)
    item = prose(r, 400)
    w = item.split()
    docs = spark.createDataFrame([(k, " ".join(w[k : k + 14])) for k in range(0, 386, 3)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "?")], "item_id long, text string")
    found = lambda: sorted((x.doc_id, x.n_words, x.n_hit, x["items"], x.near_items, sorted(x.spans)) for x in P.find_leaks(docs, bench).collect())
    want = found()
    old, P.PIECE_BYTES = P.PIECE_BYTES, 150
    try:
        assert P.pieces_of(bench).where("item_id = '1'").count() > 5
        assert found() == want
    finally:
        P.PIECE_BYTES = old


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small folder of tables for the registered queries, and its documents."""
    r, place = random.Random(21), str(tmp_path_factory.mktemp("sf"))
    texts = [None, "", "ONE", "two words", prose(r, 200), "Released under the MIT License. " + prose(r, 60), 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" ' + prose(r, 70)]
    passage = prose(r, 40)
    texts += [prose(r, r.randint(40, 90)) for _ in range(40)] + [prose(r, 30) + " " + passage + " " + prose(r, 30) for _ in range(6)]
    texts += [texts[10]] * 3 + ["bad " * 70 for _ in range(12)] + [prose(r, 60) + " vile" for _ in range(12)]
    rows = [(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(f"b{k}", t) for k, t in enumerate((passage, "no such words at all", None))], "item_id string, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([(k, int("bad bad" not in (t or "")), int("vile" in (t or ""))) for k, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place, [(k, t) for k, t, *_ in rows], passage


def answers(spark, place, name):
    from clumpwise.llm.queries import QUERIES

    return {r.doc_id: r for r in QUERIES[name](spark, place).collect()}


def test_op1_query(spark, sf):
    place, rows, _ = sf
    got, slots = answers(spark, place, "op1_karmarkar_karp"), collections.defaultdict(list)
    for k, t in rows:
        b = (t or "").encode()
        assert (got[k].size, got[k].text_crc32, got[k].law, got[k].grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None) and 0 <= got[k].shard < 16
        slots[got[k].shard].append(got[k].slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2_query(spark, sf):
    place, rows, _ = sf
    got = answers(spark, place, "op2_decision_list")
    for k, t in rows:
        s = brute_statistics(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert tuple(got[k])[:6] == (k, *s) and got[k].base_failed == failed and not (failed and got[k].kept)


def test_op3_query(spark, sf):
    place, rows, _ = sf
    got = answers(spark, place, "op3_randomness_battery")
    for k, t in rows:
        spans = brute_spans(t)
        joined = ",".join(f"{x}:{a}:{b}" for x, a, b in spans)
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(x == y for x, *_ in spans) for y in ("assign", "access", "hex"))
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got[k].spans.split(","))


def test_op4_and_op5_queries(spark, sf):
    place, rows, _ = sf
    good, chain = answers(spark, place, "op4_site_bayes"), answers(spark, place, "op5_classifier_chain")
    assert set(good) == set(chain) == {k for k, _ in rows}
    assert all(not good[k].kept for k, t in rows if "bad bad" in (t or ""))
    assert all(chain[k].toxic == (chain[k].p_toxic >= 0.5) for k, _ in rows)
    assert all(chain[k].toxic for k, t in rows if "vile" in (t or ""))


def test_op6_query(spark, sf):
    place, rows, passage = sf
    got = answers(spark, place, "op6_positional_index")
    for k, t in rows:
        hit = passage in (t or "")
        want = (k, len(alnum(t)), 40 * hit, int(hit), hashlib.sha256(b"b0" if hit else b"").hexdigest(), hit)
        assert tuple(got[k])[:6] == want and (got[k].near_items == "b0" or not hit)


def test_op7_and_op9_queries(spark, sf):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    place, rows, _ = sf
    words, pieces = Tokenizer.from_file(public.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    counts, ids = answers(spark, place, "op7_token_transducer"), answers(spark, place, "op9_shared_prefix_viterbi")
    for k, t in rows:
        n = len(words.encode(t or "", add_special_tokens=False).ids)
        assert tuple(counts[k]) == (k, len((t or "").encode()), n, n > 2048)
        want = pieces.encode(t or "")
        assert tuple(ids[k]) == (k, len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), True)


def test_op8_query(spark, sf):
    place, rows, _ = sf
    got, (want, _) = answers(spark, place, "op8_jaccard_join"), brute_components(rows)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want


def test_op10_query(spark, sf):
    place, rows, _ = sf
    got = answers(spark, place, "op10_template_automata")
    for k, t in rows:
        w = alnum(t)
        at = [i for p in ("mit license", "apache license", "general public license") for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert got[k].base_labels == ("mit" if at else "") and got[k].labels == ("mit,mit-notice" if at else "") and got[k].score == (1.0 if at else 0.0)


@pytest.mark.parametrize("mean", [0.1, 0.15, 0.25])
@pytest.mark.parametrize("rare", [3000, 900, 300, 90, 30])
def test_false_discoveries_stay_few_where_random_runs_are_rare(mean, rare):
    """Realised share over draws; a draw without a threshold makes no discovery."""
    import numpy as np

    from clumpwise.llm.secret_scan import STEPS, control

    r = np.random.default_rng(int(1000 * mean) + rare)
    shares = []
    for _ in range(20):
        x = r.exponential(mean, 20_000)
        composed, random_ = x[x < 1][:3000], r.random(rare)
        found = control(np.histogram(np.concatenate([random_, composed]), STEPS, (0, 1))[0].tolist(), 0.1)
        assert found.rule in ("estimated", "none") and (found.threshold is None) == (found.rule == "none")
        t = 2.0 if found.threshold is None else found.threshold
        shares.append((composed >= t).sum() / max(1, (composed >= t).sum() + (random_ >= t).sum()))
    assert np.mean(shares) <= 0.1


def test_controls_tell_their_rule():
    from clumpwise.llm.secret_scan import FIXED, STEPS, Control, control

    assert control([3] * STEPS, 0.1) == Control("fixed", FIXED, None, 150)
    assert control([5000] + [100] * 49, 0.1).rule == "estimated"
    none = control([4000 - 80 * k for k in range(STEPS)], 0.1)
    assert none.rule == "none" and none.threshold is None and none.share > 0.1


@pytest.mark.parametrize("letters", [64, 1024, 2048, 4096])
def test_words_of_swapped_letters_differ(spark, letters):
    """Thue-Morse words and their complements, which polynomials modulo 2 ** 64 can't tell apart."""
    import numpy as np

    from clumpwise.llm import textops
    from clumpwise.llm.jaccard_join import near_copies
    from clumpwise.llm.license_templates import scan_licenses
    from clumpwise.llm.phrase_index import find_leaks

    one = "".join("ab"[bin(k).count("1") % 2] for k in range(letters))
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    h = textops.word_hashes(data, np.array([0, letters + 1]), np.array([letters, 2 * letters + 1]))
    assert h[0] != h[1]
    assert textops.word_hashes(data, np.array([0]), np.array([letters]))[0] == h[0]
    upper = np.frombuffer(one.upper().encode(), np.uint8)
    assert textops.word_hashes(upper, np.array([0]), np.array([letters]))[0] == h[0]
    assert textops.word_hashes(upper, np.array([0]), np.array([letters]), fold=False)[0] != h[0]
    rest = " w1 w2 w3 w4"
    docs = spark.createDataFrame([(1, one + rest), (2, two + rest), (3, one + rest)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == {1: 1, 2: 2, 3: 1}
    benchmark = spark.createDataFrame([("x", one + rest)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in find_leaks(docs, benchmark).collect()} == {1: 5, 2: 0, 3: 5}
    assert scan_licenses(docs).count() == 3
