"""Toxicity by classifier chains over hashed words and word beginnings.

The categories are predicted in order; each linear model sees the
probabilities of the categories before it. While training, those come from
models that did not see the row (out of fold), so later models learn to trust them
as far as they will deserve. Features are words and their first four and five
bytes, hashed to ``BITS`` bits; those that tell a category's documents from others
best are selected from counts over the sampled documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.llm.linear import fit_logistic, logistic
from clumpwise.llm.textops import ALNUM, cut, map_arrow, sampled_ids, text_slices, word_hashes, word_spans

#: Bits of a feature, features selected for each category, folds, and labelled rows that are fitted at most.
BITS, SELECTED, FOLDS, SAMPLE = 18, 96, 5, 12_000

_U = np.uint64

#: Categories in the order of the chain, as conditions on the labels.
CATEGORIES: dict[str, str] = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_low_quality": "toxic = 1 and quality = 0",
}


def features_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word and word beginning; repeats are not removed."""
    start, end, first = word_spans(data, offs, ALNUM)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    docs, found = [doc], [word_hashes(data, start, end)]
    for size in (4, 5):
        long_ = end - start > size
        docs.append(doc[long_])
        found.append(word_hashes(data, start[long_], start[long_] + size) ^ _U(size * 0x9E3779B97F4A7C15 % 2**64))
    return np.concatenate(docs), (np.concatenate(found) >> _U(64 - BITS)).astype(np.int64)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc << BITS | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


def _sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int) -> DataFrame:
    """(doc_id, text, y...) of at most ``sample`` labelled doc_ids, those of least hash.

    A doc_id that is labelled twice has a category that either label gives it; of
    rows of one doc_id the one of the longest text counts (on a tie that of the largest digest).
    """
    names = [f"y{k}" for k in range(len(categories))]
    flags = [F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(y) for y, c in zip(names, categories.values(), strict=True)]
    few = sampled_ids(labels.where("doc_id is not null").groupBy("doc_id").agg(*flags), sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    longest = F.max_by("text", F.struct(F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("m")))
    return rows.groupBy("doc_id", *names).agg(longest.alias("text")).select("doc_id", "text", *names)


def select_features(sampled: DataFrame, categories: int) -> np.ndarray:
    """The features that tell each category's documents best, by the signed G statistic, from counts of fixed size."""
    size = 1 << BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            y = np.stack([np.asarray(batch.column(2 + k)) for k in range(categories)], 1)
            for i, j, data, offs in text_slices(batch, "text"):
                doc, f = _distinct(*features_of(data, offs))
                code = y[i:j] @ (1 << np.arange(categories))
                for key, n in zip(*np.unique(code[doc] * size + f, return_counts=True), strict=True):
                    seen[int(key)] = seen.get(int(key), 0) + int(n)
        keys = np.asarray(list(seen), np.int64)
        yield pa.record_batch([pa.array(keys), pa.array(np.asarray(list(seen.values()), np.int64))], ["k", "n"])

    counts = map_arrow(sampled, scan, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n >= 3")
    packed = counts.select(F.shiftright("k", BITS).alias("code"), F.col("k").bitwiseAND(size - 1).alias("f"), "n")
    table = np.zeros((1 << categories, size))
    groups = sampled.groupBy(*[f"y{k}" for k in range(categories)]).count().collect()
    docs_of = np.zeros(1 << categories)
    for r in groups:
        docs_of[sum(r[k] << k for k in range(categories))] = r[categories]
    # at most 2 ** (BITS + categories) counts, packed by code
    for code, fs, ns in packed.groupBy("code").agg(F.collect_list("f").alias("f"), F.collect_list("n").alias("n")).collect():
        table[code, fs] = ns
    chosen: set[int] = set()
    for k in range(categories):
        with_ = np.asarray([bool(c >> k & 1) for c in range(1 << categories)])
        p, n = table[with_].sum(0), table[~with_].sum(0)
        a, b = max(docs_of[with_].sum(), 1.0), max(docs_of[~with_].sum(), 1.0)
        rate_p, rate_n = (p + 0.1) / (a + 0.2), (n + 0.1) / (b + 0.2)
        g = p * np.log(rate_p / rate_n) + (a - p) * np.log((1 - rate_p).clip(1e-9) / (1 - rate_n).clip(1e-9))
        g[p + n == 0] = 0
        best = np.argsort(-g, kind="stable")[:SELECTED]
        chosen.update(int(x) for x in best if g[x] > 2)
    return np.asarray(sorted(chosen), np.int64)


def _matrix(data: np.ndarray, offs: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    doc, f = features_of(data, offs)
    at = place[f]
    x = np.zeros((len(offs) - 1, width), np.float64)
    x[doc[at >= 0], at[at >= 0]] = 1.0
    size = np.maximum(np.diff(offs), 1)
    symbols = np.add.reduceat(np.append(_SYMBOL[data], 0.0), np.minimum(offs[:-1], len(data))) * (np.diff(offs) > 0)
    upper = np.add.reduceat(np.append(_UPPER[data], 0.0), np.minimum(offs[:-1], len(data))) * (np.diff(offs) > 0)
    words = np.bincount(doc, minlength=len(size))
    distinct = np.bincount(_distinct(doc, f)[0], minlength=len(size))
    return np.concatenate([x, np.stack([symbols / size * 10, upper / size * 2, distinct / np.maximum(words, 1)], 1)], 1)


_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>!"]).astype(float)
_UPPER = ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(float)


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector for each category; model k also weighs the k probabilities before it."""
    models: list[np.ndarray] = []
    before = np.zeros((len(x), 0))
    for k in range(y.shape[1]):
        a = np.concatenate([x, before], 1)
        models.append(fit_logistic(a, y[:, k]))
        out = np.zeros(len(x))
        for f in np.unique(fold):
            held = fold == f
            w = fit_logistic(a[~held], y[~held, k])
            out[held] = logistic(a[held] @ w[:-1] + w[-1])
        before = np.concatenate([before, out[:, None]], 1)
    return models


def apply_chain(models: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The probabilities of all categories, in the order of the chain."""
    p = np.zeros((len(x), 0))
    for w in models:
        p = np.concatenate([p, logistic(np.concatenate([x, p], 1) @ w[:-1] + w[-1])[:, None]], 1)
    return p


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_<category>...) of every row.

    Trained on at most ``sample`` labelled rows; a label that is null is a no.
    Without labels all probabilities are 1/2. Null and empty texts have no
    features; repeated rows stay; other columns are ignored.
    """
    categories = categories or CATEGORIES
    many = len(categories)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sampled = cut(_sampled(docs, labels, categories, sample))
    chosen = select_features(sampled, many)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text"):
                x = _matrix(data, offs, place, len(chosen)).astype(np.float32)
                blobs = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(batch.column(2 + k).slice(i, j - i) for k in range(many)), blobs], ["doc_id", *(f"y{k}" for k in range(many)), "x"])

    width = len(chosen) + 3
    ys = [f"y{k}" for k in range(many)]
    got = map_arrow(sampled, rows, "doc_id long, " + ", ".join(f"{y} int" for y in ys) + ", x binary").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)), *ys, "x").orderBy("doc_id").collect()
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, width).astype(float)
    y = np.asarray([[r[c] for c in ys] for r in got], float).reshape(-1, many)
    models = fit_chain(x, y, np.asarray([r[1] for r in got], int))
    sent = docs.sparkSession.sparkContext.broadcast((models, place))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, place = sent.value
        for batch in batches:
            for i, j, data, offs in text_slices(batch, "text"):
                p = apply_chain(models, _matrix(data, offs, place, width - 3))
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(pa.array(p[:, k]) for k in range(many))], ["doc_id", *(f"p_{c}" for c in categories)])

    return map_arrow(docs, score, "doc_id long, " + ", ".join(f"p_{c} double" for c in categories))
