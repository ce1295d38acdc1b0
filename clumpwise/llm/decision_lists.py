r"""Quality rules by learned decision lists, in DataFrame functions only.

Text statistics are computed with built-in functions. Sequential covering over
the labelled rows' statistics grows one rule at a time, a conjunction of threshold
conditions chosen by FOIL's gain on two thirds of the rows; the other third
prunes its last conditions; rules that stay precise are kept and what they cover is
taken out. The rules become one ordered conditional expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clumpwise.llm.textops import cut, sampled_ids

#: Labelled rows that are fitted at most: those of least hash of doc_id.
SAMPLE = 20_000

_SPACE = r"[\x20\x09-\x0D]+"

#: Features of the rules: statistics by words, characters or lines.
FEATURES: dict[str, str] = {
    "words": "cast(n_words as double)",
    "mean_chars": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "stutter": "n_stutter / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and statistics of every row's whole text.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
    n_lines (with a word), n_dup_lines (of those, equal to an earlier one),
    n_repeat_words (words in three-word windows that occur twice or more),
    n_distinct (words), n_stutter (words equal to the one before), n_upper (A-Z),
    n_marks (``!?``); a null text has none of any. Windows that may repeat are found by 64-bit hashes whose low bits,
    as many as a place in the text needs, make room for the place; those found are then compared by their words.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    names = [f"_k{i}" for i in range(len(keep))]
    one = docs.select(
        *kept,
        F.filter(F.split(t, _SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        gone(r"[#*$%&|<>]+").alias("n_symbols"),
        gone("[A-Z]+").alias("n_upper"),
        gone("[!?]+").alias("n_marks"),
    )
    two = one.select(
        *names,
        "w",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.expr("size(filter(w, (x, i) -> x <=> get(w, i - 1)))").alias("n_stutter"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_symbols",
        "n_upper",
        "n_marks",
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_distinct", "n_lines", "n_upper", "n_marks", "n_stutter")
    three = two.select(
        *names,
        *counts,
        "w",
        F.expr("shiftleft(1L, length(bin(n_words))) - 1").alias("low"),
        F.expr(
            """case when n_words < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, n_words - 3),
            i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & -shiftleft(1L, length(bin(n_words)))) | cast(i as bigint))) end"""
        ).alias("s"),
    )
    four = three.select(
        *names,
        *counts,
        F.expr(
            """sort_array(transform(filter(s, (x, j) -> (get(s, j - 1) | low) <=> (x | low) or (get(s, j + 1) | low) <=> (x | low)),
            x -> named_struct('a', w[cast(x & low as int)], 'b', w[cast(x & low as int) + 1], 'c', w[cast(x & low as int) + 2], 'p', x & low)))"""
        ).alias("s"),
    )
    same = lambda k: f"(get(s, j + {k}).a <=> x.a and get(s, j + {k}).b <=> x.b and get(s, j + {k}).c <=> x.c)"
    five = four.select(*names, *counts, F.expr(f"sort_array(transform(filter(s, (x, j) -> {same(-1)} or {same(1)}), x -> x.p))").alias("at"))
    repeat = F.expr("aggregate(at, named_struct('n', 0L, 'e', 0L), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.e), 'e', p + 3), a -> a.n)")
    return five.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col(c).cast("long").alias(c) for c in counts],
        repeat.alias("n_repeat_words"),
    )


def features() -> list[Column]:
    return [F.expr(x).cast("double").alias(f"f_{name}") for name, x in FEATURES.items()]


@dataclass(frozen=True)
class Condition:
    """A threshold on one feature: at least ``value`` or at most ``value``."""

    feature: int
    at_least: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.value if self.at_least else x[:, self.feature] <= self.value


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grown(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> Rule:
    rule: list[Condition] = []
    here = np.ones(len(x), bool)
    for _ in range(most):
        p, n = int((here & bad).sum()), int((here & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            v = x[here, f]
            b = bad[here]
            for value in np.unique(np.quantile(v, np.linspace(0, 1, cuts), method="nearest")):
                for at_least in (True, False):
                    hit = v >= value if at_least else v <= value
                    q, m = int((hit & b).sum()), int((hit & ~b).sum())
                    if q and q + m < p + n:
                        g = q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = Condition(f, at_least, float(value)), g
        if best is None:
            break
        rule.append(best)
        here &= best.holds(x)
    return tuple(rule)


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = _covered(r, x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def fit(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, rules: int = 12, conditions: int = 4, cuts: int = 48) -> list[Rule]:
    """Ordered rules for bad rows by sequential covering; none without rows of both kinds."""
    found: list[Rule] = []
    left = np.ones(len(x), bool)
    prune = np.arange(len(x)) % 3 == 2
    for _ in range(rules):
        g, h = left & ~prune, left & prune
        if not bad[g].any() or bad[g].all():
            break
        rule = _pruned(_grown(x[g], bad[g], conditions, cuts), x[h], bad[h])
        hit = _covered(rule, x) & left
        if not rule or not (hit & h).any() or bad[hit & h].mean() < precision or bad[hit].mean() < precision or (hit & bad).sum() < 5:
            break
        found.append(rule)
        left &= ~hit
    return found


def verdict(rules: Sequence[Rule]) -> Column:
    """The number (from 1) of the first rule that rejects a row, else 0, as one ordered conditional expression."""
    names = list(FEATURES)
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            f = F.expr(FEATURES[names[c.feature]]).cast("double")
            test = test & (f >= c.value if c.at_least else f <= c.value)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled(stats: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled doc_ids (least hash), collected by rising hash.

    Of rows of one doc_id the one of least statistics counts, of labels the least.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    few = sampled_ids(one, sample)
    found = stats.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct("y", *features())).alias("r"))
    rows = found.select(F.xxhash64("doc_id"), "doc_id", "r.*").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    x = np.asarray([r[3:] for r in rows], float).reshape(len(rows), len(FEATURES))
    return x, np.asarray([r[2] for r in rows], int)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of every row with ``rule`` (of the list, 0: none), ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words repeat.
    ``kept``: neither failed nor rejected by a rule. Without usable labels there
    are no rules. Null texts have no words and fail; repeated rows stay. Columns
    other than doc_id and text are ignored, so names cannot clash.
    """
    stats = cut(statistics(docs.select("doc_id", "text")))
    x, y = labelled(stats, labels, "quality", sample)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rule = verdict(fit(x, y == 0))
    return stats.select("*", rule.alias("rule"), failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"))
