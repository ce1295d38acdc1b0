r"""Secret scans: fixed patterns and a battery of randomness tests.

Runs of encoding characters that mix letters and digits are tested against
uniform draws from the alphabet inferred for them (hexadecimal, base 32, 36, 62
or 64): chi-squared uniformity of the characters, Wald-Wolfowitz runs about the
alphabet's middle, and lag-1 serial correlation. The battery's value is the most
extreme of the three deviations; its p-value is its place among the values of
simulated uniform draws of the same alphabet size and length, so that it is
uniform for random runs although the tests depend on each other and on the
length. A run that is not rejected looks random.

False discoveries (composed names taken for secrets) are controlled for each
encoding and length on its own, as short runs give weak tests. p-values of truly random
runs are uniform; those of composed runs fall off, as any mixture of exponentials may. How many random runs a
stratum holds at least is the lower confidence limit of the uniform part (by profile likelihood, the mixture fitted anew for each
share), which also holds where random runs are rare: composed runs that could explain the top of the histogram count against it.
The threshold is the least at which, with so few random runs, the share of others among those above is at most ``alpha``. Where there is none,
no run of the stratum is taken for random: no threshold could keep the share. The counts cover the distinct runs of
all documents, as copies of a run are one draw, in a table of fixed size. A stratum of few runs is
counted together with the nearest lengths of its encoding; an encoding of fewer than ``LEAST`` has a fixed
threshold, whose share of false discoveries is not known. ``controls`` tells the rule, threshold and share of each stratum.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from clumpwise.llm.textops import map_arrow

#: Kinds in the order that settles ties of spans; the last is the battery's.
KINDS = ("assign", "access", "hex", "random")
#: Steps of the p-values' histogram, and the lengths at which strata begin.
STEPS, LENGTHS = 50, (20, 24, 28, 32, 40, 48, 64, 96, 128, 256)
#: Distinct runs that the estimate needs (it loses some 4% of random runs at so many), and the threshold of encodings that have fewer.
LEAST, FIXED = 200, 0.04
#: Draws that are simulated for an alphabet size and length.
DRAWS = 4096
#: The step from which p-values are fitted, the scales that the falling part mixes, the one-sided confidence in standard units, and the rounds of the fit.
FROM, SCALES, SURE, ROUNDS = 5, (0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4), 1.28, 150
#: Shares of random runs that are tried.
SHARES = np.concatenate([[1e-6], np.geomspace(0.002, 1 - 1e-9, 60)])

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

#: Alphabets from small to large.
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, letters, frozenset(letters), {c: i for i, c in enumerate(letters)}) for name, letters in _ALPHABETS]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def encoding_of(run: str) -> tuple[str, str] | None:
    """(name, alphabet) of the smallest alphabet that holds the run; none for mere letters or mere digits."""
    held = set(run)
    if not any(c.isdigit() for c in held) or not any(c.isalpha() for c in held):
        return None
    for name, letters, own, _ in _SETS:
        if held <= own:
            return name, letters
    return None


def deviations(x: np.ndarray, k: int) -> np.ndarray:
    """The battery's value of each row of characters 0 to k - 1: the largest deviation of the three tests, in standard units."""
    m, n = x.shape
    count = np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k)
    chi = (count * count).sum(1) * k / n - n
    # Wilson-Hilferty; both tails, as counting sequences are too even
    z_chi = (np.cbrt(np.maximum(chi, 0.0) / (k - 1)) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1)))
    high = 2 * x >= k
    a = high.sum(1)
    runs, mean = 1 + (high[:, 1:] != high[:, :-1]).sum(1), 1 + 2 * a * (n - a) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = np.where(var > 0, (runs - mean) / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)
    z_runs[(a == 0) | (a == n)] = math.sqrt(n)  # no run ends at all
    d = x - x.mean(1, keepdims=True)
    power = (d * d).sum(1)
    r = np.where(power > 0, (d[:, 1:] * d[:, :-1]).sum(1) / np.where(power > 0, power, 1.0), 1.0)
    return np.maximum(np.maximum(np.abs(z_chi), np.abs(z_runs)), np.abs((r + 1 / n) * math.sqrt(n)))


@lru_cache(maxsize=1024)
def null_values(k: int, n: int) -> np.ndarray:
    """Rising values of ``DRAWS`` simulated uniform draws of n characters from k, the same in every worker."""
    return np.sort(deviations(np.random.default_rng((k, n)).integers(0, k, (DRAWS, n)), k))


def simulated_length(n: int) -> int:
    """The length at which runs of n characters are simulated: each up to 64, then steps in which the values hardly change."""
    return n if n <= 64 else n // 16 * 16 if n < 256 else 256 if n < 512 else 512


def randomness(run: str, letters: str) -> float:
    """p-value of the battery against uniform draws from ``letters``; uniform for random runs."""
    index = {c: i for i, c in enumerate(letters)}
    value = deviations(np.asarray([[index[c] for c in run]]), len(letters))[0]
    null = null_values(len(letters), simulated_length(len(run)))
    at_most, below = np.searchsorted(null, value, "right"), np.searchsorted(null, value, "left")
    return float((DRAWS - (at_most + below) / 2 + 0.5) / (DRAWS + 1))


def runs_of(text: str) -> list[tuple[str, int, int, float]]:
    """(stratum, start, end, p) of the runs that are tested."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0].strip("-_/+")
        if len(run) >= 20 and (found := encoding_of(run)):
            start = m.start() + m[0].index(run)
            out.append((stratum(found[0], len(run)), start, start + len(run), randomness(run, found[1])))
    return out


def stratum(encoding: str, length: int) -> str:
    return f"{encoding}:{max(x for x in LENGTHS if x <= length)}"


@dataclass(frozen=True)
class Control:
    """How a stratum's random runs are told: ``estimated`` with a threshold and the largest share of false ones to expect, ``none`` (no run
    counts as random; the share is the least that any threshold would have), or ``fixed`` (a threshold, the share unknown)."""

    rule: str
    threshold: float | None
    share: float | None
    runs: int


def thresholds(docs: DataFrame, alpha: float = 0.1) -> dict[str, float]:
    """The least p-value that counts as random, by stratum, for those that have one."""
    return {s: c.threshold for s, c in controls(docs, alpha).items() if c.threshold is not None}


def controls(docs: DataFrame, alpha: float = 0.1) -> dict[str, Control]:
    """The ``Control`` of each stratum, from the runs of all documents: at most encodings times lengths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, bytes], int] = {}
            for t in batch.column(0):
                if t.is_valid:
                    text = t.as_py()
                    for s, a, b, p in runs_of(text):
                        seen[s, hashlib.blake2b(text[a:b].encode(), digest_size=16).digest()] = min(int(p * STEPS), STEPS - 1)
            keys = list(seen)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["s", "run", "step"])

    runs = map_arrow(docs.select(F.col("text").cast("string")), scan, "s string, run binary, step long").distinct()
    table: dict[str, list[int]] = {}
    for s, step, n in runs.groupBy("s", "step").agg(F.count("*")).collect():  # encodings x lengths x steps at most
        table.setdefault(s, [0] * STEPS)[step] = n
    return {s: control(n, alpha) for s, n in pooled(table).items()}


def pooled(table: dict[str, list[int]]) -> dict[str, list[int]]:
    """The counts of each stratum; one of fewer than ``LEAST`` runs takes in its encoding's nearest lengths until there are as many."""
    out = {}
    for s in table:
        encoding, length = s.split(":")
        at = LENGTHS.index(int(length))
        counts = [0] * STEPS
        for x in sorted(LENGTHS, key=lambda x: (abs(LENGTHS.index(x) - at), x)):
            if sum(counts) >= LEAST:
                break
            counts = [a + b for a, b in zip(counts, table.get(f"{encoding}:{x}", [0] * STEPS), strict=True)]
        out[s] = counts
    return out


def random_runs(counts: list[int], sure: float = SURE) -> float:
    """The lower confidence limit of how many runs are random: the least share of a uniform part with which mixtures of exponentials explain the counts."""
    steps, c = len(counts), np.asarray(counts[FROM:], float)
    n = c.sum()
    if not n:
        return 0.0
    at = (np.arange(FROM, steps) + 0.5) / steps
    falling = np.stack([np.exp(-at / scale) / np.exp(-at / scale).sum() for scale in SCALES])
    share, weights = SHARES[:, None], np.full((len(SHARES), len(SCALES)), 1 / len(SCALES))
    for _ in range(ROUNDS):
        weights = weights * ((c / (share / len(c) + (1 - share) * (weights @ falling))) @ falling.T)
        weights /= weights.sum(1, keepdims=True)
    likelihood = (c * np.log(share / len(c) + (1 - share) * (weights @ falling))).sum(1)
    least = int(np.flatnonzero(2 * (likelihood.max() - likelihood) <= sure * sure)[0])
    return float(SHARES[least] * n * steps / len(c))


def control(counts: list[int], alpha: float) -> Control:
    """The rule of a stratum with so many runs at each step of p."""
    steps, runs = len(counts), sum(counts)
    if runs < LEAST:
        return Control("fixed", FIXED, None, runs)
    random, best = random_runs(counts), 1.0
    for k in range(1, steps):
        above = sum(counts[k:])
        if above:
            share = max(0.0, 1 - random * (1 - k / steps) / above)
            if share <= alpha:
                return Control("estimated", k / steps, share, runs)
            best = min(best, share)
    return Control("none", None, best, runs)


def least_random(counts: list[int], alpha: float) -> float | None:
    """The least threshold (a step's lower edge) above which at most ``alpha`` of the runs are not random; of few runs the fixed one."""
    return control(counts, alpha).threshold


def all_spans(text: str, least: dict[str, float], strata: set[str] | None = None) -> list[tuple[str, int, int]]:
    """The spans of fixed patterns and the random runs outside of them, by start, kind and end; ``strata`` gets the random runs' strata."""
    spans = base_spans(text)
    new, at, reach = [], 0, 0  # reach: the farthest end of fixed spans that begin so early
    for s, a, b, p in runs_of(text):
        while at < len(spans) and spans[at][1] <= a:
            reach, at = max(reach, spans[at][2]), at + 1
        if reach < b and p >= least.get(s, 2.0):
            new.append(("random", a, b))
            if strata is not None:
                strata.add(s)
    return sorted(spans + new, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def without_spans(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with each stretch that spans (by start) cover replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, alpha: float = 0.1) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end) in code points by start, kind and end, and ``random_by``.

    Spans of the fixed patterns always stay; a random run is added unless it
    lies inside one of them. ``random_by`` has for each distinct stratum of the text's random runs ``stratum:rule:threshold:share``
    (share: the largest to expect of false ones, empty if unknown). A null or empty text has none. Repeated rows get
    equal spans. All columns pass through; those called ``spans`` and ``random_by`` are replaced.
    """
    found = controls(docs, alpha)  # at most encodings times lengths
    least = {s: c.threshold for s, c in found.items() if c.threshold is not None}
    said = {s: f"{s}:{c.rule}:{c.threshold}:{'' if c.share is None else round(c.share, 4)}" for s, c in found.items()}
    sent = docs.sparkSession.sparkContext.broadcast((least, said))
    docs = docs.drop("spans", "random_by")
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        least, said = sent.value
        for batch in batches:
            rows, by = [], []
            for t in batch.column(at):
                strata: set[str] = set()
                spans = all_spans(t.as_py(), least, strata) if t.is_valid else ()
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                by.append(sorted(said[s] for s in strata))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind), pa.array(by, pa.list_(pa.string()))], [*batch.schema.names, "spans", "random_by"])

    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    return map_arrow(docs, scan, StructType([*docs.schema.fields, StructField("spans", ArrayType(span)), StructField("random_by", ArrayType(StringType()))]))


def redacted(docs: DataFrame, alpha: float = 0.1, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch that spans of ``scan_secrets`` cover replaced by ``mark`` in ``text``; ``n_chars`` follows if there.

    Null texts stay null; all other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(thresholds(docs, alpha))
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(at).to_pylist(), None if size is None else batch.column(size).to_pylist()
            for k, t in enumerate(texts):
                if t is not None and (spans := all_spans(t, sent.value)):
                    texts[k] = without_spans(t, spans, mark)
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_arrow(docs, scan, docs.schema)
