r"""Near copies by T-occurrence search over inverted lists of word shingles.

Two texts link when their shingle sets have Jaccard similarity of at least
3/4, so a partner of a set of ``a`` shingles holds at least ``ceil(3a/4)`` of
them, and any two linked sets of sizes a and b share ``T = ceil(3(a+b)/7)``.
As in DivideSkip, each document's lists are divided: the
``k = a - ceil(3a/4) + 1`` shortest are merged with a heap, which counts how
often each partner occurs in them; the long ones are never read. A pair that
meets in c of the merged lists can reach T only if ``c >= T - L``, L being the
long lists of the document whose merged part ends first (at most the larger of
a - k and b - k). Whether such a partner stands in the list of a long shingle is
asked the other way round, by binary search for the shingle in the partner's
sorted set; pairs that reach T occurrences are kept.

Lists are told apart by their length: two rounds count those that can be merged, and lists of ``HEAVY`` or more (the ``KNOWN`` longest
of them, a bounded table) come last in the order of every document. The order
is only a matter of cost; the search is exact under any order.

* Documents with equal sets are one class; each task posts a class once. A
  class has a 64-bit key; keys that two classes of 128-bit fingerprints would
  share are told apart.
* Lists are gathered by bucket in tasks of bounded size; the very long ones are
  split into chunks by class.
* Lists of up to ``SHORT`` members go to the heaps of their members. In longer ones
  every member is first probed against two leaders only: the least class, and
  the one whose lists are longest, which stands closest to what a group of near
  copies has in common; then only members outside their list's main component
  are compared with the members of other components of a fitting size, in parts of
  bounded size, by the count of what stands before the list in both and parities of what stands after it. Only pairs
  that may reach T by these are listed and probed. So no list of near copies is
  expanded into all its pairs, and no link between different components is missed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clumpwise.llm.components import connected
from clumpwise.llm.textops import SPACED, cut, map_arrow, mix, text_slices, window_hashes, word_hashes, word_spans

WIDTH = 5
#: Classes (by task) in whose lowest hashes a shingle must lie to count as heavy.
HEAVY = 3
#: Share of heavy shingles from which all of a set's lists are counted.
COMMON = 0.25
#: Most heavy shingles that are broadcast (8 bytes each).
KNOWN = 1 << 20
#: Postings of one bucket, and of one chunk of a list.
BUCKET, CHUNK = 1_000_000, 100_000
#: Members up to which all pairs of a list are counted; longer lists go by leaders first.
SHORT = 8
#: Marks places of shingles whose list is dealt in chunks; places beyond count as the last below.
SPLIT = 1 << 15
#: Postings that a task gathers before it deals them to buckets.
FLUSH = 2_000_000
#: Bits of the filter of candidate classes: 4 MB, at any size of input.
FILTER_BITS = 25
#: Members of one long list and size band that are paired in one part, and the parts in which a list's members learn its main component.
PART, DEALT = 4096, 16
#: Longs of parities that a member of a long list has for its set beyond that list.
SIGNS = 8
SIGN_COLUMNS = [f"s{k}" for k in range(SIGNS)]
#: Members that lead a list's size band in the first turn (four times as many in each later one), most turns, and comparisons by member that need none.
LEADERS, TURNS, EASY = 16, 4, 1024
#: Most keys that may be shared by classes (some 300 are expected among 10^11 classes).
SHARED = 1 << 20

_U = np.uint64


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) of each text; null and wordless texts have none."""
    for i, _, data, offs in text_slices(batch):
        start, end, first = word_spans(data, offs, SPACED)
        windows, at = window_hashes(word_hashes(data, start, end), first, WIDTH)
        for d in range(len(offs) - 1):
            s = np.sort(windows[at[d] : at[d + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield i + d, s


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    n = _U(len(s))
    a = mix(np.asarray([mix(s).sum(dtype=_U) + n], _U)).view(np.int64)[0]
    b = mix(np.asarray([mix(s ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U) ^ n], _U)).view(np.int64)[0]
    return int(a), int(b)


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """How many of n lists are merged: n - ceil(3n/4) + 1."""
    return n - (3 * n + 3) // 4 + 1


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Least common shingles of linked sets of sizes a and b."""
    return (3 * (a + b) + 6) // 7


def classes_of(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with (n, fa, fb): size and fingerprint of each row's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, s in shingle_sets(batch):
                n[row] = len(s)
                if len(s):
                    a[row], b[row] = fingerprint(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), pa.array(a), pa.array(b)], [*batch.schema.names[1:], "n", "fa", "fb"])

    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    fields = [StructField(f"_k{i}", rows.schema[f"_k{i}"].dataType) for i in range(len(keep))]
    out = map_arrow(rows, scan, StructType([*fields, *(StructField(c, LongType()) for c in ("n", "fa", "fb"))]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n", "fa", "fb")


class Keys:
    """The key of a class: the first half of its fingerprint, or, where two classes share that, the second half and a salt."""

    def __init__(self, shared: frozenset[int] = frozenset(), salt: int = 0) -> None:
        self.shared, self.salt = shared, salt

    def __call__(self, a: int, b: int) -> int:
        return b ^ self.salt if a in self.shared else a

    def column(self) -> Column:
        if not self.shared:
            return F.col("fa")
        return F.when(F.col("fa").isin(list(self.shared)), F.col("fb").bitwiseXOR(F.lit(self.salt))).otherwise(F.col("fa"))


def class_keys(classes: DataFrame) -> Keys:
    """Keys that no two of the ``classes`` (distinct fa, fb) share."""
    twice = classes.groupBy("fa").count().where("count > 1").limit(SHARED + 1).collect()
    if len(twice) > SHARED:
        raise ValueError("too many classes share a key")
    shared = frozenset(r[0] for r in twice)
    for k in range(64):
        keys = Keys(shared, k * 0x1E3779B97F4A7C15 & (1 << 63) - 1)
        if not shared or classes.groupBy(keys.column().alias("k")).count().where("count > 1").isEmpty():
            return keys
    raise RuntimeError("class keys did not come apart")


def _new_sets(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[tuple[int, np.ndarray]]:
    """(key, set) of classes that this task has not seen."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for _, s in shingle_sets(batch):
            if len(s) and (both := fingerprint(s)) not in seen:
                seen.add(both)
                yield keys(*both), s


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """One row of packed columns for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cuts[1:], len(bucket))
    packed = [c[order] for c in columns]
    blobs = [pa.array([c[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()) for c in packed]
    return pa.record_batch([pa.array(bucket[cuts].astype(np.int64)), *blobs], schema=schema)


def _gathered(table: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind) for name, kind in kinds.items()]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets)) >> _U(32)


def _lengths(s: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The known length of each shingle's list, else 0."""
    h, n = known
    if not len(h):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
    return np.where(h[at] == s, n[at], 0)


def heavy_lists(docs: DataFrame, keys: Keys, buckets: int, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The longest lists: shingles in rising order and their lengths. At most ``KNOWN`` are sent to the driver.

    The first round counts the lists of every set's lowest hashes. Sets of which
    a quarter (``COMMON``) turns out heavy will reach beyond these, so a second
    round counts the lists of all their other shingles.
    """
    known = docs.sparkSession.sparkContext.broadcast(before)
    schema = pa.schema([("bucket", pa.int64()), ("h", pa.binary()), ("c", pa.binary())])

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(parts), return_counts=True)
        return _dealt(_bucket(h, buckets), [h, c.astype(np.uint32)], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, s in _new_sets(batches, keys):
            k = prefix_length(len(s))
            if known.value is None:
                parts.append(s[:k])
            elif np.count_nonzero(_lengths(s[:k], known.value)) >= COMMON * k:
                parts.append(s[k:])
            else:
                continue
            held += len(parts[-1])
            if held >= FLUSH:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)

    def total(table: pa.Table) -> pa.Table:
        h, c = _gathered(table, {"h": _U, "c": np.uint32})
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.add.reduceat(c, cuts)
        h, n = h[cuts][n >= HEAVY], n[n >= HEAVY]
        return pa.table({"n": (lengths := np.unique(n)), "h": pa.array([h[n == x].tobytes() for x in lengths], pa.binary())})

    dealt = map_arrow(docs.select("text"), scan, "bucket long, h binary, c binary")
    found = cut(dealt.groupBy("bucket").applyInArrow(total, "n long, h binary"))
    least, held = 1 << 62, 0
    for n, k in found.groupBy("n").agg(F.sum(F.length("h") / 8)).orderBy(F.desc("n")).limit(KNOWN).collect():
        if (held := held + k) > KNOWN:
            break
        least = n
    rows = found.where(F.col("n") >= least).collect()
    h = np.frombuffer(b"".join(r[1] for r in rows), _U)
    n = np.repeat(np.asarray([r[0] for r in rows], np.int64), [len(r[1]) // 8 for r in rows])
    if before is not None:
        h, n = np.concatenate([before[0], h]), np.concatenate([before[1], n])
        longest = np.argsort(-n, kind="stable")[:KNOWN]
        h, n = h[longest], n[longest]
    order = np.argsort(h)
    return h[order], n[order]


_LISTS = "kind long, t long, a long, b long, n long, pos long, ids binary, sizes binary, ends binary, early binary"


def merged_lists(docs: DataFrame, keys: Keys, buckets: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The lists by bucket. Rows of kind 0 hold what is merged for a class a of size n: its short lists (later members
    ``ids`` of ``sizes``, lists ending at ``ends``; ``early``: both stand early enough there to be linked). Kind 1
    are members (t, a, n, pos) of long lists, kind 2 leaders (t, a) of chunks, kind 3 pairs (a, b) of a leader and a member of a long list."""
    schema = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in ("h", "cls", "n", "w", "pos"))])
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def ordered(s: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, int]:
        """The merged part of a set, the lengths of its lists where any is heavy, and the mean length."""
        k = prefix_length(len(s))
        if not _lengths(s[:k], known.value).any():
            return s[:k], None, 0
        length = _lengths(s, known.value)
        order = np.argsort(length, kind="stable")[:k]
        return s[order], length[order], int(length.mean() * 16)

    def packed(h: list, cls: list, n: list, many: list, w: list) -> pa.RecordBatch:
        sizes = [len(x) for x in h]
        pos = np.concatenate([np.arange(x) for x in sizes])
        h, cls, n = np.concatenate(h), np.repeat(np.asarray(cls, np.int64), sizes), np.repeat(np.asarray(n, np.uint32), sizes)
        w = np.repeat(np.asarray(w, np.uint32), sizes)
        bucket = _bucket(h, buckets)
        length = np.concatenate([np.zeros(x, np.int64) if m is None else m for x, m in zip(sizes, many, strict=True)])
        for i in np.flatnonzero(length > CHUNK):  # a chunk goes to a bucket of its own choice
            chunk = int(mix(cls[i : i + 1].view(_U) ^ h[i])[0]) % int(-(-length[i] // CHUNK))
            bucket[i] = _bucket(mix(h[i : i + 1] + _U(chunk)), buckets)[0]
        pos = np.minimum(pos, SPLIT - 1) | np.where(length > CHUNK, SPLIT, 0)
        return _dealt(bucket, [h, cls, n, w, pos.astype(np.uint16)], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, ([], [], [], [], [])
        for cls, s in _new_sets(batches, keys):
            h, many, w = ordered(s)
            for part, x in zip(parts, (h, cls, len(s), many, w), strict=True):
                part.append(x)
            held += len(h)
            if held >= FLUSH:
                yield packed(*parts)
                held, parts = 0, ([], [], [], [], [])
        if held:
            yield packed(*parts)

    def merge(table: pa.Table) -> pa.Table:
        h, cls, n, w, pos = _gathered(table, {"h": np.int64, "cls": np.int64, "n": np.uint32, "w": np.uint32, "pos": np.uint16})
        order = np.lexsort((cls, h))
        own = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (cls[order][1:] != cls[order][:-1])])
        h, cls, n, w, pos = (x[order][own].astype(np.int64) for x in (h, cls, n, w, pos))
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes, chunk = np.diff(np.append(cuts, len(h))), pos[cuts] >= SPLIT
        pos &= SPLIT - 1
        keep = (sizes > 1) | chunk
        h, cls, n, w, pos = (x[np.repeat(keep, sizes)] for x in (h, cls, n, w, pos))
        sizes, chunk = sizes[keep], chunk[keep]
        cuts = np.cumsum(sizes) - sizes
        few = (sizes <= SHORT) & ~chunk
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(2, SHORT + 1):
            x, y = np.triu_indices(k, 1)
            at = cuts[few & (sizes == k)][:, None]
            firsts.append((at + x).ravel())
            seconds.append((at + y).ravel())
        x, y = (np.concatenate(v).astype(np.int64) for v in (firsts, seconds))
        good = 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
        x, y = x[good], y[good]
        order = np.lexsort((y, x, cls[x]))  # by class, list, member
        x, y = x[order], y[order]
        own = np.flatnonzero(np.concatenate([[True], cls[x][1:] != cls[x][:-1]])) if len(x) else x
        ends = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1 if len(x) else x
        early = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= needed(n[x], n[y])
        to = np.append(own[1:], len(x))[: len(own)]
        list_to = np.searchsorted(ends, to, side="right")
        blobs: dict[str, list[bytes]] = {"ids": [], "sizes": [], "ends": [], "early": []}
        list_from = 0
        for i, j, k in zip(own.tolist(), to.tolist(), list_to.tolist(), strict=True):
            blobs["ids"].append(cls[y[i:j]].tobytes())
            blobs["sizes"].append(n[y[i:j]].astype(np.uint32).tobytes())
            blobs["ends"].append((ends[list_from:k] - i).astype(np.uint32).tobytes())
            blobs["early"].append(early[i:j].astype(np.uint8).tobytes())
            list_from = k
        many = np.repeat(~few, sizes)
        long_cuts, long_sizes = cuts[~few], sizes[~few]
        star = [np.zeros((0, 2), np.int64)]
        if len(long_cuts):
            by_weight = np.flatnonzero(many)[np.lexsort((cls[many], -w[many], np.repeat(np.arange(len(long_sizes)), long_sizes)))]
            for leader in (long_cuts, by_weight[np.cumsum(long_sizes) - long_sizes]):
                lead = np.repeat(leader, long_sizes)
                u = np.flatnonzero(many)
                t = needed(n[u], n[lead])
                fit = (cls[u] != cls[lead]) & (4 * np.minimum(n[u], n[lead]) >= 3 * np.maximum(n[u], n[lead])) & (n[u] - pos[u] >= t) & (n[lead] - pos[lead] >= t)
                star.append(np.stack([cls[lead][fit], cls[u][fit]], 1))
        star = np.unique(np.sort(np.concatenate(star), 1), axis=0)
        split = cuts[chunk]
        zeros = lambda *counts: [np.zeros(c, np.int64) for c in counts]
        lens = (len(own), int(many.sum()), len(split), len(star))
        none = pa.nulls(sum(lens[1:]), pa.binary())
        return pa.table(
            {
                "kind": np.repeat(np.arange(4), lens),
                "t": np.concatenate([*zeros(lens[0]), h[many], h[split], *zeros(lens[3])]),
                "a": np.concatenate([cls[x[own]], cls[many], cls[split], star[:, 0]]),
                "b": np.concatenate([*zeros(sum(lens[:3])), star[:, 1]]),
                "n": np.concatenate([n[x[own]], n[many], *zeros(sum(lens[2:]))]),
                "pos": np.concatenate([*zeros(lens[0]), pos[many], *zeros(sum(lens[2:]))]),
                **{k: pa.concat_arrays([pa.array(v, pa.binary()), none]) for k, v in blobs.items()},
            }
        )

    dealt = map_arrow(docs.select("text"), scan, "bucket long, h binary, cls binary, n binary, w binary, pos binary")
    return dealt.groupBy("bucket").applyInArrow(merge, _LISTS)


def heap_merged(ids: list[int], sizes: list[int], ends: list[int], early: list[int]) -> list[tuple[int, int, int, int]]:
    """(member, size, occurrences, early somewhere) of rising lists, merged with a heap."""
    starts = [0, *ends[:-1]]
    heap = [(ids[at], at, end) for at, end in zip(starts, ends, strict=True)]
    heapq.heapify(heap)
    out = []
    while heap:
        b, at, _ = heap[0]
        m, times, soon = sizes[at], 0, 0
        while heap and heap[0][0] == b:
            _, at, end = heap[0]
            times, soon = times + 1, soon | early[at]
            if at + 1 < end:
                heapq.heapreplace(heap, (ids[at + 1], at + 1, end))
            else:
                heapq.heappop(heap)
        out.append((b, m, times, soon))
    return out


def occurrences(lists: DataFrame) -> DataFrame:
    """(a, b, n, m, times, early): how often partners b occur in the short lists of each class a.

    The lists of a class, at most its own merged part, meet in one place and are merged there.
    """
    kinds = {"ids": np.int64, "sizes": np.uint32, "ends": np.uint32, "early": np.uint8}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, ...]] = []
        now: tuple[int, int] | None = None
        held: tuple[list[int], ...] = ([], [], [], [])

        def done() -> None:
            if now is not None:
                out.extend((now[0], b, now[1], m, times, soon) for b, m, times, soon in heap_merged(*held))

        def packed() -> pa.RecordBatch:
            columns = np.asarray(out, np.int64).reshape(-1, 6)
            out.clear()
            return pa.record_batch([pa.array(columns[:, k]) for k in range(6)], ["a", "b", "n", "m", "times", "early"])

        for batch in batches:
            a, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = [batch.column(2 + k) for k in range(4)]
            for k in range(batch.num_rows):
                if now != (a[k], n[k]):
                    done()
                    now, held = (a[k], n[k]), ([], [], [], [])
                base = len(held[0])
                for to, part, kind, shift in zip(held, parts, kinds.values(), (0, 0, base, 0), strict=True):
                    x = np.frombuffer(part[k].as_buffer(), kind).tolist()
                    to.extend([v + shift for v in x] if shift else x)
            if len(out) >= 100_000:
                yield packed()
        done()
        yield packed()

    rows = lists.where("kind = 0").select("a", "n", *kinds).repartition("a").sortWithinPartitions("a")
    return map_arrow(rows, merge, "a long, b long, n long, m long, times long, early long")


def candidate_sets(docs: DataFrame, keys: Keys, wanted: DataFrame) -> DataFrame:
    """(cls, s): the sets of ``wanted`` classes, packed.

    A filter of fixed size keeps most other classes out of the shuffle.
    """
    bits = 1 << FILTER_BITS
    slot = F.pmod(F.col("cls"), F.lit(bits))
    rows = (
        wanted.select(F.shiftright(slot, 15).alias("k"), slot.bitwiseAND(32767).alias("at"))
        .groupBy("k")
        .agg(F.bitmap_construct_agg("at").alias("b"))
        .collect()  # at most 2 ** 10 bitmaps of 4 KB
    )
    maps = np.zeros((bits >> 15, 4096), np.uint8)
    for k, b in rows:
        maps[k] |= np.frombuffer(b, np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(maps.reshape(-1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def packed() -> pa.RecordBatch:
            a, s = zip(*out, strict=True)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(s, pa.binary())], ["cls", "s"])

        for key, s in _new_sets(batches, keys):
            at = key % bits
            if known.value[at >> 3] >> (at & 7) & 1:
                out.append((key, s.tobytes()))
                held += len(s)
                if held > 500_000:
                    yield packed()
                    out, held = [], 0
        if out:
            yield packed()

    found = map_arrow(docs.select("text"), scan, "cls long, s binary")
    return found.groupBy("cls").agg(F.first("s").alias("s")).join(wanted, "cls", "left_semi")


def probed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between classes: pairs (a, b) whose sets reach T common shingles, by binary search of one set's in the other."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, sa, sb = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(s[k].as_buffer(), _U) for s in (sa, sb))
                if len(x) > len(y):
                    x, y = y, x
                hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                keep.append(bool(np.count_nonzero(hit) >= needed(len(x), len(y))))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([u.filter(keep), v.filter(keep)], ["u", "v"])

    a = sets.select(F.col("cls").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("cls").alias("b"), F.col("s").alias("sb"))
    return map_arrow(pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb"), probe, "u long, v long")


def reaching(met: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of short lists that may reach T: early enough in one list, and c >= T - L.

    What two classes can have in common beyond short lists is at most the long lists of either.
    """
    long_lists = members.groupBy("a").agg(F.count("*").alias("k"))
    p = met.join(long_lists.withColumnRenamed("k", "ka"), "a", "left").join(long_lists.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b", "left")
    n, m, none = F.col("n"), F.col("m"), F.lit(0)
    c = F.col("times") + F.least(F.coalesce("ka", none), F.coalesce("kb", none))
    enough = c >= F.floor((3 * (n + m) + 6) / 7) - F.greatest(n - prefix_length_column(n), m - prefix_length_column(m))
    return p.where((F.col("early") > 0) & enough).select("a", "b")


def apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """The ``members`` of long lists that more than one component has part in, with their component ``c`` and their list's ``main`` one."""
    m = members.join(label, "a", "left").withColumn("c", F.coalesce("component", "a"))
    m = m.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(DEALT)))
    each = m.groupBy("t", "c").agg(F.count("*").alias("k"))
    main = each.groupBy("t").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("many")).where("many > 1")
    main = main.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    return m.join(main, ["t", "part"]).select(*members.columns, "c", "main")


def comparisons(m: DataFrame) -> tuple[int, int]:
    """The rows of ``apart``, and how many pairs of a member outside its list's main component and any member they make."""
    each = m.groupBy("t").agg(F.count("*").alias("k"), F.count(F.when(F.col("c") != F.col("main"), 1)).alias("out"))
    rows, work = each.agg(F.sum("k"), F.sum(F.col("k") * F.col("out"))).first()
    return rows or 0, work or 0


def parities(s: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For shingles ``t`` of a set, told apart in its order by length and value: how many come before each, and ``SIGNS`` longs of parities.

    A bit tells whether an odd number of the shingles after t fall on it, so two
    sets' bits differ in at most as many places as the sets do after t.
    """
    order = np.lexsort((s, length))
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s))
    pos = rank[np.searchsorted(s, t)]
    by = np.argsort(pos)
    bits = 64 * SIGNS
    slot = (mix(s[order]) % _U(bits)).astype(np.int64)
    seen = np.searchsorted(pos[by], np.arange(len(s)), side="left")  # how many of t come before a shingle
    counts = np.bincount(seen * bits + slot, minlength=(len(t) + 1) * bits).reshape(-1, bits)[1:]
    odd = np.empty((len(t), bits), np.uint8)
    odd[by] = np.cumsum(counts[::-1], axis=0)[::-1] & 1
    return pos, np.packbits(odd, axis=1).view(np.int64)


def marked(m: DataFrame, sets: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Members (t, a) of long lists with n, ``pos``, how many shingles a has before t, and the parities ``s0``, ``s1``, ... of those after it."""
    known = m.sparkSession.sparkContext.broadcast(heavy)
    names = ["t", "a", "n", "pos", *SIGN_COLUMNS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for a, t, s in zip(*(batch.column(k) for k in range(3)), strict=True):
                t, s = np.asarray(t.as_py(), np.int64), np.frombuffer(s.as_buffer(), _U)
                pos, signs = parities(s, _lengths(s, known.value), t.view(_U))
                held.append(np.column_stack([t, np.full(len(t), a.as_py(), np.int64), np.full(len(t), len(s), np.int64), pos, signs]))
                if sum(map(len, held)) >= 20_000:
                    yield pa.record_batch(list(map(pa.array, np.concatenate(held).T)), names)
                    held = []
            if held:
                yield pa.record_batch(list(map(pa.array, np.concatenate(held).T)), names)

    each = m.groupBy("a").agg(F.collect_list("t").alias("t"))  # at most the merged part of a
    each = each.join(sets.select(F.col("cls").alias("a"), "s"), "a")
    return map_arrow(each.select("a", "t", "s"), scan, ", ".join(f"{x} long" for x in names))


def remaining_pairs(m: DataFrame, turn: int | None = None) -> DataFrame:
    """Pairs (a, b) of ``marked`` members of a list that are ``apart`` and whose sets may reach T, this list being that of their first common shingle.

    Of two components one at least is not its list's main one, so the join runs
    between the members outside the main component (with a ``turn`` between some members
    of each list and size band, others each turn) and all members. What stands
    before the first common shingle is in one of the two sets only, and so is a
    shingle after it for each parity that differs; linked sets differ in at
    most n + m - 2T shingles. A linked pair is let through in its first common list, whatever later ones tell.
    """
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3)))  # sizes of linked sets lie in the same or in neighbouring bands
    m = m.withColumn("band", band)
    parts = cut(m.groupBy("t", "band").agg(F.ceil(F.count("*") / PART).alias("parts")))
    if turn is None:
        few = m.where("c <> main")
    else:
        dealt = F.pmod(F.xxhash64("a", "t", F.lit(turn)), F.lit(LEADERS << 2 * turn))
        leaders = m.groupBy("t", "band", dealt.alias("k")).agg(F.min_by("a", F.xxhash64("t", "a", F.lit(turn))).alias("a"))
        few = m.join(leaders.select("t", "a"), ["t", "a"], "left_semi")
    other = {"a": "b", "n": "m", "pos": "at", "c": "d", **{x: f"o{x}" for x in SIGN_COLUMNS}}
    few = few.select("t", *[F.col(x).alias(y) for x, y in other.items()], F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"))
    few = few.join(parts, ["t", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    m = m.join(parts, ["t", "band"]).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    t = F.floor((3 * (F.col("n") + F.col("m")) + 6) / 7)
    differ = F.col("pos") + F.col("at")
    for x in SIGN_COLUMNS:
        differ += F.bit_count(F.col(x).bitwiseXOR(F.col(f"o{x}")))
    good = (
        (F.col("c") != F.col("d"))
        & (F.lit(turn is not None) | (F.col("c") == F.col("main")) | (F.col("a") < F.col("b")))
        & (4 * F.least("n", "m") >= 3 * F.greatest("n", "m"))
        & (F.col("n") - F.col("pos") >= t)
        & (F.col("m") - F.col("at") >= t)
        & (differ <= F.col("n") + F.col("m") - 2 * t)
    )
    same = m.join(few, ["t", "band", "part"]).where(good)
    return same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined_further(docs: DataFrame, keys: Keys, heavy: tuple[np.ndarray, np.ndarray], members: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of ``links`` and of those between ``members`` of long lists that are not among the probed ``pairs``.

    Where lists hold many members outside their main component, turns of few leaders
    come first, so that members who link with many are of one component before the rest is paired.
    """

    def named(found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias("a"), "component")

    found = cut(connected(links))
    m = cut(apart(members, named(found)))
    rows, work = comparisons(m)
    if not rows:
        return found
    sets = cut(candidate_sets(docs, keys, cut(m.select(F.col("a").alias("cls")).distinct())))
    signed = cut(marked(m, sets, heavy))
    m = cut(apart(signed, named(found)))
    for turn in range(TURNS):
        if work <= EASY * rows:
            break
        more = cut(probed(cut(remaining_pairs(m, turn)), sets))
        if more.isEmpty():
            continue
        links = links.union(more)
        found = cut(connected(links))
        m = cut(apart(signed, named(found)))
        rows, work = comparisons(m)
    more = cut(remaining_pairs(m).join(pairs, ["a", "b"], "left_anti"))
    return found if more.isEmpty() else connected(links.union(probed(more, sets)))


def grouped(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with (n, grp): the size of its set and its group of linked texts (null without words).

    Shingles are runs of five words; a text of fewer is one shingle, a null,
    empty or wordless text has none and links with nothing. Groups are of texts:
    rows with one doc_id and different texts stand for themselves.
    """
    rows = cut(classes_of(docs, keep))
    classes = cut(rows.where("n > 0").groupBy("fa", "fb").agg(F.max("n").alias("n")))
    keys = class_keys(classes)
    posted = classes.agg(F.sum(prefix_length_column("n"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-posted // BUCKET))
    heavy = heavy_lists(docs, keys, buckets)
    heavy = heavy_lists(docs, keys, buckets, heavy)
    lists = cut(merged_lists(docs, keys, buckets, heavy))
    members = lists.where("kind = 1").select("t", "a", "n")
    stars = lists.where("kind = 3").select("a", "b")
    pairs = cut(reaching(occurrences(lists), members).union(stars).union(_between_chunks(lists)).distinct())
    links = cut(probed(pairs, _sets_of(docs, keys, pairs)))
    found = joined_further(docs, keys, heavy, members, pairs, links)
    named = rows.where("n > 0").withColumn("_node", keys.column()).join(found.withColumnRenamed("node", "_node"), "_node", "left")
    none = rows.where("n = 0").select(*keep, "n", F.lit(None).cast("long").alias("grp"))
    return named.select(*keep, "n", F.coalesce("component", "_node").alias("grp")).union(none)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id among the rows of its group (see
    ``grouped``), null where no row of the group has one; a row without words has its own doc_id.
    Repeated rows come out as often as they came in. Needs columns ``doc_id``
    (that reads as a long) and ``text``; others are ignored.
    """
    rows = cut(grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    least = cut(rows.where("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("component_id")))
    linked = rows.where("grp is not null").join(least, "grp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(rows.where("grp is null").select("doc_id", "n", "doc_id"))


def _sets_of(docs: DataFrame, keys: Keys, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    return cut(candidate_sets(docs, keys, cut(wanted)))


def _between_chunks(lists: DataFrame) -> DataFrame:
    """Pairs of the leaders of one list's chunks with the least of them."""
    leaders = lists.where("kind = 2").select("t", "a").distinct()
    least = leaders.groupBy("t").agg(F.min("a").alias("b"))
    return leaders.join(least, "t").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def prefix_length_column(n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return n - F.floor((3 * n + 3) / 4) + 1
