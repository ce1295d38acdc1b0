r"""Product codes of vectors by Yinyang's exact k-means over integers.

Components become integers, vectors are cut into equal parts and every part
position has a codebook. Lloyd's rounds keep, for each part of each vector, an upper bound of the distance
to its entry and one lower bound for each group of entries (entries are clustered into
groups once, from the first codebook). When entries move, bounds drift with them; only groups whose
drifted bound does not exclude them are scanned, with exact integer distances, so that ties
go to the lower index. The bounds are rounded outwards, so skipping never changes a result.

A round is one pass over a table in the shared folder that holds vectors with codes and bounds;
it writes the next such table and its partial sums for the codebooks (a few rows a task). Only
codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clumpwise.llm.textops import checkpoint_dir, drop_folder, map_arrow, stored

#: Parts of a vector, entries of a codebook, rounds, scale of components, and groups of entries.
PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 8, 16, 6, 4096, 4
#: Scaled components must lie below this; with it squared distances of 64 components fit 63 bits.
LIMIT = 1 << 27
#: Relative slack of the bounds, beyond all rounding of their arithmetic in doubles.
SLACK = 1e-12


def integers(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the vectors that are neither null nor hold null or non-finite components; x: floor(scale * component).

    x is null for a vector whose length is no multiple of ``parts`` above 0 or differs from that of the first (by vec_id, then components)
    that has such a length: it can't be coded together with the others. A component that leaves ``LIMIT`` raises an error.
    """
    v = F.col("_v")
    rows = vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("_v"))
    kept = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(kept)
    far = F.raise_error(F.lit(f"a component times {scale} leaves +-{LIMIT}"))
    x = F.transform(v, lambda c: F.when(F.abs(c) < LIMIT / scale, F.floor(c * scale)).otherwise(far.cast("long")))
    rows = rows.select("vec_id", "label", F.when(kept, x).alias("x"))  # conditions on x may be tested before ``kept``
    fits = (F.size("x") > 0) & (F.size("x") % parts == 0)
    first = rows.where(fits).agg(F.min_by(F.size("x"), F.struct(F.col("vec_id").isNull(), "vec_id", "x"))).scalar()
    return rows.withColumn("x", F.when(fits & (F.size("x") == first), F.col("x")))


def clustered(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: farthest-first seeds, then Lloyd's rounds, alike every time."""
    x = entries.astype(float)
    seeds = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(seeds) < min(groups, len(x)) and far.max() > 0:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(1))
    centre = x[seeds]
    for _ in range(10):
        group = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([x[group == g].mean(0) if (group == g).any() else centre[g] for g in range(len(centre))])
    return group


class Codebook:
    """The entries of one part position, their groups, and how far they moved last."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, moved: np.ndarray):
        self.entries, self.group, self.moved = entries, group, moved
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        self.drift = np.asarray([moved[m].max() if len(m) else 0.0 for m in self.members])

    @classmethod
    def first(cls, entries: np.ndarray, groups: int = GROUPS) -> Codebook:
        return cls(entries, clustered(entries, groups), np.zeros(len(entries)))

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Codebook:
        """Entries replaced by floor(sum / count) of their parts; unused ones stay."""
        now = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], self.entries)
        moved = np.sqrt(((now - self.entries) ** 2).sum(1).astype(float)) * (1 + SLACK)
        return Codebook(now, self.group, moved)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each entry."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def assign(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper bound, lower bounds by group): nearest entries by a full scan; ties go to the lower index.

    A lower bound holds for all entries of its group but the nearest one.
    """
    d = squared(x, book.entries)
    code = d.argmin(1)
    rows = np.arange(len(x))
    root = np.sqrt(d.astype(float))
    upper = root[rows, code] * (1 + SLACK)
    root[rows, code] = np.inf
    lower = np.stack([root[:, m].min(1) if len(m) else np.full(len(x), np.inf) for m in book.members], 1) * (1 - SLACK)
    return code, upper, lower


def reassign(x: np.ndarray, book: Codebook, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``assign``, from the codes and bounds before the entries moved; also how many (row, group) pairs were scanned."""
    code = code.copy()
    upper = (upper + book.moved[code]) * (1 + SLACK)
    lower = np.maximum((lower - book.drift) * (1 - SLACK), 0.0)
    open_ = np.flatnonzero(lower.min(1) <= upper)
    if not len(open_):
        return code, upper, lower, 0
    own = x[open_] - book.entries[code[open_]]
    best = (own * own).sum(1)
    was, best_code = best.copy(), code[open_]
    root = np.sqrt(best.astype(float)) * (1 + SLACK)
    upper[open_] = root
    scan = lower[open_] <= root[:, None]
    before = code[open_]
    scanned = 0
    seen: list[tuple[int, np.ndarray, np.ndarray]] = []
    for g, m in enumerate(book.members):
        at = np.flatnonzero(scan[:, g])
        if not len(at) or not len(m):
            continue
        scanned += len(at)
        d = squared(x[open_[at]], book.entries[m])
        seen.append((g, at, d))
        k = d.argmin(1)
        least, entry = d[np.arange(len(at)), k], m[k]
        better = (least < best[at]) | ((least == best[at]) & (entry < best_code[at]))
        best[at] = np.where(better, least, best[at])
        best_code[at] = np.where(better, entry, best_code[at])
    code[open_] = best_code
    upper[open_] = np.sqrt(best.astype(float)) * (1 + SLACK)
    for g, at, d in seen:
        root = np.sqrt(d.astype(float))
        root[book.members[g][None, :] == best_code[at][:, None]] = np.inf
        lower[open_[at], g] = root.min(1) * (1 - SLACK)
    # an entry that lost its row counts in its group's bound again; scanned groups hold it already
    lost = np.flatnonzero(best_code != before)
    if len(lost):
        g = book.group[before[lost]]
        fresh = ~scan[lost, g]
        rows, g = open_[lost[fresh]], g[fresh]
        lower[rows, g] = np.minimum(lower[rows, g], np.sqrt(was[lost[fresh]].astype(float)) * (1 - SLACK))
    return code, upper, lower, scanned


def _outward(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in 32 bits, rounded outwards."""
    up, low = upper.astype(np.float32), lower.astype(np.float32)
    up = np.where(up < upper, np.nextafter(up, np.float32(np.inf)), up)
    return up, np.where(low > lower, np.nextafter(low, np.float32(0)), low)


def _step(books: list[Codebook], first: bool, last: bool):
    """The pass of a round over Arrow batches: rows with new codes and bounds, and at the end the sums of its parts."""
    parts, entries = len(books), len(books[0].entries)
    groups = [len(b.members) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].entries.shape[1]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(n, parts, width).astype(np.int64)
            if first:
                codes = uppers = lowers = None
            else:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                bounds = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f4").reshape(n, -1).astype(float)
                uppers, lowers = bounds[:, :parts], bounds[:, parts:]
            new, ups, lows, error, at = np.empty((n, parts), np.uint8), [], [], np.zeros(n, np.int64), 0
            for p, book in enumerate(books):
                own = np.ascontiguousarray(x[:, p])
                if first:
                    code, up, low = assign(own, book)
                else:
                    code, up, low, _ = reassign(own, book, codes[:, p].astype(np.int64), uppers[:, p], lowers[:, at : at + groups[p]])
                at += groups[p]
                new[:, p] = code
                if last:
                    d = own - book.entries[code]
                    error += (d * d).sum(1)
                else:
                    up, low = _outward(up, low)
                    ups.append(up[:, None])
                    lows.append(low)
                    counts[p] += np.bincount(code, minlength=entries)
                    np.add.at(sums[p], code, own)
            rows = [batch.column(0), batch.column(1)]
            if last:
                text = new.tobytes().hex()
                k = 2 * parts
                yield pa.RecordBatch.from_arrays([*rows, pa.array([text[i : i + k] for i in range(0, n * k, k)]), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                bound = np.concatenate([*ups, *lows], 1).astype("<f4").tobytes()
                size, raw = len(bound) // n, new.tobytes()
                made = [pa.array([raw[i : i + parts] for i in range(0, n * parts, parts)], pa.binary()), pa.array([bound[i : i + size] for i in range(0, n * size, size)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows, batch.column(2), *made, pa.array(["rows"] * n), *[pa.nulls(n, pa.int64())] * 5], [*STATE, "kind", *SUMS])
        if not last and counts.any():
            p, e, k = (a.ravel() for a in np.meshgrid(np.arange(parts), np.arange(entries), np.arange(width), indexing="ij"))
            n = len(p)
            none = [pa.nulls(n, t) for t in (batch.schema.field(0).type, batch.schema.field(1).type, pa.binary(), pa.binary(), pa.binary())]
            number = [pa.array(a.astype(np.int64)) for a in (p, e, k, sums.ravel(), np.repeat(counts.ravel(), width))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(["sums"] * n), *number], [*STATE, "kind", *SUMS])

    return run


STATE = ("vec_id", "label", "x", "codes", "bounds")
SUMS = ("part", "entry", "place", "total", "many")


def code_vectors(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error) of every kept vector, the final codebooks).

    The codebooks begin with the parts of the ``entries`` vectors of smallest vec_id (ties by components, null ids last; of fewer vectors
    all); equal beginnings keep their places, and of equal entries the first is used. A vector that can't be coded with the others
    (see ``integers``) has null code and error. No kept vectors give no rows and no codebooks. Repeated rows each count.
    """
    spark = vectors.sparkSession
    rows = stored(integers(vectors, vector, parts))
    begin = rows.where("x is not null").orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    kinds = [f for f in rows.schema.fields if f.name in ("vec_id", "label")]
    out = StructType([*kinds, *StructType.fromDDL("code string, error long").fields])
    if not begin:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    seed = np.asarray([r[0] for r in begin], np.int64)
    seed = seed.reshape(len(seed), parts, -1)
    books = [Codebook.first(np.ascontiguousarray(seed[:, p]), groups) for p in range(parts)]
    state = StructType([*kinds, *StructType.fromDDL("x binary, codes binary, bounds binary, kind string, " + ", ".join(f"{c} long" for c in SUMS)).fields])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(2).flatten().to_numpy().astype("<i4").tobytes()
                size = len(flat) // b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([flat[i : i + size] for i in range(0, len(flat), size)], pa.binary())], ["vec_id", "label", "x"])

    now = map_arrow(rows.where("x is not null"), packed, StructType([*kinds, *StructType.fromDDL("x binary").fields]))
    place, before = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}", None
    for k in range(rounds):
        at = f"{place}/{k}"
        map_arrow(now, _step(books, not k, False), state).write.partitionBy("kind").parquet(at)
        if before:
            drop_folder(spark, before)
        before = at
        # parts * entries * width rows
        found = spark.read.parquet(f"{at}/kind=sums").groupBy(*SUMS[:3]).agg(F.sum("total"), F.sum("many")).collect()
        sums, counts = np.zeros((parts, len(seed), seed.shape[2]), np.int64), np.zeros((parts, len(seed)), np.int64)
        for p, e, c, total, many in found:
            sums[p, e, c], counts[p, e] = total, many
        books = [b.after(sums[p], counts[p]) for p, b in enumerate(books)]
        now = spark.read.parquet(f"{at}/kind=rows").select(*STATE)
    coded = map_arrow(now, _step(books, not rounds, True), out)
    other = rows.where("x is null").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    done = stored(coded.unionByName(other))
    if before:
        drop_folder(spark, before)
    return done, [b.entries for b in books]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes of ``code_vectors``, and the error summed over equal labels (nulls together)."""
    rows, books = code_vectors(vectors, vector)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    found = rows.join(sums.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

