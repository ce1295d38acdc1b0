r"""Source divergence audit: how the sources of a language differ in their terms.

Terms are cut from the UTF-8 buffers of many documents at once: a lookup table
of bytes finds their boundaries, XXH64 of the slices (computed for all slices of one
length together) groups them, and every slice is compared byte by byte with its group's
first, so that terms that share a hash are told apart. Counts are summed in the task,
then by Spark. Divergences come from sparse matrices of sources by terms, a block of
terms and two tiles of sources a task: what an entry adds to a pair of sources beyond two absent
terms is summed over each row's entries with ``reduceat``. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clumpwise.llm.textops import map_arrow, ramp, stored, text_slices

#: Documents of a language that must hold a term; the scale of probabilities; terms that a group reports.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Counted rows that a task holds before it hands them on.
HELD_ROWS = 400_000
#: Sources in a tile, and entries in a block of terms.
TILE, BLOCK = 256, 20_000

_U = np.uint64
_P = [_U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]

#: Bytes of terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``, and lower case of A-Z.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << _U(k)) | (x >> _U(64 - k))


def slice_hashes(slices: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each row of an (n, length) matrix of bytes; rows of 32 bytes and more one by one."""
    n, length = slices.shape
    if length >= 32:
        return np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in slices), _U, n)
    h = np.full(n, _P[4] + _U(length), _U)
    at = 0
    while at + 8 <= length:
        lane = np.ascontiguousarray(slices[:, at : at + 8]).view("<u8")[:, 0]
        h ^= _turned(lane * _P[1], 31) * _P[0]
        h = _turned(h, 27) * _P[0] + _P[3]
        at += 8
    if at + 4 <= length:
        lane = np.ascontiguousarray(slices[:, at : at + 4]).view("<u4")[:, 0].astype(_U)
        h = _turned(h ^ (lane * _P[0]), 23) * _P[1] + _P[2]
        at += 4
    for k in range(at, length):
        h = _turned(h ^ (slices[:, k].astype(_U) * _P[4]), 11) * _P[0]
    h = (h ^ (h >> _U(33))) * _P[1]
    h = (h ^ (h >> _U(29))) * _P[2]
    return h ^ (h >> _U(32))


def grouped(slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group, group of each row) of equal rows: by hash, then compared byte by byte."""
    _, first, group = np.unique(slice_hashes(slices), return_index=True, return_inverse=True)
    odd = np.flatnonzero((slices != slices[first[group]]).any(1))
    if len(odd):  # rows that only share a hash with their group's first
        found: dict[tuple[int, bytes], int] = {}
        more = []
        for k in odd:
            key = int(group[k]), slices[k].tobytes()
            if key not in found:
                found[key] = len(first) + len(more)
                more.append(k)
            group[k] = found[key]
        first = np.concatenate([first, more])
    return first, group


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct terms, term of each occurrence, document of each occurrence) of documents data[offsets[d] : offsets[d + 1]]."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    low, lens = _LOWER[data], end - start
    order = np.argsort(lens, kind="stable")
    bounds = np.flatnonzero(np.diff(lens[order], prepend=-1, append=-1))
    terms: list[bytes] = []
    which = np.empty(len(start), np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        rows, length = order[a:b], int(lens[order[a]])
        step = max(1, (1 << 22) // length)  # a slice of a very long term stands alone
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            slices = low[start[part][:, None] + np.arange(length)]
            first, group = grouped(slices)
            which[part] = group + len(terms)
            terms += [x.tobytes() for x in slices[first]]
    return terms, which, doc


def slice_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, then for each group and term that occurs: group, term, occurrences, documents)."""
    terms, which, doc = terms_of(data, offsets)
    t = max(len(terms), 1)
    pair, many = np.unique(doc * t + which, return_counts=True)
    key = group[pair // t] * t + pair % t
    order = np.argsort(key, kind="stable")
    key, many = key[order], many[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(many, begin) if len(begin) else many
    docs = np.diff(np.append(begin, len(key)))
    return terms, key[begin] // t, key[begin] % t, n, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row of an empty term for each group.

    Nulls in text, lang and source count as ''. A task hands on its counts whenever it holds ``HELD_ROWS``.
    """
    schema = "lang string, source string, term string, n long, docs long"
    names = ["lang", "source", "term"]

    def summed(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by(names).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select([*names, "n_sum", "docs_sum"]).rename_columns([*names, "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            # pairs of names, told apart by a struct
            kinds = [pa.array(batch.column(k).to_pylist(), pa.string()).dictionary_encode() for k in (1, 2)]
            codes = [k.indices.to_numpy(zero_copy_only=False).astype(np.int64) for k in kinds]
            both, group = np.unique(codes[0] * len(kinds[1].dictionary) + codes[1], return_inverse=True) if batch.num_rows else (codes[0], codes[0])
            lang = kinds[0].dictionary.take(pa.array(both // max(len(kinds[1].dictionary), 1)))
            source = kinds[1].dictionary.take(pa.array(both % max(len(kinds[1].dictionary), 1)))
            zero = pa.array(np.zeros(len(both), np.int64))
            held.append(pa.table({"lang": lang, "source": source, "term": pa.array([""] * len(both), pa.string()), "n": zero, "docs": zero}))
            for i, j, data, offs in text_slices(batch, "text"):
                terms, g, t, n, d = slice_counts(data, offs, group[i:j])
                words = pa.array(terms, pa.binary()).cast(pa.string())
                held.append(pa.table({"lang": lang.take(pa.array(g)), "source": source.take(pa.array(g)), "term": words.take(pa.array(t)), "n": pa.array(n, pa.int64()), "docs": pa.array(d, pa.int64())}))
                if sum(len(x) for x in held) > HELD_ROWS:
                    held = [summed(held)]
                    if len(held[0]) > HELD_ROWS // 2:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                        held = []
        if held:
            yield from summed(held).combine_chunks().to_batches(max_chunksize=50_000)

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return map_arrow(rows, count, schema).groupBy(*names).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for any counts of 64 bits."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of numbers up to SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def sparse_excess(data: np.ndarray, columns: np.ndarray, indptr: np.ndarray, zero: np.ndarray, width: int, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row a of ``first`` its excess over absent terms against every row of ``second``.

    The matrix in compressed rows holds p where a term occurs; elsewhere a row has its ``zero``. The excess is the sum of
    f(p_a, p_b) - f(zero_a, zero_b) over the columns where either row has an entry.
    """
    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    lens = np.diff(indptr)
    take = ramp(indptr[second], lens[second])
    p, col, of = data[take], columns[take], np.repeat(zero[second], lens[second])
    begin = np.concatenate([[0], np.cumsum(lens[second])])
    some = np.flatnonzero(lens[second])
    for a in first:
        own, at = data[indptr[a] : indptr[a + 1]], columns[indptr[a] : indptr[a + 1]]
        dense = np.full(width, zero[a])
        dense[at] = own
        base = f(zero[a], zero[second])
        # a's entries against absent terms of b, then b's entries against what that assumed
        levels, level = np.unique(zero[second], return_inverse=True)
        out = np.asarray([f(own, z).sum() for z in levels], np.int64)[level] - len(own) * base
        if len(some):
            held = np.zeros(width, bool)
            held[at] = True
            x = dense[col]
            was = np.where(held[col], f(x, of), 0)
            now = f(x, p) - np.where(held[col], was, np.repeat(base, lens[second]))
            out[some] += np.add.reduceat(now, begin[:-1][some])
        yield a, out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each group from other sources (``pair``) and its ``top`` over-used terms (``term``).

    A language keeps the terms of at least ``least_docs`` of its documents. Nulls count as ''; texts without terms still make their group
    occur. A language of one source has no pairs, one without kept terms pairs of value 0. No documents give no rows; other columns are not
    read. Repeated rows count as often as they occur.
    """
    counts = stored(term_counts(docs))
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least_docs)
    terms = stored(terms.select("lang", "term", "n_lang"))
    kept = stored(counts.where("term <> ''").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    entries = kept.groupBy("lang").agg(F.count("*").alias("entries"))
    langs = sizes.join(langs, "lang", "left").join(entries, "lang", "left").na.fill(0)
    zero = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", zero))
    groups = groups.withColumns(
        {
            "zero": F.when(F.col("v") > 0, probability(zero, F.col("total"), F.col("v"))).otherwise(1),
            "tiles": F.ceil(F.col("sources") / tile).cast("int"),
        }
    )
    # blocks so large that a task's two tiles hold about ``block`` entries
    groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("entries") * 2 / F.col("tiles") / block), F.lit(1)).cast("int"))
    groups = stored(groups.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")))
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("v")))

    over = rows.withColumn("q", probability(F.col("n_lang"), F.col("total_lang"), F.col("v"))).where("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    pairs = source_pairs(rows, groups)
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(over)


def source_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of a language's sources."""
    names = ("lang", "source", "zero", "tile")
    cells = rows.select(*names, "tiles", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "p")
    marks = groups.select(*names, "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    cells = cells.unionByName(marks).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select(*names, "block", "term", "p", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"))

    def excess(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        marks = table.filter(pa.compute.is_null(table.column("p"))).sort_by("source")
        names = marks.column("source")
        zero, tile = (marks.column(c).to_numpy().astype(np.int64) for c in ("zero", "tile"))
        cells = table.filter(pa.compute.is_valid(table.column("p")))
        row = pa.compute.index_in(cells.column("source"), value_set=names.combine_chunks()).to_numpy().astype(np.int64)
        order = np.argsort(row, kind="stable")
        column = cells.column("term").combine_chunks().dictionary_encode()
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column, p = column.indices.to_numpy().astype(np.int64)[order], cells.column("p").to_numpy()[order]
        indptr = np.searchsorted(row[order], np.arange(len(names) + 1))
        first, second = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        found_a, found_b, values = [], [], []
        for a, out in sparse_excess(p, column, indptr, zero, int(column.max(initial=-1)) + 1, first, second):
            ok = second > a if i == j else np.ones(len(second), bool)
            found_a.append(np.full(ok.sum(), a))
            found_b.append(second[ok])
            values.append(out[ok])
        a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b, values))
        return pa.table(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()),
                "a": names.take(pa.array(a)),
                "b": names.take(pa.array(b)),
                "zero_a": pa.array(zero[a], pa.int64()),
                "zero_b": pa.array(zero[b], pa.int64()),
                "excess": pa.array(value, pa.int64()),
            }
        )

    found = cells.groupBy("lang", "i", "j", "block").applyInArrow(excess, "lang string, a string, b string, zero_a long, zero_b long, excess long")
    sums = found.groupBy("lang", "a", "b", "zero_a", "zero_b").agg(F.sum("excess").alias("excess"))
    size = groups.groupBy("lang").agg(F.max("v").alias("v"))
    sums = sums.join(size, "lang").withColumn("value", F.col("excess") + F.col("v") * divergence(F.col("zero_a"), F.col("zero_b")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("e"), "value").select("lang", "e.source", "e.item", "value")
