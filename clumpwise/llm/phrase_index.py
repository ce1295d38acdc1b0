r"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each row holds the postings of a block of
whole documents (about half a megabyte of text), terms in rising order of their hash, each
with its rising word positions. Documents are set apart by a gap, so no phrase
runs over a border. A search sends the test phrases to every block: a phrase's
lists are taken from its rarest term on, each shifted by the term's offset, and
intersected by binary search. Phrases with a term that the block lacks drop out
before any list is read. Exact matches need every term in its place; proximity
matches need each within ``slop`` words of it (in any order).

Blocks never shuffle and postings never meet on one task, so a frequent word or
a passage shared by many documents costs what its own postings cost. The index
is stored in the shared folder (``build_index`` also serves one that is kept and
searched for benchmark after benchmark); test texts are broadcast in shares of
bounded size, long items in pieces that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from clumpwise.llm.textops import ALNUM, map_arrow, ramp, stored, text_slices, word_hashes, word_spans

#: Words in a benchmark window; an item of fewer (but some) words is one window.
WIDTH = 10
#: Words by which a term may be off its place in a proximity match.
SLOP = 2
#: Positions left free between documents: more than WIDTH + 2 * SLOP.
GAP = 64
#: Bytes of test texts that are broadcast at once, and the bytes of an item's piece: windows take some 15 times as much.
TEST_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
#: Postings from which a slice of windows is searched on its own.
STARTS = 1 << 17
#: Bytes of blocks that the stored index holds in a row group, checked after each block: a reader holds a group at once.
GROUP = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}

_POSTINGS = "starts array<int>, n_words array<int>, terms array<long>, at array<int>, positions array<int>"
_SPANS = "array<struct<item_id:string,start:long,end:long,exact:boolean>>"


def build_index(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each block of documents: its number ``block`` (once written or cut), their columns ``keep`` as ``rows``, first positions, word counts, and the postings.

    ``positions[at[k] : at[k + 1]]`` are those of ``terms[k]``. A null text has no words.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), *keep)
    fields = [rows.schema[c] for c in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.StructArray.from_arrays([batch.column(1 + k) for k in range(len(keep))], [f"k{k}" for k in range(len(keep))])
            for i, j, data, offs in text_slices(batch):
                start, end, first = word_spans(data, offs, ALNUM)
                h = word_hashes(data, start, end).view(np.int64)
                count = np.diff(first)
                place = np.arange(len(h), dtype=np.int32) + np.repeat(np.arange(j - i, dtype=np.int32) * GAP, count)
                order = np.argsort(h, kind="stable")
                h = h[order]
                cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                lists = (
                    (kept.slice(i, j - i), None),
                    ((first[:-1] + np.arange(j - i) * GAP).astype(np.int32), pa.int32()),
                    (count.astype(np.int32), pa.int32()),
                    (h[cuts], pa.int64()),
                    (np.append(cuts, len(h)).astype(np.int32), pa.int32()),
                    (place[order], pa.int32()),
                )
                cells = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if t is None else pa.array(v, t)) for v, t in lists]
                yield pa.record_batch(cells, ["rows", "starts", "n_words", "terms", "at", "positions"])

    kind = StructType([StructField("rows", ArrayType(StructType([StructField(f"k{k}", f.dataType) for k, f in enumerate(fields)])))])
    postings = StructType.fromDDL(_POSTINGS)
    return map_arrow(rows, scan, StructType([*kind.fields, *postings.fields])).withColumn("block", F.monotonically_increasing_id())


def stored_index(index: DataFrame) -> DataFrame:
    """The index of ``build_index``, stored (``textops.stored``) in row groups of few blocks.

    Spark reads up to 4,096 rows of a row group at once, and a row here is a block, so that with groups of usual size a task would hold its whole split.
    """
    return stored(index, **GROUP)


def pieces_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id string, text) of the items, long ones in pieces of about ``PIECE_BYTES`` that overlap by ``width`` - 1 words, so that they have the same windows."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                blob, out = (t or "").encode(), []
                data = np.frombuffer(blob, np.uint8)
                start, end, _ = word_spans(data, np.asarray([0, len(data)]), ALNUM)
                k = 0
                while k < len(start):
                    j = max(int(np.searchsorted(end, start[k] + PIECE_BYTES, "right")), k + 2 * width)
                    j = len(start) if len(start) - j < width else j
                    out.append(blob[start[k] : end[j - 1]].decode())
                    k = j if j == len(start) else j - width + 1
                yield pa.record_batch([pa.array([item] * len(out), pa.string()), pa.array(out, pa.string())], ["item_id", "text"])

    return map_arrow(bench, scan, "item_id string, text string")


def windows_of(items: list[tuple[str, str]], width: int = WIDTH) -> dict[str, np.ndarray]:
    """Distinct windows of the items: term numbers (-1: none) by offset, lengths, and which items hold which."""
    blob = [(t or "").encode() for _, t in items]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
    data = np.frombuffer(b"".join(blob), np.uint8)
    start, end, first = word_spans(data, offs, ALNUM)
    words = word_hashes(data, start, end).view(np.int64)
    terms, number = np.unique(words, return_inverse=True)
    rows, owner = [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(items)):
        w = number[first[k] : first[k + 1]]
        if len(w) >= width:
            rows.append(np.lib.stride_tricks.sliding_window_view(w, width))
        elif len(w):
            rows.append(np.concatenate([w, np.full(width - len(w), -1)])[None])
        owner.append(np.full(len(rows[-1]) if len(w) else 0, k))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    if not len(rows):
        return {"terms": terms, "windows": rows, "owner": owner, "owners_at": np.zeros(1, np.int64)}
    windows, which = np.unique(rows, axis=0, return_inverse=True)
    held = np.unique(np.stack([which.reshape(-1), owner], 1), axis=0)
    at = np.searchsorted(held[:, 0], np.arange(len(windows) + 1))
    return {"terms": terms, "windows": windows, "owner": held[:, 1], "owners_at": at}


def matches(q: dict[str, np.ndarray], terms: np.ndarray, at: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact) of all proximity matches in one block, exact ones among them.

    Windows are walked in slices whose rarest terms have about ``STARTS`` postings together, or of one window; what a
    slice needs does not grow with the benchmark.
    """
    none = np.zeros(0, np.int64)
    windows = q["windows"]
    if not len(windows) or not len(terms):
        return none, none, none.astype(bool)
    place = np.minimum(np.searchsorted(terms, q["terms"]), len(terms) - 1)
    known = terms[place] == q["terms"]
    count = np.where(known, at[place + 1] - at[place], 0)
    # postings of the test terms as one rising list of (term, position)
    lens = count
    span = int(positions.max()) + 2 * GAP if len(positions) else 1
    keys = np.repeat(np.arange(len(lens)), lens) * span + positions[ramp(at[place] * known, lens)]
    per = np.where(windows >= 0, count[np.maximum(windows, 0)], np.iinfo(np.int64).max)
    live = np.flatnonzero(per.min(1) > 0)
    if not len(live):
        return none, none, none.astype(bool)
    order = np.argsort(per[live], axis=1, kind="stable")
    first_key = np.concatenate([[0], np.cumsum(lens)])

    def intersect(win: np.ndarray, row: np.ndarray, start: np.ndarray, off: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for k in range(windows.shape[1]):
            if not len(win):
                break
            offset = order[row, k]
            t = windows[win, offset]
            low = t * span + start + offset
            found = np.searchsorted(keys, low - off)
            near = keys[np.minimum(found, len(keys) - 1)]
            ok = (t < 0) | ((near >= low - off) & (near <= low + off))
            win, row, start = win[ok], row[ok], start[ok]
        return win, row, start

    load = np.cumsum(lens[windows[live, order[:, 0]]])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(load, np.arange(STARTS, load[-1], STARTS)) + 1, [len(live)]]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rarest = order[a:b, 0]
        term = windows[live[a:b], rarest]
        row = np.repeat(np.arange(a, b), lens[term])
        start = keys[ramp(first_key[term], lens[term])] - np.repeat(term * span, lens[term]) - np.repeat(rarest, lens[term])
        # the rarest term may be off its place as well
        both = np.unique((row * span + start + GAP)[:, None] + np.arange(-slop, slop + 1))
        row, start = both // span, both % span - GAP
        win, row, start = intersect(live[row], row, start, slop)
        exact = np.ones(len(win), bool)
        if slop:
            w, _, s = intersect(win, row, start, 0)
            exact = np.isin(win * span + start + GAP, w * span + s + GAP)
        out.append((win, start, exact))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(index: DataFrame, items: list[tuple[str, str]], width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """Rows (block, row, keep, n_words, spans): matches of the items' windows in every indexed document, whose kept columns are the struct ``keep``.

    Spans are in words of the document, end exclusive; a proximity span may begin before the document's first word by up to ``slop``.
    """
    q = windows_of(items, width)
    names = np.asarray([str(i) for i, _ in items], object)
    sent = index.sparkSession.sparkContext.broadcast((q, names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        size = (q["windows"] >= 0).sum(1)
        for batch in batches:
            for b in range(batch.num_rows):
                rows, starts, n_words, terms, at, positions = (batch.column(k)[b].values for k in range(6))
                starts, n_words, terms, at, positions = (np.asarray(x).astype(np.int64) for x in (starts, n_words, terms, at, positions))
                win, start, exact = matches(q, terms, at, positions, slop)
                many = q["owners_at"][win + 1] - q["owners_at"][win]
                item = q["owner"][ramp(q["owners_at"][win], many)]
                win, start, exact = (np.repeat(x, many) for x in (win, start, exact))
                doc = np.maximum(np.searchsorted(starts, start + slop, side="right") - 1, 0) if len(start) else start
                order = np.lexsort((item, start, doc))
                doc, item, win, start, exact = (x[order] for x in (doc, item, win, start, exact))
                begin = start - starts[doc] if len(doc) else start
                span = pa.StructArray.from_arrays(
                    [pa.array(names[item] if len(item) else [], pa.string()), pa.array(begin), pa.array(begin + size[win]), pa.array(exact)],
                    ["item_id", "start", "end", "exact"],
                )
                cuts = np.searchsorted(doc, np.arange(len(starts) + 1)).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(np.full(len(starts), batch.column(6)[b].as_py())), pa.array(np.arange(len(starts))), rows, pa.array(n_words), pa.ListArray.from_arrays(pa.array(cuts), span)],
                    ["block", "row", "keep", "n_words", "spans"],
                )

    fields = StructType.fromDDL(f"n_words long, spans {_SPANS}").fields
    kept = StructField("keep", index.schema["rows"].dataType.elementType)
    return map_arrow(index.select("rows", "starts", "n_words", "terms", "at", "positions", "block"), scan, StructType([StructField("block", LongType()), StructField("row", LongType()), kept, *fields]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with (n_words, n_hit, items, near_items, spans) of every row of ``docs``.

    ``n_hit`` counts words inside exact occurrences of windows; ``items`` and
    ``near_items`` are the ids (distinct, sorted as strings) with exact and with
    proximity matches. A null or wordless text or item has no words and matches
    nothing; a null item_id counts as the string "null"; repeated rows each keep
    their row. Other columns are ignored. The index is stored (``textops.stored``).
    """
    return find_in(stored_index(build_index(docs, keep)), benchmark, width, slop, keep)


def find_in(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``find_leaks`` over an index that ``build_index`` has built with the same ``keep`` and that is stored."""
    bench = pieces_of(benchmark, width)
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = -(-size // TEST_BYTES) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))
    found = None
    for k in range(rounds):  # each round broadcasts its share; blocks are numbered, so that rounds meet again by row
        share = [tuple(r) for r in bench.where(part == k).collect()]
        one = search(index, share, width, slop)
        found = one if found is None else found.union(one)
    if rounds > 1:
        found = found.groupBy("block", "row").agg(F.first("keep").alias("keep"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    exact = F.filter("spans", lambda x: x["exact"])
    in_order = F.array_sort(F.transform(exact, lambda x: F.struct(x["start"], x["end"])))
    covered = F.aggregate(
        in_order,
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    names = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda s: s["item_id"])))
    kept = [F.col(f"keep.k{k}").alias(c) for k, c in enumerate(keep)]
    return found.select(*kept, "n_words", covered.alias("n_hit"), names(exact).alias("items"), names(F.col("spans")).alias("near_items"), "spans")
