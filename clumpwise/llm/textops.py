"""Shared byte-level text kernels and Arrow plumbing for the document operators.

Everything here works on the UTF-8 bytes of whole texts, many documents at a
time, in slices of bounded size that never cut a document.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes handled at once by the vectorised kernels (one longer document goes alone).
SLICE_BYTES = 1 << 19

#: Rows that a function sees at once, so that long texts stay bounded (Spark's own batches are bounded in bytes).
BATCH_ROWS = 512

_U = np.uint64


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, as a Python archive."""
    sc = spark.sparkContext
    if getattr(sc, "_clumpwise_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), "clumpwise_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    sc._clumpwise_shipped = True


def release() -> None:
    """Give free memory back to the system, so that idle Python workers stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _released(fn: Callable) -> Callable:
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, max(b.num_rows, 1), BATCH_ROWS):
                yield b.slice(k, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(few(batches))
        finally:
            release()

    return run


def map_arrow(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with the package shipped and Arrow batches of bounded rows."""
    ship(df.sparkSession)
    return df.mapInArrow(_released(fn), schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = getattr(sc, "_clumpwise_checkpoint", None) or tempfile.mkdtemp(prefix="clumpwise-")
        sc._clumpwise_checkpoint = place
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **options: int) -> DataFrame:
    """``df`` written as Parquet in the shared folder, with the writer's ``options``, and read again, where later reads want few of its columns.

    ``drop_stored`` removes what a session has stored so.
    """
    spark = df.sparkSession
    place = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    _STORED.append(place)
    return spark.read.parquet(place)


def drop_folder(spark: SparkSession, place: str) -> None:
    """Delete a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_places() -> tuple[str, ...]:
    """The folders of ``stored`` tables, in the order they were written."""
    return tuple(_STORED)


def drop_stored(spark: SparkSession, places: Iterable[str] | None = None) -> None:
    """Delete the given (else all) tables of ``stored``; nothing that still reads them may be left."""
    for place in tuple(_STORED) if places is None else places:
        if place in _STORED:
            _STORED.remove(place)
            drop_folder(spark, place)


_STORED: list[str] = []


def sampled_ids(labels: DataFrame, sample: int) -> DataFrame:
    """The rows of ``labels`` (distinct doc_id) of at most ``sample`` doc_ids, those of least hash.

    A bound on the hash is guessed from the count and then made exact from the
    hashes below it, so about ``sample`` longs reach the driver however many tasks there are.
    """
    hashed = labels.withColumn("_h", F.xxhash64("doc_id"))
    n = labels.count()
    if n <= sample:
        return labels
    share = 1.2 * sample / n + 64 / n
    while True:
        bound = -(1 << 63) + min(int(share * 2.0**64), (1 << 64) - 1)
        found = sorted(r[0] for r in hashed.where(F.col("_h") <= bound).select("_h").collect())
        if len(found) > sample or bound == (1 << 63) - 1:
            break
        share *= 2
    return hashed.where(F.col("_h") < (found[sample] if len(found) > sample else bound)).drop("_h")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of slices of a batch's documents."""
    data, offs = utf8(batch.column(batch.schema.get_field_index(name)))
    for i, j in slices(offs):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = _BYTE[_LOWER]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]

#: Words between white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words of digits, letters and anything beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, b, _U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document) in bytes; words never cross documents.

    The last array has n + 1 entries, so document d owns words first[d]:first[d + 1].
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = w.copy()
    left[1:] &= ~w[:-1] | edge[1:-1]
    right = w.copy()
    right[:-1] &= ~w[1:] | edge[1:-1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return start, end, np.searchsorted(start, offsets)


#: Bytes from which words are hashed one by one.
LONG_WORD = 32


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if ``fold``.

    Words of fewer than ``LONG_WORD`` bytes are hashed together by a polynomial. Modulo 2 ** 64 that loses some bits for
    every doubling of a pattern that swaps two letters, and all from a thousand letters on, so longer words have XXH64.
    """
    if not len(start):
        return np.zeros(0, _U)
    powers, inverse = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _BYTE)[data] * powers[: len(data)], out=total[1:])
    out = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(end - start >= LONG_WORD):
        word = data[start[k] : end[k]]
        out[k] = xxhash.xxh64_intdigest((_LOWER[word] if fold else word).tobytes())
    return out


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside documents, and each document's first window.

    A document of fewer words (but some) has one window: its whole sequence.
    """
    count = np.diff(first)
    n = len(words) - width + 1
    many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(out_first[-1], _U)
    if n > 0:
        h = np.zeros(n, _U)
        for k in range(width):
            h = (h + words[k : k + n]) * _U(0x9FB21C651E98DF25 + 2 * k)
        h = mix(h)
    long_ = np.flatnonzero(count >= width)
    if len(long_):
        lens = many[long_]
        src = np.repeat(first[long_] - out_first[long_], lens) + ramp(out_first[long_], lens)
        out[ramp(out_first[long_], lens)] = h[src]
    for d in np.flatnonzero((count > 0) & (count < width)):
        v = np.full(1, 0xA24BAED4963EE407 + int(count[d]), _U)
        for k in range(first[d], first[d + 1]):
            v = mix(v * _U(0x9FB21C651E98DF25) + words[k : k + 1])
        out[out_first[d]] = v[0]
    return out, out_first


def ramp(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] : start[i] + lens[i]."""
    if not len(lens) or not lens.sum():
        return np.zeros(0, np.int64)
    total = np.cumsum(lens)
    return np.arange(total[-1]) + np.repeat(np.asarray(start) - (total - lens), lens)
