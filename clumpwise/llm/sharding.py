"""Sharding by Karmarkar-Karp differencing.

Indivisible groups (equal texts) are dealt to shards so that the shards' bytes
come out nearly equal. Up to ``2 * grains`` groups are differenced one by one. Of
more, the heaviest ``grains`` (found from a histogram of their sizes) are still
items of their own, and all lighter ones fall into ``grains`` grains by a hash of
their key, each a union of whole groups. So the differencing sees at most
``2 * grains`` items however large the input is, and runs in one small task:
it keeps a heap of partial partitions (one sum for each shard) and repeatedly
combines the two of largest spread in opposite order, so that the heaviest side
of one meets the lightest of the other. Every item of a light grain is far smaller than
a shard, so grains cost little balance (the README has figures).

Rows never shuffle to learn their shard: item and shard tables are bounded by
``2 * grains`` rows and are broadcast. One narrow shuffle numbers the slots.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clumpwise.llm.textops import cut, ship

#: Most grains of light groups, and most groups that stand alone beside them.
GRAINS = 1 << 14

#: Classes of sizes in a doubling, in the histogram that tells heavy groups.
FINE = 16

#: Rows of one item that are numbered in one window.
SLOT_ROWS = 50_000


def difference(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each size by Karmarkar-Karp differencing, for any number of shards.

    Ties are taken in order of position, so equal input gives equal output; no
    sizes give an empty list. Shards are numbered by falling sum.
    """
    n = len(sizes)
    if not n:
        return []
    # a partial partition: sums by falling order, less the smallest; node k >= n joins two others
    heap: list[tuple[int, int, tuple[int, ...]]] = [(-s, i, (s,) + (0,) * (shards - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, bytes | tuple[int, ...], tuple[int, ...]]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(shards), key=both.__getitem__, reverse=True)
        low = both[order[-1]]
        sums = tuple(both[k] - low for k in order)
        to = [0] * shards
        for rank, k in enumerate(order):
            to[k] = rank
        joined.append((a, b, tuple(to), tuple(to[shards - 1 - k] for k in range(shards))))
        heapq.heappush(heap, (-sums[0], n + len(joined) - 1, sums))
    lane: list[tuple[int, ...] | None] = [None] * (n + len(joined))
    lane[-1] = tuple(range(shards))
    for k in range(len(joined) - 1, -1, -1):
        a, b, of_a, of_b = joined[k]
        up = lane[n + k]
        lane[n + k] = None
        lane[a] = tuple(up[r] for r in of_a)
        lane[b] = tuple(up[r] for r in of_b)
    return [x[0] for x in lane[:n]]


def shard_groups(
    rows: DataFrame, group: Column, size: Column, order: Sequence[Column], shards: int = 16, grains: int = GRAINS
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    Rows of one group stay together. ``size`` must be at least 1. ``order``
    settles slots among rows of one item; rows that tie are interchangeable.
    A null group is one group. An empty table gives an empty table. Columns
    ``_kk_*`` are reserved; any others pass through.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.withColumns({"_kk_key": F.md5(F.coalesce(group.cast("binary"), F.lit("null group").cast("binary"))), "_kk_size": size.cast("long")})
    groups = cut(rows.groupBy("_kk_key").agg(F.sum("_kk_size").alias("bytes"), F.count("*").alias("n")))
    size_class = F.floor(F.log2("bytes") * FINE)
    classes = groups.groupBy(size_class.alias("c")).count().orderBy(F.desc("c")).collect()  # some 64 * FINE rows
    alone, least = 0, None
    for c, n in classes:
        if (alone := alone + n) <= (2 * grains if sum(x[1] for x in classes) <= 2 * grains else grains):
            least = c
    is_heavy = F.lit(False) if least is None else size_class >= least
    grain = F.pmod(F.xxhash64("_kk_key"), F.lit(grains)).cast("string")
    heavy = groups.where(is_heavy)
    items = groups.groupBy(F.when(is_heavy, F.col("_kk_key")).otherwise(grain).alias("_kk_item")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("_kk_item", "ascending")])
        shard = difference(table.column("bytes").to_pylist(), shards)
        parts = [-(-n // SLOT_ROWS) for n in table.column("n").to_pylist()]
        return pa.table({"_kk_item": table.column("_kk_item"), "shard": pa.array(shard, pa.int32()), "_kk_parts": pa.array(parts, pa.int64())})

    # at most 2 * grains rows: one task, recomputed if its executor is lost
    dealt = cut(
        items.groupBy(F.lit(0).alias("_kk_all")).applyInArrow(deal, "_kk_item string, shard int, _kk_parts long")
    )
    placed = (
        rows.join(F.broadcast(heavy.select("_kk_key", F.col("_kk_key").alias("_kk_heavy"))), "_kk_key", "left")
        .withColumn("_kk_item", F.coalesce("_kk_heavy", grain))
        .join(F.broadcast(dealt), "_kk_item")
        .withColumn("_kk_part", F.pmod(F.xxhash64(F.struct(*order)), F.col("_kk_parts")))
        .drop("_kk_heavy", "_kk_parts", "_kk_size")
    )
    runs = placed.groupBy("shard", "_kk_item", "_kk_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_kk_item", "_kk_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "_kk_item", "_kk_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_kk_start"))
    inside = Window.partitionBy("shard", "_kk_item", "_kk_part").orderBy(*order)
    return (
        placed.withColumn("_kk_row", F.row_number().over(inside))
        .join(starts, ["shard", "_kk_item", "_kk_part"])
        .withColumn("slot", F.col("_kk_start") + F.col("_kk_row") - 1)
        .drop("_kk_item", "_kk_part", "_kk_row", "_kk_start", "_kk_key")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents dealt to shards of nearly equal bytes, equal texts together.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty and
    groups with empty texts. Repeated rows each take a slot of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        text.alias("_kk_text"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    narrow = rows.select("doc_id", "size", "text_crc32", F.md5(F.col("_kk_text").cast("binary")).alias("_kk_text_key"))
    return shard_groups(narrow, F.col("_kk_text_key"), F.col("size"), [F.col("doc_id")], shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
