"""Labels over edge tables: pointer jumping, components, closures and thread order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder in that of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            place = tempfile.mkdtemp(prefix="clumpwise-")
        sc.setCheckpointDir(place)
    return sc._jsc.sc().getCheckpointDir().get()


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in ``shared_folder``.

    A checkpoint would hand on the size that was estimated for its plan, the product of a join's sides,
    which grows without bound from round to round; a table's size is that of its files.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def follow(targets: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the end of each node's chain in (node, target), by pointer jumping.

    Chains halve each round, so a chain of length n takes log2 n rounds. Ends point at themselves.
    """
    now = reliable(targets.select("node", F.col("target").alias("root")))
    for _ in range(rounds):
        step = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        then = reliable(now.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        now = then.select("node", "root")
        if then.where("moved").isEmpty():
            return now
    raise RuntimeError("a chain has no end")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node; component is the least node reachable over undirected edges (u, v)."""
    e = reliable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        both = big.join(low, "u")
        e = reliable(both.select("u", F.col("m").alias("v")).union(both.select("v", "m")).where("u > v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ancestors(tree: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, ancestor, steps) for each row of (id, parent) with itself and all its ancestors; parent 0 or null ends.

    Doubles the reach each round; the result has as many rows as the tree's nodes times their depth.
    """
    up = reliable(tree.select("id", F.when(F.col("parent") > 0, F.col("parent")).alias("up")).where("up is not null"))
    out = tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps"))
    out, reach = reliable(out), 1
    for _ in range(rounds):
        more = out.join(up.select(F.col("id").alias("ancestor"), "up"), "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("steps") + reach).alias("steps"))
        more = reliable(more)
        if more.isEmpty():
            return out
        out = reliable(out.union(more))
        up = reliable(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
        reach *= 2
    raise RuntimeError("the tree has a loop")
