"""Refined centres: shrinking spheres and nested mesh cells, all structures in step by grouped sums.

Each step is one shuffle of partial sums by structure (or structure and cell), so
no structure is taken whole into a task; the number of steps grows with the
logarithm of the first radius over the least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X
from clumpwise.operators.graph import reliable

AT = ("x", "y", "z")


def _first(rel: DataFrame) -> DataFrame:
    """(halo_id, cx, cy, cz, r): where each structure's search begins."""
    return rel.groupBy("halo_id").agg(*[F.first(f"p{a}").alias(f"c{a}") for a in AT], F.first("start").alias("r"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shrinking_sphere(rel: DataFrame, least: float, shrink: float = 0.3) -> DataFrame:
    """The member nearest to the mass centre of a sphere that shrinks by ``shrink`` until its radius is ``least``.

    ``rel`` has halo_id, pid, x, y, z, mass, a first centre px, py, pz and ``start``, the first radius.
    Members of equal distance are settled by pid.
    """
    rows = reliable(rel.select("halo_id", "pid", *AT, "mass"))
    live, done = reliable(_first(rel)), []
    while True:
        near = rows.join(live, "halo_id").withColumns({f"d{a}": X.min_image(F.col(a) - F.col(f"c{a}")) for a in AT})
        near = near.where(X.norm2("dx", "dy", "dz") <= F.col("r") * F.col("r"))
        sums = near.groupBy("halo_id").agg(F.sum("mass").alias("m"), *[F.sum(F.col("mass") * F.col(f"d{a}")).alias(f"s{a}") for a in AT])
        moved = live.join(sums, "halo_id", "left").withColumns({f"c{a}": F.col(f"c{a}") + F.coalesce(F.try_divide(f"s{a}", "m"), F.lit(0.0)) for a in AT})
        moved = moved.withColumn("go", (F.col("r") > least) & (F.coalesce("m", F.lit(0.0)) > 0))
        moved = reliable(moved.select("halo_id", "cx", "cy", "cz", (F.col("r") * (1 - shrink)).alias("r"), "go"))
        done.append(moved.where("not go").drop("go"))
        live = moved.where("go").drop("go")
        if live.isEmpty():
            break
    d2 = X.norm2(*[X.min_image(F.col(a) - F.col(f"c{a}")) for a in AT])
    best = rows.join(_union(done), "halo_id").groupBy("halo_id").agg(F.min_by(F.struct(*AT, "pid"), F.struct(d2.alias("d2"), "pid")).alias("b"))
    return best.select(F.col("halo_id").alias("id"), *[F.col(f"b.{a}").alias(f"p{a}") for a in AT], F.col("b.pid").alias("pid"))


def nested_cells(rel: DataFrame, least: float, first: int = 9, then: int = 3) -> DataFrame:
    """The densest member in the heaviest cell of a mesh that is refined until a cell is ``then * least`` wide.

    Members carry ``density`` as well; the first heaviest cell and the smaller pid win ties.
    """
    around = lambda a: F.col(f"p{a}") + X.min_image(F.col(a) - F.col(f"p{a}"))
    rows = reliable(rel.select("halo_id", "pid", *AT, "mass", "density", *[around(a).alias(f"u{a}") for a in AT]))
    live, n, done = reliable(_first(rel)), first, []
    while True:
        side = 2 * F.col("r") / n
        cut = rows.join(live, "halo_id").withColumns({f"g{a}": F.floor((F.col(f"u{a}") - (F.col(f"c{a}") - F.col("r"))) / side) for a in AT})
        inside = " and ".join(f"g{a} >= 0 and g{a} < {n}" for a in AT)
        cut = cut.withColumn("cell", (F.col("gx") * n + F.col("gy")) * n + F.col("gz"))
        held = cut.where(inside)
        best = held.groupBy("halo_id", "cell").agg(F.sum("mass").alias("m")).groupBy("halo_id").agg(F.max_by("cell", F.struct("m", -F.col("cell"))).alias("cell"))
        kept = reliable(held.join(best, ["halo_id", "cell"]))
        lost = rows.join(live.select("halo_id"), "halo_id", "left_semi").join(best.select("halo_id"), "halo_id", "left_anti")  # nobody lies inside the mesh
        done.append(kept.where(side <= then * least).select(*rows.columns).unionByName(lost))
        deeper = kept.where(side > then * least)
        if deeper.isEmpty():
            break
        mid = [(F.first(f"c{a}") - F.first("r") + (F.first(f"g{a}") + 0.5) * 2 * F.first("r") / n).alias(f"c{a}") for a in AT]
        live = reliable(deeper.groupBy("halo_id").agg(*mid, (2 * F.first("r") / n).alias("r")))
        rows, n = deeper.select(*rows.columns), then
    top = _union(done).groupBy("halo_id").agg(F.max_by(F.struct(*AT, "pid"), F.struct("density", (-F.col("pid")).alias("o"))).alias("b"))
    return top.select(F.col("halo_id").alias("id"), *[F.col(f"b.{a}").alias(f"p{a}") for a in AT], F.col("b.pid").alias("pid"))
