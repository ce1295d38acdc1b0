"""Periodic range joins of spheres with points, by bucket.

Both sides have classes by powers of two: spheres by their radius, points by how far they
reach themselves (cells: by their level). The two sides of a pair of classes meet on a uniform grid of
their own, whose places are at least as wide as both reach together. A sphere is laid
out over the places that its box touches, once for each class of points; a point once for each grid
on which its class meets spheres. So a sphere meets at most 27 places of each class however large it is, and a few
coarse cells widen no search among fine ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X

#: Finest grid: 2 ** FINEST places a side.
FINEST = 24


def periodic_boxes(spheres: DataFrame, radius: str) -> DataFrame:
    """Up to eight boxes inside [0, 1) that cover each sphere's bounding box; a whole side if the radius is 1/2 or more.

    Rows carry id, box (0 to 7) and lo/hi on each axis; an axis wraps on one side only.
    """
    r = F.col(radius)

    def parts(a: str):
        c = X.wrap(f"p{a}")
        part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        zero, one = F.lit(0.0), F.lit(1.0)
        return (
            F.when(r >= 0.5, F.array(part(zero, one)))
            .when(c - r < 0, F.array(part(zero, c + r), part(c - r + 1, one)))
            .when(c + r > 1, F.array(part(c - r, one), part(zero, c + r - 1)))
            .otherwise(F.array(part(c - r, c + r)))
        )

    out = spheres.select("id", *[parts(a).alias(a) for a in "xyz"])
    for a in "xyz":
        out = out.select("*", F.posexplode(a).alias(f"i{a}", f"b{a}"))
    box = F.col("ix") + 2 * F.col("iy") + 4 * F.col("iz")
    return out.select("id", box.cast("int").alias("box"), *[F.col(f"b{a}.{e}").alias(f"{e}_{a}") for a in "xyz" for e in ("lo", "hi")])


def bucket_index(points: DataFrame, side: int) -> DataFrame:
    """(gx, gy, gz, n): the occupied places of a grid of ``side`` places a side, and how many points (x, y, z in [0, 1)) they hold."""
    return points.groupBy(*[F.floor(F.col(a) * side).alias(f"g{a}") for a in "xyz"]).agg(F.count("*").alias("n"))


def bucket_spans(spheres: DataFrame, radius: str, side: int) -> DataFrame:
    """Spheres with the first and last place of their box on each axis (lo_gx, hi_gx, ...; beyond the grid where it wraps) and ``n``, how many it touches."""
    ends = {f"{n}_g{a}": F.floor((F.col(f"p{a}") + s * F.col(radius)) * side) for a in "xyz" for n, s in (("lo", -1), ("hi", 1))}
    wide = [F.col(f"hi_g{a}") - F.col(f"lo_g{a}") + 1 for a in "xyz"]
    return spheres.withColumns(ends).withColumn("n", (wide[0] * wide[1] * wide[2]).cast("long"))


def _class(size: Column) -> Column:
    """The least power of two, as its exponent, that is not below the size; ``-FINEST`` for less, 1 for all of the box's diagonal and more."""
    up = F.when(size > 0, F.greatest(F.lit(-FINEST), F.least(F.lit(1), F.ceil(F.log2(size)).cast("int")))).otherwise(-FINEST)
    # one up where the logarithm was rounded down
    return F.when(size > F.pow(F.lit(2.0), up), F.least(up + 1, F.lit(1))).otherwise(up)


def meetings(points: DataFrame, spheres: DataFrame, reach: str, slack: str | None = None, classes: Sequence[int] | None = None) -> DataFrame:
    """Pairs of points and spheres on neighbouring places of the grid of their two classes: all that ``points_in_spheres`` looks at."""
    s = spheres.where((F.col(reach) > 0) & ~F.isnan(reach))
    if slack is None:
        p, s, wide = points.withColumn("_c", F.lit(0)), s.withColumn("_c", F.lit(0)), F.lit(0.0)
    else:
        p = points.withColumn("_c", _class(F.col(slack)))
        if classes is None:
            classes = [r[0] for r in p.select("_c").distinct().collect()]  # at most FINEST + 2
        s = s.withColumn("_c", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>")))
        wide = F.pow(F.lit(2.0), F.col("_c"))
    r = F.col(reach) + wide
    level = F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(-F.log2(F.least(r, F.lit(1.0)))).cast("int")))
    s = s.withColumn("_g", level)
    met: dict[int, list[int]] = {}
    for c, g in s.select("_c", "_g").distinct().collect():  # classes of points by those of spheres: some hundred at most
        met.setdefault(c, []).append(g)
    side = F.pow(F.lit(2.0), F.col("_g"))
    for a in "xyz":
        lo, hi = F.floor((F.col(f"p{a}") - r) * side), F.floor((F.col(f"p{a}") + r) * side)
        cells = F.when(F.col("_g") <= 1, F.sequence(F.lit(0).cast("long"), side.cast("long") - 1)).otherwise(
            F.array_distinct(F.transform(F.sequence(lo, hi), lambda c: F.pmod(c, side.cast("long"))))
        )
        s = s.withColumn(f"_{a}", F.explode(cells))
    grids = F.array().cast("array<int>")
    for c, levels in met.items():
        grids = F.when(F.col("_c") == c, F.array(*[F.lit(g) for g in sorted(levels)])).otherwise(grids)
    p = p.withColumn("_g", F.explode(grids))
    for a in "xyz":
        p = p.withColumn(f"_{a}", F.pmod(F.floor(F.col(a) * side), side.cast("long")))
    return p.join(s, ["_c", "_g", "_x", "_y", "_z"]).drop("_c", "_g", "_x", "_y", "_z")


def points_in_spheres(points: DataFrame, spheres: DataFrame, reach: str, slack: str | None = None, classes: Sequence[int] | None = None) -> DataFrame:
    """Rows of ``points`` (x, y, z in box units) with every sphere (id, px, py, pz, reach) whose centre is within reach.

    Adds id, dx, dy, dz, r2, d; columns of spheres other than those pass through. With ``slack``, a column of points, the
    bound is reach + slack (for cells: half their diagonal). Points are classed by their slack, which widens the search of
    spheres among their own class only; ``classes`` names the classes there are (see ``slack_class``), else they are looked up.
    A reach that is null, NaN or not positive takes no point.
    """
    out = meetings(points, spheres, reach, slack, classes)
    for a in "xyz":
        out = out.withColumn(f"d{a}", X.min_image(F.col(a) - F.col(f"p{a}")))
    out = out.withColumn("r2", X.norm2("dx", "dy", "dz")).withColumn("d", F.sqrt("r2"))
    bound = F.col(reach) + (F.col(slack) if slack is not None else F.lit(0.0))
    return out.where(F.col("d") <= bound)


def slack_class(slack: float) -> int:
    """The class of a slack, for ``classes`` of ``points_in_spheres``."""
    if not slack > 0:
        return -FINEST
    up = max(-FINEST, min(1, math.ceil(math.log2(slack))))
    return min(up + 1, 1) if slack > 2.0**up else up
