"""Stellar light from a grid of simple populations: bracketing, interpolation and sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X
from clumpwise.operators.members import fraction_radii


def axis(grid: DataFrame, column: str) -> list[float]:
    """The rising values of one axis of a grid; grids hold a few thousand rows."""
    return [r[0] for r in grid.select(column).distinct().orderBy(column).collect()]


def checked_grid(grid: DataFrame, bands: Sequence[str]) -> DataFrame:
    """``grid``, or an error where bands are missing, or a cell of its axes is missing, double or without a number."""
    missing = [b for b in bands if b not in grid.columns]
    if missing:
        raise ValueError(f"the grid has no {', '.join(missing)}")
    whole = F.countDistinct("log_z") * F.countDistinct("log_age")
    number = [F.col(b).isNotNull() & ~F.isnan(b) for b in bands]
    n, cells, full, numbers = grid.agg(F.count("*"), F.countDistinct("log_z", "log_age"), whole, F.count(F.when(reduce(lambda a, b: a & b, number, F.lit(True)), 1))).first()
    if not n == cells == full == numbers:
        raise ValueError(f"the grid has {n} rows, {cells} cells of {full}, and {numbers} rows with numbers")
    return grid


def grid_axes(grid: DataFrame) -> DataFrame:
    """(n, n_z, n_age, lo, hi): cells of a grid, points of its axes, and the ends of its ages."""
    return grid.agg(F.count("*").alias("n"), F.countDistinct("log_z").alias("n_z"), F.countDistinct("log_age").alias("n_age"), F.min("log_age").alias("lo"), F.max("log_age").alias("hi"))


def bracket(value: Column, points: Sequence[float]) -> tuple[Column, Column]:
    """(upper place, weight of the upper point): values are clipped to the axis, places to 1 .. n - 1."""
    n = len(points)
    lits = F.array(*[F.lit(float(p)) for p in points])
    clipped = F.greatest(F.lit(float(points[0])), F.least(F.lit(float(points[-1])), value))
    upper = F.least(F.greatest(F.size(F.filter(lits, lambda p: p <= clipped)), F.lit(1)), F.lit(n - 1))
    low, high = F.get(lits, upper - 1), F.get(lits, upper)
    weight = F.when(high > low, (clipped - low) / (high - low)).otherwise(0.0)
    return upper, weight


def with_magnitudes(stars: DataFrame, grid: DataFrame, bands: Sequence[str], age: str = "age_gyr", metal: str = "metal") -> DataFrame:
    """Stars with one magnitude a band by bilinear interpolation in log age and log metallicity.

    The grid (iz, ia, log_z, log_age, bands) is folded into one row a cell with its four corners and broadcast.
    """
    checked_grid(grid, bands)
    ages, metals = axis(grid, "log_age"), axis(grid, "log_z")
    ia, wa = bracket(F.when(F.col(age) > 0, F.log10(F.col(age) * 1e9)).otherwise(float(ages[0])), ages)
    iz, wz = bracket(F.when(F.col(metal) > 0, F.log10(metal)).otherwise(float(metals[0])), metals)
    rows = stars.withColumns({"_ia": ia, "_wa": wa, "_iz": iz, "_wz": wz})
    corner = grid.select("iz", "ia", F.struct(*bands).alias("c"))
    cells = corner.select((F.col("iz") + 1).alias("_iz"), (F.col("ia") + 1).alias("_ia"), F.col("c").alias("c00"))
    for name, dz, da in (("c01", 1, 0), ("c10", 0, 1), ("c11", 0, 0)):
        other = corner.select((F.col("iz") + dz).alias("_iz"), (F.col("ia") + da).alias("_ia"), F.col("c").alias(name))
        cells = cells.join(other, ["_iz", "_ia"])
    rows = rows.join(F.broadcast(cells), ["_iz", "_ia"])  # a grid's cells: a few thousand rows
    for b in bands:
        low = F.col(f"c00.{b}") * (1 - F.col("_wa")) + F.col(f"c01.{b}") * F.col("_wa")
        high = F.col(f"c10.{b}") * (1 - F.col("_wa")) + F.col(f"c11.{b}") * F.col("_wa")
        rows = rows.withColumn(f"mag_{b}", low * (1 - F.col("_wz")) + high * F.col("_wz"))
    return rows.drop("_ia", "_wa", "_iz", "_wz", "c00", "c01", "c10", "c11")


def total_light(stars: DataFrame, bands: Sequence[str], red: str) -> DataFrame:
    """By structure: total magnitudes, and age and metallicity weighted by light in ``red``."""
    lum = lambda b: F.col("mass") * X.luminosity(f"mag_{b}")
    agg = [X.magnitude(F.sum(lum(b))).alias(b) for b in bands]
    for c, name in (("age_gyr", "age_r"), ("metal", "metal_r")):
        agg.append(F.try_divide(F.sum(lum(red) * F.col(c)), F.sum(lum(red))).alias(name))
    return stars.groupBy("halo_id").agg(*agg)


def light_radii(rel: DataFrame, red: str, tail: str = "") -> DataFrame:
    return fraction_radii(rel, F.col("mass") * X.luminosity(f"mag_{red}"), {f"r50_r{tail}": 0.5, f"r90_r{tail}": 0.9})


def with_models(stars: DataFrame, grids: Mapping[str, DataFrame], bands: Sequence[str], age: str = "age_gyr", metal: str = "metal") -> DataFrame:
    """Stars with one magnitude a model and band, mag_{band}_{model}; the models' grids may have axes of their own."""
    for model, grid in grids.items():
        stars = with_magnitudes(stars, grid, bands, age, metal).withColumnsRenamed({f"mag_{b}": f"mag_{b}_{model}" for b in bands})
    return stars


def models_light(stars: DataFrame, models: Sequence[str], bands: Sequence[str], red: str) -> DataFrame:
    """By structure, for all models in one pass: what ``total_light`` gives, as {column}_{model}."""
    lum = lambda b, m: F.col("mass") * X.luminosity(f"mag_{b}_{m}")
    agg = []
    for m in models:
        agg += [X.magnitude(F.sum(lum(b, m))).alias(f"{b}_{m}") for b in bands]
        for c, name in (("age_gyr", "age_r"), ("metal", "metal_r")):
            agg.append(F.try_divide(F.sum(lum(red, m) * F.col(c)), F.sum(lum(red, m))).alias(f"{name}_{m}"))
    return stars.groupBy("halo_id").agg(*agg)


def of_model(light: DataFrame, model: str, bands: Sequence[str]) -> DataFrame:
    """One model's table (halo_id, bands, age_r, metal_r and, where they are there, r50_r, r90_r) of the columns of all models."""
    names = [c for c in (*bands, "age_r", "metal_r", "r50_r", "r90_r") if f"{c}_{model}" in light.columns]
    return light.select("halo_id", *[F.col(f"{c}_{model}").alias(c) for c in names])


def interpolated(df: DataFrame, value: str, knots: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """``df`` with ``name``: y at ``value`` by straight lines between the knots, clamped at the ends (at most some thousand knots); null where the value is."""
    rows = knots.select(F.col(x).cast("double"), F.col(y).cast("double")).orderBy(x).collect()
    upper, weight = bracket(F.col(value).cast("double"), [r[0] for r in rows])
    ys = F.array(*[F.lit(r[1]) for r in rows])
    low, high = F.get(ys, upper - 1), F.get(ys, upper)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), low + weight * (high - low)))
