"""Catalog conventions: units, projections, and the join with gas summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X

#: Columns of the light profile that a table may have, in order.
LIGHT = ("id", "level", "hosthalo", "hostsub", "nbsub", "nextsub", "m", "r", "px", "py", "pz", "vx", "vy", "vz", "Lx", "Ly", "Lz", "sha", "shb", "shc", "ek", "ep", "et", "spin", "sigma", "rvir", "mvir", "tvir", "cvel", "rho_0", "r_c")

#: How internal columns become output columns: by mass unit, by box size, or else.
MASSES = ("m", "m_dark", "m_star", "m_contam", "mvir", "Lx", "Ly", "Lz", "ek", "ep", "et")
PLACES = ("px", "py", "pz", "px_star", "py_star", "pz_star")
LENGTHS = ("r", "rvir", "r_c", "sha", "shb", "shc", "r_star", "r50", "r90", "rmaxcir")


def output_units(catalog: DataFrame, box: float) -> DataFrame:
    """Masses times 1e11, places over the box folded into [0, 1), lengths over the box, rho_0 times 100."""
    have = set(catalog.columns)
    out = {c: F.col(c) * X.MASS_UNIT for c in MASSES if c in have}
    out |= {c: X.wrap(F.col(c) / box) for c in PLACES if c in have}
    out |= {c: F.col(c) / box for c in LENGTHS if c in have}
    if "rho_0" in have:
        out["rho_0"] = F.col("rho_0") * 100
    return catalog.withColumns(out)


def code_units(catalog: DataFrame, box: float, legacy: bool) -> DataFrame:
    """Places and lengths in box units; older tables hold physical ones about the middle of the box. Nulls stay null."""
    if not legacy:
        return catalog
    have = set(catalog.columns)
    out = {c: X.wrap(F.col(c) / box + 0.5) for c in PLACES if c in have}
    return catalog.withColumns(out | {c: F.col(c) / box for c in LENGTHS if c in have})


def light(catalog: DataFrame) -> DataFrame:
    return catalog.select(*[c for c in LIGHT if c in catalog.columns])


def with_gas(catalog: DataFrame, gas: DataFrame, missing: dict[str, object]) -> DataFrame:
    """The catalog with its gas columns by id; ``missing`` fills rows without gas."""
    return catalog.join(gas, "id", "left").fillna(missing)


def with_photometry(catalog: DataFrame, photometry: DataFrame, *bands: str) -> DataFrame:
    """Structures with the bands of their photometry; those without a row are left out."""
    return catalog.join(photometry.select("id", *bands), "id")


def member_dump(members: DataFrame, particles: DataFrame, mass_unit: float = X.MASS_UNIT) -> DataFrame:
    """(halo_id, pid, x, y, z, vx, vy, vz, mass) of all members (halo_id, pid): code-unit places, masses in solar masses."""
    columns = [c for c in ("x", "y", "z", "vx", "vy", "vz", "mass") if c in particles.columns]
    return members.join(particles.select("pid", *columns), "pid").select("halo_id", "pid", *[c for c in columns if c != "mass"], (F.col("mass") * mass_unit).alias("mass"))


def write_catalog(path: str, snapshot: int, header: dict[str, object], halos: DataFrame, members: DataFrame | None = None, photometry: DataFrame | None = None) -> None:
    """One snapshot's tables under ``path``: header, halos and, if given, members and photometry, each replaced whole."""
    spark = halos.sparkSession
    row = spark.createDataFrame([(snapshot, {k: str(v) for k, v in header.items()})], "snapshot int, attributes map<string,string>")
    for name, df in (("header", row.coalesce(1)), ("halos", halos), ("members", members), ("photometry", photometry)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/snapshot={snapshot}")


def read_catalog(spark, path: str, snapshot: int, name: str = "halos") -> DataFrame:
    """One of the tables of a snapshot."""
    return spark.read.parquet(f"{path.rstrip('/')}/{name}/snapshot={snapshot}")


def members_of(members: DataFrame, halo: int) -> DataFrame:
    """The members of one structure, by pid."""
    return members.where(F.col("halo_id") == halo).orderBy("pid")


def with_mother(tree: DataFrame) -> DataFrame:
    """Rows of (id, hostsub, level) with their mother's level and number of direct daughters; a daughter is one level below."""
    mother = tree.select(F.col("id").alias("hostsub"), F.col("level").alias("mother_level"))
    kids = tree.groupBy("hostsub").agg(F.count("*").alias("nbsub")).select(F.col("hostsub").alias("id"), "nbsub")
    out = tree.join(mother, "hostsub", "left").join(kids, "id", "left")
    return out.withColumns({"nbsub": F.coalesce("nbsub", F.lit(0)), "in_order": F.coalesce(F.col("level") == F.col("mother_level") + 1, F.col("level") == 1)})
