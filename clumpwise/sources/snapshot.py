"""Binary snapshot files: headers and particles of one domain a file, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTICLES = "domain int, pid long, family int, x double, y double, z double, vx double, vy double, vz double, mass double, birth double, metal double"


def records(blob: bytes) -> Iterator[bytes]:
    """The records of a sequential file: each between two copies of its length in four bytes."""
    at = 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        end = blob[at + 4 + n : at + 8 + n]
        if int.from_bytes(end, "little") != n or len(end) < 4:
            raise ValueError(f"a record at byte {at} is cut off")
        yield blob[at + 4 : at + 4 + n]
        at += 8 + n


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i4")


def _reals(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<f8")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One row of a mesh header: domains, dimensions, box, time, densities and expansion."""
    blob = spark.read.format("binaryFile").load(path).select("content").first()[0]
    r = list(records(bytes(blob)))
    omega, a = _reals(r[14]), _reals(r[15])
    row = (int(_ints(r[0])[0]), int(_ints(r[1])[0]), int(_ints(r[3])[0]), float(_reals(r[6])[0]), float(_reals(r[10])[0]), *map(float, omega[:4]), float(a[0]))
    return spark.createDataFrame([row], "ncpu int, ndim int, nlevelmax int, boxlen double, t double, omega_m double, omega_l double, omega_k double, omega_b double, aexp double")


@dataclass(frozen=True)
class Layout:
    """The records after a file's fixed ones, by name in the file's order, of tagged files."""

    names: tuple[str, ...] = ("birth_time", "metallicity")

    @property
    def columns(self) -> dict[str, str]:
        """Record names to columns, of the records that are read; others are passed over."""
        known = {"birth_time": "birth", "metallicity": "metal", "initial_mass": "m0"}
        return {x: known.get(x, x) for x in self.names if x in known or x.startswith("chem_")}

    @property
    def schema(self) -> str:
        more = [c for c in self.columns.values() if c not in ("birth", "metal")]
        return ", ".join([PARTICLES, "level int, tag int", *[f"{c} double" for c in more]])


def read_layout(path: str) -> Layout:
    """The layout that a descriptor names: lines of number, name, type; # begins a comment.

    An initial mass without a metallicity before it is an error.
    """
    with open(path) as f:
        rows = [[x.strip() for x in line.split(",")] for line in f if not line.lstrip().startswith("#")]
    names = [r[1] for r in rows if len(r) > 1]
    if "initial_mass" in names and "metallicity" not in names[: names.index("initial_mass")]:
        raise ValueError(f"{path} has an initial mass without a metallicity before it")
    first = names.index("tag") + 1 if "tag" in names else min((k for k, x in enumerate(names) if x in Layout(tuple(names)).columns), default=len(names))
    return Layout(tuple(names[first:]))


def parse_particles(blob: bytes, domain: int, tagged: bool, layout: Layout = Layout(), family: str = "all") -> pd.DataFrame:
    """One domain's particles of the wanted family. ``tagged`` files name the family (1 dark, 2 star); in others dark particles
    have id > 0 and no birth time, stars have a negative birth time, or a birth time and a negative id. Values that a file
    lacks are NaN; its tags are 0 if there are none."""
    r = records(blob)
    _, ndim, n = next(r), int(_ints(next(r))[0]), int(_ints(next(r))[0])
    next(r)
    stars = int(_ints(next(r))[0])
    next(r), next(r)
    sinks = int(_ints(next(r))[0])
    place = [_reals(next(r)) for _ in range(ndim)]
    speed = [_reals(next(r)) for _ in range(ndim)]
    mass = _reals(next(r))
    raw = next(r)
    ids = np.frombuffer(raw, "<i8" if len(raw) == 8 * n else "<i4").astype(np.int64)
    level = _ints(next(r))
    kinds, tag = None, np.zeros(n, int)
    if tagged:
        kinds, tag = (np.frombuffer(next(r), np.int8).astype(int) for _ in range(2))
    more = {c: np.full(n, np.nan) for c in ("birth", "metal", *layout.columns.values())}
    if stars > 0 or sinks > 0:
        for name, record in zip(layout.names, r, strict=False):
            if name in layout.columns and len(record) == 8 * n:
                more[layout.columns[name]] = _reals(record)
    if kinds is None:
        b = np.nan_to_num(more["birth"])
        kinds = np.select([(ids > 0) & (b == 0), ((b < 0) & (ids > 0)) | ((b != 0) & (ids < 0))], [1, 2], 0)
    out = {"domain": np.full(n, domain), "pid": np.abs(ids), "family": kinds}
    for k, a in enumerate("xyz"):
        out[a], out[f"v{a}"] = place[k], speed[k]
    out |= {"mass": mass, "level": level, "tag": tag, **more}
    wanted = np.isin(kinds, FAMILIES[family])
    return pd.DataFrame({c: v[wanted] for c, v in out.items()})[[c.split()[0] for c in layout.schema.split(", ")]]


#: The family numbers that a reader keeps.
FAMILIES = {"all": (1, 2), "dm": (1,), "star": (2,)}


def read_particles(spark: SparkSession, pattern: str, tagged: bool = True, family: str = "all", descriptor: str | None = None) -> DataFrame:
    """Particles of all domain files that match ``pattern``, a task each; ``family`` all, dm or star.

    The domain is the number at the end of the file's name. Places stay in box units. A ``descriptor`` file names the
    records after the tag: initial mass (``m0``) and abundances (``chem_...``) become columns, unknown records are passed over.
    """
    if family not in FAMILIES:
        raise ValueError(f"no such family: {family}")
    layout = read_layout(descriptor) if descriptor else Layout()
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"(\d+)$", 1).cast("int").alias("domain"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for domain, blob in zip(batch["domain"], batch["content"], strict=True):
                yield parse_particles(bytes(blob), int(domain), tagged, layout, family)

    return files.mapInPandas(parse, layout.schema)


def check_dense(particles: DataFrame) -> DataFrame:
    """One row a family: how many, how many different ids, and their range (dense: 1 to n without gaps)."""
    out = particles.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("ids"), F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    return out.withColumn("dense", (F.col("n") == F.col("ids")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n")))


def velocity_units(particles: DataFrame, scale_l: float, scale_t: float) -> DataFrame:
    """Velocities in km/s from code units."""
    return particles.withColumns({f"v{a}": F.col(f"v{a}") * (scale_l / scale_t * 1e-5) for a in "xyz"})


def domains_of(boxes: DataFrame, extents: DataFrame) -> DataFrame:
    """The domains whose extent (domain, lo_x, hi_x, ...) meets any box: what a box-bounded read opens."""
    b, e = boxes.alias("b"), extents.alias("e")
    meet = F.lit(True)
    for a in "xyz":
        meet = meet & (F.col(f"b.lo_{a}") <= F.col(f"e.hi_{a}")) & (F.col(f"e.lo_{a}") <= F.col(f"b.hi_{a}"))
    return e.join(b, meet, "left_semi")
