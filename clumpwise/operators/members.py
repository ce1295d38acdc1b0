"""Per-structure aggregates of member particles.

A membership table carries ``halo_id, pid, family (1 dark, 2 star), x, y, z, vx,
vy, vz, mass`` with positions in box units. Every operator is one shuffle on
``halo_id`` with partial aggregation; operators that need a centre or a bulk
velocity join one narrow row a structure, which Spark broadcasts while it is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clumpwise.functions import exprs as X
from clumpwise.operators import bands as B


def is_star() -> Column:
    return F.col("family") == 2


#: Families of particles that a run may be confined to.
FAMILIES = {"all": None, "dm": 1, "star": 2}


def of_family(particles: DataFrame, family: str) -> DataFrame:
    """Particles of ``all`` families, ``dm`` or ``star``."""
    number = FAMILIES[family]
    return particles if number is None else particles.where(F.col("family") == number)


def gathered(halos: DataFrame, members: DataFrame) -> DataFrame:
    """``halos`` (id) with ``n`` and ``mass`` of their members; one without members has 0 and null."""
    per = members.groupBy(F.col("halo_id").alias("id")).agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    return halos.join(per, "id", "left").fillna({"n": 0})


def masses(members: DataFrame) -> DataFrame:
    """Total, dark and stellar mass and counts, and the mass above the least dark mass."""
    least = members.where("family = 1").agg(F.min("mass")).scalar()
    star = is_star()
    return (
        members.withColumn("least", least)
        .groupBy("halo_id")
        .agg(
            F.sum("mass").alias("m"),
            F.coalesce(F.sum(F.when(~star, F.col("mass"))), F.lit(0.0)).alias("m_dark"),
            F.coalesce(F.sum(F.when(star, F.col("mass"))), F.lit(0.0)).alias("m_star"),
            F.count(F.when(~star, 1)).alias("n_dark"),
            F.count(F.when(star, 1)).alias("n_star"),
            F.count("*").alias("n_members"),
            F.coalesce(F.sum(F.when(~star & X.contaminated("mass", "least"), F.col("mass"))), F.lit(0.0)).alias("m_contam"),
        )
    )


def contaminated_by_level(members: DataFrame, halos: DataFrame) -> DataFrame:
    """Structures with contaminating dark particles, by level of the tree."""
    dirty = masses(members).where("m_contam > 0").select(F.col("halo_id").alias("id"), F.lit(True).alias("dirty"))
    return halos.join(dirty, "id", "left").groupBy("level").agg(F.count("*").alias("n_halos"), F.count("dirty").alias("n_contaminated"))


def relative(members: DataFrame, centres: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Members with minimum-image offsets dx, dy, dz and distances r2, d from their structure's centre (id, px, py, pz)."""
    c = centres.select(F.col("id").alias("halo_id"), "px", "py", "pz", *keep)
    out = members.join(c, "halo_id")
    for a in "xyz":
        out = out.withColumn(f"d{a}", X.min_image(F.col(a) - F.col(f"p{a}")))
    return out.withColumn("r2", X.norm2("dx", "dy", "dz")).withColumn("d", F.sqrt("r2"))


def densest_centre(members: DataFrame, density: Column) -> DataFrame:
    """(id, px, py, pz, pid) of the densest member; the smaller pid wins a tie."""
    best = F.max_by(F.struct("pid", "x", "y", "z"), F.struct(density.alias("density"), (-F.col("pid")).alias("order"))).alias("b")
    g = members.groupBy(F.col("halo_id").alias("id")).agg(best)
    return g.select("id", F.col("b.x").alias("px"), F.col("b.y").alias("py"), F.col("b.z").alias("pz"), F.col("b.pid").alias("pid"))


def mass_centre(members: DataFrame) -> DataFrame:
    """(id, px, py, pz): centre of mass, measured by minimum images from the member of least pid."""
    first = members.groupBy(F.col("halo_id").alias("id")).agg(F.min_by(F.struct("x", "y", "z"), "pid").alias("f"))
    rel = relative(members, first.select("id", F.col("f.x").alias("px"), F.col("f.y").alias("py"), F.col("f.z").alias("pz")))
    mean = lambda a: F.first(f"p{a}") + F.sum(F.col("mass") * F.col(f"d{a}")) / F.sum("mass")
    return rel.groupBy(F.col("halo_id").alias("id")).agg(*[mean(a).alias(f"p{a}") for a in "xyz"])


def nearest_to_mass_centre(members: DataFrame) -> DataFrame:
    """(id, px, py, pz, pid) of the member nearest to the centre of mass; the smaller pid wins a tie."""
    rel = relative(members, mass_centre(members))
    best = F.min_by(F.struct("pid", "x", "y", "z"), F.struct(F.round("r2", 12), "pid")).alias("b")
    g = rel.groupBy(F.col("halo_id").alias("id")).agg(best)
    return g.select("id", F.col("b.x").alias("px"), F.col("b.y").alias("py"), F.col("b.z").alias("pz"), F.col("b.pid").alias("pid"))


def bulk_velocity(members: DataFrame) -> DataFrame:
    mean = lambda a: (F.sum(F.col("mass") * F.col(f"v{a}")) / F.sum("mass")).alias(f"u{a}")
    return members.groupBy("halo_id").agg(*[mean(a) for a in "xyz"])


def with_bulk(members: DataFrame) -> DataFrame:
    """Members with velocities wx, wy, wz relative to their structure's bulk velocity ux, uy, uz."""
    out = members.join(bulk_velocity(members), "halo_id")
    return out.withColumns({f"w{a}": F.col(f"v{a}") - F.col(f"u{a}") for a in "xyz"})


def dispersions(members: DataFrame) -> DataFrame:
    """Bulk velocity and mass-weighted dispersions of all, dark and star members about the total bulk velocity."""
    w2 = F.col("mass") * X.norm2("wx", "wy", "wz")
    part = lambda test: F.sqrt(F.try_divide(F.sum(F.when(test, w2)), F.sum(F.when(test, F.col("mass")))))
    return (
        with_bulk(members)
        .groupBy("halo_id")
        .agg(
            *[F.first(f"u{a}").alias(f"v{a}") for a in "xyz"],
            F.sqrt(F.sum(w2) / F.sum("mass")).alias("sigma"),
            F.coalesce(part(F.col("family") == 1), F.lit(0.0)).alias("sigma_dark"),
            F.coalesce(part(is_star()), F.lit(0.0)).alias("sigma_star"),
        )
    )


def _cross(a: str, b: str) -> dict[str, Column]:
    c = lambda i, j: F.col(f"{a}{i}") * F.col(f"{b}{j}") - F.col(f"{a}{j}") * F.col(f"{b}{i}")
    return {"x": c("y", "z"), "y": c("z", "x"), "z": c("x", "y")}


def angular_momentum(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Sum of m (r - centre) x (v - bulk)."""
    rel = relative(with_bulk(members), centres)
    return rel.groupBy("halo_id").agg(*[F.sum(F.col("mass") * l).alias(f"L{a}") for a, l in _cross("d", "w").items()])


def extents(members: DataFrame, centres: DataFrame, star_centres: DataFrame) -> DataFrame:
    """Largest distance of members from the centre and of stars from the star centre (null without stars)."""
    all_ = relative(members, centres).groupBy("halo_id").agg(F.max("d").alias("r"))
    stars = relative(members.where(is_star()), star_centres).groupBy("halo_id").agg(F.max("d").alias("r_star"))
    return all_.join(stars, "halo_id", "left")


def inertia(members: DataFrame, centres: DataFrame) -> DataFrame:
    """The six moments sum m di dj, and the mass."""
    rel = relative(members, centres)
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return rel.groupBy("halo_id").agg(*[F.sum(F.col("mass") * F.col(f"d{a}") * F.col(f"d{b}")).alias(f"i{a}{b}") for a, b in pairs], F.sum("mass").alias("m"))


def axes(moments: DataFrame) -> DataFrame:
    """Principal axes sqrt(eigenvalue / m), ascending, with the axes' directions (columns of ``v``, row by row)."""
    import numpy as np
    import pandas as pd

    def solve(batches):
        for p in batches:
            t = p[["ixx", "ixy", "ixz", "ixy", "iyy", "iyz", "ixz", "iyz", "izz"]].to_numpy(float).reshape(-1, 3, 3)
            w, v = np.linalg.eigh(t)
            a = np.sqrt(np.maximum(w, 0) / p["m"].to_numpy()[:, None])
            yield pd.DataFrame({"halo_id": p["halo_id"], "sha": a[:, 0], "shb": a[:, 1], "shc": a[:, 2], "v": list(v.reshape(-1, 9))})

    return moments.mapInPandas(solve, "halo_id long, sha double, shb double, shc double, v array<double>")


def kinetic_energy(members: DataFrame, centres: DataFrame, hubble: float) -> DataFrame:
    """Half the sum of m |v - bulk + H d|^2."""
    rel = relative(with_bulk(members), centres)
    t = [F.col(f"w{a}") + hubble * F.col(f"d{a}") for a in "xyz"]
    return rel.groupBy("halo_id").agg((0.5 * F.sum(F.col("mass") * X.norm2(*t))).alias("ek"))


def pair_potential(members: DataFrame, most: int = 1000) -> DataFrame:
    """-G sum of m m / distance over all pairs of structures with fewer than ``most`` members; coincident pairs count nothing.

    The bound is what makes the pairs of a structure fit one task; larger ones have no row here, but in ``large_potential``.
    """
    import numpy as np
    import pyarrow as pa

    periodic, block = X.is_periodic(), 128

    def one(table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy() for c in "xyz"]
        m = table.column("mass").to_numpy()
        total = 0.0
        for k in range(0, len(m), block):
            end, r2 = min(k + block, len(m)), 0.0
            for x in at:
                d = x[None, k:] - x[k:end, None]
                if periodic:
                    d -= np.rint(d)
                r2 = r2 + d * d
            near = r2 > 0
            near[:, : end - k] &= np.tri(end - k, k=-1, dtype=bool).T  # each pair of the block once
            inverse = np.zeros_like(r2)
            np.divide(1.0, np.sqrt(r2), out=inverse, where=near)
            total += m[k:end] @ (inverse @ m[k:])
        return pa.table({"halo_id": table.column("halo_id").slice(0, 1), "ep": [-X.G * total]})

    small = members.groupBy("halo_id").agg(F.count("*").alias("n")).where(F.col("n") < most).select("halo_id")
    m = members.join(small, "halo_id").select("halo_id", "x", "y", "z", "mass")
    return m.groupBy("halo_id").applyInArrow(one, "halo_id long, ep double")


def large_potential(members: DataFrame, centres: DataFrame, most: int = 1000) -> DataFrame:
    """The outer value of the shells' potential, of structures of at least ``most`` members.

    Where that is null or vanishes (flat or coincident members have no ellipsoidal shells), the value of a homogeneous
    ellipsoid of the principal axes; 0 if all members coincide. No structure is taken whole into a task.
    """
    from clumpwise.operators import profiles as R

    large = members.groupBy("halo_id").agg(F.count("*").alias("n"), F.sum("mass").alias("m")).where(F.col("n") >= most)
    rows = members.join(large.select("halo_id"), "halo_id")
    ax = axes(inertia(rows, centres))
    rel = relative(rows, centres).join(ax, "halo_id").where("sha > 0").withColumn("v2", F.lit(0.0))
    turned = {f"d{a}": sum((F.col(f"d{c}") * F.col("v")[3 * i + j] for i, c in enumerate("xyz")), F.lit(0.0)) for j, a in enumerate("abc")}
    shells = R.shell_potential(R.shell_table(R.in_shells(rel.withColumns(turned))))
    outer = shells.groupBy("halo_id").agg(F.min("w_in").alias("outer"))

    whole = ellipsoid_unit(ax)
    out = large.join(whole, "halo_id", "left").join(outer, "halo_id", "left")
    return out.select("halo_id", F.when(F.col("outer") < 0, F.col("outer")).otherwise(F.col("unit") * F.col("m") * F.col("m")).alias("ep"))


def ellipsoid_unit(axes: DataFrame) -> DataFrame:
    """(halo_id, unit): the potential energy of homogeneous ellipsoids of mass 1 with the axes sha, shb, shc.

    0 where two axes vanish, for which the integral diverges.
    """
    import pandas as pd

    from clumpwise.functions.cosmology import ellipsoid_potential

    def solve(batches):
        for p in batches:
            unit = [ellipsoid_potential(1.0, a, b, c, X.G) if b else 0.0 for a, b, c in zip(p["sha"], p["shb"], p["shc"], strict=True)]
            yield pd.DataFrame({"halo_id": p["halo_id"], "unit": pd.Series(unit, dtype=float)})

    return axes.select("halo_id", "sha", "shb", "shc").mapInPandas(solve, "halo_id long, unit double")


def potential(members: DataFrame, centres: DataFrame, most: int = 1000) -> DataFrame:
    """The potential energy of every structure: all pairs below ``most`` members, the shells beyond."""
    return pair_potential(members, most).unionByName(large_potential(members, centres, most))


def spin(props: DataFrame) -> DataFrame:
    """|L| sqrt|et| / (m^2.5 G) of rows with Lx, Ly, Lz, et, m."""
    l = F.sqrt(X.norm2("Lx", "Ly", "Lz"))
    return props.withColumn("spin", F.try_divide(l * F.sqrt(F.abs("et")), F.pow("m", F.lit(2.5)) * X.G))


def isothermal(props: DataFrame) -> DataFrame:
    """rho_0 = mvir / (4 pi rvir^3) and r_c = rvir, null where either is not positive."""
    import math

    ok = (F.col("mvir") > 0) & (F.col("rvir") > 0)
    return props.withColumns({"rho_0": F.when(ok, F.col("mvir") / (4 * math.pi * F.pow("rvir", F.lit(3.0)))), "r_c": F.when(ok, F.col("rvir"))})


def fraction_radii(rel: DataFrame, weight: Column, fractions: dict[str, float], most: int = B.MOST) -> DataFrame:
    """For each name the least distance that holds its fraction of the total weight (not negative).

    Of structures of more than ``most`` rows only the bands of distance are sorted in which a fraction is reached.
    """
    sums = {"w": F.col("_w")}

    def near(bands: DataFrame) -> DataFrame:
        # a little more than the band itself, as sums depend on their order in the last digits
        hits = [(F.col("before_w") <= f * F.col("all_w") * (1 + 1e-9)) & (F.col("before_w") + F.col("in_w") >= f * F.col("all_w") * (1 - 1e-9)) for f in fractions.values()]
        return bands.where(reduce(lambda a, b: a | b, hits))

    rows = B.banded(rel.select("halo_id", "r2", "d", "pid", weight.alias("_w")), ["halo_id"], "d", sums, near, most=most)
    rows = B.running(rows, ["halo_id"], ["r2", "pid"], sums)
    return rows.groupBy("halo_id").agg(*[F.min(F.when(F.col("in_w") >= f * F.col("all_w"), F.col("d"))).alias(n) for n, f in fractions.items()])


def half_mass_radii(members: DataFrame, centres: DataFrame) -> DataFrame:
    """r50 and r90 of the stars."""
    return fraction_radii(relative(members.where(is_star()), centres), F.col("mass"), {"r50": 0.5, "r90": 0.9})


def weighted_means(stars: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Mass-weighted means over finite values; null where there are none."""
    def mean(c: str) -> Column:
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.try_divide(F.sum(F.when(ok, F.col("mass") * F.col(c))), F.sum(F.when(ok, F.col("mass")))).alias(c)

    return stars.groupBy("halo_id").agg(*[mean(c) for c in columns])


def star_formation(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Mass formed in the last 0.1 Gyr (times 1e3) and 0.01 Gyr (times 1e4): all, strictly within r50, strictly within r90."""
    rel = relative(members.where(is_star()), centres).join(half_mass_radii(members, centres), "halo_id")
    out = []
    for name, age, unit in (("sfr", 0.1, 1e3), ("sfr10", 0.01, 1e4)):
        for tail, inside in (("", F.lit(True)), ("_r50", F.col("d") < F.col("r50")), ("_r90", F.col("d") < F.col("r90"))):
            young = (F.col("age_gyr") < age) & inside
            out.append((F.coalesce(F.sum(F.when(young, F.col("mass"))), F.lit(0.0)) * unit).alias(name + tail))
    return rel.groupBy("halo_id").agg(*out)


def cylindrical(rows: DataFrame, inside: Column, frame: DataFrame | None = None) -> DataFrame:
    """Rotation and dispersions of ``inside`` rows about the axis of their angular momentum, or that (and the bulk velocity) of the rows ``frame``.

    Rows carry halo_id, dx..dz, vx..vz and mass. Two rows at least are needed:
    vrot (mean azimuthal velocity), sig3d (about the bulk velocity) and sigcyl (about the means in r, phi, z).
    """
    columns = ("halo_id", "mass", "dx", "dy", "dz", "vx", "vy", "vz")
    r = rows.where(inside).select(*columns)
    source = (r if frame is None else frame).select(*columns)
    r = r.join(bulk_velocity(source), "halo_id").withColumns({f"w{a}": F.col(f"v{a}") - F.col(f"u{a}") for a in "xyz"})
    enough = r.groupBy("halo_id").agg(F.count("*").alias("_k")).where("_k >= 2").select("halo_id")
    r = r.join(enough, "halo_id", "left_semi")
    total = with_bulk(source).groupBy("halo_id").agg(*[F.sum(F.col("mass") * l).alias(f"l{a}") for a, l in _cross("d", "w").items()], F.count("*").alias("_n"))
    total = total.withColumn("_l", F.sqrt(X.norm2("lx", "ly", "lz"))).where("_n >= 2 and _l > 0")
    r = r.join(total.select("halo_id", *[(F.col(f"l{a}") / F.col("_l")).alias(f"n{a}") for a in "xyz"]), "halo_id")
    r = r.withColumn("_h", sum((F.col(f"d{a}") * F.col(f"n{a}") for a in "xyz"), F.lit(0.0)))
    r = r.withColumns({f"q{a}": F.col(f"d{a}") - F.col("_h") * F.col(f"n{a}") for a in "xyz"})
    r = r.withColumn("_q", F.sqrt(X.norm2("qx", "qy", "qz")))
    r = r.withColumns({f"e{a}": F.try_divide(F.col(f"q{a}"), F.col("_q")) for a in "xyz"}).where("_q > 0")
    t = _cross("n", "e")
    r = r.withColumns({f"t{a}": c for a, c in t.items()})
    dot = lambda u, v: sum((F.col(f"{u}{a}") * F.col(f"{v}{a}") for a in "xyz"), F.lit(0.0))
    r = r.withColumns({"v_r": dot("w", "e"), "v_t": dot("w", "t"), "v_z": dot("w", "n")})
    mean = lambda c: F.sum(F.col("mass") * c) / F.sum("mass")
    var = lambda c: F.greatest(mean(F.col(c) * F.col(c)) - mean(F.col(c)) * mean(F.col(c)), F.lit(0.0))
    return r.groupBy("halo_id").agg(
        mean(F.col("v_t")).alias("vrot"),
        F.sqrt(mean(X.norm2("wx", "wy", "wz"))).alias("sig3d"),
        F.sqrt(var("v_r") + var("v_t") + var("v_z")).alias("sigcyl"),
    )


def peak_circular_velocity(members: DataFrame, centres: DataFrame, most: int = B.MOST) -> DataFrame:
    """Largest sqrt(G m(<r) / r) over members off the centre, and the least radius where it is reached.

    Of structures of more than ``most`` members only the bands of distance are sorted that can hold the peak: the mass up to a
    band's end over its least distance bounds it from above, over its largest distance it is reached.
    """
    sums = {"m": F.col("mass")}

    def high(bands: DataFrame) -> DataFrame:
        inside = F.col("before_m") + F.col("in_m")
        reached = F.max(inside / F.col("hi")).over(Window.partitionBy("halo_id", "_part"))
        return bands.withColumn("_reached", reached).where(inside / F.col("lo") >= F.col("_reached") * (1 - 1e-9)).drop("_reached")

    rel = relative(members, centres).where("d > 0").select("halo_id", "r2", "d", "pid", "mass")
    rows = B.running(B.banded(rel, ["halo_id"], "d", sums, high, most=most), ["halo_id"], ["r2", "pid"], sums)
    v = rows.withColumn("v", F.sqrt(X.G * F.col("in_m") / F.col("d")))
    return v.groupBy("halo_id").agg(F.max("v").alias("vmaxcir"), F.max_by("d", F.struct("v", -F.col("d"))).alias("rmaxcir"))
