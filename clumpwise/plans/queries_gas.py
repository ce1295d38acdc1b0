"""Queries of gas, range joins and overdensities over the fixture views."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X
from clumpwise.operators import gas as G
from clumpwise.operators import spatial as S
from clumpwise.plans.queries_members import CYLINDER, rounded
from clumpwise.plans.registry import query

CH = ("cells", "halos")

CELLS = "(select *, rho*pow(2e0,-3e0*level) as cmass, p/rho as temp, pow(2e0,-level) as side, pow(2e0,-level)*0.8660254037844386e0 as half from cells)"


def near(reach: str, slack: str = "0", spheres: str = "halos") -> str:
    """Cells around spheres by brute force."""
    return f"""near as (select * from (select c.cell_id, c.level, c.rho, c.p, c.vx, c.vy, c.vz, c.metal, c.cmass, c.temp, c.side, c.half, h.id, h.{reach} as reach,
 c.x-h.px-round_even(c.x-h.px,0) as dx, c.y-h.py-round_even(c.y-h.py,0) as dy, c.z-h.pz-round_even(c.z-h.pz,0) as dz from {CELLS} c cross join {spheres} h) a
 where sqrt(dx*dx+dy*dy+dz*dz) <= reach+{slack})"""


def _places(c: DataFrame, h: DataFrame, elements: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Places of cells that touch the spheres of the virial radius."""
    return G.places_near(G.places(c, elements, lists=lists), h.select("id", "px", "py", "pz", "rvir"), "rvir", levels=G.levels_of(c))


@query(
    "p12_gas_phase",
    ("cells",),
    """select level, count(*) as n, count(case when p/rho<1e4 then 1 end) as n_cold, count(case when p/rho<1e4 and rho>5 then 1 end) as n_dense,
 round(sum(rho*pow(2e0,-3e0*level)),9) as mass from cells group by level""",
)
def phases(c: DataFrame) -> DataFrame:
    out = c.groupBy("level").agg(
        F.count("*").alias("n"),
        F.count(F.when(X.is_cold("p", "rho"), 1)).alias("n_cold"),
        F.count(F.when(X.is_dense("p", "rho"), 1)).alias("n_dense"),
        F.sum(X.cell_mass("rho", "level")).alias("mass"),
    )
    return rounded(out, 9, "mass")


@query("p13_cell_mass", ("cells",), "select cell_id, rho*pow(2e0,-3e0*level) as mass, p/rho as temp from cells")
def cell_mass(c: DataFrame) -> DataFrame:
    return c.select("cell_id", X.cell_mass("rho", "level").alias("mass"), X.temperature("p", "rho").alias("temp"))


@query("p14_cells_in_sphere", CH, f"with {near('r', 'half')} select id, cell_id, round(sqrt(dx*dx+dy*dy+dz*dz),9) as d from near")
def cells_in_sphere(c: DataFrame, h: DataFrame) -> DataFrame:
    rows = G.places_near(G.places(c, lists=("cell_id",)), h.select("id", "px", "py", "pz", "r"), "r", levels=G.levels_of(c))
    return rows.select("id", F.round("d", 9).alias("d"), F.explode("cells").alias("c")).select("id", "c.cell_id", "d")


def _axis(a: str) -> str:
    c = f"(p{a}-floor(p{a}))"
    return f"""select id, 0 as i, case when r>=0.5 then 0e0 when {c}-r<0 then 0e0 else {c}-r end as lo, case when r>=0.5 then 1e0 when {c}-r<0 then {c}+r when {c}+r>1 then 1e0 else {c}+r end as hi from halos
 union all select id, 1, case when {c}-r<0 then {c}-r+1 else 0e0 end, case when {c}-r<0 then 1e0 else {c}+r-1 end from halos where r<0.5 and ({c}-r<0 or {c}+r>1)"""


@query(
    "p15_periodic_boxes",
    ("halos",),
    f"""with ax as ({_axis("x")}), ay as ({_axis("y")}), az as ({_axis("z")}) select ax.id, cast(ax.i+2*ay.i+4*az.i as int) as box, ax.lo as lo_x, ax.hi as hi_x, ay.lo as lo_y, ay.hi as hi_y, az.lo as lo_z, az.hi as hi_z
 from ax join ay on ax.id=ay.id join az on ax.id=az.id""",
)
def boxes(h: DataFrame) -> DataFrame:
    return S.periodic_boxes(h, "r")


@query(
    "j7_particles_in_sphere",
    ("particles", "halos"),
    """with a as (select id, pid, mass, x-px-round_even(x-px,0) as dx, y-py-round_even(y-py,0) as dy, z-pz-round_even(z-pz,0) as dz, rvir from particles cross join (select id, px, py, pz, rvir from halos) h)
 select id, count(*) as n, sum(mass) as mass from a where sqrt(dx*dx+dy*dy+dz*dz)<=rvir group by id""",
)
def particles_in_sphere(p: DataFrame, h: DataFrame) -> DataFrame:
    inside = S.points_in_spheres(p.select("pid", "x", "y", "z", "mass"), h.select("id", "px", "py", "pz", "rvir"), "rvir")
    return inside.groupBy("id").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))


@query(
    "d36_so_gas",
    CH,
    f"""with {near('r')} select id, round(sum(cmass),9) as m_gas, round(sum(case when temp<1e4 then cmass else 0 end),9) as m_cold,
 round(sum(case when temp<1e4 and rho>5 then cmass else 0 end),9) as m_dense, count(*) as n_cells from near group by id""",
)
def centre_in_gas(c: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(G.place_masses(G.places_near(G.places(c), h.select("id", "px", "py", "pz", "r"), "r", touching=False), F.lit(1.0)), 9, "m_gas", "m_cold", "m_dense")


#: Squared offsets of the 64 parts of a cell, four on an axis, counted one by one.
_AXES = ", ".join(f"pow(d{a}+side*({i + 0.5}e0/4-0.5e0),2) as {a}{i}" for a in "xyz" for i in range(4))
_HITS = "+".join(f"(case when x{i}+y{j}+z{k}<=reach*reach then 1 else 0 end)" for i in range(4) for j in range(4) for k in range(4))
FIXED = f"""f as (select id, cell_id, cmass, temp, rho, metal, ({_HITS})/64e0 as f from (select *, {_AXES} from near) a)"""


@query("g5_overlap_fixed_depth", CH, f"with {near('rvir', 'half')}, {FIXED} select id, cell_id, f, round(f*cmass,12) as mass from f")
def fixed_overlap(c: DataFrame, h: DataFrame) -> DataFrame:
    rows = _places(c, h, lists=("cell_id", "cmass")).select("id", "dx", "dy", "dz", "side", "rvir", "cells")
    rows = G.with_fixed_overlap(rows, "rvir", 2).select("id", "f", F.explode("cells").alias("c"))
    return rows.select("id", "c.cell_id", "f", F.round(F.col("f") * F.col("c.cmass"), 12).alias("mass"))


@query("g5_adaptive", CH)
def adaptive(c: DataFrame, h: DataFrame) -> DataFrame:
    out = G.gas_summary(G.with_overlap(_places(c, h, ("metal",)), "rvir"), "rvir")
    return rounded(out, 9, "m_gas", "m_cold", "m_dense", "metal", "spread")


@query(
    "d31_gas_overlap_mass",
    CH,
    f"""with {near('rvir', 'half')}, {FIXED} select id, round(sum(f*cmass),9) as m_gas, round(sum(case when temp<1e4 then f*cmass else 0 end),9) as m_cold,
 round(sum(case when temp<1e4 and rho>5 then f*cmass else 0 end),9) as m_dense, count(*) as n_cells from f group by id""",
)
def overlap_mass(c: DataFrame, h: DataFrame) -> DataFrame:
    rows = _places(c, h).select("id", "dx", "dy", "dz", "side", "rvir", "cmass", "cold", "dense", "held")
    out = G.place_masses(G.with_fixed_overlap(rows, "rvir", 2), F.col("f"))
    return rounded(out, 9, "m_gas", "m_cold", "m_dense")


@query("d32_gas_metal", CH, f"with {near('r')} select id, round(sum(cmass*metal)/sum(cmass),9) as metal from near group by id")
def gas_metal(c: DataFrame, h: DataFrame) -> DataFrame:
    rows = G.places_near(G.places(c, ("metal",)), h.select("id", "px", "py", "pz", "r"), "r", touching=False)
    out = rows.groupBy("id").agg((F.sum("of_metal") / F.sum("cmass")).alias("metal"))
    return rounded(out, 9, "metal")


@query(
    "d33_gas_kinematics",
    CH,
    f"with {near('r')}, rows_in as (select id as halo_id, cmass as mass, dx, dy, dz, vx, vy, vz from near), {CYLINDER}",
)
def gas_kinematics(c: DataFrame, h: DataFrame) -> DataFrame:
    rows = G.places(c, motion=True)
    out = G.place_kinematics(lambda s: G.places_near(rows, s, "r", touching=False), h.select("id", "px", "py", "pz", "r"), F.lit(1.0))
    return rounded(out.where("vrot is not null").select("halo_id", "vrot", "sig3d", "sigcyl"), 5, "vrot", "sig3d", "sigcyl")


@query(
    "d34_overlap_diagnostics",
    CH,
    f"with {near('rvir', 'half')} select id, count(*) as n_cells, count(case when sqrt(dx*dx+dy*dy+dz*dz)<=reach then 1 end) as n_centre_in, round(any_value(reach)/min(side),9) as r_over_cell from near group by id",
)
def diagnostics(c: DataFrame, h: DataFrame) -> DataFrame:
    held = F.coalesce(F.sum(F.when(F.col("d") <= F.col("rvir"), F.col("held"))), F.lit(0).cast("long"))
    return _places(c, h).groupBy("id").agg(
        F.sum("held").alias("n_cells"), held.alias("n_centre_in"), F.round(F.first("rvir") / F.min("side"), 9).alias("r_over_cell")
    )


@query(
    "d35_component_mass",
    ("particles", "halos"),
    """with a as (select id, family, mass, x-px-round_even(x-px,0) as dx, y-py-round_even(y-py,0) as dy, z-pz-round_even(z-pz,0) as dz, rvir from particles cross join (select id, px, py, pz, rvir from halos) h)
 select id, coalesce(sum(case when family=1 then mass end),0e0) as m_dark, coalesce(sum(case when family=2 then mass end),0e0) as m_star from a where sqrt(dx*dx+dy*dy+dz*dz)<rvir group by id""",
)
def enclosed(p: DataFrame, h: DataFrame) -> DataFrame:
    return G.enclosed_mass(p.select("family", "x", "y", "z", "mass"), h.select("id", "px", "py", "pz", "rvir"), "rvir")


@query(
    "d37_root_envelope",
    ("halo_tree",),
    """select h.id as hosthalo, round(greatest(h.r*1.1e0, max(sqrt(pow(t.px-h.px-round_even(t.px-h.px,0),2)+pow(t.py-h.py-round_even(t.py-h.py,0),2)+pow(t.pz-h.pz-round_even(t.pz-h.pz,0),2))+t.r)),9) as envelope, count(*) as n_descendants
 from halo_tree t join halo_tree h on t.hosthalo=h.id group by h.id, h.r""",
)
def envelope(t: DataFrame) -> DataFrame:
    return rounded(G.root_envelope(t), 9, "envelope")


@query(
    "s1_population_union",
    ("particles", "cells"),
    "select family, count(*) as n, round(sum(mass),6) as mass from (select family, mass from particles union all select 0, rho*pow(2e0,-3e0*level) from cells) a group by family",
)
def population(p: DataFrame, c: DataFrame) -> DataFrame:
    return rounded(G.populations(p, c).groupBy("family").agg(F.count("*").alias("n"), F.sum("mass").alias("mass")), 6, "mass")


@query(
    "w3_so_radius",
    ("particles", "cells", "halos"),
    """with e as (select pid as key, family, x, y, z, mass from particles union all select cell_id, 0, x, y, z, rho*pow(2e0,-3e0*level) from cells),
 a as (select id, key, family, mass, x-px-round_even(x-px,0) as dx, y-py-round_even(y-py,0) as dy, z-pz-round_even(z-pz,0) as dz, 0.1e0 as r from e cross join (select id, px, py, pz from halos) h),
 b as (select *, dx*dx+dy*dy+dz*dz as r2, sqrt(dx*dx+dy*dy+dz*dz) as d from a where sqrt(dx*dx+dy*dy+dz*dz)<=r and sqrt(dx*dx+dy*dy+dz*dz)>0 and mass>0),
 c as (select *, sum(mass) over w as m, row_number() over w as k from b window w as (partition by id order by r2, family, key rows unbounded preceding)),
 f as (select *, m/(4e0/3e0*pi()*pow(d,3)) as rho from c),
 g as (select *, lead(d) over w as d2, lead(m) over w as m2, lead(rho) over w as rho2 from f window w as (partition by id order by k)),
 l as (select *, row_number() over (partition by id order by k desc) as j from g where rho>=4e7)
 select id, round(d+(rho-4e7)/(rho-rho2)*(d2-d),9) as r_so, round(m+(rho-4e7)/(rho-rho2)*(m2-m),5) as m_so from l where j=1 and d2 is not null""",
)
def overdensity(p: DataFrame, c: DataFrame, h: DataFrame) -> DataFrame:
    out = G.overdensity_radius(G.populations(p, c), h.select("id", "px", "py", "pz", F.lit(0.1).alias("r")), "r", 4e7)
    return rounded(rounded(out, 9, "r_so"), 5, "m_so")




def _parts(name: str, square: str, less: str) -> str:
    """The share of the 64 parts of a cell whose squared offsets on the axes add up to less than the radius allows."""
    hits = "+".join(f"(case when {square.format('x', i)}+{square.format('y', j)}+{square.format('z', k)}{less}reach*reach then 1 else 0 end)" for i in range(4) for j in range(4) for k in range(4))
    return f"({hits})/64e0 as {name}"


_OFFSETS = ", ".join(f"d{a}+side*({i + 0.5}e0/4-0.5e0) as o{a}{i}" for a in "xyz" for i in range(4))
_ENDS = ", ".join(f"abs(o{a}{i})+side/8e0 as u{a}{i}, greatest(abs(o{a}{i})-side/8e0,0e0) as v{a}{i}" for a in "xyz" for i in range(4))
BOUNDS = f"""f as (select id, cell_id, level, rho, temp, metal, cmass, reach, side, vx, vy, vz, dx, dy, dz, sqrt(dx*dx+dy*dy+dz*dz) as d, {_parts("f", "o{0}{1}*o{0}{1}", "<=")}, {_parts("f_lo", "u{0}{1}*u{0}{1}", "<=")}, {_parts("f_hi", "v{0}{1}*v{0}{1}", "<")}
 from (select *, {_ENDS} from (select *, {_OFFSETS} from near) a) b)"""

GAS_SUMS = """select id, round(sum(f*cmass),9) as m_gas, round(sum(case when temp<1e4 then f*cmass else 0 end),9) as m_cold, round(sum(case when temp<1e4 and rho>5 then f*cmass else 0 end),9) as m_dense,
 round(case when sum(f*cmass)<>0 then sum(f*cmass*metal)/sum(f*cmass) end,9) as metal, count(*) as n_cells, count(case when d<=reach then 1 end) as n_centre_in, count(case when f>0 then 1 end) as n_overlap, round(any_value(reach)/min(side),9) as r_over_cell,
 round(case when sum(f*cmass)<>0 then sum(cmass*(f_hi-f_lo))/sum(f*cmass) end,9) as spread, case when sum(f*cmass)<>0 then sum(cmass*(f_hi-f_lo))/sum(f*cmass)<=0.05e0 end as resolved from f group by id"""

SUMS = ("m_gas", "m_cold", "m_dense", "metal", "r_over_cell", "spread")


def _weighed(c: DataFrame, h: DataFrame) -> DataFrame:
    return G.with_fixed_overlap(_places(c, h, ("metal",)), "rvir", 2)


@query("d32_overlap_summary", CH, f"with {near('rvir', 'half')}, {BOUNDS} {GAS_SUMS}")
def overlap_summary(c: DataFrame, h: DataFrame) -> DataFrame:
    """Masses, metallicity and diagnostics weighted by overlap (D31, D32, D34), by the library's own summary."""
    return rounded(G.gas_summary(_weighed(c, h), "rvir"), 9, *SUMS)


@query(
    "d33_overlap_kinematics",
    CH,
    f"with {near('rvir', 'half')}, {BOUNDS}, rows_in as (select id as halo_id, f*cmass as mass, dx, dy, dz, vx, vy, vz from f where f*cmass>0), {CYLINDER}",
)
def overlap_kinematics(c: DataFrame, h: DataFrame) -> DataFrame:
    rows, levels = G.places(c, motion=True).drop("held", "cold", "dense", "cmass"), G.levels_of(c)
    near = lambda s: G.with_fixed_overlap(G.places_near(rows, s, "rvir", levels=levels), "rvir", 2)
    out = G.place_kinematics(near, h.select("id", "px", "py", "pz", "rvir"), F.col("f"))
    return rounded(out.where("vrot is not null").select("halo_id", "vrot", "sig3d", "sigcyl"), 5, "vrot", "sig3d", "sigcyl")


@query(
    "gas_catalog",
    ("cells", "particles", "halo_tree"),
    f"""with {near('rvir', 'half')}, {BOUNDS}, g as ({GAS_SUMS}),
 a as (select id, family, mass, x-px-round_even(x-px,0) as dx, y-py-round_even(y-py,0) as dy, z-pz-round_even(z-pz,0) as dz, rvir from particles cross join (select id, px, py, pz, rvir from halos) h),
 e as (select id, coalesce(sum(case when family=1 then mass end),0e0) as m_dark, coalesce(sum(case when family=2 then mass end),0e0) as m_star from a where sqrt(dx*dx+dy*dy+dz*dz)<rvir group by id)
 select t.id, t.hosthalo as root_id, g.* exclude (id, n_cells, n_centre_in, n_overlap), coalesce(n_cells,0) as n_cells, coalesce(n_centre_in,0) as n_centre_in, coalesce(n_overlap,0) as n_overlap, m_dark, m_star from halo_tree t left join g on g.id=t.id left join e on e.id=t.id""",
)
def gas_catalog(c: DataFrame, p: DataFrame, t: DataFrame) -> DataFrame:
    """The gas run of all roots in one plan: envelopes, boxes, reads, and every structure's spheres."""
    from clumpwise.plans.programs import summarise_roots
    from clumpwise.sources.reader import TableReader
    from clumpwise.sources.text import GasConfig

    roots = t.where("level = 1").select(F.col("id").alias("root_id"))
    out, _ = summarise_roots(TableReader(c, p), t, roots, GasConfig(radius_field="rvir"), parts_depth=2)
    return rounded(out, 9, *SUMS)
