"""Queries of the per-structure aggregates over the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X
from clumpwise.operators import members as M
from clumpwise.plans.registry import query

PH = ("particles", "halos")

#: Members with their offsets, in SQL.
REL = """with rel as (select p.*, h.px, h.py, h.pz, h.r as h_r, h.rvir, dx, dy, dz, dx*dx+dy*dy+dz*dz as r2, sqrt(dx*dx+dy*dy+dz*dz) as d
 from (select p.*, p.x-h.px-round_even(p.x-h.px,0) as dx, p.y-h.py-round_even(p.y-h.py,0) as dy, p.z-h.pz-round_even(p.z-h.pz,0) as dz
 from particles p join halos h on p.halo_id=h.id) p join halos h on p.halo_id=h.id)"""
BULK = """bulk as (select halo_id, sum(mass*vx)/sum(mass) as ux, sum(mass*vy)/sum(mass) as uy, sum(mass*vz)/sum(mass) as uz from particles group by halo_id)"""


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("p1_family_split", ("particles",), "select family, count(*) as n, sum(mass) as mass from particles group by family")
def family_split(p: DataFrame) -> DataFrame:
    """What runs of one family each would read."""
    parts = M.of_family(p, "dm").unionByName(M.of_family(p, "star"))
    return parts.groupBy("family").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))


@query(
    "p2_dense_ids",
    ("particles",),
    """select family, min(dense) as lo, max(dense) as hi, count(distinct dense) as n from (select family,
 (case when family=2 then (select count(*) from particles where family=1) else 0 end) + row_number() over (partition by family order by pid, halo_id, x) - 1 as dense from particles) a group by family""",
)
def dense_ids(p: DataFrame) -> DataFrame:
    """Dark particles take 0..n-1, stars follow; checked by bounds and distinct count."""
    from clumpwise.operators.tables import dense_numbers

    dark = p.where("family = 1").agg(F.count("*")).scalar()
    d = dense_numbers(p.select("family", "pid", "halo_id", "x"), "family", ["pid", "halo_id", "x"], "k").withColumn("n_dark", dark)
    dense = F.col("k") + F.when(M.is_star(), F.col("n_dark")).otherwise(F.lit(0))
    return d.groupBy("family").agg(F.min(dense).alias("lo"), F.max(dense).alias("hi"), F.countDistinct(dense).alias("n"))


@query(
    "d1_mass",
    ("particles",),
    """select halo_id, sum(mass) as m, coalesce(sum(case when family=1 then mass end),0e0) as m_dark, coalesce(sum(case when family=2 then mass end),0e0) as m_star,
 count(case when family=1 then 1 end) as n_dark, count(case when family=2 then 1 end) as n_star, count(*) as n_members,
 coalesce(sum(case when family=1 and mass > 1.00001e0*(select min(mass) from particles where family=1) then mass end),0e0) as m_contam from particles group by halo_id""",
)
def mass(p: DataFrame) -> DataFrame:
    return M.masses(p)


@query(
    "d26_contamination",
    PH,
    """select level, count(*) as n_halos, count(dirty) as n_contaminated from halos left join (select distinct halo_id, 1 as dirty from particles
 where family=1 and mass > 1.00001e0*(select min(mass) from particles where family=1)) c on id=halo_id group by level""",
)
def contamination(p: DataFrame, h: DataFrame) -> DataFrame:
    return M.contaminated_by_level(p, h)


@query(
    "d2_densest_center",
    ("particles",),
    "select halo_id as id, x as px, y as py, z as pz, pid from (select *, row_number() over (partition by halo_id order by mass*(abs(vx)+1) desc, pid) as k from particles) a where k=1",
)
def densest(p: DataFrame) -> DataFrame:
    return M.densest_centre(p, F.col("mass") * (F.abs("vx") + 1))


@query(
    "d2_cdm_center",
    ("particles",),
    """with f as (select halo_id, arg_min(x,pid) as fx, arg_min(y,pid) as fy, arg_min(z,pid) as fz from particles group by halo_id),
 c as (select p.halo_id, any_value(fx)+sum(mass*(x-fx-round_even(x-fx,0)))/sum(mass) as cx, any_value(fy)+sum(mass*(y-fy-round_even(y-fy,0)))/sum(mass) as cy,
 any_value(fz)+sum(mass*(z-fz-round_even(z-fz,0)))/sum(mass) as cz from particles p join f on p.halo_id=f.halo_id group by p.halo_id),
 n as (select p.*, cx, cy, cz, row_number() over (partition by p.halo_id order by round(pow(x-cx-round_even(x-cx,0),2)+pow(y-cy-round_even(y-cy,0),2)+pow(z-cz-round_even(z-cz,0),2),12), pid) as k
 from particles p join c on p.halo_id=c.halo_id)
 select halo_id as id, x as px, y as py, z as pz, pid, round(cx,9) as cx, round(cy,9) as cy, round(cz,9) as cz from n where k=1""",
)
def cdm(p: DataFrame) -> DataFrame:
    c = M.mass_centre(p).select("id", *[F.round(f"p{a}", 9).alias(f"c{a}") for a in "xyz"])
    return M.nearest_to_mass_centre(p).join(c, "id")


@query(
    "d3_dispersion",
    ("particles",),
    f"""with {BULK}, w as (select p.*, ux,uy,uz, mass*((vx-ux)*(vx-ux)+(vy-uy)*(vy-uy)+(vz-uz)*(vz-uz)) as w2 from particles p join bulk b on p.halo_id=b.halo_id)
 select halo_id, round(any_value(ux),6) as vx, round(any_value(uy),6) as vy, round(any_value(uz),6) as vz, round(sqrt(sum(w2)/sum(mass)),6) as sigma,
 round(coalesce(sqrt(sum(case when family=1 then w2 end)/nullif(sum(case when family=1 then mass end),0)),0),6) as sigma_dark,
 round(coalesce(sqrt(sum(case when family=2 then w2 end)/nullif(sum(case when family=2 then mass end),0)),0),6) as sigma_star from w group by halo_id""",
)
def dispersion(p: DataFrame) -> DataFrame:
    return rounded(M.dispersions(p), 6, "vx", "vy", "vz", "sigma", "sigma_dark", "sigma_star")


@query(
    "d4_angular_momentum",
    PH,
    f"""{REL}, {BULK} select rel.halo_id, round(sum(mass*(dy*(vz-uz)-dz*(vy-uy))),4) as Lx, round(sum(mass*(dz*(vx-ux)-dx*(vz-uz))),4) as Ly,
 round(sum(mass*(dx*(vy-uy)-dy*(vx-ux))),4) as Lz from rel join bulk on rel.halo_id=bulk.halo_id group by rel.halo_id""",
)
def momentum(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(M.angular_momentum(p, h), 4, "Lx", "Ly", "Lz")


@query(
    "d5_extent",
    PH,
    f"""{REL}, s as (select halo_id, arg_max(x, struct_pack(m:=mass*(abs(vx)+1), k:=-pid)) as sx, arg_max(y, struct_pack(m:=mass*(abs(vx)+1), k:=-pid)) as sy,
 arg_max(z, struct_pack(m:=mass*(abs(vx)+1), k:=-pid)) as sz from particles where family=2 group by halo_id),
 rs as (select p.halo_id, max(sqrt(pow(x-sx-round_even(x-sx,0),2)+pow(y-sy-round_even(y-sy,0),2)+pow(z-sz-round_even(z-sz,0),2))) as r_star from particles p join s on p.halo_id=s.halo_id where family=2 group by p.halo_id)
 select rel.halo_id, round(max(d),9) as r, round(any_value(r_star),9) as r_star from rel left join rs on rel.halo_id=rs.halo_id group by rel.halo_id""",
)
def extent(p: DataFrame, h: DataFrame) -> DataFrame:
    stars = M.densest_centre(p.where(M.is_star()), F.col("mass") * (F.abs("vx") + 1))
    return rounded(M.extents(p, h, stars), 9, "r", "r_star")


@query(
    "d8_star_center",
    ("particles",),
    "select halo_id as id, x as px, y as py, z as pz, pid from (select *, row_number() over (partition by halo_id order by mass*(abs(vx)+1) desc, pid) as k from particles where family=2) a where k=1",
)
def star_centre(p: DataFrame) -> DataFrame:
    return M.densest_centre(p.where(M.is_star()), F.col("mass") * (F.abs("vx") + 1))


_INERTIA = ", ".join(f"round(sum(mass*d{a}*d{b}),7) as i{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query("d9_inertia_tensor", PH, f"{REL} select halo_id, {_INERTIA}, sum(mass) as m from rel group by halo_id")
def inertia(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(M.inertia(p, h), 7, "ixx", "ixy", "ixz", "iyy", "iyz", "izz")


@query("d9_axes", PH)
def axes(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(M.axes(M.inertia(p, h)).drop("v"), 7, "sha", "shb", "shc")


@query(
    "d10_kinetic",
    PH,
    f"""{REL}, {BULK} select rel.halo_id, round(0.5e0*sum(mass*(pow(vx-ux+70e0*dx,2)+pow(vy-uy+70e0*dy,2)+pow(vz-uz+70e0*dz,2))),2) as ek from rel join bulk on rel.halo_id=bulk.halo_id group by rel.halo_id""",
)
def kinetic(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(M.kinetic_energy(p, h, 70.0), 2, "ek")


@query(
    "d11_pair_potential",
    ("particles",),
    """with p as (select * from particles where halo_id<=12 and pid%4=0), n as (select halo_id, count(*) as n from p group by halo_id having count(*)<1000),
 e as (select a.halo_id, a.mass*b.mass as mm, sqrt(pow(a.x-b.x-round_even(a.x-b.x,0),2)+pow(a.y-b.y-round_even(a.y-b.y,0),2)+pow(a.z-b.z-round_even(a.z-b.z,0),2)) as d
 from p a join p b on a.halo_id=b.halo_id and a.pid<b.pid) select n.halo_id, round(coalesce(-430.1e0*sum(case when d>0 then mm/d end),0),-2) as ep from n left join e on n.halo_id=e.halo_id group by n.halo_id"""
    .replace("where halo_id<=12 and pid%4=0", ""),
)
def pair_potential(p: DataFrame) -> DataFrame:
    """Structures of 1000 or more members, which the SQL leaves out, have the shells' value."""
    centres = M.densest_centre(p, F.col("mass") * (F.abs("vx") + 1))
    return rounded(M.potential(p, centres), -2, "ep")


@query(
    "d16_spin",
    PH,
    f"""{REL}, {BULK}, s as (select rel.halo_id, sum(mass) as m, sum(mass*(dy*(vz-uz)-dz*(vy-uy))) as lx, sum(mass*(dz*(vx-ux)-dx*(vz-uz))) as ly, sum(mass*(dx*(vy-uy)-dy*(vx-ux))) as lz,
 0.5e0*sum(mass*(pow(vx-ux,2)+pow(vy-uy,2)+pow(vz-uz,2))) as et from rel join bulk on rel.halo_id=bulk.halo_id group by rel.halo_id)
 select halo_id, round(sqrt(lx*lx+ly*ly+lz*lz)*sqrt(abs(et))/(pow(m,2.5e0)*430.1e0),9) as spin from s""",
)
def spin(p: DataFrame, h: DataFrame) -> DataFrame:
    props = M.angular_momentum(p, h).join(M.kinetic_energy(p, h, 0.0).withColumnRenamed("ek", "et"), "halo_id").join(M.masses(p), "halo_id")
    return rounded(M.spin(props).select("halo_id", "spin"), 9, "spin")


@query("d15_isothermal", ("halos",), "select id, round(r*1000/(4*pi()*pow(rvir,3)),4) as rho_0, rvir as r_c from halos")
def isothermal(h: DataFrame) -> DataFrame:
    out = M.isothermal(h.withColumn("mvir", F.col("r") * 1000))
    return out.select("id", F.round("rho_0", 4).alias("rho_0"), "r_c")


R50 = """st as (select *, sum(mass) over (partition by halo_id order by r2, pid rows unbounded preceding) as cm, sum(mass) over (partition by halo_id) as tm from rel where family=2),
 hm as (select halo_id, min(case when cm>=0.5e0*tm then d end) as r50, min(case when cm>=0.9e0*tm then d end) as r90 from st group by halo_id)"""


@query("d18_half_mass_radius", PH, f"{REL}, {R50} select halo_id, round(r50,9) as r50, round(r90,9) as r90 from hm")
def half_mass(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(M.half_mass_radii(p, h), 9, "r50", "r90")


@query(
    "d19_weighted_metal",
    ("particles",),
    "select halo_id, "
    + ", ".join(f"round(sum(mass*{c})/sum(mass),9) as {c}" for c in ("age_gyr", "metal", "h_frac", "o_frac"))
    + " from particles where family=2 group by halo_id",
)
def weighted(p: DataFrame) -> DataFrame:
    c = ("age_gyr", "metal", "h_frac", "o_frac")
    return rounded(M.weighted_means(p.where(M.is_star()), c), 9, *c)


_SFR = ", ".join(
    f"coalesce(sum(case when age_gyr<{age} and {test} then mass end),0e0)*{unit} as {name}{tail}"
    for name, age, unit in (("sfr", "0.1e0", "1e3"), ("sfr10", "0.01e0", "1e4"))
    for tail, test in (("", "true"), ("_r50", "d<r50"), ("_r90", "d<r90"))
)


@query("d20_sfr", PH, f"{REL}, {R50} select st.halo_id, {_SFR} from st join hm on st.halo_id=hm.halo_id group by st.halo_id")
def sfr(p: DataFrame, h: DataFrame) -> DataFrame:
    return M.star_formation(p, h)


CYLINDER = """b as (select halo_id, sum(mass*vx)/sum(mass) as ux, sum(mass*vy)/sum(mass) as uy, sum(mass*vz)/sum(mass) as uz from rows_in group by halo_id),
 w as (select r.halo_id, mass, dx, dy, dz, vx-ux as wx, vy-uy as wy, vz-uz as wz from rows_in r join b on r.halo_id=b.halo_id),
 l as (select halo_id, sum(mass*(dy*wz-dz*wy)) as lx, sum(mass*(dz*wx-dx*wz)) as ly, sum(mass*(dx*wy-dy*wx)) as lz, count(*) as n from w group by halo_id),
 a as (select halo_id, lx/sqrt(lx*lx+ly*ly+lz*lz) as nx, ly/sqrt(lx*lx+ly*ly+lz*lz) as ny, lz/sqrt(lx*lx+ly*ly+lz*lz) as nz from l where n>=2 and lx*lx+ly*ly+lz*lz>0),
 q as (select w.*, nx, ny, nz, dx-(dx*nx+dy*ny+dz*nz)*nx as qx, dy-(dx*nx+dy*ny+dz*nz)*ny as qy, dz-(dx*nx+dy*ny+dz*nz)*nz as qz from w join a on w.halo_id=a.halo_id),
 e as (select *, qx/sqrt(qx*qx+qy*qy+qz*qz) as ex, qy/sqrt(qx*qx+qy*qy+qz*qz) as ey, qz/sqrt(qx*qx+qy*qy+qz*qz) as ez from q where qx*qx+qy*qy+qz*qz>0),
 v as (select halo_id, mass, wx*wx+wy*wy+wz*wz as w2, wx*ex+wy*ey+wz*ez as vr, wx*(ny*ez-nz*ey)+wy*(nz*ex-nx*ez)+wz*(nx*ey-ny*ex) as vt, wx*nx+wy*ny+wz*nz as vz from e),
 m as (select halo_id, sum(mass*vt)/sum(mass) as vrot, sqrt(sum(mass*w2)/sum(mass)) as sig3d, sum(mass*vr*vr)/sum(mass)-pow(sum(mass*vr)/sum(mass),2)+sum(mass*vt*vt)/sum(mass)-pow(sum(mass*vt)/sum(mass),2)
 +sum(mass*vz*vz)/sum(mass)-pow(sum(mass*vz)/sum(mass),2) as s2 from v group by halo_id)
 select halo_id, round(vrot,5) as vrot, round(sig3d,5) as sig3d, round(sqrt(greatest(s2,0)),5) as sigcyl from m"""


@query("d21_stellar_kinematics", PH, f"{REL}, {R50}, rows_in as (select st.* from st join hm on st.halo_id=hm.halo_id where d<r90), {CYLINDER}")
def kinematics(p: DataFrame, h: DataFrame) -> DataFrame:
    rel = M.relative(p.where(M.is_star()), h).join(M.half_mass_radii(p, h), "halo_id")
    return rounded(M.cylindrical(rel, F.col("d") < F.col("r90")), 5, "vrot", "sig3d", "sigcyl")


@query(
    "d23_vmax",
    PH,
    f"""{REL}, c as (select halo_id, pid, d, sqrt(430.1e0*(sum(mass) over (partition by halo_id order by r2, pid rows unbounded preceding))/d) as v from rel where d>0),
 k as (select *, row_number() over (partition by halo_id order by v desc, d) as k from c) select halo_id, round(v,6) as vmaxcir, round(d,9) as rmaxcir from k where k=1""",
)
def vmax(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(rounded(M.peak_circular_velocity(p, h), 6, "vmaxcir"), 9, "rmaxcir")


@query(
    "p21_octant",
    PH,
    f"{REL} select halo_id, cast((case when dx>=0 then 1 else 0 end)+2*(case when dy>=0 then 1 else 0 end)+4*(case when dz>=0 then 1 else 0 end) as int) as oct, count(*) as n, sum(mass) as mass from rel group by 1,2",
)
def octants(p: DataFrame, h: DataFrame) -> DataFrame:
    rel = M.relative(p, h).withColumn("oct", X.octant("dx", "dy", "dz"))
    return rel.groupBy("halo_id", "oct").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))


def _starts(p: DataFrame, h: DataFrame) -> DataFrame:
    """Members with their structure's centre and radius as the first guess, and a density."""
    rows = p.withColumn("density", F.col("mass") * (F.abs("vx") + 1))
    return rows.join(h.select(F.col("id").alias("halo_id"), "px", "py", "pz", F.col("r").alias("start")), "halo_id")


@query("d6_shrinking_sphere", PH)
def shrinking(p: DataFrame, h: DataFrame) -> DataFrame:
    from clumpwise.operators.refine import shrinking_sphere

    return shrinking_sphere(_starts(p, h), 0.001)


@query("d7_nested_cells", PH)
def nested(p: DataFrame, h: DataFrame) -> DataFrame:
    from clumpwise.operators.refine import nested_cells

    return nested_cells(_starts(p, h), 0.001)
