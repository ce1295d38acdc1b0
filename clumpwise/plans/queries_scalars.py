"""Queries of scalings, filters, lookups and bookkeeping over the fixture views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X
from clumpwise.operators import catalog as C
from clumpwise.operators import hierarchy as H
from clumpwise.operators import members as M
from clumpwise.operators import neighbours as N
from clumpwise.operators import photometry as P
from clumpwise.operators import scaling as S
from clumpwise.operators import spatial as R
from clumpwise.operators import tables as O
from clumpwise.operators.graph import shared_folder
from clumpwise.operators.profiles import shell_widths
from clumpwise.plans.queries_members import PH, REL, rounded
from clumpwise.plans.registry import query
from clumpwise.sources import text as T
from clumpwise.sources.catalog_store import CatalogStore
from clumpwise.sources.snapshot import domains_of


@query("a5_counts", ("particles",), "select family, count(*) as n, count(distinct pid) as ids, min(pid) as lo, max(pid) as hi, (count(*)=count(distinct pid) and min(pid)=1 and max(pid)=count(*)) as dense from particles group by family")
def counts(p: DataFrame) -> DataFrame:
    from clumpwise.sources.snapshot import check_dense

    return check_dense(p)


@query("a14_catalog", ("halos",), "select id, hosthalo, level, box_id, px, py, pz, r, rvir from halos where level <= 3")
def catalog_read(h: DataFrame) -> DataFrame:
    return _stored(h).where("level <= 3")


@query("a14_whole_catalog", ("halos",), "select id, hosthalo, level, box_id, px, py, pz, r, rvir from halos")
def whole_catalog(h: DataFrame) -> DataFrame:
    """All levels; ``a14_catalog`` is the read under a predicate."""
    return _stored(h)


def _stored(h: DataFrame) -> DataFrame:
    """The structures, written as a version of a catalog in the shared folder and read back."""
    store = CatalogStore(h.sparkSession, f"{shared_folder(h.sparkSession)}/catalog-{uuid.uuid4().hex}")
    store.write(1, {"halos": h.select("id", "hosthalo", "level", "box_id", "px", "py", "pz", "r", "rvir")}, {"aexp": 1.0}, box=100.0)
    return store.halos(1)


_BOX = "(select id, 0.3e0 as lo_x, 0.3e0+r*4 as hi_x, 0.1e0 as lo_y, 0.5e0 as hi_y, 0.2e0 as lo_z, 0.2e0+r*8 as hi_z from halos where level=1)"


@query("a15_cells_in_boxes", ("cells", "halos"), f"select cell_id, x, y, z, rho from cells c where exists (select 1 from {_BOX} b where x>=lo_x and x<hi_x and y>=lo_y and y<hi_y and z>=lo_z and z<hi_z)")
def box_read(c: DataFrame, h: DataFrame) -> DataFrame:
    lit = lambda v: F.lit(v)
    b = h.where("level = 1").select(lit(0.3).alias("lo_x"), (0.3 + F.col("r") * 4).alias("hi_x"), lit(0.1).alias("lo_y"), lit(0.5).alias("hi_y"), lit(0.2).alias("lo_z"), (0.2 + F.col("r") * 8).alias("hi_z"))
    return S.in_boxes(c, b, ["cell_id", "x", "y", "z", "rho"])


@query("a16_grid_axes", ("ssp_grid",), "select count(*) as n, count(distinct log_z) as n_z, count(distinct log_age) as n_age, min(log_age) as lo, max(log_age) as hi from ssp_grid")
def axes(g: DataFrame) -> DataFrame:
    return P.grid_axes(P.checked_grid(g, ("sdss_u", "sdss_r", "johnson_k")))


@query("b2s_member_dump", ("particles",), "select halo_id, pid, x, y, z, vx, vy, vz, mass*1e11 as mass from particles where halo_id is not null")
def dump(p: DataFrame) -> DataFrame:
    return C.member_dump(p.select("halo_id", "pid"), p.drop("halo_id"))


@query("p3_scale", ("particles",), "select pid, x-0.5e0 as x, vx*2e0 as vx from particles")
def scale(p: DataFrame) -> DataFrame:
    return S.centred(p, 2e5, 1.0).select("pid", "x", "vx")


@query("p6_physical", ("particles",), "select pid, x*150e0 as x, mass*3e0 as mass from particles")
def physical(p: DataFrame) -> DataFrame:
    return S.physical(p, 150.0, 3.0).select("pid", "x", "mass")


@query("p9_min_image", PH, f"{REL} select pid, halo_id, dx, dy, dz from rel")
def images(p: DataFrame, h: DataFrame) -> DataFrame:
    return M.relative(p, h).select("pid", "halo_id", "dx", "dy", "dz")


@query("p10_dense_points", ("particles",), "select pid, halo_id, mass*(abs(vx)+1) as density from particles where mass*(abs(vx)+1) > 5000")
def dense(p: DataFrame) -> DataFrame:
    return N.dense_points(p.select("pid", "halo_id", (F.col("mass") * (F.abs("vx") + 1)).alias("density")), 5000.0)


@query("p17_contaminants", ("particles",), "select family, count(*) as n from particles where mass > (select min(mass) from particles where family=1)*1.00001e0 group by family")
def contaminants(p: DataFrame) -> DataFrame:
    least = p.where("family = 1").agg(F.min("mass")).scalar()
    return p.withColumn("least", least).where(X.contaminated("mass", "least")).groupBy("family").agg(F.count("*").alias("n"))


@query("p18_valid_stars", ("particles",), "select halo_id, count(*) as n from particles where family=2 and age_gyr>0 and metal>0 and mass>0 group by halo_id")
def valid(p: DataFrame) -> DataFrame:
    return p.where(M.is_star() & X.valid_star("age_gyr", "metal", "mass")).groupBy("halo_id").agg(F.count("*").alias("n"))


@query("p19_light_mass", ("particles",), "select halo_id, sum(case when metal > 0.01 then mass*2 else mass end) as mass_light from particles where family=2 group by halo_id")
def light_mass(p: DataFrame) -> DataFrame:
    stars = p.where(M.is_star()).withColumn("m0", F.when(F.col("metal") > 0.01, F.col("mass") * 2))
    return S.light_mass(stars, "m0").groupBy("halo_id").agg(F.sum("mass_light").alias("mass_light"))


@query(
    "p23_kernel",
    PH,
    f"""{REL} select pid, halo_id, round(case when d/h_r*20<=1 then 1-1.5e0*pow(d/h_r*20,2)+0.75e0*pow(d/h_r*20,3) when d/h_r*20<=2 then 0.25e0*pow(2-d/h_r*20,3) else 0 end,9) as w from rel""",
)
def kernel(p: DataFrame, h: DataFrame) -> DataFrame:
    rel = M.relative(p, h, ("r",)).withColumn("h", F.col("r") / 20)
    return rounded(S.kernel_table(rel, "d", "h").select("pid", "halo_id", "w"), 9, "w")


@query("p24_magnitudes", ("ssp_grid",), "select ia, round(-2.5e0*log10(sum(pow(10e0,-0.4e0*sdss_r))),7) as sdss_r from ssp_grid group by ia")
def magnitudes(g: DataFrame) -> DataFrame:
    return rounded(g.groupBy("ia").agg(X.magnitude(F.sum(X.luminosity("sdss_r"))).alias("sdss_r")), 7, "sdss_r")


@query("j2_neighbour_lookup", ("halo_tree",), "select a.id, b.id as nid, b.r as neighbour_r from halo_tree a join halo_tree b on a.hostsub=b.id")
def lookup(t: DataFrame) -> DataFrame:
    return N.with_neighbour(t.select("id", F.col("hostsub").alias("nid")), t, "id", neighbour_r="r").select("id", "nid", "neighbour_r")


@query("j4_gather", PH, "select h.id, h.level, count(pid) as n, sum(mass) as mass from halos h left join particles p on p.halo_id=h.id group by 1,2")
def gather(p: DataFrame, h: DataFrame) -> DataFrame:
    return M.gathered(h.select("id", "level"), p)


@query(
    "j5_parents",
    ("halo_tree",),
    "select t.id, t.hostsub, t.level, m.level as mother_level, (select count(*) from halo_tree k where k.hostsub=t.id) as nbsub, coalesce(t.level=m.level+1, t.level=1) as in_order from halo_tree t left join halo_tree m on t.hostsub=m.id",
)
def parents(t: DataFrame) -> DataFrame:
    return C.with_mother(t.select("id", "hostsub", "level")).select("id", "hostsub", "level", "mother_level", "nbsub", "in_order")


@query("j10_photometry_rows", ("halos", "ssp_grid"), "select h.id, h.level, g.sdss_r from halos h join (select iz*10+ia+1 as id, sdss_r from ssp_grid) g on h.id=g.id")
def align(h: DataFrame, g: DataFrame) -> DataFrame:
    light = g.select((F.col("iz") * 10 + F.col("ia") + 1).cast("long").alias("id"), "sdss_r")
    return C.with_photometry(h.select("id", "level"), light, "sdss_r")


_EXT = "(select s_nationkey as domain, min(lx) as lo_x, max(lx) as hi_x, min(ly) as lo_y, max(ly) as hi_y, min(lz) as lo_z, max(lz) as hi_z from (select box_id as s_nationkey, px as lx, py as ly, pz as lz from halos) a group by 1)"


@query(
    "j14_domains",
    ("halos",),
    f"select domain from {_EXT} e where exists (select 1 from (select px-r as lo_x, px+r as hi_x, py-r as lo_y, py+r as hi_y, pz-r as lo_z, pz+r as hi_z from halos where level=3) b where b.lo_x<=e.hi_x and e.lo_x<=b.hi_x and b.lo_y<=e.hi_y and e.lo_y<=b.hi_y and b.lo_z<=e.hi_z and e.lo_z<=b.hi_z)",
)
def domains(h: DataFrame) -> DataFrame:
    ends = [f(f"p{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    extents = h.groupBy(F.col("box_id").alias("domain")).agg(*ends)
    side = [(F.col(f"p{a}") + s * F.col("r")).alias(f"{n}_{a}") for a in "xyz" for n, s in (("lo", -1), ("hi", 1))]
    return domains_of(h.where("level = 3").select(*side), extents).select("domain")


@query("d27_mean_density", ("particles",), "select count(*) as n, count(case when d>5000 then 1 end) as n_above, round(avg(d),6) as mean, round(avg(case when d>5000 then d end),6) as mean_above from (select mass*(abs(vx)+1) as d from particles) a")
def mean_density(p: DataFrame) -> DataFrame:
    return rounded(S.mean_density(p.select((F.col("mass") * (F.abs("vx") + 1)).alias("density")), 5000.0), 6, "mean", "mean_above")


@query("d29_group_sizes", ("particles",), "select count(*) as n_groups, cast(sum(k) as bigint) as n_points, avg(k) as mean_size, max(k) as largest from (select halo_id, count(*) as k from particles group by halo_id) a")
def sizes(p: DataFrame) -> DataFrame:
    return S.group_sizes(p.select("pid", F.col("halo_id").alias("group_id")))


@query("g11_bucket_index", ("cells",), "select cast(floor(x*16) as bigint) as gx, cast(floor(y*16) as bigint) as gy, cast(floor(z*16) as bigint) as gz, count(*) as n from cells group by 1,2,3")
def buckets(c: DataFrame) -> DataFrame:
    return R.bucket_index(c, 16)


@query("j6_halo_buckets", ("halos",), "select id, count(*) as n from (select h.id, x.i, y.i, z.i from halos h, range(-40,60) x(i), range(-40,60) y(i), range(-40,60) z(i) where x.i between floor((px-r)*32) and floor((px+r)*32) and y.i between floor((py-r)*32) and floor((py+r)*32) and z.i between floor((pz-r)*32) and floor((pz+r)*32)) a group by id")
def halo_buckets(h: DataFrame) -> DataFrame:
    return R.bucket_spans(h, "r", 32).select("id", "n")


@query(
    "w4_shell_widths",
    PH,
    f"""{REL}, l as (select halo_id, pid, d, d-lag(d) over (partition by halo_id order by r2, pid) as width from rel where family=2) select halo_id, round(max(width),10) as widest, count(width) as n from l group by halo_id""",
)
def widths(p: DataFrame, h: DataFrame) -> DataFrame:
    rel = shell_widths(M.relative(p.where(M.is_star()), h))
    return rounded(rel.groupBy("halo_id").agg(F.max("width").alias("widest"), F.count("width").alias("n")), 10, "widest")


@query("s2_remaining_roots", ("halo_tree", "root_log"), "select id from halo_tree where level=1 except select root_id from root_log where n_fail=0")
def remaining(t: DataFrame, log: DataFrame) -> DataFrame:
    return H.roots_to_do(t, log.where("n_fail = 0")).select("id")


@query("s3_distinct_buckets", ("particles",), "select count(*) as n from (select distinct floor(x*64), floor(y*64), floor(z*64) from particles) a")
def distinct_buckets(p: DataFrame) -> DataFrame:
    return R.bucket_index(p, 64).agg(F.count("*").alias("n"))


@query("w6_members_by_sort", ("particles",), "select halo_id, cast(sum(count(*)) over (order by halo_id rows unbounded preceding) - count(*) as bigint) as at, count(*) as n from particles group by halo_id")
def offsets(p: DataFrame) -> DataFrame:
    """Offsets of members in a list sorted by structure: a running sum over one row a structure."""
    return O.member_offsets(p)


@query(
    "p4_box_scalars",
    ("nation",),
    """select n_nationkey, round(side,9) as box, round(2.78782e0*pow(side,3)*pow(hubble/100,2)*omega_m,6) as box_mass from (select n_nationkey, 60e0+n_nationkey as hubble, 0.25e0+n_nationkey/100e0 as omega_m,
 (1e0+n_nationkey)*3e24/3.08e24/(0.1e0+n_nationkey/50e0) as side from nation) a""",
)
def box_scalars(n: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    header = n.select("n_nationkey", (k + 1.0).alias("boxlen"), F.lit(3e24).alias("scale_l"), (0.1 + k / 50.0).alias("aexp"), (0.25 + k / 100.0).alias("omega_m"), (60.0 + k).alias("hubble"))
    return rounded(rounded(S.box_scalars(header).select("n_nationkey", "box", "box_mass"), 9, "box"), 6, "box_mass")


@query(
    "a3_hubble_precedence",
    ("nation",),
    """select n_nationkey, case when h0 is null then 'config_fallback' when abs(h0-70e0)<=1e-6*abs(h0) then 'config_equivalent_info' else 'info_H0' end as source,
 case when h0 is null or abs(h0-70e0)<=1e-6*abs(h0) then 70e0 else h0 end as hubble from (select n_nationkey, case when n_nationkey%5<>0 then 70e0+(n_nationkey%3)*0.00003e0*(n_nationkey%4) end as h0 from nation) a""",
)
def hubble_precedence(n: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    info = n.select("n_nationkey", F.when(k % 5 != 0, 70.0 + (k % 3) * 0.00003 * (k % 4)).alias("h0"))
    return T.with_hubble(info, 70.0).select("n_nationkey", "source", "hubble")


@query(
    "a2_snapshot_info",
    ("nation",),
    """select n_nationkey, (n_nationkey+1)*3e23 as scale_l, (n_nationkey+2)*1e-27 as scale_d, case when n_nationkey%3=0 then n_nationkey*5e15 end as scale_t, case when n_nationkey%2=1 then 60e0+n_nationkey/4e0 end as h0 from nation""",
)
def info(n: DataFrame) -> DataFrame:
    """Unit files of one snapshot a nation: either spelling of the exponent, comments, other keys and missing ones."""
    k = F.col("n_nationkey")
    lines = F.array(
        F.lit("# units"), F.lit("ordering type=hilbert"), F.lit(""),
        F.concat(F.lit("unit_l      =  "), ((k + 1) * 3).cast("string"), F.lit("D+23 ! cm")),
        F.concat(F.lit(" scale_d="), (k + 2).cast("string"), F.lit("E-27")),
        F.when(k % 3 == 0, F.concat(F.lit("unit_t = "), (k * 5).cast("string"), F.lit("d15"))).otherwise("#unit_t = 1"),
        F.when(k % 2 == 1, F.concat(F.lit("H0 = "), (60 + k / 4).cast("string"))).otherwise("H0 ! none"),
    )
    out = T.info_of(T.pairs_of(n.select("n_nationkey", F.explode(lines).alias("value")), "n_nationkey"), "n_nationkey")
    # the written decimals and the products of the SQL differ in their last bits
    return out.select("n_nationkey", *[F.expr(e).alias(c) for c, e in (("scale_l", "round(scale_l/3e23)*3e23"), ("scale_d", "round(scale_d/1e-27)*1e-27"), ("scale_t", "round(scale_t/5e15)*5e15"), ("h0", "h0"))])


@query(
    "a10_job_lines",
    ("orders",),
    """select cast(o_orderkey as bigint) as line_no, concat('/runs/', o_orderpriority) as source, case when o_custkey%2=0 then 'Ra3' else 'Ra4' end as simtype, cast(o_custkey%64 as int) as workers, cast(o_orderkey%500 as int) as numstep,
 case when o_custkey%5=0 then concat('p', cast(o_custkey as varchar)) else '' end as line_prefix, regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]', '_', 'g') as source_tag from (select o_orderkey, o_custkey, replace(o_orderpriority, ' ', '+') as o_orderpriority from orders) a where o_orderkey%4<>0""",
)
def job_lines(o: DataFrame) -> DataFrame:
    """A job line an order, quoted or not, with four fields or five; every fourth is a comment or blank."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    quote = F.when(c % 3 == 0, "'").when(c % 3 == 1, '"').otherwise("")
    source = F.concat(quote, F.lit("/runs/"), F.replace("o_orderpriority", F.lit(" "), F.lit("+")), quote)
    fields = [source, F.when(c % 2 == 0, "Ra3").otherwise("Ra4"), (c % 64).cast("string"), (k % 500).cast("string"), F.when(c % 5 == 0, F.concat(F.lit("p"), c.cast("string")))]
    line = F.when(k % 8 == 0, "! none").when(k % 4 == 0, "  ").otherwise(F.concat_ws("  ", *fields))
    return T.jobs_of(o.select(k.cast("long").alias("line_no"), line.alias("line")))


_BACKGROUND = "(select n_nationkey, 0.2e0+n_nationkey/100e0 as om, 0.7e0-n_nationkey/80e0 as ol, 60e0+n_nationkey as h, 1e0/(1e0+n_nationkey/4e0) as a from nation)"


def _background(n: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    return S.background(n.select("n_nationkey", (0.2 + k / 100.0).alias("omega_m"), (0.7 - k / 80.0).alias("omega_l"), (60.0 + k).alias("hubble"), (1.0 / (1.0 + k / 4.0)).alias("aexp")))


@query("c1_expansion_rate", ("nation",), f"select n_nationkey, round(h*sqrt(om/(a*a*a)+(1-om-ol)/(a*a)+ol),7) as rate from {_BACKGROUND} b")
def expansion(n: DataFrame) -> DataFrame:
    return rounded(_background(n).select("n_nationkey", "rate"), 7, "rate")


@query(
    "c2_age",
    ("nation",),
    f"""select n_nationkey, round(any_value(977.78e0/h)*sum(x/sqrt(om*pow(x,5)+(1-om-ol)*pow(x,4)+ol*x*x)*step),5) as age from
 (select n_nationkey, om, ol, h, ln(10001e0*a)/20000e0 as step, exp(ln(1e0/a)+(i+0.5e0)*ln(10001e0*a)/20000e0) as x from {_BACKGROUND} b, range(20000) r(i)) c group by n_nationkey""",
)
def age(n: DataFrame) -> DataFrame:
    """Ages by quadrature; the SQL sums 20,000 midpoints."""
    return rounded(_background(n).select("n_nationkey", "age"), 5, "age")


@query("c7_critical_density", ("nation",), f"select n_nationkey, round(3e0*h*h/(8e0*pi()*430.1e0)*1e2/(a*a*a),6) as rho_crit from {_BACKGROUND} b")
def critical(n: DataFrame) -> DataFrame:
    return rounded(_background(n).select("n_nationkey", "rho_crit"), 6, "rho_crit")
