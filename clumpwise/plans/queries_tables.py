"""Queries of profiles, light, catalogs, work lists and names over the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X
from clumpwise.operators import catalog as C
from clumpwise.operators import hierarchy as H
from clumpwise.operators import members as M
from clumpwise.operators import photometry as P
from clumpwise.operators import profiles as R
from clumpwise.plans.queries_members import BULK, PH, REL, rounded
from clumpwise.plans.registry import query

SHELLS = f"""{REL}, {BULK}, v as (select rel.*, pow(vx-ux+70e0*dx,2)+pow(vy-uy+70e0*dy,2)+pow(vz-uz+70e0*dz,2) as v2, h_r as sa, h_r*0.8e0 as sb, h_r*0.6e0 as sc from rel join bulk on rel.halo_id=bulk.halo_id),
 f as (select halo_id, max(sqrt(pow(dx/sa,2)+pow(dy/sb,2)+pow(dz/sc,2))) as far from v group by halo_id),
 x as (select v.*, far*sa*1.01e0 as amax, far*sb*1.01e0 as bmax, far*sc*1.01e0 as cmax from v join f on v.halo_id=f.halo_id),
 s as (select halo_id, cast(floor(sqrt(pow(dx/amax,2)+pow(dy/bmax,2)+pow(dz/cmax,2))*1000) as bigint) as shell, mass, v2, amax, bmax, cmax from x),
 t as (select halo_id, shell, count(*) as n, sum(mass) as m, sum(0.5e0*mass*v2) as k, any_value(amax) as amax, any_value(bmax) as bmax, any_value(cmax) as cmax from s group by 1,2),
 c as (select *, sum(m) over w as m_in, sum(k) over w as k_in from t window w as (partition by halo_id order by shell rows unbounded preceding)),
 p as (select *, -430.1e0*sum((m_in-m+0.5e0*(n-1)/n*m)*m/((case when shell=0 then 0.5e0 else shell end)/999e0*cbrt(amax*bmax*cmax))) over (partition by halo_id order by shell rows unbounded preceding) as w_in from c)"""


def shells(p: DataFrame, h: DataFrame) -> DataFrame:
    """Shells about the given centres, with axes r, 0.8 r and 0.6 r along x, y and z."""
    rel = M.relative(M.with_bulk(p), h, ("r",))
    v2 = X.norm2(*[F.col(f"w{a}") + 70.0 * F.col(f"d{a}") for a in "xyz"])
    rel = rel.withColumns({"v2": v2, "da": F.col("dx"), "db": F.col("dy"), "dc": F.col("dz"), "sha": F.col("r"), "shb": F.col("r") * 0.8, "shc": F.col("r") * 0.6})
    return R.shell_table(R.in_shells(rel))


@query("d12_shell_table", PH, f"{SHELLS} select halo_id, shell, n, m, round(k,1) as k, m_in, round(k_in,1) as k_in from c")
def shell_table(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(shells(p, h).select("halo_id", "shell", "n", "m", "k", "m_in", "k_in"), 1, "k", "k_in")


@query("d13_shell_potential", PH, f"{SHELLS} select halo_id, shell, round(ln(1-w_in),7) as log_w from p")
def shell_potential(p: DataFrame, h: DataFrame) -> DataFrame:
    return R.shell_potential(shells(p, h)).select("halo_id", "shell", F.round(F.log(1 - F.col("w_in")), 7).alias("log_w"))


@query(
    "d14_virial",
    PH,
    f"""{SHELLS}, u as (select *, 2e7*4/3*pi()*(amax*bmax*cmax)/pow(999e0,3) as unit, coalesce(lead(shell) over (partition by halo_id order by shell),1000)-1 as upto, max(shell) over (partition by halo_id) as final,
 case when k_in+w_in<0 then abs(2*k_in+w_in)/abs(k_in+w_in) end as ratio from p),
 q as (select *, floor(cbrt(m_in/unit)) as reach from u),
 y as (select *, least(upto, reach + case when unit*pow(reach+1,3)<=m_in then 1 else 0 end, final) as dense from q),
 b as (select halo_id, any_value(unit) as unit, any_value(cbrt(amax*bmax*cmax)) as size, max(case when ratio<=0.2 then upto end) as settled, max_by(m_in, shell) filter (where ratio<=0.2) as m_settled, max_by(ratio, shell) filter (where ratio<=0.2) as best,
  least(1e0, min(ratio)) as lowest, greatest(max(shell),1) as top, max(case when dense>=greatest(shell,1) then dense end) as reached, max_by(m_in, dense) filter (where dense>=greatest(shell,1)) as m_reached, max(case when shell<=1 then m_in end) as m1 from y group by halo_id),
 z as (select *, coalesce(m_settled >= unit*pow(least(settled,top),3), false) as kept from b),
 o as (select halo_id, case when kept then least(settled,top) else coalesce(reached,1) end/999e0*size as r, case when kept then m_settled else coalesce(m_reached,m1,0e0) end as m, coalesce(best,lowest,1e0) as virth from z)
 select halo_id, round(case when m>0 and r>0 then r end,6) as rvir, round(case when m>0 and r>0 then m end,6) as mvir, round(virth,6) as virth,
 round(case when m>0 and r>0 then sqrt(430.1e0*m/r) end,6) as cvel, round(case when m>0 and r>0 then 35.9e0*(430.1e0*m/r) end,2) as tvir from o""",
)
def virial(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(R.virial_scalars(R.virial(R.shell_potential(shells(p, h)), 2e7)), 6, "rvir", "mvir", "virth", "cvel").withColumn("tvir", F.round("tvir", 2))


@query(
    "d17_shell_momentum",
    PH,
    f"""{REL}, {BULK}, s as (select rel.*, ux, uy, uz, cast(floor(d/h_r*100) as bigint) as shell from rel join bulk on rel.halo_id=bulk.halo_id where d<h_r)
 select halo_id, shell, sum(mass) as m, round(sum(mass*(dy*(vz-uz)-dz*(vy-uy))),5) as Lx, round(sum(mass*(dz*(vx-ux)-dx*(vz-uz))),5) as Ly, round(sum(mass*(dx*(vy-uy)-dy*(vx-ux))),5) as Lz from s group by 1,2""",
)
def shell_momentum(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(R.spherical_shells(M.relative(M.with_bulk(p), h, ("r",)), "r"), 5, "Lx", "Ly", "Lz")


HIST = f"""{REL}, i as (select * from rel where family=1 and d>0 and d<=rvir), e as (select halo_id, count(*) as n_in, min(d) as lo, max(d) as hi from i group by halo_id having count(*)>=8 and max(d)>min(d)),
 b as (select i.halo_id, mass, cast(greatest(8, least(80, floor(sqrt(n_in)))) as int) as bins, lo, hi, d from i join e on i.halo_id=e.halo_id)"""


@query(
    "d24_density_histogram",
    PH,
    f"{HIST} select halo_id, cast(least(floor((log10(d)-log10(lo))/(log10(hi)-log10(lo))*bins), bins-1) as int) as bin, count(*) as n, sum(mass) as m, any_value(bins) as bins from b group by 1,2",
)
def histogram(p: DataFrame, h: DataFrame) -> DataFrame:
    return R.log_histogram(M.relative(p, h, ("rvir",)), "rvir").select("halo_id", "bin", "n", "m", "bins")


@query("d24_nfw", PH)
def nfw(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(R.concentration(R.log_histogram(M.relative(p, h, ("rvir",)), "rvir")), 5, "c_nfw", "c_err")


@query(
    "d25_inner_slope",
    PH,
    f"""{REL}, i as (select *, lag(d) over (partition by halo_id order by d, pid) as pd from rel where family=1 and d>0 and d<rvir),
 v as (select halo_id, mass, d, rvir, 4e0/3e0*pi()*(pow(d,3)-coalesce(pow(pd,3),0)) as vol from i where pd is null or (d-pd)/d>1e-9),
 l as (select halo_id, log10(d/rvir) as x, log10(mass/vol) as y from v where vol>0 and mass>0),
 s as (select halo_id, count(*) as n, regr_slope(y,x) as b, regr_sxx(y,x) as sxx, regr_syy(y,x) as syy, regr_sxy(y,x) as sxy from l group by halo_id having count(*)>=4)
 select halo_id, round(b,6) as inslope, round(sqrt(greatest(syy-sxy*sxy/sxx,0)/((n-2)*sxx)),6) as inslope_err from s""",
)
def slope(p: DataFrame, h: DataFrame) -> DataFrame:
    return rounded(R.inner_slope(M.relative(p, h, ("rvir",)), "rvir", "rvir"), 6, "inslope", "inslope_err")




def look(ages: int = 10, metals: int = 6, tail: str = "") -> str:
    """CTEs that end in g + tail: stars with their magnitudes on the first ``ages`` and ``metals`` points of the grid's axes."""
    return f"""a{tail} as (select *, greatest(5.5e0, least({4.5 + 0.5 * (ages + 1)}e0, case when age_gyr>0 then log10(age_gyr*1e9) else 5.5e0 end)) as la, greatest(-4e0, least({-4.5 + 0.5 * metals}e0, log10(metal))) as lz from particles where family=2),
 i{tail} as (select *, cast(least(greatest(floor((la-5.5e0)/0.5e0)+1,1),{ages - 1}) as int) as ia, cast(least(greatest(floor((lz+4e0)/0.5e0)+1,1),{metals - 1}) as int) as iz from a{tail}),
 w{tail} as (select *, (la-(5.5e0+0.5e0*(ia-1)))/0.5e0 as wa, (lz-(-4e0+0.5e0*(iz-1)))/0.5e0 as wz from i{tail}),
 g{tail} as (select w.pid, w.halo_id, w.mass, w.age_gyr, w.metal, w.x, w.y, w.z, w.ia, w.iz, wa, wz, (g00.sdss_u*(1-wa)+g01.sdss_u*wa)*(1-wz)+(g10.sdss_u*(1-wa)+g11.sdss_u*wa)*wz as mu,
 (g00.sdss_r*(1-wa)+g01.sdss_r*wa)*(1-wz)+(g10.sdss_r*(1-wa)+g11.sdss_r*wa)*wz as mr, (g00.johnson_k*(1-wa)+g01.johnson_k*wa)*(1-wz)+(g10.johnson_k*(1-wa)+g11.johnson_k*wa)*wz as mk
 from w{tail} w join ssp_grid g00 on g00.iz=w.iz-1 and g00.ia=w.ia-1 join ssp_grid g01 on g01.iz=w.iz-1 and g01.ia=w.ia join ssp_grid g10 on g10.iz=w.iz and g10.ia=w.ia-1 join ssp_grid g11 on g11.iz=w.iz and g11.ia=w.ia)"""


LOOK = look()
BANDS = ("sdss_u", "sdss_r", "johnson_k")


@query("j11_ssp_lookup", ("particles", "ssp_grid"), f"with {LOOK} select pid, halo_id, round(mu,7) as sdss_u, round(mr,7) as sdss_r, round(mk,7) as johnson_k from g")
def lookup(p: DataFrame, g: DataFrame) -> DataFrame:
    out = P.with_magnitudes(p.where(M.is_star()), g, BANDS)
    return out.select("pid", "halo_id", *[F.round(f"mag_{b}", 7).alias(b) for b in BANDS])


@query(
    "d22_photometry",
    ("particles", "ssp_grid"),
    f"""with {LOOK} select halo_id, round(-2.5e0*log10(sum(mass*pow(10,-0.4e0*mu))),6) as sdss_u, round(-2.5e0*log10(sum(mass*pow(10,-0.4e0*mr))),6) as sdss_r,
 round(-2.5e0*log10(sum(mass*pow(10,-0.4e0*mk))),6) as johnson_k, round(sum(mass*pow(10,-0.4e0*mr)*age_gyr)/sum(mass*pow(10,-0.4e0*mr)),6) as age_r,
 round(sum(mass*pow(10,-0.4e0*mr)*metal)/sum(mass*pow(10,-0.4e0*mr)),8) as metal_r from g where age_gyr>0 group by halo_id""",
)
def photometry(p: DataFrame, g: DataFrame) -> DataFrame:
    stars = p.where(M.is_star() & X.valid_star("age_gyr", "metal", "mass"))
    out = P.total_light(P.with_magnitudes(stars, g, BANDS), BANDS, "sdss_r")
    return rounded(rounded(out, 6, *BANDS, "age_r"), 8, "metal_r")


#: The models of ``d22_models``: the stars' CTE, and the magnitudes there; ``given`` is the grid as it is, ``steep`` has other magnitudes, ``short`` shorter axes.
MODELS = {"given": ("g", "m{}"), "steep": ("g", "(1.5e0*m{}-1e0)"), "short": ("g_short", "m{}")}


def _model_sums(model: str) -> str:
    table, mag = MODELS[model]
    light = {b: f"mass*pow(10,-0.4e0*{mag.format(b)})" for b in "urk"}
    totals = ", ".join(f"round(-2.5e0*log10(sum({light[b]})),6) as {name}_{model}" for b, name in zip("urk", BANDS, strict=True))
    means = ", ".join(f"round(sum({light['r']}*{c})/sum({light['r']}),{n}) as {out}_{model}" for c, n, out in (("age_gyr", 6, "age_r"), ("metal", 8, "metal_r")))
    return f"(select halo_id, {totals}, {means} from {table} where age_gyr>0 group by halo_id)"


def _grids(g: DataFrame) -> dict[str, DataFrame]:
    steep = g.withColumns({b: F.col(b) * 1.5 - 1 for b in BANDS})
    return {"given": g, "steep": steep, "short": g.where("ia < 7 and iz < 4")}


@query(
    "d22_models",
    ("particles", "ssp_grid"),
    f"with {LOOK}, {look(7, 4, '_short')} select * from {_model_sums('given')} m1 join {_model_sums('steep')} m2 using (halo_id) join {_model_sums('short')} m3 using (halo_id)",
)
def models(p: DataFrame, g: DataFrame) -> DataFrame:
    """Light by three models of populations, whose grids differ in magnitudes and axes, in one aggregation."""
    stars = p.where(M.is_star() & X.valid_star("age_gyr", "metal", "mass"))
    out = P.models_light(P.with_models(stars, _grids(g), BANDS), list(MODELS), BANDS, "sdss_r")
    digits = lambda c: 8 if c.startswith("metal_r") else 6
    return out.select("halo_id", *[F.round(c, digits(c)).alias(c) for c in out.columns if c != "halo_id"])


@query(
    "d22_light_radii",
    ("particles", "halos", "ssp_grid"),
    f"""with {LOOK}, o as (select g.halo_id, g.pid, mass*pow(10,-0.4e0*mr) as lum, x-px-round_even(x-px,0) as dx, y-py-round_even(y-py,0) as dy, z-pz-round_even(z-pz,0) as dz from g join halos h on h.id=g.halo_id where age_gyr>0),
 c as (select halo_id, dx*dx+dy*dy+dz*dz as r2, sum(lum) over (partition by halo_id order by dx*dx+dy*dy+dz*dz, pid) as held, sum(lum) over (partition by halo_id) as total from o)
 select halo_id, round(min(case when held>=0.5e0*total then sqrt(r2) end),9) as r50_r, round(min(case when held>=0.9e0*total then sqrt(r2) end),9) as r90_r from c group by halo_id""",
)
def light_radii(p: DataFrame, h: DataFrame, g: DataFrame) -> DataFrame:
    stars = P.with_magnitudes(p.where(M.is_star() & X.valid_star("age_gyr", "metal", "mass")), g, BANDS)
    return rounded(P.light_radii(M.relative(stars, h), "sdss_r"), 9, "r50_r", "r90_r")


@query(
    "b5s_tree_dump",
    ("halo_tree",),
    """with t as (select id, hostsub as mother, case when hostsub>0 then lead(id) over (partition by hostsub order by id) end as sister from halo_tree),
 k as (select hostsub as id, min(id) as first_child from halo_tree where hostsub>0 group by hostsub),
 d as (select t.id, mother, coalesce(first_child,0) as first_child, coalesce(sister,0) as sister from t left join k on k.id=t.id)
 select *, case when mother>0 then printf('sub:%6d mother:%6d first_child:%6d sister:%6d',id,mother,first_child,sister) else printf('halo:%6d first_child:%6d sister:%6d',id,first_child,sister) end as line from d""",
)
def tree_dump(t: DataFrame) -> DataFrame:
    return H.tree_dump(t)


@query("p26_octal", ("orders",), "select o_orderkey, cast((o_orderkey%8)*64+(o_custkey%8)*8+(o_orderkey*3)%8 as bigint) as mode from orders")
def octal_modes(o: DataFrame) -> DataFrame:
    """Permissions written as three octal digits of an order's numbers."""
    digits = [F.col("o_orderkey") % 8, F.col("o_custkey") % 8, (F.col("o_orderkey") * 3) % 8]
    head = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" 0o")).otherwise(F.lit("0"))
    return o.select("o_orderkey", X.octal(F.concat(head, *[d.cast("string") for d in digits])).alias("mode"))


@query(
    "p9_open_box",
    ("particles", "halos"),
    """with o as (select pid, halo_id, mass, x-px as dx, y-py as dy, z-pz as dz from particles p join halos h on h.id=p.halo_id)
 select halo_id, count(*) as n, round(max(sqrt(dx*dx+dy*dy+dz*dz)),9) as r, round(sum(mass*(dx*dx+dy*dy+dz*dz)),6) as moment from o group by halo_id""",
)
def open_box(p: DataFrame, h: DataFrame) -> DataFrame:
    """Extents and moments of structures in a box that is not periodic."""
    with X.boundary(False):
        rel = M.relative(p, h)
    out = rel.groupBy("halo_id").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.sum(F.col("mass") * F.col("r2")).alias("moment"))
    return rounded(rounded(out, 9, "r"), 6, "moment")


@query(
    "j13_epoch_age",
    ("particles", "nation"),
    """with k as (select cast(n_nationkey as double) as u, cast(n_nationkey*n_nationkey as double) as t, lead(cast(n_nationkey as double)) over (order by n_nationkey) as u2,
 lead(cast(n_nationkey*n_nationkey as double)) over (order by n_nationkey) as t2 from nation), p as (select pid, halo_id, least(greatest(age_gyr*2,0e0),24e0) as v from particles where family=2)
 select pid, halo_id, round(t+(v-u)/(u2-u)*(t2-t),6) as epoch from p join k on v>=u and (v<u2 or (v=24 and u2=24))""",
)
def epoch(p: DataFrame, n: DataFrame) -> DataFrame:
    knots = n.select(F.col("n_nationkey").cast("double").alias("u"), (F.col("n_nationkey") * F.col("n_nationkey")).cast("double").alias("t"))
    stars = p.where(M.is_star()).select("pid", "halo_id", (F.col("age_gyr") * 2).alias("v"))
    return rounded(P.interpolated(stars, "v", knots, "u", "t", "epoch").select("pid", "halo_id", "epoch"), 6, "epoch")


@query("p7_output_units", ("halos",), "select id, r*1e11 as m, px-floor(px) as px, py-floor(py) as py, pz-floor(pz) as pz, r/2e0 as r, rvir/2e0 as rvir, rvir*100 as rho_0 from halos")
def units(h: DataFrame) -> DataFrame:
    rows = h.withColumns({"m": F.col("r"), "rho_0": F.col("rvir"), **{f"p{a}": F.col(f"p{a}") * 2.0 for a in "xyz"}})
    return C.output_units(rows, 2.0).select("id", "m", "px", "py", "pz", "r", "rvir", "rho_0")


@query("p8_light_catalog", ("halos",), "select id, level, hosthalo, px, py, pz, r, rvir from halos")
def light(h: DataFrame) -> DataFrame:
    return C.light(h)


@query("p16_legacy_centres", ("halos",), "select id, px/2e0+0.5e0-floor(px/2e0+0.5e0) as px, case when rvir>0.02 then rvir/2e0 end as rvir from halos")
def legacy(h: DataFrame) -> DataFrame:
    rows = h.withColumn("rvir", F.when(F.col("rvir") > 0.02, F.col("rvir")))
    return C.code_units(rows, 2.0, legacy=True).select("id", "px", "rvir")


@query("j9_gas_join", ("halos", "cells"), "select h.id, h.level, coalesce(c.n,-1) as n_cells from halos h left join (select cell_id%150+1 as id, count(*) as n from cells group by 1) c on h.id=c.id")
def gas_join(h: DataFrame, c: DataFrame) -> DataFrame:
    gas = c.groupBy((F.col("cell_id") % 150 + 1).alias("id")).agg(F.count("*").alias("n_cells"))
    return C.with_gas(h.select("id", "level"), gas, {"n_cells": -1})


@query("j15_resume_antijoin", ("halo_tree", "root_log"), "select id, hosthalo, level from halo_tree where level=1 and id not in (select root_id from root_log where n_fail=0)")
def to_do(t: DataFrame, log: DataFrame) -> DataFrame:
    return H.roots_to_do(t, log.where("n_fail = 0")).select("id", "hosthalo", "level")


@query("j17_root_selection", ("halos",), "select id, level from halos where level=1 order by id limit 10")
def root_selection(h: DataFrame) -> DataFrame:
    return H.selected_roots(h, most=10).select("id", "level")


@query("d38_run_totals", ("root_log",), "select count(*) as n_roots, cast(sum(cells_read) as bigint) as cells_read, cast(sum(n_fail) as bigint) as n_fail from root_log")
def totals(log: DataFrame) -> DataFrame:
    return H.run_totals(log)


@query(
    "d39_progress",
    ("halo_tree", "root_log"),
    """select count(root_id) as done, count(case when root_id is null then 1 end) as to_do, arg_max(root_id, struct_pack(c:=cells_read, k:=-root_id)) as slowest from (select id from halo_tree where level=1) t left join root_log on id=root_id""",
)
def progress(t: DataFrame, log: DataFrame) -> DataFrame:
    return H.progress(t, log)


@query(
    "d39_remaining_time",
    ("halo_tree", "root_log"),
    """select count(root_id) as done, count(case when root_id is null then 1 end) as to_do, coalesce(sum(s),0e0) as seconds, round(avg(s)*count(case when root_id is null then 1 end),6) as eta, arg_max(root_id, struct_pack(c:=s, k:=-root_id)) as slowest
 from (select id from halo_tree where level<=2) t left join (select root_id, cells_read/4e0 as s from root_log where root_id%3<>0) l on id=root_id""",
)
def remaining(t: DataFrame, log: DataFrame) -> DataFrame:
    """Time left at the rate so far; a log in which a third of the hosts is missing, and seconds by cells."""
    hosts = t.where("level <= 2").withColumn("level", F.lit(1))
    timed = log.where("root_id % 3 <> 0").select("root_id", (F.col("cells_read") / 4).alias("seconds"))
    return rounded(H.remaining_time(hosts, timed), 6, "eta")


@query(
    "a11_output_names",
    ("snapshot_jobs",),
    """select line_no, numstep, concat(case when line_prefix<>'' then line_prefix when count(*) over (partition by numstep)=1 then 'step' when count(*) over (partition by numstep, source_tag)=1 then source_tag
 else concat(source_tag,'_L',cast(line_no as varchar)) end, '_', lpad(cast(numstep as varchar),5,'0')) as name from snapshot_jobs""",
)
def names(jobs: DataFrame) -> DataFrame:
    return H.output_names(jobs).select("line_no", "numstep", "name")


@query(
    "a13_repeated_outputs",
    ("snapshot_jobs",),
    """select name, count(*) as n from (select concat(case when line_prefix<>'' then concat('p',cast(line_no%5 as varchar)) when count(*) over (partition by numstep)=1 then 'step' when count(*) over (partition by numstep, source_tag)=1 then source_tag
 else concat(source_tag,'_L',cast(line_no as varchar)) end, '_', lpad(cast(numstep as varchar),5,'0')) as name from snapshot_jobs) a group by name having count(*)>1""",
)
def repeated(jobs: DataFrame) -> DataFrame:
    """Prefixes are made to repeat."""
    prefix = F.concat(F.lit("p"), (F.col("line_no") % 5).cast("string"))
    return H.repeated_outputs(jobs.withColumn("line_prefix", F.when(F.col("line_prefix") != "", prefix).otherwise("")))


@query(
    "p25_names",
    ("nation",),
    """select n_nationkey, regexp_replace(concat(n_name,' #',cast(n_nationkey as varchar)),'[^A-Za-z0-9._-]','_','g') as tag, n_nationkey%3=0 as flag, cast(n_nationkey as double)*100e0 as number from nation""",
)
def tags(n: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/data/"), "n_name", F.lit(" #"), F.col("n_nationkey").cast("string"), F.lit("//"))
    flag = F.when(F.col("n_nationkey") % 3 == 0, F.lit(" .TRUE. ")).otherwise(F.lit("no"))
    number = F.concat(F.col("n_nationkey").cast("string"), F.lit(".0D+02"))
    return n.select("n_nationkey", X.path_tag(path).alias("tag"), X.fortran_bool(flag).alias("flag"), X.fortran_double(number).alias("number"))
