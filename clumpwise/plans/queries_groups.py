"""Queries of neighbours, groups, saddles, trees and hierarchies over the fixture views.

The SQL of nearest neighbours compares all points of the 27 cells around a point on one grid of 16 cells a
side, which is wide enough for the views' points; the threshold tree and what follows from it have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clumpwise.operators import hierarchy as H
from clumpwise.operators import neighbours as N
from clumpwise.operators import tree as T
from clumpwise.operators.graph import follow, reliable
from clumpwise.operators.tables import with_unique
from clumpwise.plans.queries_members import rounded
from clumpwise.plans.registry import query

#: Neighbours of the density, neighbours that are climbed, and the least density.
K, HOPS, LEAST = 16, 12, 1e8


def found(p: DataFrame) -> tuple[DataFrame, N.Field]:
    """Particles with unique ids, and their densities and neighbours."""
    points = with_unique(p, "pid").select("pid", "x", "y", "z", "mass")
    return points, N.field(points, K, HOPS)


#: Nearest neighbours (knn), densities (dens), targets (climb), groups (grp) and saddles by brute force over the cells around.
_KNN = f"""q as (select pid, x, y, z, mass, cast(floor(x*16) as int) as gx, cast(floor(y*16) as int) as gy, cast(floor(z*16) as int) as gz from particles),
 o as (select unnest([-1,0,1]) as o), s as (select q.*, (gx+a.o+16)%16 as cx, (gy+b.o+16)%16 as cy, (gz+c.o+16)%16 as cz from q cross join o a cross join o b cross join o c),
 pairs as (select s.pid, t.pid as nid, t.x-s.x-round_even(t.x-s.x,0) as dx, t.y-s.y-round_even(t.y-s.y,0) as dy, t.z-s.z-round_even(t.z-s.z,0) as dz from s join q t on t.gx=s.cx and t.gy=s.cy and t.gz=s.cz and t.pid<>s.pid),
 near as (select pid, nid, dx*dx+dy*dy+dz*dz as d2 from pairs), far as (select pid, list_max(min(d2,{K})) as most from near group by pid),
 knn as materialized (select * from (select near.pid, nid, d2, row_number() over (partition by near.pid order by d2, nid) as rank from near join far on near.pid=far.pid and d2<=most) a where rank<={K})"""
_DENS = f"""{_KNN}, h as (select pid, sqrt(d2)/2 as h from knn where rank={K}),
 w as (select knn.pid, h, q.mass as m, sqrt(d2)/h as u from knn join h on h.pid=knn.pid join q on q.pid=knn.nid),
 dens as materialized (select w.pid, (sum(m*(case when u<=1 then 1-1.5e0*u*u+0.75e0*u*u*u when u<=2 then 0.25e0*pow(2-u,3) else 0e0 end))+any_value(q.mass))/(pi()*pow(any_value(h),3)) as density from w join q on q.pid=w.pid group by w.pid)"""
_CLIMB = f"""{_DENS}, own as (select * from dens where density>{LEAST!r}),
 cand as (select own.pid, knn.nid, d.density from own join knn on knn.pid=own.pid and rank<={HOPS} join dens d on d.pid=knn.nid union all select pid, pid, density from own),
 climb as materialized (select pid as node, nid as target from (select pid, nid, row_number() over (partition by pid order by density desc, nid) as k from cand) a where k=1)"""
_GROUPS = f"""{_CLIMB}, walk as (select node, node as at from climb union select walk.node, climb.target from walk join climb on climb.node=walk.at),
 grp as (select walk.node as pid, walk.at as group_id from walk join climb on climb.node=walk.at and climb.target=climb.node)"""
_SADDLES = f"""{_GROUPS}, known as (select grp.pid, group_id, density from grp join dens on dens.pid=grp.pid),
 edge as (select a.group_id as g1, b.group_id as g2, max(least(a.density,b.density)) as rho from knn join known a on a.pid=knn.pid join known b on b.pid=knn.nid where rank<={HOPS} and a.group_id<>b.group_id group by 1, 2)"""

P = ("particles",)


@query("j1_knn", P, f"with {_KNN} select pid, nid, rank, round(sqrt(d2),9) as d from knn")
def knn(p: DataFrame) -> DataFrame:
    points = with_unique(p, "pid")
    return N.nearest(points, K).select("pid", "nid", F.col("rank").cast("long").alias("rank"), F.round(F.sqrt("d2"), 9).alias("d"))


@query("d28_sph_density", P, f"with {_DENS} select pid, round(log10(density),6) as log_density from dens")
def density(p: DataFrame) -> DataFrame:
    _, d = found(p)
    return d.density.select("pid", F.round(F.log10("density"), 6).alias("log_density"))


@query("g1_hill_climb", P, f"with {_CLIMB} select node, target from climb")
def climb(p: DataFrame) -> DataFrame:
    _, d = found(p)
    return d.targets(LEAST)


@query("g2_group_labels", P, f"with recursive {_GROUPS} select pid, group_id from grp")
def labels(p: DataFrame) -> DataFrame:
    _, d = found(p)
    return N.groups(d.targets(LEAST))


@query("g3_saddles", P, f"with recursive {_SADDLES} select a.g1, a.g2, round(log10(least(a.rho,b.rho)),6) as rho from edge a join edge b on a.g1=b.g2 and a.g2=b.g1")
def saddle_edges(p: DataFrame) -> DataFrame:
    _, d = found(p)
    return N.symmetric(reliable(d.saddles(N.groups(d.targets(LEAST))))).withColumn("rho", F.round(F.log10("rho"), 6))


def _tree(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, d = found(p)
    member = N.groups(d.targets(1e7))
    edges = reliable(N.symmetric(reliable(d.saddles(member))))
    return reliable(T.threshold_tree(points, member, d.density, edges, T.TreeRules(1e7, members=20))), member, d.density


@query("g4b_tree", ("particles",))
def tree(p: DataFrame) -> DataFrame:
    nodes, _, _ = _tree(p)
    out = T.node_order(nodes, T.ORDER).withColumn("groups", F.size("groups").cast("long"))
    return rounded(out, 6, "px", "py", "pz", "r_rms")


@query("g4d_painting", ("particles",))
def painting(p: DataFrame) -> DataFrame:
    nodes, member, d = _tree(p)
    return T.paint(member, d, nodes)


@query("g6_structures", ("particles",))
def selection(p: DataFrame) -> DataFrame:
    nodes, _, _ = _tree(p)
    return T.structures(nodes)


EDGES = "(select cast(l_suppkey+1 as bigint) as g1, cast((l_partkey*7+l_orderkey)%100+1 as bigint) as g2, cast(l_quantity as double)+cast(l_extendedprice as double)/1000e0 as rho from lineitem)"


def edges_of(lineitem: DataFrame) -> DataFrame:
    """Directed contacts of suppliers, as stand-ins of groups."""
    return lineitem.select(
        (F.col("l_suppkey") + 1).cast("long").alias("g1"),
        ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 100 + 1).cast("long").alias("g2"),
        (F.col("l_quantity").cast("double") + F.col("l_extendedprice").cast("double") / 1000.0).alias("rho"),
    ).where("g1 <> g2")


@query(
    "j3_saddle_symmetry",
    ("lineitem",),
    f"""with e as (select g1, g2, max(rho) as rho from {EDGES} a where g1<>g2 group by g1, g2) select a.g1, a.g2, least(a.rho, b.rho) as rho from e a join e b on a.g1=b.g2 and a.g2=b.g1""",
)
def symmetry(lineitem: DataFrame) -> DataFrame:
    return N.symmetric(edges_of(lineitem).groupBy("g1", "g2").agg(F.max("rho").alias("rho")))


@query(
    "g4_percolation",
    ("halo_tree",),
    """with recursive n as (select id, hostsub, r from halo_tree where r > 0.024e0),
 e as (select a.id as u, b.id as v from n a join n b on a.hostsub=b.id where least(a.r,b.r) > 0.024e0 union select b.id, a.id from n a join n b on a.hostsub=b.id where least(a.r,b.r) > 0.024e0),
 w as (select id as node, id as seen from n union select w.node, e.v from w join e on w.seen=e.u)
 select node as group_id, min(seen) as component from w group by node""",
)
def percolation(t: DataFrame) -> DataFrame:
    peaks = t.select(F.col("id").alias("group_id"), F.col("r").alias("peak"))
    r = t.select(F.col("id").alias("g2"), F.col("r").alias("r2"))
    e = t.where("hostsub > 0").select(F.col("id").alias("g1"), F.col("hostsub").alias("g2"), "r").join(r, "g2").select("g1", "g2", F.least("r", "r2").alias("rho"))
    return N.percolate(peaks, e, 0.024)


@query(
    "g7_hop_selection",
    ("halo_tree",),
    "with recursive w as (select id, id as root from halo_tree where hostsub=0 union all select t.id, w.root from w join halo_tree t on t.hostsub=w.id) select id, root from w",
)
def hosts(t: DataFrame) -> DataFrame:
    jumps = t.select(F.col("id").alias("node"), F.when(F.col("hostsub") > 0, F.col("hostsub")).otherwise(F.col("id")).alias("target"))
    return follow(jumps).select(F.col("node").alias("id"), "root")


@query(
    "g6_most_massive_child",
    ("halo_tree",),
    "select mother, child from (select hostsub as mother, id as child, row_number() over (partition by hostsub order by r desc, id) as k from halo_tree where hostsub>0) a where k=1",
)
def massive_child(t: DataFrame) -> DataFrame:
    return T.heaviest_child(t.withColumn("mother", F.col("hostsub")), "r")


@query(
    "g9_hierarchy_threading",
    ("halo_tree",),
    """with recursive w as (select id, hostsub, id as hosthalo, 1 as level, [id] as path from halo_tree where hostsub=0
 union all select t.id, t.hostsub, w.hosthalo, w.level+1, list_append(w.path, t.id) from w join halo_tree t on t.hostsub=w.id)
 select id, cast(level as int) as level, hostsub, hosthalo, (select count(*) from halo_tree k where k.hostsub=w.id) as nbsub, coalesce(lead(id) over (partition by hosthalo order by path), -1) as nextsub from w""",
)
def threading(t: DataFrame) -> DataFrame:
    return H.thread(t)


@query(
    "j16_descendants",
    ("halo_tree",),
    "with recursive w as (select id as root, id from halo_tree where level=1 union all select w.root, t.id from w join halo_tree t on t.hostsub=w.id) select root, id from w",
)
def below(t: DataFrame) -> DataFrame:
    return H.descendants(t)


@query(
    "t3_node_order",
    ("halos",),
    "select id, row_number() over (order by level, r desc, rvir desc, px, py, pz, id) as rank from halos",
)
def order(h: DataFrame) -> DataFrame:
    return T.node_order(h, {"level": False, "r": True, "rvir": True, "px": False, "py": False, "pz": False, "id": False}).select("id", "rank")


DENS = "(select pid, halo_id as group_id, x, y, z, mass, mass*(abs(vx)+1) as density from particles)"


@query(
    "w5_prefix_moments",
    ("particles",),
    f"""select group_id, pid, density, count(*) over w as n, sum(mass) over w as m, round(sum(density) over w, 4) as s from {DENS} a window w as (partition by group_id order by density desc, pid rows unbounded preceding)""",
)
def prefixes(p: DataFrame) -> DataFrame:
    member = p.select("pid", F.col("halo_id").alias("group_id"))
    d = p.select("pid", (F.col("mass") * (F.abs("vx") + 1)).alias("density"))
    return rounded(N.prefix_moments(p.select("pid", "mass"), member, d), 4, "s")


@query(
    "d30_component_moments",
    ("particles", "halos"),
    f"""with a as (select d.*, h.hosthalo as component from {DENS} d join halos h on d.group_id=h.id where density>2000),
 t as (select component, x as tx, y as ty, z as tz from (select *, row_number() over (partition by component order by density desc, pid) as k from a) b where k=1),
 r as (select a.*, x-tx-round_even(x-tx,0) as dx, y-ty-round_even(y-ty,0) as dy, z-tz-round_even(z-tz,0) as dz from a join t on a.component=t.component),
 g as (select component, group_id, count(*) as n, sum(mass) as m, sum(mass*dx) as mx, sum(mass*dy) as my, sum(mass*dz) as mz, sum(mass*(dx*dx+dy*dy+dz*dz)) as mr, sum(density) as s, max(density) as top from r group by 1,2)
 select component, cast(sum(n) as bigint) as n, sum(m) as mass, round(sqrt(abs(sum(m)*sum(mr)-sum(mx)*sum(mx)-sum(my)*sum(my)-sum(mz)*sum(mz)))/sum(m),8) as r_rms, round(sum(s)/sum(n),5) as rho_mean,
 max(top) as rho_max, max(n) as n_group, round(max((s/n)/(1+4e0/sqrt(n))),5) as contrast from g group by component""",
)
def moments(p: DataFrame, h: DataFrame) -> DataFrame:
    member = p.select("pid", F.col("halo_id").alias("group_id"))
    d = p.select("pid", (F.col("mass") * (F.abs("vx") + 1)).alias("density"))
    comp = h.select(F.col("id").alias("group_id"), F.col("hosthalo").alias("component"))
    out = N.component_moments(p.select("pid", "x", "y", "z", "mass"), member, d, comp, 2000.0)
    return rounded(rounded(out, 8, "r_rms"), 5, "rho_mean", "contrast")
