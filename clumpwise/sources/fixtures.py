"""Fixture views: the driver's star-schema tables seen as particles, cells, structures and logs.

The text of each view runs unchanged in Spark and in DuckDB and gives the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View name: (tables or views it reads, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "particles": (
        ('lineitem',),
        """select pid, halo_id, family, px-floor(px) as x, py-floor(py) as y, pz-floor(pz) as z,
 vx, vy, vz, mass, age_gyr, metal, h_frac, o_frac
from (select cast(((l_orderkey*8+l_linenumber)*20000+l_partkey)*1000+l_suppkey as bigint) as pid,
  cast(l_suppkey+1 as bigint) as halo_id,
  cast(case when l_returnflag='R' then 2 else 1 end as int) as family,
  cast((l_suppkey*6180339)%10000000 as double)/1.0e7 + ox*ox*ox*0.25 as px,
  cast((l_suppkey*7548776)%10000000 as double)/1.0e7 + oy*oy*oy*0.25 as py,
  cast((l_suppkey*5698402)%10000000 as double)/1.0e7 + oz*oz*oz*0.25 as pz,
  cast((l_orderkey*37+l_linenumber*11)%401-200 as double) as vx,
  cast((l_orderkey*53+l_linenumber*17)%401-200 as double) as vy,
  cast((l_orderkey*71+l_linenumber*29)%401-200 as double) as vz,
  cast(l_quantity as double) as mass,
  cast((l_orderkey*13+l_linenumber)%1300 as double)/100.0e0 as age_gyr,
  cast(l_tax as double)/4.0e0+0.001e0 as metal, 0.70e0+cast(l_discount as double) as h_frac, cast(l_tax as double)/10.0e0 as o_frac
 from (select *, cast((l_orderkey*7919+l_linenumber*104729+l_partkey*611953)%1000003 as double)/1000003.0e0-0.5e0 as ox,
   cast((l_orderkey*6271+l_linenumber*15485863+l_partkey*746773)%1000033 as double)/1000033.0e0-0.5e0 as oy,
   cast((l_orderkey*4099+l_linenumber*32452843+l_partkey*982451)%1000037 as double)/1000037.0e0-0.5e0 as oz from lineitem) a) b""",
    ),
    "cells": (
        ('orders',),
        """select cell_id, level, (ix+0.5e0)/n as x, (iy+0.5e0)/n as y, (iz+0.5e0)/n as z, rho, rho*temp as p, vx, vy, vz, metal
from (select cell_id, level, n, floor((ux-floor(ux))*n) as ix, floor((uy-floor(uy))*n) as iy, floor((uz-floor(uz))*n) as iz, rho, temp, vx, vy, vz, metal
 from (select cast(o_orderkey as bigint) as cell_id, cast(5+o_custkey%4 as int) as level,
  cast(case o_custkey%4 when 0 then 32 when 1 then 64 when 2 then 128 else 256 end as double) as n,
  cast(((o_orderkey%100)*6180339)%10000000 as double)/1.0e7 + (cast((o_orderkey*7919)%10007 as double)/10007.0e0-0.5e0)*0.2e0 as ux,
  cast(((o_orderkey%100)*7548776)%10000000 as double)/1.0e7 + (cast((o_orderkey*6271)%10009 as double)/10009.0e0-0.5e0)*0.2e0 as uy,
  cast(((o_orderkey%100)*5698402)%10000000 as double)/1.0e7 + (cast((o_orderkey*4099)%10037 as double)/10037.0e0-0.5e0)*0.2e0 as uz,
  cast(o_totalprice as double)/10000.0e0 as rho, cast((o_orderkey*97)%30000+100 as double) as temp,
  cast(o_orderkey%301-150 as double) as vx, cast((o_orderkey*3)%301-150 as double) as vy, cast((o_orderkey*7)%301-150 as double) as vz,
  cast(o_custkey%50 as double)/1000.0e0 as metal from orders) a) b""",
    ),
    "halos": (
        ('supplier',),
        """select cast(s_suppkey+1 as bigint) as id, cast(min(s_suppkey+1) over (partition by s_nationkey) as bigint) as hosthalo, cast(k as bigint) as rk, s_nationkey as box_id,
 cast(case when k=1 then 1 when k<4 then 2 when k<8 then 3 when k<16 then 4 when k<32 then 5 else 6 end as int) as level,
 cast((s_suppkey*6180339)%10000000 as double)/1.0e7 as px, cast((s_suppkey*7548776)%10000000 as double)/1.0e7 as py, cast((s_suppkey*5698402)%10000000 as double)/1.0e7 as pz,
 0.02e0+abs(cast(s_acctbal as double))/500000.0e0 as r, 0.01e0+abs(cast(s_acctbal as double))/1000000.0e0 as rvir
from (select *, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier) a""",
    ),
    "halo_tree": (
        ('halos',),
        """select h.*, cast(coalesce(m.id,0) as bigint) as hostsub from halos h left join halos m on h.box_id=m.box_id and m.rk=cast(floor(h.rk/2.0e0) as bigint)""",
    ),
    "ssp_grid": (
        ('part',),
        """select cast(p_partkey%6 as int) as iz, cast(floor(p_partkey/6.0e0) as int) as ia, -4.0e0+0.5e0*(p_partkey%6) as log_z, 5.5e0+0.5e0*floor(p_partkey/6.0e0) as log_age,
 4.0e0+0.8e0*floor(p_partkey/6.0e0)+0.1e0*(p_partkey%6) as sdss_u, 3.5e0+0.7e0*floor(p_partkey/6.0e0)+0.2e0*(p_partkey%6) as sdss_r, 3.0e0+0.6e0*floor(p_partkey/6.0e0)+0.3e0*(p_partkey%6) as johnson_k
from part where p_partkey<60""",
    ),
    "root_log": (
        ('events',),
        """select cast(event_id%100+1 as bigint) as root_id, count(*) as cells_read, cast(sum(case when event_type='error' then 1 else 0 end) as bigint) as n_fail, max(ts) as last_ts from events group by event_id%100""",
    ),
    "snapshot_jobs": (
        ('events',),
        """select cast(event_id as bigint) as line_no, cast(event_id%40 as int) as numstep, event_type as source_tag, case when event_id%17=0 then concat('p',cast(user_id as varchar(20))) else '' end as line_prefix from events""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view over them, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, text = VIEWS[name]
    text = text.replace("{", "{{").replace("}", "}}")
    for r in reads:
        text = re.sub(rf"\b(from|join) {r}\b", rf"\1 {{{r}}}", text)
    return spark.sql(text, **{r: view(spark, sf_dir, r) for r in reads})


def with_views(names: tuple[str, ...], sql: str) -> str:
    """DuckDB SQL that begins with the views it needs as common table expressions."""
    needed: list[str] = []

    def need(n: str) -> None:
        if n in VIEWS and n not in needed:
            for r in VIEWS[n][0]:
                need(r)
            needed.append(n)

    for n in names:
        need(n)
    parts = [f"{n} as ({VIEWS[n][1]})" for n in needed]
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join([*parts, body[15:]])
    if body.lower().startswith("with "):
        return "with " + ",\n".join([*parts, body[5:]])
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
