"""Catalogs that change as a whole, slices of them, and domain files that are pruned before they are opened."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from clumpwise.sources import domains
from clumpwise.sources.catalog_store import CatalogStore, stream_catalogs


def tables(spark, n=4, mass=1.0):
    halos = spark.createDataFrame([(h, 0.5, 0.25, 0.75, 0.1 * h, mass) for h in range(1, n + 1)], "id long, px double, py double, pz double, r double, m double")
    members = spark.range(2000).select((1 + F.col("id") % n).alias("halo_id"), F.col("id").alias("pid"), F.lit(mass).alias("mass")).where("halo_id <> 3 or pid < 100")
    light = halos.where("id <> 2").select("id", F.lit(-20.0).alias("sdss_r"), F.lit(1.0).alias("m"))
    return {"halos": halos, "members": members, "photometry": light, "gas": halos.where("id = 1").select("id", F.lit(7.0).alias("m_gas"))}


def test_a_broken_write_leaves_the_version_before(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    with pytest.raises(KeyError):
        store.read(5)
    assert store.write(5, tables(spark), {"aexp": 0.5, "tag": "a"}, box=50.0)
    for stop in ("halos", "members", "gas"):
        with pytest.raises(RuntimeError, match=stop):
            store.write(5, tables(spark, mass=2.0), crash_after=stop)
        assert {r.m for r in store.read(5).collect()} == {1.0} and store.read(5, "members").where("mass = 2").isEmpty()
    assert store.header(5) == {"aexp": 0.5, "tag": "a", "box": 50.0, "units_version": "v2"}
    assert store.write(5, tables(spark, mass=2.0), {"aexp": 0.6}, box=50.0) and store.write(6, tables(spark))
    assert {r.m for r in store.read(5).collect()} == {2.0} and store.header(5)["aexp"] == 0.6
    assert sorted((r.snapshot, r.version) for r in store.snapshots().collect()) == [(5, 2), (6, 1)]
    with pytest.raises(KeyError, match="no table"):
        store.read(5, "cells")


def test_units_follow_the_version(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    store.write(1, {"halos": tables(spark)["halos"].withColumn("px", F.lit(-5.0))}, box=50.0, units=None)
    row = store.halos(1).where("id = 2").first()
    assert row.px == pytest.approx(0.4) and row.r == pytest.approx(0.2 / 50)
    store.write(2, {"halos": tables(spark)["halos"]}, box=50.0)
    assert store.halos(2).where("id = 2").first().px == 0.5
    store.write(3, {"halos": tables(spark)["halos"]}, units=None)
    with pytest.raises(ValueError, match="no box"):
        store.halos(3)


def test_one_structure_is_read_without_the_others(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    t = tables(spark, 4)
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows are one folder
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        store.write(9, t)
    finally:
        spark.conf.set(name, before)
    for h in (1, 2, 3, 4):
        want = [r.pid for r in t["members"].where(F.col("halo_id") == h).orderBy("pid").collect()]
        rows = store.slice_of(9, "members", h)
        assert [r.pid for r in rows.collect()] == want and rows.columns == ["halo_id", "pid", "mass"]
        assert len(want) == 500 or h == 3
    every = len(store.read(9, "members").inputFiles())
    plan = spark._jvm.PythonSQLUtils.explainString(store.slice_of(9, "members", 1)._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:200]
    at = store.read(9, "members_offsets").where("id = 3").first()
    opened = store.read(9, "members").where(F.col("part").between(at["first"], at["last"])).select(F.input_file_name()).distinct().count()
    assert every >= 3 and opened < every
    assert store.slice_of(9, "members", 77).collect() == [] and store.slice_of(9, "photometry", 2).collect() == []
    rows = {r.id: r for r in store.joined(9).collect()}
    assert rows[1].m_gas == 7.0 and rows[2].m_gas is None and rows[2].sdss_r is None and rows[4].sdss_r == -20.0 and rows[1].m_photometry == 1.0


def test_streamed_snapshots_commit_once(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "catalogs"))
    (tmp_path / "jobs").mkdir()
    for k, steps in enumerate(([1], [2, 3], [4])):
        (tmp_path / "jobs" / f"{k}.json").write_text("".join(json.dumps({"numstep": s, "n": 0 if s == 3 else s}) + "\n" for s in steps))
        os.utime(tmp_path / "jobs" / f"{k}.json", (1000 + k, 1000 + k))
    calls, broken = [], [True]

    def find(job):
        calls.append(job.numstep)
        if job.n == 0:
            return None
        if job.numstep == 4 and broken:
            broken.clear()
            raise RuntimeError("machine lost")
        return tables(spark, job.n), {"step": job.numstep}, 1.0

    run = lambda: stream_catalogs(spark, str(tmp_path / "jobs"), "numstep long, n long", str(tmp_path / "state"), store, find)
    with pytest.raises(Exception, match="machine lost"):
        run()
    run()
    assert sorted((r.snapshot, r.version) for r in store.snapshots().collect()) == [(1, 1), (2, 1), (4, 1)]
    assert store.read(2).count() == 2 and calls == [1, 2, 3, 4, 4]
    # a batch that comes again writes nothing that it has committed
    assert not store.write(2, tables(spark, 1), batch=1) and store.read(2).count() == 2


def record(b):
    return struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))


@pytest.fixture
def files(tmp_path):
    """Eight domains, slabs of x, with a particle at each tenth of the slab."""
    folder = tmp_path / "output_00001"
    folder.mkdir()
    ints = lambda *x: struct.pack(f"<{len(x)}i", *x)
    reals = lambda *x: struct.pack(f"<{len(x)}d", *x)
    for d in range(1, 9):
        n = 10
        x = [(d - 1 + (k + 0.5) / n) / 8 for k in range(n)]
        body = [ints(8), ints(3), ints(n), ints(0), ints(0), reals(0), reals(0), ints(0)]
        body += [reals(*x), reals(*[0.5] * n), reals(*[0.1 * d] * n)] + [reals(*[1.0] * n)] * 3 + [reals(*[1.0] * n), ints(*range(100 * d, 100 * d + n)), ints(*[1] * n), struct.pack(f"<{n}b", *[1, 2] * (n // 2)), struct.pack(f"<{n}b", *[0] * n)]
        (folder / f"part_00001.out{d:05d}").write_bytes(b"".join(record(b) for b in body))
    return folder


def test_a_box_read_opens_only_the_domains_it_meets(spark, files, tmp_path):
    folder = str(files)
    whole = domains.read_domains(spark, folder)
    assert whole.count() == 80 and whole.rdd.getNumPartitions() == 8
    domains.write_extents(whole, str(tmp_path / "extents.json"))
    boxes = spark.createDataFrame([(0.0, 0.1, 0.0, 1.0, 0.0, 1.0), (0.55, 0.6, 0.4, 0.6, 0.0, 1.0)], "lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    for d in (2, 3, 4, 6, 7, 8):  # files of other domains can't be read: they are not opened
        (files / f"part_00001.out{d:05d}").write_bytes(b"broken")
    rows = domains.read_domains(spark, folder, boxes, str(tmp_path / "extents.json"))
    got = rows.collect()
    assert {r.domain for r in got} == {1, 5} and all(r.x < 0.1 or 0.55 <= r.x < 0.6 for r in got) and len(got) == 8 + 4
    reader = domains.DomainReader({"path": folder, "extents": str(tmp_path / "extents.json"), "boxes": json.dumps([([0.0] * 3, [0.1, 1, 1]), ([0.55, 0.4, 0], [0.6, 0.6, 1])])})
    assert [p.domain for p in reader.partitions()] == [1, 5]
    with pytest.raises(Exception, match="cut off|broken|struct|buffer"):
        domains.read_domains(spark, folder).count()


def test_comparisons_are_pushed_down(spark, files, tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    extents = str(tmp_path / "extents.json")
    domains.write_extents(domains.read_domains(spark, str(files)), extents)
    reader = domains.PushedReader({"path": str(files), "extents": extents})
    kept = list(reader.pushFilters([GreaterThanOrEqual(("x",), 0.3), LessThan(("x",), 0.5), LessThan(("mass",), 2.0)]))
    assert len(kept) == 3 and [p.domain for p in reader.partitions()] == [3, 4]
    name, before = "spark.sql.python.filterPushdown.enabled", None
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        (files / "part_00001.out00008").write_bytes(b"broken")
        assert domains.read_domains(spark, str(files), extents=extents).where("x < 0.5").count() == 40
        assert domains.read_domains(spark, str(files), extents=extents, family="star").where("x < 0.5").count() == 20
    finally:
        spark.conf.set(name, before)
