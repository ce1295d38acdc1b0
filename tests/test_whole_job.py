"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

from clumpwise.operators import members as M
from clumpwise.plans import registry

PARTICLE = "halo_id long, pid long, family int, x double, y double, z double, vx double, vy double, vz double, mass double"


def test_large_structures_have_a_potential(spark):
    from clumpwise.functions import exprs as X

    r = np.random.default_rng(2)
    at = np.concatenate([r.normal(0.5, 0.01, (1200, 3)), r.normal(0.2, 0.01, (50, 3)), np.full((1000, 3), 0.75)])
    at[1250:, :2] += r.normal(0, 0.01, (1000, 2))  # flat: no shells, but an ellipsoid
    halo = [1] * 1200 + [2] * 50 + [3] * 1000
    p = spark.createDataFrame([(h, k, 1, *map(float, x), 0.0, 0.0, 0.0, 1.0) for k, (h, x) in enumerate(zip(halo, at, strict=True))], PARTICLE)
    exact = {e.halo_id: e.ep for e in M.pair_potential(p, 5000).collect()}
    centres = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 0.2, 0.2, 0.2), (3, 0.75, 0.75, 0.75)], "id long, px double, py double, pz double")
    got = {e.halo_id: e.ep for e in M.potential(p, centres).collect()}
    assert set(got) == {1, 2, 3} and got[2] == pytest.approx(exact[2])
    assert got[1] == pytest.approx(exact[1], rel=0.2)
    assert got[3] == pytest.approx(-0.6 * X.G * 1000**2 * np.pi / 2 / 0.01, rel=0.05)


def test_potential_of_every_structure_of_a_table(spark, tmp_path):
    """All particles of the table's line items in one structure."""
    from pyspark.sql import functions as F

    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    items.withColumn("l_suppkey", F.lit(1).cast(items.schema["l_suppkey"].dataType)).limit(1500).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = registry.queries()["d11_pair_potential"](spark, str(tmp_path)).collect()
    assert [r.halo_id for r in rows] == [2] and rows[0].ep < 0


def test_log_and_jobs_hold_all_events(spark):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    total = registry.queries()["d38_run_totals"](spark, sf).first()
    assert n > 200 and total.n_roots == 100 and total.cells_read == n
    assert registry.queries()["a11_output_names"](spark, sf).count() == n


def test_whole_catalog(spark):
    sf = "/root/testdata/sf0.01"
    assert registry.queries()["a14_whole_catalog"](spark, sf).count() == spark.read.parquet(f"{sf}/supplier.parquet").count()
