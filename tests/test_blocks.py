"""Neighbours by blocks: no pair is shuffled, and blocks of any shape give brute force's neighbours."""

import numpy as np
import pytest

from clumpwise.functions import exprs as X
from clumpwise.operators import neighbours as N
from clumpwise.operators.graph import reliable


def test_neighbours_by_blocks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    r = np.random.default_rng(3)
    at = np.concatenate([r.random((300, 3)), r.normal(0.999, 1e-3, (200, 3)) % 1.0, r.normal(0.3, 1e-6, (100, 3)), np.full((20, 3), 0.25)])
    points = spark.createDataFrame([(7 * k, *map(float, p)) for k, p in enumerate(at)] + [(-1, None, 0.5, 0.5)], "pid long, x double, y double, z double")
    found = N.nearest(points, 6)
    text = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "Join" not in text and "Window" not in text
    got = {}
    for x in found.orderBy("pid", "rank").collect():
        got.setdefault(x.pid, []).append((x.d2, x.nid))
    assert len(got) == len(at)
    for k, p in enumerate(at):
        d = at - p
        d -= np.rint(d)
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        assert got[7 * k] == sorted((float(v), 7 * j) for j, v in enumerate(d2) if j != k)[:6]


def test_few_points_are_one_block(spark):
    points = spark.createDataFrame([(k, 0.1 * k, 0.5, 0.5) for k in range(5)], "pid long, x double, y double, z double")
    assert N.nearest(points, 3).groupBy("pid").count().where("count = 3").count() == 5
    assert N.nearest(points, 9).count() == 20 and N.nearest(points.limit(1), 3).count() == 0


def _field_points(spark):
    r = np.random.default_rng(8)
    at = np.concatenate([r.random((400, 3)), r.normal(0.999, 1e-2, (300, 3)) % 1.0, r.normal(0.3, 1e-4, (200, 3))])
    rows = [(7 * k, *map(float, p), float(r.uniform(1, 2)) if k % 50 else None) for k, p in enumerate(at)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, mass double").repartition(3)


def _same(a, b, *keys):
    flat = lambda d: sorted(((tuple(x[k] for k in keys), *[v for c, v in sorted(x.asDict().items()) if c not in keys]) for x in d.collect()), key=str)
    a, b = flat(a), flat(b)
    assert [x[0] for x in a] == [x[0] for x in b]
    for x, y in zip(a, b, strict=True):
        assert x == y or (x[1] is not None and abs(x[1] - y[1]) <= 1e-9 * abs(y[1]))


@pytest.mark.parametrize("periodic", [True, False])
def test_fields_by_blocks_are_as_by_pairs(spark, monkeypatch, periodic):
    monkeypatch.setattr(N, "BLOCK", 60)
    points = _field_points(spark)
    with X.boundary(periodic):
        knn = N.nearest(points, 8).checkpoint()
        density = N.kernel_density(points, knn, 8).checkpoint()
        got = N.field(points, 8, 5)
    assert got.knn is None
    _same(got.density, density, "pid")
    targets = N.climb_targets(density, knn, 2e3, 5)
    _same(got.targets(2e3), targets, "node")
    member = N.groups(targets)
    _same(got.saddles(member), N.saddles(density, knn, member, 5), "g1", "g2")
    assert got.saddles(member).count() > 0


def test_no_pair_is_stored_for_densities(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "reliable", lambda d: seen.append(reliable(d)) or seen[-1])
    N.field(_field_points(spark), 8, 5).targets(0.0).collect()
    assert seen and all("nid" not in d.columns for d in seen) and max(d.count() for d in seen if "pid" in d.columns) <= 900


def test_a_ball_gets_no_more_than_its_nearest():
    r = np.random.default_rng(4)
    p = r.normal(0.5, 1e-3, (5000, 3))
    hit = N._hit(p, np.array([[0.4, 0.5, 0.5], [0.4, 0.51, 0.5]]), np.array([0.2, 0.3]), 6, True)
    assert 6 <= hit.sum() <= 12
    d2 = ((p - [0.4, 0.5, 0.5]) ** 2).sum(1)
    assert hit[np.argsort(d2)[:6]].all()
