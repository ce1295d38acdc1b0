"""Open boxes, potential choices, light by several models, and texts of trees and modes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clumpwise.functions import exprs as X
from clumpwise.functions.cosmology import ellipsoid_potential
from clumpwise.operators import hierarchy as H
from clumpwise.operators import members as M
from clumpwise.operators import neighbours as N
from clumpwise.operators import photometry as P
from clumpwise.operators import spatial as S
from clumpwise.plans.programs import find_structures, properties
from clumpwise.sources.text import RunConfig, run_config

PARTICLE = "halo_id long, pid long, family int, x double, y double, z double, vx double, vy double, vz double, mass double"
MEMBER = PARTICLE + ", density double"


def _members(spark, sizes, seed=3, at=0.5):
    r, rows = np.random.default_rng(seed), []
    for h, n in enumerate(sizes, 1):
        for x in at + r.normal(0, (0.02, 0.03, 0.04), (n, 3)):
            rows.append((h, len(rows), 1, *map(float, x), *map(float, r.normal(0, 1, 3)), float(r.uniform(1, 2)), float(r.random())))
    return spark.createDataFrame(rows, MEMBER)


def test_open_box_takes_differences_as_they_are(spark):
    r = np.random.default_rng(1)
    at = r.random((120, 3))
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(at)], "pid long, x double, y double, z double")
    with X.boundary(False):
        assert not X.is_periodic()
        got = N.nearest(p, 5).collect()
        spheres = spark.createDataFrame([(1, 0.05, 0.5, 0.95, 0.3), (2, 0.5, 0.5, 0.5, 0.8)], "id long, px double, py double, pz double, r double")
        held = S.points_in_spheres(p, spheres, "r").groupBy("id").count().collect()
    assert X.is_periodic()
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = {(k, j, n + 1) for k in range(len(at)) for n, j in enumerate(np.argsort(d2[k], kind="stable")[:5])}
    assert {(g.pid, g.nid, g["rank"]) for g in got} == want
    centres = {1: ((0.05, 0.5, 0.95), 0.3), 2: ((0.5, 0.5, 0.5), 0.8)}
    assert {h.id: h["count"] for h in held} == {k: int((((at - c) ** 2).sum(1) <= s * s).sum()) for k, (c, s) in centres.items()}


@pytest.mark.parametrize("periodic", [True, False])
@pytest.mark.parametrize("n", [1, 2, 127, 129, 300])
def test_pairs_by_blocks(spark, periodic, n):
    r = np.random.default_rng(n)
    at, m = r.random((n, 3)), r.uniform(1, 2, n)
    if n > 2:
        at[1] = at[0]  # coincident pairs count nothing
    p = spark.createDataFrame([(1, k, 1, *map(float, at[k]), 0.0, 0.0, 0.0, float(m[k])) for k in range(n)], PARTICLE)
    with X.boundary(periodic):
        got = M.pair_potential(p).first().ep
    want = 0.0
    for i in range(n):
        for j in range(i):
            d = at[i] - at[j]
            d = np.sqrt(((d - np.rint(d)) ** 2).sum() if periodic else (d * d).sum())
            want -= m[i] * m[j] / d if d else 0.0
    assert got == pytest.approx(X.G * want)


def test_finder_in_an_open_box(spark):
    r = np.random.default_rng(5)
    rows = []
    for c in ((0.99, 0.5, 0.5), (0.3, 0.3, 0.3), (0.34, 0.3, 0.3)):
        for x in r.normal(0, 0.01, (150, 3)) + np.array(c):
            rows.append((len(rows), 1, *map(float, x % 1), *map(float, r.normal(0, 1, 3)), 1.0))
    p = spark.createDataFrame(rows, "pid long, family int, x double, y double, z double, vx double, vy double, vz double, mass double")
    config = RunConfig(neighbours=12, hops=8, threshold=3e3, members=15, fudge=2.0, periodic=False)
    found = find_structures(p, config, overdensity=1e3)
    width = found.members.groupBy("halo_id").agg(*[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).collect()
    assert len(width) >= 2 and all(max(w.x, w.y, w.z) < 0.3 for w in width)  # nothing reaches across a face
    extents = {h.id: h.r for h in found.catalog.collect()}
    assert set(extents) == {w.halo_id for w in width} and max(extents.values()) < 0.3


def test_potential_choices(spark):
    p = _members(spark, (40, 60))
    base = {r.halo_id: r for r in properties(p, RunConfig(direct_pairs=50)).collect()}
    as_ellipsoid = {r.halo_id: r for r in properties(p, RunConfig(direct_pairs=50, potential_norm="ellipsoid")).collect()}
    profile = {r.halo_id: r for r in properties(p, RunConfig(direct_pairs=50, potential_profile="ellipsoid")).collect()}
    pairs = M.pair_potential(p, 50).first().ep
    for got in (base, as_ellipsoid, profile):
        assert got[1].ep == pytest.approx(pairs)  # below direct_pairs: always the pairs
    h = base[2]
    whole = ellipsoid_potential(h.m, h.sha, h.shb, h.shc, X.G)
    assert as_ellipsoid[2].ep == pytest.approx(whole) == profile[2].ep
    assert base[2].ep != pytest.approx(whole, rel=1e-6) and base[2].ep == pytest.approx(whole, rel=0.5)
    assert profile[2].et == pytest.approx(profile[2].ek + whole)
    with pytest.raises(ValueError, match="potential_norm"):
        RunConfig(potential_norm="none")
    with pytest.raises(ValueError, match="shell_own"):
        run_config({}, {"shell_own": "most"})


def test_light_of_several_models(spark):
    cells = [(iz, ia, -3.0 + iz, 6.0 + ia, 3.0 + ia + 0.2 * iz, 2.0 + 0.5 * ia) for iz in range(3) for ia in range(5)]
    grid = spark.createDataFrame(cells, "iz int, ia int, log_z double, log_age double, u double, r double")
    other = grid.where("iz < 2 and ia < 4").withColumn("u", F.col("u") + 1)
    r = np.random.default_rng(2)
    rows = [(1 + k % 2, k, 2, *map(float, r.random(3) * 0.1), float(r.uniform(0.01, 12)), float(r.uniform(1e-3, 0.03)), 1.0) for k in range(40)]
    stars = spark.createDataFrame(rows, "halo_id long, pid long, family int, x double, y double, z double, age_gyr double, metal double, mass double")
    centres = spark.createDataFrame([(1, 0.05, 0.05, 0.05), (2, 0.05, 0.05, 0.05)], "id long, px double, py double, pz double")
    rel = M.relative(stars, centres)
    lit = P.with_models(rel, {"a": grid, "b": other}, ("u", "r"))
    both = P.models_light(lit, ["a", "b"], ("u", "r"), "r")
    for m, g in (("a", grid), ("b", other)):
        alone = P.with_magnitudes(rel, g, ("u", "r"))
        want = {x.halo_id: x.asDict() for x in P.total_light(alone, ("u", "r"), "r").join(P.light_radii(alone, "r"), "halo_id").collect()}
        got = P.of_model(both.join(P.light_radii(lit, f"r_{m}", f"_{m}"), "halo_id"), m, ("u", "r")).collect()
        assert len(got) == 2
        for x in got:
            assert x.asDict() == pytest.approx(want[x.halo_id])


def test_light_of_models_in_a_run(spark):
    p = _members(spark, (60,))
    p = p.withColumns({"family": F.lit(2), "age_gyr": F.lit(1.0), "metal": F.lit(0.01)})
    cells = [(iz, ia, -3.0 + iz, 6.0 + ia, 3.0 + ia) for iz in range(3) for ia in range(5)]
    grid = spark.createDataFrame(cells, "iz int, ia int, log_z double, log_age double, r double")
    got = properties(p, RunConfig(photometry=True), grid={"one": grid, "two": grid.withColumn("r", F.col("r") + 1)}, bands=("r",), red="r").first()
    assert got.r_two == pytest.approx(got.r_one + 1) and got.r50_r_one == got.r50_r_two > 0


def test_tree_dump(spark):
    tree = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 3), (5, 0)], "id long, hostsub long")
    got = {r.id: (r.mother, r.first_child, r.sister, r.line) for r in H.tree_dump(tree).collect()}
    assert got[1] == (0, 2, 0, "halo:     1 first_child:     2 sister:     0")
    assert got[2] == (1, 0, 3, "sub:     2 mother:     1 first_child:     0 sister:     3")
    assert got[3][:3] == (1, 4, 0) and got[4][:3] == (3, 0, 0) and got[5][:3] == (0, 0, 0)
    assert H.tree_dump(tree.limit(0)).count() == 0


def test_octal(spark):
    texts = spark.createDataFrame([("0644",), (" 0o755 ",), ("0O7",), ("8",), ("",), (None,), ("7 7",)], "t string")
    assert [r.v for r in texts.select(X.octal("t").alias("v")).collect()] == [0o644, 0o755, 7, None, None, None, None]
