"""Every query with SQL agrees with DuckDB at the smallest size; the others run."""

from pathlib import Path

import duckdb
import pytest

from clumpwise.plans import registry

SF = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(row):
    return tuple(repr(float(x)) if isinstance(x, float) else repr(x) for x in row)


#: Steps on the way to ``g3_saddles``, which compares what they all give; each takes a minute.
STEPS = {"j1_knn", "d28_sph_density", "g1_hill_climb", "g2_group_labels"}


@pytest.mark.parametrize("name", sorted(set(SQL) - STEPS))
def test_same_as_sql(spark, duck, name):
    df, res = QUERIES[name](spark, SF), duck.sql(SQL[name])
    mine, theirs = sorted(df.columns), sorted(res.columns)
    assert mine == theirs
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == dict(zip(res.columns, map(str, res.types), strict=True))
    a = sorted(plain(r) for r in df.select(*mine).collect())
    assert a == sorted(plain(r) for r in res.select(", ".join(f'"{c}"' for c in theirs)).fetchall())
    assert a


@pytest.mark.parametrize("name", ["d6_shrinking_sphere", "d7_nested_cells", "d9_axes", "d24_nfw", "g5_adaptive"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
