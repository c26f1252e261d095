"""Every registered query with SQL gives the rows of its SQL; the others run."""

import decimal

import duckdb
import pytest

from cueloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, found.fetchall())


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["split_by_length", "wrap_lines"])
def test_long_and_unspaced_lines_are_not_left_out(spark, sf_dir, name):
    from cueloom.plans.relations import v_lines

    lines = v_lines(spark, sf_dir)
    assert lines.where("length(text) >= 400 or text not like '% %'").count() > 0
    assert registry.QUERIES[name](spark, sf_dir).count() == lines.count()
