"""Every query of the catalog against its SQL, or at least that it runs."""

import math
import os

import duckdb
import pytest

from tabloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    said = db.execute(catalog.ORACLE[name])
    names = [c[0] for c in said.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in order]) for r in said.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_models_see_the_whole_table_by_unique_ids(spark):
    rows, _ = catalog._frame(spark, SF)
    assert rows.count() == rows.select("id").distinct().count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
