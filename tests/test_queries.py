"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and repeat themselves."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sigspark import catalog
from sigspark.fixtures import view

DATA = "/root/testdata/sf0.001"


def canon(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False, name=None):
        row = []
        for v in r:
            if isinstance(v, (list, np.ndarray)):
                row.append(tuple(np.asarray(v).tolist()))
            elif v is None or v is pd.NaT or v is pd.NA or v != v:
                row.append(None)
            elif isinstance(v, (bool, np.bool_)):
                row.append(bool(v))
            elif isinstance(v, (int, np.integer)):
                row.append(int(v))
            elif isinstance(v, (float, np.floating)):
                row.append(int(v) if float(v).is_integer() else round(float(v), 9))
            else:
                row.append(v)
        out.append(repr(row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_repeats_itself(spark, name):
    f = catalog.queries()[name]
    first = canon(f(spark, DATA).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert canon(f(spark, DATA).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first


def test_all_kmers_and_windows(spark):
    got = {n: catalog.queries()[n](spark, DATA) for n in ("kmer_rank", "lower_bound_lookup")}
    v = lambda name: view(spark, DATA, name)
    assert got["kmer_rank"].count() == v("v_seq").selectExpr("sum(greatest(length(seq) - 7, 0))").first()[0]
    assert got["lower_bound_lookup"].count() == v("v_events").select("read_id", "ref_pos").distinct().count()
