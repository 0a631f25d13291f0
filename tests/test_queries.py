"""Every query with an oracle against DuckDB, every other one by its rows, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillframe.plans import catalog

SF = "/root/testdata/sf0.001"
#: Grouped decoders that take long: run on small tables below, and tested on small texts of their own.
SLOW = {"hmm_viterbi", "word_lookup_map", "simul_map", "bnb_map"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got
    sql = catalog.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(_plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query(spark, tmp_path_factory, name):
    folder = str(tmp_path_factory.mktemp("small"))
    spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 40 and 400").orderBy("doc_id").limit(4).write.parquet(f"{folder}/documents.parquet")
    for other in ("conversations", "benchmark"):
        spark.read.parquet(f"{SF}/{other}.parquet").limit(40).write.parquet(f"{folder}/{other}.parquet")
    df = catalog.queries()[name](spark, folder)
    assert df.columns and df.collect()
