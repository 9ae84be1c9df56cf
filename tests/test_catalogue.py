import pytest
import zstandard

import __spark_entry__ as entry
from lodestrata.plans import catalogue

from . import oracle


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    df = catalogue.QUERIES[name](spark, oracle.SF)
    columns, expected = oracle.sql_rows(catalogue.ORACLES[name])
    assert sorted(df.columns) == columns
    assert oracle.rows(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, oracle.SF).count() > 0


def test_compress_ratio_equals_brute_force(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    got = {r.doc_id: r.ratio for r in catalogue.QUERIES["compress_ratio"](spark, oracle.SF).collect()}
    packed = {i: 4 + len(zstandard.ZstdCompressor(level=3).compress(t)) for i, t in docs.items()}
    assert got == pytest.approx({i: packed[i] / len(t) if t else 0.0 for i, t in docs.items()}, abs=1e-4)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
