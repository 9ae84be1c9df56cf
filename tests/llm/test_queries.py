import itertools

import pytest

import corpus_pipeline
from lodestrata.llm import lang_cnn, queries

from .. import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, oracle.SF)
    columns, expected = oracle.sql_rows(queries.ORACLES[name])
    assert sorted(df.columns) == columns
    assert oracle.rows(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_covers_the_table(spark, name):
    table = "pages" if name.startswith("op6") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = {r[0] for r in spark.read.parquet(f"{oracle.SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in queries.QUERIES[name](spark, oracle.SF).select(key).collect()} == ids


def test_pipeline(spark):
    """Each stage against a plain version on its own input; then the whole."""
    from .test_operators import brute_groups, brute_hits, check_pieces

    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.Scratch(spark, "t").keep(stage(spark, docs, oracle.SF))
        if name == "language":
            found = lang_cnn.identify(docs, lang_cnn.fit(docs, held_out=None)).collect()
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5}
            assert all(r.lang_pred == "und" for r in found if not any(c.isalpha() for c in before[r.doc_id] or ""))
        elif name == "lines":
            assert {r.doc_id for r in out.collect()} == set(before)
            seen = [x.strip().lower() for r in out.collect() for x in set(r.text.split("\n"))]
            long = [x for x in seen if len(x) >= 12 and x.isascii()]
            assert len(long) == len(set(long))
        elif name == "near_duplicates":
            assert {r.doc_id for r in out.collect()} == {i for i, _, c in brute_groups(list(before.items()), 5, 80) if i == c}
        elif name == "decontaminate":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in brute_hits(list(before.items()), items) if not r[5]}
        else:
            check_pieces(out.collect(), list(before.items()), corpus_pipeline.vector_packing.Limits())
        if name != "pack":
            assert out.columns == docs.columns
            assert all(len(r.text) == r.n_chars for r in out.collect())
        docs = out
    whole = corpus_pipeline.run(spark, oracle.SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, docs.collect()))


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, oracle.SF)
    assert docs.count() == 0


def test_names():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert numbers == list(range(1, 11))
    assert all(len(set(a)) == 2 for a in itertools.pairwise(numbers))
