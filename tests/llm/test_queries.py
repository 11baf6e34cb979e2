"""Contract queries: those that SQL can express against it, and the columns of all."""

import pytest

from genoloom.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    1: {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    2: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    3: {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    4: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    5: {"doc_id": "bigint", "log_likelihood": "double"},
    6: {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    7: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    8: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    9: {"doc_id": "bigint", "probability": "double", "sampled": "boolean"},
    10: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(want)


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_columns(spark, number):
    (name,) = [q for q in queries.queries() if q.startswith(f"op{number}_")]
    df = queries.queries()[name](spark, DATA)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[number]} == COLUMNS[number]
    table = "embeddings" if number == 2 else "documents"
    if number != 2:
        assert df.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
