"""The registered queries on the smallest tables: against SQL where there is some, else by shape."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tessellum.llm import queries

DATA = Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op3": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    wanted = COLUMNS.get(name.split("_")[0], {})
    assert {k: dict(df.dtypes)[k] for k in wanted} == wanted
    rows = df.collect()
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name.split("_")[0] in ("op1", "op5", "op6", "op7", "op8", "op9", "op10"):
        assert len(rows) == documents
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in DATA.glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        made = con.sql(queries.ORACLES[name])
        assert sorted(made.columns) == sorted(df.columns)
        assert sorted(made.fetchall()) == sorted(tuple(r[c] for c in made.columns) for r in rows)
