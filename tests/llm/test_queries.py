"""Registered queries that SQL can express, next to their SQL in DuckDB on the smallest tables and on odd rows."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(40))


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=repr)


def compare(spark, name, folder):
    got = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cur = con.execute(ORACLES[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, FOLDER)


def test_items_without_id_hit_words(spark, tmp_path):
    """Windows of items with a null id mark words; only their id is missing from the list."""
    texts = ["a " + LONG + " b", LONG[: len(LONG) // 2], "clean text", None, "", "Short item here", "x short item here, y"]
    docs = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * 7, "source": ["s"] * 7, "n_chars": [1] * 7}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    bench = {"item_id": pa.array([None, 7, 8, None, 9], pa.int64()), "text": [LONG, "word0 word1 word2 word3 word4 word5 word6 word7 word8 word9 word10", "short item here", "short item", None]}
    pq.write_table(pa.table(bench), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"page_id": [1], "url": ["u"], "html": ["h"]}), tmp_path / "pages.parquet")
    compare(spark, "op5_decontaminate", str(tmp_path))
    found = {r["doc_id"]: r for r in QUERIES["op5_decontaminate"](spark, str(tmp_path)).collect()}
    assert found[0]["n_hit"] == 40 and found[0]["n_items"] == 1 and found[6]["n_items"] == 1 and not found[2]["contaminated"]
