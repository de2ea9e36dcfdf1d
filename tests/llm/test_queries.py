"""Registered queries against DuckDB on the smallest test data; the others run and have the columns of their contracts."""

import pytest
from check import canon, connect

from courtside.llm import queries
SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op2": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op3": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4": ["page_id", "host", "path", "rule", "verdict"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8": ["doc_id", "fingerprint", "component_id"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["lang", "source", "part", "item", "value", "rank"],
    "op12": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cur = connect(SF).execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), columns)


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in queries.ORACLES and n[:4] != "op1_"))
def test_contract_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert [c for c in COLUMNS[name.split("_")[0]] if c not in df.columns] == []
    if name.startswith("op13"):  # 25 of the 500 rows are queries
        assert df.count() == 20 * 25
        return
    table = "pages" if name.startswith("op4") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
