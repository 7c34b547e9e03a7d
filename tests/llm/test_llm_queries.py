import pytest

from rankstead.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.count() >= 0
    want = {"p3_found": ["src_table", "first_id", "copy_id"], "p4_found": ["test_id", "train_id"], "p5_found": ["first_id", "row_id"], "p6_found": ["peptide", "mark"], "p7_ids": ["doc_id", "ids"], "p8_found": ["item_id", "doc_id"], "p9_found": ["doc_id"]}
    assert df.columns == want.get(name, df.columns)


def test_every_row_is_assigned_once(spark, data):
    rows = queries.p5_splits(spark, data).collect()
    assert len(rows) == len({r["row_id"] for r in rows}) == spark.read.parquet(f"{data}/atlas_labelled.parquet").count()
