import duckdb
import pytest

from lodespark.llm import catalog

FOUND = {
    "p1_found": ["row_id_a", "row_id_b"], "p2_found": ["row_id", "defect"], "p3_found": ["row_id", "kind", "char_pos"], "p4_found": ["row_id", "char_pos"], "p5_found": ["row_id"], "p8_found": ["doc_id", "lang_code"],
}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_runs_over_the_small_tables(spark, tiny, name):
    df = catalog.queries()[name](spark, tiny)
    rows = df.collect()
    assert rows or name in ("p4_found",)
    if name in FOUND:
        assert df.columns == FOUND[name]
        assert len(set(rows)) == len(rows)


def test_oversized_rows_against_sql(spark, tiny):
    con = duckdb.connect()
    con.execute(f"create view chunks as select * from '{tiny}/chunks.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["p5_found"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()["p5_found"](spark, tiny).collect()) == want
