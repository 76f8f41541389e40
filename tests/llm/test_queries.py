import pytest
import sqlcheck

from scriptorium.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_as_sql(spark, name):
    assert sqlcheck.rows(QUERIES[name](spark, sqlcheck.DATA)) == sqlcheck.sql_rows(sqlcheck.database(), SQL[name])


COLUMNS = {"p1_found": "name_a name_b", "p4_found": "wish_id book_id", "p5_found": "group_book_id field book_id", "p6_found": "table_name record_id field", "p7_found": "field book_id section_idx line_no", "p8_ids": "doc_id ids", "p10_found": "doc_id kind found_text"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, sqlcheck.DATA)
    assert df.columns == COLUMNS[name].split()
    rows = [repr(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
