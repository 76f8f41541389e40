import pytest
import sqlcheck

from scriptorium.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_as_sql(spark, name):
    assert sqlcheck.rows(QUERIES[name](spark, sqlcheck.DATA)) == sqlcheck.sql_rows(sqlcheck.database(), SQL[name])


def one_to_one(rows, d):
    return len({r.book_id for r in rows}) == len({r.wish_id for r in rows}) == len(rows)


#: What the rows of a query without SQL must hold; d counts the rows of a table.
HOLDS = {
    "archive_names": lambda rows, d: len({r.file_name for r in rows}) == len(rows) == d("books"),
    "book_headers": lambda rows, d: len(rows) == d("documents") and all(r.title for r in rows),
    "greedy_links": one_to_one,
    "lookup_rank": lambda rows, d: len({r.id for r in rows}) == len(rows),
    "metadata_patch": lambda rows, d: all((r.publisher, r.series) == ("新社", "丛书") for r in rows),
    "metadata_score": lambda rows, d: all(r.score is not None for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    rows = QUERIES[name](spark, sqlcheck.DATA).collect()
    count = lambda t: spark.read.parquet(f"{sqlcheck.DATA}/{t}.parquet").count()
    assert rows and HOLDS[name](rows, count)


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
