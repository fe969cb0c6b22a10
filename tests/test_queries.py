"""All registered queries outside the training-data subpackage against their SQL, at the smallest scale."""

import duckdb
import pytest

from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def shown(rows):
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted("|".join(map(show, r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert shown([[r[c] for c in columns] for r in df.collect()]) == shown([[r[i] for i in at] for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_rows_only(spark, name):
    """Queries without SQL: every column of every row is made. Their values are tested by brute force beside their operators."""
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    assert all(any(r[c] is not None for r in rows) for c in df.columns)


def test_page_quality_many_blank_lines(spark, tmp_path):
    """A document with more than a thousand blank lines keeps all of its failed pages."""
    from pyspark.sql import functions as F

    text = "first\n" + "\n" * 1500 + "last line\n \n"
    spark.createDataFrame([(1, text, "s"), (2, "a\n\nb", "s"), (3, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["page_quality"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = c.sql(SQL["page_quality"])
    assert shown([[r[x] for x in rel.columns] for r in got.collect()]) == shown(rel.fetchall())
    assert got.filter("doc_id = 1").select(F.size(F.split("failed_pages", ","))).first()[0] == 1500
