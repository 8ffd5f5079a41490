"""The queries of the subpackage that SQL expresses against their SQL, on the smallest tables."""

import duckdb
import pytest

from foliant.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_scratch_keeps_what_it_is_told_to(spark):
    from foliant.llm.common import materialize, scratch

    with scratch(spark) as keep:
        gone = materialize(spark.range(3))
        kept = keep(materialize(gone.selectExpr("id + 1 AS id")))
    assert sorted(r[0] for r in kept.collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)exist"):
        gone.collect()
