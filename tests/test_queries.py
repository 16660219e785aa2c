"""Every query that has an SQL twin gives its rows, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from compare import oracle_rows, rows_of, spark_rows
from pyspark.sql import functions as F

from tracewell.plans import catalog, views as v

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = spark_rows(catalog.QUERIES[name](spark, SF))
    if name in catalog.ORACLE_SQL:
        assert got == oracle_rows(catalog.ORACLE_SQL[name], SF)
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_symbol_counts(spark, tmp_path):
    """The counts are those of the symbols, whatever is null, and line items are shuffled once, as they are."""
    values = [None, 1, 2]
    rows = [(i % 41 or None, values[i % 3], values[i // 3 % 3], values[i // 9 % 3], [None, 10.0, 30.0][i // 27 % 3], [None, 0.0, 0.07][i // 81 % 3], ["R", "N", None][i % 7 % 3]) for i in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = v.symbol_counts(spark, str(tmp_path))
    level, count = F.col("level"), lambda x, c: F.count_if((level == x) & c)
    t, p = F.col("truth"), F.col("predicted")
    want = v.symbols(spark, str(tmp_path)).groupBy("id").agg(*(count(x, c).alias(f"{n}_{x}") for x in ("file", "entity", "module") for n, c in (("tp", t & p), ("p", p), ("t", t))))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = v.symbol_counts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_answered_requests_long_lines(spark, tmp_path):
    """Two lines are two lines, whatever their length."""
    texts = ["x" * 40_000, "x" * 20_000 + "\n" + "y" * 20_000 + "\nz", "a\n" + "y" * 40_000, "a\nb\n", "a", "\n\n"]
    spark.createDataFrame([(6 * j + i, t, "en", "s") for j in range(2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = con.execute(catalog.ORACLE_SQL["answered_requests"])
    want = rows_of([c[0] for c in out.description], out.fetchall())
    assert spark_rows(catalog.QUERIES["answered_requests"](spark, str(tmp_path))) == want


def test_faulty_log_is_numbered_once(spark):
    """No task of the log's readers holds a sort of its events."""
    plan = catalog.QUERIES["event_codes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ReusedExchange" not in plan
