"""The driver contract: entry, queries and oracle SQL."""

import duckdb

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "RuleScore" in df.columns


def test_every_oracle_has_a_query_and_runs_in_duckdb():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 70
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, text in sql.items():
        con.execute(f"DESCRIBE {text}")  # binds and plans every oracle query


def test_query_and_oracle_columns_agree(spark):
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name in ["top_risky_rule", "job_stats", "ops_gate", "alt_score", "latency_histogram", "officer_kpis"]:
        spark_cols = sorted(qs[name](spark, "/root/testdata/sf0.001").columns)
        duck_cols = sorted(r[0] for r in con.execute(f"DESCRIBE {sql[name]}").fetchall())
        assert spark_cols == duck_cols, name
