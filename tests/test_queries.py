"""A few registered queries against their SQL; ``check_queries.py`` runs them all."""

from pathlib import Path

import duckdb
import pytest

from check_queries import rows_of
from veilspark.queries import oracle_sql, queries

FOLDER = Path("/root/testdata/sf0.001")

NAMES = [
    "detect_payment_card", "gate_order", "document_chunks", "session_log_records", "account_export_records",
    "embedded_records", "table_shapes", "collapse_repeats", "also_at", "masked_snippets", "latest_with_state",
    "remote_assets", "stream_scan",
]


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = queries()[name](spark, str(FOLDER))
    cursor = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
