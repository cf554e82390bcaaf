"""Queries over the smallest test tables against their SQL in DuckDB; those that take long are left to the driver."""

import math
import os

import duckdb
import pytest

from maskloom.plans import queries

DATA = "/root/testdata/sf0.001"
QUICK = [
    "normalize_text", "email_attrs", "phone_spans", "account_spans", "card_scheme_counts", "ssn_ein_spans", "bic_spans", "aba_spans", "generic_id_spans", "iban_valid", "generic_dates", "dob_spans", "bank_spans",
    "address_lines", "address_blocks", "guard_filter", "name_spans", "document_names", "name_scores", "merge_spans", "entity_tokens", "match_case", "shaped", "residual_scan", "metrics_summary", "metrics_confusion",
]


def shown(value):
    return "" if value is None else f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("customer", "documents", "orders", "part", "supplier"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, DATA)
    found = sql.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(shown(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == want and want
