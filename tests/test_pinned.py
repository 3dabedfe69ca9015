"""Every pinned case: the operator's result is the expected value, and the SQL gives the same rows."""

import duckdb
import pinned
import pinned_names
import pytest

CASES = {**pinned.CASES, **pinned_names.CASES}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    case = CASES[name]
    rows = {r["case_id"]: r for r in case.query(spark, "").coalesce(1).collect()}
    for i, row in enumerate(case.rows):
        got = rows[i]["result"]
        assert got == pytest.approx(row[-1]) if isinstance(row[-1], float) else got == row[-1], row
    sql = sorted(duckdb.connect().execute(case.sql()).fetchall(), key=lambda r: r[0])
    assert [r[:-1] for r in sql] == [tuple(rows[i])[:-1] for i in range(len(sql))]
    assert [r[-1] for r in sql] == [r[-1] for r in case.rows]
