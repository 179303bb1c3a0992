"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from ledgerloom.operators import audit
from ledgerloom.plans import adapters, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in adapters.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).columns


def test_greedy_draw(spark):
    """Requests in order against a plain loop."""
    t = lambda r: adapters.relation(spark, DATA, r).collect()
    fit = {(r.scope_id, r.work_id): r.admissible for r in registry.queries()["grant_admissible"](spark, DATA).collect()}
    reserve = {r.scope_id: r.reserved_budget_units for r in t("scopes")}
    drawn = {}
    for w in t("work"):
        drawn[w.scope_id] = drawn.get(w.scope_id, 0) + (w.granted_units or 0)
    want = {}
    for q in sorted(t("requests"), key=lambda r: r.key):
        if fit[q.scope_id, q.work_id]:
            ok = drawn[q.scope_id] + q.units <= reserve[q.scope_id]
            drawn[q.scope_id] += q.units if ok else 0
            want[q.scope_id, q.work_id] = ok
    assert {(r.scope_id, r.work_id): r.admitted for r in registry.queries()["grant_in_order"](spark, DATA).collect()} == want


def test_bounded_text(spark):
    for r in registry.queries()["bounded_text"](spark, DATA).collect():
        assert len(r.text.encode()) <= 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_every_check_is_broken(spark):
    """The planted faults break each of the 40 row checks."""
    found = {r.check_id for r in registry.queries()["audit_every_check"](spark, DATA).select("check_id").distinct().collect()}
    every = audit.checks(*(adapters.relation(spark, DATA, r) for r in ("scopes", "log", "work", "deps")))
    assert every.columns == ["check_id", "key"] and len(found) == 40, sorted(found)
