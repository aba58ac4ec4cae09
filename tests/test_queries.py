import pytest

import __spark_entry__ as entry_points
from sentrymill.plans import catalog

from .compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_event_query_has_sql():
    assert set(catalog.queries()) <= set(SQL) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = compare(spark, con, name, entry_points.queries()[name], SQL[name], SF)
    assert got == want


def test_stored_columns_are_filtered_in_the_scan(spark):
    from sentrymill.sources.tables import bind_events

    for option, pushed in (({"event_id": "424"}, "EqualTo(event_id,424)"), ({"source": "user-7"}, "EqualTo(user_id,7)")):
        plan = bind_events(spark, SF, **option)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan
    for option in ({"event_id": "0424"}, {"event_id": "x"}, {"source": "host-7"}, {"source": "user-07"}):
        assert bind_events(spark, SF, **option).count() == 0
