"""counter_conflict_whole over all rows, against its SQL."""

from evidentia import plans
from tests.test_queries import DATA, con, plain, pytestmark  # noqa: F401


def test_whole_table(spark, con):  # noqa: F811
    got = {r[0]: r for r in plans.queries()["counter_conflict_whole"](spark, DATA).collect()}
    rows = con.sql(plans.oracles()["counter_conflict_whole"]).fetchall()
    assert {k: plain(tuple(r)) for k, r in got.items()} == {r[0]: plain(r) for r in rows}
    assert set(got) == {k for (k,) in con.sql("SELECT DISTINCT user_id FROM events").fetchall()}
    assert len({r["conflict"] for r in got.values()}) > 1
