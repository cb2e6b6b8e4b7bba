"""Every registered query against its SQL on the small tables."""

import pytest

from hushlake.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    cols, got = rows(QUERIES[name](spark, sf_dir))
    want_cols, want = sql_rows(con, ORACLES[name])
    assert cols == want_cols
    assert got - want == want - got


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_detect_sessions_adds_moved_values(spark, sf_dir):
    """Frame 1 shows name and address-book mail of frame 0 again, without labels."""
    found = QUERIES["detect_sessions"](spark, sf_dir).filter("frame_id = 1").collect()
    cards = spark.read.parquet(f"{sf_dir}/customer.parquet").collect()
    want = {(c.c_custkey, "NAME", c.c_name) for c in cards} | {(c.c_custkey, "EMAIL", f"c{c.c_custkey}@example.net") for c in cards}
    assert want <= {(f.session_id, f.kind, f.value) for f in found}
    assert {f.source for f in found if (f.session_id, f.kind, f.value) in want} == {"local-vault"}
