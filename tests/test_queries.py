"""Registered queries against their SQL twins.

Every query runs by default; BARLOOM_SPREAD=1 runs a spread over all strategies.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point
from barloom.plans import catalog
from compare import database, differences

SF = os.environ.get("BARLOOM_SF_DIR", "/root/testdata/sf0.001")
SPREAD = ["bars_path", "rejected_rows", "kalman_level", "csv_round_trip", "hurst", "split_slice", "positions", "param_sweep", "quarter_summary", "attach_log", "policy_trades", "first_touch", "json_field"]
NAMES = SPREAD if os.environ.get("BARLOOM_SPREAD") else list(catalog.queries())


def test_every_query_has_a_twin():
    from barloom.plans import oracle

    assert set(catalog.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    want = database(SF).sql(entry_point.oracle_sql()[name]).df()
    got = entry_point.queries()[name](spark, SF).toPandas()
    assert not differences(got, want)


def test_signal_queries_are_not_vacuous():
    """The default data opens and closes trades on both sides."""
    con = database("/root/testdata/sf0.01")
    sql = entry_point.oracle_sql()
    sides, trades = con.sql(f"SELECT count(DISTINCT side), count(*) FROM ({sql['lead_lag_ledger']})").fetchall()[0]
    assert sides == 2 and trades >= 8
    assert con.sql(f"SELECT count(DISTINCT trade_type) FROM ({sql['trade_type_counts']})").fetchall()[0][0] == 7
    assert con.sql(f"SELECT count(*) FROM ({sql['gates']}) WHERE vol_exit").fetchall()[0][0] > 0
    assert con.sql(f"SELECT count(DISTINCT touch) FROM ({sql['first_touch']})").fetchall()[0][0] == 3


def test_no_predicate_sits_on_its_threshold():
    """Positions are compared exactly, so no gate input may lie within 1e-9 of its threshold."""
    con = database("/root/testdata/sf0.01")
    from barloom.plans import oracle

    near = ["leader_atr - 0.012 * leader_open", "correlation", "follower_hurst - 0.45", "leader_rsi - 55", "leader_rsi - 45", "leader_atr - 0.018 * leader_open",
            "leader_close - leader_bollinger_middle", "leader_close - leader_bollinger_lower", "leader_s_hi - 1.5 * leader_sigma"]
    test = " OR ".join(f"abs({e}) < 1e-9" for e in near)
    assert con.sql(oracle.q(oracle.PAIR_INDICATORS, select=f"SELECT count(*) FROM p13 WHERE {test}")).fetchall()[0][0] == 0


def test_every_digit_of_the_state_occurs():
    """Flat, long and short positions are met by the policy whose state holds them."""
    con = database("/root/testdata/sf0.01")
    sql = entry_point.oracle_sql()["policy_held"]
    assert con.sql(f"SELECT count(DISTINCT state_index // 20 % 3), count(DISTINCT held) FROM ({sql})").fetchall()[0] == (3, 3)
