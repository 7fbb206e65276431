"""A cross-section of registered queries against their SQL at the smallest scale."""
import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["W03_rolling_sum_24", "W17_drawdown", "W25_lagged_liquidity_stratum", "J06_asof_calendar_offset", "J09_forward_tolerance", "J11_range_anti_join", "A01_resample_ohlcv",
         "A22_auc_average_precision", "K09_window_sample", "X16_gated_heuristic_signal", "M09_extremes_label", "M15_multiscale_vote", "M17_gold_signal_latest", "M20_hybrid_purged_splits",
         "P02_signed_target_weights", "P12_rebalance_series", "G05_robust_rho", "L01_fill_netting", "L02_cost_basis", "Q01_candle_validation", "S15_upsert_by_key", "T09_density_clusters",
         "R02_streaming_candles", "R08_drawdown_alert"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_lookback_grid_takes_all_dates(spark):
    assert min(r["n"] for r in entry.queries()["P22_tsmom_lookback_grid"](spark, SF).collect()) > 40  # more than the sampled window starts
