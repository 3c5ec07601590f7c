"""Hand-made bars and dates with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import market as m

BAR = "code long, trade_date date, open double, high double, low double, close double, pre_close double, volume double, amount double"


def bar(day, o=10.0, h=10.5, low=9.8, c=10.2, pre=10.0, v=1e6, a=1.02e7, code=1):
    return (code, dt.date.fromisoformat(day), o, h, low, c, pre, v, a)


def test_weekly_bars(spark):
    rows = [bar("2026-05-04", c=10.4, v=1_000_000.0, a=10_000_000.0), bar("2026-05-05", o=10.4, h=10.8, low=10.1, c=10.6, pre=10.2, v=1_100_000.0, a=11_000_000.0), bar("2026-05-11", o=10.4, c=10.5, pre=10.0)]
    out = m.resample(spark.createDataFrame(rows, BAR), "week").orderBy("trade_date").collect()
    first, second = out
    assert (first.trade_date, first.open, first.high, first.low, first.close, first.volume, first.amount, first.pct_chg) == (dt.date(2026, 5, 4), 10.0, 10.8, 9.8, 10.6, 2_100_000.0, 21_000_000.0, 6.0)
    assert (second.open, second.close, second.pct_chg) == (10.4, 10.5, 5.0)


def test_months_and_nulls(spark):
    rows = [bar("2026-05-04", low=None), bar("2026-05-12", low=9.9), bar("2026-06-01", o=0.0, pre=None)]
    out = m.resample(spark.createDataFrame(rows, BAR), "month").orderBy("trade_date").collect()
    assert [r.low for r in out] == [9.9, 9.8]  # a null low isn't a price of 0
    assert out[1].pct_chg == 0.0


def test_factors(spark):
    bars = spark.createDataFrame([bar("2026-05-11"), bar("2026-05-12"), bar("2026-05-13")], BAR)
    factors = spark.createDataFrame([(1, dt.date(2026, 5, 11), 1.0), (1, dt.date(2026, 5, 12), 1.5)], "code long, trade_date date, factor double")
    out = m.forward_adjust(bars, factors).orderBy("trade_date").collect()
    assert out[0].close == 15.3 and out[1].close == 10.2 and out[2].close == 10.2 and out[0].volume == 1e6


def test_first_bar_has_no_change(spark):
    out = m.with_pre_close(spark.createDataFrame([bar("2026-05-11", c=10.0), bar("2026-05-12", c=11.0)], BAR).drop("pre_close")).orderBy("trade_date").collect()
    assert (out[0].pre_close, out[0].change, out[0].pct_chg) == (None, None, None) and round(out[1].pct_chg, 6) == 10.0


@pytest.mark.parametrize(("later", "earlier", "lag"), [("2026-07-20", "2026-07-17", 1), ("2026-07-19", "2026-07-17", 0), ("2026-07-17", "2026-07-17", 0), ("2026-07-16", "2026-07-17", 0), ("2026-07-31", "2026-07-17", 10)])
def test_weekday_lag(spark, later, earlier, lag):
    assert spark.range(1).select(m.weekday_lag(F.lit(later).cast("date"), F.lit(earlier).cast("date")).alias("x")).first().x == lag


def test_unknown_sort_key(spark):
    with pytest.raises(ValueError):
        m.concept_ranking(spark.createDataFrame([], "concept string, trade_date date, ups long, pct double"), 5, 10, "turnover")


def test_bonus_counts_beside_a_change(spark):
    heat = spark.createDataFrame([("a", dt.date(2026, 5, 4), 10, 2.0), ("a", dt.date(2026, 5, 5), 5, 1.0)], "concept string, trade_date date, ups long, pct double")
    row = m.concept_ranking(heat, 5, 10).first()
    assert row.score == (1.0 + 10) + (2.0 + 20) / 2 and row.pct == 1.0 and row.ups == 5


def test_as_of_keeps_every_key(spark):
    facts = spark.createDataFrame([(1, dt.date(2026, 1, 5), 3.0), (1, dt.date(2026, 1, 9), None)], "code long, as_of date, pe double")
    keys = spark.createDataFrame([(1, dt.date(2026, 1, d)) for d in (4, 5, 10)] + [(2, dt.date(2026, 1, 5))], "code long, trade_date date")
    got = sorted((r.code, r.trade_date.day, r.pe) for r in m.as_of(facts, keys, "code", "as_of", "trade_date", ["pe"]).collect())
    assert got == [(1, 4, None), (1, 5, 3.0), (1, 10, 3.0), (2, 5, None)]
