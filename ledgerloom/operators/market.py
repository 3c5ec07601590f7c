"""Market series: resampling, breadth, concept heat, indicators and scores, for all instruments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_date():
    return Window.partitionBy("code").orderBy("trade_date")


def rows_back(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def with_pre_close(bars: DataFrame) -> DataFrame:
    """Previous close, change and percent change of each bar; null on an instrument's first bar."""
    pre = F.lag("close").over(by_date())
    return bars.withColumn("pre_close", pre).withColumn("change", F.round(F.col("close") - pre, 3)).withColumn("pct_chg", F.when(pre != 0, (F.col("close") - pre) / pre * 100))


def resample(bars: DataFrame, freq: str) -> DataFrame:
    """Bars of ISO weeks ('week') or months ('month').

    Nulls don't count as prices; pct_chg is against the period's first pre_close, or its first open where that is
    null, and 0 where neither is usable.
    """
    period = F.date_trunc(freq, F.col("trade_date")).cast("date")
    out = bars.groupBy("code", period.alias("period")).agg(
        F.min("trade_date").alias("trade_date"),
        F.min_by("open", "trade_date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").alias("volume"),
        F.round(F.sum("amount"), 2).alias("amount"),
        F.min_by("pre_close", "trade_date").alias("base"),
    )
    base = F.coalesce(F.when(F.col("base") > 0, F.col("base")), F.col("open"))
    return out.withColumn("pct_chg", F.when(base > 0, F.round((F.col("close") - base) / base * 100, 2)).otherwise(F.lit(0.0))).drop("base")


def sma(value: str, n: int) -> Column:
    """Simple moving average over the last n rows, null until there are n."""
    return F.when(F.count(value).over(rows_back(n)) == n, F.avg(value).over(rows_back(n)))


def moving_averages(bars: DataFrame, spans: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    return bars.select("code", "trade_date", "close", *[sma("close", n).alias(f"ma{n}") for n in spans])


def alignment(ma5: Column, ma10: Column, ma20: Column) -> Column:
    """bull, bear, tangled, or insufficient where an average is missing."""
    missing = ma5.isNull() | ma10.isNull() | ma20.isNull()
    return F.when(missing, "insufficient").when((ma5 > ma10) & (ma10 > ma20), "bull").when((ma5 < ma10) & (ma10 < ma20), "bear").otherwise("tangled")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean and bands of ``width`` population deviations over n rows; null until there are n."""
    full = F.count("close").over(rows_back(n)) == n
    mid, dev = F.avg("close").over(rows_back(n)), F.stddev_pop("close").over(rows_back(n))
    return bars.select("code", "trade_date", *[F.round(F.when(full, x), 3).alias(k) for k, x in (("boll_mid", mid), ("boll_up", mid + width * dev), ("boll_low", mid - width * dev))])


def rsi_window(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI over the last period + 1 changes, each side divided by period; 100 without losses, null before."""
    change = F.col("close") - F.lag("close").over(by_date())
    moves = bars.withColumn("change", change)
    over = rows_back(period + 1)
    gain = F.sum(F.when(F.col("change") > 0, F.col("change")).otherwise(0.0)).over(over) / period
    loss = F.sum(F.when(F.col("change") < 0, -F.col("change")).otherwise(0.0)).over(over) / period
    enough = F.count("change").over(over) == period + 1
    return moves.select("code", "trade_date", F.round(F.when(enough, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))), 3).alias("rsi"))


def ema_series(values: Column, span: int) -> Column:
    """Exponential moving averages of an ordered array, seeded with its first value."""
    alpha = 2.0 / (span + 1)
    grow = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.element_at(acc, -1) * (1 - alpha) + x * alpha)))
    return F.aggregate(values, F.array().cast("array<double>"), grow)


def seeded_ema(bars: DataFrame, span: int) -> DataFrame:
    """(code, ema): the average at the last bar, seeded with the mean of the first ``span`` closes; none for fewer bars.

    The fold is a sum: a close k bars before the last weighs alpha (1 - alpha)^k, and the seed (1 - alpha)^bars, so a
    history of any length is one pass of aggregation (weights too small for a double vanish).
    """
    alpha = 2.0 / (span + 1)
    ranked = bars.withColumn("rn", F.row_number().over(by_date()))
    size = ranked.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rn") <= span, F.col("close"))).alias("seed")).filter(F.col("n") >= span)
    later = ranked.filter(F.col("rn") > span).join(size, "code").groupBy("code").agg(F.sum(F.col("close") * alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("rn"))).alias("moved"))
    out = size.join(later, "code", "left")
    return out.select("code", (F.col("seed") * F.pow(F.lit(1 - alpha), F.col("n") - span) + F.coalesce("moved", F.lit(0.0))).alias("ema"))


def macd(bars: DataFrame, bars_back: int = 250) -> DataFrame:
    """DIF, DEA and histogram (12, 26, 9) at each instrument's last bar, over its last ``bars_back`` bars.

    One instrument's history of ``bars_back`` prices is one array, so a fold stays in one row of bounded size.
    """
    recent = bars.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date")))).filter(F.col("rn") <= bars_back)
    series = recent.groupBy("code").agg(F.max("trade_date").alias("trade_date"), F.array_sort(F.collect_list(F.struct("trade_date", "close"))).alias("s"))
    series = series.select("code", "trade_date", F.transform("s", lambda x: x["close"]).alias("closes"))
    dif = series.select("code", "trade_date", F.zip_with(ema_series(F.col("closes"), 12), ema_series(F.col("closes"), 26), lambda a, b: a - b).alias("difs"))
    last = dif.select("code", "trade_date", F.element_at("difs", -1).alias("dif"), F.element_at(ema_series(F.col("difs"), 9), -1).alias("dea"))
    return last.select("code", "trade_date", F.round("dif", 3).alias("dif"), F.round("dea", 3).alias("dea"), F.round((F.col("dif") - F.col("dea")) * 2, 3).alias("macd"))


def rsi_smoothed(bars: DataFrame, period: int = 14, bars_back: int = 250) -> DataFrame:
    """RSI at the last bar with gains and losses smoothed as exponential averages of span ``period``."""
    moves = bars.withColumn("change", F.col("close") - F.lag("close").over(by_date())).filter("change is not null")
    recent = moves.withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date")))).filter(F.col("rn") <= bars_back)
    series = recent.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("trade_date", "change"))).alias("s"))
    gains = F.transform("s", lambda x: F.greatest(x["change"], F.lit(0.0)))
    losses = F.transform("s", lambda x: F.greatest(-x["change"], F.lit(0.0)))
    out = series.select("code", F.element_at(ema_series(gains, period), -1).alias("g"), F.element_at(ema_series(losses, period), -1).alias("l"))
    return out.select("code", F.round(F.when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("g") / F.col("l"))), 3).alias("rsi"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, without a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def breadth(bars: DataFrame, limit: float = 9.9) -> DataFrame:
    """Counts of advances, declines, limit-ups and limit-downs on the latest day, with pct_chg given."""
    day = bars.join(F.broadcast(bars.agg(F.max("trade_date").alias("last_day"))), F.col("trade_date") == F.col("last_day"))
    out = day.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("pct_chg") > 0).alias("advance"),
        F.count_if(F.col("pct_chg") < 0).alias("decline"),
        F.count_if(F.col("pct_chg") == 0).alias("unchanged"),
        F.count_if(F.col("pct_chg") >= limit).alias("limit_up"),
        F.count_if(F.col("pct_chg") <= -limit).alias("limit_down"),
    )
    return out.withColumn("breadth_pct", F.round(F.col("advance") / F.col("total") * 100, 2))


def concept_ranking(heat: DataFrame, days: int, top: int, sort_by: str = "score") -> DataFrame:
    """Concepts by heat over the last ``days`` dates: (pct + bonus) with weight 1/2 for each date back."""
    if sort_by not in ("score", "pct", "ups"):
        raise ValueError(f"unknown sort key {sort_by!r}")
    dates = heat.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(days)
    ranked = dates.select("trade_date", (F.row_number().over(Window.orderBy(F.desc("trade_date"))) - 1).alias("idx"))
    recent = heat.join(F.broadcast(ranked), "trade_date")
    bonus = F.when(F.col("ups") >= 10, 20.0).when(F.col("ups") >= 5, 10.0).otherwise(0.0)
    out = recent.groupBy("concept").agg(
        F.round(F.sum((F.col("pct") + bonus) * F.pow(F.lit(2.0), -F.col("idx"))), 4).alias("score"), F.max_by("pct", "trade_date").alias("pct"), F.max_by("ups", "trade_date").alias("ups"), F.count(F.lit(1)).alias("days")
    )
    return out.orderBy(F.desc(sort_by), "concept").limit(top)


def as_of(facts: DataFrame, keys: DataFrame, key: str, fact_time: str, key_time: str, values: list[str]) -> DataFrame:
    """``keys`` with the last fact at or before each row's time: one shuffle of the union, then a running last."""
    left = keys.select(key, F.col(key_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*keys.columns).alias("_row"), *[F.lit(None).cast(facts.schema[v].dataType).alias(v) for v in values])
    right = facts.select(key, F.col(fact_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *values)
    order = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).select("_side", "_row", *[F.last(v, ignorenulls=True).over(order).alias(v) for v in values])
    return both.filter("_side = 1").select("_row.*", *values)


def forward_adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times latest factor / factor of the day, rounded to 2; rows without a usable factor stay as they are."""
    newest = factors.groupBy("code").agg(F.max_by("factor", "trade_date").alias("newest"))
    joined = bars.join(factors, ["code", "trade_date"], "left").join(newest, "code", "left")
    ratio = F.when((F.col("factor") > 0) & (F.col("newest") > 0), F.col("newest") / F.col("factor"))
    prices = [F.when(ratio.isNotNull(), F.round(F.col(c) * ratio, 2)).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "pre_close")]
    return joined.select("code", "trade_date", *prices, "volume", "amount")


def tracking(bars: DataFrame) -> DataFrame:
    """5-day return, 5/20-day volume ratio and MA5 against MA20 of each instrument's latest bar, with labels."""
    back5 = F.lag("close", 5).over(by_date())
    marked = bars.select(
        "code", "trade_date",
        F.when(back5 > 0, (F.col("close") - back5) / back5 * 100).alias("ret5"),
        (sma("volume", 5) / sma("volume", 20)).alias("vol_ratio"),
        ((sma("close", 5) - sma("close", 20)) / sma("close", 20) * 100).alias("ma_gap"),
    )
    last = latest(marked, "code", "trade_date")
    trend = F.when(F.col("ma_gap").isNull(), "unknown").when(F.col("ma_gap") > 2, "above").when(F.col("ma_gap") < -2, "below").otherwise("near")
    return last.select("code", "trade_date", *[F.round(c, 3).alias(c) for c in ("ret5", "vol_ratio", "ma_gap")], trend.alias("trend"))


def stock_scores(bars: DataFrame, heat_by_code: DataFrame, facts: DataFrame, least_bars: int = 5) -> DataFrame:
    """Score of each instrument at its latest bar, at most 100: momentum 25, trend 30, capital 25, concept 15, valuation 5."""
    back = F.lag("close", 5).over(by_date())
    n = F.row_number().over(by_date())
    marked = bars.select("code", "trade_date", "close", n.alias("bars"), ((F.col("close") - back) / back * 100).alias("ret5"), sma("close", 5).alias("ma5"), sma("close", 10).alias("ma10"), sma("close", 20).alias("ma20"), (F.col("volume") / F.avg("volume").over(rows_back(20))).alias("vol_ratio"))
    last = latest(marked, "code", "trade_date").filter(F.col("bars") >= least_bars)
    known = as_of(facts, last, "code", "as_of", "trade_date", ["pe"]).join(heat_by_code, "code", "left")
    momentum = F.greatest(F.lit(0.0), F.least(F.lit(25.0), F.coalesce("ret5", F.lit(0.0)) * 1.25 + 12.5))
    state = alignment(F.col("ma5"), F.col("ma10"), F.col("ma20"))
    trend = F.when(state == "bull", 30.0).when(state == "tangled", 15.0).otherwise(0.0)
    capital = F.greatest(F.lit(0.0), F.least(F.lit(25.0), F.col("vol_ratio") * 10))
    concept = F.least(F.lit(15.0), F.coalesce("heat", F.lit(0.0)))
    valuation = F.when((F.col("pe") > 0) & (F.col("pe") <= 5), 5.0).when(F.col("pe") <= 8, 3.0).otherwise(0.0)
    parts = known.select("code", "trade_date", F.round(momentum, 3).alias("momentum"), trend.alias("trend"), F.round(capital, 3).alias("capital"), F.round(concept, 3).alias("concept"), valuation.alias("valuation"))
    return parts.withColumn("score", F.round(F.col("momentum") + F.col("trend") + F.col("capital") + F.col("concept") + F.col("valuation"), 2))


def weekday_lag(later: Column, earlier: Column) -> Column:
    """Weekdays after ``earlier`` up to ``later``, weekends skipped; 0 where ``later`` isn't later.  Closed form."""

    def weekdays_before(d: Column) -> Column:  # weekdays from Monday 1970-01-05 to d, d excluded
        days = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))

    return F.greatest(F.lit(0), (weekdays_before(F.date_add(later, 1)) - weekdays_before(F.date_add(earlier, 1))).cast("int"))


def last_expected_date(today: Column) -> Column:
    """Yesterday, rolled back over a weekend."""
    back = F.when(F.weekday(today) == 0, 3).when(F.weekday(today) == 6, 2).otherwise(1)
    return F.date_sub(today, back)


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Failures in a row up to each run of a task; any other status starts again at 0."""
    order = Window.partitionBy("task").orderBy("started_at", "run_id")
    island = F.sum(F.when(F.col("status") != "failed", 1).otherwise(0)).over(order)
    marked = runs.withColumn("island", island)
    inside = Window.partitionBy("task", "island").orderBy("started_at", "run_id")
    return marked.select("run_id", "task", "status", F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).over(inside).alias("streak"))
