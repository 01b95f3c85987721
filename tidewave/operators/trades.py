"""Statistics of trades. A trade table has strategy, pair, open_time and close_time (epoch seconds), seq (order of trades that
close together), is_short, profit_ratio and profit_abs; a profit of zero is no win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPITAL = 1000.0


def with_outcome(trades: DataFrame) -> DataFrame:
    """trades with is_win, direction, profit in percent, and duration in hours and in rounded four-hour bars."""
    hours = (F.col("close_time") - F.col("open_time")) / 3600
    return trades.withColumns({"is_win": F.col("profit_ratio") > 0, "direction": F.when(F.col("is_short"), "Short").otherwise("Long"), "profit_pct": F.col("profit_ratio") * 100, "duration_hours": hours, "duration_bars": F.floor(hours / 4 + 0.5).cast("long")})


def measures(capital: float | None = None) -> dict[str, Column]:
    """Aggregates of a group of trades. Without wins or losses their averages are 0; the profit factor is infinite with wins
    and no loss, and 0 with neither."""
    win, ratio, pnl = F.col("profit_ratio") > 0, F.col("profit_ratio"), F.col("profit_abs")
    zero = F.lit(0.0)
    gain, loss = F.coalesce(F.sum(F.when(win, pnl)), zero), F.abs(F.coalesce(F.sum(F.when(~win, pnl)), zero))
    rate = F.count(F.when(win, 1)) / F.count("*")
    avg_win, avg_loss = F.coalesce(F.avg(F.when(win, ratio)) * 100, zero), F.coalesce(F.avg(F.when(~win, ratio)) * 100, zero)
    return {
        "total_trades": F.count("*"), "long_count": F.count(F.when(~F.col("is_short"), 1)), "short_count": F.count(F.when(F.col("is_short"), 1)),
        "win_rate": rate * 100, "profit_factor": F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, F.lit(float("inf"))).otherwise(0.0),
        "total_pnl": F.sum(pnl), "avg_win_pct": avg_win, "avg_loss_pct": avg_loss,
        "avg_duration_hours": F.avg((F.col("close_time") - F.col("open_time")) / 3600), "expectancy": rate * avg_win + (1 - rate) * avg_loss,
    }


def stats(trades: DataFrame, *keys: str) -> DataFrame:
    """One row of measures for each group; without trades there is no row (see overall() for zeros)."""
    return trades.groupBy(*keys).agg(*(c.alias(n) for n, c in measures().items()))


def overall(trades: DataFrame) -> DataFrame:
    """One row over all trades; zeros where there are none."""
    safe = {n: F.coalesce(F.when(F.count("*") > 0, c), F.lit(0)) for n, c in measures().items() if n not in ("win_rate", "expectancy")}
    rows = trades.agg(*(c.alias(n) for n, c in safe.items()), F.count(F.when(F.col("profit_ratio") > 0, 1)).alias("_wins"))
    rate = F.coalesce(F.try_divide(F.col("_wins"), F.col("total_trades")), F.lit(0.0))
    return rows.withColumns({"win_rate": rate * 100, "expectancy": rate * F.col("avg_win_pct") + (1 - rate) * F.col("avg_loss_pct")}).drop("_wins")


def rollup(trades: DataFrame) -> DataFrame:
    """Measures by strategy and pair, by strategy, and over all, in one pass."""
    return trades.rollup("strategy", "pair").agg(*(c.alias(n) for n, c in measures().items()))


#: Seconds of closings that are one block of a drawdown.
SPAN = 30 * 86_400


def drawdown(trades: DataFrame, *keys: str, capital: float = CAPITAL, span: int = SPAN) -> DataFrame:
    """Largest fall of equity from its peak, in percent, by group; trades that close together count in order of seq. A block is what
    closes within `span`: it is summed up to its total and its highest point; from these of the blocks before it a block has the equity
    and the peak it begins with, and then finds its own worst fall. So a group is as many tasks as it has blocks."""
    rows = trades.select(F.struct(*keys, F.lit(0).alias("_")).alias("_key"), F.coalesce(F.floor(F.col("close_time") / span), F.lit(-1 << 40)).alias("_block"), "close_time", "seq", "profit_abs")
    order = Window.partitionBy("_key", "_block").orderBy("close_time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.coalesce(F.sum("profit_abs").over(order), F.lit(0.0)))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_key", "_block").agg(F.coalesce(F.sum("profit_abs"), F.lit(0.0)).alias("_total"), F.max("_sum").alias("_top"))
    blocks = blocks.withColumn("_equity", capital + F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("_peak", F.greatest(F.lit(capital), F.max(F.col("_equity") + F.col("_top")).over(before))).select("_key", "_block", "_equity", "_peak")
    rows = rows.join(blocks, ["_key", "_block"]).withColumn("equity", F.col("_equity") + F.col("_sum"))
    rows = rows.withColumn("peak", F.greatest("_peak", F.max("equity").over(order)))
    return rows.groupBy("_key").agg((F.max((F.col("peak") - F.col("equity")) / F.col("peak")) * 100).alias("max_drawdown")).select(*(F.col("_key")[k].alias(k) for k in keys), "max_drawdown")


def swing_trades(segmented: DataFrame, strategy: str = "swing", stake: float = 300.0) -> DataFrame:
    """Trades from one confirmation of a wave to the next: long after a bottom, short after a top, at the closes of the bars."""
    flips = segmented.where("flip")
    order = Window.partitionBy("symbol").orderBy("open_time")
    rows = flips.select("symbol", "open_time", "close", "is_up", F.lead("open_time").over(order).alias("until"), F.lead("close").over(order).alias("out"), (F.row_number().over(order) - 1).alias("seq")).where("until IS NOT NULL AND close > 0")
    ratio = F.when(F.col("is_up"), F.col("out") - F.col("close")).otherwise(F.col("close") - F.col("out")) / F.col("close")
    return rows.select(F.lit(strategy).alias("strategy"), F.col("symbol").alias("pair"), F.col("seq").cast("long").alias("seq"), F.floor(F.col("open_time") / 1000).cast("long").alias("open_time"), F.floor(F.col("until") / 1000).cast("long").alias("close_time"), (~F.col("is_up")).alias("is_short"), F.col("close").alias("open_rate"), F.col("out").alias("close_rate"), ratio.alias("profit_ratio"), (ratio * stake).alias("profit_abs"), F.lit("exit_signal").alias("exit_reason"), F.lit(None).cast("string").alias("enter_tag"), F.lit(stake).alias("stake_amount"))


def bars_in_trades(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Each trade with the number of its pair's bars from its opening to its closing, and their highest and lowest prices. Bars
    are met by pair and hour-long bins of a day, never by all of a pair's history."""
    day = 86_400
    spread = trades.select("strategy", "pair", "seq", F.col("open_time").alias("t0"), F.col("close_time").alias("t1"), F.explode(F.sequence(F.floor(F.col("open_time") / day), F.floor(F.col("close_time") / day))).alias("day"))
    rows = bars.select(F.col("symbol").alias("pair"), F.floor(F.col("open_time") / 1000).alias("t"), "high", "low").withColumn("day", F.floor(F.col("t") / day))
    met = spread.join(rows, ["pair", "day"]).where("t BETWEEN t0 AND t1")
    return met.groupBy("strategy", "pair", "seq").agg(F.count("*").alias("n_bars"), F.max("high").alias("highest"), F.min("low").alias("lowest"))
