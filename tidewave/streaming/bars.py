"""Bars from a stream of ticks: a bar is emitted once, when the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.sources.bars import millis


def closed_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, tie: Column, interval: str = "4 hours", late: str = "10 minutes") -> DataFrame:
    """Bars of tumbling windows in append mode. Ticks later than the watermark allows are dropped by Spark. A bar that is still
    open isn't shown, so nothing downstream can look ahead."""
    rows = ticks.select(symbol.cast("string").alias("symbol"), ts.cast("timestamp").alias("ts"), price.cast("double").alias("p"), volume.cast("double").alias("v"), tie.alias("tie"))
    rows = rows.where("ts IS NOT NULL AND p IS NOT NULL").withWatermark("ts", late)
    row = F.struct("ts", "tie", "p")
    bars = rows.groupBy("symbol", F.window("ts", interval).alias("w")).agg(F.min(row).alias("a"), F.max("p").alias("high"), F.min("p").alias("low"), F.max(row).alias("z"), F.sum("v").alias("volume"))
    return bars.select("symbol", millis(F.col("w.start")).alias("open_time"), F.col("a.p").alias("open"), "high", "low", F.col("z.p").alias("close"), "volume")
