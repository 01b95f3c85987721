"""Spans and events of projected bars: runs of one value as intervals, and flags as rows.

A run ends where the next one begins; the last ends at the last bar. All start from project()'s output (prefix ms_).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.indicators import by_symbol

FLAGS = ("sfp_high", "sfp_low", "three_push_up", "three_push_down")
LIFE_EVENTS = ("break", "retest", "flip", "failed_retest")


def runs_of(bars: DataFrame, value: Column, first: dict[str, Column]) -> DataFrame:
    """One row per run of equal values (null-safe): value, first.* as of its first bar, begin and end_time."""
    rows = bars.select("symbol", "open_time", value.alias("value"), *(c.alias(n) for n, c in first.items()))
    change = F.lag("open_time").over(by_symbol()).isNull() | ~F.col("value").eqNullSafe(F.lag("value").over(by_symbol()))
    last = F.max("open_time").over(Window.partitionBy("symbol"))
    heads = rows.withColumns({"_new": change, "_last": last}).where("_new")
    return heads.withColumn("end_time", F.coalesce(F.lead("open_time").over(by_symbol()), "_last")).drop("_new", "_last")


def zone_spans(bars: DataFrame, side: str) -> DataFrame:
    """Intervals of one zone of a side; start_time is its anchor's time where known."""
    low, high = F.col(f"ms_{side}_zone_low"), F.col(f"ms_{side}_zone_high")
    first = {"double": F.coalesce(F.col(f"ms_{side}_is_double"), F.lit(False)), "overlaps": F.coalesce(F.col(f"ms_{side}_overlap_count"), F.lit(0)), "start_time": F.coalesce(F.col(f"ms_{side}_zone_anchor_time").cast("long"), F.col("open_time"))}
    rows = runs_of(bars, F.struct(low.alias("low"), high.alias("high")), first).where("value.low IS NOT NULL AND value.high IS NOT NULL")
    return rows.select("symbol", F.lit(side).alias("side"), "start_time", "end_time", F.col("value.low").alias("price_low"), F.col("value.high").alias("price_high"), F.col("double").alias("is_double"), F.col("overlaps").cast("long").alias("overlap_count"))


def trend_spans(bars: DataFrame) -> DataFrame:
    direction = F.when(F.col("ms_is_trending_up"), "up").when(F.col("ms_is_trending_down"), "down")
    return runs_of(bars, direction, {}).where("value IS NOT NULL").select("symbol", F.col("open_time").alias("start_time"), "end_time", F.col("value").alias("direction"))


def structure_break_spans(bars: DataFrame) -> DataFrame:
    rows = runs_of(bars, F.col("ms_structure_break_level"), {"up": F.col("ms_is_trending_up")}).where("value IS NOT NULL")
    return rows.select("symbol", F.col("open_time").alias("start_time"), "end_time", F.col("value").alias("level"), F.col("up").alias("is_uptrend"))


def wave_transitions(bars: DataFrame) -> DataFrame:
    """Bars on which another wave begins."""
    before = F.lag("ms_wave_id").over(by_symbol())
    return bars.withColumn("_before", before).where("_before != ms_wave_id").select("symbol", F.col("open_time").alias("time"), F.col("ms_wave_id").alias("wave_id"), F.col("ms_wave_side").alias("side"))


def divergence_markers(bars: DataFrame) -> DataFrame:
    """Bars on which a divergence shows for the first time; never the first bar."""
    rows = bars.select("symbol", "open_time", *(F.coalesce(F.col(f"ms_{k}_divergence"), F.lit(False)).alias(k) for k in ("bearish", "bullish")))
    rows = rows.withColumns({f"_{k}": F.lag(k).over(by_symbol()) for k in ("bearish", "bullish")})
    marks = F.filter(F.array(*(F.when(F.col(k) & ~F.col(f"_{k}"), F.lit(k)) for k in ("bearish", "bullish"))), lambda x: x.isNotNull())
    return rows.select("symbol", F.col("open_time").alias("time"), F.explode(marks).alias("type"))


def _flags(bars: DataFrame, names: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """A row for each true flag, with its labels."""
    cells = [F.when(F.col(c), F.struct(*(F.lit(v).alias(k) for k, v in labels.items()))) for c, labels in names]
    return bars.select("symbol", F.col("open_time").alias("time"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("e")).select("symbol", "time", "e.*")


def lifecycle_events(bars: DataFrame) -> DataFrame:
    return _flags(bars, [(f"ms_zone_{e}_{s}", {"event_type": e, "zone_side": s}) for s in ("support", "resistance") for e in LIFE_EVENTS])


def pattern_markers(bars: DataFrame) -> DataFrame:
    return _flags(bars, [(f"ms_{f}", {"pattern_type": f}) for f in FLAGS])


def markers(bars: DataFrame) -> DataFrame:
    """All markers in one table: symbol, time, kind, label."""
    parts = [
        wave_transitions(bars).select("symbol", "time", F.lit("wave").alias("kind"), F.col("wave_id").alias("label")),
        divergence_markers(bars).select("symbol", "time", F.lit("divergence").alias("kind"), F.col("type").alias("label")),
        lifecycle_events(bars).select("symbol", "time", F.lit("zone").alias("kind"), F.concat_ws("_", "event_type", "zone_side").alias("label")),
        pattern_markers(bars).select("symbol", "time", F.lit("pattern").alias("kind"), F.col("pattern_type").alias("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zone_grade(score: Column) -> Column:
    """Weak below 3, Fair below 6, Strong below 8, else Very Strong; null without a score."""
    return F.when(score < 3, "Weak").when(score < 6, "Fair").when(score < 8, "Strong").when(score.isNotNull(), "Very Strong")


def has_lifecycle_event() -> Column:
    out = F.lit(False)
    for s in ("support", "resistance"):
        for e in LIFE_EVENTS:
            out = out | F.coalesce(F.col(f"ms_zone_{e}_{s}"), F.lit(False))
    return out
