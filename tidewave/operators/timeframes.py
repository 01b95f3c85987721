"""Structure of a higher timeframe on the bars of a lower one, without looking ahead.

A higher bar is known when it has closed: its columns hold from its start plus its length. The as-of join carries the whole row
of the higher bar as one struct, so that a missing cell isn't filled from an older bar.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.projection import check_columns, project

#: Milliseconds of the units of a timeframe.
UNITS = {"s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def timeframe_ms(name: str) -> int:
    """Milliseconds of 15m, 4h, 1d and the like."""
    found = re.fullmatch(r"(\d+)\s*([a-z]+)", name.strip().lower())
    if not found or found[2] not in UNITS or not int(found[1]):
        raise ValueError(f"no timeframe: {name}")
    return int(found[1]) * UNITS[found[2]]


def check_timeframes(htf: str, ltf: str) -> tuple[int, int]:
    high, low = timeframe_ms(htf), timeframe_ms(ltf)
    if high <= low:
        raise ValueError(f"{htf} must be longer than {ltf}")
    if high % low:
        raise ValueError(f"{htf} must be a multiple of {ltf}")
    return high, low


def resample_bars(bars: DataFrame, interval_ms: int, offset_ms: int = 0) -> DataFrame:
    """Bars of a longer interval: first open, highest high, lowest low, last close, sum of volumes, last hist if there is one.
    A bin is left-closed and labelled by its start; empty bins are absent. Bars of one time are ordered by their prices."""
    extra = ["hist"] if "hist" in bars.columns else []
    row = F.struct("open_time", "open", "close", *extra)
    begin = F.col("open_time") - F.pmod(F.col("open_time") - offset_ms, F.lit(interval_ms))
    found = bars.where("open_time IS NOT NULL").groupBy("symbol", begin.cast("long").alias("bin")).agg(F.min(row).alias("a"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(row).alias("z"), F.sum("volume").alias("volume"))
    return found.where("a.open IS NOT NULL").select("symbol", F.col("bin").alias("open_time"), F.col("a.open").alias("open"), "high", "low", F.col("z.close").alias("close"), "volume", *(F.col(f"z.{c}").alias(c) for c in extra))


def as_of(left: DataFrame, right: DataFrame, at: str, known: str, columns: list[str]) -> DataFrame:
    """left (symbol, at, ...) with the columns of the last row of right whose known <= at; nulls where there is none. Both are
    sorted once by symbol and time: no pairs are formed."""
    names = left.columns
    one = left.select("symbol", F.col(at).alias("_t"), F.lit(1).alias("_late"), F.struct(*names).alias("_l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    two = right.select("symbol", F.col(known).alias("_t"), F.lit(0).alias("_late"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("_l"), F.struct(*columns).alias("_r"))
    order = Window.partitionBy("symbol").orderBy("_t", "_late").rowsBetween(Window.unboundedPreceding, 0)
    rows = one.unionByName(two).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_late = 1")
    return rows.select(*(F.col(f"_l.{c}").alias(c) for c in names), *(F.col(f"_r.{c}").alias(c) for c in columns))


def project_higher(bars: DataFrame, columns: Iterable[str] | None = None, *, htf: str, ltf: str, **options: object) -> DataFrame:
    """bars with the requested columns of the higher timeframe as ms_{htf}_*. options go to project(); where hist names a column,
    the last value in each higher bar is its oscillator. One row for each row of bars."""
    high, _ = check_timeframes(htf, ltf)
    wanted = check_columns(columns)
    rows = bars
    if options.get("hist"):
        rows = bars.withColumn("hist", F.col(str(options["hist"])))
        options = options | {"hist": "hist"}
    else:
        rows = bars.drop("hist")
    prefix = f"ms_{htf}_"
    higher = project(resample_bars(rows, high), wanted, prefix=prefix, **options)
    names = [prefix + c for c in wanted]
    known = higher.select("symbol", (F.col("open_time") + high).alias("_known"), *names)
    return as_of(bars, known, "open_time", "_known", names)
