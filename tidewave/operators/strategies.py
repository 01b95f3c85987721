"""Entry, exit and size rules over projected bars, as plain predicates (missing values are false)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.indicators import by_symbol


def _is(name: str) -> Column:
    return F.coalesce(F.col(f"ms_{name}"), F.lit(False))


def _before(name: str) -> Column:
    return F.lag(f"ms_{name}").over(by_symbol())


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def trend_entry() -> Column:
    """Uptrend, rising wave, a pullback of half to all of the last leg, and enough waves."""
    f = F.col("ms_pullback_correction_factor")
    return _flag(_is("is_trending_up") & (F.col("ms_wave_side") == "up") & (f >= 0.5) & (f <= 1.0) & (F.col("ms_wave_count") >= 6))


def zone_entry() -> Column:
    """The low dips into a support zone with a double bottom, outside a downtrend."""
    return _flag((F.col("low") <= F.col("ms_support_zone_high")) & (F.col("low") >= F.col("ms_support_zone_low")) & _is("support_is_double") & ~_is("is_trending_down"))


def divergence_entry() -> tuple[Column, Column]:
    """Long and short: a divergence with a new extreme, the next wave begun, and the price near the zone."""
    long = _is("bullish_divergence") & _is("made_lower_low") & (F.col("ms_wave_side") == "up") & (F.col("close") <= F.col("ms_support_zone_high") * 1.01)
    short = _is("bearish_divergence") & _is("made_higher_high") & (F.col("ms_wave_side") == "down") & (F.col("close") >= F.col("ms_resistance_zone_low") * 0.99)
    return _flag(long), _flag(short)


def strength_filter() -> Column:
    return _flag(_is("is_trending_up") & (F.coalesce("ms_high_since", F.lit(0)) >= 50) & (F.col("ms_wave_count") >= 8) & (F.coalesce("ms_wave_length", F.lit(0)) <= 30))


def stake_scale(stake: Column, least: float, most: float) -> Column:
    """A stake scaled by the depth of the pullback and clipped; unscaled where there is none."""
    f = F.col("ms_pullback_correction_factor")
    scale = F.when((f >= 0.5) & (f <= 0.85), 1.0).when((f > 0.85) & (f <= 1.0), 0.6).when(f < 0.5, 0.5).otherwise(0.3)
    return F.when(f.isNull(), stake).otherwise(F.greatest(F.lit(least), F.least(stake * scale, F.lit(most))))


def multi_entry() -> Column:
    f = F.col("ms_pullback_correction_factor")
    near = _before("forming_wave_low") <= _before("support_zone_high") * 1.005
    return _flag(_is("is_trending_up") & _is("made_higher_high") & _is("made_higher_low") & (F.col("ms_wave_side") == "up") & (f >= 0.382) & (f <= 0.786) & near & ~_is("bearish_divergence") & (F.col("ms_wave_count") >= 6))


def break_exit() -> tuple[Column, Column]:
    """Long and short: the trend flag falls; long also with a lower high, a lower low and a price below support."""
    long = (_flag(_before("is_trending_up")) & ~_is("is_trending_up")) | (_is("made_lower_high") & _is("made_lower_low") & (F.col("ms_forming_wave_low") < F.col("ms_support_zone_low")))
    return _flag(long), _flag(_flag(_before("is_trending_down")) & ~_is("is_trending_down"))


def signals(bars: DataFrame, **flags: Column) -> DataFrame:
    """symbol, open_time and the named columns of each bar."""
    return bars.select("symbol", "open_time", *(c.alias(n) for n, c in flags.items()))
