"""The 67 ms_ columns of each bar: structure as of the last confirmed wave, corrected bar by bar.

A bar of wave j sees what was known when wave j - 1 was confirmed, so nothing of its own wave leaks into it. Columns know what
they need: only those stages are planned that a requested column depends on; Catalyst prunes the rest.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import lifecycle
from tidewave.operators import waves as wv
from tidewave.operators.indicators import by_symbol, with_structure
from tidewave.sources.tables import written

#: The short names of all columns, by group.
PLAIN = ["wave_side", "wave_id", "forming_wave_high", "forming_wave_low", "wave_count", "atr"]
SWINGS = ["last_top_price", "last_bottom_price", "made_higher_high", "made_higher_low", "made_lower_high", "made_lower_low", "trend_wave_count", "is_trending_up", "is_trending_down", "trend_duration", "structure_break_level", "structure_break_confirmed", "three_push_up", "three_push_down", "sfp_high", "sfp_low", "bars_since_last_top", "bars_since_last_bottom", "bearish_divergence", "bullish_divergence"]
WAVE = ["wave_length", "wave_amplitude", "wave_slope", "wave_volume", "wave_volume_ratio", "wave_amplitude_ratio", "pullback_length", "pullback_correction_factor", "pullback_breakout_level", "pullback_price_diff", "pullback_atr_factor"]
ZONES = ["high_since", "low_since", *(f"{s}_{c}" for s in ("support", "resistance") for c in ("zone_low", "zone_high", "zone_wick_low", "zone_wick_high", "is_double", "overlap_count", "zone_anchor_time")), "zone_quality_support", "zone_quality_resistance", "distance_to_support", "distance_to_resistance"]
LIFE = [f"zone_{e}_{s}" for e in ("break", "retest", "retest_count", "flip", "failed_retest") for s in ("support", "resistance")]
ALL_COLUMNS = tuple(sorted([*PLAIN, *SWINGS, *WAVE, *ZONES, *LIFE]))
WHOLE = {"wave_count", "trend_wave_count", "trend_duration", "wave_length", "pullback_length", "high_since", "low_since", "support_overlap_count", "resistance_overlap_count", "bars_since_last_top", "bars_since_last_bottom", "zone_retest_count_support", "zone_retest_count_resistance"}


def check_columns(columns: Iterable[str] | None) -> list[str]:
    """The requested short names; all, sorted, for None. Unknown ones are an error."""
    if columns is None:
        return list(ALL_COLUMNS)
    unknown = sorted(set(columns) - set(ALL_COLUMNS))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}; known are {', '.join(ALL_COLUMNS)}")
    return list(dict.fromkeys(columns))


def quality(overlaps: Column, double: Column, width: Column, atr: Column, age: Column, touches: Column) -> Column:
    """Score of a zone, 0 to 10: earlier swings at it, double, narrow against ATR, young, touched from the other side."""
    narrow = F.when(atr > 0, F.greatest(F.lit(0.0), 2.0 - width / atr * 2)).otherwise(0.0)
    score = F.least(overlaps, F.lit(5)) * 0.8 + F.when(double, 2.0).otherwise(0.0) + narrow + 2.0 * F.exp(-age / 100) + F.least(touches, F.lit(3)) * 0.7
    return F.least(score, F.lit(10.0))


def snapshots(table: DataFrame, zones: bool, max_waves: int | None = None) -> DataFrame:
    """One row per confirmed wave: all that bars of the next wave see."""
    rows = wv.metrics(wv.diverging(wv.pullback(wv.confirmed(table))))
    top, bottom = (lambda n: wv.swing("h", True, n)), (lambda n: wv.swing("l", False, n))
    rows = rows.withColumns({"t0": top(0), "t1": top(1), "b0": bottom(0), "b1": bottom(1)})
    hh, hl, lh, ll = F.col("t0") > F.col("t1"), F.col("b0") > F.col("b1"), F.col("t0") < F.col("t1"), F.col("b0") < F.col("b1")
    rows = rows.withColumns({"hh": hh, "hl": hl, "lh": lh, "ll": ll, "last_div": F.col("diverging"), "prev_div": F.lag("diverging").over(wv.by_wave())})
    rises, falls = F.coalesce(hh & hl, F.lit(False)), F.coalesce(lh & ll, F.lit(False))
    rows = rows.withColumns({"rises": rises, "falls": falls, "orderly": rises | falls})
    # how many same-parity waves back (this one included) are orderly: both lists walk back together
    parity = Window.partitionBy("symbol", F.col("k") % 2).orderBy("k")
    rows = rows.withColumn("broken", F.max(F.when(~F.col("orderly"), F.col("k"))).over(parity.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("run", F.when(F.col("orderly"), (F.col("k") - F.coalesce("broken", (F.col("k") % 2) - 2)) / 2).otherwise(0).cast("int"))
    up = F.col("is_up")
    size = [F.lag("high", 2 * n).over(wv.by_wave()) - F.lag("low", 2 * n).over(wv.by_wave()) if n else F.col("high") - F.col("low") for n in range(3)]
    price = [(F.lag(F.when(up, F.col("h")).otherwise(-F.col("l")), 2 * n).over(wv.by_wave())) if n else F.when(up, F.col("h")).otherwise(-F.col("l")) for n in range(3)]
    pushes = (size[0] < size[1]) & (size[1] < size[2]) & (price[0] > price[1]) & (price[1] > price[2]) & (price[0] - price[1] < price[1] - price[2])
    rows = rows.withColumn("pushes", F.coalesce(pushes, F.lit(False)))
    before = F.lag("pushes").over(wv.by_wave())
    out = {
        "last_top_price": F.col("t0"), "last_bottom_price": F.col("b0"),
        "made_higher_high": F.col("hh"), "made_higher_low": F.col("hl"), "made_lower_high": F.col("lh"), "made_lower_low": F.col("ll"),
        "trend_wave_count": F.col("run") if max_waves is None else F.least("run", F.lit(max_waves // 2 - 1)), "structure_break_level": F.when(F.col("rises"), F.col("b0")).when(F.col("falls"), F.col("t0")),
        "three_push_up": F.coalesce(F.when(up, F.col("pushes")).otherwise(before), F.lit(False)),
        "three_push_down": F.coalesce(F.when(~up, F.col("pushes")).otherwise(before), F.lit(False)),
        "bearish_divergence": F.when(up, F.col("last_div")).otherwise(F.col("prev_div")), "bullish_divergence": F.when(~up, F.col("last_div")).otherwise(F.col("prev_div")),
        "wave_length": F.col("n_bars").cast("int"), "wave_amplitude": F.col("amplitude"), "wave_slope": F.col("slope"), "wave_volume": F.col("volume"),
        "wave_volume_ratio": F.col("volume_ratio"), "wave_amplitude_ratio": F.col("amplitude_ratio"),
        "pullback_length": F.col("pullback_length"), "pullback_correction_factor": F.col("pullback_correction_factor"),
        "pullback_breakout_level": F.col("pullback_breakout_level"), "pullback_price_diff": F.col("pullback_price_diff"),
        "pullback_atr_factor": F.when(F.col("formation_atr") > 0, F.abs("pullback_price_diff") / F.col("formation_atr")),
        "rises": F.col("rises"), "falls": F.col("falls"), "s_up": up, "s_formation_i": F.col("formation_i"), "s_formation_atr": F.col("formation_atr"),
    }
    snaps = rows.select("symbol", "k", *(c.alias(n) for n, c in out.items()))
    return with_zones(snaps, table, max_waves) if zones else snaps


def with_zones(snaps: DataFrame, table: DataFrame, max_waves: int | None = None) -> DataFrame:
    """Snapshots with swing distances and zones (see waves.wave_history)."""
    past = wv.wave_history(table, max_waves=max_waves)
    rows = snaps.join(past, ["symbol", "k"])
    own, prev = F.col("since"), F.lag("since").over(wv.by_wave())
    rows = rows.withColumns({"high_since": F.when(F.col("s_up"), own).otherwise(prev), "low_since": F.when(~F.col("s_up"), own).otherwise(prev)})
    names = {"low": "zone_low", "high": "zone_high", "wick_low": "zone_wick_low", "wick_high": "zone_wick_high", "double": "is_double", "overlaps": "overlap_count", "anchor_time": "zone_anchor_time"}
    for side in ("support", "resistance"):
        score = quality(F.col(f"{side}_overlaps"), F.col(f"{side}_double"), F.col(f"{side}_high") - F.col(f"{side}_low"), F.col("s_formation_atr"), F.col("s_formation_i") - F.col(f"{side}_formation_i"), F.col(f"{side}_touches"))
        rows = rows.withColumn(f"zone_quality_{side}", F.when(F.col(f"{side}_low").isNotNull(), score))
        rows = rows.withColumnsRenamed({f"{side}_{a}": f"{side}_{b}" for a, b in names.items()})
    return rows


def project(bars: DataFrame, columns: Iterable[str] | None = None, *, hist: str | None = None, retest_mode: str = "wick", atr_period: int = 14, r: int = 12, s: int = 8, signal_period: int = 4, prefix: str = "ms_", max_waves: int | None = None) -> DataFrame:
    """bars with the requested columns under prefix. hist: the column whose sign makes waves; None: the TSI histogram of the
    closes. Any retest_mode but wick is the close mode. max_waves: only so many confirmed waves are remembered (see waves.evicted).
    Empty input gives the full schema without rows. Indicators and waves are written once (see written), as several
    stages read them."""
    wanted = check_columns(columns)
    if max_waves is not None and max_waves < wv.LEAST_WAVES:
        raise ValueError(f"max_waves must be {wv.LEAST_WAVES} or more")
    rows = bars.withColumn("hist", F.col(hist)) if hist else bars
    rows = written(with_structure(rows, bool(hist), r, s, signal_period, atr_period), "bars-in-waves")
    table = wv.waves(rows)
    zoned = bool(set(wanted) & set(ZONES + LIFE))
    if zoned:
        table = written(table, "waves")
    snaps = snapshots(table, zoned, max_waves)
    last = Window.partitionBy("symbol")
    rows = rows.withColumn("wave_side", F.when(F.col("is_up"), "up").otherwise("down"))
    rows = rows.withColumn("wave_id", F.concat(F.when(F.col("k") == F.max("k").over(last), "forming-").otherwise("w-"), F.col("k").cast("string")))
    own = Window.partitionBy("symbol", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"forming_wave_high": F.max("high").over(own), "forming_wave_low": F.min("low").over(own), "wave_count": (F.col("k") if max_waves is None else F.least("k", F.lit(max_waves))).cast("int")})
    joined = rows.alias("b").join(snaps.withColumn("k", F.col("k") + 1).alias("s"), ["symbol", "k"], "left")
    joined = per_bar(joined, zoned)
    if set(wanted) & set(LIFE):
        needed = ["symbol", "open_time", "i", "open", "high", "low", "close", "volume", *(f"{z}_zone_{e}" for z in ("support", "resistance") for e in ("low", "high")), *(c for c in wanted if c not in LIFE)]
        joined = lifecycle.with_lifecycle(joined.select(*(joined[c] for c in dict.fromkeys(needed))), retest_mode)
    kept = ["symbol", "open_time", *(c for c in ("open", "high", "low", "close", "volume"))]
    return joined.select(*kept, *((F.col(c).cast("long") if c in WHOLE else F.col(c)).alias(prefix + c) for c in wanted))


def edge(flag: Column, level: Column | None = None) -> Column:
    """True on the first bar of a run, and again where the level it refers to changes."""
    begins = ~F.lag(flag, 1, False).over(by_symbol())
    return flag & begins if level is None else flag & (begins | ~level.eqNullSafe(F.lag(level).over(by_symbol())))


def per_bar(rows: DataFrame, zoned: bool) -> DataFrame:
    """Columns that change within a wave."""
    no = F.lit(False)
    rows = rows.withColumns({c: F.coalesce(c, no) for c in ("three_push_up", "three_push_down", "rises", "falls")}).withColumn("trend_wave_count", F.coalesce("trend_wave_count", F.lit(0)))
    up, down = F.col("is_up"), ~F.col("is_up")
    rows = rows.withColumns({
        "is_trending_up": F.col("rises") & ~F.coalesce(down & (F.col("forming_wave_low") <= F.col("last_bottom_price")), no),
        "is_trending_down": F.col("falls") & ~F.coalesce(up & (F.col("forming_wave_high") >= F.col("last_top_price")), no),
        "_broken": F.coalesce(F.when(F.col("rises"), F.col("close") < F.col("structure_break_level")).when(F.col("falls"), F.col("close") > F.col("structure_break_level")), no),
        "_sfp_high": F.coalesce((F.col("high") > F.col("last_top_price")) & (F.col("close") < F.col("last_top_price")), no),
        "_sfp_low": F.coalesce((F.col("low") < F.col("last_bottom_price")) & (F.col("close") > F.col("last_bottom_price")), no),
    })
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    trending = F.col("is_trending_up") | F.col("is_trending_down")
    rows = rows.withColumns({"_trending": trending, "_calm": F.max(F.when(~trending, F.col("i"))).over(so_far)})
    confirmed_up, confirmed_down = F.col("flip") & down, F.col("flip") & up  # a flip to down confirms an up wave
    rows = rows.withColumns({
        "trend_duration": F.when(F.col("_trending"), F.col("i") - F.coalesce("_calm", F.lit(-1)) - 1),
        "structure_break_confirmed": edge(F.col("_broken"), F.col("structure_break_level")),
        "sfp_high": edge(F.col("_sfp_high"), F.col("last_top_price")), "sfp_low": edge(F.col("_sfp_low"), F.col("last_bottom_price")),
        "three_push_up": edge(F.col("three_push_up")), "three_push_down": edge(F.col("three_push_down")),
        "bars_since_last_top": F.col("i") - F.max(F.when(confirmed_up, F.col("i"))).over(so_far),
        "bars_since_last_bottom": F.col("i") - F.max(F.when(confirmed_down, F.col("i"))).over(so_far),
    })
    if zoned:
        atr = F.when(F.col("atr") != 0, F.col("atr"))
        rows = rows.withColumns({"distance_to_support": (F.col("close") - F.col("support_zone_high")) / atr, "distance_to_resistance": (F.col("resistance_zone_low") - F.col("close")) / atr})
    return rows
