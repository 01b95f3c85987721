"""Questions about the newest state of each symbol: last swings, trends, zones, long-term swings."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import waves as wv
from tidewave.operators.indicators import along

MAX_WAVES = 200
ZONE_SCHEMA = "symbol string, place int, side string, anchor_wave_id string, low double, high double, wick_low double, wick_high double, is_double boolean, overlap_low_ids array<string>, overlap_high_ids array<string>"


def retained(table: DataFrame, max_waves: int | None = MAX_WAVES) -> DataFrame:
    """Confirmed waves that are still in the registry: the newest max_waves of each symbol, or all with None."""
    if max_waves is None:
        return wv.confirmed(table)
    last = F.max("k").over(Window.partitionBy("symbol"))
    return wv.confirmed(table).withColumn("_last", last).where(F.col("_last") - F.col("k") < max_waves).drop("_last")


def last_swing(table: DataFrame, up: bool, back: int = 0, include_forming: bool = False) -> DataFrame:
    """The latest top (up) or bottom of each symbol; back=1: the one before. With include_forming a forming wave of that side
    counts as the latest."""
    rows = table.where(F.col("is_up") == F.lit(up))
    rows = rows if include_forming else wv.confirmed(rows)
    newest = Window.partitionBy("symbol").orderBy(F.desc("k"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == back + 1).drop("_n")


def current_wave(table: DataFrame) -> DataFrame:
    return table.where("is_forming")


def wave_by_id(table: DataFrame, wave_id: str) -> DataFrame:
    return wv.confirmed(table).where(F.col("wave_id") == wave_id)


#: Levels of range extrema, from one wave to all that a place of 31 bits can number, and how many of them one window gives.
LEVELS, AT_ONCE = 31, 4


def range_extrema(table: DataFrame, levels: int = LEVELS) -> DataFrame:
    """symbol and k of each confirmed wave, with lows and highs: extrema of the 1, 2, 4 ... waves from it on, as far as the symbol's waves go. A level comes from the one below it, by what that has 1, 2, 4 ... of its lengths further on; AT_ONCE levels are one
    window of leads, so the cost of a wave grows with the number of levels only, and no job runs to count them."""
    rows = wv.confirmed(table).select("symbol", "k", F.struct("low", "high").alias("_0"))
    for base in range(0, levels - 1, AT_ONCE):
        upto = min(AT_ONCE, levels - 1 - base)
        ahead = {n: F.lead(f"_{base}", n << base).over(wv.by_wave()) for n in range(1, 1 << upto)}
        rows = rows.withColumns({f"_a{n}": c for n, c in ahead.items()})
        made = {}
        for j in range(1, upto + 1):
            own = [F.col(f"_{base}"), *(F.col(f"_a{n}") for n in range(1, 1 << j))]
            made[f"_{base + j}"] = F.struct(F.least(*(c["low"] for c in own)).alias("low"), F.greatest(*(c["high"] for c in own)).alias("high"))
        rows = rows.select("symbol", "k", *(f"_{j}" for j in range(base + 1)), *(c.alias(n) for n, c in made.items()))
    left = F.max("k").over(Window.partitionBy("symbol")) - F.col("k") + 1
    used = F.floor(F.log2(left.cast("double"))).cast("int") + 1
    return rows.select("symbol", "k", *(F.slice(F.array(*(F.col(f"_{j}")[c] for j in range(levels))), F.lit(1), F.least(used, F.lit(levels))).alias(f"{c}s") for c in ("low", "high")))


def broken_between(table: DataFrame, pairs: DataFrame, apart: int | None = None) -> DataFrame:
    """pairs (symbol, a, b: places of two waves) with lower_low_between and higher_high_between: whether a confirmed wave strictly
    between them goes beyond either. False where one of them isn't confirmed. Two runs of range_extrema cover what is between a pair, so
    a pair meets four waves, however far apart its ends are. apart: the most that ends are apart, where it is known, so that fewer levels are
    planned; a pair beyond it is an error."""
    levels = LEVELS if apart is None else max(1, max(apart - 1, 1).bit_length())
    ends = pairs.select("symbol", "a", "b").distinct()
    first, last = F.least("a", "b") + 1, F.greatest("a", "b") - 1
    size = last - first + 1
    level = F.when(size > 0, F.floor(F.log2(size.cast("double")))).cast("int")
    level = F.when(level >= levels, F.raise_error(F.lit(f"ends are more than {apart} waves apart"))).otherwise(level)
    ends = ends.withColumns({"_level": level, "_one": F.when(size > 0, first)}).withColumn("_two", F.when(size > 0, last - F.expr("shiftleft(1, _level)") + 1))
    rows = range_extrema(table, levels)
    own = wv.confirmed(table).select("symbol", "k", "low", "high")
    for side in ("a", "b"):
        ends = ends.join(own.select("symbol", F.col("k").alias(side), F.col("low").alias(f"l_{side}"), F.col("high").alias(f"h_{side}")), ["symbol", side], "left")
    for side in ("_one", "_two"):
        runs = rows.select("symbol", F.col("k").alias(side), "lows", "highs")
        ends = ends.join(runs, ["symbol", side], "left").withColumns({f"l{side}": F.get("lows", "_level"), f"h{side}": F.get("highs", "_level")}).drop("lows", "highs")
    both = F.col("l_a").isNotNull() & F.col("l_b").isNotNull()
    low, high = F.least("l_one", "l_two"), F.greatest("h_one", "h_two")
    return ends.select("symbol", "a", "b", F.coalesce(both & (low < F.greatest("l_a", "l_b")), F.lit(False)).alias("lower_low_between"), F.coalesce(both & (high > F.least("h_a", "h_b")), F.lit(False)).alias("higher_high_between"))


def trending(table: DataFrame) -> DataFrame:
    """is_trending_up and is_trending_down of each symbol now: the last two tops and bottoms both rise (fall), and the forming
    wave hasn't gone through the last bottom (top)."""
    rows = wv.confirmed(table)
    rows = rows.withColumns({"t0": wv.swing("h", True), "t1": wv.swing("h", True, 1), "b0": wv.swing("l", False), "b1": wv.swing("l", False, 1)})
    newest = rows.groupBy("symbol").agg(F.max(F.struct("k", "t0", "t1", "b0", "b1")).alias("s"))
    forming = current_wave(table).select("symbol", F.col("is_up").alias("forming_up"), F.col("high").alias("forming_high"), F.col("low").alias("forming_low"))
    both = forming.join(newest, "symbol", "left")
    up = (F.col("s.t0") > F.col("s.t1")) & (F.col("s.b0") > F.col("s.b1")) & (F.col("forming_up") | (F.col("forming_low") > F.col("s.b0")))
    down = (F.col("s.t0") < F.col("s.t1")) & (F.col("s.b0") < F.col("s.b1")) & (~F.col("forming_up") | (F.col("forming_high") < F.col("s.t0")))
    return both.select("symbol", F.coalesce(up, F.lit(False)).alias("is_trending_up"), F.coalesce(down, F.lit(False)).alias("is_trending_down"))


def long_term_swings(table: DataFrame, up: bool, since: int = 100, max_age: int = 50) -> DataFrame:
    """The newest top (bottom) that is the extreme of at least `since` bars, with age, the bars since its extreme. The newest
    confirmed wave counts at any age; an older one if at most max_age bars have passed since it ended."""
    n = table.groupBy("symbol").agg(F.max("end_i").alias("_end"))
    newest = wv.confirmed(table).groupBy("symbol").agg(F.max("k").alias("_newest"))
    at = "h_i" if up else "l_i"
    rows = wv.confirmed(table).where(F.col("is_up") == F.lit(up)).join(wv.swing_distances(table), ["symbol", "k"]).where(F.col("since") >= since)
    best = Window.partitionBy("symbol").orderBy(F.desc("k"))
    rows = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").join(n, "symbol").join(newest, "symbol")
    rows = rows.where((F.col("k") == F.col("_newest")) | (F.col("_end") - F.col("end_i") <= max_age))
    return rows.select("symbol", "wave_id", "k", (F.col("_end") - F.col(at)).alias("age"), "since", F.col("h" if up else "l").alias("price"))


class Taken:
    """Prices that zones have taken: disjoint intervals in order, merged where they meet."""

    def __init__(self) -> None:
        self.starts: list[float] = []
        self.ends: list[float] = []

    def meets(self, low: float, high: float) -> bool:
        at = bisect.bisect_right(self.starts, high) - 1
        return at >= 0 and self.ends[at] >= low

    def add(self, low: float, high: float) -> None:
        a, b = bisect.bisect_left(self.ends, low), bisect.bisect_right(self.starts, high)
        if a < b:
            low, high = min(low, self.starts[a]), max(high, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [low], [high]


#: What the list of zones needs of each wave.
ZONE_NUMBERS = ["k", "is_up", "is_forming", "high", "high_atr", "low", "low_atr", "top_low", "top_high", "bottom_low", "bottom_high"]


class Registry:
    """The waves of a symbol as columns of numbers, and their names."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.names: list[str] = []
        self.symbol = ""

    def take(self, part: pd.DataFrame) -> None:
        self.symbol = part["symbol"].iloc[0]
        self.parts.append(np.stack([part[c].to_numpy(np.float64, na_value=np.nan) for c in ZONE_NUMBERS]))
        self.names += part["wave_id"].tolist()

    def zones(self, up: bool, include_forming: bool, proximity: int, only_overlapping: bool, only_newest: bool, multiple: float, share: float) -> Iterator[dict]:
        """Zones, newest first. An anchor is passed over if its body meets prices that are taken."""
        c = dict(zip(ZONE_NUMBERS, np.concatenate(self.parts, 1), strict=True))
        mine, forming = c["is_up"] == float(up), c["is_forming"] == 1
        body, other = (("top_low", "top_high"), ("bottom_low", "bottom_high")) if up else (("bottom_low", "bottom_high"), ("top_low", "top_high"))
        same, rest = np.flatnonzero(mine if include_forming else mine & ~forming), np.flatnonzero(~mine & ~forming)
        inside = c["high" if up else "low"]
        names, taken = np.array(self.names, object), Taken()

        def row(n: int) -> dict:
            return {k: float(v[n]) for k, v in c.items()} | {"is_up": up, "wave_id": names[n]}

        for n in range(len(same) - 1, -1, -1):
            at = int(same[n])
            if only_newest and taken.meets(c[body[0]][at], c[body[1]][at]):
                continue
            near = same[max(0, n - proximity) : n][::-1]
            # the registry has no forming wave, so one as anchor is never vetoed
            between = [None if forming[at] or o + 1 == at else float((np.max if up else np.min)(inside[o + 1 : at])) for o in near.tolist()]
            z = wv.zone_of(row(at), [row(o) for o in near.tolist()], between, proximity, multiple, share)
            older = same[: max(0, n - proximity)][::-1]
            ids = [w["wave_id"] for w in z["near"]] + names[older[(c[body[0]][older] <= z["high"]) & (c[body[1]][older] >= z["low"])]].tolist()
            against = names[rest[(c[other[0]][rest] <= z["high"]) & (c[other[1]][rest] >= z["low"])]].tolist()
            taken.add(z["low"], z["high"])
            if ids or not only_overlapping:
                yield {"side": "resistance" if up else "support", "anchor_wave_id": names[at], "low": z["low"], "high": z["high"], "wick_low": z["wick_low"], "wick_high": z["wick_high"], "is_double": z["double"], "overlap_low_ids": against if up else ids, "overlap_high_ids": ids if up else against}


def zones(table: DataFrame, side: str, *, include_forming: bool = False, proximity: int = 2, only_overlapping: bool = False, only_newest: bool = True, max_waves: int | None = MAX_WAVES, multiple: float = 0.3, share: float = 0.004) -> DataFrame:
    """All zones of a side as of the last bar, newest first (place). Whether an anchor is passed over depends on the zones before
    it, one after another: a fold over the symbol's waves, which pass in batches and stay as a dozen numbers each. max_waves: only the
    newest so many; None: all."""
    up = side == "resistance"
    if side not in ("support", "resistance"):
        raise ValueError(f"no side: {side}")
    rows = retained(table, max_waves).unionByName(current_wave(table)).select("symbol", "wave_id", *ZONE_NUMBERS)

    def finish(waves: Registry) -> pd.DataFrame:
        found = [{"symbol": waves.symbol, "place": n} | z for n, z in enumerate(waves.zones(up, include_forming, proximity, only_overlapping, only_newest, multiple, share))]
        return pd.DataFrame(found, columns=[c.split(" ")[0] for c in ZONE_SCHEMA.split(", ")])

    return along(rows, Registry, Registry.take, ZONE_SCHEMA, ["k"], finish=finish)


def anchors(table: DataFrame, side: str) -> DataFrame:
    """The zone of each confirmed wave of a side, newest first (place), with how many older waves of the side meet it (overlaps). Zones come
    from the pass over the waves, so no symbol is gathered."""
    up = side == "resistance"
    rows = wv.wave_history(table).join(wv.confirmed(table).where(F.col("is_up") == F.lit(up)).select("symbol", "k", "wave_id"), ["symbol", "k"])
    newest = Window.partitionBy("symbol").orderBy(F.desc("k"))
    names = {"low": "low", "high": "high", "wick_low": "wick_low", "wick_high": "wick_high", "double": "is_double", "overlaps": "overlaps"}
    return rows.select("symbol", (F.row_number().over(newest) - 1).alias("place"), F.lit(side).alias("side"), F.col("wave_id").alias("anchor_wave_id"), *(F.col(f"{side}_{a}").alias(b) for a, b in names.items()))
