"""Waves: runs of bars with one sign of the histogram, and what can be said about each wave and its predecessors.

Waves alternate, so the previous wave of the same side is two rows back and the previous one of the other side one row back.
Ties within a wave go to the earlier bar. The last wave of a symbol is forming: it is no wave of its successors' past.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewave.operators.indicators import along, by_symbol
from tidewave.sources.tables import written


def by_wave() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("k")


def segment(bars: DataFrame) -> DataFrame:
    """bars with i (place of the bar), is_up (0 counts as up, a missing value as down), flip and k (number of its wave)."""
    rows = bars.withColumn("i", F.row_number().over(by_symbol()) - 1).withColumn("is_up", F.coalesce(F.col("hist") >= 0, F.lit(False)))
    rows = rows.withColumn("flip", F.coalesce(F.col("is_up") != F.lag("is_up").over(by_symbol()), F.lit(False)))
    return rows.withColumn("k", F.sum(F.col("flip").cast("int")).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))


def waves(segmented: DataFrame) -> DataFrame:
    """One row per wave: extrema with their bars, lengths, volumes, the bar that confirmed it, and ATRs there."""
    body_top, body_low = F.greatest("open", "close"), F.least("open", "close")
    atr = F.col("atr") if "atr" in segmented.columns else F.lit(None).cast("double").alias("atr")
    rows = segmented.withColumn("atr", atr).groupBy("symbol", "k").agg(
        F.max("is_up").alias("is_up"),
        F.min("i").alias("start_i"),
        F.max("i").alias("end_i"),
        F.count("*").alias("n_bars"),
        F.sum("volume").alias("volume"),
        F.max("hist").alias("hist_max"),
        F.min("hist").alias("hist_min"),
        F.max(F.struct("high", (-F.col("i")).alias("at"), "open_time", "atr")).alias("hi"),
        F.min(F.struct("low", F.col("i").alias("at"), "open_time", "atr")).alias("lo"),
        F.max(F.struct("close", (-F.col("i")).alias("at"), "open")).alias("hc"),
        F.min(F.struct("close", F.col("i").alias("at"), "open")).alias("lc"),
        F.max(F.struct(body_top.alias("v"), (-F.col("i")).alias("at"), "open_time")).alias("hco"),
        F.min(F.struct(body_low.alias("v"), F.col("i").alias("at"), "open_time")).alias("lco"),
        F.min(F.struct("i", "atr")).alias("head"),
    )
    flat = rows.select(
        "symbol", "k", "is_up", "start_i", "end_i", "n_bars", "volume", "hist_max", "hist_min",
        F.col("hi.high").alias("high"), (-F.col("hi.at")).alias("high_i"), F.col("hi.open_time").alias("high_time"), F.col("hi.atr").alias("high_atr"),
        F.col("lo.low").alias("low"), F.col("lo.at").alias("low_i"), F.col("lo.open_time").alias("low_time"), F.col("lo.atr").alias("low_atr"),
        F.col("hc.close").alias("high_close"), F.greatest("hc.open", "hc.close").alias("top_high"), F.least("hc.open", "hc.close").alias("top_low"),
        F.col("lc.close").alias("low_close"), F.greatest("lc.open", "lc.close").alias("bottom_high"), F.least("lc.open", "lc.close").alias("bottom_low"),
        F.col("hco.v").alias("h"), (-F.col("hco.at")).alias("h_i"), F.col("hco.open_time").alias("h_time"),
        F.col("lco.v").alias("l"), F.col("lco.at").alias("l_i"), F.col("lco.open_time").alias("l_time"),
        F.col("head.atr").alias("first_atr"),
    )
    after = F.lead("start_i").over(by_wave())
    flat = flat.withColumns({"is_forming": after.isNull(), "formation_i": F.coalesce(after, F.col("end_i")), "formation_atr": F.lead("first_atr").over(by_wave())})
    side, name = F.when(F.col("is_up"), "up").otherwise("down"), F.concat(F.when(F.col("is_forming"), "forming-").otherwise("w-"), F.col("k").cast("string"))
    return flat.withColumns({"side": side, "wave_id": name})


def confirmed(table: DataFrame) -> DataFrame:
    return table.where(~F.col("is_forming"))


def swing(value: str, up: bool, back: int = 0) -> Column:
    """As of a wave, the value of the last confirmed top (up) or bottom, or of the one before (back=1, ...)."""
    here = F.lag(value, 2 * back).over(by_wave()) if back else F.col(value)
    other = F.lag(value, 2 * back + 1).over(by_wave())
    return F.when(F.col("is_up") == F.lit(up), here).otherwise(other)


def pullback(table: DataFrame) -> DataFrame:
    """Confirmed waves with length, breakout level, signed price difference and correction factor of their pullbacks."""
    up = F.col("is_up")

    def back(c: str, n: int) -> Column:
        return F.lag(c, n).over(by_wave())

    length = F.when(up, F.col("h_i") - back("l_i", 1) - 1).otherwise(F.col("l_i") - back("h_i", 1) - 1)
    level = F.when(up, back("l", 1)).otherwise(back("h", 1))
    diff = F.when(up, F.col("h") - back("l", 1)).otherwise(F.col("l") - back("h", 1))
    run = F.when(up, back("h", 2) - back("l", 1)).otherwise(back("h", 1) - back("l", 2))
    factor = F.when(run != 0, F.when(up, F.col("h") - back("l", 1)).otherwise(back("h", 1) - F.col("l")) / run)
    return table.withColumns({"pullback_length": length, "pullback_breakout_level": level, "pullback_price_diff": diff, "pullback_correction_factor": factor})


def metrics(table: DataFrame) -> DataFrame:
    """Confirmed waves with amplitude (in ATR at the confirming bar), slope, and ratios to the previous wave of the side."""
    amplitude = F.when(F.col("formation_atr") > 0, (F.col("high") - F.col("low")) / F.col("formation_atr"))
    rows = table.withColumn("amplitude", amplitude).withColumn("slope", F.col("amplitude") / F.col("n_bars"))
    old, size = F.lag("volume", 2).over(by_wave()), F.lag("amplitude", 2).over(by_wave())
    return rows.withColumns({"volume_ratio": F.when(old > 0, F.col("volume") / old), "amplitude_ratio": F.when(size > 0, F.col("amplitude") / size)})


def diverging(table: DataFrame) -> DataFrame:
    """Confirmed waves with diverging: prices go on and the histogram doesn't; null without a previous wave of the side."""
    price = F.when(F.col("is_up"), F.col("high_close") > F.lag("high_close", 2).over(by_wave())).otherwise(F.col("low_close") < F.lag("low_close", 2).over(by_wave()))
    oscillator = F.when(F.col("is_up"), F.col("hist_max") < F.lag("hist_max", 2).over(by_wave())).otherwise(F.col("hist_min") > F.lag("hist_min", 2).over(by_wave()))
    both = F.coalesce(price, F.lit(False)) & F.coalesce(oscillator, F.lit(False))
    return table.withColumn("diverging", F.when(F.lag("k", 2).over(by_wave()).isNotNull(), both))


#: The fewest waves a bounded memory can have: three-push looks at three of a side.
LEAST_WAVES = 6


class Counted:
    """Numbers in order, in buckets that are split as they grow, so that one more costs no walk over all."""

    LOAD = 512

    def __init__(self, values: Iterable[float] = ()) -> None:
        found = sorted(values)
        self.parts = [found[k : k + self.LOAD] for k in range(0, len(found), self.LOAD)]
        self.tops = [p[-1] for p in self.parts]

    def add(self, x: float) -> None:
        if not self.parts:
            self.parts, self.tops = [[x]], [x]
            return
        b = min(bisect.bisect_left(self.tops, x), len(self.parts) - 1)
        part = self.parts[b]
        bisect.insort(part, x)
        if len(part) > 2 * self.LOAD:
            self.parts[b : b + 1] = [part[: self.LOAD], part[self.LOAD :]]
            self.tops[b : b + 1] = [part[self.LOAD - 1], part[-1]]
        else:
            self.tops[b] = part[-1]

    def remove(self, x: float) -> None:
        b = bisect.bisect_left(self.tops, x)
        part = self.parts[b]
        del part[bisect.bisect_left(part, x)]
        if part:
            self.tops[b] = part[-1]
        else:
            del self.parts[b], self.tops[b]

    def below(self, x: float) -> int:
        b = bisect.bisect_left(self.tops, x)
        return sum(map(len, self.parts[:b])) + (bisect.bisect_left(self.parts[b], x) if b < len(self.parts) else 0)

    def upto(self, x: float) -> int:
        b = bisect.bisect_right(self.tops, x)
        return sum(map(len, self.parts[:b])) + (bisect.bisect_right(self.parts[b], x) if b < len(self.parts) else 0)


class FirstTouch:
    """The first of many (bottom, top, far) triples, in the order they came, with bottom <= high, top >= low and far >= high: a tree over
    their order, whose nodes have the lowest bottom, the highest top and the highest far of FAN nodes below. A node that can't hold an
    answer is passed over with all that is below it."""

    FAN, BITS = 32, 5

    def __init__(self) -> None:
        self.n, self.levels = 0, [np.empty((3, self.FAN))]

    def add(self, bottom: float, top: float, far: float) -> None:
        at = self.n
        for j in range(len(self.levels)):
            if at == self.levels[j].shape[1]:
                self.levels[j] = np.concatenate([self.levels[j], np.empty_like(self.levels[j])], 1)
            row = self.levels[j]
            if self.n & (1 << self.BITS * j) - 1 == 0:
                row[:, at] = bottom, top, far
            else:
                row[0, at], row[1, at], row[2, at] = min(row[0, at], bottom), max(row[1, at], top), max(row[2, at], far)
            at >>= self.BITS
        self.n += 1
        if (self.n - 1 >> self.BITS * len(self.levels)) + 1 > 1 or self.n == self.FAN ** len(self.levels):
            row = self.levels[-1][:, : (self.n - 1 >> self.BITS * (len(self.levels) - 1)) + 1]
            self.levels.append(np.empty((3, self.FAN)))
            self.levels[-1][:, 0] = row[0].min(), row[1].max(), row[2].max()

    def first(self, low: float, high: float, begin: int, end: int) -> int:
        """Its place, of those from begin to before end; -1 if there is none."""
        top = len(self.levels) - 1
        return self._search(top, 0, low, high, begin, end) if begin < end else -1

    def _search(self, j: int, at: int, low: float, high: float, begin: int, end: int) -> int:
        shift = self.BITS * j
        bottoms, tops, fars = self.levels[j][:, max(at, begin >> shift) : min(at + self.FAN if j < len(self.levels) - 1 else self.levels[j].shape[1], (end - 1 >> shift) + 1)]
        at = max(at, begin >> shift)
        for node in (np.flatnonzero((bottoms <= high) & (tops >= low) & (fars >= high)) + at).tolist():
            if j == 0:
                return node
            found = self._search(j - 1, node << self.BITS, low, high, begin, end)
            if found >= 0:
                return found
        return -1


class Side:
    """The tops (or bottoms) so far: the newest few as rows, and of all that aren't forgotten the body, the extreme and its time."""

    def __init__(self, up: bool, recent: int):
        self.up, self.keep, self.recent = up, max(recent, 1), []
        self._hold(np.empty((5, 0)))

    def _hold(self, held: np.ndarray) -> None:
        """Start with these rows: lower and upper end of the body, extreme, time, number of the wave."""
        self.n, self.begin = held.shape[1], 0
        self.rows = np.concatenate([held, np.empty((5, max(64, self.n)))], 1)
        self.starts, self.ends = Counted(held[0].tolist()), Counted(held[1].tolist())
        self._plant()

    def _plant(self) -> None:
        self.touch = FirstTouch()
        for a, b, far in self.rows[:3, : self.n].T.tolist():
            self.touch.add(*self._turned(a, b, far))

    def _turned(self, a: float, b: float, far: float) -> tuple[float, float, float]:
        """Bottoms are tops of the mirrored prices."""
        return (a, b, far) if self.up else (-b, -a, -far)

    def add(self, w: dict) -> None:
        if self.n == self.rows.shape[1]:
            if self.begin > self.n // 2:  # most are forgotten
                held = self.rows[:, self.begin : self.n]
                self.n, self.begin = held.shape[1], 0
                self.rows[:, : self.n] = held.copy()
                self._plant()
            else:
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)], 1)
        body = ("top_low", "top_high") if self.up else ("bottom_low", "bottom_high")
        a, b, far = float(w[body[0]]), float(w[body[1]]), float(w["high" if self.up else "low"])
        self.rows[:, self.n] = [a, b, far, w["high_time" if self.up else "low_time"], w["k"]]
        self.n += 1
        self.recent = [*self.recent, w][-self.keep :]
        self.starts.add(a)
        self.ends.add(b)
        self.touch.add(*self._turned(a, b, far))

    def forget(self, before: int) -> None:
        """Forget the waves before the one of this number."""
        while self.begin < self.n and self.rows[4, self.begin] < before:
            self.starts.remove(self.rows[0, self.begin])
            self.ends.remove(self.rows[1, self.begin])
            self.begin += 1
            self.recent = [w for w in self.recent if w["k"] >= before]

    def overlapping(self, low: float, high: float) -> int:
        """How many bodies meet [low, high]."""
        return self.starts.upto(high) - self.ends.below(low)

    def earliest(self, low: float, high: float, but: int) -> float:
        """The time of the first extreme at or beyond the zone [low, high] of a body that meets it; the newest `but` don't count."""
        at = self.touch.first(*((low, high) if self.up else (-high, -low)), self.begin, self.n - but)
        return float(self.rows[3, at]) if at >= 0 else float(np.inf)


class History:
    """What the wave kernel remembers of a symbol: open ranges for `since`, and the bodies of past tops and bottoms. With max_waves
    it forgets older waves, as a registry of so many waves does: then `since` ends at the first bar that is remembered."""

    def __init__(self, recent: int = 2, max_waves: int | None = None) -> None:
        self.max_waves = max_waves
        self.highs: list[tuple[float, int, int]] = []
        self.lows: list[tuple[float, int, int]] = []
        self.sides = {up: Side(up, recent) for up in (True, False)}
        self.begins: list[int] = []
        self.zone: dict[bool, dict | None] = {True: None, False: None}


def since(stack: list[tuple[float, int, int]], value: float, at: int, oldest: int, oldest_start: int) -> int:
    """Bars back to the latest earlier wave beyond value, or to the start of the oldest wave that is remembered; the stack keeps
    only waves that can still be the answer."""
    while stack and stack[-1][0] <= value:
        stack.pop()
    return at - stack[-1][1] - 1 if stack and stack[-1][2] >= oldest else at - oldest_start


def tolerance(atr: float | None, price: float, multiple: float, share: float) -> float:
    return multiple * atr if atr is not None and np.isfinite(atr) and atr > 0 else share * price


def zone_of(wave: dict, older: list[dict], between: list[float], proximity: int, multiple: float, share: float) -> dict:
    """The zone of an anchor and the older waves of its side, newest first; between[j] is the deepest low (highest high) of the
    waves between the anchor and older[j], None without a veto. Only the first `proximity` older waves can change the range."""
    up = wave["is_up"]
    sign = -1.0 if up else 1.0  # tops are bottoms of the mirrored prices
    low, high = (wave["top_low"], wave["top_high"]) if up else (wave["bottom_low"], wave["bottom_high"])
    wick = [wave["top_high"], wave["high"]] if up else [wave["low"], wave["bottom_low"]]
    edge = wave["high"] if up else wave["low"]
    limit = tolerance(wave["high_atr"] if up else wave["low_atr"], edge, multiple, share)
    zone = {"double": False, "near": []}
    for j, w in enumerate(older[:proximity]):
        a, b = (w["top_low"], w["top_high"]) if up else (w["bottom_low"], w["bottom_high"])
        meets = a <= high and b >= low
        if meets:
            zone["near"].append(w)
        extreme = w["high"] if up else w["low"]
        veto = between[j] is not None and (sign * between[j] < sign * edge or sign * between[j] < sign * extreme)
        if not veto and abs(extreme - edge) <= limit:
            zone["double"] = True
            if meets:
                low, high = (low, max(high, b)) if up else (min(low, a), high)
            other = [w["top_high"], w["high"]] if up else [w["low"], w["bottom_low"]]
            wick = [min(wick[0], other[0]), max(wick[1], other[1])]
    return zone | {"low": low, "high": high, "wick_low": wick[0], "wick_high": wick[1]}


KERNEL_SCHEMA = "symbol string, k int, since int, " + ", ".join(f"{s}_{c}" for s in ("support", "resistance") for c in ("low double", "high double", "wick_low double", "wick_high double", "double boolean", "overlaps int", "anchor_time double", "touches int", "formation_i int"))


def _zone_step(h: History, w: dict, proximity: int, multiple: float, share: float) -> None:
    up = w["is_up"]
    mine, others = h.sides[up], h.sides[not up]
    older = mine.recent[::-1][:proximity]
    between: list[float] = []
    deepest = None
    for j in range(len(older)):  # the waves between: one of the other side, then one of this side and one of the other ...
        for x in [older[j - 1]] * (j > 0) + [others.recent[-1 - j]]:
            v = x["high"] if up else x["low"]
            deepest = v if deepest is None else (max if up else min)(deepest, v)
        between.append(deepest)
    z = zone_of(w, older, between, proximity, multiple, share)
    count = mine.overlapping(z["low"], z["high"])
    keys = ("top_low", "top_high") if up else ("bottom_low", "bottom_high")
    count += len(z["near"]) - sum(1 for x in older if x[keys[0]] <= z["high"] and x[keys[1]] >= z["low"])
    first = min(w["high_time"], w["h_time"]) if up else min(w["low_time"], w["l_time"])
    if z["double"]:
        for x in z["near"]:
            if x["high"] >= z["high"] if up else x["low"] <= z["low"]:
                first = min(first, x["high_time"] if up else x["low_time"])
        first = min(first, mine.earliest(z["low"], z["high"], len(older)))
    h.zone[up] = {c: z[c] for c in ("low", "high", "wick_low", "wick_high", "double")} | {"overlaps": count, "anchor_time": float(first), "formation_i": w["formation_i"]}


def remember(h: History, w: dict) -> None:
    """Take one more confirmed wave into the history, and forget what is too old."""
    for stack, value, at in ((h.highs, w["h"], w["h_i"]), (h.lows, -w["l"], w["l_i"])):
        while stack and stack[-1][0] <= value:
            stack.pop()
        stack.append((value, int(at), w["k"]))
    h.sides[w["is_up"]].add(w)
    if h.max_waves is not None:
        h.begins = [*h.begins, int(w["start_i"])][-h.max_waves :]
        for side in h.sides.values():
            side.forget(w["k"] - h.max_waves + 1)
        # ranges that began in forgotten waves can't be an answer any more
        h.highs, h.lows = ([x for x in s if x[2] >= w["k"] - h.max_waves] if s and s[0][2] < w["k"] - h.max_waves else s for s in (h.highs, h.lows))


def wave_step(h: History, w: dict, proximity: int = 2, multiple: float = 0.3, share: float = 0.004) -> dict:
    """Take one more confirmed wave into the history; returns its row of KERNEL_SCHEMA. The zone of an anchor is fixed when the anchor is
    confirmed; only touches from the other side are counted anew."""
    up = w["is_up"]
    oldest = 0 if h.max_waves is None else max(0, w["k"] - h.max_waves)
    start = h.begins[0] if h.begins and h.max_waves is not None else 0
    # a wave's own extreme closes the ranges of smaller ones, on both sides
    high, low = since(h.highs, w["h"], int(w["h_i"]), oldest, start), since(h.lows, -w["l"], int(w["l_i"]), oldest, start)
    _zone_step(h, w, proximity, multiple, share)
    remember(h, w)
    row = {"symbol": w.get("symbol"), "k": w["k"], "since": high if up else low}
    for side, name in ((False, "support"), (True, "resistance")):
        z = h.zone[side]
        for c in ("low", "high", "wick_low", "wick_high", "double", "overlaps", "anchor_time", "formation_i"):
            row[f"{name}_{c}"] = z[c] if z else None
        row[f"{name}_touches"] = h.sides[not side].overlapping(z["low"], z["high"]) if z else None
    return row


KERNEL_FIELDS = ["k", "is_up", "start_i", "h", "h_i", "h_time", "l", "l_i", "l_time", "high", "high_time", "high_atr", "low", "low_time", "low_atr", "top_low", "top_high", "bottom_low", "bottom_high", "formation_i"]


def wave_history(table: DataFrame, proximity: int = 2, multiple: float = 0.3, share: float = 0.004, max_waves: int | None = None) -> DataFrame:
    """For each confirmed wave: since (bars back to a higher top, or lower bottom, of any wave), and the newest support and
    resistance zone as of it. History needs all earlier waves, in order: a few numbers of each, or of the newest max_waves only; counts
    of overlaps come from sorted edges, the search for earlier extremes from a stack, and a double zone looks once through a
    numpy column for the first touch."""

    def step(h: History, part: pd.DataFrame) -> pd.DataFrame:
        frame = pd.DataFrame([wave_step(h, w, proximity, multiple, share) for w in part.to_dict("records")], dtype=object)
        return frame[[c.split(" ")[0] for c in KERNEL_SCHEMA.split(", ")]]

    return along(confirmed(table).select("symbol", *KERNEL_FIELDS), lambda: History(proximity, max_waves), step, KERNEL_SCHEMA, ["k"])


#: Waves of a block of swing_distances.
DISTANCE_BLOCK = 1024


class Beyond:
    """Waves that no later one has gone beyond, oldest first: the latest one beyond a value is found by bisection."""

    def __init__(self) -> None:
        self.minus: list[float] = []
        self.of: list[tuple] = []

    def add(self, value: float, of: tuple) -> None:
        while self.minus and self.minus[-1] >= -value:
            self.minus.pop()
            self.of.pop()
        self.minus.append(-value)
        self.of.append(of)

    def latest(self, value: float) -> tuple | None:
        at = bisect.bisect_left(self.minus, -value) - 1
        return self.of[at] if at >= 0 else None


def _both() -> dict[bool, Beyond]:
    return {True: Beyond(), False: Beyond()}


def _in_block(sides: dict[bool, Beyond], part: pd.DataFrame) -> pd.DataFrame:
    """The latest wave of the block beyond each wave: its number and bar, of those before it or, for questions, of all."""
    found = []
    for k, up, h, h_i, low, l_i, ask in zip(*(part[c].tolist() for c in ("k", "is_up", "h", "h_i", "l", "l_i", "ask")), strict=True):
        found.append(sides[up].latest(h if up else -low))
        if not ask:
            sides[True].add(h, (k, h_i))
            sides[False].add(-low, (k, l_i))
    return pd.DataFrame([f or (None, None) for f in found], columns=["hit", "hit_i"], dtype=object)


def _of_blocks(sides: dict[bool, Beyond], part: pd.DataFrame) -> pd.DataFrame:
    """The latest earlier block that goes beyond each question; rows that don't ask are the blocks' own extremes."""
    found = []
    for block, up, h, low, ask in zip(*(part[c].tolist() for c in ("_block", "is_up", "h", "l", "ask")), strict=True):
        if ask:
            found.append(sides[up].latest(h if up else -low))
        else:
            found.append(None)
            sides[True].add(h, (block,))
            sides[False].add(-low, (block,))
    return pd.DataFrame([f or (None,) for f in found], columns=["from_block"], dtype=object)


def swing_distances(table: DataFrame, block: int = DISTANCE_BLOCK, max_waves: int | None = None) -> DataFrame:
    """symbol, k and since of each confirmed wave: bars from its extreme back to the latest earlier wave of any side that goes beyond it, or to
    the first bar that is remembered. Waves are dealt by blocks. Most find their answer in their own block; for the others a walk over the
    blocks' extremes names the block that has it, and they look there. So one symbol is as many tasks as it has blocks; only questions that
    a block can't answer, and one row for each block, meet by symbol."""
    own = confirmed(table).select("symbol", "k", "start_i", "is_up", "h", "h_i", "l", "l_i", F.floor(F.col("k") / block).cast("long").alias("_block"), F.lit(False).alias("ask"))

    def dealt(rows: DataFrame) -> DataFrame:
        return along(rows.withColumn("_part", F.concat_ws("\n", "symbol", "_block")), _both, _in_block, "hit long, hit_i long", ["ask", "k"], key="_part", fields=["k", "is_up", "h", "h_i", "l", "l_i", "ask"]).drop("_part")

    first = written(dealt(own), "swings-in-blocks")
    open_ = first.where("hit IS NULL").drop("hit", "hit_i").withColumn("ask", F.lit(True))
    extremes = first.groupBy("symbol", "_block").agg(F.max("h").alias("h"), F.min("l").alias("l")).select("symbol", F.lit(-1).cast("long").alias("k"), F.lit(True).alias("is_up"), "h", "l", "_block", F.lit(False).alias("ask"))
    met = open_.select(*extremes.columns).unionByName(extremes).withColumn("_later", ~F.col("ask"))
    named = along(met, _both, _of_blocks, "from_block long", ["_block", "_later"], fields=["_block", "is_up", "h", "l", "ask"]).where("ask AND from_block IS NOT NULL").select("symbol", "k", "from_block")
    asked = written(open_.join(named, ["symbol", "k"]).withColumn("_block", F.col("from_block")).select(*own.columns), "swings-asked")
    there = own.join(asked.select("symbol", "_block").distinct(), ["symbol", "_block"], "left_semi").select(*own.columns)
    told = dealt(there.unionByName(asked)).where("ask").select("symbol", "k", F.col("hit").alias("far"), F.col("hit_i").alias("far_i"))
    rows = first.join(told, ["symbol", "k"], "left").withColumns({"hit": F.coalesce("hit", "far"), "hit_i": F.coalesce("hit_i", "far_i")})
    at = F.when(F.col("is_up"), F.col("h_i")).otherwise(F.col("l_i"))
    oldest = F.coalesce(F.lag("start_i", max_waves).over(by_wave()), F.lit(0)) if max_waves is not None else F.lit(0)
    known = F.col("hit").isNotNull() & (F.col("hit") >= F.col("k") - (max_waves if max_waves is not None else F.col("k")))
    return rows.select("symbol", "k", F.when(known, at - F.col("hit_i") - 1).otherwise(at - oldest).cast("int").alias("since"))


def evicted(table: DataFrame, max_waves: int) -> DataFrame:
    """The waves of a bounded registry: the forming one and the newest max_waves confirmed ones of each symbol."""
    newest = F.max("k").over(Window.partitionBy("symbol"))
    return table.withColumn("_newest", newest).where(F.col("is_forming") | (F.col("_newest") - F.col("k") <= max_waves)).drop("_newest")


def alternation_faults(table: DataFrame) -> DataFrame:
    """Waves on the same side as the one before them. There are none in a sound table."""
    return table.withColumn("_before", F.lag("side").over(by_wave())).where("_before = side").drop("_before")


def alternating(table: DataFrame) -> DataFrame:
    """The same waves; reading one that is on the same side as the one before it is an error."""
    said = F.concat(F.lit("wave "), F.col("wave_id"), F.lit(" of "), F.col("symbol"), F.lit(" is on the same side as the one before it"))
    return table.withColumn("side", F.when(F.lag("side").over(by_wave()) == F.col("side"), F.raise_error(said)).otherwise(F.col("side")))


def bar_counts(bars: DataFrame) -> DataFrame:
    """Registered bars of each symbol: different open_times."""
    return bars.groupBy("symbol").agg(F.countDistinct("open_time").alias("n_bars"))
