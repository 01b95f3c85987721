"""Life of a zone: intact, broken, retested, and back to intact by a flip or a failed retest.

The states go in a circle of three, so what a bar does is a map of three states to three, and what a run of bars does is the maps' composition.
An era is a run of bars with one zone; a new zone (or none) starts again. Bars are dealt by blocks of their symbol: a block is folded to
one map, the maps of a symbol's blocks are composed in order, and with the state it begins in each block is folded once more for its events.
So a symbol, and a long era too, is as many tasks as it has blocks, and bars never leave the JVM. A stream has the machine itself (Zone).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = ("break", "retest", "flip", "failed_retest")
INTACT, BROKEN, RETESTED = 0, 1, 2


class Zone:
    """State of one side."""

    def __init__(self, sign: float):
        self.sign, self.state, self.count, self.bounds = sign, INTACT, 0, None

    def bar(self, near: float, far: float, close: float, reach: float, wick: bool) -> tuple[str | None, int]:
        """One bar in prices turned so that the zone is a support: far is its lower bound, near the upper one, reach the bar's
        end towards it from below. Returns the event and the retest count."""
        if np.isnan(near) or np.isnan(far):
            self.state, self.count, self.bounds = INTACT, 0, None
            return None, 0
        if self.bounds != (near, far):
            self.state, self.count, self.bounds = INTACT, 0, (near, far)
        event = None
        if self.state == INTACT and close < far:
            self.state, event = BROKEN, "break"
        elif self.state == BROKEN and (reach >= far if wick else far <= close <= near):
            self.state, event, self.count = RETESTED, "retest", self.count + 1
        elif self.state == RETESTED and (close < far or close > near):
            event = "flip" if close < far else "failed_retest"
            self.state, self.count = INTACT, 0
        return event, self.count


#: Bars of a block: the unit of work, and of memory.
BLOCK = 512
SIDES = ("support", "resistance")
#: What a bar does: digits of a number. The last says whether the close is beyond the zone, the next whether the bar comes back to it, the next
#: whether the close leaves it on either side, then whether there is no zone, then whether the zone is another one than at the bar before.
BEYOND, BACK, LEFT, NONE, NEW = 1, 2, 4, 8, 16


def turned(side: str) -> tuple[Column, Column, Column, Column]:
    """Near and far bound, close, and the bar's end towards the zone from beyond it, in prices turned so that the zone is a support."""

    def number(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    if side == "support":
        return number("support_zone_high"), number("support_zone_low"), number("close"), number("high")
    return -number("resistance_zone_low"), -number("resistance_zone_high"), -number("close"), -number("low")


def doing(side: str, wick: bool, in_order: Column) -> Column:
    """What a bar does on a side, as a number (see above). in_order: the bar is not the first of its block."""
    near, far, close, reach = turned(side)
    back = reach >= far if wick else close.between(far, near)
    block = Window.partitionBy("symbol", "block").orderBy("i")
    new = in_order & ~(near.eqNullSafe(F.lag(near).over(block)) & far.eqNullSafe(F.lag(far).over(block)))
    flags = {BEYOND: close < far, BACK: back, LEFT: (close < far) | (close > near), NONE: near.isNull() | far.isNull(), NEW: new}
    return sum((F.when(flag, bit).otherwise(0) for bit, flag in flags.items()), F.lit(0)).cast("int")


def has(does: Column, bit: int) -> Column:
    return does.bitwiseAND(F.lit(bit)) != 0


def moved(state: Column, does: Column) -> Column:
    """The state after a bar."""
    before = F.when(has(does, NEW), INTACT).otherwise(state)
    after = F.when(before == INTACT, has(does, BEYOND).cast("int")).when(before == BROKEN, has(does, BACK).cast("int") + BROKEN).otherwise(F.when(has(does, LEFT), INTACT).otherwise(RETESTED))
    return F.when(has(does, NONE), INTACT).otherwise(after).cast("int")


def told(state: Column, does: Column, after: Column) -> Column:
    """A letter for what has happened at a bar: its event, else r for retested or a dot."""
    before = F.when(has(does, NEW), INTACT).otherwise(state)
    event = F.when((before == INTACT) & (after == BROKEN), "B").when((before == BROKEN) & (after == RETESTED), "R").when((before == RETESTED) & (after == INTACT), F.when(has(does, BEYOND), "F").otherwise("X"))
    return F.when(has(does, NONE), ".").otherwise(F.coalesce(event, F.when(after == RETESTED, "r").otherwise(".")))


def block_map(does: Column) -> Column:
    """The state after a block's bars for each state before them."""
    return F.aggregate(does, F.array(F.lit(INTACT), F.lit(BROKEN), F.lit(RETESTED)), lambda m, d: F.transform(m, lambda s: moved(s, d)))


def block_story(does: Column, state: Column) -> Column:
    """A letter for each bar of a block (see told), from the state it begins in."""
    start = F.struct(state.cast("int").alias("s"), F.lit("").alias("text"))

    def step(acc: Column, d: Column) -> Column:
        after = moved(acc["s"], d)
        return F.struct(after.alias("s"), F.concat(acc["text"], told(acc["s"], d, after)).alias("text"))

    return F.aggregate(does, start, step, lambda acc: acc["text"])


def states_before(blocks: DataFrame) -> DataFrame:
    """symbol, block and for each side the state its first bar meets. A symbol is a row of its blocks' maps here, not of its bars."""
    edges = [F.struct(F.col("bars")[0][c].alias("a"), F.element_at("bars", -1)[c].alias("z")).alias(c) for s in SIDES for c in (f"near_{s}", f"far_{s}")]
    rows = blocks.select("symbol", "block", *edges, *(block_map(F.col(f"bars.does_{s}")).alias(f"map_{s}") for s in SIDES))
    names = [*(f"{c}_{s}" for s in SIDES for c in ("near", "far")), *(f"map_{s}" for s in SIDES)]
    rows = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", *names))).alias("blocks"))

    def entered(s: str, acc: Column, b: Column) -> Column:
        """The state of acc, if the zone is still the same."""
        same = b[f"near_{s}"]["a"].eqNullSafe(acc[f"near_{s}"]) & b[f"far_{s}"]["a"].eqNullSafe(acc[f"far_{s}"])
        return F.when(same, acc[f"state_{s}"]).otherwise(INTACT).cast("int")

    def step(acc: Column, b: Column) -> Column:
        found = {s: entered(s, acc, b) for s in SIDES}
        fields = [x for s in SIDES for x in (b[f"near_{s}"]["z"].alias(f"near_{s}"), b[f"far_{s}"]["z"].alias(f"far_{s}"), F.get(b[f"map_{s}"], found[s]).alias(f"state_{s}"))]
        return F.struct(*fields, F.concat(acc["out"], *(found[s].cast("string") for s in SIDES)).alias("out"))

    nothing = F.lit(None).cast("double")
    start = F.struct(*(x for s in SIDES for x in (nothing.alias(f"near_{s}"), nothing.alias(f"far_{s}"), F.lit(INTACT).alias(f"state_{s}"))), F.lit("").alias("out"))
    rows = rows.select("symbol", F.transform("blocks", lambda b: b["block"]).alias("numbers"), F.split(F.aggregate("blocks", start, step, lambda acc: acc["out"]), "").alias("out"))
    rows = rows.select("symbol", "out", F.posexplode("numbers").alias("n", "block"))
    return rows.select("symbol", "block", *(F.get("out", F.col("n") * 2 + k).cast("int").alias(f"state_{s}") for k, s in enumerate(SIDES)))


def with_lifecycle(rows: DataFrame, retest_mode: str = "wick", block: int = BLOCK) -> DataFrame:
    """rows (with i, bounds of both zones, high, low, close) with the ten lifecycle columns."""
    wick = retest_mode == "wick"
    dealt = rows.withColumn("block", F.floor(F.col("i") / block).cast("long"))
    inside = F.col("i") % block != 0
    extra = {f"does_{s}": doing(s, wick, inside) for s in SIDES} | {f"{n}_{s}": turned(s)[k] for s in SIDES for k, n in enumerate(("near", "far"))}
    dealt = dealt.withColumns(extra)
    blocks = dealt.groupBy("symbol", "block").agg(F.sort_array(F.collect_list(F.struct("i", *(c for c in rows.columns if c not in ("symbol", "i")), *extra))).alias("bars"))
    both = blocks.join(states_before(blocks), ["symbol", "block"])
    stories = [F.split(block_story(F.col(f"bars.does_{s}"), F.col(f"state_{s}")), "").alias(f"story_{s}") for s in SIDES]
    bars = both.select("symbol", "bars", *stories).select("symbol", F.explode(F.arrays_zip("bars", *(f"story_{s}" for s in SIDES))).alias("x"))
    letters = {"break": "B", "retest": "R", "flip": "F", "failed_retest": "X"}
    events = [(F.col(f"x.story_{s}") == letter).alias(f"zone_{e}_{s}") for e, letter in letters.items() for s in SIDES]
    counts = [F.col(f"x.story_{s}").isin("R", "r").cast("int").alias(f"zone_retest_count_{s}") for s in SIDES]
    return bars.select(*(F.col("symbol") if c == "symbol" else F.col(f"x.bars.{c}").alias(c) for c in rows.columns), *events, *counts)
