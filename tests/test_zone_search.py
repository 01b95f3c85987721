"""Sorted edges, the tree of first touches, taken prices, and drawdowns by blocks, against plain walks."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import accessors, trades
from tidewave.operators import waves as wv


def wave(rng, k, level):
    a, b, c, d = sorted(level + rng.gauss(0, 2) for _ in range(4))
    return {"k": k, "bottom_low": b, "bottom_high": c, "top_low": b, "top_high": c, "low": a, "high": d, "low_time": 10.0 * k, "high_time": 10.0 * k + 1}


@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize("keep", [None, 40, 700])
def test_a_side_equals_a_walk_over_all_waves(up, keep):
    rng, side, waves, level = random.Random(keep), wv.Side(up, 2), [], 100.0
    body, far, at = (("top_low", "top_high"), "high", "high_time") if up else (("bottom_low", "bottom_high"), "low", "low_time")
    for k in range(2500):
        level += rng.gauss(0, 1)
        waves.append(wave(rng, k, level))
        side.add(waves[-1])
        if keep:
            side.forget(k - keep + 1)
            waves = [w for w in waves if w["k"] >= k - keep + 1]
        if k % 10 == 0:
            low = level + rng.gauss(0, 10)
            high, but = low + rng.random() * 4, min(2, len(waves))
            meets = [w for w in waves if w[body[0]] <= high and w[body[1]] >= low]
            assert side.overlapping(low, high) == len(meets)
            touch = [w[at] for w in meets if w in waves[: len(waves) - but] and (w[far] >= high if up else w[far] <= low)]
            assert side.earliest(low, high, but) == min(touch, default=np.inf)


def test_a_wave_costs_about_the_same_however_many_there_are():
    """Adding and asking among the last 10,000 of 110,000 waves takes no more than a few times what it takes among the first ones."""
    rng, side, level, took = random.Random(1), wv.Side(True, 2), 100.0, {}
    for k in range(110_000):
        if k % 10_000 == 0:
            began = time.process_time()
        level += rng.gauss(0, 1)
        side.add(wave(rng, k, level))
        side.overlapping(level, level + 2)
        side.earliest(level, level + 2, 2)
        if k % 10_000 == 9_999:
            took[k // 10_000] = time.process_time() - began
    assert took[10] < 6 * took[1]


def test_first_touch_at_its_levels_ends():
    for n in (1, 31, 32, 33, 1023, 1024, 1025, 1057):
        tree = wv.FirstTouch()
        for k in range(n):
            tree.add(0.0, 1.0, float(k))
        assert [tree.first(0.5, x, 0, n) for x in (0.75, n - 1.0 or 0.5, n + 1.0)] == [min(1, n - 1) if n > 1 else -1, n - 1 if n > 1 else -1, -1] or n == 1
        assert tree.first(0.5, 0.0, n - 1, n) == n - 1 and tree.first(0.5, 0.0, n, n) == -1


def test_taken_prices():
    rng, taken, zones = random.Random(3), accessors.Taken(), []
    for _ in range(600):
        low = rng.random() * 100
        high = low + rng.random()
        assert taken.meets(low, high) == any(a <= high and b >= low for a, b in zones)
        if rng.random() < 0.3:
            taken.add(low, high)
            zones.append((low, high))
    assert taken.starts == sorted(taken.starts) and all(b < a for b, a in zip(taken.ends, taken.starts[1:], strict=False))


def test_distinct_zones_of_many_waves(spark):
    n = 50_000
    table = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").alias("k"), F.concat(F.lit("w-"), "id").alias("wave_id"), (F.col("id") % 2 == 0).alias("is_up"), (F.col("id") == n - 1).alias("is_forming"), (100 + 50 * F.sin(F.col("id") / 700) + F.rand(1)).alias("m"))
    table = table.select("*", (F.col("m") + 1).alias("high"), (F.col("m") - 1).alias("low"), F.lit(1.0).alias("high_atr"), F.lit(1.0).alias("low_atr"), *((F.col("m") + d).alias(c) for c, d in (("top_low", 0.5), ("top_high", 0.8), ("bottom_low", -0.8), ("bottom_high", -0.5))))
    found = accessors.zones(table, "resistance", max_waves=None).orderBy("place").collect()
    rows = {r.wave_id: r for r in table.collect()}
    assert len(found) > 30 and [int(r.anchor_wave_id[2:]) for r in found] == sorted((int(r.anchor_wave_id[2:]) for r in found), reverse=True)
    for n, z in enumerate(found[:40]):
        a = rows[z.anchor_wave_id]
        assert not any(x.low <= a.top_high and x.high >= a.top_low for x in found[:n])
        assert set(z.overlap_high_ids) == {w for w, r in rows.items() if r.is_up and not r.is_forming and r.k < a.k and r.top_low <= z.high and r.top_high >= z.low}


@pytest.mark.parametrize("span", [1, 5000, trades.SPAN])
def test_drawdown_by_blocks(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["s", "t", None]), "p", n, 0, rng.randrange(0, 100_000, 100) if n else None, False, 0.0, rng.choice([float(rng.randrange(-90, 80)), None])) for n in range(900)]
    df = spark.createDataFrame(rows, "strategy string, pair string, seq long, open_time long, close_time long, is_short boolean, profit_ratio double, profit_abs double")
    want = {}
    for key in ("s", "t", None):
        equity = peak = 1000.0
        worst = 0.0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[4] is not None, r[4], r[2])):
            equity += r[7] or 0.0
            peak = max(peak, equity)
            worst = max(worst, (peak - equity) / peak)
        want[key] = round(worst * 100, 9)
    assert {r.strategy: round(r.max_drawdown, 9) for r in trades.drawdown(df, "strategy", "pair", span=span).collect()} == want
    assert trades.drawdown(df, span=span).count() == 1


@pytest.mark.parametrize(("block", "max_waves"), [(1, None), (7, None), (50, None), (50, 20), (1024, 9)])
def test_swing_distances_by_blocks(spark, block, max_waves):
    """Against a walk back over all waves; rising, falling and level runs, and a symbol of one wave."""
    rng = random.Random(block)
    rows, at = [], 0
    for symbol, n in (("a", 400), ("b", 1), ("c", 160)):
        at, level = 0, 50.0
        for k in range(n):
            level += 1.0 if k % 100 < 30 else -1.0 if k % 100 < 60 else rng.choice([-2.0, 0.0, 2.0])
            size = rng.randrange(1, 6)
            rows.append((symbol, k, at, k % 2 == 0, level + rng.randrange(3), at + rng.randrange(size), level - rng.randrange(3), at + rng.randrange(size), k == n - 1 and n > 1))
            at += size
    table = spark.createDataFrame(rows, "symbol string, k long, start_i int, is_up boolean, h double, h_i int, l double, l_i int, is_forming boolean").repartition(5)
    want = {}
    for symbol in "abc":
        mine = [r for r in rows if r[0] == symbol and not r[8]]
        for _, k, _, up, h, h_i, low, l_i, _ in mine:
            oldest = 0 if max_waves is None else max(0, k - max_waves)
            hit = next((w for w in reversed(mine[oldest:k]) if (w[4] > h if up else w[6] < low)), None)
            here = h_i if up else l_i
            want[symbol, k] = here - (hit[5] if up else hit[7]) - 1 if hit else here - mine[oldest][2]
    assert {(r.symbol, r.k): r.since for r in wv.swing_distances(table, block, max_waves).collect()} == want
