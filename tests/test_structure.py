"""Hand-made cases of waves, zones, lifecycles, timeframes, spans and trades."""

import random

import pytest
from pyspark.sql import functions as F

from tidewave.operators import accessors, lifecycle, spans, strategies, timeframes, trades
from tidewave.operators import waves as wv
from tidewave.operators.projection import ALL_COLUMNS, check_columns, project
from tidewave.sources.bars import normalise, quarantined

BARS = "symbol string, open_time long, open double, high double, low double, close double, volume double, hist double"
SEVEN = [
    (1000, 100, 105, 98, 103, 0.4), (2000, 102, 110, 100, 108, 0.2), (3000, 107, 109, 101, 106, -0.1), (4000, 104, 106, 97, 98, -0.3),
    (5000, 99, 103, 96, 101, 0.2), (6000, 100, 108, 99, 107, 0.5), (7000, 106, 107, 95, 96, -0.4),
]


def frame(spark, rows, symbol="a"):
    return spark.createDataFrame([(symbol, t, *map(float, (o, h, lo, c)), 1.0, None if x is None else float(x)) for t, o, h, lo, c, x in rows], BARS)


def walk(n, seed, symbol="a"):
    rng = random.Random(seed)
    price, rows = 100.0, []
    for t in range(n):
        o = price
        price = max(1.0, price + rng.choice([-2, -1, -0.5, 0.5, 1, 2]))
        rows.append((t * 1000, o, max(o, price) + rng.choice([0, 0.5]), min(o, price) - rng.choice([0, 0.5]), price, rng.choice([-1, -1, 1, 1, 0])))
    return rows


def test_seven_bars(spark):
    rows = project(frame(spark, SEVEN), ["wave_side", "wave_id", "last_top_price", "last_bottom_price", "made_higher_high", "made_lower_high", "made_higher_low", "wave_count", "bars_since_last_top", "bars_since_last_bottom", "high_since"], hist="hist").orderBy("open_time").collect()
    assert [r.ms_wave_id for r in rows] == ["w-0", "w-0", "w-1", "w-1", "w-2", "w-2", "forming-3"]
    assert [r.ms_wave_side for r in rows] == ["up", "up", "down", "down", "up", "up", "down"]
    last = rows[-1]
    assert (last.ms_last_top_price, last.ms_last_bottom_price, last.ms_made_higher_high, last.ms_made_lower_high, last.ms_made_higher_low) == (107.0, 98.0, False, True, None)
    assert (last.ms_wave_count, last.ms_bars_since_last_top, last.ms_bars_since_last_bottom, last.ms_high_since) == (3, 0, 2, 3)
    assert rows[0].ms_last_top_price is None and rows[0].ms_wave_count == 0


def test_empty_single_and_flat_frames(spark):
    for rows, n in (([], 0), (SEVEN[:1], 1), ([(t * 1000, 5, 5, 5, 5, None) for t in range(30)], 30)):
        out = project(frame(spark, rows))
        assert len(out.columns) == 7 + len(ALL_COLUMNS) and out.count() == n
    flat = project(frame(spark, [(t * 1000, 5, 5, 5, 5, None) for t in range(30)]), ["wave_side", "wave_count"]).distinct().select("ms_wave_side").distinct().collect()
    assert [r[0] for r in flat] == ["down"]


def test_order_symbols_and_partitions_do_not_matter(spark):
    a, b = walk(120, 1), walk(90, 2)
    wanted = ["wave_id", "support_zone_low", "resistance_zone_high", "zone_break_support", "atr", "trend_duration"]
    alone = sorted(map(str, project(frame(spark, a), wanted).collect() + project(frame(spark, b, "b"), wanted).collect()))
    mixed = frame(spark, a).unionByName(frame(spark, b, "b")).orderBy(F.rand(3)).repartition(7)
    assert sorted(map(str, project(mixed, wanted).collect())) == alone


def test_unknown_columns_are_an_error():
    with pytest.raises(ValueError, match="nonsense"):
        check_columns(["nonsense"])
    assert check_columns(()) == [] and len(check_columns(None)) == 67


def test_bad_bars_are_put_aside(spark):
    nan = float("nan")
    rows = [("a", 1, 2.0, 3.0, 1.0, 2.0), ("a", 2, 2.0, None, 1.0, 2.0), ("a", 3, 2.0, 3.0, 1.0, nan), ("b", 1, 2.0, 3.0, 1.0, 2.0), (None, 1, 2.0, 3.0, 1.0, 2.0), ("b", None, 2.0, 3.0, 1.0, 2.0), ("c", 1, 2.0, 1.5, 1.0, 2.0), ("c", 2, 2.0, 3.0, 2.5, 2.0), ("d", 5, 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame([(*r, 1.0) for r in rows], "symbol string, open_time long, open double, high double, low double, close double, volume double")
    sound, bad = quarantined(bars)
    assert sorted((r.symbol, r.open_time) for r in sound.collect()) == [("a", 1), ("b", 1), ("d", 5)] and sound.columns == bars.columns
    assert sorted((str(r.symbol), r.open_time, r.fault) for r in bad.collect() if r.open_time) == [("None", 1, "no symbol"), ("a", 2, "no price"), ("a", 3, "no price"), ("c", 1, "prices out of order"), ("c", 2, "prices out of order")]
    sound, bad = quarantined(bars, whole_symbols=True)
    assert [r.symbol for r in sound.collect()] == ["d"] and bad.count() == 8 and bad.where("fault IS NULL").count() == 2
    assert project(quarantined(bars)[0], ["atr"]).count() == 3


def test_alternation_is_enforced(spark):
    waves = spark.createDataFrame([("a", k, f"w-{k}", s) for k, s in enumerate("up down up up".split())], "symbol string, k long, wave_id string, side string")
    assert wv.alternating(waves.where("k < 3")).count() == 3
    with pytest.raises(Exception, match="wave w-3 of a is on the same side"):
        wv.alternating(waves).collect()


def test_nulls_and_nan_count_as_down(spark):
    bars = spark.createDataFrame([("a", 1000 * t, 1.0, 2.0, 0.5, 1.0, 1.0, x) for t, x in enumerate([None, float("nan"), 0.0, -1.0])], BARS)
    assert [r.is_up for r in wv.segment(normalise(bars, "hist")).orderBy("i").collect()] == [False, False, True, False]


def brute_zones(waves, up, include_forming, proximity, only_overlapping, only_newest):
    """Zones as the rules tell them, one comparison after another."""
    s = -1 if up else 1
    body = (lambda w: (-w["top_high"], -w["top_low"])) if up else (lambda w: (w["bottom_low"], w["bottom_high"]))
    edge = (lambda w: -w["high"]) if up else (lambda w: w["low"])
    far = (lambda w: (-w["bottom_high"], -w["bottom_low"])) if up else (lambda w: (w["top_low"], w["top_high"]))
    anchors = [w for w in reversed(waves) if w["is_up"] == up and (include_forming or not w["is_forming"])]
    out = []
    for w in anchors:
        low, high = body(w)
        if only_newest and any(x["low"] <= high and x["high"] >= low for x in out):
            continue
        atr = w["high_atr"] if up else w["low_atr"]
        limit = 0.3 * atr if atr is not None and atr > 0 else 0.004 * abs(edge(w))
        wick, double, ids = [edge(w), body(w)[0]], False, []
        for n, o in enumerate(x for x in anchors if x["k"] < w["k"]):
            meets = body(o)[0] <= high and body(o)[1] >= low
            if meets:
                ids.append(o["wave_id"])
            between = [edge_x for x in waves if o["k"] < x["k"] < w["k"] and not w["is_forming"] for edge_x in [(-x["high"] if up else x["low"])]]
            if n < proximity and not any(v < edge(w) or v < edge(o) for v in between) and abs(edge(o) - edge(w)) <= limit:
                double = True
                low = min(low, body(o)[0]) if meets else low
                wick = [min(wick[0], edge(o)), max(wick[1], body(o)[0])]
        others = [x["wave_id"] for x in waves if x["is_up"] != up and not x["is_forming"] and far(x)[0] <= high and far(x)[1] >= low]
        out.append({"low": low, "high": high, "wick": wick, "double": double, "ids": ids, "others": others, "anchor": w["wave_id"]})
    out = [z for z in out if z["ids"] or not only_overlapping]
    turn = lambda a, b: tuple(sorted((s * a, s * b)))
    return [(z["anchor"], *turn(z["low"], z["high"]), *turn(*z["wick"]), z["double"], z["ids"], z["others"]) for z in out]


@pytest.mark.parametrize("options", [{}, {"include_forming": True}, {"only_newest": False, "proximity": 5}, {"only_overlapping": True, "proximity": 1}])
def test_zone_lists_equal_brute_force(spark, options):
    bars = wv.segment(frame(spark, walk(150, 5)).withColumn("atr", F.when(F.col("open_time") % 3000 == 0, F.lit(1.5))))
    table = wv.waves(bars)
    waves = [r.asDict() for r in table.orderBy("k").collect()]
    full = {"include_forming": False, "proximity": 2, "only_overlapping": False, "only_newest": True} | options
    for side in ("support", "resistance"):
        up = side == "resistance"
        found = accessors.zones(table, side, **options).orderBy("place").collect()
        got = [(r.anchor_wave_id, r.low, r.high, r.wick_low, r.wick_high, r.is_double, list(r.overlap_high_ids if up else r.overlap_low_ids), list(r.overlap_low_ids if up else r.overlap_high_ids)) for r in found]
        assert got == brute_zones(waves, up, **full)


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_broken_between_equals_brute_force(spark, n):
    """All distances, ends in either order, ends that aren't there; nothing runs while the plan is made."""
    rng = random.Random(n)
    waves = [{"low": float(rng.randrange(50)), "high": float(50 + rng.randrange(50))} for _ in range(n)]
    table = spark.createDataFrame([("a", k, w["low"], w["high"], False) for k, w in enumerate(waves)] + [("a", n, 0.0, 200.0, True), ("b", 0, 1.0, 2.0, False)], "symbol string, k long, low double, high double, is_forming boolean")
    pairs = {(rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(400)} | {(0, n - 1), (n - 1, 0), (0, n)}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    out = accessors.broken_between(table, spark.createDataFrame([("a", *p) for p in pairs], "symbol string, a long, b long"))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup()) == list(jobs)

    def broken(a, b):
        if max(a, b) >= n:
            return False, False
        inside = waves[min(a, b) + 1 : max(a, b)]
        return any(w["low"] < max(waves[a]["low"], waves[b]["low"]) for w in inside), any(w["high"] > min(waves[a]["high"], waves[b]["high"]) for w in inside)

    assert {(r.a, r.b): (r.lower_low_between, r.higher_high_between) for r in out.collect()} == {p: broken(*p) for p in pairs}
    if n == 700:
        near = spark.createDataFrame([("a", a, a - d) for a in range(60, 90) for d in range(1, 10)], "symbol string, a long, b long")
        assert {(r.a, r.b): (r.lower_low_between, r.higher_high_between) for r in accessors.broken_between(table, near, apart=9).collect()} == {(r.a, r.b): broken(r.a, r.b) for r in near.collect()}
        with pytest.raises(Exception, match="more than 3 waves apart"):
            accessors.broken_between(table, near, apart=3).collect()


def test_zone_lists_without_a_bound_keep_the_oldest_waves(spark):
    table = wv.waves(wv.segment(frame(spark, walk(2500, 5)).withColumn("atr", F.lit(1.5))))
    waves = [(r.wave_id, r.is_up) for r in wv.confirmed(table).orderBy(F.desc("k")).collect()]
    assert len(waves) > accessors.MAX_WAVES
    found = accessors.zones(table, "support", only_newest=False, max_waves=None).orderBy("place").collect()
    assert [r.anchor_wave_id for r in found] == [w for w, up in waves if not up]


def test_lifecycle_of_a_support(spark):
    closes = [(9, 10.5), (9, 9.5), (10.5, 11.5), (9, 9.5), (9, 9.0), (12, 12.5), (12, 13)]  # close, high of a zone 10 to 11
    rows = [("a", n, 10.0, 11.0, None, None, float(h), 5.0, float(c)) for n, (c, h) in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, i int, support_zone_low double, support_zone_high double, resistance_zone_low double, resistance_zone_high double, high double, low double, close double")
    for mode, events in (("wick", ["break", None, "retest", "flip", "break", "retest", "failed_retest"]), ("close", ["break", None, "retest", "flip", "break", None, None])):
        got = lifecycle.with_lifecycle(df, mode).orderBy("i").collect()
        assert [next((e for e in lifecycle.EVENTS if r[f"zone_{e}_support"]), None) for r in got] == events
        assert not any(r.zone_break_resistance for r in got)


@pytest.mark.parametrize(("htf", "ltf"), [("1h", "4h"), ("1h", "1h"), ("90m", "1h"), ("x", "1h")])
def test_bad_timeframes(htf, ltf):
    with pytest.raises(ValueError):
        timeframes.check_timeframes(htf, ltf)


def test_higher_timeframe_does_not_look_ahead(spark):
    rows = walk(200, 9)
    hour = frame(spark, [(t * 3600, *r) for t, *r in rows])
    wanted = ["wave_id", "last_top_price", "wave_count"]
    whole = {r.open_time: r for r in timeframes.project_higher(hour, wanted, htf="4h", ltf="1h", hist="hist").collect()}
    assert len(whole) == 200
    assert all(whole[t * 3_600_000].ms_4h_wave_count is None for t in range(4)) and whole[4 * 3_600_000].ms_4h_wave_count == 0
    part = {r.open_time: r for r in timeframes.project_higher(hour.where("open_time < 100 * 3600000"), wanted, htf="4h", ltf="1h", hist="hist").collect()}
    assert all(part[t].ms_4h_last_top_price == whole[t].ms_4h_last_top_price for t in part)


def test_spans_end_where_the_next_begins(spark):
    df = spark.createDataFrame([("a", t, up, down) for t, (up, down) in enumerate([(False, False), (True, False), (True, False), (False, True), (False, False), (True, False)])], "symbol string, open_time long, ms_is_trending_up boolean, ms_is_trending_down boolean")
    assert sorted((r.start_time, r.end_time, r.direction) for r in spans.trend_spans(df).collect()) == [(1, 3, "up"), (3, 4, "down"), (5, 5, "up")]


TRADES = "strategy string, pair string, seq long, open_time long, close_time long, is_short boolean, profit_ratio double, profit_abs double"


def test_trade_statistics(spark):
    rows = [("s", "p", 0, 0, 7200, False, 0.1, 30.0), ("s", "p", 1, 0, 7200, True, -0.05, -15.0), ("s", "p", 2, 7200, 21600, False, 0.0, 0.0)]
    df = spark.createDataFrame(rows, TRADES)
    r = trades.stats(df, "strategy").first()
    assert (r.total_trades, r.long_count, r.short_count) == (3, 2, 1)
    assert (round(r.win_rate, 4), r.profit_factor, r.total_pnl, round(r.avg_loss_pct, 4)) == (33.3333, 2.0, 15.0, -2.5)
    assert round(trades.drawdown(df, "strategy").first().max_drawdown, 6) == round(15 / 1030 * 100, 6)
    none = trades.overall(df.where("false")).first()
    assert (none.total_trades, none.win_rate, none.profit_factor, none.expectancy) == (0, 0.0, 0.0, 0.0)
    assert trades.stats(df.where("seq = 0"), "strategy").first().profit_factor == float("inf")


def test_stake_scale(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.85,), (0.9,), (1.2,), (None,)], "ms_pullback_correction_factor double")
    assert [r[0] for r in df.select(strategies.stake_scale(F.lit(100.0), 35.0, 80.0)).collect()] == [50.0, 80.0, 80.0, 60.0, 35.0, 100.0]
