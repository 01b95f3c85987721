"""Lifecycles by blocks against the machine bar by bar: eras of all lengths, blocks of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from tidewave.operators import lifecycle
from tidewave.operators.lifecycle import EVENTS, Zone

SCHEMA = "symbol string, i int, support_zone_low double, support_zone_high double, resistance_zone_low double, resistance_zone_high double, high double, low double, close double, note string"


def bars(n, seed, symbol="a", change=0.1):
    """Prices around zones that change, go, and come back."""
    rng = random.Random(seed)
    zones = [None, (9.0, 10.0), (9.0, 11.0), (12.0, 13.0), (9.0, 10.0)]
    a, b = zones[1], zones[3]
    rows = []
    for i in range(n):
        if rng.random() < change:
            a = rng.choice(zones)
        if rng.random() < change:
            b = rng.choice(zones)
        close = rng.choice([7, 8, 9, 9.5, 10, 11, 12, 12.5, 13, 14])
        rows.append((symbol, i, *(a or (None, None)), *(b or (None, None)), close + rng.choice([0.0, 1.0]), close - rng.choice([0.0, 1.0]), float(close), f"n{i}"))
    return rows


def plain(rows, mode):
    """Events and counts of each bar by the machine, one symbol after another."""
    out, nan = {}, float("nan")
    for symbol in {r[0] for r in rows}:
        sides = {"support": Zone(1), "resistance": Zone(-1)}
        for s, i, sl, sh, rl, rh, high, low, close, _ in rows:
            if s != symbol:
                continue
            turned = {"support": (nan if sh is None else sh, nan if sl is None else sl, close, high), "resistance": (nan if rl is None else -rl, nan if rh is None else -rh, -close, -low)}
            out[s, i] = tuple(x for name, zone in sides.items() for x in zone.bar(*turned[name], mode == "wick"))
    return out


def found(df):
    def one(r, s):
        return next((e for e in EVENTS if r[f"zone_{e}_{s}"]), None), r[f"zone_retest_count_{s}"]

    return {(r.symbol, r.i): (*one(r, "support"), *one(r, "resistance")) for r in df.collect()}


@pytest.mark.parametrize("mode", ["wick", "close"])
@pytest.mark.parametrize("block", [1, 2, 7, 512])
def test_blocks_equal_the_machine(spark, mode, block):
    rows = bars(300, block) + bars(5, 2, "b") + bars(260, 3, "c", change=0.004)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(lifecycle.with_lifecycle(df, mode, block)) == plain(rows, mode)


def test_one_era_of_many_bars(spark):
    rows = [("a", i, 9.0, 10.0, None, None, c + 0.5, c - 0.5, c, "") for i, c in enumerate(random.Random(4).choices([8.0, 9.5, 10.5], k=100_000))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lifecycle.with_lifecycle(df)
    assert found(got) == plain(rows, "wick")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    spread = lifecycle.with_lifecycle(df.repartition(4)).select("symbol", F.floor(F.col("i") / lifecycle.BLOCK).alias("b"), F.spark_partition_id().alias("p")).distinct().groupBy("symbol").agg(F.countDistinct("b").alias("blocks"), F.countDistinct("p").alias("tasks"))
    r = spread.first()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert r.blocks == 196 and r.tasks > 1


def test_rows_keep_their_columns_and_no_python_is_planned(spark):
    rows = bars(40, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    out = lifecycle.with_lifecycle(df, block=8)
    assert out.columns[: len(df.columns)] == df.columns and len(out.columns) == len(df.columns) + 10
    assert sorted(map(tuple, out.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()
    assert lifecycle.with_lifecycle(df.where("false")).collect() == []
