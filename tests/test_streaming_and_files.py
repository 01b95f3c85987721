"""Streams against the batch query; files written and read again."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_structure import walk
from tidewave.operators import timeframes
from tidewave.operators.projection import check_columns, project
from tidewave.sources import bars as src
from tidewave.streaming.bars import closed_bars
from tidewave.streaming.structure import BarProcessor, LateBarError, Symbol, stream_higher, stream_structure, symbol_states, with_counts

SF = "/root/testdata/sf0.001"


def run(stream, name, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).start()
    q.processAllAvailable()
    q.stop()


def test_closed_bars_equal_the_batch_bars(spark, tmp_path):
    ticks = spark.read.parquet(f"{SF}/events.parquet")
    ticks.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    run(closed_bars(stream, F.col("event_type"), F.col("ts"), F.col("value"), F.col("value"), F.col("event_id")), "closed", tmp_path / "c")
    got = {(r.symbol, r.open_time): (r.open, r.high, r.low, r.close) for r in spark.table("closed").collect()}
    batch = src.resample(ticks, F.col("event_type"), src.millis(F.col("ts")), F.col("value"), F.col("value"), 4 * 3_600_000, [F.col("event_id")])
    want = {(r.symbol, r.open_time): (r.open, r.high, r.low, r.close) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 10


def cells(rows, names):
    """Rows as text; floats to nine digits, and wave ids by their number."""
    cell = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v.rsplit("-", 1)[1] if isinstance(v, str) and "-" in v else v
    return sorted(str((r.symbol, r.open_time, *(cell(r[f"ms_{n}"]) for n in names))) for r in rows)


@pytest.mark.parametrize(("name", "columns", "options"), [("whole", None, {"max_waves": None}), ("bounded", None, {"max_waves": 8, "retest_mode": "close"}), ("few", ["last_top_price", "is_trending_up", "atr", "wave_id"], {"max_waves": None})])
def test_stream_equals_batch(spark, tmp_path, name, columns, options):
    schema = "symbol string, open_time long, open double, high double, low double, close double, volume double"
    for part in range(3):  # the second file repeats bars of the first one
        rows = [(s, t, o, h, lo, c, 1.0 + t % 7) for s, seed in (("a", 1), ("b", 2)) for t, o, h, lo, c, _ in walk(240, seed)[max(0, part * 80 - 5) : part * 80 + 80]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(stream_structure(stream, columns, **options), f"structure_{name}", tmp_path / "c")
    batch = spark.createDataFrame([(s, t, o, h, lo, c, 1.0 + t % 7) for s, seed in (("a", 1), ("b", 2)) for t, o, h, lo, c, _ in walk(240, seed)], schema)
    names = check_columns(columns)
    want, got = cells(project(batch, columns, **options).collect(), names), cells(spark.table(f"structure_{name}").collect(), names)
    assert len(want) == 480 and got == want


def test_a_registry_of_all_waves_forgets_nothing(spark):
    bars = spark.createDataFrame([("a", t, o, h, lo, c, 1.0) for t, o, h, lo, c, _ in walk(200, 4)], "symbol string, open_time long, open double, high double, low double, close double, volume double")
    assert cells(project(bars, None, max_waves=1000).collect(), check_columns(None)) == cells(project(bars, None).collect(), check_columns(None))
    with pytest.raises(ValueError, match="max_waves"):
        project(bars, None, max_waves=2)


def test_state_survives_as_text():
    make = lambda saved, waves: Symbol(None, 12, 8, 4, 14, 20, "wick", saved, json.loads(json.dumps(waves), object_hook=lambda d: {int(k) if k.isdigit() else k: v for k, v in d.items()}))
    one = make(None, {})
    out = []
    for t, o, h, lo, c, x in walk(80, 6):
        bar = {"open_time": t, "open": o, "high": h, "low": lo, "close": c, "volume": 1.0}
        two = make(one.saved(), one.held)
        out.append(one.bar(bar, float(x), 1.0))
        assert two.bar(bar, float(x), 1.0) == out[-1]
    assert len({str(x[2:]) for x in out}) > 40
    assert issubclass(LateBarError, ValueError)


BAR_SCHEMA = "symbol string, open_time long, open double, high double, low double, close double, volume double"


def bar_rows(n, seed, symbol="a", step=1):
    return [(symbol, t * step, o, h, lo, c, 1.0 + t % 7) for t, o, h, lo, c, _ in walk(n, seed)]


def stream_of(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, BAR_SCHEMA).coalesce(1).write.parquet(str(folder / f"{k}"))
        for f in (folder / f"{k}").glob("part-*"):
            f.rename(folder / f"{k}-{f.name}")
    return spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder / "*.parquet"))


def test_late_bars_are_marked_and_counted(spark, tmp_path):
    rows = bar_rows(60, 3)
    late = [rows[4], rows[30], rows[31]]
    broken = ("a", 50_500, 1.0, None, 1.0, 1.0, 1.0)
    parts = [rows[:40], [*rows[40:50], rows[39], *late, broken, rows[45]], rows[50:]]
    (tmp_path / "in").mkdir()
    marked = with_counts(stream_structure(stream_of(spark, tmp_path / "in", parts), ["wave_id", "last_top_price"], late="mark"))
    q = marked.writeStream.format("memory").queryName("marked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    seen = [p["observedMetrics"]["bars"] for p in q.recentProgress if p["observedMetrics"]]
    q.stop()
    got = spark.table("marked").collect()
    assert sorted((r.open_time, r.status) for r in got if r.status) == sorted([(rows[4][1], "late"), (rows[30][1], "late"), (rows[31][1], "late"), (rows[39][1], "repeated"), (rows[45][1], "repeated"), (50_500, "broken")])
    assert len([r for r in got if not r.status]) == 60 and all(r.ms_wave_id is None for r in got if r.status) and len(got) == sum(map(len, parts))
    total = {k: sum(p[k] for p in seen) for k in ("taken", "late", "repeated", "broken")}
    assert total == {"taken": 60, "late": 3, "repeated": 2, "broken": 1}
    with pytest.raises(ValueError, match="late is one of"):
        stream_structure(marked, late="hide")


@pytest.mark.parametrize("max_waves", [None, 8])
def test_a_stream_goes_on_where_a_batch_ends(spark, tmp_path, max_waves):
    rows = {s: bar_rows(240, seed, s) for s, seed in (("a", 1), ("b", 2), ("c", 3))}
    old = [r for s in "ab" for r in rows[s][:150]]  # c has no history
    new = [[r for s in "abc" for r in rows[s][0 if s == "c" else 150 : 200]], [r for s in "abc" for r in rows[s][200:]]]
    states = symbol_states(spark.createDataFrame(old, BAR_SCHEMA).repartition(3), max_waves=max_waves)
    states.write.parquet(str(tmp_path / "states"))
    (tmp_path / "in").mkdir()
    stream = stream_structure(stream_of(spark, tmp_path / "in", new), max_waves=max_waves, history=spark.read.parquet(str(tmp_path / "states")))
    name = f"handover_{max_waves}"
    run(stream, name, tmp_path / "c")
    whole = project(spark.createDataFrame([r for s in rows.values() for r in s], BAR_SCHEMA), max_waves=max_waves).where("symbol = 'c' OR open_time >= 150000")
    names = check_columns(None)
    assert cells(spark.table(name).collect(), names) == cells(whole.collect(), names)
    with pytest.raises(ValueError, match="can't be used"):
        Symbol(None, 12, 8, 4, 15, max_waves, "wick", states.first().saved)


def test_a_stream_of_higher_timeframes_equals_the_batch(spark, tmp_path):
    hour = 3_600_000
    rows = [r for s, seed in (("a", 4), ("b", 5)) for r in bar_rows(300, seed, s, step=3600)]
    rows = [r for k, r in enumerate(rows) if k % 41 not in (7, 8, 9, 10, 11)]  # gaps of more than a higher bar
    parts = [[r for r in rows if a <= r[1] // hour < b] for a, b in ((0, 90), (90, 91), (91, 220), (220, 300))]
    (tmp_path / "in").mkdir()
    run(stream_higher(stream_of(spark, tmp_path / "in", parts), htf="4h", ltf="1h", max_waves=None), "higher", tmp_path / "c")
    names = check_columns(None)
    whole = timeframes.project_higher(spark.createDataFrame(rows, BAR_SCHEMA), htf="4h", ltf="1h")
    shown = lambda df: df.select("symbol", "open_time", *(F.col(f"ms_4h_{c}").alias(f"ms_{c}") for c in names)).collect()
    got = shown(spark.table("higher"))
    assert cells(got, names) == cells(shown(whole), names) and len(got) == len(rows)
    assert all(r.ms_wave_count is None for r in got if r.open_time < 4 * hour)


class Held:
    """Stands for a value and a map of a state store, and counts what is written."""

    def __init__(self):
        self.value, self.entries, self.written = None, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.written = value, self.written + len(value[0])

    def iterator(self):
        return iter(self.entries.items())

    def updateValue(self, key, value):  # noqa: N802
        self.entries[key], self.written = value, self.written + len(value[0])

    def removeKey(self, key):  # noqa: N802
        del self.entries[key]

    def getValueState(self, *_):  # noqa: N802
        return self

    def getMapState(self, *_):  # noqa: N802
        return self


def test_what_a_batch_writes_does_not_grow_with_the_memory():
    rows = pd.DataFrame(bar_rows(3000, 8), columns=["symbol", "open_time", "open", "high", "low", "close", "volume"])
    written, held = {}, {}
    for max_waves in (20, 400):
        store = Held()
        p = BarProcessor(None, (12, 8, 4, 14, max_waves, "wick"), "drop", "ms_")
        p.init(store)
        for at in range(0, 3000, 30):
            before = store.written
            assert len(pd.concat(p.handleInputRows(("a",), iter([rows[at : at + 30]]), None))) == 30
        written[max_waves], held[max_waves] = store.written - before, len(store.entries)
    assert held[20] == 20 and held[400] > 300
    assert written[400] < 1.1 * written[20]


def test_json_files(spark, tmp_path):
    bars = [{"openTime": f"2025-01-01T0{h}:00:00+00:00", "open": 1.0 + h, "high": 3.0, "low": 0.5, "close": 2.0, "volume": 5.0} for h in range(3)]
    (tmp_path / "BTCUSDT.json").write_text(json.dumps(bars))
    rows = src.read_ohlcv_json(spark, str(tmp_path / "BTCUSDT.json")).orderBy("open_time").collect()
    assert [(r.symbol, r.open_time, r.open, r.hist) for r in rows][:2] == [("BTCUSDT", 1735689600000, 1.0, 0.0), ("BTCUSDT", 1735693200000, 2.0, 0.0)]
    trade = {"pair": "BTC/USDT:USDT", "open_date": "2025-01-01 00:00:00+00:00", "close_date": "2025-01-01 04:00:00", "is_short": True, "open_rate": 1.0, "close_rate": 0.9, "profit_ratio": 0.1, "profit_abs": 30.0, "exit_reason": "roi", "enter_tag": None, "stake_amount": 300.0}
    (tmp_path / "t.json").write_text(json.dumps({"strategy": "s", "pair": "BTC/USDT:USDT", "trades": [trade]}))
    table = src.read_trades_json(spark, str(tmp_path / "t.json"))
    r = table.first()
    assert (r.pair, r.open_time, r.close_time, r.is_short) == ("BTCUSDT", 1735689600, 1735704000, True)
    src.write_trades_json(table, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().profit_abs == 30.0


def test_projected_json(spark, tmp_path):
    frame = spark.createDataFrame([("a", t, o, h, lo, c, 1.0) for t, o, h, lo, c, _ in walk(40, 3)], "symbol string, open_time long, open double, high double, low double, close double, volume double")
    src.write_projected_json(project(frame, ["wave_id", "support_zone_anchor_time", "last_top_price"]), str(tmp_path / "p"))
    back = src.read_projected(spark, str(tmp_path / "p"), "a")
    assert back.count() == 40 and back.where("time = 3").count() == 1
    assert src.read_projected(spark, str(tmp_path / "p"), "absent").count() == 0


def test_bad_times_are_errors(spark):
    with pytest.raises(Exception, match="(?i)parse|cast|malformed"):
        spark.createDataFrame([("nonsense",)], "t string").select(src.iso_seconds(F.col("t"))).collect()
