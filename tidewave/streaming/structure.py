"""Structure of a stream of bars, bar by bar: the columns of project(), as the batch query gives them for closed bars.

State of a symbol: averages, the forming wave, the newest few confirmed waves, the columns as of the last one and the lifecycle of both
zones are one value; the waves that zones and distances look back at, the newest max_waves only, are entries of a map, written when a wave
is confirmed and removed when it is forgotten. So what a micro-batch writes doesn't grow with max_waves. Both are JSON text, which holds
floats exactly. Bars of a micro-batch are sorted before they are folded in. symbol_states() has the same state after a batch of bars, so that a
stream can go on where a table ends.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewave.operators import lifecycle
from tidewave.operators import waves as wv
from tidewave.operators.indicators import Ema, Oscillator, advance, along, plain
from tidewave.operators.projection import LIFE, WHOLE, ZONES, check_columns
from tidewave.operators.timeframes import check_timeframes

EMAS = ("up", "up2", "size", "size2", "signal")
TEXTS = ("wave_side", "wave_id")
SIDES = ("support", "resistance")
#: Confirmed waves that ratios, divergences and pushes look at.
NEWEST = 5


class LateBarError(ValueError):
    """A bar came that is older than one already taken."""


def kind_of(column: str) -> str:
    if column in TEXTS:
        return "string"
    if column in WHOLE:
        return "long"
    flags = ("made_", "is_", "three_", "sfp_")
    return "boolean" if column.startswith(flags) or column.endswith(("_divergence", "_confirmed", "_is_double")) or column in LIFE else "double"


def output_schema(columns: Iterable[str] | None, prefix: str = "ms_") -> str:
    return "symbol string, open_time long, close double, " + ", ".join(f"{prefix}{c} {kind_of(c)}" for c in check_columns(columns))


def clean(x: float | None) -> float | None:
    return None if x is None or np.isnan(x) else float(x)


def less(a: float | None, b: float | None) -> bool | None:
    return None if a is None or b is None else a < b


def ratio(a: float | None, b: float | None) -> float | None:
    """a / b where b is above 0."""
    return a / b if a is not None and b is not None and b > 0 else None


class Forming:
    """The wave that is not over: what waves() aggregates, bar by bar. Of equal extremes the earlier bar counts."""

    def __init__(self, saved: dict | None = None):
        self.w = saved or {}

    def add(self, b: dict, i: int, up: bool, hist: float | None, atr: float | None) -> None:
        w, t = self.w, b["open_time"]
        if not w:
            w.update(is_up=up, start_i=i, n_bars=0, volume=None, hist_max=None, hist_min=None)
        first = w["n_bars"] == 0
        w["n_bars"] += 1
        if b["volume"] is not None:
            w["volume"] = (w["volume"] or 0.0) + b["volume"]
        if hist is not None:
            w["hist_max"] = hist if w["hist_max"] is None else max(w["hist_max"], hist)
            w["hist_min"] = hist if w["hist_min"] is None else min(w["hist_min"], hist)
        top, bottom = max(b["open"], b["close"]), min(b["open"], b["close"])
        if first or b["high"] > w["high"]:
            w.update(high=b["high"], high_i=i, high_time=t, high_atr=atr)
        if first or b["low"] < w["low"]:
            w.update(low=b["low"], low_i=i, low_time=t, low_atr=atr)
        if first or b["close"] > w["high_close"]:
            w.update(high_close=b["close"], top_high=top, top_low=bottom)
        if first or b["close"] < w["low_close"]:
            w.update(low_close=b["close"], bottom_high=top, bottom_low=bottom)
        if first or top > w["h"]:
            w.update(h=top, h_i=i, h_time=t)
        if first or bottom < w["l"]:
            w.update(l=bottom, l_i=i, l_time=t)


def facts(w: dict, waves: list[dict]) -> dict:
    """Pullback, metrics and divergence of a wave; waves: those before it, oldest first."""
    one, two = (waves[-1] if waves else None), (waves[-2] if len(waves) > 1 else None)
    up, out = w["is_up"], {"pullback_length": None, "pullback_breakout_level": None, "pullback_price_diff": None, "pullback_correction_factor": None}
    if one:
        out["pullback_length"] = w["h_i"] - one["l_i"] - 1 if up else w["l_i"] - one["h_i"] - 1
        level = out["pullback_breakout_level"] = one["l"] if up else one["h"]
        out["pullback_price_diff"] = w["h"] - level if up else w["l"] - level
        if two and (run := two["h"] - one["l"] if up else one["h"] - two["l"]) != 0:
            out["pullback_correction_factor"] = (w["h"] - one["l"] if up else one["h"] - w["l"]) / run
    amplitude = ratio(w["high"] - w["low"], w["formation_atr"])
    out |= {"amplitude": amplitude, "slope": None if amplitude is None else amplitude / w["n_bars"], "volume_ratio": ratio(w["volume"], two["volume"]) if two else None, "amplitude_ratio": ratio(amplitude, two["amplitude"]) if two else None}
    out["diverging"] = None
    if two:
        price = two["high_close"] < w["high_close"] if up else w["low_close"] < two["low_close"]
        out["diverging"] = price and bool(less(w["hist_max"], two["hist_max"]) if up else less(two["hist_min"], w["hist_min"]))
    four = waves[-4] if len(waves) > 3 else None
    out["pushes"] = False
    if four:
        size = [x["high"] - x["low"] for x in (w, two, four)]
        price = [x["h"] if up else -x["l"] for x in (w, two, four)]
        out["pushes"] = size[0] < size[1] < size[2] and price[0] > price[1] > price[2] and price[0] - price[1] < price[1] - price[2]
    return out


def quality(overlaps: int, double: bool, width: float, atr: float | None, age: int, touches: int) -> float:
    """As projection.quality."""
    narrow = max(0.0, 2.0 - width / atr * 2) if atr is not None and atr > 0 else 0.0
    return min(min(overlaps, 5) * 0.8 + (2.0 if double else 0.0) + narrow + 2.0 * math.exp(-age / 100) + min(touches, 3) * 0.7, 10.0)


class Symbol:
    """The state of one symbol."""

    def __init__(self, columns: Iterable[str] | None, r: int, s: int, signal: int, period: int, max_waves: int | None, retest_mode: str, saved: str | None, waves: dict[int, dict] | None = None):
        self.columns, self.max_waves, self.wick = check_columns(columns), max_waves, retest_mode == "wick"
        self.zoned = bool(set(self.columns) & set(ZONES + LIFE))
        self.osc = Oscillator(r, s, signal, period)
        d = json.loads(saved) if saved else {}
        #: What a state can be gone on with.
        self.made_for = [self.zoned, r, s, signal, period, max_waves, retest_mode]
        if saved and d["made_for"] != self.made_for:
            raise ValueError(f"a state made for {d['made_for']} can't be used for {self.made_for}")
        for name, last in d.get("emas", {}).items():
            ema: Ema = getattr(self.osc, name)
            ema.last = np.nan if last is None else last
        for name in ("close", "atr"):
            setattr(self.osc, name, d[name] if d.get(name) is not None else np.nan)
        self.osc.first = d.get("first", [])
        self.last_time, self.i, self.k, self.up = d.get("last_time"), d.get("i", -1), d.get("k", 0), d.get("up")
        self.forming, self.waves, self.snap = Forming(d.get("forming")), d.get("waves", []), d.get("snap", {})
        self.before, self.runs = d.get("before", {}), d.get("runs", [0, 0])
        self.top_i, self.bottom_i, self.calm = d.get("top_i"), d.get("bottom_i"), d.get("calm", -1)
        self.zones = {"support": lifecycle.Zone(1), "resistance": lifecycle.Zone(-1)}
        for name, (state, count, bounds) in d.get("zones", {}).items():
            z = self.zones[name]
            z.state, z.count, z.bounds = state, count, tuple(bounds) if bounds else None
        self.history = wv.History(2, max_waves)
        #: Waves in the history by number, those that are new since the state was read, and those that are gone since.
        self.held, self.added, self.dropped = dict(waves or {}), set(), set()
        for k in sorted(self.held):
            wv.remember(self.history, self.held[k])
        self.history.zone = dict(zip((True, False), d.get("zone", (None, None)), strict=True))

    def saved(self) -> str:
        o, h = self.osc, self.history
        plain = {n: getattr(self, n) for n in ("last_time", "i", "k", "up", "waves", "snap", "before", "runs", "top_i", "bottom_i", "calm")}
        held = {"zone": [h.zone[True], h.zone[False]], "made_for": self.made_for}
        emas = {n: clean(getattr(o, n).last) for n in EMAS}
        zones = {n: (z.state, z.count, z.bounds) for n, z in self.zones.items()}
        return json.dumps(plain | held | {"forming": self.forming.w, "zones": zones, "emas": emas, "close": clean(o.close), "atr": clean(o.atr), "first": [float(x) for x in o.first]})

    def confirm(self, atr: float | None) -> None:
        """The forming wave is over: this bar is the first of the next one."""
        w = self.forming.w | {"k": self.k, "formation_i": self.i, "formation_atr": atr}
        w |= facts(w, self.waves)
        up = w["is_up"]
        last = self.waves[-1] if self.waves else None
        same = [*[x for x in self.waves if x["is_up"] == up], w]
        other = [x for x in self.waves if x["is_up"] != up]
        tops, bottoms = ([x["h"] for x in (same if up else other)][-2:], [x["l"] for x in (other if up else same)][-2:])
        t0, t1 = (tops[-1] if tops else None), (tops[-2] if len(tops) > 1 else None)
        b0, b1 = (bottoms[-1] if bottoms else None), (bottoms[-2] if len(bottoms) > 1 else None)
        hh, hl, lh, ll = less(t1, t0), less(b1, b0), less(t0, t1), less(b0, b1)
        rises, falls = bool(hh and hl), bool(lh and ll)
        self.runs[self.k % 2] = self.runs[self.k % 2] + 1 if rises or falls else 0
        run = self.runs[self.k % 2] if self.max_waves is None else min(self.runs[self.k % 2], self.max_waves // 2 - 1)
        pushed = bool(last and last["pushes"])
        div = last["diverging"] if last else None
        diff = w["pullback_price_diff"]
        self.snap = {
            "last_top_price": t0, "last_bottom_price": b0, "made_higher_high": hh, "made_higher_low": hl, "made_lower_high": lh, "made_lower_low": ll,
            "trend_wave_count": run, "structure_break_level": b0 if rises else t0 if falls else None,
            "three_push_up": w["pushes"] if up else pushed, "three_push_down": pushed if up else w["pushes"],
            "bearish_divergence": w["diverging"] if up else div, "bullish_divergence": div if up else w["diverging"],
            "wave_length": w["n_bars"], "wave_amplitude": w["amplitude"], "wave_slope": w["slope"], "wave_volume": w["volume"],
            "wave_volume_ratio": w["volume_ratio"], "wave_amplitude_ratio": w["amplitude_ratio"],
            "pullback_length": w["pullback_length"], "pullback_correction_factor": w["pullback_correction_factor"],
            "pullback_breakout_level": w["pullback_breakout_level"], "pullback_price_diff": diff,
            "pullback_atr_factor": ratio(None if diff is None else abs(diff), atr), "rises": rises, "falls": falls,
        }
        if self.zoned:
            kept = {c: w[c] for c in wv.KERNEL_FIELDS}
            found = wv.wave_step(self.history, kept)
            self.held[self.k] = kept
            self.added.add(self.k)
            if self.max_waves is not None and self.held.pop(self.k - self.max_waves, None):
                self.dropped.add(self.k - self.max_waves)
            w["since"] = found["since"]
            own, prev = w["since"], last["since"] if last else None
            self.snap |= {"high_since": own if up else prev, "low_since": prev if up else own}
            for s in SIDES:
                z = {c: found[f"{s}_{c}"] for c in ("low", "high", "wick_low", "wick_high", "double", "overlaps", "anchor_time", "formation_i", "touches")}
                self.snap |= {f"{s}_zone_low": z["low"], f"{s}_zone_high": z["high"], f"{s}_zone_wick_low": z["wick_low"], f"{s}_zone_wick_high": z["wick_high"], f"{s}_is_double": z["double"], f"{s}_overlap_count": z["overlaps"], f"{s}_zone_anchor_time": z["anchor_time"]}
                self.snap[f"zone_quality_{s}"] = None if z["low"] is None else quality(z["overlaps"], z["double"], z["high"] - z["low"], atr, self.i - z["formation_i"], z["touches"])
        self.waves = [*self.waves, w][-NEWEST:]
        if up:
            self.top_i = self.i
        else:
            self.bottom_i = self.i
        self.k, self.forming = self.k + 1, Forming()

    def bar(self, b: dict, hist: float, atr: float) -> list:
        """Take one more bar; returns its wanted columns."""
        up, hist, atr = bool(hist >= 0), clean(hist), clean(atr)
        self.i += 1
        if self.up is not None and up != self.up:
            self.confirm(atr)
        self.up = up
        self.forming.add(b, self.i, up, hist, atr)
        w, s, close = self.forming.w, self.snap, b["close"]
        top, bottom, level = s.get("last_top_price"), s.get("last_bottom_price"), s.get("structure_break_level")
        rises, falls = s.get("rises", False), s.get("falls", False)
        rising = rises and not (not up and w["low"] <= bottom)
        falling = falls and not (up and w["high"] >= top)
        if not (rising or falling):
            self.calm = self.i
        now = {
            "broken": (close < level if rises else close > level) if level is not None else False, "level": level, "top": top, "bottom": bottom,
            "sfp_high": top is not None and b["high"] > top > close, "sfp_low": bottom is not None and b["low"] < bottom < close,
            "up": s.get("three_push_up", False), "down": s.get("three_push_down", False),
        }
        was, self.before = self.before, now

        def edge(flag: str, at: str | None = None) -> bool:
            return now[flag] and (not was.get(flag, False) or (at is not None and now[at] != was.get(at)))

        out = s | {
            "wave_side": "up" if up else "down", "wave_id": f"forming-{self.k}", "wave_count": self.k if self.max_waves is None else min(self.k, self.max_waves),
            "forming_wave_high": w["high"], "forming_wave_low": w["low"], "atr": atr, "trend_wave_count": s.get("trend_wave_count", 0),
            "is_trending_up": rising, "is_trending_down": falling, "trend_duration": self.i - self.calm - 1 if rising or falling else None,
            "structure_break_confirmed": edge("broken", "level"), "sfp_high": edge("sfp_high", "top"), "sfp_low": edge("sfp_low", "bottom"),
            "three_push_up": edge("up"), "three_push_down": edge("down"),
            "bars_since_last_top": None if self.top_i is None else self.i - self.top_i, "bars_since_last_bottom": None if self.bottom_i is None else self.i - self.bottom_i,
        }
        if self.zoned:
            low, high, near, far = (s.get(c) for c in ("support_zone_low", "support_zone_high", "resistance_zone_low", "resistance_zone_high"))
            out |= {"distance_to_support": (close - high) / atr if high is not None and atr else None, "distance_to_resistance": (near - close) / atr if near is not None and atr else None}
            nan = math.nan
            turned = {"support": (nan if high is None else high, nan if low is None else low, close, b["high"]), "resistance": (nan if near is None else -near, nan if far is None else -far, -close, -b["low"])}
            for name, args in turned.items():
                event, count = self.zones[name].bar(*args, self.wick)
                out |= {f"zone_{e}_{name}": e == event for e in lifecycle.EVENTS} | {f"zone_retest_count_{name}": count}
        return [b["open_time"], close, *(out.get(c) for c in self.columns)]


    def take(self, bars: pd.DataFrame) -> list[list]:
        """Take bars in order of time, none of them late or repeated; returns a row of bar() for each."""
        if not len(bars):
            return []
        high, low, close = (bars[c].to_numpy(np.float64) for c in ("high", "low", "close"))
        _, _, hist, atr = advance(self.osc, high, low, close)
        records = [{"open_time": int(b["open_time"]), "volume": clean(b["volume"])} | {c: float(b[c]) for c in ("open", "high", "low", "close")} for b in bars.to_dict("records")]
        self.last_time = records[-1]["open_time"]
        return [self.bar(b, h, a) for b, h, a in zip(records, hist, atr, strict=True)]


#: What can keep a bar from being taken.
LATE, REPEATED, BROKEN = "late", "repeated", "broken"
DROP, FAIL, MARK = "drop", "fail", "mark"


def sorted_out(bars: pd.DataFrame, last_time: int | None) -> pd.DataFrame:
    """bars in order of time, with status: null for those to be taken. A bar without a price is broken, one before last_time late; one whose
    open_time has been taken is repeated."""
    bars = bars.sort_values("open_time", kind="stable", ignore_index=True)
    broken = bars[["open_time", "open", "high", "low", "close"]].isna().any(axis=1).to_numpy()
    time = bars["open_time"].to_numpy(np.float64, na_value=np.nan)
    known = -np.inf if last_time is None else last_time
    first = pd.Series(np.where(broken, np.nan, time)).duplicated().to_numpy()
    status = np.select([broken, time < known, (time == known) | first], [BROKEN, LATE, REPEATED], default="")
    return bars.assign(status=pd.Series(status, dtype=object).replace("", None))


class BarProcessor(StatefulProcessor):
    """Folds new bars of a symbol into its state. A repeated open_time keeps its first version. What isn't taken is dropped, is an error
    (fail: late and broken bars), or has a row with its status and no columns (mark)."""

    def __init__(self, columns: Iterable[str] | None, options: tuple, late: str, prefix: str):
        self.columns, self.options, self.late = check_columns(columns), options, late
        self.kinds = {f"{prefix}{c}": {"string": "object", "long": "Int64", "boolean": "boolean", "double": "float64"}[kind_of(c)] for c in self.columns}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("symbol", "saved string")
        self.waves = handle.getMapState("waves", "k long", "wave string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.state.update((row["saved"],))
        for w in json.loads(row["waves"]):
            self.waves.updateValue((w["k"],), (json.dumps(w),))

    def read(self) -> Symbol:
        saved = self.state.get()
        waves = {int(k[0]): json.loads(w[0]) for k, w in self.waves.iterator()} if saved else {}
        return Symbol(self.columns, *self.options, saved[0] if saved else None, waves)

    def write(self, symbol: Symbol) -> None:
        for k in sorted(symbol.added & symbol.held.keys()):
            self.waves.updateValue((k,), (json.dumps(symbol.held[k]),))
        for k in sorted(symbol.dropped - symbol.added):
            self.waves.removeKey((k,))
        self.state.update((symbol.saved(),))

    def told(self, key: tuple, bars: pd.DataFrame, rows: list[list]) -> pd.DataFrame:
        """Output: rows of the bars that were taken, and with `mark` of those that weren't."""
        good = bars["status"].isna()
        out = pd.DataFrame([[key[0], *r] for r in rows], columns=["symbol", "open_time", "close", *self.kinds])
        if self.late == MARK:
            rest = bars[~good]
            left = pd.DataFrame({"symbol": key[0], "open_time": rest["open_time"], "close": rest["close"], "status": rest["status"]})
            out = pd.concat([out.assign(status=None).astype(object), left.astype(object)], ignore_index=True).reindex(columns=["symbol", "open_time", "close", *self.kinds, "status"])
            out = out.where(out.notna(), None)
        return out.astype({"open_time": "Int64", "close": "float64", **self.kinds})

    def sort_out(self, key: tuple, rows: Iterator[pd.DataFrame], last_time: int | None) -> pd.DataFrame:
        bars = sorted_out(pd.concat(list(rows)), last_time)
        if self.late == FAIL and bars["status"].isin([LATE, BROKEN]).any():
            raise LateBarError(f"{key[0]}: a bar before {last_time}, or without a price")
        return bars

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        symbol = self.read()
        bars = self.sort_out(key, rows, symbol.last_time)
        found = symbol.take(bars[bars["status"].isna()])
        if found:
            self.write(symbol)
        yield self.told(key, bars, found)

    def close(self) -> None:
        pass


class HigherProcessor(BarProcessor):
    """Lower bars with the columns of the last higher bar that has closed. A higher bar grows from lower ones, and closes when one of a later
    bin comes; then it is folded into the structure, and what that says is kept for the bars to come."""

    def __init__(self, columns: Iterable[str] | None, options: tuple, late: str, prefix: str, length: int):
        super().__init__(columns, options, late, prefix)
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.higher = handle.getValueState("higher", "saved string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        saved = self.higher.get()
        d = json.loads(saved[0]) if saved else {"time": None, "bin": None, "row": [None] * len(self.columns)}
        bars = self.sort_out(key, rows, d["time"])
        good = bars[bars["status"].isna()]
        closed, before, now = [], [], d["bin"]
        for b in good.to_dict("records"):
            begin, volume = int(b["open_time"]) // self.length * self.length, clean(b["volume"])
            if now and begin > now["open_time"]:
                closed.append(now)
                now = None
            before.append(len(closed))
            if now is None:
                now = {"open_time": begin, "open": float(b["open"]), "high": float(b["high"]), "low": float(b["low"]), "close": float(b["close"]), "volume": volume}
            else:
                now.update(high=max(now["high"], float(b["high"])), low=min(now["low"], float(b["low"])), close=float(b["close"]), volume=now["volume"] if volume is None else (now["volume"] or 0.0) + volume)
        told = [d["row"]]
        if closed:
            symbol = self.read()
            told += [r[2:] for r in symbol.take(pd.DataFrame(closed))]
            self.write(symbol)
        if len(good):
            self.higher.update((json.dumps({"time": int(good["open_time"].iloc[-1]), "bin": now, "row": told[-1]}),))
        yield self.told(key, bars, [[int(t), float(c), *told[n]] for t, c, n in zip(good["open_time"], good["close"], before, strict=True)])


def symbol_states(bars: DataFrame, columns: Iterable[str] | None = None, r: int = 12, s: int = 8, signal_period: int = 4, atr_period: int = 14, max_waves: int | None = 200, retest_mode: str = "wick") -> DataFrame:
    """symbol, saved and waves: the state of each symbol after these bars, for stream_structure(history=...) with the same columns and
    options. One ordered pass, as a stream of all of them would make."""

    class Walk:
        def __init__(self) -> None:
            self.name, self.symbol = "", Symbol(columns, r, s, signal_period, atr_period, max_waves, retest_mode, None)

    def step(walk: Walk, part: pd.DataFrame) -> None:
        walk.name = part["symbol"].iloc[0]
        part = sorted_out(part, walk.symbol.last_time)
        walk.symbol.take(part[part["status"].isna()])

    def finish(walk: Walk) -> pd.DataFrame:
        waves = [walk.symbol.held[k] for k in sorted(walk.symbol.held)]
        return pd.DataFrame({"symbol": [walk.name], "saved": [walk.symbol.saved()], "waves": [json.dumps(waves)]})

    return along(plain(bars.drop("hist")), Walk, step, "symbol string, saved string, waves string", ["open_time"], finish=finish)


def _late(late: str, strict: bool) -> str:
    if late not in (DROP, FAIL, MARK):
        raise ValueError(f"late is one of {DROP}, {FAIL} and {MARK}")
    return FAIL if strict else late


def stream_structure(bars: DataFrame, columns: Iterable[str] | None = None, r: int = 12, s: int = 8, signal_period: int = 4, atr_period: int = 14, strict: bool = False, max_waves: int | None = 200, retest_mode: str = "wick", prefix: str = "ms_", late: str = DROP, history: DataFrame | None = None) -> DataFrame:
    """A row for each new bar of a streaming bar table: the wanted columns (None: all 67), as project() with the same max_waves gives
    them for closed bars; wave_id names the wave that is forming at the bar. With max_waves None nothing is forgotten, and state grows by some
    numbers a wave. late: what becomes of bars that can't be taken any more: drop, fail (as strict does) or mark, which gives each a row with
    its status (late, repeated or broken; null for bars that are taken). history: symbol_states() of the bars before the stream.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    options, late = (r, s, signal_period, atr_period, max_waves, retest_mode), _late(late, strict)
    schema = output_schema(columns, prefix) + (", status string" if late == MARK else "")
    return bars.groupBy("symbol").transformWithStateInPandas(BarProcessor(columns, options, late, prefix), schema, "Append", "None", history.groupBy("symbol") if history is not None else None)


def stream_higher(bars: DataFrame, columns: Iterable[str] | None = None, *, htf: str, ltf: str, r: int = 12, s: int = 8, signal_period: int = 4, atr_period: int = 14, max_waves: int | None = 200, retest_mode: str = "wick", late: str = DROP) -> DataFrame:
    """A row for each new bar of a stream of lower bars: the wanted columns of the last higher bar that had closed when it opened, as
    ms_{htf}_*, as project_higher() gives them; nulls before the first one has closed. late: as in stream_structure."""
    length, _ = check_timeframes(htf, ltf)
    options, late, prefix = (r, s, signal_period, atr_period, max_waves, retest_mode), _late(late, False), f"ms_{htf}_"
    schema = output_schema(columns, prefix) + (", status string" if late == MARK else "")
    return bars.groupBy("symbol").transformWithStateInPandas(HigherProcessor(columns, options, late, prefix, length), schema, "Append", "None")


def with_counts(marked: DataFrame, name: str = "bars") -> DataFrame:
    """A stream that marks late bars, with how many bars were taken, late, repeated and broken as observed metrics of each micro-batch
    (query.lastProgress["observedMetrics"][name])."""
    counts = [F.count_if(F.col("status") == c).alias(c) for c in (LATE, REPEATED, BROKEN)]
    return marked.observe(name, F.count_if(F.col("status").isNull()).alias("taken"), *counts)
