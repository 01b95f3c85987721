"""Recurrences along each symbol's bars: exponential averages, TSI and Wilder's ATR.

They are serial by nature, and re-associating them would flip signs of the histogram near zero. So rows are dealt by symbol and
sorted, and Arrow batches pass through one after another with a few numbers of state: a symbol of any length needs the memory of
one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def along(rows: DataFrame, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, order: list[str], key: str = "symbol", fields: list[str] | None = None, finish: Callable[[Any], pd.DataFrame] | None = None) -> DataFrame:
    """Run step(state, part) over each key's rows in order; part is what one Arrow batch has of the key, the state lives on to
    the next batch. A lost task starts again from its sorted rows. With fields, part has only these, and the columns of schema are
    put beside all columns of rows, which don't leave Arrow. With finish, steps give nothing and finish(state) gives a key's rows after
    its last one."""

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, owner = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = (batch.select([key, *fields]) if fields else batch).to_pandas()
            keys = frame[key].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(frame)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if state is None or keys[a] != owner:
                    if finish and state is not None:
                        yield pa.RecordBatch.from_pandas(finish(state), schema=arrow, preserve_index=False)
                    state, owner = start(), keys[a]
                if finish:
                    step(state, frame.iloc[a:b])
                    continue
                new = pa.RecordBatch.from_pandas(step(state, frame.iloc[a:b]), schema=arrow, preserve_index=False)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new.columns], [*batch.schema.names, *arrow.names]) if fields else new
        if finish and state is not None:
            yield pa.RecordBatch.from_pandas(finish(state), schema=arrow, preserve_index=False)

    if fields:
        out = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        spark_kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
        for name, kind in (c.split(" ") for c in schema.split(", ")):
            out = out.add(name, spark_kinds[kind])
    else:
        out = schema
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


class Ema:
    """An exponential average with alpha 2 / (span + 1) that starts at the first number: y = (1 - alpha) * y + alpha * x."""

    def __init__(self, span: int):
        self.span, self.last = span, np.nan

    def __call__(self, x: np.ndarray) -> np.ndarray:
        known = np.isnan(self.last)
        y = pd.Series(x if known else np.concatenate([[self.last], x])).ewm(span=self.span, adjust=False).mean().to_numpy()
        y = y if known else y[1:]
        if len(y):
            self.last = y[-1]
        return y


class Oscillator:
    """State of TSI and ATR at the end of the bars so far."""

    def __init__(self, r: int, s: int, signal: int, period: int):
        self.up, self.up2, self.size, self.size2, self.signal = Ema(r), Ema(s), Ema(r), Ema(s), Ema(signal)
        self.period, self.close, self.first, self.atr = period, np.nan, [], np.nan


def advance(o: Oscillator, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, ...]:
    """tsi, signal, histogram and ATR of the next bars."""
    before = np.concatenate([[o.close], close[:-1]])
    momentum = close - before
    with np.errstate(divide="ignore", invalid="ignore"):
        tsi = 100 * o.up2(o.up(momentum)) / o.size2(o.size(np.abs(momentum)))
    signal = o.signal(tsi)
    true_range = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    atr = np.full(len(close), np.nan)
    begin = 0
    if len(o.first) < o.period:
        begin = min(o.period - len(o.first), len(close))
        o.first.extend(true_range[:begin].tolist())
        if len(o.first) == o.period:
            o.atr = atr[begin - 1] = float(np.mean(o.first))
    if begin < len(close):
        n = o.period
        atr[begin:] = list(accumulate(true_range[begin:].tolist(), lambda a, x: (a * (n - 1) + x) / n, initial=o.atr))[1:]
        o.atr = atr[-1]
    o.close = close[-1]
    return tsi, signal, tsi - signal, atr


def with_indicators(bars: DataFrame, r: int = 12, s: int = 8, signal_period: int = 4, atr_period: int = 14) -> DataFrame:
    """bars with tsi, tsi_signal, tsi_histogram and atr. Bars need high, low and close; a null among them is an error, as an
    average over a gap has no meaning."""

    def step(o: Oscillator, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(INDICATORS, advance(o, *prices(part)), strict=True)))  # NaN becomes NULL on the way back

    return along(plain(bars), lambda: Oscillator(r, s, signal_period, atr_period), step, ", ".join(f"{c} double" for c in INDICATORS), ["open_time"], fields=["high", "low", "close"])


def exported_indicators(bars: DataFrame) -> DataFrame:
    """bars with the slower TSI 25/13/7 that exported files have; the bars before it can be computed have zeros. ATR is as ever."""
    rows = with_indicators(bars.drop("tsi", "tsi_signal", "tsi_histogram"), 25, 13, 7)
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("tsi", "tsi_signal", "tsi_histogram")})


INDICATORS = ("tsi", "tsi_signal", "tsi_histogram", "atr")


def plain(bars: DataFrame) -> DataFrame:
    numbers = [c for c in ("open", "high", "low", "close", "volume", "hist") if c in bars.columns]
    return bars.select(F.col("symbol").cast("string").alias("symbol"), F.col("open_time").cast("long").alias("open_time"), *(F.col(c).cast("double").alias(c) for c in numbers))


def prices(part: pd.DataFrame) -> list[np.ndarray]:
    found = [part[c].to_numpy(np.float64, na_value=np.nan) for c in ("high", "low", "close")]
    if any(np.isnan(x).any() for x in found):
        raise ValueError("a bar has no high, low or close")
    return found


class Segmented:
    """State of indicators and waves at the end of the bars so far."""

    def __init__(self, oscillator: Oscillator):
        self.osc, self.i, self.k, self.up = oscillator, 0, 0, None


def with_structure(bars: DataFrame, own_hist: bool = False, r: int = 12, s: int = 8, signal_period: int = 4, atr_period: int = 14) -> DataFrame:
    """bars with hist, atr, and the wave of each bar (i, is_up, flip, k, see waves.segment) from one ordered pass. own_hist: waves go by
    the column hist; otherwise by the TSI histogram."""
    names = [*INDICATORS, *([] if own_hist else ["hist"])]

    def step(o: Segmented, part: pd.DataFrame) -> pd.DataFrame:
        found = dict(zip(INDICATORS, advance(o.osc, *prices(part)), strict=True))
        hist = part["hist"].to_numpy(np.float64, na_value=np.nan) if own_hist else found["tsi_histogram"]
        up = hist >= 0
        flip = np.append(o.up is not None and up[0] != o.up, up[1:] != up[:-1])
        k = o.k + np.cumsum(flip)
        i = o.i + np.arange(len(up))
        o.i, o.k, o.up = int(i[-1]) + 1, int(k[-1]), bool(up[-1])
        return pd.DataFrame(found | ({} if own_hist else {"hist": hist}) | {"i": i.astype(np.int32), "is_up": up, "flip": flip, "k": k})

    rows = plain(bars) if own_hist else plain(bars.drop("hist"))
    schema = ", ".join(f"{c} double" for c in names) + ", i int, is_up boolean, flip boolean, k long"
    return along(rows, lambda: Segmented(Oscillator(r, s, signal_period, atr_period)), step, schema, ["open_time"], fields=["high", "low", "close", *(["hist"] if own_hist else [])])


def true_range() -> Column:
    """The largest of high - low and the distances of both from the close before; the first bar's is high - low."""
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
