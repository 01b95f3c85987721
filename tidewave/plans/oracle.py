"""The same results in DuckDB SQL: common table expressions that queries put together."""

from __future__ import annotations

HOUR = 3_600_000


def bars_sql(hours: int = 4) -> str:
    return f"""
ticks AS (SELECT event_type AS symbol, epoch_ms(ts) AS t, event_id AS id, value AS p FROM events WHERE value IS NOT NULL),
bars AS (SELECT symbol, CAST(t - t % {hours * HOUR} AS BIGINT) AS open_time, min(struct_pack(t := t, id := id, p := p)).p AS open, max(p) AS high, min(p) AS low,
  max(struct_pack(t := t, id := id, p := p)).p AS close, sum(p) AS volume FROM ticks GROUP BY 1, 2)"""


INDICATORS = """
b0 AS (SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS m, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
ema AS (SELECT symbol, i, m AS e1, m AS e2, abs(m) AS a1, abs(m) AS a2, 100::DOUBLE * m / abs(m) AS tsi, 100::DOUBLE * m / abs(m) AS sig FROM b0 WHERE i = 1
  UNION ALL SELECT symbol, i, e1, e2, a1, a2, tsi, (1 - 2::DOUBLE / 5) * sig + 2::DOUBLE / 5 * tsi FROM (
    SELECT *, 100::DOUBLE * e2 / a2 AS tsi FROM (
      SELECT symbol, i, e1, (1 - 2::DOUBLE / 9) * p2 + 2::DOUBLE / 9 * e1 AS e2, a1, (1 - 2::DOUBLE / 9) * q2 + 2::DOUBLE / 9 * a1 AS a2, sig FROM (
        SELECT b.symbol, b.i, (1 - 2::DOUBLE / 13) * e.e1 + 2::DOUBLE / 13 * b.m AS e1, (1 - 2::DOUBLE / 13) * e.a1 + 2::DOUBLE / 13 * abs(b.m) AS a1, e.e2 AS p2, e.a2 AS q2, e.sig
        FROM ema e JOIN b0 b ON b.symbol = e.symbol AND b.i = e.i + 1)))),
wilder AS (SELECT symbol, max(i) AS i, sum(tr) / 14 AS atr FROM b0 WHERE i < 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT b.symbol, b.i, (w.atr * 13 + b.tr) / 14 FROM wilder w JOIN b0 b ON b.symbol = w.symbol AND b.i = w.i + 1),
ind AS (SELECT b0.symbol, b0.open_time, open, high, low, close, volume, b0.i, tr, tsi, sig AS tsi_signal, tsi - sig AS hist, atr
  FROM b0 LEFT JOIN ema ON ema.symbol = b0.symbol AND ema.i = b0.i LEFT JOIN wilder ON wilder.symbol = b0.symbol AND wilder.i = b0.i)"""

SEGMENTS = """
s0 AS (SELECT *, coalesce(hist >= 0, false) AS is_up FROM ind),
s1 AS (SELECT *, coalesce(is_up <> lag(is_up) OVER (PARTITION BY symbol ORDER BY i), false) AS flip FROM s0),
seg AS (SELECT *, sum(flip::INT) OVER (PARTITION BY symbol ORDER BY i) AS k FROM s1)"""

WAVES = """
w0 AS (SELECT symbol, k, max(is_up) AS is_up, min(i) AS start_i, max(i) AS end_i, count(*) AS n_bars, sum(volume) AS volume, max(hist) AS hist_max, min(hist) AS hist_min,
  max(struct_pack(v := high, at := -i, t := open_time, atr := atr)) AS hi, min(struct_pack(v := low, at := i, t := open_time, atr := atr)) AS lo,
  max(struct_pack(v := close, at := -i, o := open)) AS hc, min(struct_pack(v := close, at := i, o := open)) AS lc,
  max(struct_pack(v := greatest(open, close), at := -i, t := open_time)) AS ho, min(struct_pack(v := least(open, close), at := i, t := open_time)) AS lw,
  min(struct_pack(i := i, atr := atr)).atr AS first_atr FROM seg GROUP BY symbol, k),
w1 AS (SELECT symbol, k, is_up, start_i, end_i, n_bars, volume, hist_max, hist_min, hi.v AS high, -hi.at AS high_i, hi.t AS high_time, hi.atr AS high_atr,
  lo.v AS low, lo.at AS low_i, lo.t AS low_time, lo.atr AS low_atr, hc.v AS high_close, greatest(hc.o, hc.v) AS top_high, least(hc.o, hc.v) AS top_low,
  lc.v AS low_close, greatest(lc.o, lc.v) AS bottom_high, least(lc.o, lc.v) AS bottom_low, ho.v AS h, -ho.at AS h_i, ho.t AS h_time, lw.v AS l, lw.at AS l_i, lw.t AS l_time,
  lead(start_i) OVER w IS NULL AS is_forming, coalesce(lead(start_i) OVER w, end_i) AS formation_i, lead(first_atr) OVER w AS formation_atr
  FROM w0 WINDOW w AS (PARTITION BY symbol ORDER BY k)),
wall AS (SELECT *, CASE WHEN is_up THEN 'up' ELSE 'down' END AS side, CASE WHEN is_forming THEN 'forming-' ELSE 'w-' END || k AS wave_id FROM w1),
wv AS (SELECT * FROM wall WHERE NOT is_forming)"""

WAVE_FACTS = """
f0 AS (SELECT *, CASE WHEN formation_atr > 0 THEN (high - low) / formation_atr END AS amplitude,
  CASE WHEN is_up THEN h_i - lag(l_i) OVER w - 1 ELSE l_i - lag(h_i) OVER w - 1 END AS pullback_length,
  CASE WHEN is_up THEN lag(l) OVER w ELSE lag(h) OVER w END AS pullback_breakout_level,
  CASE WHEN is_up THEN h - lag(l) OVER w ELSE l - lag(h) OVER w END AS pullback_price_diff,
  CASE WHEN is_up THEN h - lag(l) OVER w ELSE lag(h) OVER w - l END AS pb_num,
  CASE WHEN is_up THEN lag(h, 2) OVER w - lag(l) OVER w ELSE lag(h) OVER w - lag(l, 2) OVER w END AS pb_den,
  CASE WHEN lag(k, 2) OVER w IS NOT NULL THEN coalesce(CASE WHEN is_up THEN high_close > lag(high_close, 2) OVER w AND hist_max < lag(hist_max, 2) OVER w
    ELSE low_close < lag(low_close, 2) OVER w AND hist_min > lag(hist_min, 2) OVER w END, false) END AS diverging
  FROM wv WINDOW w AS (PARTITION BY symbol ORDER BY k)),
fact AS (SELECT *, CASE WHEN pb_den <> 0 THEN pb_num / pb_den END AS pullback_correction_factor, amplitude / n_bars AS slope,
  CASE WHEN lag(volume, 2) OVER w > 0 THEN volume / lag(volume, 2) OVER w END AS volume_ratio,
  CASE WHEN lag(amplitude, 2) OVER w > 0 THEN amplitude / lag(amplitude, 2) OVER w END AS amplitude_ratio
  FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY k))"""

SINCE = """
sv AS (SELECT a.symbol, a.k, max(CASE WHEN b.h > a.h THEN b.k END) AS kh, max(CASE WHEN b.l < a.l THEN b.k END) AS kl FROM wv a LEFT JOIN wv b ON b.symbol = a.symbol AND b.k < a.k GROUP BY a.symbol, a.k),
since AS (SELECT a.symbol, a.k, a.is_up, CASE WHEN a.is_up THEN CASE WHEN b.k IS NULL THEN a.h_i ELSE a.h_i - b.h_i - 1 END ELSE CASE WHEN c.k IS NULL THEN a.l_i ELSE a.l_i - c.l_i - 1 END END AS since
  FROM wv a JOIN sv USING (symbol, k) LEFT JOIN wv b ON b.symbol = sv.symbol AND b.k = sv.kh LEFT JOIN wv c ON c.symbol = sv.symbol AND c.k = sv.kl)"""

# tops are bottoms of mirrored prices: lo, hi and ext are mirrored for up waves, and back at the end
ZONES = """
z0 AS (SELECT symbol, k, is_up, formation_i, CASE WHEN is_up THEN -top_high ELSE bottom_low END AS lo, CASE WHEN is_up THEN -top_low ELSE bottom_high END AS hi,
  CASE WHEN is_up THEN -high ELSE low END AS ext, CASE WHEN is_up THEN high_time ELSE low_time END AS ext_t, CASE WHEN is_up THEN least(high_time, h_time) ELSE least(low_time, l_time) END AS t0,
  CASE WHEN (CASE WHEN is_up THEN high_atr ELSE low_atr END) > 0 THEN 0.3::DOUBLE * (CASE WHEN is_up THEN high_atr ELSE low_atr END) ELSE 0.004::DOUBLE * (CASE WHEN is_up THEN high ELSE low END) END AS tol,
  CASE WHEN is_up THEN -lag(high) OVER w ELSE lag(low) OVER w END AS x1, CASE WHEN is_up THEN -lag(high, 3) OVER w ELSE lag(low, 3) OVER w END AS x3
  FROM wv WINDOW w AS (PARTITION BY symbol ORDER BY k)),
z1 AS (SELECT z0.*, p.lo AS lo1, p.hi AS hi1, p.ext AS ext1, q.lo AS lo2, q.hi AS hi2, q.ext AS ext2, p.ext_t AS et1, q.ext_t AS et2
  FROM z0 LEFT JOIN z0 p ON p.symbol = z0.symbol AND p.k = z0.k - 2 LEFT JOIN z0 q ON q.symbol = z0.symbol AND q.k = z0.k - 4),
z2 AS (SELECT *, coalesce(lo1 <= hi AND hi1 >= lo, false) AS meets1, coalesce(NOT (x1 < ext OR x1 < ext1) AND abs(ext1 - ext) <= tol, false) AS d1 FROM z1),
z3 AS (SELECT *, CASE WHEN d1 AND meets1 THEN least(lo, lo1) ELSE lo END AS low1 FROM z2),
z4 AS (SELECT *, coalesce(lo2 <= hi AND hi2 >= low1, false) AS meets2, coalesce(NOT (least(x1, ext1, x3) < ext OR least(x1, ext1, x3) < ext2) AND abs(ext2 - ext) <= tol, false) AS d2 FROM z3),
z5 AS (SELECT *, CASE WHEN d2 AND meets2 THEN least(low1, lo2) ELSE low1 END AS fin, d1 OR d2 AS dbl FROM z4),
z6 AS (SELECT z.symbol, z.k, count(o.k) AS older, min(CASE WHEN o.ext <= z.fin THEN o.ext_t END) AS older_t FROM z5 z LEFT JOIN z0 o ON o.symbol = z.symbol AND o.is_up = z.is_up AND o.k < z.k - 4 AND o.lo <= z.hi AND o.hi >= z.fin GROUP BY z.symbol, z.k),
anchor AS (SELECT z5.symbol, z5.k, is_up, formation_i, dbl, older + meets1::INT + meets2::INT AS n_over,
  CASE WHEN is_up THEN -hi ELSE fin END AS zlow, CASE WHEN is_up THEN -fin ELSE hi END AS zhigh,
  CASE WHEN is_up THEN -greatest(lo, CASE WHEN d1 THEN lo1 END, CASE WHEN d2 THEN lo2 END) ELSE least(ext, CASE WHEN d1 THEN ext1 END, CASE WHEN d2 THEN ext2 END) END AS wlow,
  CASE WHEN is_up THEN -least(ext, CASE WHEN d1 THEN ext1 END, CASE WHEN d2 THEN ext2 END) ELSE greatest(lo, CASE WHEN d1 THEN lo1 END, CASE WHEN d2 THEN lo2 END) END AS whigh,
  CAST(CASE WHEN dbl THEN least(t0, older_t, CASE WHEN meets1 AND ext1 <= fin THEN et1 END, CASE WHEN meets2 AND ext2 <= fin THEN et2 END) ELSE t0 END AS DOUBLE) AS atime
  FROM z5 JOIN z6 USING (symbol, k)),
zsnap AS (SELECT v.symbol, v.k, v.formation_i AS s_form, v.formation_atr AS s_atr, a.*, (SELECT count(*) FROM wv o WHERE o.symbol = v.symbol AND o.k <= v.k AND o.is_up <> a.is_up
    AND (CASE WHEN a.is_up THEN o.bottom_low ELSE o.top_low END) <= a.zhigh AND (CASE WHEN a.is_up THEN o.bottom_high ELSE o.top_high END) >= a.zlow) AS touches
  FROM wv v JOIN (SELECT symbol AS sy, k AS ak, is_up, formation_i, dbl, n_over, zlow, zhigh, wlow, whigh, atime FROM anchor) a ON a.sy = v.symbol AND a.ak BETWEEN v.k - 1 AND v.k),
zq AS (SELECT *, least(least(n_over, 5) * 0.8::DOUBLE + CASE WHEN dbl THEN 2 ELSE 0 END + CASE WHEN s_atr > 0 THEN greatest(0, 2 - (zhigh - zlow) / s_atr * 2) ELSE 0 END
  + 2 * exp(-(s_form - formation_i) / 100::DOUBLE) + least(touches, 3) * 0.7::DOUBLE, 10) AS quality FROM zsnap)"""

SNAPSHOTS = """
n0 AS (SELECT *, CASE WHEN is_up THEN h ELSE lag(h) OVER w END AS t0, CASE WHEN is_up THEN lag(h, 2) OVER w ELSE lag(h, 3) OVER w END AS t1,
  CASE WHEN is_up THEN lag(l) OVER w ELSE l END AS b0, CASE WHEN is_up THEN lag(l, 3) OVER w ELSE lag(l, 2) OVER w END AS b1, lag(diverging) OVER w AS div1,
  coalesce(high - low < lag(high, 2) OVER w - lag(low, 2) OVER w AND lag(high, 2) OVER w - lag(low, 2) OVER w < lag(high, 4) OVER w - lag(low, 4) OVER w AND CASE WHEN is_up
    THEN h > lag(h, 2) OVER w AND lag(h, 2) OVER w > lag(h, 4) OVER w AND h - lag(h, 2) OVER w < lag(h, 2) OVER w - lag(h, 4) OVER w
    ELSE l < lag(l, 2) OVER w AND lag(l, 2) OVER w < lag(l, 4) OVER w AND lag(l, 2) OVER w - l < lag(l, 4) OVER w - lag(l, 2) OVER w END, false) AS pushes
  FROM fact WINDOW w AS (PARTITION BY symbol ORDER BY k)),
n1 AS (SELECT *, t0 > t1 AS hh, b0 > b1 AS hl, t0 < t1 AS lh, b0 < b1 AS ll, coalesce(t0 > t1 AND b0 > b1, false) AS rises, coalesce(t0 < t1 AND b0 < b1, false) AS falls,
  lag(pushes) OVER (PARTITION BY symbol ORDER BY k) AS pushes1 FROM n0),
n2 AS (SELECT *, max(CASE WHEN NOT (rises OR falls) THEN k END) OVER (PARTITION BY symbol, k % 2 ORDER BY k) AS broken FROM n1),
snap AS (SELECT *, CASE WHEN rises OR falls THEN (k - coalesce(broken, k % 2 - 2)) // 2 ELSE 0 END AS run FROM n2)"""

PROJECTION = """
p0 AS (SELECT seg.*, 'ms' AS tag, max(seg.k) OVER (PARTITION BY seg.symbol) AS last_k, max(high) OVER own AS fwh, min(low) OVER own AS fwl FROM seg WINDOW own AS (PARTITION BY seg.symbol, seg.k ORDER BY i)),
p1 AS (SELECT p0.*, n.t0, n.b0, n.hh, n.hl, n.lh, n.ll, coalesce(n.run, 0) AS run, coalesce(n.rises, false) AS rises, coalesce(n.falls, false) AS falls,
  CASE WHEN n.rises THEN n.b0 WHEN n.falls THEN n.t0 END AS brk, coalesce(CASE WHEN n.is_up THEN n.pushes ELSE n.pushes1 END, false) AS pu, coalesce(CASE WHEN n.is_up THEN n.pushes1 ELSE n.pushes END, false) AS pd,
  CASE WHEN n.is_up THEN n.diverging ELSE n.div1 END AS bear, CASE WHEN n.is_up THEN n.div1 ELSE n.diverging END AS bull, n.n_bars AS wlen, n.amplitude, n.slope, n.volume AS wvol, n.volume_ratio, n.amplitude_ratio,
  n.pullback_length, n.pullback_correction_factor, n.pullback_breakout_level, n.pullback_price_diff, CASE WHEN n.formation_atr > 0 THEN abs(n.pullback_price_diff) / n.formation_atr END AS pb_atr
  FROM p0 LEFT JOIN snap n ON n.symbol = p0.symbol AND n.k + 1 = p0.k),
p2 AS (SELECT *, rises AND NOT coalesce(NOT is_up AND fwl <= b0, false) AS tu, falls AND NOT coalesce(is_up AND fwh >= t0, false) AS td,
  coalesce(CASE WHEN rises THEN close < brk WHEN falls THEN close > brk END, false) AS rb, coalesce(high > t0 AND close < t0, false) AS rsh, coalesce(low < b0 AND close > b0, false) AS rsl FROM p1),
p3 AS (SELECT *, max(CASE WHEN NOT (tu OR td) THEN i END) OVER w AS calm, lag(rb, 1, false) OVER w AS rb1, lag(brk) OVER w AS brk1, lag(rsh, 1, false) OVER w AS rsh1, lag(t0) OVER w AS t01,
  lag(rsl, 1, false) OVER w AS rsl1, lag(b0) OVER w AS b01, lag(pu, 1, false) OVER w AS pu1, lag(pd, 1, false) OVER w AS pd1,
  max(CASE WHEN flip AND NOT is_up THEN i END) OVER w AS top_i, max(CASE WHEN flip AND is_up THEN i END) OVER w AS bot_i FROM p2 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
proj AS (SELECT symbol, open_time, i, k, open, high, low, close, volume, CASE WHEN is_up THEN 'up' ELSE 'down' END AS ms_wave_side, CASE WHEN k = last_k THEN 'forming-' ELSE 'w-' END || k AS ms_wave_id,
  fwh AS ms_forming_wave_high, fwl AS ms_forming_wave_low, CAST(k AS BIGINT) AS ms_wave_count, atr AS ms_atr, t0 AS ms_last_top_price, b0 AS ms_last_bottom_price,
  hh AS ms_made_higher_high, hl AS ms_made_higher_low, lh AS ms_made_lower_high, ll AS ms_made_lower_low, CAST(run AS BIGINT) AS ms_trend_wave_count, tu AS ms_is_trending_up, td AS ms_is_trending_down,
  CAST(CASE WHEN tu OR td THEN i - coalesce(calm, -1) - 1 END AS BIGINT) AS ms_trend_duration, brk AS ms_structure_break_level, rb AND (NOT rb1 OR brk IS DISTINCT FROM brk1) AS ms_structure_break_confirmed,
  pu AND NOT pu1 AS ms_three_push_up, pd AND NOT pd1 AS ms_three_push_down, rsh AND (NOT rsh1 OR t0 IS DISTINCT FROM t01) AS ms_sfp_high, rsl AND (NOT rsl1 OR b0 IS DISTINCT FROM b01) AS ms_sfp_low,
  CAST(i - top_i AS BIGINT) AS ms_bars_since_last_top, CAST(i - bot_i AS BIGINT) AS ms_bars_since_last_bottom, bear AS ms_bearish_divergence, bull AS ms_bullish_divergence,
  CAST(wlen AS BIGINT) AS ms_wave_length, amplitude AS ms_wave_amplitude, slope AS ms_wave_slope, wvol AS ms_wave_volume, volume_ratio AS ms_wave_volume_ratio, amplitude_ratio AS ms_wave_amplitude_ratio,
  CAST(pullback_length AS BIGINT) AS ms_pullback_length, pullback_correction_factor AS ms_pullback_correction_factor, pullback_breakout_level AS ms_pullback_breakout_level, pullback_price_diff AS ms_pullback_price_diff, pb_atr AS ms_pullback_atr_factor
  FROM p3)"""

ZONE_PROJECTION = """
hl AS (SELECT symbol, k, CASE WHEN is_up THEN since ELSE lag(since) OVER w END AS hs, CASE WHEN is_up THEN lag(since) OVER w ELSE since END AS ls FROM since WINDOW w AS (PARTITION BY symbol ORDER BY k)),
zproj AS (SELECT p.*, CAST(hl.hs AS BIGINT) AS ms_high_since, CAST(hl.ls AS BIGINT) AS ms_low_since,
  s.zlow AS ms_support_zone_low, s.zhigh AS ms_support_zone_high, s.wlow AS ms_support_zone_wick_low, s.whigh AS ms_support_zone_wick_high, s.dbl AS ms_support_is_double, CAST(s.n_over AS BIGINT) AS ms_support_overlap_count, s.atime AS ms_support_zone_anchor_time,
  r.zlow AS ms_resistance_zone_low, r.zhigh AS ms_resistance_zone_high, r.wlow AS ms_resistance_zone_wick_low, r.whigh AS ms_resistance_zone_wick_high, r.dbl AS ms_resistance_is_double, CAST(r.n_over AS BIGINT) AS ms_resistance_overlap_count, r.atime AS ms_resistance_zone_anchor_time,
  s.quality AS ms_zone_quality_support, r.quality AS ms_zone_quality_resistance, (close - s.zhigh) / nullif(ms_atr, 0) AS ms_distance_to_support, (r.zlow - close) / nullif(ms_atr, 0) AS ms_distance_to_resistance
  FROM proj p LEFT JOIN hl ON hl.symbol = p.symbol AND hl.k + 1 = p.k LEFT JOIN zq s ON s.symbol = p.symbol AND s.k + 1 = p.k AND NOT s.is_up LEFT JOIN zq r ON r.symbol = p.symbol AND r.k + 1 = p.k AND r.is_up)"""


def lifecycle_sql(wick: bool) -> str:
    touch = "reach >= far" if wick else "cl BETWEEN far AND near"
    return f"""
l0 AS (SELECT symbol, i, 'support' AS side, ms_support_zone_high AS near, ms_support_zone_low AS far, close AS cl, high AS reach FROM zproj
  UNION ALL SELECT symbol, i, 'resistance', -ms_resistance_zone_low, -ms_resistance_zone_high, -close, -low FROM zproj),
l1 AS (SELECT *, coalesce(near IS DISTINCT FROM lag(near) OVER w OR far IS DISTINCT FROM lag(far) OVER w, true) AS fresh FROM l0 WINDOW w AS (PARTITION BY symbol, side ORDER BY i)),
life AS (SELECT symbol, side, i, CASE WHEN near IS NOT NULL AND cl < far THEN 1 ELSE 0 END AS state, 0 AS cnt, CASE WHEN near IS NOT NULL AND cl < far THEN 'break' END AS event FROM l1 WHERE i = 0
  UNION ALL SELECT symbol, side, i, CASE event WHEN 'break' THEN 1 WHEN 'retest' THEN 2 WHEN 'flip' THEN 0 WHEN 'failed_retest' THEN 0 ELSE state END, CASE event WHEN 'retest' THEN cnt + 1 WHEN 'flip' THEN 0 WHEN 'failed_retest' THEN 0 ELSE cnt END, event FROM (
    SELECT *, CASE WHEN near IS NULL THEN NULL WHEN state = 0 AND cl < far THEN 'break' WHEN state = 1 AND {touch} THEN 'retest' WHEN state = 2 AND cl < far THEN 'flip' WHEN state = 2 AND cl > near THEN 'failed_retest' END AS event FROM (
      SELECT b.symbol, b.side, b.i, b.near, b.far, b.cl, b.reach, CASE WHEN b.fresh OR b.near IS NULL THEN 0 ELSE a.state END AS state, CASE WHEN b.fresh OR b.near IS NULL THEN 0 ELSE a.cnt END AS cnt
      FROM life a JOIN l1 b ON b.symbol = a.symbol AND b.side = a.side AND b.i = a.i + 1))),
lproj AS (SELECT z.*, {', '.join(f"coalesce({s[0]}.event = '{e}', false) AS ms_zone_{e}_{s}" for e in ("break", "retest", "flip", "failed_retest") for s in ("support", "resistance"))},
  CAST(s.cnt AS BIGINT) AS ms_zone_retest_count_support, CAST(r.cnt AS BIGINT) AS ms_zone_retest_count_resistance
  FROM zproj z JOIN life s ON s.symbol = z.symbol AND s.i = z.i AND s.side = 'support' JOIN life r ON r.symbol = z.symbol AND r.i = z.i AND r.side = 'resistance')"""


def bounded_since(n: int) -> str:
    """SINCE where only the n waves before each are remembered."""
    few = SINCE.replace("b.k < a.k GROUP", f"b.k < a.k AND b.k >= a.k - {n} GROUP")
    few = few.replace("THEN a.h_i ELSE", "THEN a.h_i - o.start_i ELSE").replace("THEN a.l_i ELSE", "THEN a.l_i - o.start_i ELSE")
    return few.rstrip().removesuffix(")") + f" LEFT JOIN wv o ON o.symbol = a.symbol AND o.k = greatest(0, a.k - {n}))"


def distinct_zones(side: str, n: int) -> str:
    """Zones of a side in a registry of n waves and the forming one, newest first; an anchor whose body meets a zone taken before is
    passed over. The fold keeps the zones taken so far as a list."""
    up = side == "resistance"
    body = ("top_low", "top_high") if up else ("bottom_low", "bottom_high")
    other = ("bottom_low", "bottom_high") if up else ("top_low", "top_high")
    zones = ZONES.split("zsnap AS")[0].rstrip().rstrip(",").replace("FROM wv", "FROM zw").replace("z0 AS (SELECT symbol, k, is_up,", "z0 AS (SELECT symbol, k, is_up, is_forming,")
    zones = zones.replace("coalesce(NOT (", "coalesce((is_forming OR NOT (").replace("x1 < ext1)", "x1 < ext1))").replace("least(x1, ext1, x3) < ext2)", "least(x1, ext1, x3) < ext2))")
    return f"""
zw AS (SELECT * FROM (SELECT *, max(CASE WHEN NOT is_forming THEN k END) OVER (PARTITION BY symbol) AS newest FROM wall) WHERE is_forming OR newest - k < {n}),{zones},
cand AS (SELECT a.*, w.wave_id, w.{body[0]} AS body_low, w.{body[1]} AS body_high, row_number() OVER (PARTITION BY a.symbol ORDER BY a.k DESC) AS n,
  (SELECT count(*) FROM zw o WHERE o.symbol = a.symbol AND o.is_up <> a.is_up AND NOT o.is_forming AND o.{other[0]} <= a.zhigh AND o.{other[1]} >= a.zlow) AS n_against
  FROM anchor a JOIN zw w ON w.symbol = a.symbol AND w.k = a.k WHERE a.is_up = {str(up).lower()}),
fold AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a DOUBLE, z DOUBLE)[]) AS held, false AS took, CAST(0 AS BIGINT) AS place FROM cand
  UNION ALL SELECT c.symbol, c.n, CASE WHEN skip THEN held ELSE list_append(held, struct_pack(a := zlow, z := zhigh)) END, NOT skip, len(held) FROM (
    SELECT c.*, f.held, len(list_filter(f.held, lambda x: x.a <= c.body_high AND x.z >= c.body_low)) > 0 AS skip FROM fold f JOIN cand c ON c.symbol = f.symbol AND c.n = f.n + 1) c)
SELECT c.symbol, CAST(f.place AS BIGINT) AS place, '{side}' AS side, wave_id AS anchor_wave_id, round(zlow, 6) AS low, round(zhigh, 6) AS high, round(wlow, 6) AS wick_low, round(whigh, 6) AS wick_high, dbl AS is_double,
  CAST({'n_against' if up else 'n_over'} AS BIGINT) AS n_low, CAST({'n_over' if up else 'n_against'} AS BIGINT) AS n_high FROM cand c JOIN fold f ON f.symbol = c.symbol AND f.n = c.n WHERE f.took"""


def upto(level: str, hours: int = 4, wick: bool = True) -> str:
    """WITH ... of all that a level needs: bars, ind, seg, wv, fact, since, zones, proj, zproj, lproj."""
    order = [bars_sql(hours), INDICATORS, SEGMENTS, WAVES, WAVE_FACTS, SINCE, ZONES, SNAPSHOTS, PROJECTION, ZONE_PROJECTION, lifecycle_sql(wick)]
    names = ["bars", "ind", "seg", "wv", "fact", "since", "zones", "snap", "proj", "zproj", "lproj"]
    need = {"since": names[:4] + ["since"], "zones": names[:4] + ["zones"], "snap": names[:5] + ["snap"], "proj": names[:5] + ["snap", "proj"]}.get(level, names[: names.index(level) + 1])
    return "WITH RECURSIVE " + ",".join(sql for name, sql in zip(names, order, strict=True) if name in need)
