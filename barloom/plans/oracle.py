"""The registered queries as plain SQL, written row by row from their definitions.

Recurrences and position machines are recursive queries that step through one row at a time, so they
share nothing with the chunked Spark versions.
"""

from __future__ import annotations


def num(expr: str, alias: str | None = None) -> str:
    """A rounded double under its output name; near-ties go up, as in the Spark results."""
    value = f"round(({expr}) + 3.7e-11::DOUBLE, 6)"
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value}::DOUBLE END AS {alias or expr}"


def nums(*names: str) -> str:
    return ", ".join(num(n) for n in names)


OHLCV = ("open", "high", "low", "close", "volume")

VALUE_BARS = """
bars AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume
  FROM events GROUP BY ALL)"""


def path_bars(table: str, symbol: str, ts: str, tick: str, price: str, center: float, step: float, unit: str) -> str:
    return f"""
ticks AS (SELECT {symbol} AS symbol, {ts} AS ts, {tick} AS tick_id, {price} AS price, date_trunc('{unit}', {ts})::TIMESTAMP AS bar_ts FROM {table}),
moves AS (
  SELECT *, (price - {center}::DOUBLE) / {center}::DOUBLE * {step}::DOUBLE / sqrt(count(*) OVER (PARTITION BY symbol, bar_ts)) AS move
  FROM ticks),
path AS (
  SELECT *, 100.0::DOUBLE * exp(sum(move) OVER (PARTITION BY symbol ORDER BY ts, tick_id ROWS UNBOUNDED PRECEDING)) AS p FROM moves),
bars AS MATERIALIZED (
  SELECT symbol, bar_ts AS ts, first(p ORDER BY ts, tick_id) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY ts, tick_id) AS close, sum(price) AS volume
  FROM path GROUP BY symbol, bar_ts)"""


MINUTE_BARS = path_bars("events", "event_type", "ts", "event_id", "value", 50.0, 0.012, "minute")
HOUR_BARS = path_bars("events", "event_type", "ts", "event_id", "value", 50.0, 0.012, "hour")
DAY_BARS = path_bars("orders", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", 250000.0, 0.03, "day")

SPLIT_BARS = """
bars_split AS (
  SELECT *, CASE WHEN ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2000-01-01' THEN 'train'
                 WHEN ts >= TIMESTAMP '2000-01-01' THEN 'test' END AS split
  FROM bars)"""


def over(keys: str, n: int | None = None) -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY {keys} ORDER BY ts{frame})"


def full(agg: str, x: str, n: int, keys: str) -> str:
    return f"CASE WHEN count({x}) {over(keys, n)} = {n} THEN {agg}({x}) {over(keys, n)} END"


def ix(src: str = "bars", keys: str = "symbol", name: str = "ix", where: str = "TRUE") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT *, row_number() {over(keys)} - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n_rows FROM {src} WHERE {where})"""


def on(keys: str, a: str = "p", b: str = "g") -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


def q(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


def rsi_ctes(src: str, keys: str, col: str, out: str, name: str) -> str:
    return f"""
{name}_d AS (SELECT *, {col} - lag({col}) {over(keys)} AS d FROM {src}),
{name}_g AS (
  SELECT * EXCLUDE (d), {full("avg", "CASE WHEN d > 0 THEN d ELSE 0.0::DOUBLE END", 14, keys)} AS g,
         {full("avg", "CASE WHEN d < 0 THEN -d ELSE 0.0::DOUBLE END", 14, keys)} AS l FROM {name}_d),
{name} AS (
  SELECT * EXCLUDE (g, l), CASE WHEN l > 0 THEN 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + g / l)
         WHEN g > 0 THEN 100.0::DOUBLE END AS {out} FROM {name}_g)"""


def atr_ctes(src: str, keys: str, p: str, name: str) -> str:
    prev = f"lag({p}close) {over(keys)}"
    return f"""
{name}_t AS (
  SELECT *, greatest({p}high - {p}low, abs({p}high - {prev}), abs({p}low - {prev})) AS {p}true_range FROM {src}),
{name} AS (SELECT *, {full("avg", f"{p}true_range", 12, keys)} AS {p}atr FROM {name}_t)"""


def aroon_sql(textbook: bool, keys: str = "symbol", src: str = "bars", name: str = "ar") -> str:
    def line(col: str, agg: str, out: str) -> str:
        pos = f"list_position(list({col}) {over(keys, 15)}, {agg}({col}) {over(keys, 15)}) - 1"
        steps = pos if textbook else f"14 - ({pos})"
        return f"CASE WHEN count({col}) {over(keys, 15)} = 15 THEN 100.0::DOUBLE * ({steps}) / 14.0::DOUBLE END AS {out}"

    return f"""
{name}_0 AS (SELECT *, {line("high", "max", "aroon_up")}, {line("low", "min", "aroon_down")} FROM {src}),
{name} AS (
  SELECT *, CASE WHEN aroon_up > aroon_down THEN 1 WHEN aroon_up < aroon_down THEN -1 ELSE 0 END AS aroon_signal FROM {name}_0)"""


def ma_ctes(src: str, keys: str, name: str = "ma") -> str:
    return f"""
{name}_0 AS (SELECT *, {full("avg", "close", 7, keys)} AS ma7, {full("avg", "close", 14, keys)} AS ma14 FROM {src}),
{name} AS (SELECT *, CASE WHEN ma7 > ma14 THEN 1 WHEN ma7 < ma14 THEN -1 ELSE 0 END AS ma_signal FROM {name}_0)"""


def ema_ctes(src: str, keys: str, name: str = "em") -> str:
    step = ", ".join(f"p.ema{n} * (1 - 2.0::DOUBLE / {n + 1}) + g.close * 2.0::DOUBLE / {n + 1}" for n in (7, 14, 28))
    return f"""
{name}_r AS (
  SELECT {keys}, pos, close AS ema7, close AS ema14, close AS ema28 FROM {src} WHERE pos = 0
  UNION ALL
  SELECT {", ".join("g." + k.strip() for k in keys.split(","))}, g.pos, {step} FROM {name}_r p JOIN {src} g ON {on(keys)} AND g.pos = p.pos + 1),
{name} AS (
  SELECT *, CASE WHEN ema7 > ema14 AND ema14 > ema28 THEN 1 WHEN ema7 < ema14 AND ema14 < ema28 THEN -1 ELSE 0 END AS ema_signal
  FROM {src} JOIN {name}_r USING ({keys}, pos))"""


def kalman_ctes(src: str, keys: str, p: str, name: str) -> str:
    names = ", ".join("g." + k.strip() for k in keys.split(","))
    return f"""
{name}_r AS (
  SELECT {keys}, pos, {p}close AS x, (1 - 1.0::DOUBLE / (1.0::DOUBLE + 0.1::DOUBLE)) * 1.0::DOUBLE + 0.01::DOUBLE AS v FROM {src} WHERE pos = 0
  UNION ALL
  SELECT {names}, g.pos, p.x + p.v / (p.v + 0.1::DOUBLE) * (g.{p}close - p.x),
         (1 - p.v / (p.v + 0.1::DOUBLE)) * p.v + 0.01::DOUBLE FROM {name}_r p JOIN {src} g ON {on(keys)} AND g.pos = p.pos + 1),
{name} AS MATERIALIZED (SELECT {src}.*, x AS {p}close_filtered FROM {src} JOIN {name}_r USING ({keys}, pos))"""


def regime_ctes(src: str, keys: str, p: str, name: str) -> str:
    names = ", ".join("g." + k.strip() for k in keys.split(","))
    hi = f"p.hi + (g.{p}close - g.{p}close_filtered - 0.8::DOUBLE * g.{p}sigma)"
    lo = f"p.lo + (-g.{p}close + g.{p}close_filtered - 0.8::DOUBLE * g.{p}sigma)"
    return f"""
{name}_s AS MATERIALIZED (SELECT *, {full("stddev_samp", f"{p}close", 5, keys)} AS {p}sigma FROM {src}),
{name}_r AS (
  SELECT {keys}, pos, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo FROM {name}_s WHERE pos = 0
  UNION ALL
  SELECT {names}, g.pos, CASE WHEN {hi} > 0 THEN {hi} ELSE 0.0::DOUBLE END, CASE WHEN {lo} > 0 THEN {lo} ELSE 0.0::DOUBLE END
  FROM {name}_r p JOIN {name}_s g ON {on(keys)} AND g.pos = p.pos + 1),
{name} AS MATERIALIZED (
  SELECT {name}_s.*, hi AS {p}s_hi, lo AS {p}s_lo, CASE WHEN hi > 1.5::DOUBLE * {p}sigma THEN 'bullish' ELSE 'bearish' END AS {p}regime
  FROM {name}_s JOIN {name}_r USING ({keys}, pos))"""


def supertrend_ctes(src: str, keys: str, p: str, name: str) -> str:
    names = ", ".join("g." + k.strip() for k in keys.split(","))
    cols = ", ".join(k.strip() for k in keys.split(","))
    return f"""
{name}_b AS MATERIALIZED (
  SELECT {keys}, pos, {p}close AS c, ({p}high + {p}low) / 2.0::DOUBLE + 2.5::DOUBLE * {p}atr AS ub, ({p}high + {p}low) / 2.0::DOUBLE - 2.5::DOUBLE * {p}atr AS lb
  FROM {src}),
{name}_r AS (
  SELECT {keys}, pos, ub AS st, 1 AS trend FROM {name}_b WHERE pos = 0
  UNION ALL
  SELECT {cols}, pos, CASE WHEN t = 1 THEN (CASE WHEN lb < st THEN st ELSE lb END) ELSE (CASE WHEN ub > st THEN st ELSE ub END) END, t
  FROM (SELECT {names}, g.pos, g.lb, g.ub, p.st, CASE WHEN g.c > p.st THEN 1 WHEN g.c < p.st THEN -1 ELSE p.trend END AS t
        FROM {name}_r p JOIN {name}_b g ON {on(keys)} AND g.pos = p.pos + 1)),
{name} AS MATERIALIZED (
  SELECT {src}.*, st AS {p}supertrend, CASE WHEN pos = 0 THEN 0 ELSE trend END AS {p}supertrend_direction FROM {src} JOIN {name}_r USING ({keys}, pos))"""


def hurst_ctes(src: str, keys: str, p: str, name: str) -> str:
    """Block by block: every window is cut into its blocks and measured on its own."""
    eq = on(keys, "t", "b")
    tk = ", ".join("t." + k.strip() for k in keys.split(","))
    return f"""
{name}_blocks AS (
  SELECT {tk}, t.pos, s.size, (b.pos - (t.pos - 119)) // s.size AS block, max(b.{p}close) - min(b.{p}close) AS span,
         stddev_samp(CASE WHEN (b.pos - (t.pos - 119)) % s.size > 0 THEN b.d END) AS spread
  FROM {src} t JOIN (SELECT *, {p}close - lag({p}close) {over(keys)} AS d FROM {src}) b
    ON {eq} AND b.pos BETWEEN t.pos - 119 AND t.pos
  JOIN (SELECT unnest([10, 17, 31, 56, 100, 120]) AS size) s ON (b.pos - (t.pos - 119)) // s.size < 120 // s.size
  WHERE t.pos >= 119 GROUP BY ALL),
{name}_means AS (
  SELECT {keys}, pos, size, avg(CASE WHEN span > 0 AND spread > 0 THEN span / spread END) AS m FROM {name}_blocks GROUP BY ALL),
{name}_h AS (
  SELECT {keys}, pos, CASE WHEN count(m) = 6 THEN regr_slope(log10(m), log10(size)) END AS {p}hurst FROM {name}_means GROUP BY {keys}, pos),
{name} AS MATERIALIZED (SELECT {src}.*, {p}hurst FROM {src} LEFT JOIN {name}_h USING ({keys}, pos))"""


PK = "leader, follower"
PAIRS = f"""
pairs AS (
  SELECT l.symbol AS leader, f.symbol AS follower, l.ts, {", ".join(f"l.{c} AS leader_{c}" for c in OHLCV)}, {", ".join(f"f.{c} AS follower_{c}" for c in OHLCV)}
  FROM bars l JOIN bars f ON l.ts = f.ts AND l.symbol = 'purchase' AND f.symbol <> 'purchase')"""
CORR = f"""CASE WHEN count(*) {over(PK, 7)} = 7 AND stddev_samp(leader_close) {over(PK, 7)} * stddev_samp(follower_close) {over(PK, 7)} <> 0
  THEN covar_samp(leader_close, follower_close) {over(PK, 7)} / (stddev_samp(leader_close) {over(PK, 7)} * stddev_samp(follower_close) {over(PK, 7)}) END"""


def bands(p: str) -> str:
    mean, sd = full("avg", f"{p}close", 20, PK), full("stddev_samp", f"{p}close", 20, PK)
    return f"{mean} AS {p}bollinger_middle, {mean} + 2.0::DOUBLE * ({sd}) AS {p}bollinger_upper, {mean} - 2.0::DOUBLE * ({sd}) AS {p}bollinger_lower"


PAIR_INDICATORS = ",".join(
    [
        HOUR_BARS, PAIRS, ix("pairs", PK, "px"),
        rsi_ctes("px", PK, "leader_close", "leader_rsi", "p1"), rsi_ctes("p1", PK, "follower_close", "follower_rsi", "p2"),
        atr_ctes("p2", PK, "leader_", "p3"), atr_ctes("p3", PK, "follower_", "p4"),
        f"\np5 AS MATERIALIZED (SELECT *, {CORR} AS correlation, {bands('leader_')}, {bands('follower_')}, min(follower_low) {over(PK, 25)} AS low25,"
        f" lag(leader_rsi) {over(PK)} AS leader_rsi_prev, lag(follower_rsi) {over(PK)} AS follower_rsi_prev FROM p4)",
        hurst_ctes("p5", PK, "leader_", "p6"), hurst_ctes("p6", PK, "follower_", "p7"),
        kalman_ctes("p7", PK, "leader_", "p8"), kalman_ctes("p8", PK, "follower_", "p9"),
        regime_ctes("p9", PK, "leader_", "p10"), regime_ctes("p10", PK, "follower_", "p11"),
        supertrend_ctes("p11", PK, "leader_", "p12"), supertrend_ctes("p12", PK, "follower_", "p13"),
    ]
)

GATES = """
gated_0 AS (
  SELECT *, coalesce(leader_atr < 0.012::DOUBLE * leader_open AND correlation > 0 AND follower_hurst > 0.45::DOUBLE, FALSE) AS tradeable FROM p13),
gated AS MATERIALIZED (
  SELECT *,
    coalesce(tradeable AND leader_rsi > 55 AND leader_regime = 'bullish' AND leader_close > leader_bollinger_middle AND follower_supertrend_direction = 1, FALSE) AS enter_long,
    coalesce(tradeable AND leader_rsi < 45 AND leader_regime = 'bearish' AND leader_close < leader_bollinger_lower AND follower_supertrend_direction = -1, FALSE) AS enter_short,
    coalesce(tradeable AND leader_rsi < 45 AND follower_rsi < follower_rsi_prev AND leader_regime = 'bearish' AND leader_close < leader_bollinger_lower AND follower_supertrend_direction = -1, FALSE) AS exit_long,
    coalesce(tradeable AND leader_rsi > 55 AND leader_rsi_prev > 55 AND follower_rsi > follower_rsi_prev AND leader_regime = 'bullish' AND leader_close > leader_bollinger_middle AND follower_supertrend_direction = 1, FALSE) AS exit_short,
    coalesce(leader_atr > 0.018::DOUBLE * leader_open, FALSE) AS vol_exit
  FROM gated_0)"""


def machine(grid: str, rows: str = "n_rows") -> str:
    """The rule-driven position machine, one bar at a time, for the rows of ``grid(param_id, max_hold, cooldown)``.

    ``rows`` is the length of a series; without a bound (a stream) nothing is closed on the last row.
    """
    hours = "date_diff('second', {}, ts) / 3600.0::DOUBLE"
    stop = "(CASE WHEN low25 < 0.9::DOUBLE * hi THEN (low25 + 0.9::DOUBLE * hi) / 2 ELSE low25 END)"
    return f"""
grid AS ({grid}),
bar AS MATERIALIZED (
  SELECT leader, follower, ts, pos, {rows} AS n_rows, follower_close AS close, follower_low AS low, low25, enter_long, enter_short, exit_long, exit_short, vol_exit FROM gated),
m AS (
  SELECT leader, follower, param_id, max_hold, cooldown, -1::BIGINT AS pos, 0 AS held, NULL::TIMESTAMP AS entry_ts, NULL::TIMESTAMP AS stop_ts,
         NULL::DOUBLE AS entry_price, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo, 'none' AS act, 0 AS was
  FROM (SELECT DISTINCT leader, follower FROM bar), grid
  UNION ALL
  SELECT leader, follower, param_id, max_hold, cooldown, pos,
         CASE WHEN act IN ('stop', 'close') THEN 0 WHEN act = 'long' THEN 1 WHEN act = 'short' THEN -1 ELSE held END,
         CASE WHEN act IN ('long', 'short') THEN ts WHEN act IN ('stop', 'close') THEN NULL ELSE entry_ts END,
         CASE WHEN act = 'stop' THEN ts ELSE stop_ts END,
         CASE WHEN act IN ('long', 'short') THEN close ELSE entry_price END,
         CASE WHEN act = 'long' THEN close ELSE hi END, CASE WHEN act = 'short' THEN close ELSE lo END, act, held
  FROM (
    SELECT *, CASE
      WHEN stop_ts IS NOT NULL AND {hours.format("stop_ts")} < cooldown THEN 'none'
      WHEN pos = n_rows - 1 AND held <> 0 THEN 'close'
      WHEN held = 1 AND close <= {stop} THEN 'stop'
      WHEN held = -1 AND close >= 1.1::DOUBLE * lo THEN 'stop'
      WHEN held <> 0 AND {hours.format("entry_ts")} >= max_hold THEN 'stop'
      WHEN held <> 0 AND vol_exit THEN 'stop'
      WHEN held = 0 AND enter_short THEN 'short'
      WHEN held = 0 AND enter_long THEN 'long'
      WHEN held = 1 AND exit_long THEN 'close'
      WHEN held = -1 AND exit_short THEN 'close'
      ELSE 'none' END AS act
    FROM (
      SELECT b.*, p.param_id, p.max_hold, p.cooldown, p.held, p.entry_ts, p.stop_ts, p.entry_price,
             CASE WHEN p.held = 1 THEN greatest(p.hi, b.close) END AS hi, CASE WHEN p.held = -1 THEN least(p.lo, b.low) END AS lo
      FROM m p JOIN bar b ON p.leader = b.leader AND p.follower = b.follower AND b.pos = p.pos + 1))),
signalled AS MATERIALIZED (
  SELECT gated.*, param_id, max_hold, cooldown, held, was, entry_price, hi, lo,
         CASE WHEN act = 'long' THEN 1 WHEN act = 'short' THEN -1 WHEN act IN ('stop', 'close') THEN -was ELSE 0 END::INT AS signals,
         CASE WHEN act IN ('long', 'short') THEN act WHEN act IN ('stop', 'close') THEN 'close' ELSE ' ' END AS trade_type
  FROM gated JOIN m USING (leader, follower, pos))"""


DEFAULT_GRID = "SELECT 0 AS param_id, 672.0::DOUBLE AS max_hold, 24.0::DOUBLE AS cooldown"
SHORT_GRID = "SELECT 0 AS param_id, 48.0::DOUBLE AS max_hold, 12.0::DOUBLE AS cooldown"
SWEEP_GRID = (
    "SELECT row_number() OVER (ORDER BY h, c) - 1 AS param_id, h * 48.0::DOUBLE AS max_hold, c * 2.0::DOUBLE AS cooldown "
    "FROM (SELECT unnest([7, 14, 21, 28, 35]) AS h), (SELECT unnest([12, 24, 48, 72, 96]) AS c)"
)
FOLLOWER = ", ".join(num(f"follower_{c}", c) for c in OHLCV)


def follower_returns(by: str) -> str:
    """Bar returns of the mark-to-market balance of the follower positions; shorts use the whole balance."""
    c = "0.0015::DOUBLE"

    def held_value(price: str) -> str:
        return f"CASE WHEN side = 1 THEN (1 - {c}) * {price} / e WHEN side = -1 THEN 1 + (1 - {c}) - {price} / e END"

    return f"""
ret_0 AS (
  SELECT *, lag(follower_close) OVER (PARTITION BY {by} ORDER BY ts) AS before, CASE WHEN was <> 0 THEN was ELSE held END AS side,
         CASE WHEN was <> 0 THEN lag(entry_price) OVER (PARTITION BY {by} ORDER BY ts) ELSE entry_price END AS e FROM signalled),
ret AS (
  SELECT *, CASE WHEN side = 0 THEN 0.0::DOUBLE ELSE
    ({held_value("follower_close")} - CASE WHEN was <> 0 AND held = 0 THEN follower_close / e * {c} * (CASE WHEN side = 1 THEN 1 - {c} ELSE 1 END) ELSE 0 END)
    / (CASE WHEN was = 0 THEN 1 ELSE {held_value("before")} END) - 1 END AS r FROM ret_0)"""


def ratios(bars_per_year: int) -> str:
    return (
        f"avg(r) / nullif(stddev_samp(r), 0) * sqrt({bars_per_year}.0::DOUBLE) AS sharpe, "
        f"avg(r) / nullif(sqrt(sum(least(r, 0.0::DOUBLE) ** 2) / count(*)), 0) * sqrt({bars_per_year}.0::DOUBLE) AS sortino"
    )


def single_asset(src: str, keys: str) -> str:
    """All single-asset indicators of ``src``; ``done`` holds the rows that are complete."""
    pct = f"coalesce((close / lag(close) {over(keys)} - 1) * 100, 0.0::DOUBLE)"
    return ",".join(
        [
            ix(src, keys, "sx"), ma_ctes("sx", keys), aroon_sql(False, keys, "ma", "ar"), rsi_ctes("ar", keys, "close", "rsi_14", "rs"),
            f"""
rt AS MATERIALIZED (
  SELECT *, CASE WHEN rsi_14 > 75 THEN 1 WHEN rsi_14 < 35 THEN -1 ELSE 0 END AS rsi_signal, ln(close / lag(close) {over(keys)}) AS returns,
         {pct} AS pct_change FROM rs)""",
            ema_ctes("rt", keys),
            """
done_0 AS (
  SELECT * EXCLUDE (pos, n_rows) FROM em WHERE ma7 IS NOT NULL AND ma14 IS NOT NULL AND aroon_up IS NOT NULL AND rsi_14 IS NOT NULL AND returns IS NOT NULL)""",
            ix("done_0", keys, "done"),
        ]
    )


ACTION = """
acted AS MATERIALIZED (
  SELECT *, CASE WHEN rsi_signal = 1 THEN 2 WHEN rsi_signal = -1 THEN 4 WHEN aroon_signal = 1 AND ema_signal = 1 THEN 1
                 WHEN aroon_signal = -1 AND ema_signal = -1 THEN 3 ELSE 0 END AS action FROM done)"""


def hard_stop(keys: str, action: str = "g.action") -> str:
    """The action-driven machine with its hard stop, one bar at a time; ``played`` holds its records."""
    names = ", ".join("g." + k.strip() for k in keys.split(","))
    cols = ", ".join(k.strip() for k in keys.split(","))
    return f"""
h AS (
  SELECT {cols}, -1::BIGINT AS pos, 0 AS held, 0.0::DOUBLE AS entry, 0 AS signals, ' ' AS trade_type, 0.0::DOUBLE AS price, 0 AS was, 0.0::DOUBLE AS was_entry
  FROM (SELECT DISTINCT {cols} FROM acted)
  UNION ALL
  SELECT {cols}, pos,
         CASE WHEN s IN (1, 2) AND tt IN ('long', 'short_reversal') THEN 1 WHEN tt IN ('short', 'long_reversal') THEN -1 WHEN tt = ' ' THEN held ELSE 0 END,
         CASE WHEN tt IN ('long', 'short_reversal', 'short', 'long_reversal') THEN close ELSE entry END, s, tt,
         CASE WHEN pos = n_rows - 1 THEN last_close ELSE close END, held, entry
  FROM (
    SELECT *, CASE tt WHEN 'long' THEN 1 WHEN 'short_reversal' THEN 2 WHEN 'short' THEN -1 WHEN 'long_reversal' THEN -2
                      WHEN 'long_close' THEN -1 WHEN 'short_close' THEN 1 ELSE 0 END AS s
    FROM (
      SELECT *, CASE
        WHEN pos = n_rows - 1 THEN (CASE held WHEN 1 THEN 'long_close' WHEN -1 THEN 'short_close' ELSE ' ' END)
        WHEN action = 1 AND held = -1 THEN 'short_reversal' WHEN action = 1 AND held = 0 THEN 'long'
        WHEN action = 3 AND held = 1 THEN 'long_reversal' WHEN action = 3 AND held = 0 THEN 'short'
        WHEN action = 2 AND held = 1 THEN 'long_close' WHEN action = 4 AND held = -1 THEN 'short_close'
        WHEN held = 1 AND close <= entry * 0.95::DOUBLE THEN 'long_close'
        WHEN held = -1 AND close >= entry * 1.05::DOUBLE THEN 'short_close' ELSE ' ' END AS tt
      FROM (SELECT {names}, g.pos, g.n_rows, g.close, {action} AS action, p.held, p.entry, lag_close.close AS last_close
            FROM h p JOIN acted g ON {on(keys)} AND g.pos = p.pos + 1
            LEFT JOIN acted lag_close ON {on(keys, "lag_close", "g")} AND lag_close.pos = g.pos - 1)))),
played AS MATERIALIZED (
  SELECT acted.*, h.held, h.entry, h.signals::INT AS signals, h.trade_type, h.price, h.was, h.was_entry FROM acted JOIN h USING ({cols}, pos))"""


def ledger_ctes(keys: str, price: str, share: str) -> str:
    opened = "trade_type IN ('long', 'short', 'short_reversal', 'long_reversal')"
    closed = "trade_type IN ('close', 'long_close', 'short_close', 'short_reversal', 'long_reversal')"
    return f"""
opened AS (SELECT {keys}, ts, {price} AS price, sign(signals)::INT AS side, row_number() {over(keys)} AS trade_id FROM signalled WHERE {opened}),
closed AS (SELECT {keys}, ts, {price} AS price, row_number() {over(keys)} AS trade_id FROM signalled WHERE {closed}),
ledger AS MATERIALIZED (
  SELECT {keys}, trade_id, side, o.ts AS entry_ts, c.ts AS exit_ts, o.price AS entry_price, c.price AS exit_price,
         CASE WHEN side = 1 THEN (1 - 0.0015::DOUBLE) ** 2 * c.price / o.price
              ELSE 1 + {share}::DOUBLE * ((1 - 0.0015::DOUBLE) - c.price / o.price * (1 + 0.0015::DOUBLE)) END AS factor,
         date_diff('second', o.ts, c.ts) / 3600.0::DOUBLE AS hours
  FROM opened o LEFT JOIN closed c USING ({keys}, trade_id))"""


PLAYED = ",".join([DAY_BARS, single_asset("bars", "symbol"), ACTION, hard_stop("symbol"), "\nsignalled AS (SELECT * FROM played)"])
PLAYED_LEDGER = PLAYED + "," + ledger_ctes("symbol", "price", "0.75")
EQUITY = (
    PLAYED_LEDGER
    + """,
eq_0 AS (
  SELECT *, CASE WHEN was <> 0 AND signals <> 0 THEN ln(greatest(CASE WHEN was = 1 THEN (1 - 0.0015::DOUBLE) ** 2 * price / was_entry
           ELSE 1 + 0.75::DOUBLE * ((1 - 0.0015::DOUBLE) - price / was_entry * (1 + 0.0015::DOUBLE)) END, 1e-300::DOUBLE)) ELSE 0.0::DOUBLE END AS lf,
         CASE WHEN pos = n_rows - 1 THEN 0 ELSE held END AS side FROM played),
eq AS MATERIALIZED (
  SELECT *, exp(sum(lf) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS balance_factor,
         1000.0::DOUBLE * exp(sum(lf) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) *
         CASE side WHEN 1 THEN (1 - 0.0015::DOUBLE) * close / entry WHEN -1 THEN 1 + 0.75::DOUBLE * ((1 - 0.0015::DOUBLE) - close / entry) ELSE 1 END AS equity
  FROM eq_0)"""
)
BROKE = """
ends AS (
  SELECT symbol, min(CASE WHEN trade_type = 'short_close' THEN pos + 1 ELSE pos END) AS stop_pos FROM eq
  WHERE pos < n_rows - 1 AND balance_factor < 0.9::DOUBLE AND trade_type IN ('short_close', 'long', 'short', 'short_reversal', 'long_reversal') GROUP BY symbol)"""
EXCURSION = """
worst AS (
  SELECT l.symbol, l.trade_id, CASE WHEN side = 1 THEN (entry_price - min(b.low)) / entry_price * 100 ELSE (max(b.high) - entry_price) / entry_price * 100 END AS w
  FROM ledger l JOIN played b ON l.symbol = b.symbol AND b.ts > l.entry_ts AND b.ts <= coalesce(l.exit_ts, TIMESTAMP '9999-01-01')
  GROUP BY l.symbol, l.trade_id, side, entry_price),
book AS MATERIALIZED (SELECT ledger.*, greatest(w, 0.0::DOUBLE) AS mae_pct FROM ledger LEFT JOIN worst USING (symbol, trade_id))"""
QUARTERS = """
periods AS (
  SELECT symbol, date_trunc('quarter', ts)::TIMESTAMP AS from_ts, (last(close ORDER BY ts) / first(close ORDER BY ts) - 1) * 100 AS benchmark_pct
  FROM bars GROUP BY ALL),
ends AS (SELECT symbol, max(ts) AS last_ts FROM bars GROUP BY symbol),
stats AS (
  SELECT symbol, date_trunc('quarter', exit_ts)::TIMESTAMP AS from_ts, count(*) AS total_trades, count(*) FILTER (side = 1) AS long_trades,
         count(*) FILTER (side = -1) AS short_trades, avg((factor > 1)::INT) * 100 AS win_rate_pct,
         1000.0::DOUBLE * exp(sum(ln(greatest(factor, 1e-300::DOUBLE)))) AS final_balance, max(mae_pct) AS mae_pct
  FROM book WHERE exit_ts IS NOT NULL GROUP BY ALL),
quarters_0 AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY from_ts) AS idx, from_ts,
         least(from_ts + INTERVAL 3 MONTH - INTERVAL 1 SECOND, last_ts) AS to_ts, 1000.0::DOUBLE AS initial_balance,
         coalesce(final_balance, 1000.0::DOUBLE) AS final_balance, benchmark_pct, coalesce(total_trades, 0) AS total_trades,
         coalesce(long_trades, 0) AS long_trades, coalesce(short_trades, 0) AS short_trades, win_rate_pct, mae_pct
  FROM periods LEFT JOIN stats USING (symbol, from_ts) JOIN ends USING (symbol)),
quarters AS MATERIALIZED (
  SELECT *, (final_balance / initial_balance - 1) * 100 AS profit_pct,
         CASE WHEN (final_balance / initial_balance - 1) * 100 > benchmark_pct THEN 'Yes' ELSE 'No' END AS beaten FROM quarters_0)"""

SK = "symbol, split"
SPLIT_SINGLE = ",".join([DAY_BARS, SPLIT_BARS, "\nparted AS (SELECT * FROM bars_split WHERE split IS NOT NULL)", single_asset("parted", SK)])
STATES = (
    SPLIT_SINGLE
    + """,
coded AS MATERIALIZED (
  SELECT *, least(19, floor((least(greatest(pct_change, -5.0::DOUBLE), 5.0::DOUBLE) + 5) * 2))::INT AS pct_bin FROM done),
states AS MATERIALIZED (
  SELECT *, ((aroon_signal + 1) * 540 + (rsi_signal + 1) * 180 + (ema_signal + 1) * 60 + 20 + pct_bin)::INT AS state_index FROM coded)"""
)
STEPS = """
stepped AS (
  SELECT *, lead(state_index) OVER (PARTITION BY symbol, split ORDER BY ts) AS to_state,
         lead(close) OVER (PARTITION BY symbol, split ORDER BY ts) / close - 1 AS next_return FROM states WHERE split = 'train'),
occupied AS (
  SELECT state_index, count(*) AS n, avg(next_return) AS mean_return, avg(abs(next_return)) AS mean_move FROM stepped WHERE to_state IS NOT NULL GROUP BY 1),
policy AS (
  SELECT state_index, 0 AS action, -mean_move AS q FROM occupied
  UNION ALL SELECT state_index, 1, mean_return - 0.0015::DOUBLE FROM occupied
  UNION ALL SELECT state_index, 3, 0.75::DOUBLE * -mean_return - 0.75::DOUBLE * 0.0015::DOUBLE FROM occupied),
best AS (SELECT state_index, action FROM policy QUALIFY row_number() OVER (PARTITION BY state_index ORDER BY q DESC, action) = 1),
chosen AS MATERIALIZED (SELECT states.*, coalesce(action, 0)::INT AS action FROM states LEFT JOIN best USING (state_index) WHERE split = 'test')"""

HELD_POLICY = """
hpolicy AS (
  SELECT state_index, action, q FROM policy
  UNION ALL SELECT state_index + 20, 0, mean_return FROM occupied
  UNION ALL SELECT state_index + 20, 2, -mean_move - 0.0015::DOUBLE FROM occupied
  UNION ALL SELECT state_index + 20, 3, 0.75::DOUBLE * -mean_return - 0.0015::DOUBLE - 0.75::DOUBLE * 0.0015::DOUBLE FROM occupied
  UNION ALL SELECT state_index - 20, 0, 0.75::DOUBLE * -mean_return FROM occupied
  UNION ALL SELECT state_index - 20, 4, -mean_move - 0.75::DOUBLE * 0.0015::DOUBLE FROM occupied
  UNION ALL SELECT state_index - 20, 1, mean_return - 0.0015::DOUBLE - 0.75::DOUBLE * 0.0015::DOUBLE FROM occupied),
hbest AS (SELECT state_index, action FROM hpolicy QUALIFY row_number() OVER (PARTITION BY state_index ORDER BY q DESC, action) = 1),
acted AS MATERIALIZED (
  SELECT s.*, coalesce(a.action, 0) AS action, coalesce(b.action, 0) AS action_long, coalesce(c.action, 0) AS action_short
  FROM states s LEFT JOIN hbest a ON a.state_index = s.state_index LEFT JOIN hbest b ON b.state_index = s.state_index + 20
  LEFT JOIN hbest c ON c.state_index = s.state_index - 20 WHERE split = 'test')"""
BY_HELD = "CASE {h} WHEN 1 THEN {t}action_long WHEN -1 THEN {t}action_short ELSE {t}action END"


def gap_ctes() -> str:
    """Means and levels over holes, row by row: weights decay and the variance grows on rows without a price."""

    def mean(n: int) -> str:
        old = f"pow(1 - 2.0::DOUBLE / {n + 1}, p.g + 1)"
        return f"CASE WHEN t.close IS NULL THEN p.ema{n} WHEN p.ema{n} IS NULL THEN t.close ELSE ({old} * p.ema{n} + 2.0::DOUBLE / {n + 1} * t.close) / ({old} + 2.0::DOUBLE / {n + 1}) END"

    prior = "(p.v + 0.01::DOUBLE)"
    first = "0.1::DOUBLE / 1.1::DOUBLE"
    return f"""
thin AS (SELECT symbol, ts, CASE WHEN volume >= 60 THEN close END AS close FROM bars),
{ix("thin", "symbol", "tx")},
gr AS (
  SELECT symbol, pos, close AS ema7, close AS ema14, close AS ema28, 0::BIGINT AS g, close AS x, {first} AS v FROM tx WHERE pos = 0
  UNION ALL
  SELECT t.symbol, t.pos, {mean(7)}, {mean(14)}, {mean(28)}, CASE WHEN t.close IS NULL THEN p.g + 1 ELSE 0 END,
    CASE WHEN t.close IS NULL THEN p.x WHEN p.x IS NULL THEN t.close ELSE p.x + {prior} / ({prior} + 0.1::DOUBLE) * (t.close - p.x) END,
    CASE WHEN t.close IS NULL THEN {prior} WHEN p.x IS NULL THEN {first} ELSE (1 - {prior} / ({prior} + 0.1::DOUBLE)) * {prior} END
  FROM gr p JOIN tx t ON t.symbol = p.symbol AND t.pos = p.pos + 1)"""


#: The tail of Student's t for whole degrees of freedom, as a finite sum of powers of a cosine.
T_TAIL = """
tt AS (SELECT *, n - 2 AS nu, abs(r * sqrt((n - 2) / (1 - r * r))) AS t FROM c),
th AS (SELECT *, atan(t / sqrt(nu)) AS a FROM tt),
terms AS (
  SELECT leader, follower, nu, a, 1 AS i, CASE WHEN nu % 2 = 0 THEN 1.0::DOUBLE ELSE cos(a) END AS term, CASE WHEN nu = 1 THEN 0.0::DOUBLE WHEN nu % 2 = 0 THEN 1.0::DOUBLE ELSE cos(a) END AS s FROM th
  UNION ALL
  SELECT leader, follower, nu, a, i + 1, term * f, s + term * f
  FROM (SELECT *, cos(a) * cos(a) * CASE WHEN nu % 2 = 0 THEN (2 * i - 1) / (2.0::DOUBLE * i) ELSE 2 * i / (2.0::DOUBLE * i + 1) END AS f FROM terms WHERE i < nu // 2)),
tails AS (
  SELECT leader, follower, 1 - CASE WHEN nu % 2 = 0 THEN sin(a) * s ELSE 2 / pi() * (a + sin(a) * s) END AS p
  FROM terms QUALIFY row_number() OVER (PARTITION BY leader, follower ORDER BY i DESC) = 1)"""

TRIMMED = GATES.replace("\ngated AS", "\ngated_all AS") + f""",
gated AS MATERIALIZED (
  SELECT * EXCLUDE (pos, n_rows, low25), row_number() {over(PK)} - 1 AS pos, count(*) OVER (PARTITION BY {PK}) AS n_rows, min(follower_low) {over(PK, 25)} AS low25
  FROM gated_all WHERE ts >= TIMESTAMP '2024-01-09' AND ts <= TIMESTAMP '2024-01-25')"""

PAIR_EMAS = "".join(
    [
        "\npe AS (\n  SELECT leader, follower, pos, ", ", ".join(f"{s}_close AS {s}_ema{n}" for s in ("leader", "follower") for n in (7, 14, 28)), " FROM p13 WHERE pos = 0\n",
        "  UNION ALL SELECT g.leader, g.follower, g.pos, ",
        ", ".join(f"p.{s}_ema{n} * (1 - 2.0::DOUBLE / {n + 1}) + g.{s}_close * 2.0::DOUBLE / {n + 1}" for s in ("leader", "follower") for n in (7, 14, 28)),
        " FROM pe p JOIN p13 g ON p.leader = g.leader AND p.follower = g.follower AND g.pos = p.pos + 1)",
    ]
)

K = "symbol, ts"
KP = "leader, follower, ts"


def simple(bars: str, select: str, *more: str) -> str:
    return q(bars, *more, select=select)


REJECTED = """
WITH e AS (
  SELECT CASE WHEN event_id % 89 <> 0 THEN event_type END AS symbol, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts FROM events)
SELECT symbol, count(*) FILTER (WHERE ts IS NULL) AS without_time, count(*) FILTER (WHERE symbol IS NULL) AS without_key, count(*) AS n_rows
FROM e GROUP BY symbol HAVING count(*) FILTER (WHERE ts IS NULL OR symbol IS NULL) > 0
"""


def touches(bars: str) -> str:
    """First later close beyond a barrier, or the first bar after the limit, of each row where the averages cross upwards."""
    return q(
        bars, ix(), ma_ctes("ix", "symbol"),
        f"""
flag AS (SELECT *, lag(ma_signal) {over("symbol")} AS was FROM ma),
entries AS (SELECT symbol, ts AS entry_ts, close AS entry_price FROM flag WHERE ma_signal = 1 AND was <> 1),
touched AS (
  SELECT e.*, b.ts AS touch_ts, b.close AS touch_price,
         CASE WHEN b.close >= entry_price * 1.05::DOUBLE THEN 'up' WHEN b.close <= entry_price * 0.95::DOUBLE THEN 'down' ELSE 'time' END AS touch
  FROM entries e JOIN bars b ON b.symbol = e.symbol AND b.ts > entry_ts
   AND (b.close >= entry_price * 1.05::DOUBLE OR b.close <= entry_price * 0.95::DOUBLE OR b.ts >= entry_ts + INTERVAL 72 HOUR)
  QUALIFY row_number() OVER (PARTITION BY e.symbol, entry_ts ORDER BY b.ts) = 1)""",
        select=f"SELECT e.symbol, e.entry_ts, {num('e.entry_price', 'entry_price')}, touch_ts, {nums('touch_price')}, touch FROM entries e LEFT JOIN touched USING (symbol, entry_ts)",
    )


def oracle_sql() -> dict[str, str]:
    ma, atr = ma_ctes("bars", "symbol"), atr_ctes("bars", "symbol", "", "a")
    rsi = rsi_ctes("bars", "symbol", "close", "rsi_14", "rs")
    regimes = [HOUR_BARS, ix(), kalman_ctes("ix", "symbol", "", "k"), regime_ctes("k", "symbol", "", "g")]
    boll_mean, boll_sd = full("avg", "close", 20, "symbol"), full("stddev_samp", "close", 20, "symbol")
    pair_gates = [PAIR_INDICATORS, GATES]
    pair_names = ["rsi", "atr", "close_filtered", "hurst", "bollinger_middle", "bollinger_upper", "bollinger_lower", "supertrend"]
    signalled = [*pair_gates, machine(DEFAULT_GRID)]
    quarters = [PLAYED_LEDGER, EXCURSION, QUARTERS]
    segments = """
flagged AS (SELECT *, CASE WHEN regime = lag(regime) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS new FROM g),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM flagged)"""
    lags = f"""
rets AS (
  SELECT *, leader_close / lag(leader_close) {over(PK)} - 1 AS lr, follower_close / lag(follower_close) {over(PK)} - 1 AS fr FROM px),
ks AS (SELECT unnest(range(-6, 7))::INT AS lag),
lagged AS (
  SELECT f.leader, f.follower, ks.lag, l.lr, f.fr FROM rets f CROSS JOIN ks
  JOIN rets l ON l.leader = f.leader AND l.follower = f.follower AND l.pos = f.pos - ks.lag)"""
    return {
        "rejected_rows": REJECTED,
        "bars_hourly": simple(VALUE_BARS, f"SELECT {K}, {nums(*OHLCV)} FROM bars"),
        "bars_path": simple(HOUR_BARS, f"SELECT {K}, {nums(*OHLCV)} FROM bars"),
        "bars_daily": simple(DAY_BARS, f"SELECT {K}, {nums(*OHLCV)} FROM bars"),
        "csv_round_trip": simple(VALUE_BARS, f"SELECT {K}, {nums(*OHLCV)} FROM bars"),
        "sma_cross": simple(VALUE_BARS, f"SELECT {K}, {nums('ma7', 'ma14')}, ma_signal FROM ma", ma),
        "price_changes": simple(
            VALUE_BARS,
            f"SELECT {K}, {num('close - prev', 'diff')}, {num('ln(close / prev)', 'returns')}, {num('coalesce((close / prev - 1) * 100, 0)', 'pct_change')} FROM b",
            f"\nb AS (SELECT *, lag(close) {over('symbol')} AS prev FROM bars)",
        ),
        "rsi": simple(
            VALUE_BARS, f"SELECT {K}, {nums('rsi_14')}, CASE WHEN rsi_14 > 75 THEN 1 WHEN rsi_14 < 35 THEN -1 ELSE 0 END AS rsi_signal FROM rs", rsi
        ),
        "aroon": simple(VALUE_BARS, f"SELECT {K}, {nums('aroon_up', 'aroon_down')}, aroon_signal FROM ar", aroon_sql(False)),
        "aroon_textbook": simple(VALUE_BARS, f"SELECT {K}, {nums('aroon_up', 'aroon_down')}, aroon_signal FROM ar", aroon_sql(True)),
        "atr": simple(VALUE_BARS, f"SELECT {K}, {nums('true_range', 'atr')} FROM a", atr),
        "rolling_std": simple(VALUE_BARS, f"SELECT {K}, {num(full('stddev_samp', 'close', 5, 'symbol'), 'sigma')} FROM bars"),
        "bollinger": simple(
            VALUE_BARS,
            f"SELECT {K}, {num('m', 'bollinger_middle')}, {num('m + 2 * s', 'bollinger_upper')}, {num('m - 2 * s', 'bollinger_lower')} FROM b",
            f"\nb AS (SELECT *, {boll_mean} AS m, {boll_sd} AS s FROM bars)",
        ),
        "rolling_low": simple(VALUE_BARS, f"SELECT {K}, {num(f'min(low) {over("symbol", 25)}', 'low25')} FROM bars"),
        "hurst": q(HOUR_BARS, ix(), hurst_ctes("ix", "symbol", "", "hu"), select=f"SELECT {K}, {nums('hurst')} FROM hu"),
        "previous_rsi": simple(
            VALUE_BARS,
            f"SELECT {K}, {num('b', 'rsi_14_prev')}, coalesce(rsi_14 < b, FALSE) AS falling, coalesce(b > 70, FALSE) AS was_high FROM pr",
            rsi,
            f"\npr AS (SELECT *, lag(rsi_14) {over('symbol')} AS b FROM rs)",
        ),
        "last_rows": simple(VALUE_BARS, f"SELECT {K}, {nums('close')}, pos, n_rows FROM ix WHERE pos = n_rows - 1", ix()),
        "ema_align": q(VALUE_BARS, ix(), ema_ctes("ix", "symbol"), select=f"SELECT {K}, {nums('ema7', 'ema14', 'ema28')}, ema_signal FROM em"),
        "kalman_level": q(HOUR_BARS, ix(), kalman_ctes("ix", "symbol", "", "k"), select=f"SELECT {K}, {nums('close_filtered')} FROM k"),
        "cusum_regime": q(*regimes, select=f"SELECT {K}, {nums('s_hi', 's_lo')}, regime FROM g"),
        "regime_segments": q(
            *regimes, segments,
            select=f"SELECT symbol, segment, min(regime) AS regime, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS bars, {num('last(close ORDER BY ts) / first(close ORDER BY ts) - 1', 'segment_return')} FROM numbered GROUP BY symbol, segment",
        ),
        "bullish_region": q(*regimes, select=f"SELECT {K}, {nums('close')} FROM g WHERE regime = 'bullish'"),
        "supertrend": q(
            HOUR_BARS, ix(), atr_ctes("ix", "symbol", "", "a"), supertrend_ctes("a", "symbol", "", "st"),
            select=f"SELECT {K}, {nums('supertrend')}, supertrend_direction FROM st",
        ),
        "ffill_clean": simple(
            VALUE_BARS,
            f"SELECT {K}, {nums(*OHLCV)} FROM filled WHERE close IS NOT NULL",
            f"""
thin AS (SELECT symbol, ts, open, volume, {", ".join(f"CASE WHEN volume >= 60 THEN {c} END AS {c}" for c in ("high", "low", "close"))} FROM bars),
filled AS (
  SELECT symbol, ts, open, volume, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("high", "low", "close"))} FROM thin)""",
        ),
        "recurrences_with_gaps": q(
            VALUE_BARS, gap_ctes(),
            select=f"SELECT {K}, {nums('close', 'ema7', 'ema14', 'ema28')}, CASE WHEN ema7 > ema14 AND ema14 > ema28 THEN 1 WHEN ema7 < ema14 AND ema14 < ema28 THEN -1 ELSE 0 END AS ema_signal, {num('x', 'close_filtered')} FROM tx JOIN gr USING (symbol, pos)",
        ),
        "csv_text_times": simple(VALUE_BARS, f"SELECT {K}, {nums(*OHLCV)} FROM ix WHERE pos % 11 <> 10", ix()),
        "two_file_pair": simple(
            VALUE_BARS,
            f"SELECT l.symbol AS leader, f.symbol AS follower, l.ts, {', '.join(num(f'{s[0]}.{c}', f'{s}_{c}') for s in ('leader', 'follower') for c in OHLCV)} FROM bars l JOIN bars f ON l.ts = f.ts AND l.symbol = 'purchase' AND f.symbol = 'click'",
        ),
        "blank_signals": simple(VALUE_BARS, f"SELECT {K}, {nums('close')}, 0 AS signals, ' ' AS trade_type FROM bars"),
        "split_slice": q(
            DAY_BARS, SPLIT_BARS, "\nparted AS (SELECT * FROM bars_split WHERE split IS NOT NULL)", ma_ctes("parted", SK),
            select=f"SELECT {K}, split, {nums('ma7', 'ma14')}, ma_signal FROM ma",
        ),
        "train_and_test": q(DAY_BARS, SPLIT_BARS, select=f"SELECT {K}, split, {nums('close')} FROM bars_split WHERE split IS NOT NULL"),
        "time_range": simple(
            VALUE_BARS, f"SELECT {K}, {nums('close', 'ma7', 'ma14')} FROM ma WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-21'", ma
        ),
        "single_asset": q(
            SPLIT_SINGLE,
            select=f"SELECT {K}, split, {nums('close', 'ma7', 'ma14')}, ma_signal, {nums('aroon_up', 'aroon_down')}, aroon_signal, {nums('rsi_14')}, rsi_signal, {nums('returns', 'ema7', 'ema14', 'ema28')}, ema_signal, {nums('pct_change')} FROM done",
        ),
        "pair_join": q(HOUR_BARS, PAIRS, select=f"SELECT {KP}, {nums(*[f'{s}_{c}' for s in ('leader', 'follower') for c in OHLCV])} FROM pairs"),
        "pair_asof": q(
            HOUR_BARS,
            select=f"SELECT l.symbol AS leader, f.symbol AS follower, f.ts, l.ts AS leader_ts, {', '.join(num(f'{s[0]}.{c}', f'{s}_{c}') for s in ('leader', 'follower') for c in OHLCV)} FROM (FROM bars WHERE symbol <> 'purchase') f ASOF JOIN (FROM bars WHERE symbol = 'purchase') l ON f.ts >= l.ts",
        ),
        "rolling_corr": q(HOUR_BARS, PAIRS, select=f"SELECT {KP}, {num(CORR, 'correlation')} FROM pairs"),
        "pair_indicators": q(
            PAIR_INDICATORS,
            select=f"SELECT {KP}, {nums(*[f'{s}_{c}' for s in ('leader', 'follower') for c in pair_names])}, leader_supertrend_direction, follower_supertrend_direction, leader_regime, follower_regime, {nums('correlation')} FROM p13",
        ),
        "gates": q(*pair_gates, select=f"SELECT {KP}, tradeable, enter_long, enter_short, exit_long, exit_short, vol_exit FROM gated"),
        "positions": q(*signalled, select=f"SELECT {KP}, {FOLLOWER}, {nums('leader_rsi')}, leader_regime, signals, trade_type FROM signalled"),
        "positions_narrow": q(*pair_gates, machine(SHORT_GRID), select=f"SELECT {KP}, {FOLLOWER}, signals, trade_type FROM signalled"),
        "positions_trimmed": q(
            PAIR_INDICATORS, TRIMMED, machine(DEFAULT_GRID), select=f"SELECT {KP}, pos, n_rows, {nums('low25')}, signals, trade_type FROM signalled"
        ),
        "lead_lag_ledger": q(
            *signalled, ledger_ctes(PK, "follower_close", "1.0"),
            select=f"SELECT {PK}, trade_id, side, entry_ts, exit_ts, {nums('entry_price', 'exit_price', 'factor', 'hours')} FROM ledger",
        ),
        "lead_lag_sharpe": q(
            *signalled, follower_returns(PK), f"\nx AS (SELECT {PK}, count(*) AS bars, {ratios(8760)} FROM ret GROUP BY {PK})",
            select=f"SELECT {PK}, bars, {nums('sharpe', 'sortino')} FROM x",
        ),
        "extremes_since_entry": q(
            *signalled,
            f"""
held_rows AS (
  SELECT {KP}, sum((trade_type IN ('long', 'short'))::INT) OVER (PARTITION BY {PK} ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS trade_id,
         CASE WHEN was = 1 OR trade_type = 'long' THEN hi END AS highest, CASE WHEN was = -1 OR trade_type = 'short' THEN lo END AS lowest
  FROM signalled WHERE was <> 0 OR held <> 0)""",
            select=f"SELECT {KP}, trade_id, {nums('highest', 'lowest')} FROM held_rows",
        ),
        "param_sweep": q(
            *pair_gates, machine(SWEEP_GRID), follower_returns(f"{PK}, param_id"),
            f"\nx AS (SELECT {PK}, max_hold, cooldown, {ratios(8760)} FROM ret GROUP BY ALL)",
            select=f"SELECT {PK}, max_hold AS max_hold_hours, "
            + ", ".join(num(f"max(CASE WHEN cooldown = {2 * c} THEN sharpe END)", f"cooldown_{2 * c}") for c in (12, 24, 48, 72, 96))
            + f" FROM x GROUP BY {PK}, max_hold",
        ),
        "lead_lag": q(
            HOUR_BARS, PAIRS, ix("pairs", PK, "px"), lags,
            select=f"SELECT {PK}, lag, count(*) FILTER (lr IS NOT NULL AND fr IS NOT NULL) AS n, {num('covar_samp(lr, fr) / nullif(stddev_samp(lr) FILTER (fr IS NOT NULL) * stddev_samp(fr) FILTER (lr IS NOT NULL), 0)', 'r')} FROM lagged GROUP BY {PK}, lag",
        ),
        "history_corr": q(
            HOUR_BARS, PAIRS,
            f"\nc AS (SELECT {PK}, count(*) AS n, covar_samp(leader_close, follower_close) / nullif(stddev_samp(leader_close) * stddev_samp(follower_close), 0) AS r FROM pairs GROUP BY {PK})",
            T_TAIL,
            select=f"SELECT {PK}, n, {nums('r')}, {num('r * sqrt((n - 2) / (1 - r * r))', 't')}, {nums('p')} FROM c JOIN tails USING ({PK})",
        ),
        "column_bounds": simple(HOUR_BARS, f"SELECT symbol, {num('min(close)', 'close_min')}, {num('max(close)', 'close_max')} FROM bars GROUP BY symbol"),
        "positions_hard_stop": q(PLAYED, select=f"SELECT {K}, {nums('close')}, action, signals, trade_type, {nums('price')} FROM played"),
        "trade_ledger": q(
            PLAYED_LEDGER, select=f"SELECT symbol, trade_id, side, entry_ts, exit_ts, {nums('entry_price', 'exit_price', 'factor', 'hours')} FROM ledger"
        ),
        "balances": q(
            PLAYED_LEDGER,
            select=f"SELECT symbol, count(*) AS trades, {num('1000 * exp(sum(ln(greatest(factor, 1e-300::DOUBLE))))', 'compounded_balance')}, {num('1000 + sum(1000 * (factor - 1))', 'static_balance')} FROM ledger WHERE factor IS NOT NULL GROUP BY symbol",
        ),
        "quarter_summary": q(
            *quarters,
            select=f"SELECT symbol, idx, from_ts, to_ts, {nums('initial_balance', 'final_balance', 'profit_pct', 'benchmark_pct')}, beaten, total_trades, long_trades, short_trades, {nums('win_rate_pct', 'mae_pct')} FROM quarters",
        ),
        "quarter_totals": q(
            *quarters,
            select="SELECT symbol, from_ts, sum(total_trades)::BIGINT AS total_trades, sum(long_trades)::BIGINT AS long_trades, sum(short_trades)::BIGINT AS short_trades, count(*) FILTER (beaten = 'Yes') AS quarters_beaten FROM quarters GROUP BY ROLLUP (symbol, from_ts)",
        ),
        "adverse_excursion": q(PLAYED_LEDGER, EXCURSION, select=f"SELECT symbol, trade_id, side, {nums('mae_pct')} FROM book"),
        "equity_curve": q(
            EQUITY, select=f"SELECT {K}, side, {num('CASE WHEN side <> 0 THEN entry END', 'entry_price')}, {nums('balance_factor', 'equity')} FROM eq"
        ),
        "drawdown": q(
            EQUITY,
            "\npk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM eq)",
            select=f"SELECT symbol, {num('max((1 - equity / peak) * 100)', 'max_drawdown_pct')}, {num('max(peak)', 'peak_equity')}, {num('last(equity ORDER BY ts)', 'final_equity')} FROM pk GROUP BY symbol",
        ),
        "sharpe_sortino": q(
            EQUITY,
            f"\nrt2 AS (SELECT symbol, equity / coalesce(lag(equity) {over('symbol')}, 1000) - 1 AS r FROM eq),\nx AS (SELECT symbol, count(*) AS bars, {ratios(365)} FROM rt2 GROUP BY symbol)",
            select=f"SELECT symbol, bars, {nums('sharpe', 'sortino')} FROM x",
        ),
        "benchmark_cmp": q(
            PLAYED_LEDGER,
            """
held AS (SELECT symbol, (exp(sum(ln(greatest(factor, 1e-300::DOUBLE)))) - 1) * 100 AS profit_pct FROM ledger WHERE factor IS NOT NULL GROUP BY symbol),
market AS (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, (last(close ORDER BY ts) / first(close ORDER BY ts) - 1) * 100 AS benchmark_pct FROM bars GROUP BY symbol)""",
            select=f"SELECT symbol, first_ts, last_ts, {nums('profit_pct', 'benchmark_pct')}, CASE WHEN profit_pct > benchmark_pct THEN 'Yes' ELSE 'No' END AS beaten FROM market JOIN held USING (symbol)",
        ),
        "trade_log": q(
            EQUITY,
            """
paid AS (
  SELECT *, 1000.0::DOUBLE * balance_factor AS b, 1000.0::DOUBLE * exp(ln(balance_factor) - lf) * price / nullif(was_entry, 0) AS worth FROM eq)""",
            select=f"SELECT {K}, pos AS step, trade_type, {nums('price')}, {num("""CASE WHEN pos = n_rows - 1 THEN 0.0::DOUBLE WHEN trade_type IN ('long', 'short_reversal') THEN b * 0.0015::DOUBLE
  WHEN trade_type IN ('short', 'long_reversal') THEN b * 0.75::DOUBLE * 0.0015::DOUBLE WHEN trade_type = 'long_close' THEN (1 - 0.0015::DOUBLE) * worth * 0.0015::DOUBLE
  WHEN trade_type = 'short_close' THEN 0.75::DOUBLE * worth * 0.0015::DOUBLE ELSE 0.0::DOUBLE END""", 'commission')}, signals FROM paid",
        ),
        "trade_type_counts": q(PLAYED, select="SELECT symbol, trade_type, count(*) AS records FROM played GROUP BY symbol, trade_type"),
        "broke_log": q(
            EQUITY, BROKE,
            select=f"SELECT {K}, CASE WHEN pos >= stop_pos THEN NULL ELSE signals END AS signals, CASE WHEN pos >= stop_pos THEN NULL ELSE trade_type END AS trade_type FROM eq LEFT JOIN ends USING (symbol)",
        ),
        "attach_log": q(
            EQUITY, BROKE,
            "\nlog AS (SELECT symbol, pos, signals, trade_type FROM eq LEFT JOIN ends USING (symbol) WHERE stop_pos IS NULL OR pos < stop_pos)",
            select=f"SELECT p.symbol, p.ts, {num('p.close', 'close')}, log.signals, log.trade_type FROM played p LEFT JOIN log USING (symbol, pos)",
        ),
        "state_index": q(STATES, select=f"SELECT {K}, split, pct_bin, state_index FROM states"),
        "transitions": q(
            STATES, STEPS, select="SELECT state_index AS from_state, to_state, count(*) AS n FROM stepped WHERE to_state IS NOT NULL GROUP BY 1, 2"
        ),
        "state_occupancy": q(STATES, STEPS, select=f"SELECT state_index, n, {nums('mean_return', 'mean_move')} FROM occupied"),
        "policy_table": q(STATES, STEPS, select=f"SELECT state_index, action, {nums('q')} FROM policy"),
        "policy_apply": q(STATES, STEPS, select=f"SELECT {K}, state_index, action FROM chosen"),
        "policy_trades": q(
            STATES, STEPS, "\nacted AS (SELECT * FROM chosen)", hard_stop(SK), select=f"SELECT {K}, action, signals, trade_type FROM played"
        ),
        "policy_held": q(
            STATES, STEPS, HELD_POLICY, hard_stop(SK, BY_HELD.format(h="p.held", t="g.")),
            select=f"SELECT {K}, was AS held, (state_index + 20 * was)::INT AS state_index, {BY_HELD.format(h='was', t='')} AS action, signals, trade_type FROM played",
        ),
        "first_touch": touches(HOUR_BARS),
        "first_touch_minutes": touches(MINUTE_BARS),
        "greedy_actions": q(STATES, STEPS, select="SELECT state_index, action FROM best"),
        "finite_guard": simple(
            VALUE_BARS,
            f"SELECT symbol, count(*) FILTER (open = close) AS rejected, {num('avg(high - low) FILTER (open <> close)', 'spread')} FROM bars GROUP BY symbol",
        ),
        "stream_bars": simple(
            VALUE_BARS, f"SELECT {K}, {nums(*OHLCV)} FROM bars"
        ),
        "stream_gates": q(*pair_gates, select=f"SELECT {KP}, tradeable, enter_long, enter_short, exit_long, exit_short, vol_exit FROM gated"),
        "stream_indicators": q(
            PAIR_INDICATORS, PAIR_EMAS,
            select=f"SELECT {KP}, {nums(*[f'{s}_{c}' for s in ('leader', 'follower') for c in [*pair_names, 'ema7', 'ema14', 'ema28']])}, leader_supertrend_direction, follower_supertrend_direction, leader_regime, follower_regime, {nums('correlation', 'low25')} FROM p13 JOIN pe USING ({PK}, pos)",
        ),
        "stream_positions": q(
            *pair_gates, machine(DEFAULT_GRID, "1000000000"),
            select=f"SELECT {KP}, {num('follower_close', 'close')}, signals, trade_type FROM signalled",
        ),
        "json_field": "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS sharpe FROM events",
    }
