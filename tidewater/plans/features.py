"""Queries on bars: cleaning, features, alignment and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ranges import by_ranges, lead_in
from ..functions.series import by_session
from ..operators import align, clean, features
from ..sources.tables import BARS_SQL, BENCH_SQL, BENCHMARKS, bars, bars_wide, benchmarks, table


def rounded(df: DataFrame, keys: tuple[str, ...], digits: dict[str, int]) -> DataFrame:
    return df.select(*keys, *(F.round(c, n).alias(c) for c, n in digits.items()))


def bars_clean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean.clean_bars(bars(spark, sf), 110), ("series", "session"), dict.fromkeys(("open", "high", "low", "close", "volume"), 2))


def bars_violations(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("series"), F.to_date("o_orderdate").alias("session"), F.col("o_totalprice").alias("close"))
    return clean.violations(raw)


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), F.substring("c_mktsegment", 1, 4), F.when(F.col("c_custkey") % 7 == 0, F.lit("_x")).otherwise(F.lit("-b ")), F.col("c_nationkey").cast("string")).alias("raw"))
    return raw.withColumn("symbol", clean.symbol(F.col("raw"))).select("c_custkey", "symbol")


def sma_bollinger(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.sma_bollinger(bars(spark, sf)), ("series", "session"), {"sma_20": 4, "bb_upper": 3, "bb_lower": 3})


def ema_macd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.ema_macd(bars(spark, sf)), ("series", "session"), dict.fromkeys(("ema_20", "macd", "macd_signal"), 3))


def technical_by_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Technical columns of series cut into ranges of 1,000 rows, as for very long ones."""
    built = by_ranges(bars(spark, sf), features.technical, lead_in(20, 26), ("obv",), 1000)
    return rounded(built, ("series", "session"), {"sma_20": 4, "bb_upper": 3, "ema_20": 3, "macd_signal": 3, "rsi_14": 6, "atr_14": 3, "obv": 1})


def rsi_atr_obv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.rsi_atr_obv(bars(spark, sf)), ("series", "session"), {"rsi_14": 6, "atr_14": 3, "obv": 1})


def price_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.price_returns(bars(spark, sf)), ("series", "session"), dict.fromkeys(("log_open", "log_high", "log_low", "return_1d", "volume_change"), 8))


def stationary_v4(spark: SparkSession, sf: str) -> DataFrame:
    built = features.stationary_features(bars(spark, sf), benchmarks(spark, sf), BENCHMARKS)
    return rounded(built, ("series", "session"), dict.fromkeys(features.STATIONARY, 6))


def market_asof_returns(spark: SparkSession, sf: str) -> DataFrame:
    names = tuple(f"{n.lower()}_return_1d" for n in BENCHMARKS)
    return rounded(features.market_returns(bars(spark, sf), benchmarks(spark, sf), BENCHMARKS), ("series", "session"), dict.fromkeys(names, 8))


def rolling_beta(spark: SparkSession, sf: str) -> DataFrame:
    raw = bars(spark, sf)
    df = features.price_returns(raw).join(features.market_returns(raw.select("series", "session"), benchmarks(spark, sf), BENCHMARKS), ["series", "session"], "left")
    return rounded(features.relative_and_beta(df, "spy_return_1d"), ("series", "session"), {"relative_return": 8, "beta_20": 6})


def calendar_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.calendar(bars(spark, sf)), ("series", "session"), dict.fromkeys(("month_sin", "month_cos", "weekday_sin", "weekday_cos"), 9))


def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    return clean.quality(bars_wide(spark, sf), F.to_date(F.lit("2001-08-10")))


def quality_details(spark: SparkSession, sf: str) -> DataFrame:
    return clean.quality_details(bars_wide(spark, sf), F.to_date(F.lit("2001-08-10")), benchmarks(spark, sf))


def future_sessions(spark: SparkSession, sf: str) -> DataFrame:
    lasts = bars(spark, sf).groupBy("series").agg(F.max("session").alias("last_session"))
    lasts = lasts.withColumn("always", F.col("series") == "MACHINERY")
    holidays = table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") == 1).select(F.to_date("o_orderdate").alias("session")).distinct()
    return align.future_sessions(lasts, holidays, 30)


def last_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(align.last_rows(bars(spark, sf), 252), ("series", "session"), {"close": 2})


def training_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.price_returns(bars(spark, sf)).dropna(subset=["return_1d", "log_open"])
    found = align.training_snapshot(rows, ("return_1d", "log_open"), future_sessions(spark, sf), most=500)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    digests = {"features_sum": total(F.flatten("features")), "prices_sum": total("prices"), "n": F.size("dates").cast("long"), "days": F.size("future_dates").cast("long"), "next_session": F.element_at("future_dates", 1)}
    out = found.withColumns(digests)
    return rounded(out, ("series", "n", "days", "next_session", "raw_rows", "start_date", "end_date", "usable_sequences", "problem"), {"features_sum": 6, "prices_sum": 2})


def instrument_summary(spark: SparkSession, sf: str) -> DataFrame:
    return align.instrument_summary(bars(spark, sf))


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fingerprint(bars(spark, sf), clean.BAR)


def feature_validation(spark: SparkSession, sf: str) -> DataFrame:
    return clean.validate(features.sma_bollinger(bars_wide(spark, sf)), ("close", "sma_20", "bb_upper", "bb_lower"))


def calendars(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select("c_custkey", F.concat(F.substring("c_mktsegment", 1, 3), F.element_at(F.array(*map(F.lit, ("-USD", ".L", ".TO", ".XX", "", ".SW", "-EUR", ".ax", ".HK"))), (F.col("c_custkey") % 9 + 1).cast("int"))).alias("symbol"))
    return raw.select("c_custkey", align.calendar_of(F.col("symbol")).alias("calendar"))


def change_over(spark: SparkSession, sf: str) -> DataFrame:
    """Headline statistics of each session: change, change in percent, label."""
    before = F.lag("close").over(by_session())
    change = F.col("close") - before
    return bars(spark, sf).select("series", "session", F.round(change, 2).alias("change"), F.round(F.try_divide(change, before) * 100, 6).alias("change_pct"), F.when(change > 0, "Up").when(change < 0, "Down").when(change == 0, "Flat").alias("label"))


def rank_within_month(spark: SparkSession, sf: str) -> DataFrame:
    """Latest entry per key, then the ten latest of all."""
    w = W.partitionBy("series").orderBy(F.desc("session"))
    latest = bars_wide(spark, sf).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return latest.orderBy(F.desc("session"), "series").limit(10).select("series", "session", F.round("close", 2).alias("close"))


QUERIES = {f.__name__: f for f in (
    bars_clean, bars_violations, symbols, sma_bollinger, ema_macd, rsi_atr_obv, technical_by_ranges, price_returns, stationary_v4, market_asof_returns, rolling_beta, calendar_encoding,
    quality_issues, quality_details, future_sessions, last_rows, training_snapshot, instrument_summary, fingerprints, feature_validation, calendars, change_over, rank_within_month,
)}

_FULL = "CASE WHEN count({x}) OVER w{n} = {n} THEN {agg} OVER w{n} END"


def _roll(agg: str, x: str, n: int) -> str:
    return _FULL.format(agg=f"{agg}({x})", x=x, n=n)


_WINDOWS = "WINDOW w AS (PARTITION BY series ORDER BY session), " + ", ".join(f"w{n} AS (PARTITION BY series ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 14, 20))
_EMA = """(SELECT s.series, s.t, sum(CASE WHEN p.t = 0 THEN pow({d}, s.t) ELSE {a} * pow({d}, s.t - p.t) END * p.{x}) AS y
  FROM {src} s JOIN {src} p ON p.series = s.series AND p.t <= s.t AND p.t >= s.t - 700 GROUP BY 1, 2)"""


def _ema(src: str, x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return _EMA.format(src=src, x=x, a=repr(a), d=repr(1 - a))


_MACD = f"""e20 AS {_ema("b", "close", 20)}, e12 AS {_ema("b", "close", 12)}, e26 AS {_ema("b", "close", 26)},
m AS (SELECT b.*, e20.y AS ema_20, e12.y - e26.y AS macd FROM b JOIN e20 USING (series, t) JOIN e12 USING (series, t) JOIN e26 USING (series, t)),
sig AS {_ema("m", "macd", 9)}, md AS (SELECT m.*, sig.y AS macd_signal FROM m JOIN sig USING (series, t))"""

_TECH = f"""d AS (SELECT *, coalesce(close - prev, 0) AS ch FROM {{src}}),
d2 AS (SELECT *, greatest(ch, 0) AS up, greatest(-ch, 0) AS dn,
  CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr, sign(ch) * volume AS sv FROM d),
d3 AS (SELECT *, {_roll("avg", "up", 14)} AS g, {_roll("avg", "dn", 14)} AS l, {_roll("avg", "tr", 14)} AS atr_14,
  sum(sv) OVER (PARTITION BY series ORDER BY session ROWS UNBOUNDED PRECEDING) AS obv,
  {_roll("avg", "close", 20)} AS sma_20, {_roll("stddev_samp", "close", 20)} AS sd FROM d2 {_WINDOWS}),
tech AS (SELECT *, CASE WHEN g IS NULL OR (g = 0 AND l = 0) THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END AS rsi_14,
  sma_20 + 2 * sd AS bb_upper, sma_20 - 2 * sd AS bb_lower FROM d3)"""

_MARKET = f"""{BENCH_SQL},
own AS (SELECT series, session, unnest(['SPY','QQQ','VIX','TNX']) AS benchmark FROM bars),
un AS (SELECT series, session, benchmark FROM own UNION SELECT s.series, x.session, x.benchmark FROM bench x, (SELECT DISTINCT series FROM bars) s),
fil AS (SELECT un.*, last_value(close IGNORE NULLS) OVER (PARTITION BY series, benchmark ORDER BY session ROWS UNBOUNDED PRECEDING) AS c FROM un LEFT JOIN bench USING (session, benchmark)),
ret AS (SELECT series, session, benchmark, ln(c / lag(c) OVER (PARTITION BY series, benchmark ORDER BY session)) AS r FROM fil),
mk AS (SELECT own.series, own.session, max(CASE WHEN benchmark = 'SPY' THEN r END) AS spy_return_1d, max(CASE WHEN benchmark = 'QQQ' THEN r END) AS qqq_return_1d,
  max(CASE WHEN benchmark = 'VIX' THEN r END) AS vix_return_1d, max(CASE WHEN benchmark = 'TNX' THEN r END) AS tnx_return_1d
  FROM own JOIN ret USING (series, session, benchmark) GROUP BY 1, 2)"""

_BETA = """coalesce(CASE WHEN count(CASE WHEN return_1d IS NOT NULL AND spy_return_1d IS NOT NULL THEN 1 END) OVER w20 = 20
  THEN covar_samp(return_1d, spy_return_1d) OVER w20 / greatest(var_samp(spy_return_1d) OVER w20, 1e-12) END, 0)"""

_ROUND6 = ", ".join(f"round({c}, 6) AS {c}" for c in features.STATIONARY)


def _bits(c: str) -> str:
    part = f"(({c} - floor({c})) * 9007199254740992::DOUBLE)"
    rest = f"(({part} - floor({part})) * 9007199254740992::DOUBLE)"
    return "concat_ws(':', " + ", ".join(f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)" for x in (c, part, rest)) + ")"


SQL = {
    "bars_clean": f"""WITH {BARS_SQL} SELECT series, session, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, round(volume, 2) AS volume
      FROM b WHERE series IN (SELECT series FROM b GROUP BY 1 HAVING count(*) >= 110)""",
    "bars_violations": """WITH r AS (SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS session, o_totalprice AS close FROM orders)
      SELECT series, session, 'duplicate_session' AS violation, count(*) AS rows_found FROM r GROUP BY 1, 2 HAVING count(*) > 1
      UNION ALL SELECT series, session, 'bad_price', count(*) FROM r WHERE close IS NULL OR NOT isfinite(close) OR close <= 0 GROUP BY 1, 2""",
    "symbols": r"""SELECT c_custkey, CASE WHEN regexp_full_match(s, '\^?[A-Z0-9.-]{1,12}') THEN s END AS symbol FROM (
      SELECT c_custkey, upper(trim(' ' || substr(c_mktsegment, 1, 4) || CASE WHEN c_custkey % 7 = 0 THEN '_x' ELSE '-b ' END || c_nationkey)) AS s FROM customer)""",
    "sma_bollinger": f"""WITH {BARS_SQL}, {_TECH.format(src="b")} SELECT series, session, round(sma_20, 4) AS sma_20, round(bb_upper, 3) AS bb_upper, round(bb_lower, 3) AS bb_lower FROM tech""",
    "ema_macd": f"""WITH {BARS_SQL}, {_MACD} SELECT series, session, round(ema_20, 3) AS ema_20, round(macd, 3) AS macd, round(macd_signal, 3) AS macd_signal FROM md""",
    "rsi_atr_obv": f"""WITH {BARS_SQL}, {_TECH.format(src="b")} SELECT series, session, round(rsi_14, 6) AS rsi_14, round(atr_14, 3) AS atr_14, round(obv, 1) AS obv FROM tech""",
    "technical_by_ranges": f"""WITH {BARS_SQL}, {_TECH.format(src="b")}, {_MACD} SELECT tech.series, tech.session, round(sma_20, 4) AS sma_20, round(bb_upper, 3) AS bb_upper, round(ema_20, 3) AS ema_20, round(macd_signal, 3) AS macd_signal,
      round(rsi_14, 6) AS rsi_14, round(atr_14, 3) AS atr_14, round(obv, 1) AS obv FROM tech JOIN md ON tech.series = md.series AND tech.session = md.session""",
    "price_returns": f"""WITH {BARS_SQL} SELECT series, session, round(ln(open / prev), 8) AS log_open, round(ln(high / prev), 8) AS log_high, round(ln(low / prev), 8) AS log_low,
      round(ln(close / prev), 8) AS return_1d, round(ln(1 + volume) - lag(ln(1 + volume)) OVER (PARTITION BY series ORDER BY session), 8) AS volume_change FROM b""",
    "market_asof_returns": f"""WITH {BARS_SQL}, {_MARKET} SELECT series, session, round(spy_return_1d, 8) AS spy_return_1d, round(qqq_return_1d, 8) AS qqq_return_1d,
      round(vix_return_1d, 8) AS vix_return_1d, round(tnx_return_1d, 8) AS tnx_return_1d FROM mk""",
    "rolling_beta": f"""WITH {BARS_SQL}, {_MARKET}, j AS (SELECT b.*, ln(close / prev) AS return_1d, spy_return_1d FROM b JOIN mk USING (series, session))
      SELECT series, session, round(return_1d - spy_return_1d, 8) AS relative_return, round({_BETA}, 6) AS beta_20 FROM j {_WINDOWS}""",
    "calendar_encoding": f"""WITH {BARS_SQL} SELECT series, session, round(sin(month(session) * 2 * pi() / 12), 9) AS month_sin, round(cos(month(session) * 2 * pi() / 12), 9) AS month_cos,
      round(sin((isodow(session) - 1) * 2 * pi() / 7), 9) AS weekday_sin, round(cos((isodow(session) - 1) * 2 * pi() / 7), 9) AS weekday_cos FROM b""",
    "stationary_v4": f"""WITH {BARS_SQL}, {_MACD}, {_TECH.format(src="md")}, {_MARKET},
      r AS (SELECT tech.*, ln(open / prev) AS log_open, ln(high / prev) AS log_high, ln(low / prev) AS log_low, ln(close / prev) AS return_1d,
        ln(1 + volume) - lag(ln(1 + volume)) OVER w AS volume_change, obv - lag(obv) OVER w AS oc, ln(close / lag(close, 5) OVER w) AS return_5d, ln(close / lag(close, 20) OVER w) AS return_20d,
        spy_return_1d, qqq_return_1d, vix_return_1d, tnx_return_1d FROM tech JOIN mk USING (series, session) {_WINDOWS}),
      z AS (SELECT *, close / sma_20 - 1 AS close_sma_20, close / ema_20 - 1 AS close_ema_20, (rsi_14 - 50) / 50 AS rsi_centered, macd / close AS macd_close, macd_signal / close AS macd_signal_close,
        bb_upper / close - 1 AS bb_upper_rel, CASE WHEN bb_lower <> 0 THEN close / bb_lower - 1 END AS bb_lower_rel, atr_14 / close AS atr_14_rel,
        CASE WHEN count(oc) OVER w20 = 20 AND stddev_samp(oc) OVER w20 <> 0 THEN (oc - avg(oc) OVER w20) / stddev_samp(oc) OVER w20 END AS obv_change_z,
        {_roll("stddev_samp", "return_1d", 5)} AS realized_vol_5d, {_roll("stddev_samp", "return_1d", 20)} AS realized_vol_20d,
        return_1d - spy_return_1d AS relative_return, {_BETA} AS beta_20, sin(month(session) * 2 * pi() / 12) AS month_sin, cos(month(session) * 2 * pi() / 12) AS month_cos,
        sin((isodow(session) - 1) * 2 * pi() / 7) AS weekday_sin, cos((isodow(session) - 1) * 2 * pi() / 7) AS weekday_cos FROM r {_WINDOWS})
      SELECT series, session, {_ROUND6} FROM z WHERE {" AND ".join(f"{c} IS NOT NULL" for c in features.STATIONARY)}""",
    "quality_issues": """WITH bw AS (SELECT CAST(c_nationkey AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS session, arg_max(o_totalprice, o_orderkey) AS close
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      x AS (SELECT *, lag(close) OVER w AS p, lag(session) OVER w AS ps FROM bw WINDOW w AS (PARTITION BY series ORDER BY session)),
      q AS (SELECT series, count(*) AS n_rows, CAST(0 AS BIGINT) AS duplicate_dates, count(CASE WHEN close <= 0 THEN 1 END) AS non_positive, count(CASE WHEN abs(ln(close / p)) > 0.20 THEN 1 END) AS large_moves,
        count(CASE WHEN session - ps > 7 THEN 1 END) AS long_gaps, DATE '2001-08-10' - max(session) AS stale_days FROM x GROUP BY 1)
      SELECT series, n_rows, duplicate_dates, non_positive, large_moves, long_gaps, stale_days,
        CASE WHEN large_moves > 0 OR long_gaps > 0 OR stale_days > 15 OR non_positive > 0 THEN 'annotated' ELSE 'clean' END AS status FROM q""",
    "future_sessions": f"""WITH {BARS_SQL}, l AS (SELECT series, max(session) AS last_session FROM b GROUP BY 1),
      h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders WHERE day(o_orderdate) = 1),
      c AS (SELECT series, CAST(unnest(generate_series(last_session + 1, last_session + 400, INTERVAL 1 DAY)) AS DATE) AS session FROM l),
      k AS (SELECT * FROM c WHERE series = 'MACHINERY' OR (isodow(session) < 6 AND session NOT IN (SELECT session FROM h)))
      SELECT series, session, step FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY session) AS step FROM k) WHERE step <= 30""",
    "last_rows": f"""WITH {BARS_SQL} SELECT series, session, round(close, 2) AS close FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY session DESC) <= 252""",
    "instrument_summary": f"""WITH {BARS_SQL}, y AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY session DESC) <= 252)
      SELECT series, round(max(high), 2) AS year_high, round(min(low), 2) AS year_low, round(avg(volume), 6) AS average_volume, round(arg_max(high, session), 2) AS day_high,
        round(arg_max(low, session), 2) AS day_low, round(arg_max(prev, session), 2) AS previous_close FROM y GROUP BY 1""",
    "fingerprints": f"""WITH {BARS_SQL}, r AS (SELECT series, session, sha256(concat_ws('|', CAST(session AS VARCHAR), {", ".join(map(_bits, clean.BAR))})) AS h FROM b)
      SELECT series, count(*) AS n_rows, min(session) AS first_session, max(session) AS last_session, sha256(concat_ws(',', {", ".join(f"CAST(sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT) AS VARCHAR)" for k in range(4))})) AS content_hash FROM r GROUP BY 1""",
    "feature_validation": f"""WITH bars AS (SELECT CAST(c_nationkey AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS session, arg_max(o_totalprice, o_orderkey) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
      r AS (SELECT series, close, {_roll("avg", "close", 20)} AS s, {_roll("stddev_samp", "close", 20)} AS sd FROM bars {_WINDOWS})
      SELECT 'close' AS feature, count(*) AS n_rows, count(*) - count(close) AS missing, CAST(0 AS BIGINT) AS infinite FROM r UNION ALL SELECT 'sma_20', count(*), count(*) - count(s), 0 FROM r
      UNION ALL SELECT 'bb_upper', count(*), count(*) - count(sd), 0 FROM r UNION ALL SELECT 'bb_lower', count(*), count(*) - count(sd), 0 FROM r""",
    "calendars": """SELECT c_custkey, CASE WHEN ends_with(s, '-USD') OR ends_with(s, '-EUR') THEN 'CRYPTO_24_7' WHEN ends_with(s, '.L') THEN 'LSE' WHEN ends_with(s, '.TO') THEN 'TSX' WHEN ends_with(s, '.SW') THEN 'SIX' WHEN ends_with(s, '.ax') THEN 'ASX' WHEN ends_with(s, '.HK') THEN 'HKEX'
      WHEN contains(s, '.') THEN 'NYSE_FALLBACK' ELSE 'NYSE' END AS calendar FROM (SELECT c_custkey, substr(c_mktsegment, 1, 3) || ['-USD', '.L', '.TO', '.XX', '', '.SW', '-EUR', '.ax', '.HK'][c_custkey % 9 + 1] AS s FROM customer)""",
    "change_over": f"""WITH {BARS_SQL} SELECT series, session, round(close - prev, 2) AS change, round((close - prev) / prev * 100, 6) AS change_pct,
      CASE WHEN close > prev THEN 'Up' WHEN close < prev THEN 'Down' WHEN close = prev THEN 'Flat' END AS label FROM b""",
    "rank_within_month": """WITH bw AS (SELECT CAST(c_nationkey AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS session, arg_max(o_totalprice, o_orderkey) AS close
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
      SELECT series, session, round(close, 2) AS close FROM bw QUALIFY row_number() OVER (PARTITION BY series ORDER BY session DESC) = 1 ORDER BY session DESC, series LIMIT 10""",
}
SQL["training_snapshot"] = f"""WITH {BARS_SQL}, fu AS ({SQL["future_sessions"]}), fx AS (SELECT series, session, close, ln(close / prev) AS x1, ln(open / prev) AS x2 FROM b WHERE prev IS NOT NULL),
      c AS (SELECT series, count(*) AS raw_rows FROM fx GROUP BY 1), l AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY series ORDER BY session DESC) <= 500),
      g AS (SELECT series, count(*) AS n, min(session) AS start_date, max(session) AS end_date, sum(x1 + x2) AS x, sum(close) AS p FROM l GROUP BY 1), d AS (SELECT series, count(*) AS days, min(session) AS next_session FROM fu GROUP BY 1)
      SELECT g.series, n, days, next_session, raw_rows, start_date, end_date, greatest(0, n - 60 - 30 + 1) AS usable_sequences, CASE WHEN n < 91 THEN 'short' END AS problem, round(x, 6) AS features_sum, round(p, 2) AS prices_sum
      FROM g JOIN c ON c.series = g.series JOIN d ON d.series = g.series"""
SQL["quality_details"] = f"""WITH {BENCH_SQL}, k AS (SELECT min(e) AS e FROM (SELECT max(session) AS e FROM bench GROUP BY benchmark)), q AS ({SQL["quality_issues"]})
      SELECT series, 'duplicate_dates' AS code, 'error' AS severity, duplicate_dates || ' duplicate rows.' AS detail FROM q WHERE duplicate_dates > 0
      UNION ALL SELECT series, 'non_positive_values', 'error', 'Non-positive prices found.' FROM q WHERE non_positive > 0
      UNION ALL SELECT series, 'large_single_day_move', 'warning', 'A single-day move exceeds 20%, which is inconsistent with adjusted data.' FROM q WHERE large_moves > 0
      UNION ALL SELECT series, 'missing_sessions', 'warning', long_gaps || ' session gaps longer than 7 calendar days.' FROM q WHERE long_gaps > 0
      UNION ALL SELECT series, 'stale_latest_observation', 'warning', 'Latest observation is ' || stale_days || ' days old.' FROM q WHERE stale_days > 15
      UNION ALL SELECT series, 'benchmark_series_end_earlier', 'warning', 'One or more market benchmark series end before the stock series.' FROM q, k WHERE e < DATE '2001-08-10' - CAST(stale_days AS INTEGER)"""
