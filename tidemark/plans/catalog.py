"""Queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import mean
from ..operators import country_daily, episode_daily, platform_daily, sessions, title_daily, user_daily
from ..sources import schemas, testbed
from ..sources.schemas import SESSION_KEYS
from . import runner, storage_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, date: str | None = "datetime"):
    """Register a query and its SQL; the result's date column, if any, is given as text by both."""

    def add(f):
        QUERIES[name] = f if date is None else lambda spark, d: (out := f(spark, d)).withColumn(date, out[date].cast("string"))
        if sql:
            SQL[name] = sql if date is None else f"SELECT * REPLACE (CAST({date} AS VARCHAR) AS {date}) FROM ({sql})"
        return f

    return add


# ---- SQL parts ----------------------------------------------------------------------------------
_KEYS = ", ".join(SESSION_KEYS)
_RAW = f"raw AS ({testbed.RAW_SQL})"
_FILLED = "SELECT * REPLACE (coalesce(platform, 'UNKNOWN') AS platform, coalesce(country, 'UNKNOWN') AS country, coalesce(device, 'UNKNOWN') AS device, coalesce(browser, 'UNKNOWN') AS browser)"
_CLEAN = f"{_RAW}, {testbed.FEED_SQL}, clean AS ({_FILLED} FROM whole)"
_AGG = f"""SELECT {_KEYS}, min(ts) AS start_time, max(ts) AS end_time, max(dwell_time_ms) AS duration_ms, round(max(scroll_ratio), 2) AS max_scroll_ratio,
  bool_or(event_type = 'enter') AS seen_enter, bool_or(event_type = 'scroll') AS seen_scroll, bool_or(event_type = 'complete') AS seen_complete, bool_or(event_type = 'exit') AS seen_exit
  FROM {{}} GROUP BY {_KEYS}"""


def _state(source: str, as_of: int = testbed.AS_OF_SECONDS) -> str:
    return f"""SELECT *, CAST(CASE WHEN session_state = 'COMPLETE' THEN 1 ELSE 0 END AS INTEGER) AS is_complete, CAST(CASE WHEN session_state IN ('EXIT', 'TIMEOUT_EXIT') THEN 1 ELSE 0 END AS INTEGER) AS is_exit
  FROM (SELECT *, CASE WHEN seen_complete AND max_scroll_ratio >= 0.95 THEN 'COMPLETE' WHEN seen_exit AND max_scroll_ratio < 0.95 THEN 'EXIT'
    WHEN {as_of} - CAST(floor(epoch(end_time)) AS BIGINT) > 600 THEN 'TIMEOUT_EXIT' ELSE 'IN_PROGRESS' END AS session_state FROM {source})"""


_AGGREGATED = f"WITH {_CLEAN}, agg AS ({_AGG.format('clean')})"
_SILVER = _AGGREGATED + f", s AS ({_state('agg')})"
_TIMES = "* REPLACE (epoch_us(start_time) AS start_time, epoch_us(end_time) AS end_time)"


def _q(a: str, b: str, scale: int = 2) -> str:
    """a / b rounded half up, in whole numbers; null where b is 0."""
    p = 10**scale
    return f"(CASE WHEN {a} < 0 THEN -1 ELSE 1 END * CAST((2 * abs({a}) * {p} + {b}) // nullif(2 * ({b}), 0) AS DOUBLE) / {p})"


def _mean(x: str, scale: int = 2, unit: int = 100) -> str:
    """The mean of values of two decimals."""
    return _q(f"sum(CAST(round(CAST({x} AS DOUBLE) * {unit}) AS HUGEINT))", f"({unit} * count({x}))", scale)


def _h(x: str) -> str:
    """A value of two decimals, in hundredths."""
    return f"CAST(round(({x}) * 100) AS HUGEINT)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {_q(_h(a), _h(b))} ELSE 0.0 END"


def _n(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


_AUDIENCE = f"""count(DISTINCT session_id) AS total_sessions, {_n('sum(is_complete)')} AS complete_sessions, {_n('sum(is_exit)')} AS exit_sessions, {_n("sum(CASE WHEN session_state = 'IN_PROGRESS' THEN 1 ELSE 0 END)")} AS incomplete_sessions,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT CASE WHEN is_complete = 1 THEN user_id END) AS unique_complete_users, count(DISTINCT CASE WHEN is_exit = 1 THEN user_id END) AS unique_exit_users,
  {_mean('max_scroll_ratio')} AS avg_scroll_ratio, {_mean('duration_ms')} AS avg_duration_ms, {_mean('is_complete')} AS completion_rate, {_mean('is_exit')} AS exit_rate,
  {_mean("CASE WHEN session_state = 'TIMEOUT_EXIT' THEN 1.0 ELSE 0.0 END")} AS timeout_exit_rate, {_mean('CASE WHEN duration_ms <= 10000 THEN 1.0 ELSE 0.0 END')} AS bounce_ratio"""
_DROPOFF = _mean("CASE WHEN is_exit = 1 THEN max_scroll_ratio END")


# ---- inputs -------------------------------------------------------------------------------------
def _raw(spark, d) -> DataFrame:
    return testbed.raw_events(spark, d)


def _feed(spark, d) -> DataFrame:
    return testbed.feed(spark, d)


def _sessions(spark, d) -> DataFrame:
    """The sessions of the feed, with its repeats and holes."""
    return sessions.build_sessions(_feed(spark, d), testbed.as_of())


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    """Instants as microseconds, whatever the session's time zone."""
    return df.withColumns({c: F.unix_micros(c) for c in columns or ("start_time", "end_time")})


# ---- events -------------------------------------------------------------------------------------
_PLAIN = "event_id, user_id, webtoon_id, episode_id, session_id, event_type, country, platform, device, browser, scroll_ratio, dwell_time_ms, datetime"


@query("bronze_parse_json", f"WITH {_RAW} SELECT {', '.join(f'CASE WHEN CAST(event_id AS BIGINT) % 31 <> 0 THEN {c} END AS {c}' for c in _PLAIN.split(', '))} FROM raw")
def bronze_parse_json(spark, d):
    """Events encoded as JSON lines, some cut short, and parsed."""
    line = F.to_json(F.struct(*[c for c in schemas.EVENT.names]))
    lines = _raw(spark, d).select(F.when(F.col("event_id").cast("long") % 31 == 0, F.substring(line, 1, 10)).otherwise(line).alias("value"))
    return sessions.parse_events(lines).select(*_PLAIN.split(", "))


@query("json_props_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", date=None)
def json_props_extract(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("silver_dedup_latest", f"WITH {_RAW}, twice AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (ts + INTERVAL 1 SECOND AS ts) FROM raw WHERE CAST(event_id AS BIGINT) % 10 = 0) SELECT event_id, epoch_us(ts) AS event_us, session_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) AS n FROM twice) WHERE n = 1", date=None)
def silver_dedup_latest(spark, d):
    out = sessions.latest_events(testbed.with_repeats(_raw(spark, d)))
    return out.select("event_id", F.unix_micros("event_ts").alias("event_us"), "session_id", "event_type")


@query("silver_required_fields", f"WITH {_RAW} SELECT event_id, user_id, session_id, datetime FROM raw WHERE CAST(event_id AS BIGINT) % 23 <> 0 AND CAST(event_id AS BIGINT) % 29 <> 0")
def silver_required_fields(spark, d):
    return sessions.required(testbed.with_holes(_raw(spark, d))).select("event_id", "user_id", "session_id", "datetime")


@query("silver_fill_unknown", f"WITH {_RAW} SELECT event_id, platform, country, device, browser FROM ({_FILLED} FROM raw)", date=None)
def silver_fill_unknown(spark, d):
    return sessions.fill_unknown(_raw(spark, d)).select("event_id", "platform", "country", "device", "browser")


@query("late_data_filter", f"WITH {_RAW} SELECT event_id, session_id, datetime FROM raw WHERE datetime = DATE '2024-01-10'")
def late_data_filter(spark, d):
    return sessions.on_date(_raw(spark, d), "2024-01-10").select("event_id", "session_id", "datetime")


# ---- sessions -----------------------------------------------------------------------------------
@query("silver_session_agg", f"{_AGGREGATED} SELECT {_TIMES} FROM agg")
def silver_session_agg(spark, d):
    return _micros(sessions.sessionize(sessions.cleanse(_feed(spark, d))))


@query("silver_session_state", f"{_SILVER} SELECT {_TIMES} FROM s")
def silver_session_state(spark, d):
    return _micros(_sessions(spark, d))


_HALF = "clean WHERE CAST(event_id AS BIGINT) % 2 = {}"


def _half(spark, d, k):
    return sessions.build_sessions(_feed(spark, d).where(F.col("event_id").cast("long") % 2 == k), testbed.as_of())


@query("silver_upsert_replace", f"WITH {_CLEAN}, a AS ({_state('(' + _AGG.format(_HALF.format(0)) + ')')}), b AS ({_state('(' + _AGG.format(_HALF.format(1)) + ')')}), u AS (SELECT * FROM b UNION ALL SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {' AND '.join(f'a.{k} = b.{k}' for k in SESSION_KEYS)})) SELECT {_TIMES} FROM u")
def silver_upsert_replace(spark, d):
    return _micros(sessions.replace_sessions(_half(spark, d, 0), _half(spark, d, 1)))


@query("silver_upsert_fold", f"{_SILVER} SELECT {_TIMES} FROM s")
def silver_upsert_fold(spark, d):
    """Two batches of events folded: the same sessions as of all events."""
    return _micros(sessions.fold_sessions(_half(spark, d, 0), _half(spark, d, 1), testbed.as_of()))


@query("silver_refresh_states", f"{_AGGREGATED}, s AS ({_state('agg', testbed.AS_OF_SECONDS + 86400 * 7)}) SELECT {_TIMES} FROM s")
def silver_refresh_states(spark, d):
    return _micros(sessions.refresh_states(_sessions(spark, d), F.timestamp_seconds(F.lit(testbed.AS_OF_SECONDS + 86400 * 7))))


# ---- users --------------------------------------------------------------------------------------
_TOTAL = "count(DISTINCT session_id || '|' || episode_id)"
_USER_BASE = f"""SELECT datetime, user_id, {_TOTAL} AS total_episode_sessions, {_n('sum(is_complete)')} AS complete_sessions, {_n('sum(is_exit)')} AS exit_sessions,
  {_n("sum(CASE WHEN session_state = 'IN_PROGRESS' THEN 1 ELSE 0 END)")} AS incomplete_sessions, {_mean('max_scroll_ratio')} AS avg_scroll_ratio, {_mean('duration_ms')} AS avg_duration_ms,
  {_mean('CAST(duration_ms <= 10000 AS INTEGER)')} AS bounce_ratio, count(DISTINCT episode_id) AS distinct_episode_views, count(DISTINCT CASE WHEN is_complete = 1 THEN episode_id END) AS distinct_episode_completes,
  {_ratio('sum(is_complete)', _TOTAL)} AS completion_rate, {_ratio('sum(is_exit)', _TOTAL)} AS exit_rate, CAST(CASE WHEN count(DISTINCT episode_id) > 1 THEN 1 ELSE 0 END AS INTEGER) AS multi_episode_read_flag
  FROM s GROUP BY datetime, user_id"""
_USER_GAP = f"""SELECT datetime, user_id, coalesce({_mean('gap')}, 0.0) AS avg_return_interval_sec FROM (SELECT datetime, user_id, CASE WHEN b IS NOT NULL THEN greatest(CAST(floor(epoch(start_time)) AS BIGINT) - CAST(floor(epoch(b)) AS BIGINT), 0) END AS gap
  FROM (SELECT *, lag(end_time) OVER (PARTITION BY datetime, user_id ORDER BY start_time, end_time, session_id, webtoon_id, episode_id, platform, device, browser, country) AS b FROM s)) GROUP BY datetime, user_id"""
_USER_REPEAT = f"SELECT datetime, user_id, {_n('sum(n - 1)')} AS repeat_episode_complete_count FROM (SELECT datetime, user_id, webtoon_id, episode_id, count(*) AS n FROM s WHERE is_complete = 1 GROUP BY ALL) GROUP BY datetime, user_id"


@query("user_daily_base", f"{_SILVER} {_USER_BASE}")
def user_daily_base(spark, d):
    return user_daily.base(_sessions(spark, d))


@query("user_return_interval", f"{_SILVER} {_USER_GAP}")
def user_return_interval(spark, d):
    return user_daily.with_gaps(_sessions(spark, d)).groupBy(*user_daily.KEYS).agg(user_daily.return_interval())


@query("user_repeat_complete", f"{_SILVER}, r AS ({_USER_REPEAT}) SELECT u.datetime, u.user_id, coalesce(r.repeat_episode_complete_count, 0) AS repeat_episode_complete_count FROM (SELECT DISTINCT datetime, user_id FROM s) u LEFT JOIN r ON u.datetime = r.datetime AND u.user_id = r.user_id")
def user_repeat_complete(spark, d):
    return _sessions(spark, d).groupBy(*user_daily.KEYS).agg(user_daily.repeat_completes())


@query("user_daily_metrics", f"{_SILVER}, b AS ({_USER_BASE}), g AS ({_USER_GAP}), r AS ({_USER_REPEAT}) SELECT b.*, g.avg_return_interval_sec, coalesce(r.repeat_episode_complete_count, 0) AS repeat_episode_complete_count FROM b LEFT JOIN g USING (datetime, user_id) LEFT JOIN r USING (datetime, user_id)")
def user_daily_metrics(spark, d):
    return user_daily.user_daily(_sessions(spark, d))


# ---- episodes -----------------------------------------------------------------------------------
_BUCKETS = ", ".join(f"""{_n(f"sum(CASE WHEN max_scroll_ratio >= {a} AND max_scroll_ratio {'<=' if b == 1.0 else '<'} {b} THEN 1 ELSE 0 END)")} AS scroll_bucket_{a * 100:.0f}_{b * 100:.0f}""" for a, b in episode_daily.BUCKETS)
_EP_KEYS = "datetime, webtoon_id, episode_id"
_EP_BASE = f"SELECT {_EP_KEYS}, {_AUDIENCE}, coalesce({_DROPOFF}, 0.0) AS scroll_dropoff_point, {_BUCKETS} FROM s GROUP BY {_EP_KEYS}"
_EP_NEXT = f"SELECT {_EP_KEYS}, count(DISTINCT CASE WHEN following IS NOT NULL THEN user_id END) AS continued_user_count FROM (SELECT *, lead(episode_id) OVER (PARTITION BY datetime, webtoon_id, user_id ORDER BY episode_id) AS following FROM (SELECT DISTINCT datetime, webtoon_id, user_id, episode_id FROM s WHERE is_complete = 1)) GROUP BY {_EP_KEYS}"


@query("episode_daily_base", f"{_SILVER} SELECT * EXCLUDE ({', '.join(f'scroll_bucket_{a * 100:.0f}_{b * 100:.0f}' for a, b in episode_daily.BUCKETS)}) FROM ({_EP_BASE})")
def episode_daily_base(spark, d):
    return episode_daily.base(_sessions(spark, d)).drop(*[f"scroll_bucket_{a * 100:.0f}_{b * 100:.0f}" for a, b in episode_daily.BUCKETS])


@query("episode_scroll_buckets", f"{_SILVER} SELECT {_EP_KEYS}, {_BUCKETS} FROM s GROUP BY {_EP_KEYS}")
def episode_scroll_buckets(spark, d):
    return _sessions(spark, d).groupBy(*episode_daily.KEYS).agg(*episode_daily.scroll_buckets())


@query("episode_continuation", f"{_SILVER} {_EP_NEXT}")
def episode_continuation(spark, d):
    return episode_daily.continuation(_sessions(spark, d))


@query("episode_daily_metrics", f"{_SILVER}, b AS ({_EP_BASE}), c AS ({_EP_NEXT}) SELECT b.*, coalesce(continued_user_count, 0) AS continued_user_count, {_ratio('coalesce(continued_user_count, 0)', 'unique_users')} AS episode_attractiveness_index FROM b LEFT JOIN c USING ({_EP_KEYS})")
def episode_daily_metrics(spark, d):
    return episode_daily.episode_daily(_sessions(spark, d))


# ---- titles -------------------------------------------------------------------------------------
_T_KEYS = "datetime, webtoon_id"
_T_BASE = f"SELECT {_T_KEYS}, {_AUDIENCE}, {_DROPOFF} AS scroll_dropoff_point FROM s GROUP BY {_T_KEYS}"
_T_DEEP = f"SELECT {_T_KEYS}, episode_id AS deepest_episode_reached FROM (SELECT *, row_number() OVER (PARTITION BY {_T_KEYS} ORDER BY avg_scroll_ratio DESC NULLS LAST, episode_id) AS n FROM ({_EP_BASE})) WHERE n = 1"
_T_BINGE = f"SELECT {_T_KEYS}, {_ratio('count(DISTINCT CASE WHEN n >= 2 THEN user_id END)', 'count(DISTINCT user_id)')} AS binge_read_ratio FROM (SELECT {_T_KEYS}, user_id, count(DISTINCT episode_id) AS n FROM s GROUP BY {_T_KEYS}, user_id) GROUP BY {_T_KEYS}"
_T_KEPT = f"SELECT y.datetime, y.webtoon_id, {_ratio('count(t.user_id)', 'count(y.user_id)')} AS webtoon_retention_rate FROM (SELECT DISTINCT CAST(datetime + INTERVAL 1 DAY AS DATE) AS datetime, webtoon_id, user_id FROM s) y LEFT JOIN (SELECT DISTINCT datetime, webtoon_id, user_id FROM s) t ON y.datetime = t.datetime AND y.webtoon_id = t.webtoon_id AND y.user_id = t.user_id GROUP BY y.datetime, y.webtoon_id"


@query("title_daily_base", f"{_SILVER} {_T_BASE}")
def title_daily_base(spark, d):
    return title_daily.base(_sessions(spark, d))


@query("title_deepest_episode", f"{_SILVER} {_T_DEEP}")
def title_deepest_episode(spark, d):
    return title_daily.deepest_episode(episode_daily.base(_sessions(spark, d)))


@query("title_binge", f"{_SILVER} {_T_BINGE}")
def title_binge(spark, d):
    return title_daily.binge(_sessions(spark, d))


@query("title_retention", f"{_SILVER} {_T_KEPT}")
def title_retention(spark, d):
    return title_daily.retention(_sessions(spark, d))


@query("title_daily_metrics", f"{_SILVER}, b AS ({_T_BASE}), e AS ({_T_DEEP}), g AS ({_T_BINGE}), k AS ({_T_KEPT}) SELECT b.*, deepest_episode_reached, coalesce(binge_read_ratio, 0.0) AS binge_read_ratio, coalesce(webtoon_retention_rate, 0.0) AS webtoon_retention_rate FROM b LEFT JOIN e USING ({_T_KEYS}) LEFT JOIN g USING ({_T_KEYS}) LEFT JOIN k USING ({_T_KEYS})")
def title_daily_metrics(spark, d):
    return title_daily.title_daily(_sessions(spark, d))


# ---- platforms ----------------------------------------------------------------------------------
_P_KEYS = "datetime, platform, device, browser"
_P_BASE = f"""SELECT {_P_KEYS}, count(DISTINCT session_id) AS total_sessions, count(DISTINCT user_id) AS unique_users, {_ratio('count(DISTINCT session_id)', 'count(DISTINCT user_id)')} AS sessions_per_user,
  {_mean('is_complete')} AS completion_rate, {_mean('is_exit')} AS exit_rate, {_mean("CASE WHEN session_state = 'TIMEOUT_EXIT' THEN 1.0 ELSE 0.0 END")} AS timeout_exit_rate,
  {_mean('max_scroll_ratio')} AS avg_scroll_ratio, {_mean('duration_ms')} AS avg_duration_ms, {_mean('CAST(duration_ms <= 10000 AS INTEGER)')} AS bounce_ratio FROM s GROUP BY {_P_KEYS}"""


def _gap(column: str, name: str, within: str) -> str:
    w = f"OVER (PARTITION BY datetime, {within})"
    return f"{_q(_h(f'max({column}) {w}') + ' - ' + _h(f'min({column}) {w}'), '100')} AS {name}"


_P_GAPS = ", ".join([_gap("completion_rate", "cross_browser_completion_gap", "platform, device"), _gap("avg_duration_ms", "cross_device_duration_gap", "platform, browser"), _gap("avg_scroll_ratio", "cross_platform_scroll_gap", "device, browser")])


@query("platform_base", f"{_SILVER} {_P_BASE}")
def platform_base(spark, d):
    return platform_daily.base(_sessions(spark, d))


@query("platform_cross_gaps", f"{_SILVER} SELECT {_P_KEYS}, {_P_GAPS} FROM ({_P_BASE})")
def platform_cross_gaps(spark, d):
    return platform_daily.gaps(platform_daily.base(_sessions(spark, d))).select(*platform_daily.KEYS, "cross_browser_completion_gap", "cross_device_duration_gap", "cross_platform_scroll_gap")


@query("platform_daily_metrics", f"{_SILVER} SELECT *, {_P_GAPS} FROM ({_P_BASE})")
def platform_daily_metrics(spark, d):
    return platform_daily.platform_daily(_sessions(spark, d))


# ---- countries ----------------------------------------------------------------------------------
_C_BASE = f"""SELECT datetime, country, count(DISTINCT session_id) AS total_sessions, count(DISTINCT user_id) AS unique_users, count(DISTINCT CAST(user_id AS VARCHAR) || '|' || webtoon_id || '|' || episode_id) AS total_episode_views,
  {_n('sum(is_complete)')} AS complete_sessions, {_n('sum(is_exit)')} AS exit_sessions, {_mean('is_complete')} AS completion_rate, {_mean('is_exit')} AS exit_rate,
  {_mean("CASE WHEN session_state = 'TIMEOUT_EXIT' THEN 1.0 ELSE 0.0 END", 0)} AS timeout_exit_rate, {_mean('max_scroll_ratio')} AS avg_scroll_ratio, {_mean('duration_ms')} AS avg_duration_ms,
  {_mean('CASE WHEN duration_ms <= 10000 THEN 1.0 ELSE 0.0 END', 0)} AS bounce_ratio, {_ratio('count(DISTINCT session_id)', 'count(DISTINCT user_id)')} AS sessions_per_user,
  {_ratio("count(DISTINCT CAST(user_id AS VARCHAR) || '|' || webtoon_id || '|' || episode_id)", 'count(DISTINCT user_id)')} AS active_user_depth FROM s GROUP BY datetime, country"""
_C_ALL = f"""SELECT datetime, {_q('sum(complete_sessions)', 'sum(total_sessions)')} AS all_completion, {_q('sum(' + _h('avg_scroll_ratio') + ' * total_sessions)', '(100 * sum(total_sessions))')} AS all_scroll,
  {_q('sum(' + _h('avg_duration_ms') + ' * total_sessions)', '(100 * sum(total_sessions))')} AS all_duration FROM b GROUP BY datetime"""
_C_INDEX = f"""{_q('(' + _h('completion_rate') + ' - ' + _h('all_completion') + ')', '100')} AS completion_rate_gap_vs_global, {_ratio('avg_scroll_ratio', 'all_scroll')} AS scroll_depth_index, {_ratio('avg_duration_ms', 'all_duration')} AS avg_duration_index, {_ratio('completion_rate', 'exit_rate')} AS completion_exit_ratio"""
_C_KEPT = f"""SELECT t.datetime, t.country, count(y.user_id) AS returning_users, {_ratio('count(y.user_id)', 'count(t.user_id)')} AS return_user_ratio, count(t.user_id) - count(y.user_id) AS new_users, {_ratio('(count(t.user_id) - count(y.user_id))', 'count(t.user_id)')} AS new_user_ratio
  FROM (SELECT DISTINCT datetime, country, user_id FROM s) t LEFT JOIN (SELECT DISTINCT CAST(datetime + INTERVAL 1 DAY AS DATE) AS datetime, country, user_id FROM s) y ON y.datetime = t.datetime AND y.country = t.country AND y.user_id = t.user_id GROUP BY t.datetime, t.country"""


@query("country_base", f"{_SILVER} {_C_BASE}")
def country_base(spark, d):
    return country_daily.base(_sessions(spark, d))


@query("country_global_index", f"{_SILVER}, b AS ({_C_BASE}), g AS ({_C_ALL}) SELECT datetime, country, {_C_INDEX} FROM b JOIN g USING (datetime)")
def country_global_index(spark, d):
    return country_daily.against_all(country_daily.base(_sessions(spark, d))).select("datetime", "country", "completion_rate_gap_vs_global", "scroll_depth_index", "avg_duration_index", "completion_exit_ratio")


@query("country_retention", f"{_SILVER} {_C_KEPT}")
def country_retention(spark, d):
    return country_daily.retention(_sessions(spark, d))


@query("country_daily_metrics", f"{_SILVER}, b AS ({_C_BASE}), g AS ({_C_ALL}), k AS ({_C_KEPT}) SELECT b.* EXCLUDE (total_episode_views, complete_sessions, exit_sessions), {_C_INDEX}, returning_users, return_user_ratio, new_users, new_user_ratio FROM b JOIN g USING (datetime) LEFT JOIN k USING (datetime, country)")
def country_daily_metrics(spark, d):
    return country_daily.country_daily(_sessions(spark, d))


# ---- star tables --------------------------------------------------------------------------------
@query("orders_status_daily", f"SELECT CAST(o_orderdate AS DATE) AS order_date, o_orderstatus, count(*) AS n_orders, {_n('sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)')} AS n_large, {_mean('o_totalprice')} AS avg_price, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS n_urgent_customers FROM orders GROUP BY 1, 2", date="order_date")
def orders_status_daily(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("order_date"), "o_orderstatus").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"), mean(F.col("o_totalprice")).alias("avg_price"), F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey"))).alias("n_urgent_customers"))


@query("lineitem_left_join_orders", f"SELECT l_returnflag, coalesce(o_orderpriority, 'NONE') AS priority, count(*) AS n_lines, {_mean('l_quantity')} AS avg_quantity FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey GROUP BY 1, 2", date=None)
def lineitem_left_join_orders(spark, d):
    lines, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'")
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"], "left").groupBy("l_returnflag", F.coalesce("o_orderpriority", F.lit("NONE")).alias("priority")).agg(F.count("*").alias("n_lines"), mean(F.col("l_quantity")).alias("avg_quantity"))


@query("events_first_and_next", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events", date=None)
def events_first_and_next(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.lag("event_id").over(w).alias("previous_id"), F.lead("event_id").over(w).alias("next_id"))


# ---- the daily run over stored tables -------------------------------------------------------------
_DAY = "2024-01-10"


def _house(spark, d) -> runner.Lakehouse:
    """Stored tables after the sessions job and the daily jobs of a day."""
    house = runner.Lakehouse(spark, storage_queries.new_root(spark))
    house.events.append(_feed(spark, d))
    house.update_sessions(as_of=testbed.as_of())
    house.update_gold(_DAY, wait_seconds=0)
    return house


@query("daily_run_titles", f"SELECT * FROM ({SQL['title_daily_metrics']}) WHERE datetime = '{_DAY}'", date=None)
def daily_run_titles(spark, d):
    """The titles of a day, made from the stored episodes and the stored sessions of two days."""
    out = _house(spark, d).gold["title_daily_metrics"].read()
    return out.withColumn("datetime", F.col("datetime").cast("string"))


@query("serving_views", f"SELECT s.session_state, count(*) AS n_sessions, count(u.user_id) AS n_with_features, CAST(sum(u.total_episode_sessions) AS BIGINT) AS sum_sessions FROM ({SQL['silver_session_state']}) s LEFT JOIN ({SQL['user_daily_metrics']}) u ON u.datetime = s.datetime AND u.user_id = s.user_id WHERE s.datetime = '{_DAY}' GROUP BY s.session_state", date=None)
def serving_views(spark, d):
    """SQL over the views of a day: sessions by state beside the features of their users."""
    _house(spark, d).views(since=_DAY, until=_DAY)
    return spark.sql("SELECT s.session_state, count(*) AS n_sessions, count(u.user_id) AS n_with_features, sum(u.total_episode_sessions) AS sum_sessions FROM sessions s LEFT JOIN user_daily_metrics u USING (datetime, user_id) GROUP BY s.session_state")


for _name, (_run, _sql, _date) in storage_queries.ALL.items():
    query(_name, _sql, _date)(_run)

SQL["silver_incremental_equals_full"] = f"{_SILVER} SELECT session_state, count(*) AS n_sessions, {_n('sum(duration_ms)')} AS sum_duration, {_n('sum(epoch_us(start_time) % 1000003)')} AS sum_start, {_n('sum(is_complete)')} AS n_complete FROM s GROUP BY session_state"
