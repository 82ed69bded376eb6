"""Seeded reading sessions as raw events, made by Spark expressions. All quantities are whole numbers until the end, so that SQL gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import EVENT

# Dimensions, their time zones and weights (in hundredths), as the feed has them.
COUNTRIES = {"KR": ("Asia/Seoul", 30), "US": ("America/New_York", 30), "JP": ("Asia/Tokyo", 20), "TW": ("Asia/Taipei", 15), "FR": ("Europe/Paris", 5)}
PLATFORMS, DEVICES = ["web", "android", "ios"], ["mobile", "pc", "tablet"]
BROWSERS, NETWORKS = ["safari", "chrome", "firefox", "edge", "whale"], ["wifi", "4g", "5g", "offline"]
USERS, TITLES, EPISODES, MAX_SCROLLS = 100, 10, 20, 8


def _draw(seed: int, name: str, below: int, *keys: str) -> Column:
    """A whole number from 0 to below - 1 that depends on the seed, a name and the keys alone."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[F.col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(below)).cast("int")


def _one(values: list, draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), draw + 1)


def _country(draw: Column) -> Column:
    out, top = F.lit(list(COUNTRIES)[-1]), 100
    for code, (_, weight) in reversed(COUNTRIES.items()):
        out = F.when(draw < top, code).otherwise(out)
        top -= weight
    return out


def simulate(spark: SparkSession, sessions: int, seed: int = 42, start: str = "2024-01-01 00:00:00", spacing_seconds: int = 60, out_of_order: float = 0.0, binge: float = 0.0, binge_sessions: int = 5) -> DataFrame:
    """Raw events (EVENT's columns and arrival, the order they come in).

    A session enters, scrolls 1 to 8 times at gaps of 10 to 60 s with a rising
    ratio and ends complete (4 of 5) or by leaving at a ratio of 0.6 to 0.9 at
    most; who leaves scrolls no further once near that ratio. out_of_order:
    share of sessions whose first two events arrive swapped; binge: share of
    sessions that are repeated on the following episodes.
    """
    s = spark.range(sessions).withColumnRenamed("id", "base")
    more = _draw(seed, "binge", 1000, "base") < round(binge * 1000)
    s = s.withColumn("copy", F.explode(F.when(more, F.sequence(F.lit(0), F.lit(binge_sessions - 1))).otherwise(F.array(F.lit(0)))))
    s = s.withColumn("user_id", _draw(seed, "user", USERS, "base") + 1)
    s = s.select(
        "base", "copy", "user_id",
        F.concat(F.lit("webtoon_"), (_draw(seed, "title", TITLES, "base") + 1).cast("string")).alias("webtoon_id"),
        F.concat(F.lit("ep_"), ((_draw(seed, "episode", EPISODES, "base") + F.col("copy")) % EPISODES + 1).cast("string")).alias("episode_id"),
        F.concat(F.lit(f"s{seed}-"), "base", F.lit("-"), "copy").alias("session_id"),
        _one(PLATFORMS, _draw(seed, "platform", 3, "base")).alias("platform"), _one(DEVICES, _draw(seed, "device", 3, "base")).alias("device"),
        _one(BROWSERS, _draw(seed, "browser", 5, "base")).alias("browser"), _one(NETWORKS, _draw(seed, "network", 4, "base", "copy")).alias("network_type"),
        _country(_draw(seed, "country", 100, "user_id")).alias("country"),
        (_draw(seed, "done", 10, "base", "copy") < 8).alias("done"), (600 + _draw(seed, "limit", 301, "base", "copy")).alias("limit"),
        (600 + _draw(seed, "last", 301, "base", "copy")).alias("last_limit"), (_draw(seed, "scrolls", MAX_SCROLLS, "base", "copy") + 1).alias("scrolls"),
        (_draw(seed, "order", 1000, "base", "copy") < round(out_of_order * 1000)).alias("swapped"),
    )
    e = s.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("scrolls") + 1)))
    key = ("base", "copy", "step")
    so_far = Window.partitionBy("base", "copy").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("base", "copy").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("step") == F.col("scrolls") + 1
    scrolls = (F.col("step") > 0) & ~ends
    e = e.withColumn("rise", F.when(scrolls, 50 + _draw(seed, "rise", 201, *key)).otherwise(F.lit(0)))
    e = e.withColumn("reached", F.least(F.sum("rise").over(so_far), F.when(F.col("done"), F.lit(1000)).otherwise(F.col("limit"))))
    e = e.withColumn("near", ~F.col("done") & scrolls & (F.col("reached") * 1000 >= F.col("limit") * (900 + _draw(seed, "near", 101, *key))))
    e = e.withColumn("left", F.coalesce(F.max("near").over(earlier), F.lit(False))).where(~F.col("left") | ends)
    # of the steps that are left: time, ratio and number of scrolls so far
    e = e.withColumn("dwell_time_ms", F.sum(F.when(F.col("step") > 0, 10000 + _draw(seed, "gap", 50001, *key)).otherwise(F.lit(0)).cast("long")).over(so_far))
    e = e.withColumn("ratio", F.max(F.when(~ends, F.col("reached"))).over(so_far)).withColumn("n_scrolls", F.sum(scrolls.cast("int")).over(so_far).cast("int"))
    ratio = F.when(ends & F.col("done"), F.lit(1000)).when(ends, F.least("ratio", "last_limit")).otherwise(F.col("ratio"))
    utc = F.to_utc_timestamp(F.timestamp_seconds(F.floor((F.unix_millis(F.lit(start).cast("timestamp")) + F.col("base") * spacing_seconds * 1000 + F.col("copy") * 3_600_000 + F.col("dwell_time_ms")) / 1000)), F.current_timezone())
    local = F.lit(None).cast("string")
    for code, (zone, _) in COUNTRIES.items():
        there = F.from_utc_timestamp(utc, zone)
        minutes = F.floor((F.unix_timestamp(there) - F.unix_timestamp(utc)) / 60).cast("int")
        text = F.concat(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
        local = F.when(F.col("country") == code, text).otherwise(local)
    place = F.when(F.col("swapped") & (F.col("step") < 2), 1 - F.col("step")).otherwise(F.col("step"))
    return e.select(
        F.concat("session_id", F.lit("-"), "step").alias("event_id"), "user_id", "webtoon_id", "episode_id", "session_id",
        F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("utimestamptz"), local.alias("local_timestamptz"),
        F.when(F.col("step") == 0, "enter").when(~ends, "scroll").when(F.col("done"), "complete").otherwise("exit").alias("event_type"),
        "country", "platform", "device", "browser", "network_type",
        (ratio / 1000.0).cast("double").alias("scroll_ratio"), F.col("n_scrolls").alias("scroll_event_count"), "dwell_time_ms",
        (F.col("base") * 1000 + F.col("copy") * 100 + place).alias("arrival"),
    ).select(*EVENT.names, "arrival")


def sql(sessions: int, seed: int = 42, start: str = "2024-01-01 00:00:00", spacing_seconds: int = 60, out_of_order: float = 0.0, binge: float = 0.0, binge_sessions: int = 5) -> str:
    """The same in SQL, for days on which no country changes its clocks (its winter time)."""

    def draw(name: str, below: int, *keys: str) -> str:
        return f"(CAST('0x' || substring(md5('{seed}|{name}' || {' || '.join(chr(39) + '|' + chr(39) + f' || CAST({k} AS VARCHAR)' for k in keys)}), 1, 12) AS BIGINT) % {below})"

    one = lambda values, d: f"list_extract([{', '.join(chr(39) + v + chr(39) for v in values)}], CAST({d} AS INTEGER) + 1)"
    bounds, top = [], 0
    for code, (_, weight) in COUNTRIES.items():
        top += weight
        bounds.append(f"WHEN c < {top} THEN '{code}'")
    hours = {"KR": "+09", "US": "-05", "JP": "+09", "TW": "+08", "FR": "+01"}
    offset = "CASE country " + " ".join(f"WHEN '{c}' THEN {int(h)}" for c, h in hours.items()) + " END"
    tail = "CASE country " + " ".join(f"WHEN '{c}' THEN '{h}:00'" for c, h in hours.items()) + " END"
    over = "OVER (PARTITION BY base, copy ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    now, earlier = over.format("CURRENT ROW"), over.format("1 PRECEDING")
    return f"""
WITH b AS (SELECT unnest(range({sessions})) AS base),
c AS (SELECT base, unnest(CASE WHEN {draw('binge', 1000, 'base')} < {round(binge * 1000)} THEN range({binge_sessions}) ELSE [0] END) AS copy, CAST({draw('user', USERS, 'base')} + 1 AS INTEGER) AS user_id FROM b),
s AS (SELECT *, 'webtoon_' || CAST({draw('title', TITLES, 'base')} + 1 AS VARCHAR) AS webtoon_id, 'ep_' || CAST(({draw('episode', EPISODES, 'base')} + copy) % {EPISODES} + 1 AS VARCHAR) AS episode_id,
  's{seed}-' || CAST(base AS VARCHAR) || '-' || CAST(copy AS VARCHAR) AS session_id, {one(PLATFORMS, draw('platform', 3, 'base'))} AS platform, {one(DEVICES, draw('device', 3, 'base'))} AS device,
  {one(BROWSERS, draw('browser', 5, 'base'))} AS browser, {one(NETWORKS, draw('network', 4, 'base', 'copy'))} AS network_type, (SELECT CASE {' '.join(bounds)} END FROM (SELECT {draw('country', 100, 'user_id')} AS c)) AS country,
  {draw('done', 10, 'base', 'copy')} < 8 AS done, 600 + {draw('limit', 301, 'base', 'copy')} AS top, 600 + {draw('last', 301, 'base', 'copy')} AS last_top, {draw('scrolls', MAX_SCROLLS, 'base', 'copy')} + 1 AS scrolls,
  {draw('order', 1000, 'base', 'copy')} < {round(out_of_order * 1000)} AS swapped FROM c),
e AS (SELECT *, step = scrolls + 1 AS ends, step > 0 AND step <= scrolls AS scroll FROM (SELECT *, unnest(range(scrolls + 2)) AS step FROM s)),
r AS (SELECT *, least(sum(CASE WHEN scroll THEN 50 + {draw('rise', 201, 'base', 'copy', 'step')} ELSE 0 END) {now}, CASE WHEN done THEN 1000 ELSE top END) AS reached FROM e),
n AS (SELECT *, coalesce(bool_or(NOT done AND scroll AND reached * 1000 >= top * (900 + {draw('near', 101, 'base', 'copy', 'step')})) {earlier}, FALSE) AS gone FROM r),
k AS (SELECT * FROM n WHERE NOT gone OR ends),
t AS (SELECT *, sum(CASE WHEN step > 0 THEN 10000 + {draw('gap', 50001, 'base', 'copy', 'step')} ELSE 0 END) {now} AS dwell, max(CASE WHEN NOT ends THEN reached END) {now} AS ratio, sum(CASE WHEN scroll THEN 1 ELSE 0 END) {now} AS n_scrolls FROM k),
u AS (SELECT *, TIMESTAMP '{start}' + to_seconds(CAST((base * {spacing_seconds * 1000} + copy * 3600000 + dwell) // 1000 AS BIGINT)) AS utc FROM t)
SELECT session_id || '-' || CAST(step AS VARCHAR) AS event_id, user_id, webtoon_id, episode_id, session_id, strftime(utc, '%Y-%m-%dT%H:%M:%S+00:00') AS utimestamptz,
  strftime(utc + to_hours({offset}), '%Y-%m-%dT%H:%M:%S') || {tail} AS local_timestamptz, CASE WHEN step = 0 THEN 'enter' WHEN NOT ends THEN 'scroll' WHEN done THEN 'complete' ELSE 'exit' END AS event_type,
  country, platform, device, browser, network_type, CAST(CASE WHEN ends AND done THEN 1000 WHEN ends THEN least(ratio, last_top) ELSE ratio END AS DOUBLE) / 1000 AS scroll_ratio,
  CAST(n_scrolls AS INTEGER) AS scroll_event_count, CAST(dwell AS BIGINT) AS dwell_time_ms, CAST(base * 1000 + copy * 100 + CASE WHEN swapped AND step < 2 THEN 1 - step ELSE step END AS BIGINT) AS arrival
FROM u"""


def write_lines(events: DataFrame, folder: str, files: int = 1) -> None:
    """Events as JSON lines in the order they arrive, for the file stream."""
    line = F.to_json(F.struct(*EVENT.names)).alias("value")
    events.repartitionByRange(files, "arrival").sortWithinPartitions("arrival").select(line).write.mode("append").text(folder)
