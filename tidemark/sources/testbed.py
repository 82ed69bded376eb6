"""Raw events made from the driver's `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that sessions are classified as of: 2024-01-15 00:00:00 UTC.
AS_OF_SECONDS = 1705276800


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF_SECONDS))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw event per row of `events`, its date beside it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour, user = F.hour("ts"), F.col("user_id")
    bucket = F.floor(hour / 6).cast("int")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), n.cast("int") + 1)
    kinds = {"view": "enter", "click": "scroll", "purchase": "complete", "error": "exit"}
    kind = F.col("event_type")
    for old, new in kinds.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    date = F.col("ts").cast("date")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        user.cast("int").alias("user_id"),
        F.concat(F.lit("webtoon_"), ((user + F.floor(hour / 12)) % 10 + 1).cast("string")).alias("webtoon_id"),
        F.concat(F.lit("ep_"), ((user * 7 + F.dayofmonth("ts") + bucket) % 20 + 1).cast("string")).alias("episode_id"),
        F.concat_ws("-", user.cast("string"), date.cast("string"), bucket.cast("string")).alias("session_id"),
        text.alias("utimestamptz"),
        text.alias("local_timestamptz"),
        kind.alias("event_type"),
        pick(user % 5, "KR", "US", "JP", "TW", "FR").alias("country"),
        F.when(user % 17 != 0, pick(user % 3, "web", "android", "ios")).alias("platform"),
        pick(bucket % 3, "mobile", "pc", "tablet").alias("device"),
        pick(F.floor(user / 3) % 5, "safari", "chrome", "firefox", "edge", "whale").alias("browser"),
        F.lit("wifi").alias("network_type"),
        F.when(F.col("event_type") == "purchase", F.lit(1.0)).otherwise(F.get_json_object("props", "$.k").cast("double") / 100.0).alias("scroll_ratio"),
        F.lit(0).alias("scroll_event_count"),
        F.floor(F.col("value") * 1000).cast("long").alias("dwell_time_ms"),
        date.alias("datetime"),
    )


#: The same in SQL; ts beside the text.
RAW_SQL = """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS INTEGER) AS user_id, 'webtoon_' || CAST((user_id + hour(ts) // 12) % 10 + 1 AS VARCHAR) AS webtoon_id,
  'ep_' || CAST((user_id * 7 + day(ts) + hour(ts) // 6) % 20 + 1 AS VARCHAR) AS episode_id,
  CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) || '-' || CAST(hour(ts) // 6 AS VARCHAR) AS session_id, ts,
  CASE event_type WHEN 'view' THEN 'enter' WHEN 'click' THEN 'scroll' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'exit' ELSE event_type END AS event_type,
  CASE user_id % 5 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' WHEN 3 THEN 'TW' ELSE 'FR' END AS country,
  CASE WHEN user_id % 17 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'web' WHEN user_id % 3 = 1 THEN 'android' ELSE 'ios' END AS platform,
  CASE hour(ts) // 6 % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'pc' ELSE 'tablet' END AS device,
  CASE user_id // 3 % 5 WHEN 0 THEN 'safari' WHEN 1 THEN 'chrome' WHEN 2 THEN 'firefox' WHEN 3 THEN 'edge' ELSE 'whale' END AS browser,
  CASE WHEN event_type = 'purchase' THEN 1.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 END AS scroll_ratio,
  CAST(floor(value * 1000) AS BIGINT) AS dwell_time_ms, CAST(ts AS DATE) AS datetime
FROM events
"""


def with_repeats(raw: DataFrame) -> DataFrame:
    """A tenth of the events again, a second later."""
    again = raw.where(F.col("event_id").cast("long") % 10 == 0)
    later = F.concat(F.date_format(F.to_timestamp_ntz(F.substring("utimestamptz", 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")) + F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return raw.unionByName(again.withColumn("utimestamptz", later))


def with_holes(raw: DataFrame) -> DataFrame:
    """Some events without a user or a session."""
    n = F.col("event_id").cast("long")
    return raw.withColumns({"user_id": F.when(n % 23 != 0, F.col("user_id")), "session_id": F.when(n % 29 != 0, F.col("session_id"))})


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as a feed delivers them: some twice, some with holes."""
    return with_holes(with_repeats(raw_events(spark, sf_dir)))


#: The same in SQL, of a table raw, and what is left of it: the latest row of each event that has all it needs.
FEED_SQL = """
twice AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (ts + INTERVAL 1 SECOND AS ts) FROM raw WHERE CAST(event_id AS BIGINT) % 10 = 0),
feed AS (SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 23 <> 0 THEN user_id END AS user_id, CASE WHEN CAST(event_id AS BIGINT) % 29 <> 0 THEN session_id END AS session_id) FROM twice),
latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, session_id DESC, event_type DESC) AS n FROM feed) WHERE n = 1),
whole AS (SELECT * FROM latest WHERE user_id IS NOT NULL AND webtoon_id IS NOT NULL AND episode_id IS NOT NULL AND datetime IS NOT NULL AND session_id IS NOT NULL)
"""
