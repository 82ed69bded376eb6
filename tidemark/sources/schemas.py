"""Schemas of events, sessions and daily tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "BOOLEAN": T.BooleanType()}


def _schema(ddl: str) -> T.StructType:
    """A schema of plain DDL; StructType.fromDDL would need a running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (column.split() for column in ddl.split(","))])


# Names and types of the tables' columns, the states of a session and the bounds that set them, as feeds and readers have them.
COMPLETE, EXIT, TIMEOUT_EXIT, IN_PROGRESS = "COMPLETE", "EXIT", "TIMEOUT_EXIT", "IN_PROGRESS"
COMPLETE_RATIO, TIMEOUT_SECONDS, BOUNCE_MS = 0.95, 600, 10000
EVENT = _schema("""
    event_id STRING, user_id INT, webtoon_id STRING, episode_id STRING, session_id STRING, utimestamptz STRING,
    local_timestamptz STRING, event_type STRING, country STRING, platform STRING, device STRING, browser STRING,
    network_type STRING, scroll_ratio DOUBLE, scroll_event_count INT, dwell_time_ms BIGINT
""")
SILVER = _schema("""
    session_id STRING, user_id INT, webtoon_id STRING, episode_id STRING, platform STRING, country STRING,
    device STRING, browser STRING, datetime DATE, start_time TIMESTAMP, end_time TIMESTAMP, duration_ms BIGINT,
    max_scroll_ratio DOUBLE, seen_enter BOOLEAN, seen_scroll BOOLEAN, seen_complete BOOLEAN, seen_exit BOOLEAN,
    session_state STRING, is_complete INT, is_exit INT
""")
USER_DAILY = _schema("""
    datetime DATE, user_id INT, total_episode_sessions BIGINT, complete_sessions BIGINT, exit_sessions BIGINT,
    incomplete_sessions BIGINT, avg_scroll_ratio DOUBLE, avg_duration_ms DOUBLE, bounce_ratio DOUBLE,
    distinct_episode_views BIGINT, distinct_episode_completes BIGINT, completion_rate DOUBLE, exit_rate DOUBLE,
    multi_episode_read_flag INT, avg_return_interval_sec DOUBLE, repeat_episode_complete_count BIGINT
""")
EPISODE_DAILY = _schema("""
    datetime DATE, webtoon_id STRING, episode_id STRING, total_sessions BIGINT, complete_sessions BIGINT,
    exit_sessions BIGINT, incomplete_sessions BIGINT, unique_users BIGINT, unique_complete_users BIGINT,
    unique_exit_users BIGINT, avg_scroll_ratio DOUBLE, avg_duration_ms DOUBLE, completion_rate DOUBLE,
    exit_rate DOUBLE, timeout_exit_rate DOUBLE, bounce_ratio DOUBLE, scroll_dropoff_point DOUBLE,
    scroll_bucket_0_20 BIGINT, scroll_bucket_20_40 BIGINT, scroll_bucket_40_60 BIGINT, scroll_bucket_60_80 BIGINT,
    scroll_bucket_80_100 BIGINT, continued_user_count BIGINT, episode_attractiveness_index DOUBLE
""")
TITLE_DAILY = _schema("""
    datetime DATE, webtoon_id STRING, deepest_episode_reached STRING, total_sessions BIGINT, complete_sessions BIGINT,
    exit_sessions BIGINT, incomplete_sessions BIGINT, unique_users BIGINT, unique_complete_users BIGINT,
    unique_exit_users BIGINT, avg_scroll_ratio DOUBLE, avg_duration_ms DOUBLE, completion_rate DOUBLE,
    exit_rate DOUBLE, timeout_exit_rate DOUBLE, bounce_ratio DOUBLE, scroll_dropoff_point DOUBLE,
    binge_read_ratio DOUBLE, webtoon_retention_rate DOUBLE
""")
PLATFORM_DAILY = _schema("""
    datetime DATE, platform STRING, device STRING, browser STRING, total_sessions BIGINT, unique_users BIGINT,
    sessions_per_user DOUBLE, completion_rate DOUBLE, exit_rate DOUBLE, timeout_exit_rate DOUBLE,
    avg_scroll_ratio DOUBLE, avg_duration_ms DOUBLE, bounce_ratio DOUBLE, cross_browser_completion_gap DOUBLE,
    cross_device_duration_gap DOUBLE, cross_platform_scroll_gap DOUBLE
""")
COUNTRY_DAILY = _schema("""
    datetime DATE, country STRING, total_sessions BIGINT, unique_users BIGINT, sessions_per_user DOUBLE,
    completion_rate DOUBLE, exit_rate DOUBLE, timeout_exit_rate DOUBLE, avg_scroll_ratio DOUBLE,
    avg_duration_ms DOUBLE, bounce_ratio DOUBLE, active_user_depth DOUBLE, returning_users BIGINT,
    return_user_ratio DOUBLE, new_users BIGINT, new_user_ratio DOUBLE, completion_rate_gap_vs_global DOUBLE,
    scroll_depth_index DOUBLE, avg_duration_index DOUBLE, completion_exit_ratio DOUBLE
""")
BRONZE = T.StructType([*EVENT.fields, T.StructField("datetime", T.DateType())])
SESSION_KEYS = ["session_id", "user_id", "webtoon_id", "episode_id", "platform", "country", "device", "browser", "datetime"]
REQUIRED = ["user_id", "webtoon_id", "episode_id", "datetime", "session_id"]
UNKNOWN = {"platform": "UNKNOWN", "country": "UNKNOWN", "device": "UNKNOWN", "browser": "UNKNOWN"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; others go."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
