"""Daily features of users. All parts have one partitioning, so sessions are shuffled once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import mean, ratio
from ..sources.schemas import BOUNCE_MS, IN_PROGRESS, USER_DAILY, conform

KEYS = ["datetime", "user_id"]


def with_gaps(sessions: DataFrame) -> DataFrame:
    """gap_sec: seconds since the user's session before ended that day, 0 where they overlap."""
    order = Window.partitionBy(*KEYS).orderBy("start_time", "end_time", "session_id", "webtoon_id", "episode_id", "platform", "device", "browser", "country")
    before = F.lag("end_time").over(order)
    gap = F.unix_timestamp("start_time") - F.unix_timestamp(before)
    return sessions.withColumn("gap_sec", F.when(before.isNotNull(), F.greatest(gap, F.lit(0))))


def base(sessions: DataFrame) -> DataFrame:
    """Counts, rates and flags; a user's day has few sessions, so distinct values are collected, not shuffled."""
    return _rates(sessions.groupBy(*KEYS).agg(*_base()))


def _base() -> list:
    done = F.col("is_complete") == 1
    return [
        F.size(F.collect_set(F.struct("session_id", "episode_id"))).cast("long").alias("total_episode_sessions"),
        F.sum("is_complete").alias("complete_sessions"),
        F.sum("is_exit").alias("exit_sessions"),
        F.count_if(F.col("session_state") == IN_PROGRESS).alias("incomplete_sessions"),
        mean(F.col("max_scroll_ratio")).alias("avg_scroll_ratio"),
        mean(F.col("duration_ms")).alias("avg_duration_ms"),
        mean(F.col("duration_ms") <= BOUNCE_MS).alias("bounce_ratio"),
        F.size(F.collect_set("episode_id")).cast("long").alias("distinct_episode_views"),
        F.size(F.collect_set(F.when(done, F.col("episode_id")))).cast("long").alias("distinct_episode_completes"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    total = F.col("total_episode_sessions")
    return df.withColumns({"completion_rate": ratio(F.col("complete_sessions"), total), "exit_rate": ratio(F.col("exit_sessions"), total), "multi_episode_read_flag": F.when(F.col("distinct_episode_views") > 1, 1).otherwise(0)})


def return_interval():
    """Mean gap between sessions; none is 0.0."""
    return F.coalesce(mean(F.col("gap_sec")), F.lit(0.0)).alias("avg_return_interval_sec")


def repeat_completes():
    """Completions of an episode beyond the first: all completions less the distinct episodes completed."""
    done = F.col("is_complete") == 1
    return (F.count_if(done) - F.size(F.collect_set(F.when(done, F.struct("webtoon_id", "episode_id"))))).cast("long").alias("repeat_episode_complete_count")


def user_daily(sessions: DataFrame) -> DataFrame:
    """Per date and user, over any set of dates."""
    out = with_gaps(sessions).groupBy(*KEYS).agg(*_base(), return_interval(), repeat_completes())
    return conform(_rates(out), USER_DAILY)
