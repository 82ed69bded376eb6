"""Daily features of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import mean, ratio, share
from ..sources.schemas import BOUNCE_MS, EPISODE_DAILY, IN_PROGRESS, TIMEOUT_EXIT, conform

KEYS = ["datetime", "webtoon_id", "episode_id"]
# Lower bounds of the scroll buckets; the last one is closed at 1.
BUCKETS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0))


def audience() -> list[Column]:
    """Session and user counts and means that episodes and titles share."""
    done, left = F.col("is_complete") == 1, F.col("is_exit") == 1
    return [
        F.count_distinct("session_id").alias("total_sessions"),
        F.sum("is_complete").alias("complete_sessions"),
        F.sum("is_exit").alias("exit_sessions"),
        F.count_if(F.col("session_state") == IN_PROGRESS).alias("incomplete_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct(F.when(done, F.col("user_id"))).alias("unique_complete_users"),
        F.count_distinct(F.when(left, F.col("user_id"))).alias("unique_exit_users"),
        mean(F.col("max_scroll_ratio")).alias("avg_scroll_ratio"),
        mean(F.col("duration_ms")).alias("avg_duration_ms"),
        mean(F.col("is_complete")).alias("completion_rate"),
        mean(F.col("is_exit")).alias("exit_rate"),
        share(F.col("session_state") == TIMEOUT_EXIT).alias("timeout_exit_rate"),
        share(F.col("duration_ms") <= BOUNCE_MS).alias("bounce_ratio"),
        mean(F.when(left, F.col("max_scroll_ratio"))).alias("scroll_dropoff_point"),
    ]


def scroll_buckets() -> list[Column]:
    """Sessions by scroll ratio; ratios below 0, above 1 or null are in none."""
    x = F.col("max_scroll_ratio")
    return [F.count_if((x >= low) & ((x <= high) if high == 1.0 else (x < high))).alias(f"scroll_bucket_{low * 100:.0f}_{high * 100:.0f}") for low, high in BUCKETS]


def base(sessions: DataFrame) -> DataFrame:
    out = sessions.groupBy(*KEYS).agg(*audience(), *scroll_buckets())
    return out.withColumn("scroll_dropoff_point", F.coalesce("scroll_dropoff_point", F.lit(0.0)))


def continuation(sessions: DataFrame, numeric_order: bool = False) -> DataFrame:
    """Users that completed an episode and, the same day, one that follows it in the order of ids (of their numbers, if so asked)."""
    done = sessions.where("is_complete = 1").dropDuplicates(["datetime", "webtoon_id", "user_id", "episode_id"])
    by = [F.try_element_at(F.split("episode_id", "_"), F.lit(-1)).try_cast("long"), F.col("episode_id")] if numeric_order else ["episode_id"]
    following = F.lead("episode_id").over(Window.partitionBy("datetime", "webtoon_id", "user_id").orderBy(*by))
    return done.withColumn("following", following).groupBy(*KEYS).agg(F.count_distinct(F.when(F.col("following").isNotNull(), F.col("user_id"))).alias("continued_user_count"))


def episode_daily(sessions: DataFrame, numeric_order: bool = False) -> DataFrame:
    """Per date, title and episode, over any set of dates."""
    out = base(sessions).join(continuation(sessions, numeric_order), KEYS, "left").withColumn("continued_user_count", F.coalesce("continued_user_count", F.lit(0)))
    return conform(out.withColumn("episode_attractiveness_index", ratio(F.col("continued_user_count"), F.col("unique_users"))), EPISODE_DAILY)
