"""Daily features of countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import exact, mean, ratio, rounded, share
from ..sources.schemas import BOUNCE_MS, COUNTRY_DAILY, TIMEOUT_EXIT, conform

KEYS = ["datetime", "country"]


def base(sessions: DataFrame) -> DataFrame:
    """timeout_exit_rate and bounce_ratio are rounded to whole numbers, as readers of the table expect."""
    out = sessions.groupBy(*KEYS).agg(
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct(F.struct("user_id", "webtoon_id", "episode_id")).alias("total_episode_views"),
        F.sum("is_complete").alias("complete_sessions"),
        F.sum("is_exit").alias("exit_sessions"),
        mean(F.col("is_complete")).alias("completion_rate"),
        mean(F.col("is_exit")).alias("exit_rate"),
        share(F.col("session_state") == TIMEOUT_EXIT, 0).alias("timeout_exit_rate"),
        mean(F.col("max_scroll_ratio")).alias("avg_scroll_ratio"),
        mean(F.col("duration_ms")).alias("avg_duration_ms"),
        share(F.col("duration_ms") <= BOUNCE_MS, 0).alias("bounce_ratio"),
    )
    users = F.col("unique_users")
    return out.withColumns({"sessions_per_user": ratio(F.col("total_sessions"), users), "active_user_depth": ratio(F.col("total_episode_views"), users)})


def against_all(table: DataFrame) -> DataFrame:
    """Gaps and indexes against all countries of the day, whose means are weighted by sessions. A day has few countries."""
    n = F.col("total_sessions").cast("decimal(15,0)")
    overall = table.groupBy("datetime").agg(
        rounded(F.sum("complete_sessions").cast("decimal(15,0)") / F.sum(n).cast("decimal(15,0)")).alias("all_completion"),
        rounded(F.sum(F.col("avg_scroll_ratio").cast("decimal(15,2)") * n).cast("decimal(20,2)") / F.sum(n).cast("decimal(15,0)")).alias("all_scroll"),
        rounded(F.sum(F.col("avg_duration_ms").cast("decimal(15,2)") * n).cast("decimal(20,2)") / F.sum(n).cast("decimal(15,0)")).alias("all_duration"),
    )
    return table.join(overall, "datetime", "left").withColumns({
        "completion_rate_gap_vs_global": rounded(exact(F.col("completion_rate")) - exact(F.col("all_completion"))),
        "scroll_depth_index": ratio(F.col("avg_scroll_ratio"), F.col("all_scroll")),
        "avg_duration_index": ratio(F.col("avg_duration_ms"), F.col("all_duration")),
        "completion_exit_ratio": ratio(F.col("completion_rate"), F.col("exit_rate")),
    })


def retention(sessions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Users of a country also seen there the day before, and the others."""
    earlier = sessions if previous is None else previous
    before = earlier.select(F.date_add("datetime", 1).alias("datetime"), "country", "user_id").distinct().withColumn("earlier", F.col("user_id"))
    today = sessions.select(*KEYS, "user_id").distinct()
    out = today.join(before, [*KEYS, "user_id"], "left").groupBy(*KEYS).agg(F.count("user_id").alias("users"), F.count("earlier").alias("returning_users"))
    out = out.withColumn("new_users", F.col("users") - F.col("returning_users"))
    return out.withColumns({"return_user_ratio": ratio(F.col("returning_users"), F.col("users")), "new_user_ratio": ratio(F.col("new_users"), F.col("users"))}).drop("users")


def country_daily(sessions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    out = against_all(base(sessions)).join(retention(sessions, previous), KEYS, "left")
    return conform(out.fillna(0.0, ["return_user_ratio", "new_user_ratio"]), COUNTRY_DAILY)
