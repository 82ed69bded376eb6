"""Daily features by platform, device and browser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact, mean, ratio, rounded, share
from ..sources.schemas import BOUNCE_MS, PLATFORM_DAILY, TIMEOUT_EXIT, conform

KEYS = ["datetime", "platform", "device", "browser"]


def base(sessions: DataFrame) -> DataFrame:
    out = sessions.groupBy(*KEYS).agg(
        F.count_distinct("session_id").alias("total_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
        mean(F.col("is_complete")).alias("completion_rate"),
        mean(F.col("is_exit")).alias("exit_rate"),
        share(F.col("session_state") == TIMEOUT_EXIT).alias("timeout_exit_rate"),
        mean(F.col("max_scroll_ratio")).alias("avg_scroll_ratio"),
        mean(F.col("duration_ms")).alias("avg_duration_ms"),
        mean(F.col("duration_ms") <= BOUNCE_MS).alias("bounce_ratio"),
    )
    return out.withColumn("sessions_per_user", ratio(F.col("total_sessions"), F.col("unique_users")))


def _spread(column: str, *within: str) -> Column:
    w = Window.partitionBy("datetime", *within)
    return rounded(exact(F.max(column).over(w)) - exact(F.min(column).over(w)))


def gaps(table: DataFrame) -> DataFrame:
    """Largest less smallest value among the browsers, devices or platforms that share the other two."""
    return table.withColumns({
        "cross_browser_completion_gap": _spread("completion_rate", "platform", "device"),
        "cross_device_duration_gap": _spread("avg_duration_ms", "platform", "browser"),
        "cross_platform_scroll_gap": _spread("avg_scroll_ratio", "device", "browser"),
    })


def platform_daily(sessions: DataFrame) -> DataFrame:
    return conform(gaps(base(sessions)), PLATFORM_DAILY)
