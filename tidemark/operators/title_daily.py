"""Daily features of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..sources.schemas import TITLE_DAILY, conform
from . import episode_daily as episodes

KEYS = ["datetime", "webtoon_id"]


def base(sessions: DataFrame) -> DataFrame:
    """As for episodes; without exits the drop-off point stays null."""
    return sessions.groupBy(*KEYS).agg(*episodes.audience())


def deepest_episode(episode_table: DataFrame) -> DataFrame:
    """The episode with the largest mean scroll ratio, of equal ones the smallest id."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc("avg_scroll_ratio"), "episode_id")
    return episode_table.withColumn("n", F.row_number().over(order)).where("n = 1").select(*KEYS, F.col("episode_id").alias("deepest_episode_reached"))


def binge(sessions: DataFrame) -> DataFrame:
    """Share of users with two episodes or more."""
    by_user = sessions.groupBy(*KEYS, "user_id").agg(F.count_distinct("episode_id").alias("n"))
    return by_user.groupBy(*KEYS).agg(ratio(F.count_distinct(F.when(F.col("n") >= 2, F.col("user_id"))), F.count_distinct("user_id")).alias("binge_read_ratio"))


def retention(sessions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Share of a title's users of the day before that are seen again; previous: sessions of that day, if sessions don't hold it."""
    earlier = sessions if previous is None else previous
    before = earlier.select(F.date_add("datetime", 1).alias("datetime"), "webtoon_id", "user_id").distinct()
    today = sessions.select(*KEYS, "user_id").distinct().withColumn("again", F.col("user_id"))
    joined = before.join(today, [*KEYS, "user_id"], "left")
    return joined.groupBy(*KEYS).agg(ratio(F.count("again"), F.count("user_id")).alias("webtoon_retention_rate"))


def title_daily(sessions: DataFrame, episode_table: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Per date and title; episode_table: the daily episodes, computed if not given."""
    table = episodes.base(sessions) if episode_table is None else episode_table
    out = base(sessions).join(deepest_episode(table), KEYS, "left").join(binge(sessions), KEYS, "left").join(retention(sessions, previous), KEYS, "left")
    return conform(out.fillna(0.0, ["binge_read_ratio", "webtoon_retention_rate"]), TITLE_DAILY)
