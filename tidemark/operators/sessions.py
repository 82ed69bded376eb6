"""From raw events to classified sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import any_of
from ..sources.schemas import BRONZE, COMPLETE, COMPLETE_RATIO, EVENT, EXIT, IN_PROGRESS, REQUIRED, SESSION_KEYS, SILVER, TIMEOUT_EXIT, TIMEOUT_SECONDS, UNKNOWN, conform



def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines as events with their date (the date at the head of utimestamptz).

    A malformed line is a row of nulls, a field of a wrong type is null, other
    fields are ignored.
    """
    parsed = lines.select(F.from_json(F.col(value).cast("string"), EVENT).alias("data")).select("data.*")
    return parsed.withColumn("datetime", F.col("utimestamptz").try_cast("date"))


def on_date(events: DataFrame, date: str) -> DataFrame:
    """Events of one date; those that came late for another are left for its own run."""
    return events.where(F.col("datetime") == F.lit(date).cast("date"))


def latest_events(events: DataFrame) -> DataFrame:
    """The latest row of each event_id (then the largest session and type, so that ties are settled)."""
    order = Window.partitionBy("event_id").orderBy(F.desc("event_ts"), F.desc("session_id"), F.desc("event_type"))
    stamped = events.withColumn("event_ts", F.try_to_timestamp("utimestamptz"))
    return stamped.withColumn("row_num", F.row_number().over(order)).where("row_num = 1").drop("row_num")


def required(events: DataFrame) -> DataFrame:
    return events.dropna(subset=REQUIRED)


def fill_unknown(events: DataFrame) -> DataFrame:
    return events.fillna(UNKNOWN)


def sessionize(events: DataFrame) -> DataFrame:
    """One row per session, episode, device and day. All aggregates are monotone, so sessions can be folded."""
    kind = lambda name: any_of(F.col("event_type") == name)
    return events.groupBy(*SESSION_KEYS).agg(
        F.min("event_ts").alias("start_time"),
        F.max("event_ts").alias("end_time"),
        F.max("dwell_time_ms").alias("duration_ms"),
        F.round(F.max("scroll_ratio"), 2).alias("max_scroll_ratio"),
        kind("enter").alias("seen_enter"),
        kind("scroll").alias("seen_scroll"),
        kind("complete").alias("seen_complete"),
        kind("exit").alias("seen_exit"),
    )


def classify(sessions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """session_state as of an instant (now), is_complete and is_exit."""
    as_of = F.current_timestamp() if as_of is None else as_of
    idle = F.unix_timestamp(as_of) - F.unix_timestamp("end_time")
    state = (
        F.when(F.col("seen_complete") & (F.col("max_scroll_ratio") >= COMPLETE_RATIO), COMPLETE)
        .when(F.col("seen_exit") & (F.col("max_scroll_ratio") < COMPLETE_RATIO), EXIT)
        .when(idle > TIMEOUT_SECONDS, TIMEOUT_EXIT)
        .otherwise(IN_PROGRESS)
    )
    out = sessions.withColumn("session_state", state)
    return out.withColumns({"is_complete": (F.col("session_state") == COMPLETE).cast("int"), "is_exit": F.col("session_state").isin(EXIT, TIMEOUT_EXIT).cast("int")})


def cleanse(events: DataFrame) -> DataFrame:
    """Deduplicated events with all required fields and known dimensions."""
    return fill_unknown(required(latest_events(events)))


def build_sessions(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Events (of any dates) to classified sessions, in the session table's columns."""
    return conform(classify(sessionize(cleanse(conform(events, BRONZE))), as_of), SILVER)


def fold_sessions(one: DataFrame, other: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Sessions that either holds, merged field by field: the sessions of both inputs' events together."""
    both = one.select(*SILVER.names).unionByName(other.select(*SILVER.names))
    least, most = ["start_time"], ["end_time", "duration_ms", "max_scroll_ratio", "seen_enter", "seen_scroll", "seen_complete", "seen_exit"]
    merged = both.groupBy(*SESSION_KEYS).agg(*[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    return conform(classify(merged, as_of), SILVER)


def replace_sessions(target: DataFrame, staging: DataFrame) -> DataFrame:
    """target with the sessions of staging in place of its own of the same keys."""
    keep = target.join(staging.select(*SESSION_KEYS), SESSION_KEYS, "left_anti")
    return keep.select(*SILVER.names).unionByName(staging.select(*SILVER.names))


def refresh_states(sessions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Sessions classified again, so that those without new events time out."""
    return conform(classify(sessions, as_of), SILVER)
