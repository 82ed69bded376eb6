"""Queries over the table store, the control plane and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sessions
from ..sources import schemas, simulate, store, testbed
from ..sources.cluster import checkpoint_root
from ..streaming.ingest import ingest, lines_from_files
from . import runner

ALL: dict = {}
#: (snapshot_id, parent_id, committed_at): a chain, and a branch that leaves it.
_CHAIN = [(1, None, 10), (2, 1, 20), (3, 2, 30), (4, 2, 35), (5, 3, 40)]
_LOG = "log(snapshot_id, parent_id, committed_at) AS (VALUES " + ", ".join(f"({a}, {'NULL' if b is None else b}, {c})" for a, b, c in _CHAIN) + ")"


def query(name: str, sql: str | None = None, date: str | None = None):
    def add(f):
        ALL[name] = f, sql, date
        return f

    return add


def new_root(spark) -> str:
    """A new folder for the tables of one run."""
    return f"{checkpoint_root(spark)}/tables-{uuid.uuid4().hex}"


def _log(spark):
    return spark.createDataFrame(_CHAIN, "snapshot_id long, parent_id long, committed_at int")


@query("snapshot_latest", f"WITH {_LOG} SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id FROM log ORDER BY committed_at DESC LIMIT 1")
def snapshot_latest(spark, d):
    return store.latest_snapshot(_log(spark)).select("snapshot_id")


@query("snapshot_lineage", f"WITH RECURSIVE {_LOG}, chain AS (SELECT snapshot_id, parent_id, 0 AS depth FROM log WHERE snapshot_id = 5 UNION ALL SELECT l.snapshot_id, l.parent_id, c.depth + 1 FROM chain c JOIN log l ON l.snapshot_id = c.parent_id) SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, CAST(depth AS INTEGER) AS depth FROM chain")
def snapshot_lineage(spark, d):
    return store.lineage(_log(spark), 5)


@query("partition_readiness", "SELECT CAST(ts AS DATE) AS datetime, count(*) AS n_rows, count(DISTINCT event_id % 2) AS n_files FROM events GROUP BY 1", "datetime")
def partition_readiness(spark, d):
    """Rows and files of each day's partition, after two appends of one file for each day."""
    table = store.Table(spark, new_root(spark), schemas.BRONZE)
    for k in (0, 1):
        table.append(testbed.raw_events(spark, d).where(F.col("event_id").cast("long") % 2 == k).coalesce(1))
    return runner.partition_stats(table.read())


@query("partition_overwrite", "SELECT CAST(ts AS DATE) AS datetime, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN count(CASE WHEN event_type = 'view' THEN 1 END) ELSE count(*) END AS n_rows FROM events GROUP BY 1", "datetime")
def partition_overwrite(spark, d):
    """One day replaced by its enter events; the others stay."""
    table = store.Table(spark, new_root(spark), schemas.BRONZE)
    raw = testbed.raw_events(spark, d)
    table.append(raw)
    table.overwrite_partitions(sessions.on_date(raw, "2024-01-05").where("event_type = 'enter'"))
    return table.read().groupBy("datetime").agg(F.count("*").alias("n_rows"))


_INCREMENT = "SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_events FROM events WHERE event_id % 3 = 2"


@query("incremental_append_scan", _INCREMENT)
def incremental_append_scan(spark, d):
    """Three appends; what the last one added, read by snapshot."""
    table = store.Table(spark, new_root(spark), schemas.BRONZE)
    raw = testbed.raw_events(spark, d)
    for k in (0, 1, 2):
        table.append(raw.where(F.col("event_id").cast("long") % 3 == k))
    return table.read(start=2, end=3).agg(F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_events"))


def _totals(df):
    return df.groupBy("session_state").agg(F.count("*").alias("n_sessions"), F.sum("duration_ms").alias("sum_duration"), F.sum(F.unix_micros("start_time") % 1000003).alias("sum_start"), F.sum("is_complete").alias("n_complete"))


@query("silver_incremental_equals_full")
def silver_incremental_equals_full(spark, d):
    """Sessions kept up to date over three batches of events, by state."""
    house = runner.Lakehouse(spark, new_root(spark))
    raw = testbed.feed(spark, d)
    for k in (0, 1, 2):
        house.events.append(raw.where(F.col("event_id").cast("long") % 3 == k))
        house.update_sessions(as_of=testbed.as_of())
    return _totals(house.sessions.read())


@query("stream_ingest_available_now", "SELECT event_type, count(*) AS n_events FROM (SELECT CASE event_type WHEN 'view' THEN 'enter' WHEN 'click' THEN 'scroll' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'exit' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def stream_ingest_available_now(spark, d):
    """The events as JSON files, streamed into a table twice: the second run finds nothing new."""
    root = new_root(spark)
    raw = testbed.raw_events(spark, d)
    raw.select(F.to_json(F.struct(*schemas.EVENT.names)).alias("value")).write.text(f"{root}/in")
    table = store.Table(spark, f"{root}/events", schemas.BRONZE)
    for _ in range(2):
        ingest(lines_from_files(spark, f"{root}/in"), table, f"{root}/checkpoint", once=True).awaitTermination()
    return table.read().groupBy("event_type").agg(F.count("*").alias("n_events"))


_SIMULATED = {"sessions": 2000, "out_of_order": 0.1, "binge": 0.1}


@query("simulated_sessions", simulate.sql(**_SIMULATED))
def simulated_sessions(spark, d):
    """The events of 2000 simulated readers."""
    return simulate.simulate(spark, **_SIMULATED)
