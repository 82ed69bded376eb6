"""Runs of the pipeline: events to sessions, sessions to daily tables."""

from __future__ import annotations

import argparse
import contextlib
import datetime
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import country_daily, episode_daily, platform_daily, sessions, title_daily, user_daily
from ..sources import schemas, simulate
from ..sources.store import Files, Table, plan_read


def int_or_none(text) -> int | None:
    """A whole number, or None for what is none ("", "None", None, anything else)."""
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def partition_stats(df: DataFrame, date_col: str = "datetime") -> DataFrame:
    """Rows and files by date."""
    return df.groupBy(date_col).agg(F.count("*").alias("n_rows"), F.count_distinct(F.col("_metadata.file_path")).alias("n_files"))


class NotReady(RuntimeError):
    pass


def check_partition_ready(df: DataFrame, date: str, min_rows: int = 1, min_files: int = 0, date_col: str = "datetime") -> dict:
    """Rows and files of a date's partition; raises NotReady if there are too few."""
    day = df.where(F.col(date_col) == F.lit(date).cast("date"))
    found = day.agg(F.count("*").alias("n_rows"), F.count_distinct(F.col("_metadata.file_path")).alias("n_files")).first().asDict() if min_files else {"n_rows": day.count(), "n_files": 0}
    if found["n_rows"] < min_rows or found["n_files"] < min_files:
        raise NotReady(f"{date}: {found['n_rows']} rows in {found['n_files']} files; needed are {min_rows} and {min_files}")
    return found


@dataclass
class Task:
    name: str
    run: Callable[[], object]
    after: list[str] = field(default_factory=list)
    retries: int = 0
    wait_seconds: float = 300


def run_tasks(tasks: list[Task], on_failure: Callable[[str, Exception], None] | None = None) -> dict[str, object]:
    """Run tasks in the order of their dependencies; the first that fails for good ends the run and is reported."""
    done: dict[str, object] = {}
    left = {t.name: t for t in tasks}
    while left:
        ready = [t for t in left.values() if all(a in done for a in t.after)]
        if not ready:
            raise ValueError(f"tasks wait for each other: {sorted(left)}")
        for t in ready:
            for attempt in range(t.retries + 1):
                try:
                    done[t.name] = t.run()
                    break
                except Exception as e:
                    if attempt == t.retries:
                        if on_failure:
                            on_failure(t.name, e)
                        raise
                    time.sleep(t.wait_seconds)
            del left[t.name]
    return done


class Busy(RuntimeError):
    """Another run of the same job is active."""


class Lakehouse:
    """The tables below one folder and the jobs between them."""

    GOLD = {"user_daily_metrics": schemas.USER_DAILY, "episode_daily_metrics": schemas.EPISODE_DAILY, "title_daily_metrics": schemas.TITLE_DAILY, "platform_device_daily_metrics": schemas.PLATFORM_DAILY, "country_daily_metrics": schemas.COUNTRY_DAILY}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.events = Table(spark, f"{self.root}/events_raw", schemas.BRONZE)
        self.sessions = Table(spark, f"{self.root}/sessions", schemas.SILVER)
        self.progress = Table(spark, f"{self.root}/progress", schemas.T.StructType([schemas.T.StructField("datetime", schemas.T.DateType()), schemas.T.StructField("snapshot_id", schemas.T.LongType())]))
        self.gold = {name: Table(spark, f"{self.root}/{name}", schema) for name, schema in self.GOLD.items()}
        self.files = Files(spark, self.root)

    @contextlib.contextmanager
    def alone(self, job: str, lease_seconds: float = 6 * 3600):
        """Run as the only one of a job; a lock that is older than its lease was left by a run that died."""
        name, mine = f"locks/{job}", json.dumps({"until": time.time() + lease_seconds})
        if not self.files.publish(name, mine):
            held = self.files.read(name)
            if held and json.loads(held)["until"] > time.time():
                raise Busy(f"{job} of {self.root} is running")
            self.files.delete(name)
            if not self.files.publish(name, mine):
                raise Busy(f"{job} of {self.root} has just started")
        try:
            yield
        finally:
            self.files.delete(name)

    def last_read(self) -> int | None:
        return self.progress.read().agg(F.max("snapshot_id")).first()[0]

    def update_sessions(self, date: str | None = None, as_of: Column | None = None, full: bool = False) -> str:
        """Bring sessions up to date with new events, then time out those that got none; the pointer moves only after the merge. Returns what was read.

        New events of every day are merged, those that come late for a past one
        too; date alone changes nothing. full reads all events again, with a
        date that day's files alone, whose sessions it replaces while the
        pointer stays.
        """
        with self.alone("sessions"):
            last = self.events.latest()
            newest = last["snapshot_id"] if last else None
            if full and date and newest:
                self.sessions.upsert_sessions(sessions.build_sessions(self.events.read(end=newest, dates=[date]), as_of), "replace", as_of)
                return "full"
            previous = None if full else self.last_read()
            how = plan_read(self.events.snapshots(since=previous), previous, newest)
            if how != "none":
                new = self.events.read(start=previous if how == "incremental" else None, end=newest)
                self.sessions.upsert_sessions(sessions.build_sessions(new, as_of), "fold" if how == "incremental" else "replace", as_of)
                self.progress.append(self.spark.range(1).select(F.current_date().alias("datetime"), F.lit(newest).cast("long").alias("snapshot_id")))
            self.time_out(as_of)
            return how

    def time_out(self, as_of: Column | None = None) -> list[str]:
        """Classify again the days that hold sessions in progress whose time is up; other days are not written. Returns the days."""
        base = self.sessions.latest()
        if base is None:
            return []
        open_ones = self.sessions.read(end=base["snapshot_id"]).where(F.col("session_state") == schemas.IN_PROGRESS)
        over = sessions.refresh_states(open_ones, as_of).where(F.col("session_state") != schemas.IN_PROGRESS)
        days = [r[0] for r in over.select(F.col("datetime").cast("string")).distinct().collect()]
        if days:
            self.sessions.overwrite_partitions(sessions.refresh_states(self.sessions.read(end=base["snapshot_id"], dates=days), as_of), base["snapshot_id"])
        return days

    def update_gold(self, date: str, min_rows: int = 1, min_files: int = 0, on_failure=None, retries: int = 1, wait_seconds: float = 300) -> dict[str, object]:
        """The five daily tables of a date, each in place of what it held for it; episodes before titles, the gate before all."""
        with self.alone("gold"):
            return self._update_gold(date, min_rows, min_files, on_failure, retries, wait_seconds)

    def _update_gold(self, date, min_rows, min_files, on_failure, retries, wait_seconds) -> dict[str, object]:
        before = (datetime.date.fromisoformat(date) - datetime.timedelta(days=1)).isoformat()
        day, previous = self.sessions.read(dates=[date]), self.sessions.read(dates=[before])
        g = self.gold
        task = lambda name, run, *after: Task(name, run, ["gate", *after], retries, wait_seconds)
        return run_tasks([
            Task("gate", lambda: check_partition_ready(day, date, min_rows, min_files)),
            task("user", lambda: g["user_daily_metrics"].overwrite_partitions(user_daily.user_daily(day))),
            task("episode", lambda: g["episode_daily_metrics"].overwrite_partitions(episode_daily.episode_daily(day)), "user"),
            task("title", lambda: g["title_daily_metrics"].overwrite_partitions(title_daily.title_daily(day, g["episode_daily_metrics"].read(dates=[date]), previous)), "episode"),
            task("platform", lambda: g["platform_device_daily_metrics"].overwrite_partitions(platform_daily.platform_daily(day)), "title"),
            task("country", lambda: g["country_daily_metrics"].overwrite_partitions(country_daily.country_daily(day, previous)), "platform"),
        ], on_failure)

    def views(self, since: str | None = None, until: str | None = None) -> list[str]:
        """Register every table as a temporary view, for SQL; with since and until, of those days' files alone."""
        tables = {"events_raw": self.events, "sessions": self.sessions, **self.gold}
        for name, table in tables.items():
            days = [d for d in table.days() if (since is None or d >= since) and (until is None or d <= until)] if since or until else None
            table.read(dates=days).createOrReplaceTempView(name)
        return list(tables)


def main(argv: list[str] | None = None) -> None:
    """python -m tidemark.plans.runner ROOT {sessions,gold,simulate,upkeep} [--date D] [--full] ..."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("root")
    p.add_argument("job", choices=["sessions", "gold", "simulate", "upkeep"])
    p.add_argument("--date", help="of gold, the day (default: today); of sessions with --full, the day that is built again")
    p.add_argument("--full", action="store_true")
    p.add_argument("--min-rows", default="1")
    p.add_argument("--sessions", type=int, default=10, help="of simulate, which writes JSON lines below ROOT/incoming")
    p.add_argument("--ooo-prob", type=float, default=0.0, help="share of sessions whose first two events arrive swapped")
    p.add_argument("--binge", action="store_true", help="every reader goes on")
    p.add_argument("--binge-sessions", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    house = Lakehouse(spark, a.root)
    if a.job == "sessions":
        print(house.update_sessions(a.date, full=a.full))
    elif a.job == "gold":
        print(house.update_gold(a.date or datetime.date.today().isoformat(), min_rows=int_or_none(a.min_rows) or 1))
    elif a.job == "simulate":
        start = f"{a.date or datetime.date.today().isoformat()} 00:00:00"
        made = simulate.simulate(spark, a.sessions, a.seed, start, out_of_order=a.ooo_prob, binge=float(a.binge), binge_sessions=a.binge_sessions)
        simulate.write_lines(made, f"{house.root}/incoming")
    else:
        for table in (house.events, house.sessions, house.progress, *house.gold.values()):
            table.compact()
            table.expire()


if __name__ == "__main__":
    main()
