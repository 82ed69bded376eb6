import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_operators import as_of, event, events, session, silver

from tidemark.plans import runner
from tidemark.sources import schemas, simulate, store
from tidemark.streaming.ingest import ingest, lines_from_files


def table(spark, tmp_path, name="t", schema=schemas.SILVER):
    return store.Table(spark, f"file://{tmp_path}/{name}", schema)


def test_empty_table_and_batches_once(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.latest() is None and t.read().count() == 0
    with pytest.raises(LookupError):
        store.plan_read(t.snapshots(), None, None)
    assert t.append(silver(spark, session(1)), batch_id=5) == t.append(silver(spark, session(1)), batch_id=5) == 1
    assert t.read().count() == 1


def test_incremental_reads_and_overwrite(spark, tmp_path):
    t = table(spark, tmp_path)
    for n in (1, 2, 3):
        t.append(silver(spark, session(n)))
    assert {r[0] for r in t.read(start=1, end=3).select("session_id").collect()} == {"s2", "s3"}
    t.append(silver(spark, session(4, datetime=dt.date(2025, 11, 2))))
    t.overwrite_partitions(silver(spark, session(9)))
    assert {r[0] for r in t.read().select("session_id").collect()} == {"s9", "s4"}
    assert t.read(end=3).count() == 3
    t.overwrite_partitions(t.read().where("false"))
    assert t.read().count() == 2
    assert t.read(dates=["2025-11-02"]).count() == 1
    with pytest.raises(ValueError):
        t.read(end=99)


def test_a_taken_number_is_a_conflict(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(silver(spark, session(1)))
    with pytest.raises(store.CommitConflict):
        t._commit({"snapshot_id": 1}, 1)


def test_plans(spark):
    log = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 2, 3), (4, 2, 4)], "snapshot_id long, parent_id long, committed_at int")
    assert [store.plan_read(log, a, b) for a, b in ((None, 3), (3, 3), (1, 3), (4, 3))] == ["full", "none", "incremental", "full"]


def test_upsert_modes(spark, tmp_path):
    e = events(spark, *[event(event_id=f"e{i}", utimestamptz=f"2025-11-01T10:0{i}:00+00:00", scroll_ratio=0.1 * i, event_type=k) for i, k in enumerate(["enter", "scroll", "exit"])])
    from tidemark.operators import sessions

    first, second = (sessions.build_sessions(e.where(c), as_of()) for c in ("event_id = 'e0'", "event_id <> 'e0'"))
    folded, replaced = table(spark, tmp_path, "f"), table(spark, tmp_path, "r")
    for t, mode in ((folded, "fold"), (replaced, "replace")):
        t.upsert_sessions(first, mode, as_of())
        t.upsert_sessions(second, mode, as_of())
        t.upsert_sessions(second, mode, as_of())
    assert folded.read().first()["seen_enter"] is True and folded.read().count() == 1
    assert replaced.read().first()["seen_enter"] is False and replaced.read().count() == 1


def test_gate(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(silver(spark, session(1)))
    assert runner.check_partition_ready(t.read(), "2025-11-01", 1, 1) == {"n_rows": 1, "n_files": 1}
    for kw in ({"min_rows": 2}, {"min_files": 2}):
        with pytest.raises(runner.NotReady):
            runner.check_partition_ready(t.read(), "2025-11-01", **kw)


def test_tasks_retry_and_report():
    seen, failed = [], []

    def flaky():
        seen.append(1)
        if len(seen) < 2:
            raise OSError("once")
        return "ok"

    assert runner.run_tasks([runner.Task("b", lambda: 2, ["a"]), runner.Task("a", flaky, retries=1, wait_seconds=0)]) == {"a": "ok", "b": 2}
    with pytest.raises(ZeroDivisionError):
        runner.run_tasks([runner.Task("x", lambda: 1 / 0)], on_failure=lambda n, e: failed.append(n))
    assert failed == ["x"]
    with pytest.raises(ValueError):
        runner.run_tasks([runner.Task("x", lambda: 1, ["y"])])
    assert [runner.int_or_none(x) for x in ("", "None", None, "7", "x")] == [None, None, None, 7, None]


def test_simulated_stream_to_daily_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    made = simulate.simulate(spark, 60, seed=3, out_of_order=0.5, binge=0.2)
    assert made.select("event_id").distinct().count() == made.count()
    simulate.write_lines(made, f"{root}/in")
    house = runner.Lakehouse(spark, f"{root}/house")
    for _ in range(2):
        ingest(lines_from_files(spark, f"{root}/in"), house.events, f"{root}/checkpoint", once=True).awaitTermination()
    assert house.events.read().count() == made.count()
    assert house.update_sessions(as_of=as_of()) == "full" and house.update_sessions(as_of=as_of()) == "none"
    date = "2024-01-01"
    house.update_gold(date, wait_seconds=0)
    house.update_gold(date, wait_seconds=0)
    house.views()
    n = spark.sql(f"SELECT count(*) FROM sessions WHERE datetime = DATE '{date}'").first()[0]
    assert spark.sql("SELECT sum(total_episode_sessions) FROM user_daily_metrics").first()[0] == n
    states = {r[0] for r in house.sessions.read().select("session_state").distinct().collect()}
    assert states == {"COMPLETE", "EXIT"}
    with pytest.raises(runner.NotReady):
        house.update_gold("2030-01-01", wait_seconds=0)


def test_simulation_is_seeded(spark):
    a, b = (simulate.simulate(spark, 20, seed=1).orderBy("event_id").collect() for _ in range(2))
    assert a == b
    for r in simulate.simulate(spark, 30, seed=2).groupBy("session_id").agg(F.max("scroll_ratio").alias("m"), F.max_by("event_type", "dwell_time_ms").alias("last")).collect():
        assert r["last"] in ("complete", "exit") and (r["m"] == 1.0 or r["m"] <= 0.9)
