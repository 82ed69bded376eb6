"""Runs over stored tables: late rows, idle runs, locks, two writers, the log's checkpoints, upkeep, streams."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_operators import as_of, event, events, session, silver

from tidemark.plans import runner
from tidemark.sources import schemas, simulate, store
from tidemark.streaming import ingest


def house(spark, tmp_path):
    return runner.Lakehouse(spark, f"file://{tmp_path}/house")


def later(**kw):
    return event(event_id=kw.pop("event_id"), utimestamptz=kw.pop("at"), **kw)


def test_late_rows_survive_a_dated_run(spark, tmp_path):
    h = house(spark, tmp_path)
    h.events.append(events(spark, later(event_id="a", at="2025-11-01T09:00:00+00:00")))
    assert h.update_sessions("2025-11-01", as_of()) == "full"
    h.events.append(events(spark, later(event_id="b", at="2025-10-30T09:00:00+00:00", session_id="late"), later(event_id="c", at="2025-11-01T10:00:00+00:00", event_type="exit", scroll_ratio=0.5)))
    assert h.update_sessions("2025-11-01", as_of()) == "incremental"
    got = {r["session_id"]: r for r in h.sessions.read().collect()}
    assert set(got) == {"s1", "late"} and got["late"]["datetime"] == dt.date(2025, 10, 30) and got["s1"]["session_state"] == "EXIT"
    assert h.update_sessions("2025-11-01", as_of()) == "none"


def test_a_dated_full_run_reads_and_writes_its_day(spark, tmp_path):
    h = house(spark, tmp_path)
    h.events.append(events(spark, later(event_id="a", at="2025-11-01T09:00:00+00:00"), later(event_id="b", at="2025-11-02T09:00:00+00:00")))
    h.update_sessions(as_of=as_of())
    pointer, before = h.last_read(), h.sessions.latest()
    plan = h.events.read(dates=["2025-11-02"])._jdf.queryExecution().toString()
    assert "datetime_day=2025-11-02" in plan or plan.count("parquet") and len(h.events.read(dates=["2025-11-02"]).inputFiles()) == 1
    assert h.update_sessions("2025-11-02", as_of(), full=True) == "full"
    last = h.sessions.latest()
    assert list(last["added"]) == ["2025-11-02"] and last["snapshot_id"] == before["snapshot_id"] + 1 and h.last_read() == pointer
    assert h.sessions.read().count() == 2


def test_an_idle_run_rewrites_only_days_that_change(spark, tmp_path):
    h = house(spark, tmp_path)
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds))
    rows = [later(event_id="a", at="2025-11-01T09:00:00+00:00"), later(event_id="b", at="2025-11-02T09:00:00+00:00", session_id="s2"), later(event_id="c", at="2025-11-02T09:00:00+00:00", session_id="s3", event_type="complete", scroll_ratio=1.0)]
    h.events.append(events(spark, *rows))
    start = int(dt.datetime(2025, 11, 1, 9, 5, tzinfo=dt.timezone.utc).timestamp())
    h.update_sessions(as_of=at(start))
    n = h.sessions.latest()["snapshot_id"]
    assert h.update_sessions(as_of=at(start)) == "none" and h.sessions.latest()["snapshot_id"] == n  # nothing to write
    assert h.update_sessions(as_of=at(start + 3600)) == "none"
    assert h.sessions.latest()["snapshot_id"] == n + 1 and list(h.sessions.latest()["added"]) == ["2025-11-01"]
    assert {r["session_id"]: r["session_state"] for r in h.sessions.read().collect()} == {"s1": "TIMEOUT_EXIT", "s2": "IN_PROGRESS", "s3": "COMPLETE"}


def test_one_run_at_a_time(spark, tmp_path):
    h = house(spark, tmp_path)
    h.events.append(events(spark, event()))
    with h.alone("sessions"), pytest.raises(runner.Busy):
        h.update_sessions(as_of=as_of())
    with h.alone("sessions", lease_seconds=-1):  # left by a run that died
        assert h.update_sessions(as_of=as_of()) == "full"
    assert h.update_sessions(as_of=as_of()) == "none"


def test_two_writers_lose_nothing(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.SILVER)
    failed = []

    def work(k):
        try:
            for i in range(3):
                t.append(silver(spark, session(10 * k + i)))
        except Exception as e:  # seen below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and t.read().count() == 9 and t.latest()["snapshot_id"] == 9
    assert {r[0] for r in t.read().select("session_id").collect()} == {f"s{10 * k + i}" for k in range(3) for i in range(3)}


def test_a_change_of_the_same_day_is_a_conflict(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.SILVER)
    t.append(silver(spark, session(1)))
    t.append(silver(spark, session(2, datetime=dt.date(2025, 11, 5))))
    assert t.overwrite_partitions(silver(spark, session(3)), base=1) == 3  # another day's change is none of its business
    with pytest.raises(store.CommitConflict):
        t.overwrite_partitions(silver(spark, session(4)), base=1)


def test_reads_of_the_log_do_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHECKPOINT_EVERY", 5)
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.SILVER)
    for n in range(13):
        t.append(silver(spark, session(n, datetime=dt.date(2025, 11, 1 + n % 2))), batch_id=n)
    seen = []
    real = store.Files.read
    monkeypatch.setattr(store.Files, "read", lambda self, name: seen.append(name) or real(self, name))
    assert t.read().count() == 13 and len(seen) <= 7  # the hint, what has expired, a checkpoint, at most four entries
    seen.clear()
    assert t.append(silver(spark, session(99)), batch_id=12) == 13 and len(seen) <= 3  # delivered again
    assert t.read(end=7).count() == 7 and t.read(start=11, end=13).count() == 2
    t.files.delete("log/newest")  # only a hint
    assert t.latest()["snapshot_id"] == 13


def test_replaced_rows_are_not_read_as_appended(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.SILVER)
    t.append(silver(spark, session(1)))
    t.overwrite_partitions(silver(spark, session(2)))
    with pytest.raises(ValueError):
        t.read(start=1)


def test_upkeep(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.SILVER)
    for n in range(5):
        t.append(silver(spark, session(n)))
    t.append(silver(spark, session(7, datetime=dt.date(2025, 11, 2))))
    assert t.compact(most=3) == 7 and t.compact(most=3) is None
    assert t.read().count() == 6 and len(t._folders(7)["2025-11-01"]) == 1 and t.read(start=4).count() == 2
    assert len(t.expire()) == 5 and t.read().count() == 6 and t.expire() == []
    with pytest.raises(ValueError):
        t.read(end=3)
    t.append(silver(spark, session(8)))
    assert t.read().count() == 7 and t.days() == ["2025-11-01", "2025-11-02"]


def test_views_of_some_days(spark, tmp_path):
    h = house(spark, tmp_path)
    h.events.append(events(spark, *[later(event_id=f"e{d}", at=f"2025-11-0{d}T09:00:00+00:00") for d in (1, 2, 3)]))
    h.views(since="2025-11-02", until="2025-11-02")
    assert spark.sql("SELECT count(*) FROM events_raw").first()[0] == 1 and len(spark.table("events_raw").inputFiles()) == 1


def test_broker_options_and_missing_connector(spark):
    assert ingest.kafka_options("h:9092", "t", 7) == {"kafka.bootstrap.servers": "h:9092", "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "7", "failOnDataLoss": "false"}
    with pytest.raises(Exception, match="kafka"):
        ingest.lines_from_kafka(spark, "h:9092", "t")


def test_the_first_stream_to_end_ends_all(spark, tmp_path):
    simulate.write_lines(simulate.simulate(spark, 5), f"file://{tmp_path}/in")
    tables = [store.Table(spark, f"file://{tmp_path}/t{k}", schemas.BRONZE) for k in (0, 1)]
    lines = ingest.lines_from_files(spark, f"file://{tmp_path}/in")
    once = ingest.ingest(lines, tables[0], f"file://{tmp_path}/c0", once=True)
    always = ingest.ingest(lines, tables[1], f"file://{tmp_path}/c1")
    began = time.time()
    assert ingest.await_any([always, once], 0.1) is once and not always.isActive and time.time() - began < 60
    assert tables[0].read().count() > 10


def test_who_leaves_scrolls_no_further(spark):
    made = simulate.simulate(spark, 400, seed=5, binge=0.5)
    by = made.groupBy("session_id").agg(F.collect_list(F.struct("dwell_time_ms", "event_type", "scroll_ratio", "scroll_event_count")).alias("e")).collect()
    early = 0
    for r in by:
        e = sorted(tuple(x) for x in r["e"])
        assert [x[3] for x in e] == [*range(len(e) - 1), len(e) - 2] and all(a[2] <= b[2] for a, b in zip(e[:-1], e[1:-1]))
        if e[-1][1] == "exit":
            assert e[-1][2] <= 0.9 and all(x[2] < 0.9 for x in e[1:-2])
            early += len(e) < 6
        else:
            assert e[-1][2] == 1.0
    assert early and made.where("session_id like '%-4'").count()


def test_command_line(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/h"
    runner.main([root, "simulate", "--sessions", "4", "--binge", "--date", "2024-01-02"])
    h = runner.Lakehouse(spark, root)
    ingest.ingest(ingest.lines_from_files(spark, f"{root}/incoming"), h.events, f"{root}/checkpoint", once=True).awaitTermination()
    runner.main([root, "sessions"])
    runner.main([root, "gold", "--date", "2024-01-02", "--min-rows", "None"])
    runner.main([root, "upkeep"])
    assert "full" in capsys.readouterr().out and h.sessions.read().count() == 20 and h.gold["title_daily_metrics"].read().count() > 0
