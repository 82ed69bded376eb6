"""Edges of the session and daily operators on small literal tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import country_daily, episode_daily, sessions, title_daily, user_daily
from tidemark.sources import schemas

def as_of():
    return F.timestamp_seconds(F.lit(1762000000))



def event(**kw):
    base = {"event_id": "e1", "user_id": 7, "webtoon_id": "webtoon_3", "episode_id": "ep_10", "session_id": "s1", "utimestamptz": "2025-11-01T10:00:00+00:00", "local_timestamptz": None, "event_type": "enter", "country": "KR", "platform": "ios", "device": "mobile", "browser": "safari", "network_type": "wifi", "scroll_ratio": 0.0, "scroll_event_count": 0, "dwell_time_ms": 0}
    return base | kw


def events(spark, *rows):
    lines = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")
    return sessions.parse_events(lines)


def session(n, **kw):
    base = {"session_id": f"s{n}", "user_id": 1, "webtoon_id": "webtoon_1", "episode_id": "ep_1", "platform": "ios", "country": "KR", "device": "pc", "browser": "chrome", "datetime": dt.date(2025, 11, 1), "start_time": dt.datetime(2025, 11, 1, 10), "end_time": dt.datetime(2025, 11, 1, 10, 5), "duration_ms": 20000, "max_scroll_ratio": 0.5, "seen_enter": True, "seen_scroll": True, "seen_complete": False, "seen_exit": False, "session_state": "IN_PROGRESS", "is_complete": 0, "is_exit": 0}
    return base | kw


def silver(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in schemas.SILVER.names) for r in rows], schemas.SILVER)


def done(n, **kw):
    return session(n, session_state="COMPLETE", is_complete=1, max_scroll_ratio=1.0, seen_complete=True, **kw)


def left(n, **kw):
    return session(n, session_state="EXIT", is_exit=1, seen_exit=True, **kw)


def test_parse_keeps_bad_lines_as_nulls(spark):
    got = events(spark, "{\"event_id\":", event(user_id="x", more=1), event(utimestamptz="2025-11-01T23:30:00-09:00")).collect()
    assert got[0]["event_id"] is None and got[0]["datetime"] is None
    assert got[1]["user_id"] is None and got[1]["event_id"] == "e1"
    assert got[2]["datetime"] == dt.date(2025, 11, 1)


def test_latest_event_wins_and_null_ids_are_one(spark):
    e = events(spark, event(scroll_ratio=0.1), event(scroll_ratio=0.9, utimestamptz="2025-11-01T10:00:01+00:00"), event(event_id=None), event(event_id=None))
    got = sessions.latest_events(e).collect()
    assert len(got) == 2 and {r["scroll_ratio"] for r in got if r["event_id"]} == {0.9}


@pytest.mark.parametrize("kind,ratio,ago,state", [("complete", 0.94, 0, "IN_PROGRESS"), ("complete", 0.945, 0, "COMPLETE"), ("complete", 0.95, 0, "COMPLETE"), ("exit", 0.95, 0, "IN_PROGRESS"), ("exit", 0.5, 0, "EXIT"), ("exit", None, 601, "TIMEOUT_EXIT"), ("enter", 0.0, 600, "IN_PROGRESS"), ("enter", 0.0, 601, "TIMEOUT_EXIT"), ("complete", 0.5, 601, "TIMEOUT_EXIT")])
def test_states(spark, kind, ratio, ago, state):
    at = dt.datetime.fromtimestamp(1762000000 - ago, dt.timezone.utc).isoformat()
    got = sessions.build_sessions(events(spark, event(event_type=kind, scroll_ratio=ratio, utimestamptz=at)), as_of()).first()
    assert (got["session_state"], got["is_complete"], got["is_exit"]) == (state, int(state == "COMPLETE"), int(state in ("EXIT", "TIMEOUT_EXIT")))


def test_required_and_unknown(spark):
    got = sessions.cleanse(events(spark, event(user_id=None), event(event_id="e2", session_id=None), event(event_id="e3", platform=None))).collect()
    assert [(r["event_id"], r["platform"]) for r in got] == [("e3", "UNKNOWN")]


def test_sessions_split_at_midnight_and_by_device(spark):
    e = events(spark, event(), event(event_id="e2", utimestamptz="2025-11-02T00:01:00+00:00"), event(event_id="e3", device="pc"))
    assert sessions.build_sessions(e, as_of()).count() == 3


def test_fold_of_any_split_equals_all_at_once(spark):
    e = events(spark, *[event(event_id=f"e{i}", event_type=k, scroll_ratio=r, dwell_time_ms=i, utimestamptz=f"2025-11-01T10:0{i}:00+00:00") for i, (k, r) in enumerate([("enter", 0.0), ("scroll", 0.4), ("scroll", 0.97), ("complete", 1.0)])])
    whole = [r.asDict() for r in sessions.build_sessions(e, as_of()).collect()]
    for cut in range(1, 4):
        parts = [sessions.build_sessions(e.where(c), as_of()) for c in (F.substring("event_id", 2, 1).cast("int") < cut, F.substring("event_id", 2, 1).cast("int") >= cut)]
        folded = sessions.fold_sessions(*parts, as_of())
        assert [r.asDict() for r in folded.collect()] == whole
        assert [r.asDict() for r in sessions.fold_sessions(folded, parts[1], as_of()).collect()] == whole


def test_user_features(spark):
    rows = [done(1), done(2, start_time=dt.datetime(2025, 11, 1, 10, 1), end_time=dt.datetime(2025, 11, 1, 10, 6)), done(3, episode_id="ep_2", start_time=dt.datetime(2025, 11, 1, 10, 7), duration_ms=10000), session(4, user_id=2, duration_ms=None, session_state="IN_PROGRESS")]
    got = {r["user_id"]: r for r in user_daily.user_daily(silver(spark, *rows)).collect()}
    assert got[1]["avg_return_interval_sec"] == 30.0  # 0 for the overlap, 60
    assert got[1]["repeat_episode_complete_count"] == 1 and got[1]["multi_episode_read_flag"] == 1
    assert got[1]["bounce_ratio"] == 0.33 and got[2]["bounce_ratio"] is None
    assert got[2]["avg_return_interval_sec"] == 0.0 and got[2]["incomplete_sessions"] == 1


def test_episode_features(spark):
    rows = [done(i, episode_id=e, duration_ms=d) for i, (e, d) in enumerate([("ep_2", 5), ("ep_10", 20000), ("ep_10", None)])] + [session(9, episode_id="ep_10", max_scroll_ratio=x) for x in (0.0,)] + [session(10, episode_id="ep_10", max_scroll_ratio=0.2), session(11, episode_id="ep_10", max_scroll_ratio=0.8), session(12, episode_id="ep_10", max_scroll_ratio=1.5)]
    got = {r["episode_id"]: r for r in episode_daily.episode_daily(silver(spark, *rows)).collect()}
    ten = got["ep_10"]
    assert [ten[f"scroll_bucket_{a}_{a + 20}"] for a in (0, 20, 40, 60, 80)] == [1, 1, 0, 0, 3]
    assert ten["continued_user_count"] == 1 and got["ep_2"]["continued_user_count"] == 0  # ep_10 comes before ep_2
    assert ten["scroll_dropoff_point"] == 0.0 and ten["bounce_ratio"] == 0.0
    by_number = {r["episode_id"]: r["continued_user_count"] for r in episode_daily.episode_daily(silver(spark, *rows), numeric_order=True).collect()}
    assert by_number == {"ep_2": 1, "ep_10": 0}


def test_title_features(spark):
    day2 = dt.date(2025, 11, 2)
    rows = [session(1, max_scroll_ratio=0.5), session(2, episode_id="ep_0", max_scroll_ratio=0.5), session(3, user_id=2), session(4, webtoon_id="webtoon_2"), session(5, datetime=day2)]
    got = {(r["datetime"], r["webtoon_id"]): r for r in title_daily.title_daily(silver(spark, *rows)).collect()}
    first, second = got[dt.date(2025, 11, 1), "webtoon_1"], got[day2, "webtoon_1"]
    assert first["deepest_episode_reached"] == "ep_0" and first["scroll_dropoff_point"] is None
    assert first["binge_read_ratio"] == 0.5 and first["webtoon_retention_rate"] == 0.0
    assert second["webtoon_retention_rate"] == 0.5 and (day2, "webtoon_2") not in got


def test_country_features(spark):
    day2 = dt.date(2025, 11, 2)
    rows = [done(1), left(2, user_id=2), session(3, datetime=day2), session(4, user_id=3, datetime=day2), session(5, country="US", user_id=1, datetime=day2)]
    got = {(r["datetime"], r["country"]): r for r in country_daily.country_daily(silver(spark, *rows)).collect()}
    assert got[day2, "KR"]["returning_users"] == 1 and got[day2, "KR"]["new_users"] == 1 and got[day2, "KR"]["return_user_ratio"] == 0.5
    assert got[day2, "US"]["returning_users"] == 0 and got[day2, "US"]["completion_exit_ratio"] == 0.0
    assert got[dt.date(2025, 11, 1), "KR"]["completion_exit_ratio"] == 1.0


def test_struct_with_null_fields_counts_as_a_value(spark):
    got = country_daily.base(silver(spark, session(1, episode_id=None), session(2), session(3, episode_id=None))).first()
    assert got["total_episode_views"] == 2


def test_one_shuffle_for_users(spark):
    plan = user_daily.user_daily(silver(spark, session(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
