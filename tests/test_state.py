"""The bucketed state of a stream: rows, files that stay, batches that are run again."""

from pathlib import Path

from pyspark.sql import functions as F

from quillmark.operators.logs import latest
from quillmark.streaming import logs as streams
from quillmark.streaming.state import KeyedState

EVENTS = "/root/testdata/sf0.001/events.parquet"
SCHEMA = "k long, v string, at long"


def files(root):
    return {p.relative_to(root).as_posix(): p.stat().st_mtime_ns for p in Path(root).glob("data/**/*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_streams_give_the_last_rows(spark, tmp_path):
    events = spark.read.parquet(EVENTS).select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    halves = [events.where("at.event_id % 2 = 0"), events.where("at.event_id % 2 = 1")]
    for i, part in enumerate(halves):
        part.repartition(3).write.parquet(str(tmp_path / f"in{i}"))
    for i in range(2):  # the second stream has a checkpoint of its own, so its batches count from 0 again
        stream = streams.read_log(spark, str(tmp_path / f"in{i}"), events.schema, 1, format="parquet")
        state = streams.upsert_once(stream, str(tmp_path / "state"), str(tmp_path / f"check{i}"), "user_id", "at", buckets=8)
    assert rows(state.read()) == rows(latest(events, ["user_id"], "at"))
    assert len(state.committed()) == 6 and len(state.versions()) == 8
    # a stream without anything new leaves all as it is
    before = files(tmp_path / "state")
    streams.upsert_once(stream, str(tmp_path / "state"), str(tmp_path / "check1"), "user_id", "at", buckets=8)
    assert files(tmp_path / "state") == before


def test_a_batch_rewrites_its_own_buckets_alone(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    state = KeyedState(spark, str(tmp_path), frame().schema, "k", "at", buckets=8)
    assert state.read().count() == 0
    state.merge(frame(*[(k, "a", 1) for k in range(100)]), 0)
    before = files(tmp_path)
    state.merge(frame((7, "b", 2), (7, "old", 0)), 1)
    after = files(tmp_path)
    new = set(after) - set(before)
    assert all(after[f] == at for f, at in before.items()) and len(new) == 1 and "batch=1" in next(iter(new))
    want = sorted([(k, "a", 1) for k in range(100) if k != 7] + [(7, "b", 2)])
    assert rows(state.read()) == want
    # of an older row nothing is taken, and a batch that is complete isn't run again
    state.merge(frame((7, "late", 1)), 2)
    state.merge(frame((7, "again", 9)), 2)
    assert rows(state.read()) == want
    assert sum("batch=" in f for f in {f.rsplit("/", 1)[0] for f in files(tmp_path)} if f.startswith(next(iter(new)).split("/batch")[0])) == 2
    state.merge(frame(), 3)
    assert rows(state.read()) == want


def test_a_crash_before_the_commit_leaves_the_old_state(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    state = KeyedState(spark, str(tmp_path), frame().schema, "k", "at", buckets=4)
    state.merge(frame((1, "a", 1), (2, "a", 1)), 0)
    state.merge(frame((1, "b", 2)), 1)
    (tmp_path / "commits" / "1").unlink()
    assert rows(state.read()) == [(1, "a", 1), (2, "a", 1)]
    state.merge(frame((1, "c", 2), (2, "c", 0)), 1)
    assert rows(state.read()) == [(1, "c", 2), (2, "a", 1)]
