"""Streams over several files and growing files: late events, restarts, requests across midnight, state that does not pile up."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stripline.streaming import events as V
from stripline.streaming import tail as L


def log(folder, *files):
    for k, rows in enumerate(files):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in this order


def event(i, ts, chapter="c", state="new", event="state", request="r"):
    return {"event_id": i, "ts": ts, "chapter": chapter, "request_id": request, "event": event, "state": state, "props": None}


def grow(path, *rows, end="\n"):
    with open(path, "a") as f:
        f.write("".join(json.dumps(r) + end for r in rows))


def states(q, k=-1):
    return [("state" if x["operatorName"].startswith("sessionWindow") else x["operatorName"], x["numRowsTotal"], x["numRowsUpdated"]) for x in q.recentProgress[k]["stateOperators"]]


def test_transitions_over_batches_with_late_events(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    first = [event(1, "2024-01-01T10:00:00", state="a"), event(2, "2024-01-01T11:00:00", state="b"), event(3, "2024-01-01T09:00:00", "d", "x")]
    second = [event(4, "2024-01-01T12:00:00", state="b"), event(5, "2024-01-01T10:30:00", state="late"), event(6, "2024-01-01T13:00:00", state="c")]
    third = [event(7, "2024-01-02T00:00:00", "d", "y"), event(2, "2024-01-01T11:00:00", state="b"), event(7, "2024-01-02T00:00:00", "d", "y"), event(8, None, "e", "z")]
    log(src, first, second, third)
    root = str(tmp_path / "out")
    q = V.transition_stream(V.event_stream(spark, str(src), 1), root, str(tmp_path / "c"))
    q.awaitTermination()
    cols = ["chapter", "event_id", "state_before", "state_after"]
    got = sorted(tuple(r[c] for c in cols) for r in V.read_transitions(spark, root).filter("not late").collect())
    whole = spark.read.schema(V.EVENT).json(str(src)).filter("state <> 'late' and ts is not null").dropDuplicates(["event_id"])
    assert got == sorted(tuple(r[c] for c in cols) for r in V.transitions(whole).collect()) == [("c", 2, "a", "b"), ("c", 6, "b", "c"), ("d", 7, "x", "y")]
    assert sorted(r.event_id for r in V.read_transitions(spark, root).filter("late").collect()) == [2, 5, 8]
    ran = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
    assert [x["numRowsUpdated"] for x in ran] == [2, 1, 1] and ran[-1]["numRowsTotal"] == 2  # only chapters with new events are written


def test_transitions_go_on_after_a_restart(spark, tmp_path):
    path, root = tmp_path / "log.jsonl", str(tmp_path / "out")

    def run():
        V.transition_stream(V.log_stream(spark, str(path)), root, str(tmp_path / "c")).awaitTermination()

    grow(path, event(1, "2024-01-01T10:00:00", state="a"))
    run()
    grow(path, event(2, "2024-01-01T11:00:00", state="b"), event(3, "2024-01-01T12:00:00", state="b"))
    run()
    grow(path, event(4, "2024-01-01T11:30:00", state="q"), event(5, "2024-01-01T13:00:00", state="a"))
    run()
    rows = V.read_transitions(spark, root).collect()
    assert sorted((r.event_id, r.state_before, r.state_after) for r in rows if not r.late) == [(2, "a", "b"), (5, "b", "a")]
    assert [r.event_id for r in rows if r.late] == [4]


def test_lines_of_a_growing_file_arrive_once(spark, tmp_path):
    path, out = tmp_path / "log.jsonl", str(tmp_path / "out")

    def run(step=1 << 20):
        s = L.tail(spark, str(path), step)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.position, r.value) for r in spark.read.parquet(out).collect())

    want = []

    def add(text):
        at = path.stat().st_size if path.exists() else 0
        with open(path, "ab") as f:
            f.write(text.encode())
        return at

    want.append((add("one\n"), "one"))
    want.append((add("zwei é\r\n"), "zwei é"))
    cut = add("cut")
    assert run() == sorted(want)                      # the last line waits for its end
    add(" here\n\n")
    want += [(cut, "cut here"), (cut + 9, "")]
    assert run(4) == sorted(want)                     # ranges shorter than lines
    long = "x" * 200_000
    want += [(add(long + "\n"), long), (add("after\n"), "after")]
    assert run(30_000) == sorted(want)
    assert run() == sorted(want)                      # nothing new
    got = L.tail(spark, str(path), 9000, streaming=False).collect()
    assert sorted((r.position, r.value) for r in got) == sorted(want)
    path.write_text("shorter\n")
    with pytest.raises(Exception, match="only grows"):
        run()


def test_lines_of_a_folder_and_repeated_appends(spark, tmp_path):
    folder = str(tmp_path / "logs")
    lines = spark.range(300).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    sizes = L.append_lines(lines, folder, 3)
    more = lines.select(F.concat("value", F.lit(" more")).alias("value"))
    again = L.append_lines(more, folder, 3, sizes)
    assert L.append_lines(more, folder, 3, sizes) == again  # a task that runs again
    (tmp_path / "logs" / "_hidden").write_text("no\n")
    got = sorted(r.value for r in L.tail(spark, folder, 100, streaming=False).collect())
    assert got == sorted(r.value for r in lines.union(more).collect())
    empty = tmp_path / "none"
    empty.mkdir()
    assert L.tail(spark, str(empty), streaming=False).collect() == []


def test_durations_across_midnight(spark, tmp_path):
    path, out = tmp_path / "log.jsonl", str(tmp_path / "out")

    def run():
        d = V.job_durations_stream(V.log_stream(spark, str(path)))
        q = d.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = {r.request_id: r.duration_ms for r in spark.read.parquet(out).collect()} if os.path.exists(f"{out}/_spark_metadata") and q.lastProgress else {}
        return rows, dict((n, t) for n, t, _ in states(q)) if q.recentProgress else {}

    first = [event(1, "2024-01-01T23:50:00", event="job_requested"), event(2, "2024-01-01T23:55:00", event="job_started"), event(2, "2024-01-01T23:55:00", event="job_started")]
    grow(path, *first)
    rows, held = run()
    assert rows == {} and held["state"] == 1
    grow(path, event(3, "2024-01-02T00:05:00", event="job_finished"), event(4, "2024-01-02T09:00:00", event="job_requested", request="q"),
         event(5, "2024-01-02T09:00:01", event="job_started", request="q"))
    rows, held = run()
    assert rows == {} and held["state"] == 2 and held["dedupeWithinWatermark"] == 5
    whole = {r.request_id: r.duration_ms for r in V.job_durations(spark.read.schema(V.EVENT).json(str(path))).collect()}
    assert whole == {"r": 600_000.0, "q": None}
    grow(path, event(6, "2024-01-03T08:00:00", request="s"), event(7, None, request="t"))
    rows, held = run()
    assert rows == {} and held["state"] == 3
    grow(path, event(8, "2024-01-09T00:00:00", request="u"))
    run()
    grow(path, event(10, "2024-01-09T00:30:00", request="u"))
    rows, held = run()  # the watermark is past r, q and s
    assert {k: v for k, v in rows.items() if k in whole} == whole and "u" not in rows
    assert held["state"] == 1 and held["dedupeWithinWatermark"] == 2
    grow(path, event(3, "2024-01-02T00:05:00", event="job_finished"), event(9, "2024-01-09T01:00:00", request="u"))
    rows, held = run()  # an event that is later than the watermark opens nothing
    assert held["state"] == 1 and sum(k == "r" for k in rows) == 1
