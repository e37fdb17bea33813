"""Live runs: state that survives a restart, windows that close, late and resent events, the one-second trigger."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from strideline.operators import labels, series, steady
from strideline.plans import report
from strideline.streaming import live, state


def drop(folder, number, events):
    """One file of a collector, newer than those before it."""
    folder.mkdir(exist_ok=True)
    path = folder / f"{number:04}.json"
    path.write_text("".join(json.dumps(e) + "\n" for e in events))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def event(at, label="a", ms=5, ok=True, row=0, thread="t1", threads=1):
    return {"timestamp_ms": at, "elapsed_ms": ms, "label": label, "success": ok, "failure_message": "", "response_message": "no", "all_threads": threads, "thread_name": thread, "source_id": "s", "row_no": row}


def some(batches, of=40):
    return [[event(1000 * b + 37 * i, "abc"[i % 3], 3 * i + b, i % 7 > 0, b * of + i, threads=b % 4 + 1) for i in range(of)] for b in range(batches)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ended(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.mark.parametrize("fold", [2, 3, 100])
def test_state_survives_a_lost_driver(spark, tmp_path, fold):
    """A batch that was written but not committed when its query died runs again; nothing is lost or counted twice, folded or not."""
    for b, events in enumerate(some(9)):
        drop(tmp_path / "in", b, events)
    stream = live.event_stream(spark, str(tmp_path / "in"), 1)
    put, died = state.keep(str(tmp_path / "state"), fold=fold), []

    def dies(batch, number):
        put(batch, number)
        if number in (4, 6) and number not in died:
            died.append(number)
            raise RuntimeError("the driver is gone")

    for _ in range(2):
        query = stream.writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="the driver is gone"):
            query.awaitTermination()
    ended(state.kept(stream, str(tmp_path / "state"), str(tmp_path / "ck"), fold=fold))
    assert died == [4, 6]
    run, whole = state.cube(spark, str(tmp_path / "state")), live.collected_events(spark.read.schema(live.EVENT).json(str(tmp_path / "in")))
    assert rows(labels.statistics(run)) == rows(labels.statistics(whole)) and rows(series.cells(run)) == rows(series.cells(whole)) and rows(steady.window(run)) == rows(steady.window(whole))
    held = sorted(p.name for p in (tmp_path / "state").iterdir() if p.is_dir())
    assert (fold == 100) == all(n.startswith("batch") for n in held) and len(held) <= 3 * fold + 1 or fold == 100


def test_state_can_be_read_while_the_run_goes_on(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        state.cube(spark, str(tmp_path / "state"))
    batches = some(3)
    for b in range(3):
        drop(tmp_path / "in", b, batches[b])
        ended(state.kept(live.event_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "state"), str(tmp_path / "ck")))
        (tmp_path / "state" / "batch-99").mkdir(exist_ok=True)  # begun, not complete
        total = labels.statistics(state.cube(spark, str(tmp_path / "state"))).where("is_total").first()
        assert total["n"] == 40 * (b + 1) and total["errors"] == sum(not e["success"] for x in batches[: b + 1] for e in x)


def test_report_out_of_a_running_state(spark, tmp_path):
    for b, events in enumerate(some(4)):
        drop(tmp_path / "in", b, events)
    ended(state.kept(live.event_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "state"), str(tmp_path / "ck")))
    doc = report.live_document(state.cube(spark, str(tmp_path / "state")), report.Options("live"))
    assert doc["total"]["stats"]["n"] == 160 and len(doc["labels"]) == 3 and doc["series"]["buckets"] and doc["total"]["histogram"]
    assert "<svg" in report.as_html(doc)


def test_one_second_trigger(spark, tmp_path):
    """The trigger by time: files that come while the query runs are in the state soon after."""
    drop(tmp_path / "in", 0, some(1)[0])
    query = state.kept(live.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "ck"), every="1 second")
    try:
        for wanted in (40, 80):
            until = time.time() + 60
            while time.time() < until:
                query.processAllAvailable()
                if labels.statistics(state.cube(spark, str(tmp_path / "state"))).where("is_total").first()["n"] == wanted:
                    break
            else:
                raise AssertionError("the state didn't follow")
            drop(tmp_path / "in", 1, some(2)[1])
    finally:
        query.stop()


def appended(df, tmp_path, name):
    writer = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
    ended(writer.outputMode("append").trigger(availableNow=True).start())
    return rows(df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name)))


def test_windows_close_and_late_and_resent_events(spark, tmp_path):
    """Windows of 10 s, 5 s of patience: one event comes within that, one after it, one is sent twice, and the last window stays open."""
    drop(tmp_path / "in", 0, [event(1_000, row=1), event(4_000, row=2, ok=False), event(12_000, row=3)])
    drop(tmp_path / "in", 1, [event(4_000, row=2, ok=False), event(9_000, row=4), event(31_000, row=5, threads=9)])  # resent, late but in time
    drop(tmp_path / "in", 2, [event(2_000, row=6), event(31_000, row=5, threads=9), event(33_000, row=7)])  # too late, resent
    drop(tmp_path / "in", 3, [event(70_000, row=8)])
    stream = live.once(live.event_stream(spark, str(tmp_path / "in"), 1), "5 seconds")
    got = appended(live.closed_windows(stream, "10 seconds", "5 seconds"), tmp_path, "windows")
    assert got == [("a", 0, 3, 1, 1), ("a", 10_000, 1, 0, 1), ("a", 30_000, 2, 0, 9)]


def test_sliding_windows_close(spark, tmp_path):
    drop(tmp_path / "in", 0, [event(12_000), event(17_000)])
    drop(tmp_path / "in", 1, [event(60_000)])
    got = appended(live.closed_windows(live.event_stream(spark, str(tmp_path / "in"), 1), "10 seconds", "5 seconds", "5 seconds"), tmp_path, "sliding")
    assert got == [("a", 10_000, 2, 0, 1), ("a", 15_000, 1, 0, 1), ("a", 5_000, 1, 0, 1)]


def test_sessions_of_threads(spark, tmp_path):
    drop(tmp_path / "in", 0, [event(1_000, thread="x"), event(8_000, thread="x", ok=False), event(2_000, thread="y")])
    drop(tmp_path / "in", 1, [event(30_000, thread="x"), event(14_000, thread="y")])
    drop(tmp_path / "in", 2, [event(99_000, thread="z")])
    got = appended(live.sessions(live.event_stream(spark, str(tmp_path / "in"), 1), "10 seconds", "20 seconds"), tmp_path, "sessions")
    assert got == [("x", 1_000, 18_000, 2, 1), ("x", 30_000, 40_000, 1, 0), ("y", 14_000, 24_000, 1, 0), ("y", 2_000, 12_000, 1, 0)]


def test_silent_failures_and_missing_labels(spark):
    got = live.collected_events(spark.createDataFrame([(None, False, "", "Gone")], "label string, success boolean, failure_message string, response_message string")).select(F.col("label"), "failure_message").first()
    assert tuple(got) == ("", "Gone")
