import random
from datetime import datetime, timedelta

import pytest

from opsight.streaming.settle import of_reports, report_events, report_sets, set_tables, settle_stream, settled

SCHEMA = "report_id string, observed_ts timestamp"
START = datetime(2024, 1, 1, 10)


def at(seconds):
    return START + timedelta(seconds=seconds)


def plain(events, settle=90, interval=60):
    """(report, decision second, first, last, events) by reading events in order; the newest time is the watermark."""
    newest, out = max(t for _, t in events), []
    for report in sorted({r for r, _ in events}):
        burst, decided = [], None
        for t in sorted(t for r, t in events if r == report) + [None]:
            due = max(burst[-1] + settle, decided + interval if decided is not None else 0) if burst else None
            if burst and (t is None and due < newest or t is not None and t >= due):
                out.append((report, due, burst[0], burst[-1], len(burst)))
                burst, decided = [], due
            if t is not None:
                burst.append(t)
    return sorted(out)


class Stream:
    def __init__(self, spark, tmp_path, **parameters):
        self.spark, self.path, self.parameters = spark, tmp_path, parameters

    def drop(self, events):
        rows = self.spark.createDataFrame([(r, at(t)) for r, t in events], SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.path / "in"))
        settle_stream(stream, str(self.path / "out"), str(self.path / "checkpoint"), **self.parameters)

    def decisions(self):
        seconds = lambda t: (t - START).total_seconds()
        return sorted((r[0], seconds(r[1]), seconds(r[2]), seconds(r[3]), r[4]) for r in self.spark.read.parquet(str(self.path / "out")).collect())


def test_a_burst_is_one_decision(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.drop([("a", t) for t in range(0, 100, 10)])
    assert stream.decisions() == []  # not quiet yet
    stream.drop([("b", 179)])
    assert stream.decisions() == []
    stream.drop([("b", 300)])  # nothing new of a: its timer alone decides
    assert stream.decisions() == [("a", 180.0, 0.0, 90.0, 10), ("b", 269.0, 179.0, 179.0, 1)]


def test_decisions_keep_apart(spark, tmp_path):
    events = [("a", t) for t in (0, 20, 50, 120, 200, 210)] + [("z", 1000)]
    stream = Stream(spark, tmp_path, settle_seconds=10, interval_seconds=60)
    stream.drop(events)
    assert stream.decisions() == plain(events, 10, 60)
    moments = [d[1] for d in stream.decisions() if d[0] == "a"]
    assert moments == [10, 70, 130, 210, 270] and all(b - a >= 60 for a, b in zip(moments, moments[1:]))


@pytest.mark.parametrize("drops", [1, 3])
def test_restarts_lose_nothing(spark, tmp_path, drops):
    events = [(f"r{i % 3}", (i * 37 + i * i * 5) // 4) for i in range(60)] + [("end", 10**5)]
    events.sort(key=lambda e: e[1])
    stream = Stream(spark, tmp_path)
    size = -(-len(events) // drops)
    for i in range(0, len(events), size):
        stream.drop(events[i : i + size])
    assert stream.decisions() == plain(events)


def test_repeats_and_empty_streams(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.drop([])
    stream.drop([("a", 5), ("a", 5), ("end", 500)])
    assert stream.decisions() == [("a", 95.0, 5.0, 5.0, 2)]


def test_rows_without_time_or_report_are_left_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), (None, at(1)), ("a", at(2)), ("end", at(900))], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    settle_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    assert [(r["report_id"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1)]
    assert settled(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).columns[0] == "report_id"


def test_reports_with_the_same_tables_share_one_state(spark, tmp_path):
    needs = [(f"r{i}", t) for i in range(40) for t in (("A", "b") if i % 2 else ("b",))] + [("r1", "a"), ("other", "z"), (None, "a"), ("none", None)]
    needs = spark.createDataFrame(needs, "report_id string, source_table string")
    events = [(0, '["a"]'), (10, '["B", "a"]'), (95, '["b"]'), (99, '["q"]'), (300, '["a", "a"]'), (10**4, '["z"]')]
    rows = spark.createDataFrame([(at(t), names) for t, names in events], "observed_ts timestamp, updated_tables string")
    rows.write.parquet(str(tmp_path / "in"))
    sets = report_sets(needs)
    assert report_events(rows, set_tables(sets)).count() == 4 + 2 + 1 + 1  # 40 reports, two sets and one more
    for name, asked in (("shared", set_tables(sets)), ("single", needs)):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        settle_stream(report_events(stream, asked), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    got = of_reports(spark.read.parquet(str(tmp_path / "shared")), sets)
    want = spark.read.parquet(str(tmp_path / "single"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 20 * 2 + 20  # odd reports settle at 185 and 390 s, even ones at 185 s


@pytest.mark.parametrize("settle, interval", [(90, 60), (10, 60), (0, 5), (7, 0)])
def test_runs_are_folded_as_single_events_are(spark, tmp_path, settle, interval):
    rng = random.Random(settle)
    events = sorted((("ab"[rng.random() < 0.3], rng.randint(0, 900)) for _ in range(150)), key=lambda e: e[1]) + [("end", 10**5)]
    stream = Stream(spark, tmp_path, settle_seconds=settle, interval_seconds=interval)
    stream.drop(events[:70])
    stream.drop([e for e in events if e[1] > events[69][1]])
    kept = events[:70] + [e for e in events if e[1] > events[69][1]]
    assert stream.decisions() == plain(kept, settle, interval)
