"""Update events settled into refresh decisions: a burst is one decision, and decisions keep apart.

One keyed state per report: the burst that is open, and the last decision. A report is decided when its
events have been quiet for ``settle_seconds``, and not before ``interval_seconds`` have passed since its
last decision; an event before that moment belongs to the burst. Time is the events' own, so a
restart or another cut into micro-batches gives the same decisions, and the open burst waits in the
checkpoint. A decision is due once the watermark has passed it, also without a new event of that report.

Reports that need the same tables see the same events, so their decisions are equal. :func:`report_sets` makes
one key of them: events then meet the sets that name a table, not all its reports, and
:func:`of_reports` hands the decisions of a set to its reports. A report whose tables change moves to another
set and its state: keep the sets of a checkpoint, or stream by report, if dependencies change while it runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsight.functions.relational import spread_join
from opsight.operators.router import parse_updates

SETTLE, INTERVAL = 90, 60

STATE = "first long, last long, events long, decided long"
DECISION = "report_id string, decided_at timestamp, burst_start timestamp, burst_end timestamp, events long"


def report_sets(dependencies: DataFrame) -> DataFrame:
    """(report_id, set_id, tables): the tables of each report, and an id that reports with the same tables share."""
    tables = F.array_sort(F.collect_set(F.lower("source_table"))).alias("tables")
    sets = dependencies.filter("report_id is not null").groupBy("report_id").agg(tables)
    return sets.select("report_id", F.md5(F.to_json("tables")).alias("set_id"), "tables")


def set_tables(sets: DataFrame) -> DataFrame:
    """The tables of each set once, as dependencies of :func:`report_events` with the set in place of a report."""
    return sets.select(F.col("set_id").alias("report_id"), "tables").distinct().select("report_id", F.explode("tables").alias("source_table"))


def of_reports(decisions: DataFrame, sets: DataFrame) -> DataFrame:
    """Decisions of sets as decisions of the reports in them."""
    members = sets.select("report_id", "set_id")
    made = spread_join(decisions.withColumnRenamed("report_id", "set_id"), members, "set_id")
    return made.select(decisions.columns)


def report_events(events: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(report_id, observed_ts): each event once for every report that needs a table it names.

    Works row by row on a stream; the reports of a table come by a join with the static dependencies.
    """
    needs = dependencies.select("report_id", F.lower("source_table").alias("source_table")).distinct()
    seen = parse_updates(events.select(F.col("observed_ts").cast("timestamp").alias("observed_ts"), "updated_tables"))
    return seen.join(needs, "source_table").select("report_id", "observed_ts")


def settled(events: DataFrame, settle_seconds: int = SETTLE, interval_seconds: int = INTERVAL, late_seconds: int = 0) -> DataFrame:
    """Decisions of a stream of (report_id, observed_ts); events without a time or report are left out.

    Events later than ``late_seconds`` behind the newest are dropped, as the watermark says.
    """
    settle, interval = settle_seconds * 1_000_000, interval_seconds * 1_000_000

    def due(state: tuple) -> int:
        return max(state[1] + settle, state[3] + interval if state[3] is not None else 0)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst = state.get if state.exists else (None, None, 0, None)
        out = []

        def close() -> tuple:
            out.append((key[0], due(burst), burst[0], burst[1], burst[2]))
            return (None, None, 0, due(burst))

        if state.hasTimedOut:
            if burst[2]:
                burst = close()
        else:
            # a task holds the times of one report's events of one micro-batch, whose size the trigger bounds;
            # an event before the settle time of the one before it is never in another burst, so runs of them go as one
            times = np.sort(np.concatenate([b["at"].to_numpy() for b in batches]))
            begin = np.concatenate([[0], np.flatnonzero(np.diff(times) >= settle) + 1])
            end = np.append(begin[1:], len(times))
            for at, to, n in zip(times[begin].tolist(), times[end - 1].tolist(), (end - begin).tolist()):
                if burst[2] and at >= due(burst):
                    burst = close()
                burst = (at if not burst[2] else min(burst[0], at), to if not burst[2] else max(burst[1], to), burst[2] + n, burst[3])
        state.update(burst)
        if burst[2]:
            now = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(-(-due(burst) // 1000), now + 1))
        if out:
            columns = ["report_id", "decided_at", "burst_start", "burst_end", "events"]
            made = pd.DataFrame(out, columns=columns)
            for c in columns[1:4]:
                made[c] = pd.to_datetime(made[c], unit="us")
            yield made

    timed = events.filter("report_id is not null and observed_ts is not null").withWatermark("observed_ts", f"{late_seconds} seconds")
    keyed = timed.withColumn("at", F.unix_micros("observed_ts"))
    return keyed.groupBy("report_id").applyInPandasWithState(fold, DECISION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settle_stream(events: DataFrame, out: str, checkpoint: str, processing_time: str | None = None, **parameters) -> None:
    """Append the decisions of a stream of report events to parquet, what is there or for as long as it runs."""
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    writer = settled(events, **parameters).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer.format("parquet").option("path", out).trigger(**trigger).start().awaitTermination()
