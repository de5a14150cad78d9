"""From wrapper errors to root causes, and from error texts to reasons.

Run details, outputs and event logs are read as tables. A wrapper error points at a
child by one of three edges. Runs are decided from the deepest up, in rounds of joins that
only touch the runs still open, whatever the number of failed tasks or the length of a chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsight.functions.graphs import circles
from opsight.functions.relational import latest_by
from opsight.functions.rules import by_value, first_match
from opsight.scratch import materialize

# Wrapper texts, the run reference pattern, markers, reason rules and advice.
WRAPPER = (
    r"childpipelinefailed"
    r"|pipeline execution failed"
    r"|workload failed, see run output"
    r"|notebookexecutionexception"
    r"|workflowexception"
    r"|see run output for details"
)
RUN_REFERENCE = r"(?:/runs?/|runId[=/]|run_id[=/])(\d{4,})"
NO_OUTPUT = "[get-output unavailable]"
NO_CHILD = "[child run unavailable]"
NO_RUN = "[run detail unavailable]"
FAILED = ["FAILED", "ERROR", "TIMEDOUT"]
REASONS = [
    (
        "Cascading skip (upstream failed)",
        "was skipped because not all its dependencies|run result unavailable|all upstream tasks",
        "Not a root cause — a downstream task skipped after an upstream failure. Dedupe to the upstream error; a Lakeflow DAG surfaces the true failing node and skips re-running healthy downstream work",
    ),
    (
        "Lakeflow/DLT pipeline error (nested)",
        "refer to the logs for this pipeline|pipeline.*page|dlt|delta live",
        "Job error only points to the pipeline — drill into the pipeline event log (Pipelines API / system.lakeflow pipeline tables) for the real cause; add DLT expectations so data issues quarantine instead of failing the pipeline",
    ),
    (
        "Kernel / driver crash",
        "kernel is unresponsive|python kernel|fatal error",
        "Usually driver memory or an unstable all-purpose cluster — move to serverless / right-size; split the monolithic notebook into smaller DLT stages",
    ),
    (
        "Serverless incompatibility",
        "not allowed on serverless|pyspark rdds|not_implemented",
        "Unsupported API on serverless (e.g. RDDs) — refactor to DataFrame/Spark SQL, or pin to classic compute via DABs until refactored",
    ),
    (
        "Schema / object mismatch",
        "unresolved_column|cannot be resolved|cannot resolve|analysisexception|table_or_view_not_found|no_such_catalog|no such catalog|catalog.*not.*found|no such struct|incompatible|schema mismatch|schema",
        "Auto Loader schema inference + schemaEvolutionMode=addNewColumns; enforce with DLT expectations instead of failing the run; pin catalog/table refs in DABs",
    ),
    (
        "Missing / late-arriving files",
        "no such file|path does not exist|filenotfound|file.*not.*found|does not exist",
        "Auto Loader incremental file discovery — no ADF path enumeration; late/out-of-order files picked up automatically",
    ),
    (
        "Memory pressure / OOM",
        "outofmemory|java heap|gc overhead|out of memory|executor lost|oom",
        "Move to serverless / let Lakeflow size compute; split monolithic notebook into DLT stages",
    ),
    (
        "Timeout",
        "timeout|timed out|deadline exceeded|exceeded .*time",
        "Serverless + Lakeflow Jobs automatic retries; decompose into incremental DLT tables so each run does less",
    ),
    (
        "Data access / permissions",
        "permission|access denied|unauthorized|forbidden|403|operation not permitted",
        "UC external locations + service principals; ingest via Auto Loader on the governed path",
    ),
    (
        "Monitoring / setup config",
        "experiment tag|mlflow.monitoring|sqlwarehouseid|is missing or empty|not configured",
        "Fix the setup config (e.g. set the Lakehouse Monitoring warehouse tag); manage it declaratively via DABs so it cannot drift",
    ),
    (
        "Missing parameter / widget",
        "widget is required|widget .*required|no workflow found|parameter .*required|is required",
        "Required job parameter/widget or lookup missing — make parameters explicit in the DABs job definition instead of relying on ADF-passed values",
    ),
    (
        "Null / type errors on dirty data",
        "nullpointer|null value|nonetype|none type|null in",
        "DLT expectations to quarantine/drop bad rows (EXPECT ... ON VIOLATION DROP) rather than crashing",
    ),
    (
        "Missing dependency / library",
        "modulenotfound|importerror|no module named|cannot import|library install",
        "Pin dependencies via DABs / serverless environments; remove ad-hoc %pip / cluster-library installs",
    ),
    (
        "Malformed / parse errors",
        "malformed|corrupt|badrecord|could not parse|parseexception",
        "Auto Loader rescued-data column captures bad records; add DLT expectations on parse quality",
    ),
    (
        "Data quality / dedup",
        "constraint|duplicate|primary key|unique|merge .*match",
        "DLT expectations + APPLY CHANGES INTO (CDC) for idempotent, dedup-safe upserts",
    ),
    (
        "Source connectivity (JDBC/API)",
        "connection|connect timed|refused|network|unknown host|jdbc|socket",
        "Lakeflow Connect managed connectors with built-in retry, replacing ADF copy activities",
    ),
    (
        "Capacity / quota",
        "instance pool|capacity|quota|limit exceeded",
        "Serverless removes fixed pools/quotas; Lakeflow elasticity absorbs bursts",
    ),
    (
        "Application code bug (unhandled exception)",
        "notimplementederror|not yet wired|typeerror|keyerror|valueerror|attributeerror|assertionerror|runtimeerror|exception",
        "Genuine code defect (unhandled exception) — this is the real RCA/triage-agent surface; route with the enriched stack trace for a fix suggestion",
    ),
]
OTHER_REASON = "Other / uncategorized code error"
OTHER_ADVICE = "Route to the RCA/triage agent with the enriched error text + stack trace"


# ---- texts ---------------------------------------------------------------------------


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def is_wrapper(error: Column, state_message: Column) -> Column:
    """Whether the error (else the state message) only wraps another; blank or marked text does not."""
    text = F.trim(F.coalesce(_filled(error), _filled(state_message), F.lit("")))
    return (text != "") & ~text.startswith("[") & text.rlike(f"(?i){WRAPPER}")


def child_run_id(*texts: Column) -> Column:
    """The last run id referenced by the first of the texts that references any."""
    last = [F.element_at(F.regexp_extract_all(t, F.lit(RUN_REFERENCE), 1), -1) for t in texts]
    guarded = [F.when(t.rlike(RUN_REFERENCE), found) for t, found in zip(texts, last)]
    return F.coalesce(*guarded).try_cast("bigint")


def event_log_errors(event_log: DataFrame) -> DataFrame:
    """Per flow: its newest error event, else its newest event with a failed status."""
    status = F.get_json_object("details", "$.flow_progress.status")
    state = F.get_json_object("details", "$.update_progress.state")
    is_error = F.col("level") == "ERROR"
    failed = F.coalesce(status == "FAILED", F.lit(False)) | F.coalesce(state == "FAILED", F.lit(False))
    tie = ["event_seq"] if "event_seq" in event_log.columns else []
    kept = event_log.withColumn("_first", F.coalesce(is_error, F.lit(False)).cast("int")).filter(
        (F.col("_first") == 1) | failed
    )
    return latest_by(kept, ["pipeline_id"], ["_first", "event_ts", *tie]).select(
        "pipeline_id", "message", "details"
    )


# ---- resolution ----------------------------------------------------------------------


@dataclass
class RunTables:
    """``runs(run_id, run_page_url)``, ``tasks(run_id, task_key, task_order, task_run_id,
    result_state, state_message, pipeline_id)``, ``outputs(run_id, error, error_trace,
    state_message, child_run_id)`` and ``events(pipeline_id, message, details)``.

    ``cut`` writes what a round or level found to scratch and reads it back, so that it is
    computed once and not for every edge that uses it.
    """

    runs: DataFrame
    tasks: DataFrame
    outputs: DataFrame
    events: DataFrame
    cut: Callable[[DataFrame, str], DataFrame] | None = None


RESULT = ["resolved_error", "resolved_trace", "resolved_via", "resolved_depth"]


def _units_of(runs: DataFrame, t: RunTables) -> DataFrame:
    """The tasks of each run; a run without tasks is one ``solo`` unit of its own.

    A run whose detail is gone keeps one ``lost`` row without output.
    """
    described = t.runs.select("run_id", F.lit(True).alias("_described"))
    tasks = t.tasks.withColumnRenamed("state_message", "unit_message")
    lost = F.col("_described").isNull()
    solo = ~lost & F.col("task_order").isNull()
    return (
        runs.join(described, "run_id", "left")
        .join(tasks, "run_id", "left")
        .withColumns({"lost": lost, "solo": solo})
        .withColumn("unit_run_id", F.when(F.col("solo"), F.col("run_id")).when(~F.col("lost"), F.col("task_run_id")))
        .drop("_described", "task_run_id")
    )


def _every_unit(t: RunTables) -> DataFrame:
    """All tasks, also of runs whose detail is gone, and the runs without tasks."""
    flags = {"lost": F.lit(False), "solo": F.lit(False)}
    tasks = t.tasks.withColumnsRenamed({"state_message": "unit_message", "task_run_id": "unit_run_id"}).withColumns(flags)
    alone = t.runs.select("run_id", F.col("run_id").alias("unit_run_id"), F.lit(False).alias("lost"), F.lit(True).alias("solo"))
    alone = alone.join(t.tasks.select("run_id"), "run_id", "left_anti")
    return tasks.unionByName(alone, allowMissingColumns=True)


def _own_output(units: DataFrame, outputs: DataFrame) -> DataFrame:
    """Units with the output they left behind, or a marker where it is gone."""
    out = outputs.select(
        F.col("run_id").alias("unit_run_id"),
        "error",
        "error_trace",
        F.col("state_message").alias("_message"),
        F.col("child_run_id").alias("_child"),
        F.lit(True).alias("_has_output"),
    )
    gone = F.col("unit_run_id").isNotNull() & F.col("_has_output").isNull()
    return (
        units.join(out, "unit_run_id", "left")
        .withColumn("error", F.when(gone, NO_OUTPUT).otherwise(F.col("error")))
        .withColumn("state_message", F.coalesce(_filled(F.col("unit_message")), "_message"))
        .drop("_has_output", "_message", "unit_message")
    )


def _accepted(error: Column) -> Column:
    return F.coalesce(_filled(error).isNotNull() & ~is_wrapper(error, F.lit(None).cast("string")), F.lit(False))


def _edged(units: DataFrame, t: RunTables, solo_via: str, solo_follows: bool) -> DataFrame:
    """Units with their output, what they say themselves (``_self``), their flow's error (``_at_flow``) and their
    edges to child runs, ``_job`` before ``_text``.

    Solo units follow no edge but references in their text, and those only if ``solo_follows``.
    """
    own = _own_output(units, t.outputs)
    wraps, named, unit, solo = F.col("_wraps"), F.col("_named"), F.col("unit_run_id"), F.col("solo")
    by_reference = wraps & (~solo | F.lit(solo_follows)) & ((named != unit) | unit.isNull())
    flows = t.events.filter(_filled(F.col("message")).isNotNull()).select(
        F.col("pipeline_id").alias("_flow"), F.col("message").alias("_msg"), F.col("details").alias("_details")
    )
    at_self = F.struct(
        F.col("error").alias("resolved_error"),
        F.col("error_trace").alias("resolved_trace"),
        F.when(solo, solo_via).otherwise("task_output").alias("resolved_via"),
        F.lit(0).alias("resolved_depth"),
    )
    at_flow = F.struct(
        F.col("_msg").alias("resolved_error"),
        F.col("_details").alias("resolved_trace"),
        F.concat(F.lit("pipeline_event_log("), "_flow", F.lit(")")).alias("resolved_via"),
        F.lit(1).alias("resolved_depth"),
    )
    return (
        own.withColumns(
            {
                "_wraps": is_wrapper(F.col("error"), F.col("state_message")),
                "_named": child_run_id(F.col("error"), F.col("error_trace"), F.col("state_message")),
            }
        )
        .withColumns(
            {
                "_flow": F.when(wraps & ~solo, F.col("pipeline_id")),
                "_job": F.when(wraps & ~solo, F.nullif("_child", F.lit(0))),
                "_text": F.when(by_reference, F.nullif(named, F.lit(0))),
            }
        )
        .join(flows, "_flow", "left")
        .withColumns({"_self": at_self, "_at_flow": F.when(F.col("_msg").isNotNull(), at_flow)})
        .withColumns({edge: F.when(F.col("_msg").isNull(), F.col(edge)) for edge in ("_job", "_text")})
        .drop("_wraps", "_named", "_flow", "_msg", "_details", "_child")
    )


def _chosen(job: Column, text: Column) -> Column:
    """What a unit resolves to, given what its children do: flow, then job, then reference, else itself."""
    at_job = job.withField("resolved_depth", job["resolved_depth"] + 1)
    at_text = text.withField("resolved_depth", text["resolved_depth"] + 1).withField(
        "resolved_via", F.concat(F.lit("notebook_run_child/"), text["resolved_via"])
    )
    return F.coalesce(F.col("_at_flow"), F.when(job.isNotNull(), at_job), F.when(text.isNotNull(), at_text), F.col("_self"))


def _resolve_units(units: DataFrame, t: RunTables, depth: int | None, solo_via: str, solo_follows: bool) -> DataFrame:
    """Add the deepest real error of each unit, following at most ``depth`` levels of children, or all."""
    edged = _edged(units, t, solo_via, solo_follows)
    given = [c for c in edged.columns if not c.startswith("_")]
    if depth is not None and depth <= 0:
        return edged.select(*given, "_self.*")
    if depth is None:
        children = _all_children(t)
    else:
        ids = edged.select(F.explode(F.array("_job", "_text")).alias("run_id")).filter("run_id is not null")
        children = _resolve_children(ids.distinct(), t, depth - 1)
        if t.cut:
            children = t.cut(children, f"children-{depth}")
        children = children.withColumn("_circle", F.lit(None).cast("bigint"))
    mine = children.filter("_circle is not null").select("run_id", F.col("_circle").alias("_mine"))
    children = children.filter(_accepted(F.col("resolved_error")))
    joined = edged.join(mine, "run_id", "left")
    for edge in ("_job", "_text"):
        found = children.select(
            F.col("run_id").alias(edge), F.struct(*RESULT).alias(f"{edge}_found"), F.col("_circle").alias(f"{edge}_circle")
        )
        same = F.coalesce(F.col("_mine") == F.col(f"{edge}_circle"), F.lit(False))
        joined = joined.join(found, edge, "left").withColumn(f"{edge}_found", F.when(~same, F.col(f"{edge}_found")))
    return joined.select(*given, _chosen(F.col("_job_found"), F.col("_text_found")).alias("_found")).select(*given, "_found.*")


def _all_children(t: RunTables) -> DataFrame:
    """What every run resolves to that a wrapper error names, however long the chain behind it, and its ``_circle``.

    Runs are decided from the deepest up: a round decides the runs all of whose units are settled,
    and only what it decided meets the open units of the next, so the work is that of the
    levels there are, and each run is decided once. When a round decides nothing, the open
    runs stand on circles or wait for one: edges on circles are given up there, so that a unit on
    a circle ends as its wrapper (unless it has another edge), and the rounds go on.
    """
    cut = t.cut or materialize
    edges = _edged(_every_unit(t), t, "child_run_output", True).select(F.explode(F.array("_job", "_text")).alias("run_id"))
    named = cut(edges.filter("run_id is not null").distinct(), "named-runs")
    run = Window.partitionBy("run_id")
    # only failed tasks count where a run has any
    failed = F.coalesce(F.col("result_state").isin(FAILED), F.lit(False))
    nothing = F.lit(None).cast("struct<resolved_error string, resolved_trace string, resolved_via string, resolved_depth int>")
    waits = F.coalesce("_job", "_text").isNotNull()
    units = (
        _edged(_units_of(named, t), t, "child_run_output", True)
        .withColumn("_counts", failed | ~F.max(failed).over(run))
        .filter("_counts")
        .select("run_id", "task_order", "result_state", "solo", "lost", "_self", "_at_flow", "_job", "_text")
        .withColumns({"_job_found": nothing, "_text_found": nothing, "_open": F.max(waits).over(run)})
    )
    units = cut(units, "units")
    decided = cut(_best_of(units.filter("not _open")), "decided")
    done, on = [decided], None
    units = units.filter("_open")
    while not units.isEmpty():
        known = decided.select(
            "run_id", F.when(_accepted(F.col("resolved_error")), F.struct(*RESULT)).alias("_got"), F.lit(True).alias("_known")
        )
        for edge in ("_job", "_text"):
            found, left = F.coalesce(f"{edge}_found", "_got"), F.when(F.col("_known").isNull(), F.col(edge))
            units = units.join(known.withColumnRenamed("run_id", edge), edge, "left")
            units = units.withColumns({f"{edge}_found": found, edge: left}).drop("_got", "_known")
        units = cut(units.withColumn("_open", F.max(waits).over(run)), "units")
        decided = cut(_best_of(units.filter("not _open")), "decided")
        done.append(decided)
        units = units.filter("_open")
        if decided.isEmpty() and not units.isEmpty():
            on = circles(units.select(F.col("run_id").alias("src"), F.explode(F.array("_job", "_text")).alias("dst")), cut)
            units = cut(_without_circles(units, on), "units")
    runs = reduce(DataFrame.unionByName, done)
    if on is None:
        return runs.withColumn("_circle", F.lit(None).cast("bigint"))
    return runs.join(on.select(F.col("node").alias("run_id"), F.col("circle").alias("_circle")), "run_id", "left")


def _without_circles(units: DataFrame, on: DataFrame) -> DataFrame:
    """Open units without the edges whose two runs stand on one circle."""
    units = units.join(on.select(F.col("node").alias("run_id"), F.col("circle").alias("_mine")), "run_id", "left")
    for edge in ("_job", "_text"):
        theirs = on.select(F.col("node").alias(edge), F.col("circle").alias("_theirs"))
        same = F.coalesce(F.col("_mine") == F.col("_theirs"), F.lit(False))
        units = units.join(theirs, edge, "left").withColumn(edge, F.when(~same, F.col(edge))).drop("_theirs")
    return units.drop("_mine")


def _resolve_children(ids: DataFrame, t: RunTables, depth: int) -> DataFrame:
    """One result per child run, following at most ``depth`` levels below it."""
    units = _resolve_units(_units_of(ids, t), t, depth, "child_run_output", True)
    return _picked(units.withColumn("_found", F.struct(*RESULT)))


def _best_of(units: DataFrame) -> DataFrame:
    """One result per run whose units are settled."""
    return _picked(units.withColumn("_found", _chosen(F.col("_job_found"), F.col("_text_found"))))


def _picked(units: DataFrame) -> DataFrame:
    """Of each run its first failed task (any task if none failed) with a real error, from ``_found``."""
    found, order = F.col("_found"), F.col("task_order")
    good, failed = _accepted(found["resolved_error"]), F.col("result_state").isin(FAILED)
    best = units.groupBy("run_id").agg(
        F.bool_or("solo").alias("_solo"),
        F.bool_or("lost").alias("_lost"),
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("_any_failed"),
        F.min_by(found, F.when(good & failed, order)).alias("_failed"),
        F.min_by(found, F.when(good, order)).alias("_any"),
        F.first(F.when(F.col("solo"), found), ignorenulls=True).alias("_own"),
    )
    task = F.when(F.col("_any_failed"), F.col("_failed")).otherwise(F.col("_any"))
    pick = F.when(F.col("_solo"), F.col("_own")).otherwise(task)
    via = (
        F.when(F.col("_lost") | pick.isNull(), "child_run")
        .when(F.col("_solo"), pick["resolved_via"])
        .otherwise(F.concat(F.lit("child_run/"), pick["resolved_via"]))
    )
    return best.select(
        "run_id",
        F.when(F.col("_lost"), NO_CHILD).otherwise(pick["resolved_error"]).alias("resolved_error"),
        F.when(~F.col("_lost"), pick["resolved_trace"]).alias("resolved_trace"),
        via.alias("resolved_via"),
        F.when(F.col("_lost"), 0).otherwise(F.coalesce(pick["resolved_depth"], F.lit(0))).alias("resolved_depth"),
    )


def resolve_root_cause(tables: RunTables, depth: int | None = None) -> DataFrame:
    """Every task with its own error and the deepest real error found behind it.

    Children are followed as far as they lead, or ``depth`` levels. An edge between two runs of one
    circle is not followed where ``depth`` is not given, so a circle ends as its wrapper.
    """
    return _resolve_units(_every_unit(tables).filter(~F.col("solo")), tables, depth, "task_output", False).select(
        "run_id",
        "task_key",
        "task_order",
        F.col("unit_run_id").alias("task_run_id"),
        "state_message",
        "error",
        "error_trace",
        *RESULT,
    )


def enriched_errors(
    candidates: DataFrame, names: DataFrame, tables: RunTables, depth: int | None = None
) -> DataFrame:
    """Candidate runs with their error texts: one row per task, one for a run without
    tasks, and a marker row for a run whose detail is gone."""
    mine = candidates.select("workspace_id", "run_id", "job_id", "run_date", "termination_code")
    pages = tables.runs.select("run_id", "run_page_url")
    lost = F.col("lost")
    return (
        _resolve_units(_units_of(mine, tables), tables, depth, "run_output", False)
        .join(pages, "run_id", "left")
        .join(names.select("workspace_id", "workspace_name"), "workspace_id", "left")
        .select(
            "workspace_id",
            "workspace_name",
            "run_id",
            "job_id",
            "run_date",
            "termination_code",
            F.when(~lost, F.col("task_key")).alias("task_key"),
            F.col("unit_run_id").alias("task_run_id"),
            F.when(lost, NO_RUN).otherwise(F.col("state_message")).alias("state_message"),
            F.when(~lost, F.col("error")).alias("error"),
            F.when(~lost, F.col("error_trace")).alias("error_trace"),
            F.when(~lost, F.col("resolved_error")).alias("resolved_error"),
            F.when(~lost, F.col("resolved_trace")).alias("resolved_trace"),
            F.when(~lost, F.col("resolved_via")).alias("resolved_via"),
            F.col("resolved_depth").alias("depth"),
            "run_page_url",
        )
    )


# ---- reasons -------------------------------------------------------------------------


def classify_reason(errors: DataFrame) -> DataFrame:
    """One reason per error: the first rule that matches the first text present.

    A row whose first text is a ``[...]`` marker is dropped, later texts or not.
    """
    text = F.coalesce("resolved_error", "error", "state_message")
    msg = F.col("msg")
    rules = [(msg.rlike(pattern), name) for name, pattern, _ in REASONS]
    return (
        errors.filter(text.isNotNull() & ~text.startswith("["))
        .withColumn("msg", F.lower(text))
        .withColumn("code_failure_reason", first_match(rules, OTHER_REASON))
    )


def reason_rollup(classified: DataFrame) -> DataFrame:
    advice = by_value(F.col("code_failure_reason"), {n: a for n, _, a in REASONS}, OTHER_ADVICE)
    return (
        classified.groupBy("code_failure_reason")
        .agg(
            F.count(F.lit(1)).alias("failed_runs"),
            F.countDistinct("job_id").alias("distinct_jobs"),
            F.min("msg").alias("sample_message"),
        )
        .withColumn("recommendation", advice)
        .orderBy(F.col("failed_runs").desc())
    )


def _real(text: str) -> Column:
    filled = _filled(F.col(text))
    return F.coalesce(filled.isNotNull() & ~filled.startswith("["), F.lit(False))


def run_summary(rows: dict[str, int], enriched: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row: rows per stage, how much was enriched, a sample error, and the reasons as JSON.

    ``rows`` are the counts of the stages, as they were seen when the stages were stored: no stage
    runs again to be counted.
    """
    real = _real("resolved_error") | _real("error")
    drilled = (F.col("depth") > 0) & _real("resolved_error")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    traced = _filled(F.col("error_trace")).isNotNull() | _filled(F.col("resolved_trace")).isNotNull()
    sample = F.struct(
        "run_id",
        "job_id",
        "task_key",
        text("state_message"),
        text("error"),
        text("resolved_error"),
        "resolved_via",
        "depth",
        traced.alias("error_trace_present"),
    )
    order = F.struct((-F.col("run_id")).alias("r"), F.coalesce("task_key", F.lit("")).alias("k"))
    facts = enriched.agg(
        F.count(F.lit(1)).alias("enriched_task_rows"),
        F.count_if(real).alias("rows_with_real_error_text"),
        F.count_if(drilled).alias("rows_resolved_via_child_drilldown"),
        F.to_json(F.min_by(sample, F.when(real, order))).alias("sample_enriched_error"),
    )
    entry = F.struct(
        (-F.col("failed_runs")).alias("order"),
        F.col("code_failure_reason").alias("reason"),
        "failed_runs",
        "recommendation",
    )
    listed = reasons.agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("order"))).alias("x")
    )
    counts = {f"{name}_rows": F.lit(n).cast("long") for name, n in rows.items()}
    return facts.withColumns({**counts, "code_failure_reason_breakdown": listed.scalar()})
