"""Root-cause resolution against a plain recursive reading of its rules."""

import random
import re

import pytest

from opsight.operators import root_cause as rc
from opsight.scratch import materialize


def wraps(error, message=None):
    text = (error or message or "").strip()
    return bool(text) and not text.startswith("[") and re.search(rc.WRAPPER, text, re.I) is not None


def referenced(*texts):
    for text in texts:
        hits = re.findall(rc.RUN_REFERENCE, text or "")
        if hits:
            return int(hits[-1])
    return None


class Plain:
    """Follow one task or run at a time; ``whole``: as far as it leads, but not along circles."""

    def __init__(self, runs, tasks, outputs, events, whole=False):
        self.runs, self.events = set(runs), events
        self.circle = (lambda a, b: False) if not whole else self.same_circle
        self.outputs = {o[0]: o[1:] for o in outputs}
        self.tasks = {}
        for task in sorted(tasks, key=lambda t: t[2]):
            self.tasks.setdefault(task[0], []).append(task)

    def edges(self, run):
        """Runs that the units of a run lead to which count for it."""
        tasks = self.tasks.get(run, [])
        failed = [t for t in tasks if t[4] in rc.FAILED]
        for _, _, _, unit, _, message, flow in failed or tasks or [(run, None, 0, run, None, None, None)]:
            error, trace, other, child = self.outputs.get(unit, (rc.NO_OUTPUT if unit else None, None, None, None))
            message = message or other
            if wraps(error, message) and not (tasks and self.events.get(flow)):
                ref = referenced(error, trace, message)
                yield from [child] if tasks and child else []
                yield from [ref] if ref and ref != unit else []

    def reaches(self, a, b):
        seen, waiting = set(), [a]
        while waiting:
            for child in self.edges(waiting.pop()):
                if child in self.runs and child not in seen:
                    seen.add(child)
                    waiting.append(child)
        return b in seen

    def same_circle(self, a, b):
        return a in self.runs and b in self.runs and self.reaches(a, b) and self.reaches(b, a)

    def unit(self, run, message, flow, depth, solo, of=None):
        missing = (rc.NO_OUTPUT if run else None, None, None, None)
        error, trace, other, child = self.outputs.get(run, missing)
        message = message or other
        own = (error, trace, "child_run_output" if solo else "task_output", 0)
        if depth <= 0 or not wraps(error, message):
            return own
        if not solo and self.events.get(flow):
            return (*self.events[flow], f"pipeline_event_log({flow})", 1)
        if not solo and child and not self.circle(of, child):
            e, t, v, d = self.child(child, depth - 1)
            if e and not wraps(e):
                return e, t, v, d + 1
        ref = referenced(error, trace, message)
        if ref and ref != run and not self.circle(of, ref):
            e, t, v, d = self.child(ref, depth - 1)
            if e and not wraps(e):
                return e, t, f"notebook_run_child/{v}", d + 1
        return own

    def child(self, run, depth):
        if run not in self.runs:
            return rc.NO_CHILD, None, "child_run", 0
        tasks = self.tasks.get(run, [])
        if not tasks:
            return self.unit(run, None, None, depth, True, run)
        failed = [t for t in tasks if t[4] in rc.FAILED]
        for _, _, _, unit, _, message, flow in failed or tasks:
            e, t, v, d = self.unit(unit, message, flow, depth, False, run)
            if e and not wraps(e):
                return e, t, f"child_run/{v}", d
        return None, None, "child_run", 0


def build(seed):
    rnd = random.Random(seed)
    runs = list(range(1000, 1060))
    texts = [
        lambda: f"Workload failed, see run output: https://h/jobs/1/runs/{rnd.randint(995, 1065)}",
        lambda: "pipeline execution failed",
        lambda: "NotebookExecutionException",
        lambda: "real cause",
        lambda: "[unavailable]",
        lambda: "",
        lambda: None,
    ]
    tasks, outputs = [], []
    for run in runs:
        for n in range(rnd.choice([0, 1, 1, 2, 3])):
            unit = run * 10 + 100_000 + n
            flow = f"p{rnd.randint(0, 5)}" if rnd.random() < 0.3 else None
            state = rnd.choice(["FAILED", "SUCCESS", None, "TIMEDOUT"])
            message = rnd.choice([None, "", "see run output for details", "text"])
            tasks.append((run, f"t{n}", run * 10 + n, unit if rnd.random() < 0.95 else None, state, message, flow))
    for unit in [t[3] for t in tasks if t[3]] + runs:
        if rnd.random() < 0.9:
            child = rnd.randint(995, 1065) if rnd.random() < 0.4 else None
            trace = rnd.choice([None, f"at runId={rnd.randint(1000, 1059)} and runId={rnd.randint(1000, 1059)}"])
            outputs.append((unit, rnd.choice(texts)(), trace, rnd.choice([None, "workflowexception"]), child))
    events = {f"p{i}": (f"flow {i}" if i % 2 else None, "{}") for i in range(6)}
    return runs, tasks, outputs, {k: v for k, v in events.items() if v[0]}


def tables(spark, runs, tasks, outputs, events, cut=None):
    return rc.RunTables(
        spark.createDataFrame([(r, f"u{r}") for r in runs], "run_id long, run_page_url string"),
        spark.createDataFrame(tasks, "run_id long, task_key string, task_order long, task_run_id long, result_state string, state_message string, pipeline_id string"),
        spark.createDataFrame(outputs, "run_id long, error string, error_trace string, state_message string, child_run_id long"),
        spark.createDataFrame([(k, *v) for k, v in events.items()], "pipeline_id string, message string, details string"),
        cut,
    )


CASES = [(1, 0, None), (2, 1, None), (3, 2, None), (4, 2, materialize), (5, 3, materialize), (6, None, None), (7, None, materialize), (8, None, materialize)]


@pytest.mark.parametrize("seed, depth, cut", CASES)
def test_matches_recursive_reading(spark, seed, depth, cut):
    runs, tasks, outputs, events = build(seed)
    t = tables(spark, runs, tasks, outputs, events, cut)
    plain = Plain(runs, tasks, outputs, events, depth is None)
    got = {r.task_order: tuple(r[c] for c in rc.RESULT) for r in rc.resolve_root_cause(t, depth).collect()}
    assert len(got) == len(tasks)
    for run, _, order, unit, _, message, flow in tasks:
        assert got[order] == plain.unit(unit, message, flow, 10**6 if depth is None else depth, False, run)


def chain(links, first=0):
    """Runs of one failed task each, whose output names the next run of the chain."""
    tasks = [(a, "t", 0, a * 10, "FAILED", None, None) for a in links[:-1]]
    return tasks, [(a * 10, "Workload failed, see run output", None, None, b) for a, b in zip(links, links[1:])]


def test_a_chain_of_forty_runs_and_a_circle_of_three(spark):
    tasks, outputs = chain(range(1, 41))
    outputs.append((40, "real cause", "trace", None, None))  # the last run has no task of its own
    round_tasks, round_outputs = chain([101, 102, 103, 101])
    behind_tasks, behind_outputs = chain([100, 101])
    runs = [*range(1, 41), 100, 101, 102, 103]
    t = tables(spark, runs, tasks + round_tasks + behind_tasks, outputs + round_outputs + behind_outputs, {"none": (None, None)})
    got = {r.run_id: r for r in rc.resolve_root_cause(t).collect()}
    assert got[1].resolved_error == "real cause" and got[1].resolved_depth == 39
    assert got[39].resolved_depth == 1 and got[1].resolved_via == "child_run/" * 38 + "child_run_output"
    for run in (100, 101, 102, 103):
        assert got[run].resolved_error == "Workload failed, see run output" and got[run].resolved_depth == 0


def test_a_circle_with_a_way_out(spark):
    """A run on a circle takes its other edge; runs in front of the circle get that cause."""
    tasks, outputs = chain([1, 2, 3, 1])
    outputs[1] = (20, "Workload failed, see run output: /runs/5000", None, None, 3)
    outputs.append((5000, "the cause", None, None, None))
    front_tasks, front_outputs = chain([9, 2])
    t = tables(spark, [1, 2, 3, 9, 5000], tasks + front_tasks, outputs + front_outputs, {"none": (None, None)})
    got = {r.run_id: (r.resolved_error, r.resolved_depth) for r in rc.resolve_root_cause(t).collect()}
    assert got[2] == ("the cause", 1) and got[9] == ("the cause", 2)
    assert got[1][1] == got[3][1] == 0


def test_no_runs_at_all(spark):
    t = tables(spark, [], [], [], {})
    assert rc.resolve_root_cause(t).count() == 0


def test_event_log_prefers_errors(spark, rows):
    data = [
        ("a", "ERROR", 1, "old error", "{}"),
        ("a", "INFO", 9, "newer failed", '{"flow_progress":{"status":"FAILED"}}'),
        ("b", "INFO", 1, "failed", '{"update_progress":{"state":"FAILED"}}'),
        ("b", "INFO", 2, "fine", '{"update_progress":{"state":"DONE"}}'),
        ("c", "INFO", 2, "bad json", "not json"),
    ]
    df = spark.createDataFrame(data, "pipeline_id string, level string, event_ts int, message string, details string")
    assert rows(rc.event_log_errors(df), "pipeline_id", "message") == [("a", "old error"), ("b", "failed")]
