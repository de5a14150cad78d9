"""Operators called from SQL text, with every value bound.

A text names operators in braces, like tables, and values by markers::

    run(spark, tables, "select * from {failure_matrix} where runs >= :least",
        as_of=datetime(2024, 1, 30), lookback_days=30, workspace_id="o'brien", least=5)

Operators take their own arguments (look-back, ids) from the same named values. Values become literals of
the plan, never a part of the text, so a quote in an id changes nothing, and filters of the text are pushed
into the operator's plan as with any view.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from string import Formatter
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from opsight.operators import cost, failures
from opsight.windows import Lookback

Tables = Mapping[str, DataFrame]


def failure_matrix(t: Tables, as_of: datetime, lookback_days: int = 30, workspace_id: str | None = None, workspace_name: str | None = None) -> DataFrame:
    """Workspace x day x category of failed runs, of one workspace by id or name, or of all."""
    runs = failures.terminal_runs(t["job_run_periods"], Lookback(as_of, lookback_days))
    runs = failures.scope_workspace(runs, t["workspaces"], workspace_id, workspace_name)
    return failures.daily_failure_matrix(runs, t["workspaces"])


def failure_reach(t: Tables, as_of: datetime, lookback_days: int = 30, workspace_id: str | None = None) -> DataFrame:
    """Failed runs per category with their share of all failures."""
    runs = failures.terminal_runs(t["job_run_periods"], Lookback(as_of, lookback_days), workspace_id)
    return failures.exec_rollup(runs)


def cost_summary(t: Tables, as_of: datetime, lookback_days: int = 30, space_ids: str | Sequence[str] = ()) -> DataFrame:
    """Per warehouse: bill, configuration and the share of some spaces; ids as a list or separated by commas."""
    spaces = cost.split_ids(space_ids) if isinstance(space_ids, str) else list(space_ids)
    window = Lookback(as_of, lookback_days)
    return cost.warehouse_summary(t["query_history"], t["usage"], t["prices"], t["warehouses"], window, spaces)


OPERATORS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (failure_matrix, failure_reach, cost_summary)}


def _own(operator: Callable[..., DataFrame], values: Mapping[str, Any]) -> dict[str, Any]:
    """The arguments of an operator among the named values."""
    parameters = list(inspect.signature(operator).parameters.values())[1:]
    missing = [p.name for p in parameters if p.default is p.empty and p.name not in values]
    if missing:
        raise ValueError(f"{operator.__name__} needs {', '.join(missing)}")
    return {p.name: values[p.name] for p in parameters if p.name in values}


def run(spark: SparkSession, tables: Tables, text: str, **values: Any) -> DataFrame:
    """The rows of a SQL text over operators in braces, tables by their own names in braces, and ``:markers``."""
    names = {name for _, name, _, _ in Formatter().parse(text) if name}
    unknown = names - OPERATORS.keys() - tables.keys()
    if unknown:
        raise ValueError(f"no operator or table: {', '.join(sorted(unknown))}")
    frames = {n: OPERATORS[n](tables, **_own(OPERATORS[n], values)) if n in OPERATORS else tables[n] for n in names}
    markers = {n: list(v) if isinstance(v, (tuple, set)) else v for n, v in values.items() if v is not None}
    return spark.sql(text, args=markers, **frames)
