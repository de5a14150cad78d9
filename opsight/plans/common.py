"""What every registered query needs: tables, the as-of instant, and oracle SQL assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsight.functions.columns import settled
from opsight.sources.logical import LOGICAL
from opsight.sources.tables import Tables, used_tables
from opsight.windows import Lookback

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "(select max(ts) from events)"
MIDNIGHT = f"date_trunc('day', {AS_OF})"


class Inputs(Tables):
    def window(self, days: int) -> Lookback:
        return Lookback(self.as_of(), days)


def query(build: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, folder: build(Inputs(spark, folder))


def logical_cte(name: str) -> str:
    text = LOGICAL[name]
    return f"{name} as ({text.format(**{t: t for t in used_tables(text)}).strip()})"


def settle_rounds(sql: str) -> str:
    """Let every ``round(x, n)`` round a decimal: DuckDB rounds a double by its binary value,
    so that 2.675 becomes 2.67."""
    out, rest = "", sql
    while (at := rest.find("round(")) >= 0:
        depth, cut = 1, None
        for i in range(at + 6, len(rest)):
            depth += {"(": 1, ")": -1}.get(rest[i], 0)
            if depth == 1 and rest[i] == ",":
                cut = i
            if depth == 0:
                break
        inner = settle_rounds(rest[at + 6 : cut])
        digits = int(rest[cut + 1 : i])
        out += rest[:at] + f"cast(round(cast({inner} as decimal(38, 9)), {digits}) as double)"
        rest = rest[i + 1 :]
    return out + rest


def oracle(logical: str, *steps: str, recursive: bool = False) -> str:
    """``WITH`` the named logical tables, then the given CTE steps; the last is the SELECT."""
    ctes = [logical_cte(n) for n in logical.split()] + list(steps[:-1])
    head = ("with recursive " if recursive else "with ") + ",\n".join(ctes) + "\n" if ctes else ""
    return settle_rounds(head + steps[-1])


def round_raw(queries: dict[str, Query], oracles: dict[str, str], columns: dict[str, str]) -> None:
    """Compare unrounded double columns at six decimals on both sides."""

    def wrap(inner: Query, names: list[str]) -> Query:
        return lambda spark, folder: inner(spark, folder).withColumns({n: settled(n, 6) for n in names})

    for name, text in columns.items():
        names = text.split()
        queries[name] = wrap(queries[name], names)
        if name in oracles:
            shown = settle_rounds(", ".join(f"round({n}, 6) as {n}" for n in names))
            oracles[name] = f"select * replace ({shown}) from ({oracles[name]}) q"
