"""Ordered rule lists compiled to one CASE expression (whole-stage codegen, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The output of the first rule whose predicate holds."""
    chain = None
    for predicate, output in rules:
        value = output if isinstance(output, Column) else F.lit(output)
        chain = F.when(predicate, value) if chain is None else chain.when(predicate, value)
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return chain.otherwise(fallback)


def by_value(col: Column, table: dict[str, object], otherwise: object = None) -> Column:
    """Simple CASE: look ``col`` up in a small fixed table."""
    return first_match([(col == key, value) for key, value in table.items()], otherwise)


def fired(parts: Sequence[tuple[Column, object]], sep: str) -> Column:
    """Join the texts of every rule that holds, in order; the rest are skipped."""
    texts = [F.when(p, t if isinstance(t, Column) else F.lit(t)) for p, t in parts]
    return F.concat_ws(sep, *texts)
