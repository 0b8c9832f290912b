"""Evaluating expensive columns once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Add columns that no later filter re-evaluates.

    The optimizer moves a filter below the projection it reads from by repeating the projected
    expression in it; for a text scan that doubles the work, and chains of such columns multiply.
    A one-row generator is a step filters on its output do not pass, while filters on the other
    columns still move below it.
    """
    named = [F.expr(e).alias(c) if isinstance(e, str) else e.alias(c) for c, e in columns.items()]
    kept = [_quoted(c) for c in df.columns if c not in columns]
    made = df.select(*kept, F.inline_outer(F.array(F.struct(*named))))
    return made.select(*[_quoted(c) for c in dict.fromkeys([*df.columns, *columns])])


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"
