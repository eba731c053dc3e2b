"""Sizes of inputs from the catalog's statistics, so that planning a join runs no job.

``ANALYZE TABLE`` stores row counts and, per text column, the longest value; a write through Spark
drops or renews them, so they are never stale. Filters and projections only make a table smaller,
so its statistics bound them from above. Anything else is unknown here and must be measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Bytes of a row and of each column besides its values, as of measured sizes.
OVERHEAD = 16
NARROWING = ("Project", "Filter", "SubqueryAlias")


@dataclass
class Known:
    """Upper bounds from the catalog; ``None`` where it says nothing."""

    rows: int | None = None
    bytes: int | None = None


def known_size(df: DataFrame) -> Known:
    plan = df._jdf.queryExecution().optimizedPlan()
    output = plan.output()
    kept = [output.apply(i).exprId().id() for i in range(output.size())]
    while plan.getClass().getSimpleName() in NARROWING:
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or not plan.catalogTable().isDefined():
        return Known()
    stats = plan.catalogTable().get().stats()
    if not stats.isDefined() or not stats.get().rowCount().isDefined():
        return Known()
    rows = int(str(stats.get().rowCount().get()))
    columns = plan.output()
    names = {columns.apply(i).exprId().id(): columns.apply(i).name() for i in range(columns.size())}
    width = OVERHEAD
    for field, kept_id in zip(df.schema.fields, kept, strict=True):
        most = _most_bytes(field.dataType, stats.get().colStats(), names.get(kept_id))
        if most is None:
            return Known(rows)
        width += OVERHEAD + most
    return Known(rows, rows * width)


def _most_bytes(kind: T.DataType, column_stats, name: str | None) -> int | None:
    """The longest a value can be; texts need a measured length."""
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return 16
    if name is None or not isinstance(kind, (T.StringType, T.BinaryType)):
        return None
    found = column_stats.get(name)
    if not found.isDefined() or not found.get().maxLen().isDefined():
        return None
    return int(str(found.get().maxLen().get()))
