"""Names of columns: some that are not taken, and any as it is; values computed once; rows spread over tasks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with as many underscores before each as tell them from all columns, however these write capitals."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, use) -> Column:
    """What use makes of a value that is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """rows in four parts for each core: a table that is small in bytes is read by few tasks, however much is made of each row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *columns)
