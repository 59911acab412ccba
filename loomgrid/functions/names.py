"""Column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its plain name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names."""
    return [named(c) for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until none is a column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
