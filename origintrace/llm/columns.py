"""Names for added columns that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[str]:
    """The columns of ``df`` as references, whatever their names hold."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]
