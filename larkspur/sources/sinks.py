"""Where results go: files, with the refusal to cut an export short."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_ROWS = 25_000


class TooManyRows(ValueError):
    """An export has more rows than a reader can use; nothing was written."""


def export(rows: DataFrame, path: str, kind: str = "csv", most: int = MOST_ROWS) -> None:
    """Writes a search's rows; refuses, rather than truncates, beyond the limit.

    No more than one row over the limit is counted.
    """
    if rows.limit(most + 1).count() > most:
        raise TooManyRows(f"more than {most} rows")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def snapshot(rows: DataFrame, path: str, stamp: str) -> str:
    """A dated copy of a table."""
    rows.write.mode("overwrite").parquet(f"{path}/stamp={stamp}")
    return f"{path}/stamp={stamp}"


def snapshots_beyond(stamps: list[str], keep: int) -> list[str]:
    """Which dated copies a pruning to the newest ``keep`` removes."""
    return sorted(stamps, reverse=True)[keep:]
