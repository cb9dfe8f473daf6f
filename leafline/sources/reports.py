"""Writers of reports: one folder for each table, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(path: str, **tables: DataFrame) -> None:
    """Each table as JSON lines under ``path``/name."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def worst_as_markdown(worst: DataFrame) -> str:
    """A top-k table, small by its limit, as Markdown."""
    names = worst.columns
    rows = [f"| {' | '.join(str(v) for v in r)} |" for r in worst.toLocalIterator()]
    return "\n".join([f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *rows])
