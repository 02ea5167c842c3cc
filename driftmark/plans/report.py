"""Markdown and number formatting of small metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def percent(value: float | None, places: int = 1) -> str:
    """A rate as a percentage, n/a for none."""
    return "n/a" if value is None else f"{100 * value:.{places}f}%"


def cell(value: object) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def csv_cell(value: object) -> str:
    """A value as a CSV field."""
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of at most ``most`` rows; larger ones are no reports and raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]) + "\n"


def document(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A report with a section for each table or text."""
    body = [f"## {name}\n\n{x if isinstance(x, str) else markdown(x)}" for name, x in sections.items()]
    return f"# {title}\n\n" + "\n".join(body)
