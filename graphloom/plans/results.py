"""Small results on the driver: columns, maps and single values of a query's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ResultError(ValueError):
    """A result that isn't as asked for."""


def column_values(df: DataFrame, column: str, most: int = 1_000_000) -> list:
    """The values of a column, of a result of at most so many rows."""
    return [r[column] for r in _few(df.select(column), most)]


def map_by(df: DataFrame, key: str, most: int = 1_000_000) -> dict:
    """Rows by the values of a column; a value that comes twice is an error."""
    out: dict = {}
    for r in _few(df, most):
        if r[key] in out:
            raise ResultError(f"{key} has {r[key]!r} twice")
        out[r[key]] = r
    return out


def scalar(df: DataFrame, column: str | None = None):
    """The value of the only row; None where there is none or more than one."""
    if column is None and len(df.columns) != 1:
        raise ResultError(f"{len(df.columns)} columns, not one")
    rows = df.limit(2).collect()
    return rows[0][column or df.columns[0]] if len(rows) == 1 else None


def amount(df: DataFrame, column: str = "amount") -> int:
    """The only row's number, 0 where there is none."""
    value = scalar(df, column)
    value = value["value"] if hasattr(value, "asDict") else value
    return 0 if value is None else int(value)


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ResultError(f"more than {most} rows")
    return rows
