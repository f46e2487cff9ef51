"""Shared plumbing: settled tables in the shared work folder, and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import discard, new_path, settle, work_folder

__all__ = ["bytes_of", "discard", "new_path", "settle", "slim", "steady", "work_folder"]

#: Rows of a few numbers up to which a table is broadcast to a join: 16 to 32 MB.
SLIM_ROWS = 1_000_000


def slim(rows: DataFrame) -> DataFrame:
    """A settled table of a few numbers a row, marked for broadcast if it has no more than SLIM_ROWS."""
    return F.broadcast(rows) if rows.count() <= SLIM_ROWS else rows


def bytes_of(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of a text column: one aggregate row."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def steady(df: DataFrame, tag: str = "steady") -> DataFrame:
    """df itself if it deals its rows the same way whenever it is run, as files do; settled where there is an exchange in
    it, after which a lost executor's rows may come back in another order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return settle(df, tag) if "Exchange" in plan else df
