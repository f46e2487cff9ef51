"""Row numbers in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..work import discard, settle


#: Rows up to which one task numbers them all.
FEW = 10_000


def numbered(rows: DataFrame, out: str, *order: Column | str, start: int = 1) -> DataFrame:
    """rows with `out`, their number in the order. The rows are settled once, so that they are made once; few of them are
    numbered by one task. More are range-partitioned and sorted, each partition numbering its own from where those before
    it end: only a count for each partition is looked at as a whole."""
    held = rows if getattr(rows, "tallstrip_path", None) else settle(rows, "rows")
    if held.count() <= FEW:
        return held.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))
    placed = settle(held.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    if held is not rows:
        discard(held)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(before), "_part").withColumn(out, (own + F.col("_before") - 1 + start).cast("long")).drop("_part", "_before")
