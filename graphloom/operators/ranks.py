"""Places in a total order and pages of it, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import cut


def ranked(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df in order with its place from 0 on, as a table of the shared folder.

    The sort is parallel; a place is the size of the partitions before plus the place in its own, so the one window over all
    has a row a partition.
    """
    rows = cut(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "ranked")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_id").alias("_first"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    places = sizes.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(places), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.col("_first"))
    return placed.drop("_part", "_id", "_first", "_before")


def comparable(df: DataFrame) -> list[Column]:
    """All columns of df as a total order (maps by their text)."""
    return [F.to_json(c) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes]
