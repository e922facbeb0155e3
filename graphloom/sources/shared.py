"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder.

    In local mode, where driver and executors are one process, a folder of our own stands in where both are unset; it goes
    when Python ends. On a cluster such a folder would be another one on each machine, so there it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "state") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


#: Rows that a task of a step with a join or an aggregation gets, where the step deals its rows out itself.
ROWS_A_TASK = 100_000


def tasks_of(rows: int) -> int:
    """Partitions for a step over so many rows. Partitions of a given number are not put together by their compressed bytes, so a
    task's memory doesn't grow with the table."""
    return max(1, -(-rows // ROWS_A_TASK))


def tasks_for(table: DataFrame) -> int:
    """Partitions for a step over a table that cut() has written, by its rows, which are in the files' footers."""
    return tasks_of(table.count())


def in_order(table: DataFrame) -> DataFrame:
    """A table that cut() has written as one partition, which streams over its files in the order of the tasks that wrote them."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    # names are part-<task>-<id>-c<file of the task>; the number of the task may outgrow its five digits
    files = sorted((x for x in (f.getPath().toString() for f in found) if "/part-" in x), key=lambda x: (int(x.rsplit("/part-", 1)[1].split("-")[0]), x))
    return reduce(DataFrame.unionAll, [spark.read.schema(table.schema).parquet(x) for x in files]).coalesce(1)


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() has written and that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
