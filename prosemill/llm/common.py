"""What the training-data operators share: lineage cuts, checked broadcasts, row identity."""

from __future__ import annotations

import gc
import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a derived table may be broadcast.
BROADCAST_ROWS = 50_000
#: Rows a task of compact() reads, and its least number of tasks.
TASK_ROWS, TASKS = 50_000, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh local one only where that is unset (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="prosemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(df: DataFrame) -> None:
    """Removes what durable() kept for df; only for callers that know no one reads it any more."""
    spark = df.sparkSession
    kept = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if kept.isDefined():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.get())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def compact(df: DataFrame) -> DataFrame:
    """A durable table read by as many tasks as its counted rows need, so that rounds over few rows don't write a file for each of many partitions."""
    return df.coalesce(max(TASKS, math.ceil(df.count() / TASK_ROWS)))


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files and checkpoints that nothing refers to any more; for the end of a round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Paths of stored tables not yet released, in the order they were made.
_TABLES: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df computed once as compressed Parquet in the shared folder; for wide rows, whose columns are read apart. released() removes it."""
    spark = df.sparkSession
    from uuid import uuid4

    path = f"{shared_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.parquet(path)


def made() -> int:
    """How many stored tables there are; for released()."""
    return len(_TABLES)


def released(spark: SparkSession, since: int) -> None:
    """Removes the stored tables made after the first `since` ones, but the last; only for callers that know no one reads them any more, as a pipeline between its stages."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _TABLES[since:-1]
    del _TABLES[since:-1]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else as it is, for a shuffled join. Call on a durable table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def md5_unit(value: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 of the value as text."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def without_clash(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with the names an operator adds."""
    have = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in have])


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
