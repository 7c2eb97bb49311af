"""Runs compared: multiset difference of findings, counts before and after, files before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

KEY = ["path", "line", "column", "rule_id"]


def multiset_diff(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, status, n: how many of equal keys were removed, added or persisted, matched one to one; a key, however common, is summed before it meets."""
    c = count_diff(old, new, *key)
    both = F.least("n_old", "n_new")
    each = F.array(*[F.struct(F.lit(s).alias("status"), n.alias("n")) for s, n in (("persisted", both), ("removed", F.col("n_old") - both), ("added", F.col("n_new") - both))])
    return c.select(*key, F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("s")).select(*key, "s.status", "s.n")


def count_diff(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """by, n_old, n_new, delta: counts on either side; what only one side has counts 0 on the other."""
    a, b = (d.groupBy(*by).agg(F.count("*").alias(n)) for d, n in ((old, "n_old"), (new, "n_new")))
    j = a.join(b, list(by), "full_outer").fillna(0, ["n_old", "n_new"])
    return j.withColumn("delta", F.col("n_new") - F.col("n_old"))


def file_status(old: DataFrame, new: DataFrame, old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """path, n_old, n_new, status: new, old-only, improved, regressed or unchanged."""
    a, b = old_files.select("path").distinct().withColumn("was", F.lit(True)), new_files.select("path").distinct().withColumn("is", F.lit(True))
    files = a.join(b, "path", "full_outer").join(count_diff(old, new, "path"), "path", "left").fillna(0, ["n_old", "n_new", "delta"])
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "old-only").when(F.col("delta") < 0, "improved").when(F.col("delta") > 0, "regressed").otherwise("unchanged")
    return files.select("path", "n_old", "n_new", status.alias("status"))


def merge_intervals(df: DataFrame, *by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of each group joined."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_i", F.sum(F.when(F.col(start) <= reach, 0).otherwise(1)).over(w))
    return marked.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")
