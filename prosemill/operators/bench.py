"""Runs of several corpora under several profiles: findings and times, kept as snapshots, and two such runs compared."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import PROFILE_CONFIGS, PROFILES
from .diff import count_diff
from .lint import lint

TIMES = "corpus string, profile string, elapsed_ms double"


def bench(corpora: dict[str, DataFrame], profiles: tuple[str, ...] | list[str] = PROFILES) -> tuple[DataFrame, DataFrame]:
    """(counts, times) of every corpus under every profile: corpus, profile, rule_id, n; and corpus, profile, elapsed_ms. A corpus: path, text.

    The findings of a corpus under a profile are summed where they are found; the driver gets a row for each rule."""
    rows, times = [], []
    for name, docs in corpora.items():
        for p in profiles:
            began = time.perf_counter()
            rows += [(name, p, r["rule_id"], r["n"]) for r in lint(docs, PROFILE_CONFIGS[p]).groupBy("rule_id").agg(F.count("*").alias("n")).collect()]
            times.append((name, p, (time.perf_counter() - began) * 1000))
    spark = next(iter(corpora.values())).sparkSession
    return spark.createDataFrame(rows, "corpus string, profile string, rule_id string, n long"), spark.createDataFrame(times, TIMES)


def bench_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """profile, rule_id, n_old, n_new, delta of two tables of counts, where they differ; a profile that only one side has is left out (see bench_profiles)."""
    sums = lambda d, n: d.groupBy("profile", "rule_id").agg(F.sum("n").alias(n))
    both = old.select("profile").distinct().join(new.select("profile").distinct(), "profile")
    j = sums(old, "n_old").join(sums(new, "n_new"), ["profile", "rule_id"], "full_outer").fillna(0, ["n_old", "n_new"])
    return j.withColumn("delta", F.col("n_new") - F.col("n_old")).filter("delta != 0").join(both, "profile", "left_semi")


def bench_profiles(old: DataFrame, new: DataFrame, old_times: DataFrame, new_times: DataFrame) -> DataFrame:
    """A row for each profile of either side: findings, their difference, times, their difference, and status (added, removed or both)."""
    side = lambda counts, times, s: times.groupBy("profile").agg(F.sum("elapsed_ms").alias(f"ms_{s}")).join(counts.groupBy("profile").agg(F.sum("n").alias(f"n_{s}")), "profile", "left")
    j = side(old, old_times, "old").join(side(new, new_times, "new"), "profile", "full_outer")
    status = F.when(F.col("ms_old").isNull(), "added").when(F.col("ms_new").isNull(), "removed").otherwise("both")
    j = j.withColumn("status", status).fillna(0, ["n_old", "n_new", "ms_old", "ms_new"])
    return j.select("profile", "n_old", "n_new", (F.col("n_new") - F.col("n_old")).alias("delta"), "ms_old", "ms_new", (F.col("ms_new") - F.col("ms_old")).alias("delta_ms"), "status")


def diff_markdown(profiles: DataFrame, rules: DataFrame, title: str = "Comparison") -> str:
    """bench_profiles and bench_diff as text, rules by the size of their difference. Both have a row a profile or rule, so they are collected."""
    out = [f"# {title}", "", "| profile | before | after | difference | ms before | ms after | difference |", "|---|---:|---:|---:|---:|---:|---:|"]
    rows = profiles.orderBy("profile").collect()
    out += [f"| {r['profile']} | {r['n_old']} | {r['n_new']} | {r['delta']:+d} | {r['ms_old']:.2f} | {r['ms_new']:.2f} | {r['delta_ms']:+.2f} |" for r in rows]
    by: dict[str, list] = {}
    for r in rules.orderBy(F.abs("delta").desc(), "rule_id").collect():
        by.setdefault(r["profile"], []).append(r)
    for r in rows:
        out += ["", f"## {r['profile']}", ""]
        if r["status"] != "both":
            out.append("Only after." if r["status"] == "added" else "Only before.")
        elif r["profile"] not in by:
            out.append("No rule differs.")
        else:
            out += ["| rule | before | after | difference |", "|---|---:|---:|---:|", *[f"| {x['rule_id']} | {x['n_old']} | {x['n_new']} | {x['delta']:+d} |" for x in by[r["profile"]]]]
    return "\n".join(out) + "\n"


def snapshot(findings: DataFrame, docs: DataFrame, path: str, name: str) -> None:
    """Counts by file, rule and severity appended to a table of snapshots, files without findings with a null rule; name: the snapshot's."""
    counts = findings.groupBy("path", "rule_id", "severity").agg(F.count("*").alias("n"))
    docs.select("path").distinct().join(counts, "path", "left").fillna(0, ["n"]).withColumns({"snapshot": F.lit(name), "taken": F.current_timestamp()}).write.mode("append").partitionBy("snapshot").parquet(path)


def snapshot_diff(snapshots: DataFrame, old: str, new: str) -> DataFrame:
    """path, rule_id, n_old, n_new, delta between two snapshots of a table."""
    rows = lambda s: snapshots.filter((F.col("snapshot") == s) & F.col("rule_id").isNotNull()).select("path", "rule_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return count_diff(rows(old), rows(new), "path", "rule_id").filter("delta != 0")


def selected(rows: DataFrame, ids: list[str], column: str = "id") -> DataFrame:
    """The rows with these ids, all rows without ids. An id that no row has is an error."""
    if not ids:
        return rows
    out = rows.filter(F.col(column).isin(*ids))
    missing = sorted(set(ids) - {r[0] for r in out.select(column).distinct().collect()})
    if missing:
        raise ValueError(f"unknown {column}: {', '.join(missing)}")
    return out
