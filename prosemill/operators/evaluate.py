"""Findings against a labelled goldset: precision, recall and F1 by rule, counts, one-to-one findings, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import NAMESPACE, PROFILE_CONFIGS, PROFILES, RULES
from .lint import lint

_FINDING = "array<struct<ruleId:string,rule:string,line:int,column:int,excerpt:string,messageIncludes:string>>"
GOLDSET = (
    "id string, profile string, text string, expectedRules array<string>, expected array<string>, expectedByProfile map<string,array<string>>, expectedCounts map<string,int>, "
    f"expectedCountsByProfile map<string,map<string,int>>, expectedFindings {_FINDING}, expectedFindingsByProfile map<string,{_FINDING}>, review struct<status:string,decision:string,reason:string>, domain string, category string, note string, origin string, sourceFile string, rightsNote string"
)
REVIEW = ("TP", "FP", "FN", "boundary", "defer", "keep")


def full_id(rule: Column) -> Column:
    return F.when(rule.startswith(f"{NAMESPACE}/"), rule).otherwise(F.concat(F.lit(f"{NAMESPACE}/"), rule))


def ratios(df: DataFrame) -> DataFrame:
    """df with tp, fp and fn, and precision, recall and f1 (0 where there is nothing to divide by)."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return df.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)})


def confusion(predicted: DataFrame, expected: DataFrame, *by: str, on: list[str]) -> DataFrame:
    """tp, fp, fn of two sets of (on) rows, by columns of on; micro figures without by."""
    a, b = predicted.select(*on).distinct().withColumn("p", F.lit(1)), expected.select(*on).distinct().withColumn("e", F.lit(1))
    j = a.join(b, on, "full_outer").fillna(0, ["p", "e"])
    return ratios(j.groupBy(*by).agg(F.sum(F.col("p") * F.col("e")).alias("tp"), F.sum(F.col("p") * (1 - F.col("e"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("e")).alias("fn")))


def predicted(gold: DataFrame, profile: str | None = None) -> DataFrame:
    """Findings of each record's text under its profile (or the one given): one lint plan a profile."""
    own = F.lit(profile) if profile else F.col("profile")
    rows = gold.select(F.col("id").alias("path"), "text", own.alias("profile"))
    have = {profile} if profile else {r["profile"] for r in rows.select("profile").distinct().collect()}  # as many as there are profiles
    parts = [lint(rows.filter(F.col("profile") == p), PROFILE_CONFIGS[p]) for p in PROFILES if p in have]
    if None in have or not parts:
        parts.append(lint(rows.filter(F.col("profile").isNull())))
    return reduce(DataFrame.unionByName, parts)


def _findings(c: Column) -> Column:
    return F.transform(c, lambda f: F.struct(full_id(F.coalesce(f["ruleId"], f["rule"])).alias("rule_id"), f["line"].alias("line"), f["column"].alias("column"), f["excerpt"].alias("excerpt"), f["messageIncludes"].alias("messageIncludes")))


def expectations(gold: DataFrame, profile: str | None = None) -> DataFrame:
    """Records with rules, counts and findings expected: those by profile first, then expectedRules, then expected; a finding's rule is expected too."""
    own = F.lit(profile) if profile else F.col("profile")
    findings = F.coalesce(F.try_element_at("expectedFindingsByProfile", own), F.col("expectedFindings"), F.array().cast(_FINDING))
    rules = F.coalesce(F.try_element_at("expectedByProfile", own), F.col("expectedRules"), F.col("expected"), F.array().cast("array<string>"))
    counts = F.coalesce(F.try_element_at("expectedCountsByProfile", own), F.col("expectedCounts"), F.create_map().cast("map<string,int>"))
    told = gold.select(F.col("id").alias("path"), F.coalesce(own, F.lit("<default>")).alias("profile"), F.transform(rules, full_id).alias("rules"), F.transform_keys(counts, lambda k, v: full_id(k)).alias("counts"), _findings(findings).alias("findings"))
    return told.withColumn("rules", F.array_union("rules", F.transform("findings", lambda f: f["rule_id"])))


def evaluate(gold: DataFrame, found: DataFrame, profile: str | None = None) -> dict[str, DataFrame]:
    """micro, by_rule and by_profile (rule sets), counts (expected, predicted, matched, excess, shortfall), findings (matched, missed, unexpected by record)."""
    spec = expectations(gold, profile)
    e = spec.select("path", "profile", F.explode("rules").alias("rule_id"))
    p = found.select("path", "rule_id").distinct().join(spec.select("path", "profile"), "path")
    on = ["path", "profile", "rule_id"]
    n = found.groupBy("path", "rule_id").agg(F.count("*").alias("predicted"))
    want = spec.select("path", "profile", F.explode("counts").alias("rule_id", "expected"))
    counts = want.join(n, ["path", "rule_id"], "left").fillna(0, ["predicted"]).withColumns({"matched": F.least("expected", "predicted"), "excess": F.greatest(F.col("predicted") - F.col("expected"), F.lit(0)), "shortfall": F.greatest(F.col("expected") - F.col("predicted"), F.lit(0))})
    return {"micro": confusion(p, e, on=on), "by_rule": confusion(p, e, "rule_id", on=on), "by_profile": confusion(p, e, "profile", on=on), "counts": counts, "findings": match_findings(spec, found)}


def match_findings(spec: DataFrame, found: DataFrame) -> DataFrame:
    """path, expected, predicted, matched, missed, unexpected: expected findings take the first unused finding that fits, in order; a fold over each record's own row."""
    item = F.struct("index", "rule_id", "line", "column", "excerpt", "message")
    own = found.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("all"))
    rows = spec.filter(F.size("findings") > 0).join(own, "path", "left").withColumn("all", F.coalesce("all", F.array().cast(own.schema["all"].dataType)))
    flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))

    def fits(m: Column, e: Column) -> Column:
        same = lambda a, b: b.isNull() | (a == b)
        return (m["rule_id"] == e["rule_id"]) & same(m["line"], e["line"]) & same(m["column"], e["column"]) & (e["excerpt"].isNull() | flat(m["excerpt"]).contains(flat(e["excerpt"]))) & (e["messageIncludes"].isNull() | m["message"].contains(e["messageIncludes"]))

    own_rules = F.filter("all", lambda m: F.exists("findings", lambda e: e["rule_id"] == m["rule_id"]))
    rows = rows.withColumn("pool", own_rules)
    first = F.struct(F.col("pool").alias("pool"), F.lit(0).alias("hits"))

    def step(a: Column, e: Column) -> Column:
        hit = F.array_min(F.transform(a["pool"], lambda m, i: F.when(fits(m, e), i)))
        return F.struct(F.when(hit.isNull(), a["pool"]).otherwise(F.filter(a["pool"], lambda m, i: i != hit)).alias("pool"), (a["hits"] + F.when(hit.isNull(), 0).otherwise(1)).alias("hits"))

    hits = F.aggregate("findings", first, step, lambda a: a["hits"])
    return rows.select("path", "profile", F.size("findings").alias("expected"), F.size("pool").alias("predicted"), hits.alias("matched")).withColumns({"missed": F.col("expected") - F.col("matched"), "unexpected": F.col("predicted") - F.col("matched")})


def goldset_errors(gold: DataFrame) -> DataFrame:
    """(line_no, id, code) of what is wrong in records read by read_jsonl(path, GOLDSET)."""
    bad = lambda code, test: F.when(test, F.lit(code))
    every = F.concat(F.coalesce("expectedFindings", F.array().cast(_FINDING)), F.flatten(F.coalesce(F.map_values("expectedFindingsByProfile"), F.array().cast(f"array<{_FINDING}>"))))
    names = F.concat(F.coalesce("expectedRules", F.array().cast("array<string>")), F.coalesce("expected", F.array().cast("array<string>")), F.flatten(F.coalesce(F.map_values("expectedByProfile"), F.array().cast("array<array<string>>"))))
    known = F.array(*[F.lit(f"{NAMESPACE}/{r}") for r in RULES])
    codes = F.array(
        bad("json", F.col("corrupt").isNotNull()), bad("text", F.col("text").isNull()), bad("profile", F.col("profile").isNotNull() & ~F.col("profile").isin(*PROFILES)), bad("rule", F.exists(names, lambda r: ~F.array_contains(known, full_id(r)))),
        bad("count", F.exists(F.coalesce(F.map_values("expectedCounts"), F.array().cast("array<int>")), lambda n: n.isNull() | (n < 0))), bad("finding-rule", F.exists(every, lambda f: f["ruleId"].isNull() & f["rule"].isNull())),
        bad("finding-text", F.exists(every, lambda f: f["excerpt"].isNull() & f["messageIncludes"].isNull())), bad("finding-place", F.exists(every, lambda f: (f["line"] < 1) | (f["column"] < 1))), bad("review", F.col("review").isNotNull() & ~F.coalesce(F.col("review.status").isin(*REVIEW), F.lit(False))),
    )
    return gold.select("line_no", "id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def review_counts(gold: DataFrame) -> DataFrame:
    return gold.filter("review is not null").groupBy("review.status", "review.decision").agg(F.count("*").alias("n"))


def coverage(gold: DataFrame) -> DataFrame:
    """field, profile, state (missing, empty, nonEmpty), records: how far the expectations by profile reach."""
    fields = {"expectedByProfile": "array<string>", "expectedCountsByProfile": "map<string,int>", "expectedFindingsByProfile": _FINDING}
    parts = []
    for f in fields:
        cell = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.try_element_at(F.col(f), F.lit(p)).alias("v")) for p in PROFILES])).alias("c")
        parts.append(gold.select(cell).select(F.lit(f).alias("field"), "c.profile", F.when(F.col("c.v").isNull(), "missing").when(F.size("c.v") == 0, "empty").otherwise("nonEmpty").alias("state")))
    return reduce(DataFrame.unionByName, parts).groupBy("field", "profile", "state").agg(F.count("*").alias("records"))
