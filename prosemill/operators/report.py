"""Findings to summaries, payloads, SARIF and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.catalogue import NAMESPACE, RULES, default_severity
from ..plans.config import RANK
from .lint import rank

VERSION = "0.1.0"


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(rank(F.col("severity")) >= RANK[severity])


def summarize(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: files, findings, by_rule, by_severity. Files without findings count; counts are taken a rule first, so that no task gets all findings."""
    counts = findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    maps = lambda c, name: counts.groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(name))
    files = docs.agg(F.count("*").alias("files"))
    one = files.crossJoin(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings")))  # single rows
    return one.crossJoin(maps("rule_id", "by_rule")).crossJoin(maps("severity", "by_severity"))


def counts_by(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.groupBy(*columns).agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent rules of each file, ties by name."""
    w = Window.partitionBy("path").orderBy(F.col("n").desc(), "rule_id")
    return counts_by(findings, "path", "rule_id").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def exit_status(findings: DataFrame, fail_on: str = "warning", max_findings: int | None = None) -> int:
    """0, or 1 if a finding is as severe as fail_on (off: none is) or there are more than max_findings."""
    n, worst = findings.agg(F.count("*"), F.max(rank(F.col("severity")))).first()
    return int(fail_on != "off" and (worst or 0) >= RANK[fail_on] or max_findings is not None and n > max_findings)


def _messages(findings: DataFrame) -> DataFrame:
    item = F.struct("index", F.col("rule_id").alias("ruleId"), "severity", "line", "column", "length", "message", "excerpt", "occurrences")
    return findings.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("messages"))


def file_payloads(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, json): a file's messages, by place and rule; a document's own findings meet in one row, those of the corpus don't."""
    rows = docs.select("path").distinct().join(_messages(findings), "path", "left")
    empty = F.array().cast(rows.schema["messages"].dataType)
    return rows.select("path", F.to_json(F.struct("path", F.coalesce("messages", empty).alias("messages"))).alias("json"))


def payload(findings: DataFrame, docs: DataFrame) -> str:
    """The report of a run on files, in one text. For corpora write file_payloads() instead."""
    import json

    files = [json.loads(r["json"]) for r in file_payloads(findings, docs).orderBy("path").toLocalIterator()]
    s = summarize(findings, docs).first()
    return json.dumps({"tool": NAMESPACE, "version": VERSION, "language": "ja", "files": files, "summary": {"files": s["files"], "findings": s["findings"], "byRule": s["by_rule"], "bySeverity": s["by_severity"]}}, ensure_ascii=False)


def level(severity: Column) -> Column:
    return F.when(severity == "info", "note").when(severity.isin("warning", "error"), severity).otherwise("warning")


def uri(path: Column) -> Column:
    return F.when(path == "<stdin>", "stdin").when(path.startswith("/"), F.concat(F.lit("file://"), path)).otherwise(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result a finding; occurrences are further locations."""
    region = lambda column, index, length: F.struct(F.col("line").alias("startLine"), column.alias("startColumn"), index.alias("charOffset"), length.alias("charLength"))
    place = lambda r: F.struct(F.struct(F.struct(uri(F.col("path")).alias("uri")).alias("artifactLocation"), r.alias("region")).alias("physicalLocation"))
    head = F.array(place(region(F.col("column"), F.col("index"), F.col("length"))))
    more = F.transform("occurrences", lambda o: place(region(o["column"], o["index"], o["length"])))
    return findings.select("path", "index", F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.concat(head, more).alias("locations"))


def sarif(findings: DataFrame) -> str:
    import json

    results = [json.loads(x["j"]) for x in sarif_results(findings).orderBy("path", "index", "ruleId").select(F.to_json(F.struct("ruleId", "level", "message", "locations")).alias("j")).toLocalIterator()]
    rules = [{"id": f"{NAMESPACE}/{r}", "name": r, "shortDescription": {"text": g}, "properties": {"severity": default_severity(r), "category": c}} for r, (c, _, g) in RULES.items()]
    run = {"tool": {"driver": {"name": NAMESPACE, "version": VERSION, "rules": rules}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, ensure_ascii=False)


def markdown_report(findings: DataFrame, docs: DataFrame, title: str = "Lint report", max_detail: int = 200) -> str:
    """Totals, counts by severity and rule, files with their most frequent rules, clean files, and findings with their excerpts; of files and findings max_detail each."""
    s = summarize(findings, docs).first()
    by = lambda m, key: sorted(m.items(), key=key)
    out = [f"# {title}", "", f"Files: {s['files']}. Findings: {s['findings']}.", "", "| severity | n |", "|---|---|"]
    out += [f"| {k} | {n} |" for k, n in by(s["by_severity"], lambda x: (-x[1], -RANK.get(x[0], 0)))]
    out += ["", "| rule | n |", "|---|---|", *[f"| {k} | {n} |" for k, n in by(s["by_rule"], lambda x: (-x[1], x[0]))], "", "| file | n | most frequent |", "|---|---|---|"]
    most = counts_by(findings, "path").orderBy(F.col("n").desc(), "path").limit(max_detail)
    top: dict[str, list[str]] = {}
    for r in top_rules(findings.join(F.broadcast(most.select("path")), "path", "left_semi")).orderBy("path", "place").collect():  # three rows a file at most
        top.setdefault(r["path"], []).append(f"{r['rule_id']} {r['n']}")
    out += [f"| {r['path']} | {r['n']} | {', '.join(top[r['path']])} |" for r in most.collect()]
    clean = docs.select("path").distinct().join(findings.select("path").distinct(), "path", "left_anti")
    n = clean.count()
    out += ["", f"Files without findings: {n}.", *[f"- {r['path']}" for r in clean.orderBy("path").limit(max_detail).collect()]]
    out += ["", "## Findings", ""]
    for r in findings.orderBy("path", "index", "rule_id").limit(max_detail).collect():
        out += [f"- {r['path']}:{r['line']}:{r['column']} {r['severity']} {r['rule_id']}: {r['message']}", *([f"  > {r['excerpt']}"] if r["excerpt"] else [])]
    return "\n".join(out) + "\n"


def validate_sarif(spark, path: str, publish: bool = False) -> DataFrame:
    """(code, detail) of what is wrong with a SARIF file."""
    schema = "version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,charOffset:int,charLength:int>>>>>>>>"
    log = spark.read.schema(schema).json(path, multiLine=True)
    runs = log.select("version", F.explode_outer("runs").alias("run"))
    results = runs.select(F.col("run.tool.driver.rules.id").alias("known"), F.explode("run.results").alias("r"))
    places = results.select("r.ruleId", F.explode("r.locations.physicalLocation").alias("p"))
    errors = [
        log.filter(~F.col("version").eqNullSafe(F.lit("2.1.0"))).select(F.lit("version").alias("code"), F.coalesce("version", F.lit("")).alias("detail")),
        runs.filter(F.col("run").isNull()).select(F.lit("runs"), F.lit("none")),
        runs.filter("run is not null and run.tool.driver.name is null").select(F.lit("driver-name"), F.lit("none")),
        results.filter("r.ruleId is null or r.message.text is null or r.message.text = ''").select(F.lit("result"), F.coalesce("r.ruleId", F.lit(""))),
        results.filter(~F.coalesce(F.array_contains("known", F.col("r.ruleId")), F.lit(False))).select(F.lit("unknown-rule"), F.coalesce("r.ruleId", F.lit(""))),
        results.filter(~F.coalesce(F.col("r.level"), F.lit("")).isin("none", "note", "warning", "error")).select(F.lit("level"), F.coalesce("r.level", F.lit(""))),
        results.filter("coalesce(size(r.locations), 0) < 1").select(F.lit("locations"), F.coalesce("r.ruleId", F.lit(""))),
        places.filter("coalesce(p.region.startLine, 0) < 1 or coalesce(p.region.startColumn, 0) < 1").select(F.lit("region"), F.coalesce("ruleId", F.lit(""))),
        places.filter("p.artifactLocation.uri is null or p.artifactLocation.uri = ''").select(F.lit("uri"), F.coalesce("ruleId", F.lit(""))),
    ]
    if publish:
        errors.append(places.filter(F.col("p.artifactLocation.uri").rlike(r"^(?:file:|/|[A-Za-z]:\\|\.\./)")).select(F.lit("uri-not-relative"), F.col("p.artifactLocation.uri")))
    out = errors[0]
    for e in errors[1:]:
        out = out.union(e)
    return out
