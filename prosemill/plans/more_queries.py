"""Queries of whole runs over the derived corpus, with DuckDB SQL composed of the rules' SQL: all profiles, reports, configuration, evaluation and audits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, bench, diff, evaluate, report
from ..operators.lint import lint
from .cases import CASES
from .catalogue import NAMESPACE, PROFILE_CONFIGS, PROFILES, RULES, default_options, default_severity
from .config import MERGE_DISTANCE, merge, rule_settings
from .queries import _HITS, _hits, _sql_text, corpus, rule_sql

N = len(CASES)


# Runs of all rules of a configuration.
def run_sql(config: dict) -> str:
    """All findings of a configuration on the derived corpus: path, rule_id, severity, line, column, index, length."""
    parts = []
    for rule, (severity, options) in rule_settings(config).items():
        own = f"CASE WHEN severity = 'error' THEN 'error' ELSE '{severity}' END" if rule == "long-sentence" else f"'{severity}'"
        sql = rule_sql({rule: options})[rule]
        parts.append(f"""SELECT path, '{NAMESPACE}/{rule}' AS rule_id, {own} AS severity, line, "column", "index", length FROM ({sql})""")
    return " UNION ALL ".join(parts)


def lint_profile(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lint(corpus(spark, sf_dir), PROFILE_CONFIGS[name]).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))

    return run


def counts_sql(config: dict) -> str:
    return f"SELECT rule_id, severity, count(*) AS n FROM ({run_sql(config)}) GROUP BY 1, 2"


def lint_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint(corpus(spark, sf_dir), PROFILE_CONFIGS["strict"] | {"collapseOccurrences": True})
    return found.select("path", "rule_id", "severity", "line", "column", F.size("occurrences").alias("n_more"))


_COLLAPSED = f"""WITH f AS ({run_sql(PROFILE_CONFIGS["strict"])}), g AS (SELECT *, CASE WHEN abs("column" - lag("column") OVER w) > {MERGE_DISTANCE} THEN 1 ELSE 0 END AS b FROM f WINDOW w AS (PARTITION BY path, rule_id, line ORDER BY "index", length)),
s AS (SELECT *, sum(b) OVER (PARTITION BY path, rule_id, line ORDER BY "index", length ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT path, rule_id, CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END AS severity, line, first("column" ORDER BY "index", length) AS "column", (count(*) - 1)::INTEGER AS n_more FROM s GROUP BY path, rule_id, line, k"""


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(lint(corpus(spark, sf_dir), PROFILE_CONFIGS["general"])).select("path", "ruleId", "level", F.to_json("locations").alias("locations"))


_SARIF = f"""SELECT path, rule_id AS "ruleId", CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, '[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":' || line || ',"startColumn":' || "column" || ',"charOffset":'
  || "index" || ',"charLength":' || length || '}}}}}}]' AS locations FROM ({run_sql(PROFILE_CONFIGS["general"])})"""


def file_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages in each file's JSON: how many, and their rules and places in the order of the report."""
    docs = corpus(spark, sf_dir)
    json_ = report.file_payloads(lint(docs, PROFILE_CONFIGS["minimal"]), docs)
    m = F.from_json("json", "messages array<struct<ruleId:string,severity:string,index:int>>")["messages"]
    return json_.select("path", F.size(m).alias("n"), F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["index"].cast("string"), x["ruleId"], x["severity"])), ",").alias("messages"))


_PAYLOADS = f"""WITH f AS ({run_sql(PROFILE_CONFIGS["minimal"])}), d AS (SELECT DISTINCT doc_id::VARCHAR AS path FROM documents)
SELECT d.path, count(f.path)::INTEGER AS n, coalesce(string_agg("index" || ':' || rule_id || ':' || severity, ',' ORDER BY "index", rule_id, severity), '') AS messages FROM d LEFT JOIN f USING (path) GROUP BY 1"""


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, findings and the counts by severity and rule of a run, warnings and worse, as text."""
    docs = corpus(spark, sf_dir)
    s = report.summarize(report.at_least(lint(docs, PROFILE_CONFIGS["business"]), "warning"), docs)
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return s.select("files", "findings", flat("by_severity"), flat("by_rule"))


_SUMMARY = f"""WITH f AS (SELECT * FROM ({run_sql(PROFILE_CONFIGS["business"])}) WHERE severity <> 'info'), r AS (SELECT rule_id, count(*) AS n FROM f GROUP BY 1), s AS (SELECT severity, count(*) AS n FROM f GROUP BY 1)
SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM f) AS findings, (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM s) AS by_severity, (SELECT string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) FROM r) AS by_rule"""

# Configuration: overlays, allowed terms, ignored lines.
OVERLAY = {"rules": {f"{NAMESPACE}/list-intro-padding": False, "placeholder": "warning", f"{NAMESPACE}/buzzword-density": ["info", {"maxPerParagraph": 2}], f"{NAMESPACE}/empty-conclusion": {"severity": "error", "options": {"patterns": ["一助となる"]}}}}
ALLOWED = {"allowTerms": [{"term": "必ず成功する", "rules": [f"{NAMESPACE}/absolute-claim"], "reason": "題名として使う語"}, {"term": "近年", "rules": [f"{NAMESPACE}/citation-needed"], "reason": "前書きとして使う語"}]}
IGNORED = {"ignorePatterns": [{"pattern": "^水の使い方", "scope": "line", "reason": "引いた文として残す"}, {"pattern": "^★", "scope": "line", "reason": "飾りの行として残す"}]}


def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint(corpus(spark, sf_dir), merge(PROFILE_CONFIGS["general"], OVERLAY)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


_AFTER_OVERLAY = {r: s for r, s in rule_settings(PROFILE_CONFIGS["general"]).items() if r != "list-intro-padding"}
_AFTER_OVERLAY["placeholder"] = ("warning", _AFTER_OVERLAY["placeholder"][1])
_AFTER_OVERLAY["buzzword-density"] = ("info", _AFTER_OVERLAY["buzzword-density"][1] | {"maxPerParagraph": 2})
_AFTER_OVERLAY["empty-conclusion"] = ("error", {"patterns": ["一助となる"]})
_OVERLAY = "SELECT rule_id, severity, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{NAMESPACE}/{r}' AS rule_id, {'CASE WHEN severity = ' + chr(39) + 'error' + chr(39) + ' THEN severity ELSE ' + chr(39) + s + chr(39) + ' END' if r == 'long-sentence' else chr(39) + s + chr(39)} AS severity FROM ({rule_sql({r: o})[r]})" for r, (s, o) in _AFTER_OVERLAY.items()) + ") GROUP BY 1, 2"


def _some(*rules: str) -> dict:
    return {"rules": {f"{NAMESPACE}/{r}": default_severity(r) if r in rules else False for r in RULES}}


def allowed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings within allowed terms are left out; others of the same rule stay."""
    found = lint(corpus(spark, sf_dir), _some("absolute-claim", "citation-needed") | ALLOWED)
    return found.select("path", "rule_id", "index")


_ALLOWED = f"""SELECT path, '{NAMESPACE}/absolute-claim' AS rule_id, "index" FROM ({rule_sql()["absolute-claim"]}) WHERE length = 3"""


def ignored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an ignore pattern matches are masked for all rules."""
    found = lint(corpus(spark, sf_dir), _some("weasel-phrases", "headline-decoration", "citation-needed", "hidden-unicode-controls") | IGNORED)
    return found.select("path", "rule_id", "index")


_IGNORED = " UNION ALL ".join(f"""SELECT path, '{NAMESPACE}/{r}' AS rule_id, "index" FROM ({rule_sql()[r]})""" for r in ("citation-needed", "hidden-unicode-controls"))


# Cases: each document is a case and its own text; what the case's rule finds is in the list.
def case_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, k): a case before each document's whole text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.pmod(F.col("doc_id"), F.lit(N)).cast("int")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.get(F.array(*[F.lit(t) for _, t, _ in CASES]), k), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"), k.alias("k"))


def _own(found: DataFrame) -> DataFrame:
    """Findings by the case's own rule."""
    rules = F.array(*[F.lit(f"{NAMESPACE}/{r}") for r, _, _ in CASES])
    return found.filter(F.col("rule_id") == F.get(rules, F.pmod(F.col("path").cast("long"), F.lit(N)).cast("int")))


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(lint(case_corpus(spark, sf_dir))).select("path", "rule_id", "line", "index", "length")


_CASE_ROWS = f"k(k, rule_id, body) AS (VALUES {', '.join(f'({i}, {_sql_text(NAMESPACE + chr(47) + r)}, {_sql_text(t)})' for i, (r, t, _) in enumerate(CASES))}), w(k, passage) AS (VALUES {', '.join(f'({i}, {_sql_text(p)})' for i, (_, _, ps) in enumerate(CASES) for p in ps)})"
_CASES = f"""WITH {_CASE_ROWS}, h AS (SELECT doc_id::VARCHAR AS path, rule_id, body, passage, strpos(body, passage) - 1 AS ofs FROM documents JOIN k ON k.k = doc_id % {N} JOIN w ON w.k = k.k)
SELECT path, rule_id, (length(substr(body, 1, ofs)) - length(replace(substr(body, 1, ofs), chr(10), '')) + 1)::INTEGER AS line, ofs::INTEGER AS "index", least(length(passage), 80)::INTEGER AS length FROM h"""


# Evaluation: the cases as a goldset, every fifth document with the wrong expectation.
def goldset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = case_corpus(spark, sf_dir)
    at = lambda xs: F.get(F.array(*xs), F.col("k"))
    rule, n = at([F.lit(r) for r, _, _ in CASES]), at([F.lit(len(p)) for _, _, p in CASES])
    wrong = F.col("path").cast("long") % 5 == 0
    hit = (n > 0) != wrong
    excerpts = at([F.array(*[F.struct(F.lit(f"{NAMESPACE}/{r}").alias("ruleId"), F.lit(x[:20]).alias("excerpt")) for x in p]).cast("array<struct<ruleId:string,excerpt:string>>") if p else F.array().cast("array<struct<ruleId:string,excerpt:string>>") for r, _, p in CASES])
    none = F.lit(None)
    finding = F.transform(excerpts, lambda e: F.struct(e["ruleId"].alias("ruleId"), none.cast("string").alias("rule"), none.cast("int").alias("line"), none.cast("int").alias("column"), e["excerpt"].alias("excerpt"), none.cast("string").alias("messageIncludes")))
    by = "map<string,array<string>>"
    return c.select(
        F.col("path").alias("id"), none.cast("string").alias("profile"), "text", F.when(hit, F.array(rule)).otherwise(F.array().cast("array<string>")).alias("expectedRules"), none.cast("array<string>").alias("expected"), none.cast(by).alias("expectedByProfile"),
        F.create_map(rule, n + wrong.cast("int")).alias("expectedCounts"), none.cast("map<string,map<string,int>>").alias("expectedCountsByProfile"), finding.alias("expectedFindings"), none.cast(f"map<string,{evaluate._FINDING}>").alias("expectedFindingsByProfile"))


def _evaluated(spark: SparkSession, sf_dir: str, without_findings: bool = False) -> dict[str, DataFrame]:
    gold = goldset(spark, sf_dir)
    if without_findings:
        gold = gold.withColumn("expectedFindings", F.lit(None).cast(evaluate._FINDING))
    return evaluate.evaluate(gold, _own(evaluate.predicted(gold)))


def goldset_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, True)["by_rule"]


def goldset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)["counts"].select("path", "rule_id", "expected", F.col("predicted").cast("int").alias("predicted"), F.col("matched").cast("int").alias("matched"), F.col("excess").cast("int").alias("excess"), F.col("shortfall").cast("int").alias("shortfall"))


def goldset_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)["findings"].select("path", "expected", "predicted", "matched", "missed", "unexpected")


_GOLD = f"{_CASE_ROWS}, g AS (SELECT doc_id, k.k, rule_id, (SELECT count(*) FROM w WHERE w.k = k.k) AS n, doc_id % 5 = 0 AS wrong FROM documents JOIN k ON k.k = doc_id % {N})"
_GOLD_SQL = {
    "goldset_by_rule": f"""WITH {_GOLD}, r AS (SELECT rule_id, sum((n > 0 AND NOT wrong)::INT)::BIGINT AS tp, sum((n > 0 AND wrong)::INT)::BIGINT AS fp, sum((n = 0 AND wrong)::INT)::BIGINT AS fn FROM g WHERE n > 0 OR wrong GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1 FROM r""",
    "goldset_counts": f"WITH {_GOLD} SELECT doc_id::VARCHAR AS path, rule_id, (n + wrong::INT)::INTEGER AS expected, n::INTEGER AS predicted, n::INTEGER AS matched, 0::INTEGER AS excess, wrong::INTEGER AS shortfall FROM g",
    "goldset_findings": f"WITH {_GOLD} SELECT doc_id::VARCHAR AS path, n::INTEGER AS expected, n::INTEGER AS predicted, n::INTEGER AS matched, 0::INTEGER AS missed, 0::INTEGER AS unexpected FROM g WHERE n > 0",
}


def goldset_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies of review notes, by status and decision."""
    d = spark.read.parquet(f"{sf_dir}/labels.parquet")
    status = F.when(F.col("toxic") == 1, "FP").when(F.col("quality") == 0, "boundary").otherwise("TP")
    gold = d.select(F.when(F.col("doc_id") % 3 != 0, F.struct(status.alias("status"), F.when(F.col("quality") == 1, "keep").alias("decision"))).alias("review"))
    return evaluate.review_counts(gold)


_REVIEWS = """SELECT CASE WHEN toxic = 1 THEN 'FP' WHEN quality = 0 THEN 'boundary' ELSE 'TP' END AS status, CASE WHEN quality = 1 THEN 'keep' END AS decision, count(*) AS n FROM labels WHERE doc_id % 3 <> 0 GROUP BY 1, 2"""


def goldset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far expectations by profile reach: general for every second record, strict for every third, empty for every fourth."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    some = lambda kind, full, empty: F.map_filter(F.create_map(F.lit("general"), F.when(F.col("doc_id") % 2 == 0, full), F.lit("strict"), F.when(F.col("doc_id") % 3 == 0, full), F.lit("web"), F.when(F.col("doc_id") % 4 == 0, empty)).cast(kind), lambda _, v: v.isNotNull())
    rules = some("map<string,array<string>>", F.array(F.lit("placeholder")), F.array().cast("array<string>"))
    return evaluate.coverage(d.select(rules.alias("expectedByProfile"), F.lit(None).cast("map<string,map<string,int>>").alias("expectedCountsByProfile"), F.lit(None).cast(f"map<string,{evaluate._FINDING}>").alias("expectedFindingsByProfile")))


_STATES = " ".join(f"WHEN p = '{p}' THEN CASE WHEN doc_id % {m} = 0 THEN '{s}' ELSE 'missing' END" for p, m, s in (("general", 2, "nonEmpty"), ("strict", 3, "nonEmpty"), ("web", 4, "empty")))
_COVERAGE = f"""SELECT f AS field, p AS profile, CASE WHEN f <> 'expectedByProfile' THEN 'missing' {_STATES} ELSE 'missing' END AS state, count(*) AS records
FROM documents, (SELECT unnest({list(PROFILES)}) AS p), (SELECT unnest(['expectedByProfile', 'expectedCountsByProfile', 'expectedFindingsByProfile']) AS f) GROUP BY 1, 2, 3"""


# Runs and files compared, audits.
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the first over documents but every fifth, the second but every seventh; findings at even places are old, at uneven ones new."""
    hits, d = _hits(spark, sf_dir), corpus(spark, sf_dir).select("path")
    was, now = F.col("path").cast("long") % 5 != 0, F.col("path").cast("long") % 7 != 0
    return diff.file_status(hits.filter((F.col("index") % 2 == 0) & was), hits.filter((F.col("index") % 2 == 1) & now), d.filter(was), d.filter(now))


_STATUS = f"""WITH {_HITS}, d AS (SELECT doc_id, doc_id::VARCHAR AS path FROM documents WHERE doc_id % 35 <> 0), n AS (SELECT d.path, doc_id % 5 <> 0 AS was, doc_id % 7 <> 0 AS now, count(*) FILTER ("index" % 2 = 0 AND doc_id % 5 <> 0) AS n_old, count(*) FILTER ("index" % 2 = 1 AND doc_id % 7 <> 0) AS n_new
FROM d LEFT JOIN f USING (path) GROUP BY 1, 2, 3) SELECT path, n_old, n_new, CASE WHEN NOT was THEN 'new' WHEN NOT now THEN 'old-only' WHEN n_new < n_old THEN 'improved' WHEN n_new > n_old THEN 'regressed' ELSE 'unchanged' END AS status FROM n"""


def bench_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a bench, made of the hits: even places before, uneven ones after, documents' lines as rules, languages as profiles."""
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("profile"))
    side = lambda k: _hits(spark, sf_dir).filter(F.col("index") % 2 == k).join(lang, "path").groupBy("profile", F.col("line").cast("string").alias("rule_id")).agg(F.count("*").alias("n"))
    return bench.bench_diff(side(0), side(1))


_BENCH = f"""WITH {_HITS}, r AS (SELECT lang AS profile, line::VARCHAR AS rule_id, count(*) FILTER ("index" % 2 = 0) AS n_old, count(*) FILTER ("index" % 2 = 1) AS n_new FROM f JOIN documents ON doc_id::VARCHAR = path GROUP BY 1, 2)
SELECT *, n_new - n_old AS delta FROM r WHERE n_new <> n_old AND profile IN (SELECT profile FROM r GROUP BY 1 HAVING sum(n_old) > 0 AND sum(n_new) > 0)"""


def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest made of the documents, with faults in every few records."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    each = lambda m, bad, good: F.when(F.col("doc_id") % m == 0, F.lit(bad)).otherwise(F.lit(good))
    text = {"origin": each(11, "found", "external-public"), "sourceName": F.lit("s"), "sourceUrl": each(13, "ftp://x", "https://x.org/a"), "license": F.lit("CC0"), "termsCheckedAt": each(17, "2024-02-30", "2024-02-29"), "purpose": each(19, " ", "p"), "validationRole": F.lit("r"), "storagePolicy": F.lit("none"), "profile": each(23, "general", "web"), "genre": F.lit("general"), "notes": F.lit("n")}
    rows = d.select(F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 29 == 0, F.lit("same")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("id"), *[v.alias(k) for k, v in text.items()],
        *[(F.col("doc_id") % 31 == 0 if c == "includeText" else F.lit(False)).alias(c) for c in audit.MANIFEST_FLAGS], F.when(F.col("doc_id") % 37 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("reviewFocus"), *[F.lit(None).cast("string").alias(c) for c in ("text", "body", "content", "html", "markdown", "corrupt")])
    return audit.manifest_issues(rows).select("line_no", "level", "code")


_FAULTS = [("error", "origin-value", "doc_id % 11 = 0"), ("error", "source-url", "doc_id % 13 = 0"), ("error", "terms-format", "doc_id % 17 = 0"), ("error", "required-field:purpose", "doc_id % 19 = 0"), ("warning", "profile-genre-identical", "doc_id % 23 = 0"), ("warning", "genre-profile-name", "doc_id % 23 <> 0"),
    ("error", "id-duplicate", "doc_id % 29 = 0 AND doc_id > (SELECT min(doc_id) FROM documents WHERE doc_id % 29 = 0)"), ("error", "external-public-no-body:includeText", "doc_id % 31 = 0 AND doc_id % 11 <> 0"), ("error", "review-focus-empty", "doc_id % 37 = 0")]
_MANIFEST = " UNION ALL ".join(f"SELECT doc_id AS line_no, '{level}' AS level, '{code}' AS code FROM documents WHERE {test}" for level, code, test in _FAULTS)


def package_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id")
    gold = d.select(n.alias("line_no"), n.cast("string").alias("id"), "text", F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, "rights-cleared").when(n % 4 == 2, "self-authored").otherwise("found").alias("origin"), F.when(n % 3 == 0, "note").alias("rightsNote"), F.when(n % 5 == 0, "local/x").otherwise("x").alias("sourceFile"))
    return audit.goldset_package_issues(gold, strict_source=True).select("line_no", "level", "code")


_PACKAGE = " UNION ALL ".join(f"SELECT doc_id AS line_no, '{level}' AS level, '{code}' AS code FROM documents WHERE {test}" for level, code, test in (
    ("warning", "origin-missing", "doc_id % 4 = 0"), ("error", "origin-value", "doc_id % 4 = 3"), ("error", "rights-note", "doc_id % 4 = 1 AND doc_id % 3 <> 0"), ("error", "local-source", "doc_id % 5 = 0"), ("error", "text-missing", "text IS NULL OR trim(text, ' ') = ''")))

QUERIES = {f"lint_{p.replace('-', '_')}": lint_profile(p) for p in PROFILES} | {
    f.__name__: f
    for f in (
        lint_collapsed, sarif_results, file_payloads, report_summary, config_overlay, allowed_terms, ignored_lines, rule_cases, goldset_by_rule, goldset_counts, goldset_findings, goldset_reviews, goldset_coverage, file_status, manifest_audit,
        package_audit, bench_diff,
    )
}
ORACLE: dict[str, str] = {f"lint_{p.replace('-', '_')}": counts_sql(PROFILE_CONFIGS[p]) for p in PROFILES} | _GOLD_SQL | {
    "lint_collapsed": _COLLAPSED, "sarif_results": _SARIF, "file_payloads": _PAYLOADS, "report_summary": _SUMMARY, "config_overlay": _OVERLAY, "allowed_terms": _ALLOWED, "ignored_lines": _IGNORED, "rule_cases": _CASES, "goldset_reviews": _REVIEWS,
    "goldset_coverage": _COVERAGE, "file_status": _STATUS, "manifest_audit": _MANIFEST, "package_audit": _PACKAGE, "bench_diff": _BENCH,
}
