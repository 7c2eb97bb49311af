"""Documents to findings: preparation, rules, suppression, allowed terms, places, excerpts, collapsing.

One narrow stage: each document is prepared in one Arrow batch call, all rules run on its row as columns, and findings get their places there too, so that
only narrow rows are exploded, last.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsregex import WS
from ..functions.textops import FINDING, find_all, let, piece
from ..functions.jsregex import escape
from ..plans.catalogue import ALLOW_TERM_RULES, NAMESPACE
from ..plans.config import MERGE_DISTANCE, RANK, rule_settings, validate
from .context_rules import CONTEXT_RULES
from .markdown import Document
from .rules import COLUMN_RULES

_LINE_END = re.compile("\n")
_SENTENCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("raw_start", pa.int64()), ("raw_end", pa.int64()), ("text", pa.string()), ("block", pa.int32()), ("kind", pa.string()), ("section", pa.int32())])
_PARAGRAPH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("block", pa.int32()), ("sentence_count", pa.int32())])
_BLOCK = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("section", pa.int32())])
_RANGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string())])
_FOUND = pa.struct([("rule", pa.string()), ("index", pa.int64()), ("length", pa.int64()), ("message", pa.string())])
#: Length of the parts that redacted text comes in, so that an excerpt needs no walk from the start of a long text.
PART = 2048
_FIELDS = [("text", pa.string()), ("masked", pa.string()), ("redacted", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("sentences", pa.list_(_SENTENCE)), ("paragraphs", pa.list_(_PARAGRAPH)), ("blocks", pa.list_(_BLOCK)), ("ranges", pa.list_(_RANGE)), ("found", pa.list_(_FOUND))]


def prepare(docs: DataFrame, ignore_patterns: list[str] | None = None, context: dict[str, dict] | None = None, namespace: str = NAMESPACE) -> DataFrame:
    """(path, text) to prepared documents: masked text, redacted text in parts, starts of lines, sentences, paragraphs, blocks, suppression ranges, and the findings of the context rules asked for.

    text is the expanded text, whose offsets are UTF-16 units. A null text is an empty one."""
    from pyspark.sql.pandas.types import from_arrow_schema

    ignore, context = list(ignore_patterns or []), context or {}
    schema = T.StructType([docs.schema["path"], *from_arrow_schema(pa.schema(_FIELDS)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                cols: list[list] = [[] for _ in _FIELDS]
                for text in part.column(1).to_pylist():
                    d = Document(text or "", ignore, namespace)
                    found = [{"rule": r, "index": i, "length": n, "message": m} for r, o in context.items() for i, n, m in CONTEXT_RULES[r](d, o)]
                    blocks = [dict(zip(("start", "end", "kind", "section"), b)) for b in d.blocks]
                    ranges = [dict(zip(("start", "end", "rule"), r)) for r in d.ranges]
                    starts = [0, *(m.end() for m in _LINE_END.finditer(d.text))]
                    parts = [d.redacted[k : k + PART] for k in range(0, len(d.redacted), PART)]
                    for c, v in zip(cols, (d.text, d.masked, parts, starts, d.sentences, d.paragraphs, blocks, ranges, found)):
                        c.append(v)
                yield pa.record_batch([part.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)]], ["path", *[n for n, _ in _FIELDS]])

    return docs.select("path", "text").mapInArrow(run, schema)


_RAW = "array<struct<rule:string,severity:string,index:bigint,length:bigint,message:string>>"


def raw_findings(settings: dict[str, tuple[str, dict]]) -> Column:
    """All findings of a prepared document by the rules that are on: short rule id, severity, index, length, message."""
    parts: list[Column] = []
    for r, (severity, options) in settings.items():
        parts.append(_findings(r, severity, json.dumps(options, sort_keys=True), id(SparkContext._gateway)))
    return F.concat(*parts) if parts else F.array().cast(_RAW)


@lru_cache(maxsize=512)
def _findings(rule: str, severity: str, options: str, gateway: int) -> Column:
    """The findings of a rule by its options (JSON). A rule is thousands of calls to the JVM, so that its column is kept for the next run."""
    if rule in COLUMN_RULES:
        found = COLUMN_RULES[rule](json.loads(options)).cast(f"array<{FINDING}>")
    else:
        found = F.transform(F.filter("found", _named(rule)), lambda f: F.struct(f["index"], f["length"], f["message"], F.lit(None).cast("string").alias("severity"))).cast(f"array<{FINDING}>")
    return F.transform(found, _labelled(rule, severity)).cast(_RAW)


def _named(rule: str):
    return lambda f: f["rule"] == rule


def _labelled(rule: str, severity: str):
    return lambda f: F.struct(F.lit(rule).alias("rule"), F.coalesce(f["severity"], F.lit(severity)).alias("severity"), f["index"], f["length"], f["message"])


def suppressed(index: Column, rule: Column) -> Column:
    """Whether a directive or ignored line covers the place; the end of a range counts as in it."""
    return F.exists("ranges", lambda r: (index >= r["start"]) & (index <= r["end"]) & ((r["rule"] == "*") | (r["rule"] == rule)))


def allowed(allow_terms: list[dict], short: Column, index: Column, length: Column) -> Column:
    """Whether a finding lies within an allowed term."""
    out = F.lit(False)
    for item in allow_terms:
        rules = [r.split("/", 1)[1] for r in item["rules"] if r.split("/", 1)[1] in ALLOW_TERM_RULES]
        inside = F.exists(find_all(F.col("masked"), escape(item["term"])), lambda m: (index >= m["at"]) & (index + F.greatest(length, F.lit(1)) <= m["at"] + F.length(m["text"])))
        out = out | (short.isin(rules) & inside)
    return out


def line_before(index: Column) -> Column:
    """The number of the line, from 0, of a place: a binary search of the starts of lines."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("starts", at + step) <= index, at + step).otherwise(at))


def excerpt(start: Column, end: Column) -> Column:
    """Redacted text of a place, white space as single blanks."""
    first = F.greatest(start, F.lit(0))
    low = F.floor(first / PART).cast("int")
    some = F.array_join(F.slice("redacted", low + 1, F.floor(end / PART).cast("int") - low + 1), "")
    cut = piece(some, first - low * PART, end - low * PART)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, f"[{WS}]+", " "), "^ | $", ""), "[\\uE100\\uE102\\uE104][\\uE101\\uE103\\uE105]", "\ufffd")


def lint(docs: DataFrame, config: dict | None = None) -> DataFrame:
    """(path, text) to findings: path, rule_id, severity, line, column, index, length, message, excerpt, occurrences.

    index, length and column count UTF-16 units, line and column from 1. Characters beyond the BMP show as U+FFFD in excerpts. Rows with a null text have no
    findings; repeated rows have each their own."""
    config = validate(config)
    settings = rule_settings(config)
    patterns = [x["pattern"] for x in config.get("ignorePatterns", [])]
    rows = prepare(docs, patterns, {r: o for r, (_, o) in settings.items() if r in CONTEXT_RULES})
    full = lambda r: F.concat(F.lit(NAMESPACE + "/"), r)
    found = F.filter(raw_findings(settings), lambda f: ~suppressed(f["index"], full(f["rule"])))
    if config.get("allowTerms"):
        found = F.filter(found, lambda f: ~allowed(config["allowTerms"], f["rule"], f["index"], f["length"]))
    placed = F.transform(found, lambda f: let(line_before(f["index"]), lambda n: F.struct(
        full(f["rule"]).alias("rule_id"), f["severity"], (n + 1).cast("int").alias("line"), (f["index"] - F.get("starts", n) + 1).cast("int").alias("column"), f["index"].cast("int").alias("index"), f["length"].cast("int").alias("length"),
        f["message"], excerpt(f["index"] - 20, f["index"] + f["length"] + 20).alias("excerpt"))))
    out = rows.select("path", F.explode(placed).alias("f")).select("path", *[F.col("f")[c].alias(c) for c in ("rule_id", "severity", "line", "column", "index", "length", "message", "excerpt")])
    none = F.array().cast("array<struct<column:int,index:int,length:int,excerpt:string>>")
    out = out.withColumn("occurrences", none)
    return collapse(out, config.get("occurrenceMergeDistance", MERGE_DISTANCE)) if config.get("collapseOccurrences") else out


def rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(n)) for s, n in RANK.items()], F.lit(0))


def collapse(findings: DataFrame, distance: int = MERGE_DISTANCE) -> DataFrame:
    """Findings of one rule on one line, each within `distance` columns of the one before, as one with occurrences; its severity is the highest.

    Partitions are single lines of single documents."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "rule_id", "line").orderBy("index", "length")
    gap = F.abs(F.col("column") - F.lag("column").over(w))
    marked = findings.withColumn("_g", F.sum(F.when(gap > distance, 1).otherwise(0)).over(w))
    item = F.struct("index", "column", "length", "excerpt", "message", "severity")
    grouped = marked.groupBy("path", "rule_id", "line", "_g").agg(F.sort_array(F.collect_list(item)).alias("a"), F.max(F.struct(rank(F.col("severity")).alias("r"), "severity")).alias("top"))
    first = F.col("a")[0]
    rest = F.transform(F.slice("a", 2, 1 << 30), lambda x: F.struct(x["column"], x["index"], x["length"], x["excerpt"]))
    return grouped.select("path", "rule_id", F.col("top.severity").alias("severity"), "line", first["column"].alias("column"), first["index"].alias("index"), first["length"].alias("length"), first["message"].alias("message"), first["excerpt"].alias("excerpt"), rest.alias("occurrences"))
