"""Column functions on text: places of matches, visible lengths, single evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsregex import WS, java

BLOCK = 1000
#: A raw finding: offsets in UTF-16 units of the expanded text; severity overrides the rule's where not null.
FINDING = "struct<index:bigint,length:bigint,message:string,severity:string>"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def running_sum(x: Column) -> Column:
    """Exclusive prefix sums of an array of longs, in blocks, as appending to one array would take quadratic time."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def fold(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), none.alias("out"))
        return F.aggregate(values, first, lambda a, v: F.struct((a["s"] + v).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])

    blocks = F.sequence(zero, F.floor((F.size(x) - 1) / F.lit(BLOCK)).cast("long"))
    part = lambda b: F.slice(x, (b * BLOCK + 1).cast("int"), F.lit(BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), zero, lambda a, v: a + v))
    return let(fold(sums, zero), lambda base: F.flatten(F.transform(blocks, lambda b: fold(part(b), F.get(base, b.cast("int"))))))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<at, text>> of the leftmost non-overlapping matches of a Java pattern; at is 0-based."""
    kind = "array<struct<at:bigint,text:string>>"

    def placed(m: Column) -> Column:
        def at(gaps: Column) -> Column:
            lens = F.transform(m, lambda v, i: (F.length(v) + F.length(F.get(gaps, i))).cast("long"))
            return let(running_sum(lens), lambda before: F.transform(m, lambda v, i: F.struct((F.get(before, i) + F.length(F.get(gaps, i))).alias("at"), v.alias("text"))))

        return let(F.split(text, pattern, -1), at)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed).cast(kind)).otherwise(F.array().cast(kind))


def count_all(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def visible(text: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(text, f"[{WS}]+", ""))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], with start and end cut to the text."""
    a = F.greatest(start, F.lit(0))
    return F.substring(text, (a + 1).cast("int"), F.greatest(end - a, F.lit(0)).cast("int"))


def strip_urls(text: Column) -> Column:
    for p in (r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]]+\]\([^)]*\)", r"<https?:\/\/[^>\s]+>", r"https?:\/\/[^\s<>\"'）)\]」』】〉》]+"):
        text = F.regexp_replace(text, java(p), "")
    return text


_REFERS = re.compile(r"\\[1-9k]|\(\?<[A-Za-z]")


def matches(text: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns matches; false without patterns. One alternation, unless groups are referred to."""
    out = F.lit(False)
    if len(patterns) > 1 and not any(_REFERS.search(p) for p in patterns):
        patterns = ["|".join(f"(?:{p})" for p in patterns)]
    for p in patterns:
        out = out | text.rlike(java(p))
    return out


#: Signs of a source in a text.
EVIDENCE = r"doi:|DOI:|https?:\/\/|\[[A-Za-z][^\]]+\]|\[[0-9０-９]+\]|（?\(?[12][0-9]{3}\)?）?|図\s*[0-9０-９]+|表\s*[0-9０-９]+|引用|参考文献|出典[:：]"


def has_evidence(text: Column) -> Column:
    return text.rlike(java(EVIDENCE))
