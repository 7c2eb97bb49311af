"""HTML pages to Markdown-like text; column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textops import let

LEAST = 20
_NAMED = [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("ensp", " "), ("emsp", " "), ("thinsp", " "), ("copy", "(c)"), ("reg", "(R)")]
CANDIDATES = [r"(?is)<main\b[^>]*>(.*?)</main>", r"(?is)<article\b[^>]*>(.*?)</article>", r"""(?is)<div\b[^>]*(?:class|id)=["'][^"']*(?:markdown-body|main|article|content)[^"']*["'][^>]*>(.*?)</div>""", r"(?is)<body\b[^>]*>(.*?)</body>"]


def without_noise(html: Column) -> Column:
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "\n")
    for tag in ("script", "style", "svg", "noscript", "nav", "header", "footer", "aside"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "\n")
    return html


def entities(text: Column) -> Column:
    """Numeric entities by code point, then eleven named ones; the ampersand last, so that nothing is decoded twice."""
    kind = r"(?i)&#(?:x[0-9a-f]+|[0-9]+);"
    def decoded(m: Column) -> Column:
        hexa, deci = F.regexp_extract(m, r"(?i)&#x([0-9a-f]+);", 1), F.regexp_extract(m, "&#([0-9]+);", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).otherwise(deci).try_cast("long")
        return F.when(code.between(1, 1114111), _utf8(code)).otherwise(m)

    parts = F.split(text, kind, -1)
    numeric = F.transform(F.regexp_extract_all(text, F.lit(kind), F.lit(0)), decoded)
    text = F.when(text.rlike(kind), F.array_join(F.transform(parts, lambda g, i: F.concat(g, F.coalesce(F.get(numeric, i), F.lit("")))), "")).otherwise(text)
    for name, to in _NAMED[1:] + _NAMED[:1]:
        text = F.regexp_replace(text, f"(?i)&{name};", to)
    return text


def _utf8(code: Column) -> Column:
    """The character of a code point, from its UTF-8 bytes."""
    b = lambda n: F.lpad(F.hex(n), 2, "0")
    tail = lambda shift: b(F.shiftright(code, shift).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128)))
    h = F.when(code < 128, b(code)).when(code < 2048, F.concat(b(F.shiftright(code, 6).bitwiseOR(F.lit(192))), tail(0))).when(code < 65536, F.concat(b(F.shiftright(code, 12).bitwiseOR(F.lit(224))), tail(6), tail(0))).otherwise(F.concat(b(F.shiftright(code, 18).bitwiseOR(F.lit(240))), tail(12), tail(6), tail(0)))
    return F.decode(F.unhex(h), "UTF-8")


def to_markdown(html: Column) -> Column:
    for tag, mark in (("h1", "# "), ("h2", "## "), ("h3", "### "), ("h[4-6]", "#### ")):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", f"\n{mark}$1\n\n")
    html = F.regexp_replace(html, r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1")
    html = F.regexp_replace(html, r"(?is)<(?:br|div|ol|p|section|table|tr|ul)\b[^>]*>", "\n")
    html = F.regexp_replace(html, r"(?is)</(?:div|ol|p|section|table|tr|ul)>", "\n")
    html = F.regexp_replace(html, r"""(?is)<a\b[^>]*href=["'][^"']+["'][^>]*>(.*?)</a>""", "$1")
    text = entities(F.regexp_replace(html, "<[^>]+>", " "))
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), r"^[\s 　]+|[\s 　]+$", "")
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), trim), lambda x: x != ""), "\n\n")


def extract(html: Column) -> Column:
    """The text of a page's main part: of main, article, a content division, the body and the whole page, the first that gives LEAST characters; if none does, the first there is."""

    def after(clean: Column, k: int, best: Column) -> Column:
        """From the k-th candidate on, each converted only if those before were too short; best: the first text so far."""
        if k > len(CANDIDATES):
            return F.coalesce(best, F.lit(""))
        own = F.when(clean.rlike(CANDIDATES[k]), to_markdown(F.regexp_extract(clean, CANDIDATES[k], 1))) if k < len(CANDIDATES) else to_markdown(clean)
        return let(own, lambda t: F.when(F.length(t) >= LEAST, t).otherwise(after(clean, k + 1, F.coalesce(best, F.when(t != "", t)))))

    return let(without_noise(html), lambda clean: after(clean, 0, F.lit(None).cast("string")))


def extraction_status(df: DataFrame, url: str = "url", kind: str | None = None, text: str = "markdown") -> DataFrame:
    """df with status: unsupported formats by content type or else extension, texts under LEAST characters, or ok."""
    ext = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\.([A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))
    unsupported = ext.isin("pdf", "zip", "docx", "xlsx", "pptx", "png", "jpg", "jpeg", "gif", "csv") if kind is None else ~F.col(kind).rlike("html|text|markdown|json")
    return df.withColumn("status", F.when(unsupported, "unsupported-format").when(F.length(text) < LEAST, "too-short").otherwise("ok"))


def strip_wiki(text: Column) -> Column:
    """Text without balanced wiki templates, link brackets and magic words."""
    parts = F.split(text, r"(?<=\{\{)|(?=\{\{)|(?<=\}\})|(?=\}\})", -1)

    def step(a: Column, v: Column) -> Column:
        up, down = v == "{{", (v == "}}") & (a["d"] > 0)
        depth = a["d"] + F.when(up, 1).when(down, -1).otherwise(0)
        return F.struct(depth.alias("d"), F.when(~up & ~down & (a["d"] == 0), F.concat(a["o"], v)).otherwise(a["o"]).alias("o"))

    text = F.when(text.contains("{{"), F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit("").alias("o")), step, lambda a: a["o"])).otherwise(text)
    text = F.regexp_replace(text, r"\[\[(?:[^\]|\n]*\|)*([^\]|\n]*)\]\]", "$1")
    return F.regexp_replace(text, r"__[A-Z0-9_]+__", "")
