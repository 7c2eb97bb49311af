"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Rows are summed to cells (source, language, topic) first; the raking runs on cells alone. Each pass scales the cells'
token weights to one marginal after the other, by window sums, until all marginals are within `tol` or `passes` are done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import docs, durable, md5_unit, small

DIMS = ("source", "lang", "topic")
#: Without given targets: a marginal's shares to this power.
TEMPER = {"source": 0.6, "lang": 0.8, "topic": 0.9}
KEEP = 0.8
NULL = "\x00"


def topic_of(text: Column) -> Column:
    """A coarse topic by lexical markers of the whole text."""
    return (
        F.when(text.rlike(r"https?://|www\."), "web").when(text.rlike(r"(?i)licen[sc]e|copyright"), "legal").when(text.rlike(r"\w@\w|\d{3}[-. ]\d{3,4}"), "contact")
        .when(text.rlike(r"[{};]\s*\n|\|"), "table").otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Words: runs of characters other than white space."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, dims: tuple[str, ...] = DIMS, tol: float = 1e-6, passes: int = 60, chunk: int = 6) -> DataFrame:
    """cells (dims, tokens) with `share`: raked shares of the whole, summing to 1.

    targets: by dim a table (value, weight); values without cells are left out and the rest scaled to 1; cells whose value has no
    target get a share of 0. A dim without a table takes its own shares to the power TEMPER. Marginals that no weights can
    meet together end after `passes`. All weights 0: no share."""
    out = cells.withColumn("share", F.col("tokens").cast("double"))
    for d in dims:
        w = F.sum("share").over(Window.partitionBy(d))
        if targets and d in targets:
            t = targets[d].select(F.col("value").alias(d), F.col("weight").cast("double").alias(f"t_{d}"))
            out = out.join(t, d, "left").fillna(0.0, [f"t_{d}"])
        else:
            out = out.withColumn(f"t_{d}", F.pow(w, F.lit(TEMPER.get(d, 1.0))))
    out = durable(out)
    for d in dims:
        whole = out.select(d, f"t_{d}").distinct().agg(F.sum(f"t_{d}")).first()[0] or 1.0
        out = out.withColumn(f"t_{d}", F.col(f"t_{d}") / F.lit(float(whole)))
    sums = lambda d: F.sum("share").over(Window.partitionBy(d))
    for done in range(0, passes, chunk):
        for _ in range(min(chunk, passes - done)):
            for d in dims:
                out = out.withColumn("s", sums(d)).withColumn("share", F.when(F.col("s") > 0, F.col("share") * F.col(f"t_{d}") / F.col("s")).otherwise(F.lit(0.0))).drop("s")
        out = durable(out)
        gaps = [out.groupBy(d).agg(F.abs(F.sum("share") - F.first(f"t_{d}")).alias("gap")).agg(F.max("gap").alias("gap")) for d in dims]
        worst = gaps[0]
        for g in gaps[1:]:
            worst = worst.unionByName(g)
        if (worst.agg(F.max("gap")).first()[0] or 0.0) <= tol:
            break
    return out.drop(*[f"t_{d}" for d in dims])


FEATURES = ("_source", "_lang", "_topic", "_tokens", "_id")


def features(text: str = "text", source: str = "source", lang: str = "lang", key: str = "doc_id", topic: Column | None = None) -> list[Column]:
    """The columns FEATURES of a row: its cell, its tokens and what decides its fate, the hash of key and text. A null source, language or text has a value of its own
    or no tokens. topic: the row's topic; topic_of its text by default."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    each = (value(source), value(lang), topic_of(t) if topic is None else F.coalesce(topic.cast("string"), F.lit(NULL)), tokens_of(t), F.concat(value(key), F.lit("/"), F.md5(t)))
    return [c.alias(n) for c, n in zip(each, FEATURES)]


def mix(rows: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """rows (FEATURES and others) with _p and _repeats: a row comes floor(_p) times in the sample, and once more if the hash of its _id, in [0, 1), is below the rest of _p.

    _p is keep * tokens of all * the cell's share / tokens of the cell, and above 1 where a cell has fewer tokens than its share asks for; so the expected tokens of each
    cell are its share's. Rows of cells without tokens have _p 1. Rows alike in key and text have the same fate. An empty table gives an empty result."""
    cells = durable(rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    p = F.when(F.col("tokens") > 0, F.lit(float(keep * total)) * F.col("share") / F.col("tokens")).otherwise(F.lit(1.0))
    rates = rake(cells, targets).select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), p.alias("_p"))
    more = md5_unit(F.col("_id")) < F.col("_p") - F.floor("_p")
    return rows.join(small(durable(rates)), ["_source", "_lang", "_topic"]).withColumn("_repeats", F.floor("_p") + more.cast("long"))


def sample(df: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", key: str = "doc_id", topic: Column | None = None, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """A sample of the rows of df, with their columns, whose tokens meet the raked marginals in expectation; rows of cells to be raised come several times."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *features(text, source, lang, key, topic))
    return mix(rows, targets, keep).filter("_repeats > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_repeats")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(docs(spark, sf_dir).select("doc_id", *features()))
    return mix(rows).select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_p", 9).alias("p"), F.col("_repeats").alias("repeats"), (F.col("_repeats") > 0).alias("kept"))
