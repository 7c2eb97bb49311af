"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Base signals of each text are counted in its own row, without a shuffle. The labelled rows are split by the hash of their
key. On the smaller part each stratum chooses, of a grid, a cutoff for each signal and an order of the signals; that gives
nested rules, the first signal's cutoff, the first two's, and so on. On the other part, the holdout, these are tested in that order: a
rule holds if the exact binomial (Clopper-Pearson) upper bound of its false rejections among good rows is at most
`risk`. The first rule that fails ends its stratum's sequence (fixed-sequence testing, which needs no correction within a stratum), and
`delta` is shared equally by the strata (Bonferroni).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs, durable, let, md5_unit, small, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Share of the labelled keys that choose cutoffs; the others are the holdout.
CHOOSING = 0.25
RISK, DELTA = 0.02, 0.05
#: Signal: the larger the worse; and the cutoffs to choose from (at or above: rejected).
GRID: dict[str, list[float]] = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8],
    "dup_line_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeat_rate": [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18],
    "upper_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "mean_word_excess": [8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0],
    "shortness": [-200.0, -150.0, -100.0, -80.0, -60.0, -40.0, -30.0, -20.0],
}


def _repeat_words(w: Column) -> Column:
    """Words of the array w in WINDOW-word windows that occur twice or more in it."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, k: (e["x"] == F.get(s, k + 1)["x"]) | (e["x"] == F.get(s, k - 1)["x"]))
        return F.when(F.size(twice) == 0, F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(twice, lambda e: e["i"])), lambda p: F.aggregate(
            F.transform(p, lambda i, k: F.when(k > 0, F.least(F.lit(WINDOW), i - F.get(p, k - 1))).otherwise(F.lit(WINDOW))),
            F.lit(0).cast("long"), lambda a, x: a + x)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("x"), i.alias("i")))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.sort_array(hashes), covered))


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base signals of its text. A null text counts as one without words. Windows are compared
    by 64-bit hashes of their five words. Existing columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def all_of(a: Column) -> Column:
        return F.struct(
            F.size(a).cast("long").alias("n_words"), F.length(F.array_join(a, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _repeat_words(a).alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        )

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper"]
    out = df.drop(*names).withColumn("_sig", let(w, all_of))
    return out.select(*[c for c in out.columns if c != "_sig"], *[F.col("_sig")[n].alias(n) for n in names])


def _rates() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col("n_repeat_words") / n,
        "upper_rate": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "mean_word_excess": F.col("word_chars") / n,
        "shortness": -F.col("n_words").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1, by Stirling's series after a shift by 8."""
    y = x + 8.0
    shift = F.log(x * (x + 1.0) * (x + 2.0) * (x + 3.0)) + F.log((x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * y) - 1 / (360.0 * y * y * y) + 1 / (1260.0 * F.pow(y, F.lit(5.0))) - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) and k <= n * p; terms beyond 40 deviations below k, which add nothing in double precision, are left out."""
    low = F.greatest(F.lit(0.0), F.floor(k - 50.0 - 40.0 * F.sqrt(n * p * (1 - p))))
    first = log_gamma(n + 1.0) - log_gamma(low + 1.0) - log_gamma(n - low + 1.0) + low * math.log(p) + (n - low) * math.log1p(-p)
    more = lambda a, j: a["t"] + F.log(n - j + 1.0) - F.log(j) + (math.log(p) - math.log1p(-p))
    step = lambda a, j: F.struct(more(a, j.cast("double")).alias("t"), (a["s"] + F.exp(more(a, j.cast("double")))).alias("s"))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))
    js = F.when(k > low, F.sequence((low + 1).cast("long"), F.greatest(k, low + 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < 0, F.lit(0.0)).otherwise(F.aggregate(js, start, step, lambda a: a["s"]))


def fit_cutoffs(scored: DataFrame, risk: float = RISK, delta: float = DELTA, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Cutoffs by stratum from labelled rows with columns stratum, good (boolean), holdout (boolean) and the signals.

    One row a stratum that rejects anything: stratum, cut (map of signal to cutoff), with n_good and n_false of its holdout. Rejecting by all
    cutoffs of a stratum loses at most `risk` of its good rows, for all strata at once with probability 1 - delta over the
    holdout's draw. A stratum whose holdout has too few good rows for any rule, (1 - risk)**n over its share of delta, has none."""
    grid = grid or GRID
    scored = durable(scored.filter(F.col("good").isNotNull()).select("stratum", "good", "holdout", *grid))
    tests = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(float(c)).alias("cutoff"), (F.col(s) >= F.lit(float(c))).alias("hit")) for s in grid for c in grid[s]]))
    cells = scored.filter("not holdout").select("stratum", "good", tests.alias("t")).groupBy("stratum", "t.signal", "t.cutoff").agg(
        F.sum(F.col("good").cast("long")).alias("n"), F.sum((F.col("good") & F.col("t.hit")).cast("long")).alias("k"), F.sum((~F.col("good") & F.col("t.hit")).cast("long")).alias("bad"))
    best = cells.filter((F.col("bad") > F.col("k")) & (2 * F.col("k") <= risk * F.col("n"))).groupBy("stratum", "signal").agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), "cutoff")).alias("b"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("b.gain")).alias("o"), "signal", F.col("b.cutoff").alias("cutoff"))))
    path = small(durable(best.groupBy("stratum").agg(order.alias("path"))))
    value = lambda x: F.coalesce(*[F.when(x["signal"] == s, F.col(s)) for s in grid])
    rank = F.array_position(F.transform("path", lambda x: value(x) >= x["cutoff"]), True)  # 0: no cutoff reached
    held = scored.filter("holdout and good").join(path, "stratum", "left").groupBy("stratum", F.coalesce(rank, F.lit(0)).alias("rank")).agg(F.count("*").alias("c"))
    held = held.groupBy("stratum").agg(F.sum("c").alias("n"), F.collect_list(F.struct("rank", "c")).alias("ranks"))
    held = durable(held.filter(F.pow(F.lit(1 - risk), F.col("n")) <= delta))
    level = delta / max(1, held.count())  # a row for each stratum
    rules = held.join(path, "stratum").select("stratum", "n", "path", F.posexplode("path").alias("m", "x"), "ranks")
    k = F.aggregate("ranks", F.lit(0).cast("long"), lambda a, r: a + F.when((r["rank"] > 0) & (r["rank"] <= F.col("m") + 1), r["c"]).otherwise(0))
    tested = rules.withColumn("k", k).withColumn("ok", (F.col("k") <= F.col("n") * risk) & (binomial_cdf(F.col("k").cast("double"), F.col("n").cast("double"), risk) <= level))
    ends = tested.groupBy("stratum").agg(F.first("n").alias("n_good"), F.first("path").alias("path"), F.min(F.when(~F.col("ok"), F.col("m"))).alias("stop"), F.sort_array(F.collect_list(F.struct("m", "k"))).alias("ks"))
    ends = ends.withColumn("m", F.coalesce("stop", F.size("path"))).filter("m > 0")
    return ends.select("stratum", F.map_from_entries(F.transform(F.slice("path", F.lit(1), F.col("m")), lambda x: F.struct(x["signal"], x["cutoff"]))).alias("cut"), "n_good", F.element_at("ks", F.col("m"))["k"].alias("n_false"))


def stratum_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\x00"))


def cutoffs(sig: DataFrame, labels: DataFrame, key: str, risk: float, delta: float) -> DataFrame:
    """fit_cutoffs on the rows of sig (key, stratum, base_failed, signals) that have a label; labels: key and quality."""
    good = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("key")).agg((F.min("quality") > 0).alias("good"))
    voters = sig.filter(~F.col("base_failed")).join(small(durable(good)), "key")
    return small(durable(fit_cutoffs(voters.select("stratum", "good", (md5_unit(F.col("key")) >= CHOOSING).alias("holdout"), *[c.alias(n) for n, c in _rates().items()]), risk, delta)))


def failed_signals() -> Column:
    some = F.filter(F.array(*[F.when(c >= F.col("cut")[n], F.lit(n)) for n, c in _rates().items()]), lambda x: x.isNotNull())
    return F.when(F.col("cut").isNull(), F.array().cast("array<string>")).otherwise(some)


def quality_rules(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Rows of df's key with their signals, base_failed, failed (the signals over their cutoffs) and kept.

    labels: key and quality (1: good). Rows with a null key, or with no or a null label, are judged but don't vote; a key with
    several labels votes by the lowest, once for each of its rows. A null stratum is one of its own. Repeated rows are judged each by
    itself. An empty table gives an empty result; without labels only the base rules hold."""
    base = signals(df.select(F.col(key).alias("key"), F.col(text).alias("text"), stratum_of(stratum).alias("stratum"))).drop("text")
    base = durable(base.withColumn("base_failed", base_failed()))
    judged = base.join(cutoffs(base, labels, key, risk, delta), "stratum", "left").withColumn("failed", failed_signals())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("cut", "n_good", "n_false").withColumnRenamed("key", key)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs(spark, sf_dir), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of df, with their columns, that quality_rules keeps. Signals are counted once and stored beside their rows, so that no text is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = signals(df.select(row.alias("row"), F.col(text).alias("text"), F.col(key).alias("key"), stratum_of(stratum).alias("stratum"))).drop("text")
    rows = stored(rows.withColumn("base_failed", base_failed()))
    cut = cutoffs(rows.drop("row"), labels, key, risk, delta)
    return rows.filter(~F.col("base_failed")).join(cut, "stratum", "left").filter(F.size(failed_signals()) == 0).select("row.*")


def _rate_sql() -> str:
    n = "greatest(n_words, 1)::DOUBLE"
    each = {
        "symbol_rate": f"n_symbols / {n}", "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeat_rate": f"n_repeat_words / {n}",
        "upper_rate": "n_upper / greatest(word_chars, 1)::DOUBLE", "mean_word_excess": f"word_chars / {n}", "shortness": "-n_words::DOUBLE",
    }
    return ", ".join(f"{v} AS {k}" for k, v in each.items())


def _grid_sql() -> str:
    return " UNION ALL ".join(f"SELECT stratum, good, '{s}' AS signal, c AS cutoff, {s} >= c AS hit FROM v, (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in cs)}]) AS c) WHERE NOT holdout" for s, cs in GRID.items())


OP5_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(ws) - {WINDOW} + 2), lambda i: array_to_string(ws[i : i + {WINDOW - 1}], ' ')) AS k FROM t)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM w),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, (SELECT unnest(range(0, {WINDOW})) AS j) WHERE c > 1 GROUP BY 1),
b AS (SELECT doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper FROM t LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {_rate_sql()} FROM b),
v AS (SELECT s.*, l.good, ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / pow(2, 52) >= {CHOOSING} AS holdout FROM s JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1) l USING (doc_id) WHERE NOT base_failed),
c AS (SELECT stratum, signal, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS bad FROM ({_grid_sql()}) GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, signal) AS m FROM (SELECT stratum, signal, max(bad - k) AS gain, arg_max(cutoff, struct_pack(g := bad - k, c := cutoff)) AS cutoff FROM c WHERE bad > k AND 2 * k <= {RISK} * n GROUP BY 1, 2)),
x AS (SELECT doc_id, stratum, unnest([{', '.join(f"struct_pack(signal := '{n}', value := {n})" for n in GRID)}], recursive := true) FROM s WHERE NOT base_failed),
f AS (SELECT x.doc_id, min(p.m) AS rank FROM x JOIN p ON p.stratum = x.stratum AND p.signal = x.signal AND x.value >= p.cutoff GROUP BY 1),
h AS (SELECT v.stratum, f.rank FROM v LEFT JOIN f USING (doc_id) WHERE holdout AND good),
n AS (SELECT stratum, count(*) AS n FROM h GROUP BY 1 HAVING pow({1 - RISK}, count(*)) <= {DELTA}),
k AS (SELECT p.stratum, p.m, n.n, (SELECT count(*) FROM h WHERE h.stratum = p.stratum AND h.rank <= p.m) AS k FROM p JOIN n USING (stratum)),
o AS (SELECT stratum, m, k <= n * {RISK} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln({1 - RISK})))) <= {DELTA} / (SELECT count(*) FROM n) AS ok FROM k),
e AS (SELECT stratum, coalesce(min(m) FILTER (NOT ok) - 1, max(m)) AS m FROM o GROUP BY 1)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (e.m IS NULL OR f.rank IS NULL OR f.rank > e.m) AS kept FROM s LEFT JOIN f USING (doc_id) LEFT JOIN e ON e.stratum = s.stratum
"""
