"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Candidates of all kinds are found in each text's own row. The hash of each candidate's value is counted over
the distinct repositories and owners of the whole corpus: a value that more than `max_owners` owners hold, or several owners in more than
`max_repos` repositories, is a widely copied example; any other is owner-specific and looks live. Base kinds are always reported, other
kinds only where live. Spans of different kinds may overlap; redaction masks their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs, durable, let, small, stored

#: kind: (pattern, group of the value, least length of the value, base kind). Order breaks ties of start.
KINDS: dict[str, tuple[str, int, int, bool]] = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, True),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24, True),
    "provider": (r"gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, False),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", 0, 1, False),
    "opaque": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{32})(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}", 0, 32, False),
}
BASE = [k for k, v in KINDS.items() if v[3]]
MAX_OWNERS, MAX_REPOS = 2, 8
SPANS = "array<struct<start:bigint,ord:int,kind:string,end:bigint,h:bigint>>"
BLOCK = 1000


def running_sum(x: Column) -> Column:
    """Exclusive prefix sums of an array of longs; in blocks, as appending to one array would take quadratic time."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def fold(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), none.alias("out"))
        return F.aggregate(values, first, lambda a, v: F.struct((a["s"] + v).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])

    blocks = F.sequence(zero, F.floor((F.size(x) - 1) / F.lit(BLOCK)).cast("long"))
    part = lambda b: F.slice(x, (b * BLOCK + 1).cast("int"), F.lit(BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), zero, lambda a, v: a + v))
    return let(fold(sums, zero), lambda base: F.flatten(F.transform(blocks, lambda b: fold(part(b), F.get(base, b.cast("int"))))))


def _found(t: Column, kind: str) -> Column:
    """The kind's spans in t: array of (start, ord, kind, end, value hash); offsets in code points."""
    pattern, group, least, _ = KINDS[kind]
    order = list(KINDS).index(kind)
    hit = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.split(t, pattern, -1)

    def spans(m: Column) -> Column:
        def at(g: Column) -> Column:
            lens = F.transform(m, lambda v, i: (F.length(v) + F.length(F.get(g, i))).cast("long"))
            return let(lens, lambda x: let(running_sum(x), lambda before: F.transform(m, lambda v, i: F.struct(
                (F.get(before, i) + F.length(F.get(g, i))).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"),
                (F.get(before, i) + F.get(x, i)).alias("end"), (F.regexp_extract(v, pattern, 2) if group else v).alias("value")))))

        kept = F.filter(let(gaps, at), lambda s: F.length(s["value"]) >= least)
        return F.transform(kept, lambda s: F.struct(s["start"], s["ord"], s["kind"], s["end"], F.xxhash64(s["value"]).alias("h")))

    return F.when(t.rlike(pattern), let(hit, spans).cast(SPANS)).otherwise(F.array().cast(SPANS))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(text: str, repository: str, owner: str) -> list[Column]:
    """Columns uid, repo, owner, base and more (spans of the base kinds and of the others) of a row."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return [
        F.monotonically_increasing_id().alias("uid"), value(repository).alias("repo"), value(owner).alias("owner"),
        F.sort_array(F.concat(*[_found(t, k) for k in BASE])).alias("base"), F.sort_array(F.concat(*[_found(t, k) for k in KINDS if k not in BASE])).alias("more"),
    ]


def frequency(rows: DataFrame, spans: Column) -> DataFrame:
    """(h, n_owners, n_repos) of the values of the spans; a hot value is summed by owner and repository before it meets."""
    each = rows.select("repo", "owner", F.explode(F.array_distinct(F.transform(spans, lambda s: s["h"]))).alias("h"))
    by_owner = each.distinct().groupBy("h", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def copied(max_owners: int, max_repos: int) -> Column:
    return (F.col("n_owners") > max_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") > max_repos))


def secret_scan(df: DataFrame, text: str = "text", key: str = "doc_id", repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """A row for each row of df: the key, base spans, and all spans that count, each with kind, start, end, n_owners, n_repos and live.

    n_repos counts pairs of owner and repository. A null text is an empty one. Null owners (repositories) count as one. Repeated rows count by their repository
    once. An empty table gives an empty result."""
    rows = durable(df.select(F.col(key).alias("key"), *candidates(text, repository, owner)))
    every = F.concat("base", "more")
    seen = frequency(rows, every)
    spans = rows.select("uid", F.explode(every).alias("s")).withColumn("h", F.col("s.h")).join(small(durable(seen)), "h")
    ranked = F.struct(*[F.col("s")[c].alias(c) for c in ("start", "ord", "kind", "end")], "n_owners", "n_repos", (~copied(max_owners, max_repos)).alias("live"))
    counted = spans.filter(~copied(max_owners, max_repos) | F.col("s.kind").isin(BASE)).groupBy("uid").agg(F.sort_array(F.collect_list(ranked)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint,n_owners:bigint,n_repos:bigint,live:boolean>>")
    return rows.join(counted, "uid", "left").select(F.col("key").alias(key), "base", F.coalesce("spans", none).alias("spans"))


def union(spans: Column) -> Column:
    """Sorted spans (start, ord, kind, end) as disjoint ones (s, e, k): overlapping ones are one, named by the first's kind."""
    new = lambda s, e, k: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), k.alias("k"))
    done = lambda a: F.when(a["now"]["s"] >= 0, F.array_append(a["out"], a["now"])).otherwise(a["out"])
    first = F.struct(new(F.lit(-1), F.lit(-1), F.lit("")).alias("now"), F.array().cast("array<struct<s:bigint,e:bigint,k:string>>").alias("out"))
    step = lambda a, x: F.when(x["start"] < a["now"]["e"], F.struct(new(a["now"]["s"], F.greatest(a["now"]["e"], x["end"]), a["now"]["k"]).alias("now"), a["out"].alias("out"))).otherwise(
        F.struct(new(x["start"], x["end"], x["kind"]).alias("now"), done(a).alias("out")))
    return F.aggregate(spans, first, step, done)


def masked(t: Column, spans: Column, together: int = 64) -> Column:
    """t with the disjoint spans replaced by [REDACTED:kind]. A text is cut for `together` spans at a time first, so that many spans don't each walk the whole text."""

    def cut(m: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(m, i - 1)["e"]).otherwise(F.lit(0).cast("long"))  # noqa: E731  of the span before the i-th

        def block(b: Column) -> Column:
            lo = (b * together).cast("int")
            part = F.slice(m, lo + 1, F.lit(together))
            sub = F.substring(t, (end(lo) + 1).cast("int"), (F.get(m, F.least(lo + together, F.size(m)) - 1)["e"] - end(lo)).cast("int"))
            return let(sub, lambda text: F.array_join(F.transform(part, lambda x, i: F.concat(
                F.substring(text, (end(lo + i) - end(lo) + 1).cast("int"), (x["s"] - end(lo + i)).cast("int")), F.lit("[REDACTED:"), x["k"], F.lit("]"))), ""))

        blocks = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / F.lit(together)).cast("int"))
        tail = F.substring(t, (F.element_at(m, -1)["e"] + 1).cast("int"), F.length(t))
        return F.concat(F.array_join(F.transform(blocks, block), ""), tail)

    return F.when(F.size(spans) == 0, t).otherwise(let(union(spans), cut))


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """df with the union of the spans that secret_scan reports in each text replaced by [REDACTED:kind]; other columns as they are.

    Spans are found once and stored beside their rows. Only rows that hold values of widely copied examples are joined with those. A null text
    stays null."""
    names = df.columns
    rows = stored(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *candidates(text, repository, owner)))
    wide = small(durable(frequency(rows, F.col("more")).filter(copied(max_owners, max_repos)).select("h")))
    each = rows.select("uid", F.explode(F.transform("more", lambda s: s["h"])).alias("h"))
    known = durable(each.join(wide, "h").groupBy("uid").agg(F.collect_set("h").alias("known")))
    out = rows.join(small(known), "uid", "left")
    spans = F.sort_array(F.concat("base", F.filter("more", lambda s: F.col("known").isNull() | ~F.array_contains("known", s["h"]))))
    put = lambda c: masked(F.col("row")[c], spans).alias(c) if c == text else F.col("row")[c].alias(c)
    return out.select(*[put(c) for c in names])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(docs(spark, sf_dir))
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    each = lambda f: F.array_join(F.transform("spans", lambda s: s[f].cast("string")), ",")
    return found.select("doc_id", *[counted(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), each("n_owners").alias("owners"), each("n_repos").alias("repositories"), each("live").alias("live"))


def _kind_sql(kind: str) -> str:
    """Spans of a kind: matches and the gaps between them tile the text. Look-arounds, which this engine lacks, are tests of the whole run instead."""
    pattern, group, least, _ = KINDS[kind]
    pattern = {"hex": "[0-9a-f]+", "opaque": "[A-Za-z0-9+/_-]{32,}={0,2}"}.get(kind, pattern).replace("*+", "*").replace("'", "''")
    value = f"regexp_extract(m, '{pattern}', 2)" if group else "m"
    also = " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')" if kind == "opaque" else ""
    return f"""SELECT uid, {list(KINDS).index(kind)} AS ord, '{kind}' AS kind, {value} AS value, e - length(m) AS start, e AS end_ FROM (
  SELECT uid, ms[i] AS m, (list_sum(list_transform(ms[:i], lambda x: length(x))) + list_sum(list_transform(gs[:i], lambda x: length(x))))::BIGINT AS e FROM (
    SELECT uid, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT uid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))) WHERE length({value}) >= {least}{also}"""


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner, coalesce(doc_id::VARCHAR, chr(1)) AS repo FROM documents),
s AS MATERIALIZED ({' UNION ALL '.join(map(_kind_sql, KINDS))}),
o AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos FROM s JOIN d USING (uid) GROUP BY 1),
a AS (SELECT s.*, n_owners, n_repos, NOT (n_owners > {MAX_OWNERS} OR n_owners > 1 AND n_repos > {MAX_REPOS}) AS live, ord < {len(BASE)} AS base FROM s JOIN o USING (value)),
g AS (SELECT uid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, ord) FILTER (base) AS base,
  string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, ord, end_) AS spans, string_agg(n_owners::VARCHAR, ',' ORDER BY start, ord, end_) AS owners,
  string_agg(n_repos::VARCHAR, ',' ORDER BY start, ord, end_) AS repositories, string_agg(live::VARCHAR, ',' ORDER BY start, ord, end_) AS live FROM a WHERE base OR live GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(owners, '') AS owners, coalesce(repositories, '') AS repositories,
  coalesce(live, '') AS live FROM d LEFT JOIN g USING (uid)
"""
