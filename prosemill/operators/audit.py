"""Audits: profiles against the catalogue, manifests of corpora, packaged goldsets. Each gives rows of what it found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..plans.catalogue import PROFILES, profile_rules, rules
from .lint import rank

LETTERS = {"error": "E", "warning": "W", "info": "I"}


def profile_matrix(spark: SparkSession) -> DataFrame:
    """A row a rule, a column a profile: E, W, I, or - where it is off."""
    letter = F.coalesce(*[F.when(F.col("severity") == s, F.lit(x)) for s, x in LETTERS.items()], F.lit("-"))
    return profile_rules(spark).groupBy("rule_id").pivot("profile", PROFILES).agg(F.first(letter))


def profile_issues(spark: SparkSession) -> DataFrame:
    """(rule_id, profile, kind): settings that don't go together across minimal, general, agent-output and strict."""
    cells = profile_rules(spark).withColumn("r", F.when(F.col("enabled"), rank(F.col("severity"))).otherwise(F.lit(-1)))
    at = lambda p: cells.filter(F.col("profile") == p).select("rule_id", F.col("r").alias(p.replace("-", "_")), F.col("options").alias(f"o_{p.replace('-', '_')}"))
    wide = reduce(lambda a, b: a.join(b, "rule_id"), [at(p) for p in ("minimal", "general", "agent-output", "strict")])
    wide = wide.join(rules(spark).select(F.col("short_id").alias("rule_id"), rank(F.col("catalogue_severity")).alias("meta")), "rule_id")
    one = {
        "minimal-on-strict-off": "minimal > 0 and strict < 0", "strict-warn-general-off": "strict >= 2 and general < 0", "agent-on-general-off": "agent_output > 0 and general < 0", "default-warn-general-off": "meta >= 2 and general < 0",
        "agent-weaker-than-general": "agent_output > 0 and general > 0 and agent_output < general", "minimal-set-strict-off": "minimal > 0 and strict < 0", "general-warn-minimal-off": "general >= 2 and minimal < 0",
    }
    kinds = F.explode(F.filter(F.array(*[F.when(F.expr(test), F.lit(k)) for k, test in one.items()]), lambda x: x.isNotNull())).alias("kind")
    single = wide.select("rule_id", F.lit(None).cast("string").alias("profile"), kinds)
    each = cells.filter("profile != 'strict'").join(wide.select("rule_id", "strict", "o_strict"), "rule_id")
    over = each.filter("r > strict and r > 0").select("rule_id", "profile", F.lit("over-strict").alias("kind"))
    options = each.filter("r > 0 and strict > 0").select("rule_id", "profile", F.explode("options").alias("k", "v"), "o_strict").withColumn("s", F.try_element_at("o_strict", F.col("k")))
    tight = options.filter(F.col("k").rlike("(?i)^(?:max|min|errorChars)") & (F.col("v").cast("double") < F.col("s").cast("double"))).select("rule_id", "profile", F.lit("option-tighter-than-strict").alias("kind"))
    return single.unionByName(over).unionByName(tight)


MANIFEST_TEXT = "id origin sourceName sourceUrl license termsCheckedAt purpose validationRole storagePolicy profile genre notes".split()
MANIFEST_FLAGS = "includeText repositoryIncluded packageIncluded".split()
MANIFEST = T.StructType([*[T.StructField(c, T.StringType()) for c in MANIFEST_TEXT], *[T.StructField(c, T.BooleanType()) for c in MANIFEST_FLAGS], T.StructField("reviewFocus", T.ArrayType(T.StringType())), *[T.StructField(c, T.StringType()) for c in ("text", "body", "content", "html", "markdown")]])


def _codes(tests: list[tuple[str, str, Column]]) -> Column:
    found = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, t in tests])
    return F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")


def manifest_issues(manifest: DataFrame) -> DataFrame:
    """(line_no, id, level, code) for records read by read_jsonl(path, MANIFEST)."""
    c = F.col
    later = F.row_number().over(Window.partitionBy("id").orderBy("line_no")) > 1
    missing = [("error", f"required-field:{f}", c(f).isNull() | (F.trim(c(f)) == "")) for f in MANIFEST_TEXT] + [("error", f"required-field:{f}", c(f).isNull()) for f in [*MANIFEST_FLAGS, "reviewFocus"]]
    date = c("termsCheckedAt").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("termsCheckedAt", "yyyy-MM-dd").isNotNull()
    external = c("origin") == "external-public"
    profiled, named = c("profile").isin(*PROFILES), c("genre").isin(*PROFILES)
    focus = c("reviewFocus")
    tests = missing + [
        ("error", "json-parse", c("corrupt").isNotNull()), ("error", "id-format", ~c("id").rlike("^[a-z0-9][a-z0-9._-]*$")), ("error", "id-duplicate", c("_later") & c("id").isNotNull()), ("error", "origin-value", ~c("origin").isin("external-public", "self-authored")),
        ("error", "source-url", ~c("sourceUrl").rlike(r"^https?://[^\s/]+")), ("warning", "terms-tbd", c("termsCheckedAt") == "TBD-before-fetch"), ("error", "terms-format", ~date & (c("termsCheckedAt") != "TBD-before-fetch") & ~((c("termsCheckedAt") == "not-applicable") & (c("origin") == "self-authored"))),
        ("error", "review-focus-empty", F.size(focus) == 0), ("error", "review-focus-item", F.exists(focus, lambda x: x.isNull() | (F.trim(x) == ""))), ("warning", "review-focus-duplicate", F.size(F.array_distinct(focus)) < F.size(focus)),
        ("error", "profile-unknown", ~profiled), ("warning", "profile-genre-identical", c("profile") == c("genre")), ("warning", "genre-profile-name", named & (c("profile") != c("genre"))), ("warning", "possible-profile-genre-swap", ~profiled & named),
        *[("error", f"external-public-no-body:{f}", external & c(f)) for f in MANIFEST_FLAGS], *[("error", f"external-public-body-field:{f}", external & (c(f) != "")) for f in ("text", "body", "content", "html", "markdown")],
    ]
    return manifest.withColumn("_later", later).select("line_no", "id", _codes(tests)).select("line_no", "id", "f.level", "f.code")


def goldset_package_issues(gold: DataFrame, strict_origin: bool = False, strict_source: bool = False, source_prefix: str = "local/", attribute_terms: tuple[str, ...] = ()) -> DataFrame:
    """(line_no, id, level, code): records of a goldset that may not be packaged."""
    c = F.col
    mild = lambda strict: "error" if strict else "warning"
    tests = [
        (mild(strict_origin), "origin-missing", c("origin").isNull()), ("error", "origin-value", ~c("origin").isin("self-authored", "rights-cleared")), ("error", "rights-note", (c("origin") == "rights-cleared") & (F.coalesce(F.trim("rightsNote"), F.lit("")) == "")),
        (mild(strict_source), "local-source", c("sourceFile").startswith(source_prefix)), ("error", "text-missing", c("text").isNull() | (F.trim("text") == "")), *[("warning", f"attribute-term:{t}", c("text").contains(t)) for t in attribute_terms],
    ]
    return gold.select("line_no", "id", _codes(tests)).select("line_no", "id", "f.level", "f.code")
