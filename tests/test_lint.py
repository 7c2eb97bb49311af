"""The lint engine on small texts: masking, directives, allowed terms, offsets, collapsing, comparison of runs."""

import pytest

from prosemill.operators import diff, report
from prosemill.operators.lint import collapse, lint
from prosemill.plans.catalogue import NAMESPACE
from prosemill.plans.queries import _only

PLACEHOLDER = _only("placeholder")


def found(spark, texts, config):
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    return sorted((r["path"], r["line"], r["column"], r["index"], r["length"]) for r in lint(df, config).collect())


def test_masking_and_directives(spark):
    texts = {
        "plain": "ここはTODOです。", "code": "`TODO` は書き方です。", "fence": "```\nTODO\n```\n", "front": "---\ntitle: TODO\n---\n本文です。", "comment": "<!-- TODO -->\n本文です。",
        "next": f"<!-- {NAMESPACE}-disable-next-line placeholder -->\nここはTODOです。", "block": f"<!-- {NAMESPACE}-disable -->\nここはTODOです。\n<!-- {NAMESPACE}-enable -->\n次もTODOです。", "empty": "", "none": None,
    }
    assert found(spark, texts, PLACEHOLDER) == [("block", 4, 3, texts["block"].rindex("TODO"), 4), ("plain", 1, 4, 3, 4)]


def test_offsets_count_utf16_units(spark):
    assert found(spark, {"a": "😀は\n😀TODOです。"}, PLACEHOLDER) == [("a", 2, 3, 6, 4)]


def test_ignored_lines_and_allowed_terms(spark):
    config = PLACEHOLDER | {"ignorePatterns": [{"pattern": "^記録:", "scope": "line", "reason": "記録の行は調べない"}]}
    assert found(spark, {"a": "記録: TODO\nここはTODOです。"}, config) == [("a", 2, 4, 12, 4)]


def test_hidden_controls_show_even_in_code(spark):
    assert len(found(spark, {"a": "`a​b` と⁠文"}, _only("hidden-unicode-controls"))) == 2


def test_unknown_settings_are_errors():
    from prosemill.plans.config import validate

    for bad in ({"rules": {f"{NAMESPACE}/no-such-rule": "error"}}, {"unknown": 1}):
        with pytest.raises(ValueError):
            validate(bad)


def test_collapse_and_reports(spark):
    df = lint(spark.createDataFrame([("a", "TODOとTODOとTODO。")], "path string, text string"), PLACEHOLDER)
    one = collapse(df, 30).collect()
    assert len(one) == 1 and len(one[0]["occurrences"]) == 2 and one[0]["index"] == 0
    assert report.exit_status(df, "error") in (0, 1) and report.exit_status(df, "off", 2) == 1 and report.exit_status(df, "off", 3) == 0


def test_runs_compared(spark):
    key = "path string, line int, column int, rule_id string"
    old = spark.createDataFrame([("a", 1, 1, "r"), ("a", 1, 1, "r"), ("b", 1, 1, "r")], key)
    new = spark.createDataFrame([("a", 1, 1, "r"), ("c", 1, 1, "r")], key)
    got = sorted((r["path"], r["status"]) for r in diff.multiset_diff(old, new).collect())
    assert got == [("a", "persisted"), ("a", "removed"), ("b", "removed"), ("c", "added")]


def test_bench_snapshots_and_selection(spark, tmp_path):
    from prosemill.operators import bench

    docs = spark.createDataFrame([("a", "TODOとTODO。"), ("b", "静かな朝です。")], "path string, text string")
    counts, times = bench.bench({"x": docs}, ["minimal"])
    assert {(r["rule_id"], r["n"]) for r in counts.collect()} == {(f"{NAMESPACE}/placeholder", 2)} and times.count() == 1
    less = counts.withColumn("n", counts["n"] - 1)
    assert [(r["n_old"], r["n_new"], r["delta"]) for r in bench.bench_diff(counts, less).collect()] == [(2, 1, -1)]
    text = bench.diff_markdown(bench.bench_profiles(counts, less, times, times), bench.bench_diff(counts, less))
    assert "| minimal | 2 | 1 | -1 |" in text and "placeholder | 2 | 1 | -1 |" in text
    found, path = lint(docs, PLACEHOLDER), str(tmp_path / "snapshots")
    bench.snapshot(found, docs, path, "one")
    bench.snapshot(found.filter("index > 0"), docs, path, "two")
    table = spark.read.parquet(path)
    assert table.filter("snapshot = 'one'").count() == 2
    assert [(r["path"], r["n_old"], r["n_new"]) for r in bench.snapshot_diff(table, "one", "two").collect()] == [("a", 2, 1)]
    assert bench.selected(docs, ["b"], "path").count() == 1 and bench.selected(docs, [], "path").count() == 2
    with pytest.raises(ValueError):
        bench.selected(docs, ["b", "c"], "path")
    text = report.markdown_report(found, docs)
    assert f"| a | 2 | {NAMESPACE}/placeholder 2 |" in text and "Files without findings: 1.\n- b" in text and "  > TODOとTODO。" in text


def test_stream_gives_the_same_findings(spark, tmp_path):
    from prosemill.streaming.lint_stream import stream_documents, stream_findings

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("ここはTODOです。", encoding="utf-8")
    stream_findings(stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), PLACEHOLDER).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("line", "column").collect() == [(1, 4)]


def test_alternations_pass_over_other_scripts():
    import re

    from prosemill.functions.jsregex import any_literal, any_pattern, heads

    words = ["近年", "DX", "AI", "(現在)"]
    assert any_literal(words).startswith("(?=[") and any_literal(["近年"]) == "近年" and any_literal([]) is None
    text = "AIと近年のDX、(現在)とBX、aiの現在"
    assert re.findall(any_literal(words), text) == ["AI", "近年", "DX", "(現在)"]
    assert heads("(?:検討|対応)(?:する)?|[あ|い]う") is None and heads("(?:検討|対応)(?:する)?|あ[|い]") == set("検対あ")
    assert heads("(?:再|要)?検討") is None and heads("あ?い") is None and heads("(?:あ|)い") is None
    assert re.findall(any_pattern(["どんな.{1,3}でも", "常に"]), "どんな時でも常にない") == ["どんな時でも", "常に"]


def test_a_long_line_before_a_match_takes_linear_time(spark):
    """The start of a match's line was looked for from every place of the text before it."""
    import time

    texts = {str(i): "word " * 40000 + "\n\n承知しました。窓口まで連絡をください。" for i in range(4)}
    spark.range(1).count()
    began = time.time()
    assert found(spark, {"a": "承知しました。"}, _only("chat-response-leakage")) == [("a", 1, 1, 0, 6)]
    short = time.time() - began
    began = time.time()
    assert found(spark, texts, _only("chat-response-leakage")) == [(k, 3, 1, 200002, 6) for k in sorted(texts)]
    assert time.time() - began < short + 20


def test_matches_is_one_alternation_unless_groups_are_referred_to(spark):
    from pyspark.sql import functions as F

    from prosemill.functions.textops import matches

    df = spark.createDataFrame([("aXb",), ("cc",), ("Ab",)], "t string")
    got = lambda ps: [r[0] for r in df.select(matches(F.col("t"), ps)).collect()]
    assert got(["(?i)ab", "X"]) == [True, False, True] and got([r"(a)b", r"(c)\1"]) == [False, True, False] and got([]) == [False] * 3
    assert str(matches(F.col("t"), ["a", "b"])).lower().count("rlike") == 1
