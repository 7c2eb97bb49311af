"""The queries of the driver contract, each with DuckDB SQL where SQL can express it.

The given tables hold no Japanese, so the rules run on a derived corpus: two paragraphs written for this purpose, chosen by doc_id, before each document's whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import LEXICONS
from ..functions.textops import find_all
from ..operators import audit, diff, evaluate, extract_html, markdown, report
from ..operators.lint import collapse, lint
from ..sources.files import table_documents
from .cases import PASSAGES
from .catalogue import NAMESPACE, PROFILE_CONFIGS, RULES, default_options, profile_rules, rules

PARAGRAPHS = [
    "朝の会議は九時に始まり、前日の売り上げと在庫の数を確かめてから終わる。倉庫の担当は棚の番号を読み上げる。",
    "以下では手順をまとめて書きます。順番に説明します。まずはじめに箱を開けて、中の部品を机の上に並べてください。",
    "承知しました。ご希望であれば別の案も用意します。何かあれば窓口まで連絡をください。お気軽にお知らせください。",
    "この取り組みは今後の課題である。さらなる検討が必要とされ、地域にとって大きな意味を持つ。教育にも示唆を与える。",
    "重要な課題には多様な要因が関係し、複雑な構造と文脈の影響を受けるため、有用な観点と役割の意義を本質から考える価値がある。",
    "持続的な発展性の観点から効率化の可能性を高度化する意識の共有化と多様性の具体化は、組織論の専門性や計画性や実効性の向上力に関わるので、全体像の抽象度と必要性の整理が急がれる段階に来ている。",
    "ご連絡させていただきます。ご確認させていただき、ご報告させていただく予定でございます。どうぞよろしくお願いいたします。お願いさせていただくこととなりました。",
    "この制度において利用者に関する情報を踏まえて判断することができる。地域に関して調査を伴って進めるということが前提であり、観点から見て妥当なものである。制度において確認するということになる。",
    "生成AIとDXを核にしたエコシステムで価値創出を狙い、アジャイルな人材育成とリスキリングで社会実装を急ぐ。データ駆動の最適化も続ける。",
    "来月の売り上げは下がるかもしれない。天候が原因であろうという声があり、客足が戻る可能性がある。競合の値下げも響いたと考えられる。倉庫の移転が遅れた影響もあるだろう。地元の祭りが重なったことも一因とみられる。広告の掲載時期が早すぎた面も指摘された。",
    "この店とその店を比べると、これは安いがそれは遠い。こうした違いを知らずにあの店を選ぶと、その場で迷うことが増える。この町ではあの角を曲がると別の市場に出るので、それを覚えておくとこの先の買い物が楽になると長く住む人が話していた。",
    "参加者の名簿は未定のまま残っており、会場の住所はTODOと書かれている。連絡先の欄も要確認となっている。仮置きの写真も差し替える。",
    "長い文の例として、朝に港を出た船が沖で網を上げて戻るまでの流れを順に述べると、夜明け前に氷を積み、燃料を確かめ、無線で仲間と場所を分け合い、潮の向きを読みながら網を入れ、日が高くなるころに引き上げて選別し、昼過ぎに港へ戻って競りに出し、夕方には道具を洗って翌日の支度を済ませてから、ようやく家に帰って遅い食事をとるという一日になる。",
    "市場の朝は早い。荷が届く。人が集まる。声が響く。値が決まる。車が出る。通りが静かになる。店が開く。",
    "図書館では本を棚に戻す前に傷みを調べる。破れた頁は糊で直し、背の糸が切れた本は別の箱に分けて月末に職人へ送る。",
    "文の途中に​見えない字が混じると、検索で見つからない​ことがある。写しの元を確かめて取り除く。",
    "庭の木は秋に葉を落とす。掃いた葉は畑の隅に積み、春まで寝かせて土に戻す。",
    "研究の一助となるよう記録を残した。地域に貢献することが期待される。今後の展開が期待される。",
    "倉庫の鍵は二本あり、一本は事務所の棚、もう一本は管理人の手元に置く。",
    "子どもたちは放課後に川辺へ集まり、石を投げて遊んだあと、橋の下で雨が止むのを待った。",
    "水の使い方は家ごとに違うと言われている。井戸の水を好む家は多くの場合古いとされている。",
    "近年、町の書店は姿を消しつつある。駅前に残る一軒は夜まで明かりをともしている。",
    "この方法なら必ず成功する。失敗は絶対に起きない。",
    "あらゆる料理は火加減で決まる。いかなる道具も手入れを怠れば傷む。",
    "新しい窓口を設けたことで、利用者の満足は大幅に向上した。待ち時間も劇的に減少した。",
    "道路の補修については早めに検討する必要がある。橋の点検も対応が求められる。",
    "また、朝は寒い。また、夜は長い。また、風が強い。しかし、雨は少ない。",
    "参加者（子どもを除く）は受付（入口の右側）で名札（青い紙の札）を受け取り、席（前から三列目まで）に着き、資料（会場で配る冊子）を読む。",
    "★★ ☆☆ 今週のお知らせ",
    "地域の将来を見すえた取り組みを進めていくことは、これからの暮らしを考えるうえでも大変に重要である。",
]
N = len(PARAGRAPHS)
SECOND = (7, 3)
SEP = "\n\n"

Query = Callable[[SparkSession, str], DataFrame]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): the derived corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.array(*[F.lit(p) for p in PARAGRAPHS])
    pick = lambda i: F.get(body, i.cast("int"))
    a, b = pick(F.col("doc_id") % N), pick((F.col("doc_id") * SECOND[0] + SECOND[1]) % N)
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(a, F.lit(SEP), b, F.lit(SEP), F.coalesce("text", F.lit(""))).alias("text"))


def _only(rule: str, options: dict | None = None) -> dict:
    off = {f"{NAMESPACE}/{r}": False for r in RULES}
    return {"rules": off | {f"{NAMESPACE}/{rule}": {"severity": RULES[rule][1], "options": options or {}}}}


def rule_query(rule: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lint(corpus(spark, sf_dir), _only(rule)).select("path", "severity", "line", "column", "index", "length")

    return run


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BASE = "paras(i, body) AS (VALUES " + ", ".join(f"({i}, {_sql_text(p)})" for i, p in enumerate(PARAGRAPHS)) + f"""),
docs AS (SELECT d.doc_id::VARCHAR AS path, a.body AS a, b.body AS b, a.body || chr(10) || chr(10) || b.body || chr(10) || chr(10) || coalesce(d.text, '') AS t
  FROM documents d JOIN paras a ON a.i = d.doc_id % {N} JOIN paras b ON b.i = (d.doc_id * {SECOND[0]} + {SECOND[1]}) % {N}),
blk AS (SELECT path, t, a AS p, 0 AS ofs FROM docs UNION ALL SELECT path, t, b, length(a) + 2 FROM docs)"""


def _places(source: str, text: str, pattern: str) -> str:
    """CTEs: hits(path, t, ofs, m) of a pattern in a text column; at is the place in t."""
    return f"""sp AS (SELECT path, t, ofs, regexp_extract_all({text}, {_sql_text(pattern)}) AS ms, string_split_regex({text}, {_sql_text(pattern)}) AS gs FROM {source}),
hk AS (SELECT path, t, ofs, ms, gs, unnest(range(1, len(ms) + 1)) AS k FROM sp),
hits AS (SELECT path, t, (ofs + list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::INTEGER AS "index", ms[k] AS m FROM hk)"""


_OUT = """'{s}' AS severity, (length(substr(t, 1, "index")) - length(replace(substr(t, 1, "index"), chr(10), '')) + 1)::INTEGER AS line, (length(string_split(substr(t, 1, "index"), chr(10))[-1]) + 1)::INTEGER AS "column", "index", {n}::INTEGER AS length"""


def _select(rule: str, length: str, source: str, where: str = "true") -> str:
    return f"SELECT path, {_OUT.format(s=RULES[rule][1], n=length)} FROM {source} WHERE {where}"


def literal_sql(rule: str, words: list[str]) -> str:
    return f"WITH {_BASE}, whole AS (SELECT path, t, 0 AS ofs FROM docs), {_places('whole', 't', '|'.join(words))} {_select(rule, 'length(m)', 'hits')}"


def paragraph_sql(rule: str, count: str, most: int, where: str = "true") -> str:
    return f"""WITH {_BASE}, c AS (SELECT path, t, ofs::INTEGER AS "index", p, {count} AS n FROM blk WHERE {where}) {_select(rule, 'least(length(p), 80)', 'c', f'n > {most}')}"""


def _count(words: list[str]) -> str:
    return f"len(regexp_extract_all(p, {_sql_text('|'.join(words))}))"


SENTENCE = "[^。！？!?]*[。！？!?]"


def sentence_sql(rule: str, where: str, severity: str | None = None) -> str:
    out = _select(rule, "least(length(m), 80)", "hits", where)
    return f"WITH {_BASE}, {_places('blk', 'p', SENTENCE)} " + (out.replace(f"'{RULES[rule][1]}' AS severity", f"{severity} AS severity") if severity else out)


def _words(rule: str, key: str) -> list[str]:
    return LEXICONS[rule][key]


def passage_sql(rule: str) -> str:
    """The passages that PASSAGES lists for a rule, wherever their paragraph stands."""
    rows = ", ".join(f"({i}, {_sql_text(x)})" for i, x in PASSAGES[rule])
    return f"""WITH {_BASE}, want(i, x) AS (VALUES {rows}), h AS (SELECT path, t, (ofs + strpos(p, x) - 1)::INTEGER AS "index", x FROM blk JOIN paras ON paras.body = blk.p JOIN want ON want.i = paras.i) {_select(rule, 'least(length(x), 80)', 'h')}"""


def rule_sql(options: dict[str, dict] | None = None) -> dict[str, str]:
    """The findings of each rule on the derived corpus; options: by rule, over the defaults."""
    deictic = sorted(_words("unclear-deictic", "deicticPhrases"), key=lambda w: -len(w))
    tails = ["ら", *_words("unclear-deictic", "fixedPhraseTails")]
    possible = [w for w in _words("over-possibility", "possibilityPhrases") if w != "ことがある"]
    o = lambda r: default_options(r) | (options or {}).get(r, {})
    polite = literal_sql("excessive-politeness", ["させていただくこととなりました", "させていただきたく存じます"])
    heavy = literal_sql("translationese", _words("translationese", "directPatterns"))
    both = lambda a, b: f"SELECT * FROM ({a}) UNION ALL SELECT * FROM ({b})"
    noun = "[ぁ-んァ-ン一-龠々]{1,10}(?:[性化的感力度論観像]|性質)"
    dense = paragraph_sql("weasel-phrases", _count(_words("weasel-phrases", "phrases")), o("weasel-phrases")["maxPerParagraph"])
    return {r: passage_sql(r) for r in PASSAGES} | {
        "weasel-phrases": both(passage_sql("weasel-phrases"), dense),
        "hidden-unicode-controls": literal_sql("hidden-unicode-controls", ["[​-‍⁠﻿‪-‮⁦-⁩]"]),
        "list-intro-padding": literal_sql("list-intro-padding", _words("list-intro-padding", "phrases")),
        "chat-response-leakage": literal_sql("chat-response-leakage", _words("chat-response-leakage", "phrases")),
        "empty-conclusion": literal_sql("empty-conclusion", o("empty-conclusion")["patterns"]),
        "placeholder": literal_sql("placeholder", ["TODO", "未定", "要確認", "仮置き"]),
        "long-sentence": sentence_sql("long-sentence", f"length(m) > {o('long-sentence')['maxChars']}", f"CASE WHEN length(m) > {o('long-sentence')['errorChars']} THEN 'error' ELSE 'warning' END"),
        "long-paragraph": paragraph_sql("long-paragraph", f"greatest(length(p) - {o('long-paragraph')['maxChars']}, len(list_filter(regexp_extract_all(p, '{SENTENCE}'), lambda x: length(x) >= 5)) - {o('long-paragraph')['maxSentences']})", 0),
        "abstract-noun-stack": sentence_sql("abstract-noun-stack", f"len(regexp_extract_all(m, {_sql_text('|'.join(_words('abstract-noun-stack', 'abstractWords')))})) >= {o('abstract-noun-stack')['minHits']}"),
        "nominalization-density": sentence_sql("nominalization-density", f"length(m) >= {o('nominalization-density')['minChars']} AND len(regexp_extract_all(m, '{noun}')) >= {o('nominalization-density')['minHits']}"),
        "excessive-politeness": both(paragraph_sql("excessive-politeness", _count(["させていただ", "でございます", "ございます"]), o("excessive-politeness")["maxSasetePerParagraph"]), polite),
        "translationese": both(heavy, paragraph_sql("translationese", _count(_words("translationese", "densityPatterns")), o("translationese")["maxPerParagraph"])),
        "buzzword-density": paragraph_sql("buzzword-density", _count(_words("buzzword-density", "buzzwords")), o("buzzword-density")["maxPerParagraph"]),
        "over-possibility": paragraph_sql("over-possibility", f"{_count(possible)} + {_count(['ことがある'])} - {_count(['[ただ]ことがある'])}", o("over-possibility")["maxPerParagraph"], f"length(p) >= {o('over-possibility')['minParagraphChars']}"),
        "unclear-deictic": paragraph_sql("unclear-deictic", f"{_count(deictic)} - {_count(['(?:' + '|'.join(deictic) + ')(?:' + '|'.join(tails) + ')'])}", o("unclear-deictic")["maxPerParagraph"], f"length(p) >= {o('unclear-deictic')['minParagraphChars']}"),
    }


# Relational operators on the given tables.
def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a plain word in the documents, for the operators that come after the rules."""
    t = F.col("text")
    rows = table_documents(spark, sf_dir).withColumn("m", F.explode(find_all(t, " the ")))
    head = F.substring(t, F.lit(1), F.col("m.at").cast("int"))
    line, column = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1, F.length(F.substring_index(head, "\n", -1)) + 1
    none = F.array().cast("array<struct<column:int,index:int,length:int,excerpt:string>>")
    return rows.select("path", F.lit("word").alias("rule_id"), F.when(F.col("m.at") % 2 == 0, "info").otherwise("warning").alias("severity"), line.cast("int").alias("line"), column.cast("int").alias("column"), F.col("m.at").cast("int").alias("index"), F.length("m.text").cast("int").alias("length"), F.lit("").alias("message"), F.lit("").alias("excerpt"), none.alias("occurrences"))


_HITS = """w AS (SELECT doc_id::VARCHAR AS path, text AS t, 0 AS ofs FROM documents), """ + _places("w", "t", " the ") + """,
f AS (SELECT path, CASE WHEN "index" % 2 = 0 THEN 'info' ELSE 'warning' END AS severity, "index", (length(substr(t, 1, "index")) - length(replace(substr(t, 1, "index"), chr(10), '')) + 1)::INTEGER AS line, (length(string_split(substr(t, 1, "index"), chr(10))[-1]) + 1)::INTEGER AS "column" FROM hits)"""


def find_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("path", "severity", "line", "column", "index")


def collapse_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(_hits(spark, sf_dir), 60).select("path", "severity", "line", "column", "index", F.size("occurrences").alias("n_more"))


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts_by(_hits(spark, sf_dir), "severity", "line")


def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lines of each document with most hits."""
    by_line = _hits(spark, sf_dir).withColumn("rule_id", F.col("line").cast("string"))
    return report.top_rules(by_line, 3).select("path", F.col("rule_id").alias("line"), "n", "place")


def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir).select("path", F.col("index").alias("start"), (F.col("index") + 80).alias("end"))
    return diff.merge_intervals(rows, "path")


def _lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' lines with their text's first letter's side: an old and a new run to compare."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("lang").alias("path"), F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4"), "old").otherwise("new").alias("side"), F.explode(F.split("text", "\n")).alias("rule_id")).withColumns({"line": F.length("rule_id"), "column": F.lit(1)})


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_of(spark, sf_dir)
    return diff.multiset_diff(rows.filter("side = 'old'"), rows.filter("side = 'new'")).groupBy("path", "status").agg(F.sum("n").alias("n"))


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines_of(spark, sf_dir)
    return diff.count_diff(rows.filter("side = 'old'"), rows.filter("side = 'new'"), "path", "line")


def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines as a sign of labelled bad quality: precision, recall and F1 by language."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", (F.size(lines) > F.size(F.array_distinct(lines))).alias("hit"))
    rows = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return evaluate.confusion(rows.filter("hit"), rows.filter("quality = 0"), "lang", on=["doc_id", "lang"])


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of Markdown lines of the whole corpus, by language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l"))
    kind = markdown.kind_of(F.col("l"))
    return d.groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("l")).alias("chars"))


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_html.extraction_status(p.select("page_id", "url", extract_html.extract(F.col("html")).alias("markdown"))).select("page_id", "markdown", "status")


def replies_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal rule with its words replaced by an option, over conversations."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    docs = c.select(F.concat_ws("/", "conv_id", "turn", "role").alias("path"), "text")
    found = lint(docs, _only("list-intro-padding", {"phrases": [" the ", " and "]}))
    return found.groupBy(F.substring_index("path", "/", -1).alias("role")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("turns"))


def catalogue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark).select("rule_id", "category", "severity", "n_profiles")


def profile_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile_matrix(spark)


def profile_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_rules(spark).groupBy("profile").agg(F.sum(F.col("enabled").cast("int")).cast("long").alias("n"))


def profile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile_issues(spark)


_EX = r"(?is)"


def _extract_sql() -> str:
    r = lambda e, p, to, f="gis": f"regexp_replace({e}, {_sql_text(p)}, {to}, '{f}')"
    nl = "chr(10)"
    noise = r("html", "<!--.*?-->", nl, "gs")
    for tag in ("script", "style", "svg", "noscript", "nav", "header", "footer", "aside"):
        noise = r(noise, rf"<{tag}\b.*?</{tag}>", nl)

    def md(e: str) -> str:
        for tag, mark in (("h1", "# "), ("h2", "## "), ("h3", "### "), ("h[4-6]", "#### ")):
            e = r(e, rf"<{tag}\b[^>]*>(.*?)</{tag}>", f"{nl} || '{mark}\\1' || {nl} || {nl}")
        e = r(e, r"<li\b[^>]*>(.*?)</li>", f"{nl} || '- \\1'")
        e = r(e, r"<(?:br|div|ol|p|section|table|tr|ul)\b[^>]*>", nl)
        e = r(e, r"</(?:div|ol|p|section|table|tr|ul)>", nl)
        e = r(e, r"""<a\b[^>]*href=["'][^"']+["'][^>]*>(.*?)</a>""", "'\\1'")
        e = r(e, "<[^>]+>", "' '")
        for name, to in extract_html._NAMED[1:] + extract_html._NAMED[:1]:
            e = r(e, f"&{name};", _sql_text(to))
        return f"array_to_string(list_filter(list_transform(string_split({e}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10))"

    pats = [p.removeprefix(_EX) for p in extract_html.CANDIDATES]
    parts = [f"CASE WHEN regexp_matches(c, {_sql_text(p)}, 'is') THEN {md(f'regexp_extract(c, {_sql_text(p)}, 1, {chr(39)}is{chr(39)})')} END" for p in pats] + [md("c")]
    cols = ", ".join(f"{p} AS m{i}" for i, p in enumerate(parts))
    pick = ", ".join(f"CASE WHEN length(m{i}) >= {extract_html.LEAST} THEN m{i} END" for i in range(len(parts))) + ", " + ", ".join(f"nullif(m{i}, '')" for i in range(len(parts)))
    return f"WITH n AS (SELECT page_id, url, {noise} AS c FROM pages), x AS (SELECT page_id, url, {cols} FROM n), y AS (SELECT page_id, url, coalesce({pick}, '') AS markdown FROM x) SELECT page_id, markdown, CASE WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]{{1,5}})(?:[?#].*)?$', 1)) IN ('pdf', 'zip', 'docx', 'xlsx', 'pptx', 'png', 'jpg', 'jpeg', 'gif', 'csv') THEN 'unsupported-format' WHEN length(markdown) < {extract_html.LEAST} THEN 'too-short' ELSE 'ok' END AS status FROM y"


_LINES = "l AS (SELECT lang AS path, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'old' ELSE 'new' END AS side, unnest(string_split(text, chr(10))) AS x FROM documents)"
ORACLE: dict[str, str] = {f"rule_{k.replace('-', '_')}": v for k, v in rule_sql().items()} | {
    "find_words": f'WITH {_HITS} SELECT path, severity, line, "column", "index" FROM f',
    "collapse_findings": f"""WITH {_HITS}, g AS (SELECT *, CASE WHEN "column" - lag("column") OVER w > 60 THEN 1 ELSE 0 END AS b FROM f WINDOW w AS (PARTITION BY path, line ORDER BY "index")),
s AS (SELECT *, sum(b) OVER (PARTITION BY path, line ORDER BY "index") AS grp FROM g) SELECT path, max(severity) AS severity, line, min("column") AS "column", min("index") AS "index", (count(*) - 1)::INTEGER AS n_more FROM s GROUP BY path, line, grp""",
    "summary_counts": f"WITH {_HITS} SELECT severity, line, count(*) AS n FROM f GROUP BY 1, 2",
    "top_lines": f"WITH {_HITS}, c AS (SELECT path, line::VARCHAR AS line, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, line)::INTEGER AS place FROM c) SELECT * FROM p WHERE place <= 3",
    "merged_intervals": f"""WITH {_HITS}, r AS (SELECT path, "index" AS s, "index" + 80 AS e FROM f), m AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY s, e) AS k FROM m) SELECT path, min(s)::INTEGER AS start, max(e)::INTEGER AS "end" FROM i GROUP BY path, k""",
    "multiset_difference": f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY path, side, x) AS k FROM l), o AS (SELECT * FROM n WHERE side = 'old'), w AS (SELECT * FROM n WHERE side = 'new'),
j AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.x IS NULL THEN 'added' WHEN w.x IS NULL THEN 'removed' ELSE 'persisted' END AS status FROM o FULL OUTER JOIN w ON o.path = w.path AND o.x = w.x AND o.k = w.k) SELECT path, status, count(*) AS n FROM j GROUP BY 1, 2""",
    "run_diff": f"WITH {_LINES}, g AS (SELECT path, length(x)::INTEGER AS line, count(*) FILTER (side = 'old') AS n_old, count(*) FILTER (side = 'new') AS n_new FROM l GROUP BY 1, 2) SELECT *, n_new - n_old AS delta FROM g",
    "label_evaluation": """WITH d AS (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), r AS (SELECT lang, (len(ls) > len(list_distinct(ls)))::INT AS p, (quality = 0)::INT AS e FROM d JOIN labels USING (doc_id)),
g AS (SELECT lang, sum(p * e)::BIGINT AS tp, sum(p * (1 - e))::BIGINT AS fp, sum((1 - p) * e)::BIGINT AS fn FROM r WHERE p + e > 0 GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1 FROM g""",
    "line_kinds": r"""WITH l AS (SELECT lang, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) SELECT lang, CASE WHEN regexp_matches(l, '^\s*$') THEN 'blank' WHEN regexp_matches(l, '^\s{0,3}#{1,6}\s+\S') THEN 'heading' WHEN regexp_matches(l, '^\s*\|.*\|\s*$') THEN 'table'
WHEN regexp_matches(l, '^\s*(?:\d+[.)]|[*+-])\s+\S') THEN 'list' WHEN regexp_matches(l, '^\s{0,3}>\s?') THEN 'quote' WHEN regexp_matches(l, '^\s{0,3}(?:[*_-]\s*){3,}$') THEN 'thematic' ELSE 'normal' END AS kind, count(*) AS n, sum(length(l))::BIGINT AS chars FROM l GROUP BY 1, 2""",
    "extract_pages": _extract_sql(),
    "replies_by_role": "WITH c AS (SELECT role, conv_id, turn, len(regexp_extract_all(text, ' the | and ')) AS k FROM conversations) SELECT role, sum(k)::BIGINT AS n, count(DISTINCT conv_id || '/' || turn) FILTER (k > 0) AS turns FROM c GROUP BY role HAVING sum(k) > 0",
    "profile_enabled": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}::BIGINT)" for p, n in zip(PROFILE_CONFIGS, (5, 25, 24, 18, 21, 26, 26, 26, 26))) + ") AS v(profile, n)",
}
QUERIES: dict[str, Query] = {f"rule_{r.replace('-', '_')}": rule_query(r) for r in RULES} | {
    f.__name__: f
    for f in (
        find_words, collapse_findings, summary_counts, top_lines, merged_intervals, multiset_difference, run_diff, label_evaluation, line_kinds, extract_pages, replies_by_role, catalogue_rules, profile_matrix, profile_enabled, profile_issues,
    )
}
