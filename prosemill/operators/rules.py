"""The rules as column expressions over a prepared document: text, masked, sentences, paragraphs, blocks.

A rule takes its options and gives an array of findings for its row; nothing is exploded or shuffled until all rules
of a row have run. Rules that need order or adjacent text across markup are in context_rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsregex import any_literal, any_pattern, begins, escape, java, strings
from ..functions.lexicons import LEXICONS
from ..functions.textops import FINDING, count_all, find_all, has_evidence, let, matches, piece, strip_urls, trim, visible

Options = dict


def none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def finding(index: Column, length: Column, message: Column | str, severity: Column | None = None) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    s = F.lit(None).cast("string") if severity is None else severity
    return F.struct(index.cast("long").alias("index"), length.cast("long").alias("length"), m.alias("message"), s.alias("severity"))


def texts(words: list[str]) -> Column:
    """An array of texts, made in one call."""
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def span(x: Column) -> Column:
    return F.least(x["end"] - x["start"], F.lit(80))


def literals(words, message: str, text: str = "masked") -> Column:
    p = any_literal(words)
    return F.transform(find_all(F.col(text), p), lambda m: finding(m["at"], F.length(m["text"]), message)) if p else none()


def paragraphs_over(test: Callable[[Column], Column], count: Callable[[Column], Column], most: int, message: str) -> Column:
    """A finding for each paragraph that passes the test and counts more than most."""
    some = F.transform("paragraphs", lambda p: F.struct(p.alias("p"), count(p["text"]).alias("n")))
    return F.transform(F.filter(some, lambda x: (x["n"] > most) & test(x["p"])), lambda x: finding(x["p"]["start"], span(x["p"]), F.format_string(message, x["n"])))


def yes(_: Column) -> Column:
    return F.lit(True)


def hidden_unicode_controls(o: Options) -> Column:
    return F.transform(find_all(F.col("text"), begins("\u200b\ufeff") + "[\\u200B-\\u200D\\u2060\\uFEFF\\u202A-\\u202E\\u2066-\\u2069]"), lambda m: finding(m["at"], F.length(m["text"]), "見えない制御文字です。混入したものなら削ってください。"))


def list_intro_padding(o: Options) -> Column:
    return literals(o["phrases"], "前置きの働きが薄いようです。削っても通じるか確認してください。")


def empty_conclusion(o: Options) -> Column:
    return literals(o["patterns"], "中身の薄い結びです。具体的な結論に替えられるか確認してください。")


def _line(text: Column, at: Column, stops: str) -> tuple[Column, Column]:
    """The parts of a line (or whatever ends at the stops) before and after a place."""
    return _last(piece(text, F.lit(0), at), stops), _first(piece(text, at, F.length(text)), stops)


def _last(text: Column, stops: str) -> Column:
    """What comes after the last stop, looked for from the starts of runs only."""
    return F.regexp_extract(text, f"(?<![^{stops}])[^{stops}]*+\\z", 0)


def _first(text: Column, stops: str) -> Column:
    return F.regexp_extract(text, f"\\A[^{stops}]*+", 0)


def _in_quote(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for a, b in ("「」", "『』", "“”", "‘’"):
        out = out | (before.rlike(f"{a}[^{b}]*\\z") & after.contains(b))
    return out


def chat_response_leakage(o: Options) -> Column:
    p = any_literal(o["phrases"])
    if not p:
        return none()
    marker = "フレーズ|言い回し|文字列|表記|引用|サンプル|ひな形|テンプレート|記入例|回答例|文例|例"
    told = "という|と示す|と説明|として(?:説明|挙げる|示す)|から始まる|で始まる|を(?:説明|引用|例示)"

    def kept(m: Column) -> Column:
        head, _ = _line(F.col("masked"), m["at"], "\\n\\r")
        _, tail = _line(F.col("masked"), m["at"] + F.length(m["text"]), "\\n\\r")

        def line(x: Column) -> Column:
            rest = _first(x["tail"], "。！？!?\\n\\r")
            return ~(_in_quote(x["head"], x["tail"]) | (rest.rlike(told) & F.concat(_last(x["head"], "。！？!?\\n\\r"), m["text"], rest).rlike(marker)))

        return let(F.struct(head.alias("head"), tail.alias("tail")), line)

    return F.transform(F.filter(find_all(F.col("masked"), p), kept), lambda m: finding(m["at"], F.length(m["text"]), "対話の応答が残ったように見えます。本文に要る情報だけを残してください。"))


def _prose(text: Column) -> Column:
    """A sentence without markup that readers don't see: links, tags, templates, wiki links."""
    return let(F.regexp_replace(strip_urls(text), r"</?[a-zA-Z][^>]*>", ""), lambda t: let(_untemplated(t), _unbraced))


def _untemplated(t: Column) -> Column:
    q = r'"(?:\\.|[^"\\])*+"'
    meta = t
    for p in (rf'"[^"\n]{{1,80}}"\s*:\s*\{{\s*"wt"\s*:\s*{q}\s*\}}', rf'\{{\s*"wt"\s*:\s*{q}\s*\}}', rf'"[^"\n]{{1,80}}"\s*:\s*{q}', r'(?:^|[\s,{}\[\]])"i"\s*:\s*\d+(?:[\s,{}\[\]])*', r'[{}\[\],":<>]+'):
        meta = F.regexp_replace(meta, java(p), " ")
    return F.when(t.rlike(java(r'"\s*,\s*"i"\s*:|"\s*:\s*\{\s*"wt"\s*:')), meta).otherwise(t)


def _unbraced(t: Column) -> Column:
    def braces(x: Column) -> Column:
        parts = F.split(x, r"(?<=\{\{)|(?=\{\{)|(?<=\}\})|(?=\}\})", -1)
        start = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))

        def step(a: Column, v: Column) -> Column:
            opens, closes = v == "{{", (v == "}}") & (a["d"] > 0)
            return F.struct((a["d"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("d"), F.when(~opens & ~closes & (a["d"] == 0), F.concat(a["out"], v)).otherwise(a["out"]).alias("out"))

        return F.aggregate(parts, start, step, lambda a: a["out"])

    t = F.when(t.contains("{{"), braces(t)).otherwise(t)
    t = F.regexp_replace(t, r"(?iu)\[\[\s*(?:ファイル|画像|File|Image|Category|カテゴリ):[^\]\n]*\]\]", "")
    t = F.regexp_replace(t, r"\[\[(?:[^\]\n]*\|)?:*([^\]\n|]*)\]\]", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"__[\p{Lu}0-9_]+__", ""), r"\\[rn]", " ")


def long_sentence(o: Options) -> Column:
    long = F.filter("sentences", lambda s: F.length(s["text"]) > o["maxChars"])  # what readers don't see only shortens it
    sized = F.transform(long, lambda s: F.struct(s.alias("s"), visible(_prose(s["text"])).alias("n")))
    over = F.filter(sized, lambda x: x["n"] > o["maxChars"])
    return F.transform(over, lambda x: finding(x["s"]["start"], span(x["s"]), F.format_string("一文が%d字あります。論点を分けられるか確認してください。", x["n"]), F.when(x["n"] > o["errorChars"], "error")))


def long_paragraph(o: Options) -> Column:
    def countable(s: Column) -> Column:
        t = trim(strip_urls(s["text"]))
        return (visible(t) >= 5) & t.rlike(java(r"[。！？!?][」』”’）)\]】〉》]*\s*$"))

    some = F.filter("paragraphs", lambda p: (F.length(p["text"]) > o["maxChars"]) | (p["sentence_count"] > o["maxSentences"]))  # others can't be over
    counted = F.transform(some, lambda p: F.struct(p.alias("p"), visible(strip_urls(p["text"])).alias("n"), F.size(F.filter("sentences", lambda s: (s["block"] == p["block"]) & countable(s))).alias("m")))
    over = F.filter(counted, lambda x: (x["n"] > o["maxChars"]) | (x["m"] > o["maxSentences"]))
    return F.transform(over, lambda x: finding(x["p"]["start"], span(x["p"]), F.format_string("段落が長めです（%d字、%d文）。分けられるか確認してください。", x["n"], x["m"])))


def _sentence_of(m: Column) -> Column:
    """The first sentence around a match, null if there is none."""
    return F.get(F.filter("sentences", lambda x: (x["start"] <= m["at"]) & (m["at"] < x["end"])), F.lit(0))


def weasel_phrases(o: Options) -> Column:
    lex, p = LEXICONS["weasel-phrases"], any_literal(o["phrases"])
    dense = paragraphs_over(yes, lambda t: count_all(t, p), o["maxPerParagraph"], "責任の所在がぼやける表現が段落に%d件あります。根拠、主体、条件を書けるか確認してください。") if p else none()

    def kept(m: Column) -> Column:
        def judged(x: Column) -> Column:
            head, tail = _line(F.col("text"), m["at"], "\\n")
            table = F.concat(head, F.regexp_replace(tail, "\\r\\z", "")).rlike(java(r"^\s*\|.*\|\s*$"))
            own = x["own"]
            bounded = (m["text"] == "とされている") & matches(own, lex["concreteQuantityPattern"]) & matches(own, lex["policyContextPattern"]) & matches(own, lex["boundaryCuePattern"])
            return ~(has_evidence(x["near"]) | matches(x["near"], lex["evidenceContextPatterns"]) | bounded | table)

        def around(p: Column) -> Column:
            return F.struct(piece(F.col("text"), p["start"] - 30, p["end"] + 30).alias("near"), piece(F.col("text"), p["start"], p["end"]).alias("own"))

        def place(s: Column) -> Column:
            return F.struct(F.coalesce(s["start"], m["at"]).alias("start"), F.coalesce(s["end"], m["at"] + F.length(m["text"])).alias("end"))

        return let(_sentence_of(m), lambda s: let(place(s), lambda p: let(around(p), judged)))

    single = F.filter(find_all(F.col("masked"), begins("と多") + "(?:と(?:考えられ|言われ|され)ている|多くの研究)"), kept)
    return F.concat(dense, F.transform(single, lambda m: finding(m["at"], F.length(m["text"]), "誰の見解か、何に基づくかが見えません。出どころを示せるか確認してください。")))


def _cited(t: Column) -> Column:
    lex = LEXICONS["citation-needed"]
    inside = F.regexp_extract_all(t, F.lit(r"[(（]([^()（）]{1,50}[12][0-9]{3}[^()（）]{0,30})[)）]"), F.lit(1))
    author = F.exists(F.transform(inside, lambda x: F.regexp_replace(x, java(r"\s+"), "")), lambda x: ~x.rlike(r"\A[12][0-9]{3}年?\z") & x.rlike("[A-Za-zぁ-んァ-ン一-龠々]"))
    return matches(t, lex["sourceMarkerPatterns"]) | matches(t, lex["dataEvidencePatterns"]) | author


def citation_needed(o: Options) -> Column:
    lex, p = LEXICONS["citation-needed"], any_literal(o["claimPatterns"])
    if not p:
        return none()
    technical = rf"^(?:最新(?:の)?|現在(?:の)?(?:開いている|実行される|実行中の|表示中の|選択中の|アクティブな)?)[^。！？、,]{{0,18}}(?:{any_literal(lex['technicalStateOrVersionNouns'])})"

    def claims(s: Column) -> Column:
        def real(m: Column) -> Column:
            tail = piece(s["text"], m["at"], F.length(s["text"]))
            drop = ((m["text"] == "現在") & tail.startswith("現在地")) | (~matches(s["text"], lex["timeSensitiveClaimContextPattern"]) & tail.rlike(java(technical)))
            return ~(m["text"].isin("現在", "最新") & drop)

        return F.filter(find_all(s["text"], p), real)

    def near(s: Column, i: Column) -> Column:
        ring = F.filter(F.array(F.when(i > 0, F.get("sentences", i - 1)), F.get("sentences", i + 1)), lambda x: x.isNotNull())
        return F.filter(ring, lambda x: (x["block"] == s["block"]) | (x["section"] == s["section"]))

    def supported(s: Column, i: Column) -> Column:
        t, b = s["text"], F.get("blocks", s["block"])
        bridge = t.rlike(java(r"(?:[。！？、,\s「『（(]|^)(?:学術論文|研究)でも")) & t.rlike("(?:という)?(?:傾向|結果)[^。！？]{0,12}報告されている")
        beside = let(near(s, i), lambda around: F.exists(around, lambda x: _cited(x["text"])) | F.exists(around, lambda x: (x["block"] == s["block"]) & matches(x["text"], lex["sourceNamePatterns"])))
        rest = F.concat(piece(F.col("text"), b["start"], s["start"]), F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")), piece(F.col("text"), s["end"], b["end"]))
        return _cited(t) | matches(t, lex["sourceNamePatterns"]) | bridge | beside | matches(rest, lex["sourceMarkerPatterns"])

    first = F.transform("sentences", lambda s, i: F.when(s["text"].rlike(p), let(claims(s), lambda c: F.when((F.size(c) > 0) & ~supported(s, i), finding(s["start"] + F.get(c, F.lit(0))["at"], F.length(F.get(c, F.lit(0))["text"]), "根拠を要する主張のようです。出典、データ、条件を示せるか確認してください。")))))
    return F.filter(first, lambda x: x.isNotNull())


def unscoped_generalization(o: Options) -> Column:
    p = any_pattern(o["patterns"])
    if not p:
        return none()
    idioms, negations, scopes = (strings(o[k]) for k in ("idiomaticPatterns", "negationPatterns", "scopeMarkerPatterns"))

    def kept(m: Column) -> Column:
        around = piece(F.col("masked"), m["at"] - 4, m["at"] + F.length(m["text"]) + 12)

        def judged(line: Column) -> Column:
            return let(F.coalesce(_sentence_of(m)["text"], line), lambda t: ~(matches(around, idioms) | matches(line, [r"^\s{0,3}#{1,6}\s+\S", r"^\s{0,3}>\s?"]) | matches(t, negations) | matches(t, scopes)))

        return let(F.concat(*_line(F.col("masked"), m["at"], "\\n")), judged)

    return F.transform(F.filter(find_all(F.col("masked"), java(p)), kept), lambda m: finding(m["at"], F.length(m["text"]), "全体についての主張に見えます。範囲、時点、条件を示せるか確認してください。"))


def no_numerics_claim(o: Options) -> Column:
    strong, effect = any_literal(o["intensifiers"]), any_literal(o["effects"])
    if not strong or not effect:
        return none()
    evidence = [*strings(o["numericPatterns"]), *strings(o["comparisonPatterns"])] if o["suppressIfNumericInWindow"] else []
    window = max(0, int(o["evidenceWindowChars"]))

    def hit(s: Column, m: Column) -> Column:
        def judged(tail: Column) -> Column:
            close = F.substring(tail, 1, 12)
            word = F.regexp_extract(close, effect, 0)
            at = F.length(F.get(F.split(close, effect, 2), F.lit(0)))
            between, rest = F.substring(close, F.lit(1), at), piece(tail, at + F.length(word), F.length(tail))
            head = piece(s["text"], F.lit(0), m["at"])
            more = lambda a, b: F.regexp_count(head, F.lit(a)) > F.regexp_count(head, F.lit(b))
            bad = between.rlike("[、，。．；;：:]") | between.rlike("(?:差|違い|意味|意義|特徴|論点|観点|視点|問い|理由|目的|条件|前提)(?:から|として|とは|でも|では|は|が|を|に|も)")
            bad = bad | rest.rlike(r"\A(?:(?:された|される|している|した|する|し)?かどうか|の(?:意味|定義|説明|比較|違い|有無)|でなく|ではなく|という|とは)") | more("「", "」") | more("『", "』")
            plain = let(piece(F.col("masked"), s["start"] - window, s["end"] + window), lambda around: matches(around, evidence) | has_evidence(around))
            return F.when((word != "") & ~(bad | plain), finding(s["start"] + m["at"], F.length(m["text"]) + at + F.length(word), "強める語に対して数値、期間、比べる相手が見えません。補えるか確認してください。"))

        return let(piece(s["text"], m["at"] + F.length(m["text"]), F.length(s["text"])), judged)

    each = F.transform("sentences", lambda s: F.get(F.filter(F.transform(find_all(s["text"], strong), lambda m: hit(s, m)), lambda x: x.isNotNull()), F.lit(0)))
    return F.filter(each, lambda x: x.isNotNull())


def abstract_noun_stack(o: Options) -> Column:
    p = any_literal(o["abstractWords"])
    if not p:
        return none()
    hits = F.transform("sentences", lambda s: F.struct(s.alias("s"), F.regexp_extract_all(s["text"], F.lit(p), F.lit(0)).alias("h")))
    return F.transform(F.filter(hits, lambda x: F.size(x["h"]) >= o["minHits"]), lambda x: finding(x["s"]["start"], span(x["s"]), F.concat(F.lit("抽象的な語が重なっています（"), F.array_join(F.slice(F.array_distinct(x["h"]), 1, 6), "、"), F.lit("）。具体例や数値を足せるか確認してください。"))))


def nominalization_density(o: Options) -> Column:
    p = "[ぁ-んァ-ン一-龠々]{1,10}(?:[性化的感力度論観像]|性質)"
    hits = F.transform(F.filter("sentences", lambda s: (F.length(s["text"]) >= o["minChars"]) & (visible(s["text"]) >= o["minChars"])), lambda s: F.struct(s.alias("s"), F.regexp_extract_all(s["text"], F.lit(p), F.lit(0)).alias("h")))
    return F.transform(F.filter(hits, lambda x: F.size(x["h"]) >= o["minHits"]), lambda x: finding(x["s"]["start"], span(x["s"]), F.concat(F.lit("名詞化が重なっています（"), F.array_join(F.slice(x["h"], 1, 6), "、"), F.lit("）。動詞で言えるか確認してください。"))))


def excessive_politeness(o: Options) -> Column:
    dense = paragraphs_over(yes, lambda t: count_all(t, "でございます|ございます|させていただ"), o["maxSasetePerParagraph"], "丁寧な言い回しが段落に%d件あります。誰が何をするかが読めるか確認してください。")
    return F.concat(dense, literals(["させていただきたく存じます", "させていただくこととなりました"], "敬語が重なっています。行動と依頼が読めるか確認してください。"))


def actorless_action(o: Options) -> Column:
    p = any_pattern(o["actionPatterns"])
    if not p:
        return none()
    particle = "(?:から|により|として|で|が|は)"
    owners = any_literal(o["ownerTerms"])
    role = rf"[一-龠A-Za-z0-9０-９]{{1,16}}(?:会社|学校|自治体|事務局|職員|教員|担当者|担当|チーム|委員会|局|室|係|課|部){particle}"
    deadline = o["deadlinePattern"][0] if isinstance(o["deadlinePattern"], list) else o["deadlinePattern"]
    sources = any_literal(o["reportedDirectionSourceTerms"])

    def open_(s: Column) -> Column:
        t = s["text"]
        owned = matches(t, [role] + ([f"(?:{owners}){particle}"] if owners else []))
        excluded = F.lit(False)
        for x in strings(o["contextExclusions"]):
            excluded = excluded | t.contains(x)
        return t.rlike(java(p)) & (visible(t) >= o["minChars"]) & ~excluded & ~(owned & (matches(t, [deadline]) if isinstance(deadline, str) and deadline else F.lit(False)))

    def told(s: Column) -> Column:
        def kept(m: Column) -> Column:
            if not sources:
                return F.lit(True)
            after = piece(s["text"], m["at"] + F.length(m["text"]), F.length(s["text"]))
            return ~(piece(s["text"], F.lit(0), m["at"]).rlike(f"(?:{sources})(?:によると|にも|には|では|で)") & after.rlike(java(r"^[^。！？\n]{0,40}[、,]\s*という方向性[もがは]?書かれてい(?:ました|ます|た|る)")))

        return F.transform(F.filter(find_all(s["text"], java(p)), kept), lambda m: finding(s["start"] + m["at"], F.length(m["text"]), "誰がいつまでに行うかが見えません。主体、期限、基準を補えるか確認してください。"))

    return F.flatten(F.transform(F.filter("sentences", open_), told))


def translationese(o: Options) -> Column:
    p = any_literal(o["densityPatterns"])
    dense = paragraphs_over(yes, lambda t: count_all(t, p), o["maxPerParagraph"], "重い言い回しが段落に%d件あります。簡潔にできるか確認してください。") if p else none()
    return F.concat(literals(o["directPatterns"], "重くなりやすい言い回しです。まっすぐに書けるか確認してください。"), dense)


def buzzword_density(o: Options) -> Column:
    p = any_literal(o["buzzwords"])
    return paragraphs_over(yes, lambda t: count_all(t, p), o["maxPerParagraph"], "流行の語が段落に%d件あります。実際の中身や指標を示せるか確認してください。") if p else none()


def thin_sentence(o: Options) -> Column:
    p, vague = any_literal(o["vaguePredicates"]), strings(o["vaguePredicates"])
    if not p:
        return none()
    times = lambda t, words: F.aggregate(texts(strings(words)), F.lit(0.0), lambda a, w: a + (F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w))
    opens, closes = "「『“", "」』”"

    def concession(t: Column) -> Column:
        out = F.lit(False)
        if o["concessionConnectorExclusion"]:
            for v in vague:
                tail = F.when(t.contains(v), F.regexp_extract(t, f"(?s)\\A.*?{escape(v)}(.*)\\z", 1))
                for c in strings(o["concessionConnectors"]):
                    out = out | F.coalesce(visible(F.regexp_extract(tail, f"(?s)\\A.*?{escape(c)}(.*)\\z", 1)) >= 6, F.lit(False))
        return out

    def thin(s: Column) -> Column:
        t = s["text"]
        pairs = count_all(t, f"[{opens}][^{opens}{closes}]+[{closes}]")
        frame = F.lit(False)
        if o["specificConditionalExclusion"]:
            said = F.lit(False)
            for x in strings(o["specificConditionalPredicates"]):
                said = said | t.contains(x)
            frame = t.rlike("(?:時|際|とき|なら|場合|と)[、，]") & said & (times(t, o["roleNounPatterns"]) >= 1)
        bullet = t.rlike(java(r"^\s*(?:[*+-]\s+)?\*\*[^*]+?\*\*\s*[:：]")) if o["bulletLeadExclusion"] else F.lit(False)
        shape = F.least((count_all(t, "[一-龯々]{4,}") + count_all(t, "[ァ-ヶ][ァ-ヶー]{2,}") + count_all(t, "[A-Z][A-Z]+")) * 2, F.lit(2))
        quick = t.rlike(p) & (visible(t) >= o["minChars"]) & ~t.rlike("[0-9０-９]") & ~has_evidence(t) & ~t.rlike("[A-ZＡ-Ｚ]{2,}|[一-龠]{2,}(?:株式会社|委員会|研究所|機構|高専|大学|社|庁|省)")
        slow = ~bullet & ~t.rlike(f"[{opens}][^{opens}{closes}]*?(?:{p})[^{opens}{closes}]*?[{closes}]") & ~concession(t) & ~frame & (pairs < 2) & (shape + times(t, o["concreteNounPatterns"]) + pairs < o["concreteScoreThreshold"])
        return F.when(quick, slow).otherwise(F.lit(False))

    def told(s: Column) -> Column:
        word = F.regexp_extract(s["text"], p, 0)
        return finding(s["start"] + F.length(F.get(F.split(s["text"], p, 2), F.lit(0))), F.length(word), "具体的な情報が少ないようです。例、対象、数値、根拠を足せるか確認してください。")

    return F.transform(F.filter("sentences", thin), told)


def excessive_parentheses(o: Options) -> Column:
    num = lambda v: v if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    glossary = any_pattern(o["glossaryParenPattern"])
    limit = num(o.get("maxPairsPerParagraph")) if num(o.get("maxPairsPerParagraph")) is not None else num(o["maxEffectivePairsPerParagraph"])
    total, floor, dense, inner = num(o["maxTotalPairsPerParagraph"]), num(o["minDensePairsPerParagraph"]) or 5, num(o["minEffectivePairsInDenseParagraph"]) or 3, num(o["maxGlossaryInnerLength"]) or 25

    def effective(t: Column, m: Column) -> Column:
        body = trim(F.substring(m["text"], F.lit(2), F.length(m["text"]) - 2))
        before = piece(t, m["at"] - 1, m["at"])
        return ~((body == "") | (body.rlike(java(f"(?:{glossary})")) if glossary else F.lit(False)) | (before.rlike("[A-Za-z0-9）)]") & (F.length(body) <= inner)))

    pairs = F.transform("paragraphs", lambda p: let(find_all(p["text"], r"[（(][^）)]{1,80}[）)]"), lambda ms: F.struct(p.alias("p"), F.size(ms).alias("n"), F.size(F.filter(ms, lambda m: effective(p["text"], m))).alias("e"))))
    off = F.lit(False)
    a = (lambda x: x["e"] > limit) if limit is not None else lambda x: off
    b = (lambda x: (x["n"] > total) & (x["e"] > 0)) if total is not None else lambda x: off
    over = F.filter(pairs, lambda x: (x["n"] > 0) & (a(x) | b(x) | ((x["n"] >= floor) & (x["e"] >= dense))))

    def message(x: Column) -> Column:
        kind = F.when(a(x) & b(x), "補足、総数とも").when(a(x), "補足").when(b(x), "総数").otherwise("密集")
        return F.format_string("括弧が多めです（%s：%d組、うち補足%d組）。本文で整理できるか確認してください。", kind, x["n"], x["e"])

    return F.transform(over, lambda x: finding(x["p"]["start"], span(x["p"]), message(x)))


def headline_decoration(o: Options) -> Column:
    glyph = "(?:[◎●□■◇◆☆★✨]|\\uE102\\uE103|\\uE104\\uE105)+"
    p = begins("#■✨\ue105") + java(rf"^(?:#{{1,6}}\s*)?(?:{glyph}\s*){{2,}}.+$", multiline=True)
    return F.transform(find_all(F.col("masked"), p), lambda m: finding(m["at"], F.least(F.length(m["text"]), F.lit(80)), "見出しの飾りが目立ちます。媒体と読者に合うか確認してください。"))


def over_possibility(o: Options) -> Column:
    words = strings(o["possibilityPhrases"])
    plain, koto = any_literal([w for w in words if w != "ことがある"]), "ことがある" in words
    if not words:
        return none()
    count = lambda t: (count_all(t, plain) if plain else F.lit(0)) + (count_all(t, "(?<![だた])ことがある") if koto else F.lit(0))
    test = lambda p: (visible(p["text"]) >= o["minParagraphChars"]) & ~p["text"].startswith(">") & ~matches(p["text"], LEXICONS["over-possibility"]["metaPhraseRegex"])
    return paragraphs_over(test, count, o["maxPerParagraph"], "推測の言い方が段落に%d回あります。確かな点とそうでない点を分けられるか確認してください。")


def unclear_deictic(o: Options) -> Column:
    words = any_literal(sorted(strings(o["deicticPhrases"]), key=lambda w: -len(w)))
    if not words:
        return none()
    p = f"(?:{words})(?!{any_literal(['ら', *strings(o['fixedPhraseTails'])])})"
    test = lambda x: ~x["text"].startswith(">") & (visible(x["text"]) >= o["minParagraphChars"])
    return paragraphs_over(test, lambda t: count_all(t, p), o["maxPerParagraph"], "指示語が段落に%d回あります。指す名詞を書けるか確認してください。")


COLUMN_RULES: dict[str, Callable[[Options], Column]] = {
    f.__name__.replace("_", "-"): f
    for f in (
        hidden_unicode_controls, chat_response_leakage, list_intro_padding, long_sentence, long_paragraph, empty_conclusion, weasel_phrases, citation_needed, unscoped_generalization, no_numerics_claim, abstract_noun_stack,
        nominalization_density, excessive_politeness, actorless_action, translationese, buzzword_density, thin_sentence, excessive_parentheses, headline_decoration, over_possibility, unclear_deictic,
    )
}
