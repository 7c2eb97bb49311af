"""The rules whose decisions depend on order or on adjacent text across markup: they run on a Document, in the preparation's Arrow batch.

Each yields (index, length, message).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import regex

from ..functions.jsregex import any_literal, any_pattern, strings
from ..functions.lexicons import LEXICONS
from .markdown import SPACE, Document, rx, trim

Finding = tuple[int, int, str]
_LEX = {k: LEXICONS[k] for k in ("placeholder", "absolute-claim", "deadline-missing")}
STOP = "[。！？!?\n\r]"
MARK = "\ue000\ue001"


def line_at(text: str, at: int) -> tuple[int, int]:
    start = text.rfind("\n", 0, max(0, at - 1) + 1) + 1
    end = text.find("\n", at)
    return start, len(text) if end < 0 else end


def bounds(text: str, at: int, stops: str) -> tuple[int, int]:
    start = at
    while start > 0 and text[start - 1] not in stops:
        start -= 1
    end = at
    while end < len(text) and text[end] not in stops:
        end += 1
    return start, end


def in_quote(before: str, after: str) -> bool:
    return any(before.rfind(o) > before.rfind(c) and c in after for o, c in ("「」", "『』", "“”", "‘’"))


def sentence_span(text: str, at: int) -> tuple[int, int]:
    a, b = bounds(text, at, "。！？!?\n\r")
    return a, min(b + 1, len(text))


def quoted_or_example(text: str, at: int, n: int, marker: str, explained: str) -> bool:
    a, b = bounds(text, at, "\n\r")
    if in_quote(text[a:at], text[at + n : b]):
        return True
    a, b = sentence_span(text, at)
    return bool(rx(marker).search(text[a:b]) and rx(explained).search(text[at + n : b]))


EXAMPLE = "サンプル|テンプレート|ひな形|プレースホルダ|ラベル|引用|文字列|欄名|表記|記入例|項目名|例"
EXPLAINED = "という|と示す|と説明|として(?:挙げる|示す|説明)|を(?:例示|引用|説明)"
REAL = "(?:実データ|本番値|正式な値)"


def _coded(text: str) -> bool:
    sep, item = "、，,", "[^、，,]{1,24}"
    both = lambda p: all(rx(p.replace("#", d)).search(text) for d in ("1１", "0０"))
    return both(rf"(?:[{sep}]\s*|^)[#]\s*?なら\s*{item}(?=[{sep}]|$)") or both(rf"(?:[{sep}]\s*|^)[^{sep}=＝:：]{{1,24}}\s*[=＝:：]\s*[#](?=[{sep}]|$)")


def _statistical(doc: Document, at: int, n: int) -> bool:
    lex, (lo, hi) = _LEX["placeholder"], sentence_span(doc.masked, at)
    view = doc.adjacency
    relation = rx(lex["STATISTICAL_DUMMY_RELATION_PATTERN"][0])
    after, complete = view.after(at + n, 192, hi)
    if rx(rf"{REAL}の代(?:わり|替)(?:として|に){SPACE}*$").search(view.before(at, 48, lo)):
        return False
    if rx(rf"^(?:変数)?(?:の値)?[はを]?{SPACE}*(?:のちに|後で)?{SPACE}*{REAL}[にへ]{SPACE}*(?:置き換え|差し替)").search(view.after(at + n, 96, hi)[0]):
        return False
    if rx(rf"(?:カテゴリー|カテゴリ)変数から{SPACE}*$").search(view.before(at, 32, lo)) and rx(rf"^変数を{SPACE}*作成").search(view.after(at + n, 16, hi)[0]):
        return True
    if rx("^(?:コード化|コーディング|符号化)").search(after) or rx(lex["STATISTICAL_DUMMY_ITEM_SUFFIX_PATTERN"][0]).search(after):
        return True
    if complete and rx(rf"^項{SPACE}*$").search(after):
        return True
    if rx(rf"^変数に{SPACE}*(?:符号化|変換)").search(after) or after.startswith("変数") and relation.search(after[2:]) or relation.search(after):
        return True
    rest, used = after, 0
    for _ in range(5):
        m = rx(lex["COORDINATED_DUMMY_TERM_PATTERN"][0]).search(rest)
        used += len(m[0]) if m else 0
        if not m or used > 160:
            break
        rest = rest[len(m[0]) :]
        if relation.search(rest):
            return True
    m = rx(r"^[(（]([^)）。！？!?\n\r]{1,80})[)）]\s*([をはがの]\s*[^。！？!?\n\r]{0,24})").search(after)
    return bool(m and _coded(m[1]) and relation.search(m[2]))


def placeholder(doc: Document, options: dict) -> Iterator[Finding]:
    t, lex = doc.masked, _LEX["placeholder"]

    def box(a: int, n: int) -> bool:
        lo, hi = bounds(t, a, "\n\r")
        return bool(rx(r"^\s*(?:\d+[.)]|[*+-])\s*$").search(t[lo:a]) and rx(r"^(?:$|\s)").search(t[a + n : hi]))

    def label(a: int, n: int) -> bool:
        s = doc.text[a : a + n]
        return s.startswith("[") and s.endswith("]") and bool(rx(r"^\([^)\r\n]*\)").search(doc.text[a + n : a + n + 256]))

    found = []
    for m in rx(lex["generalRegex"][0]).finditer(t):
        a, n = m.start(), len(m[0])
        if not (box(a, n) or label(a, n) or quoted_or_example(t, a, n, EXAMPLE, EXPLAINED) or m[0] == "ダミー" and _statistical(doc, a, n)):
            found.append((a, n))
    for m in rx("ここに").finditer(t):
        a, n = m.start(), 3
        after = t[a + n : a + n + 60]
        if box(a, n) or quoted_or_example(t, a, n, EXAMPLE, EXPLAINED) or rx(rf"^{SPACE}*[、，は]").search(after):
            continue
        if rx(lex["KOKONI_COMPLETION_PATTERN"][0]).search(regex.sub(rf"^(?:{SPACE}|[「『])+", "", after)):
            found.append((a, n))
    return ((a, n, "未完成の目印に見えます。公開前に内容を入れるか、削ってください。") for a, n in sorted(found))


def _any(patterns, text: str) -> bool:
    return any(rx(p).search(text) for p in strings(patterns))


def absolute_claim(doc: Document, options: dict) -> Iterator[Finding]:
    o = _LEX["absolute-claim"] | options
    terms = any_literal(o["terms"])
    if not terms:
        return
    t = doc.masked
    bullet = r"^\s{0,3}(?:\d+[.)]|[*+-])\s+"
    for m in rx(terms).finditer(t):
        at, w = m.start(), m[0]
        s = next((x for x in doc.sentences if x["start"] <= at < x["end"]), None)
        lo, hi = line_at(t, at)
        line = t[lo:hi]
        context, start = (s["text"], s["start"]) if s else (line, lo)
        rel = max(0, at - start)
        if _any(o["exclusionPatterns"], context[rel:]) or _any(o["contextExclusionPatterns"], context[max(0, rel - 16) : rel + len(w) + 32]):
            continue
        if line and (_any(o["quoteContextExclusions"], line) or _any(o["headingContextExclusions"], line)):
            continue
        every = w in ("すべて", "全て")
        if every and rx(bullet).search(line) and _any(o["negativeListItemExclusions"], rx(bullet).sub("", line, 1)) and _negative_list(t, lo, o["negativeListContextExclusions"], bullet):
            continue
        around = t[max(0, at - 8) : at + len(w) + 32]
        if _any(o["selfReferentialQuoteExclusions"], around) or _any(o["inlineQuotedConceptExclusions"], around):
            continue
        if any(_any(o[k], context) for k in ("scopedAudienceExclusions", "operationalRequirementExclusions", "boundedProjectStatusExclusions")):
            continue
        beside = lambda b, a: _any(o[b], doc.adjacency.before(at, 32, start)) and _any(o[a], doc.adjacency.after(at + len(w), 32, start + len(context))[0])  # noqa: B023, E731
        if every and beside("boundedQuantityBeforeExclusions", "boundedQuantityAfterExclusions") or _any(o["technicalSpecificationExclusions"], context):
            continue
        if w in ("100%", "１００％") and beside("closedArithmeticPercentageBeforeExclusions", "percentageComparisonAfterExclusions"):
            continue
        near, far = t[at : at + len(w) + 24], t[at : at + len(w) + 96]
        if _any(o["numericMeasureExclusions"], near) or _any(o["hedgedAdverbExclusions"], t[max(0, at - 16) : at + len(w)]) or _any(o["negatedAbsoluteExclusions"], near):
            continue
        if any(_any(o[k], far) for k in ("conditionNounPhraseExclusions", "negatedOutlookExclusions", "technicalSpecificationExclusions")):
            continue
        yield at, len(w), "言い切りの強い表現です。範囲、例外、根拠を添えられるか確認してください。"


def _negative_list(text: str, lo: int, cues, bullet: str) -> bool:
    seen = 0
    for raw in reversed(text[max(0, lo - 1200) : lo].split("\n")):
        seen += len(raw) + 1
        if seen > 1200:
            return False
        if trim(raw) and not rx(bullet).search(raw):
            return _any(cues, trim(rx(r"^\s{0,3}#{1,6}\s+").sub("", raw)))
    return False


def deadline_missing(doc: Document, options: dict) -> Iterator[Finding]:
    o = {"minSentenceChars": 20} | _LEX["deadline-missing"] | options
    union = lambda k: any_pattern(o[k])
    actions = union("actionPredicates")
    if not actions:
        return
    suffix, progress = union("actionSuffixExclusionPatterns"), rx("進め(?:ていく予定|ていく|る予定|る)")
    repeated = sum(len(progress.findall(s["text"])) for s in doc.sentences) >= 2
    test = lambda k, s, head="", tail="": bool(union(k) and rx(f"{head}(?:{union(k)}){tail}").search(s))
    for s in doc.sentences:
        text = s["text"]
        if len(rx(r"\s+").sub("", text)) < o["minSentenceChars"] or s["kind"] == "quote" or any(x in text for x in strings(o["contextExclusions"])):
            continue
        if test("sentenceExclusionPatterns", text) or test("deadlinePatterns", text):
            continue
        for m in rx(actions).finditer(text):
            at, end = s["start"] + m.start(), s["start"] + m.end()
            before, (after, complete) = doc.adjacency.before(at, 32, s["start"]), doc.adjacency.after(end, 24, s["end"])
            head = text[: m.start()]
            if head.count("「") > head.count("」") or head.count("『") > head.count("』"):
                continue
            if test("negationPatterns", after, "^(?:(?:つもり|もの|わけ|予定|こと)(?:では|は|も)?)?"):
                continue
            if suffix:
                if complete:
                    cut = rx(r"[。！？!?](?=\s*$)").sub("", after, 1)
                    if rx(f"^(?:{suffix})").search(after) or cut != after and rx(f"^(?:{suffix})").search(cut):
                        continue
                elif rx(rf"^(?:{suffix})(?=[\s\u0000-￿]*{MARK}$)").search(after + MARK):
                    continue
            if m[0].startswith("対応") and (test("technicalCorrespondenceBeforePatterns", before, "", r"\s*に\s*$") or test("technicalCorrespondenceAfterPatterns", after, "^")):
                continue
            if m[0].startswith("進め"):
                if test("learningProgressContextPatterns", text) and test("learningProgressBeforePatterns", before, "", r"\s*を\s*$") and test("learningProgressAfterPatterns", after, r"^\s*"):
                    continue
                if test("abstractProgressObjects", before, "", r"\s*を\s*$") and not repeated:
                    continue
            yield at, len(m[0]), "期限が読み取れない対応表現です。いつまでに何を終えるかを書けるか確認してください。"


ENDINGS = [("です", "ですか|でしょう|でした|です"), ("ます", "ましょう|ません|ました|ます"), ("である", "であろう|であった|である"), ("だ", "だろう|だった|だ"), ("た/ない", "ない|た")]


def ending(text: str) -> str:
    s = trim(text)
    return next((k for k, p in ENDINGS if rx(rf'(?:{p})[。！？!?”"』）)]*$').search(s)), "")


SPEC = "仕様|設定|形式|入力|出力|無視|各行|コメント|コードフェンス|ルールID|JSON|CLI|API|EOF|schema|profile|manifest|" + r"finding\.index"


def _structural(doc: Document, run: list[dict]) -> bool:
    kinds, n = {s["kind"] for s in run}, len(run)
    source = doc.text[run[0]["raw_start"] : run[-1]["raw_end"]]
    refs = len(rx("`[^`]+`").findall(source))
    if kinds == {"list"}:
        before = [x for x in map(trim, rx(r"\r?\n").split(doc.text[: run[0]["raw_start"]])) if x]
        intro = before[-1] if before else ""
        if rx(r"(?:検出しない例|検出例|修正例|例示|避けたい表現|望ましい表現)[:：]\s*$").search(intro):
            return True
        if rx(r"(?:リリースノート|更新履歴|変更履歴|修正履歴|直近で改善したもの|\d{4}-\d{2}-\d{2}\s*の改善|改善)[:：]?\s*$").search(intro) and refs >= -(-n // 2):
            return True
        label = r"^\s*(?:\d+[.)]|[*+-])\s+(?:[A-Za-z][A-Za-z0-9_-]*|`[^`]+`|[\p{Script=Han}ぁ-んァ-ンA-Za-z0-9_-]{1,24})\s*[:：]"
        labelled = sum(bool(trim(x) and rx(label).search(x)) for x in rx(r"\r?\n").split(source))
        return labelled >= n and bool(rx(SPEC).search(f"{intro}\n{source}"))
    return kinds == {"normal"} and refs >= 3 and bool(rx(SPEC).search(source)) and bool(rx("保存します|固定します|分けます|持たせます|返します|扱いません|無視しません|対象にします|抑制され得ます").search(source))


def same_ending(doc: Document, options: dict) -> Iterator[Finding]:
    least = options.get("consecutive", 4)

    def told(run: list[dict], kind: str) -> Iterator[Finding]:
        if kind and len(run) >= least and not _structural(doc, run):
            yield run[0]["start"], min(run[-1]["end"] - run[0]["start"], 80), f"文末の「{kind}」が{len(run)}文続いています。意図した調子か確認してください。"

    run, kind, section = [], "", None
    for s in doc.sentences:
        e = ending(s["text"])
        if section is not None and s["section"] != section or not e or e != kind:
            yield from told(run, kind)
            run, kind = [], e
        if e:
            run.append(s)
        section = s["section"]
    yield from told(run, kind)


def repeated_connectors(doc: Document, options: dict) -> Iterator[Finding]:
    window, least = options.get("window", 6), options.get("minRepeats", 3)
    runs: dict[int, list[tuple[str, int]]] = {}
    for s in doc.sentences:
        m = rx("^(一方で|また|さらに|しかし|つまり|要するに|したがって|そのため|なお|まず|次に)[,、]").search(trim(s["text"]))
        if m:
            runs.setdefault(s["section"], []).append((m[1], s["start"]))
    for run in runs.values():
        i = 0
        while i <= len(run) - least:
            part = run[i : i + window]
            words = [w for w, _ in part]
            word = next((w for w in dict.fromkeys(words) if words.count(w) >= least), None)
            if word:
                yield part[words.index(word)][1], len(word), f"文頭の「{word}」が近くで繰り返されています。別のつなぎ方ができるか確認してください。"
                i += window - 1
            i += 1


CONTEXT_RULES: dict[str, Callable[[Document, dict], Iterator[Finding]]] = {
    "placeholder": placeholder, "absolute-claim": absolute_claim, "deadline-missing": deadline_missing, "same-ending": same_ending, "repeated-connectors": repeated_connectors,
}
