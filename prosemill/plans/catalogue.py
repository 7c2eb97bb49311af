"""The rules, their defaults and the profiles, as data and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lexicons import LEXICONS

NAMESPACE = "prosemill"
PROFILES = "minimal general business technical research public web agent-output strict".split()

#: rule: category, severity in the catalogue, what it is for. In the order in which rules run.
RULES: dict[str, tuple[str, str, str]] = {
    "hidden-unicode-controls": ("surface-readability", "error", "見えない制御文字を見つける"),
    "placeholder": ("agent-artifacts", "error", "未記入や仮の目印を見つける"),
    "chat-response-leakage": ("agent-artifacts", "warning", "対話の応答が残った箇所を見つける"),
    "list-intro-padding": ("style-drift", "info", "働きの薄い前置きを見つける"),
    "long-sentence": ("surface-readability", "warning", "長すぎる文を見つける"),
    "long-paragraph": ("surface-readability", "warning", "重い段落を見つける"),
    "empty-conclusion": ("style-drift", "warning", "中身の薄い結びを見つける"),
    "weasel-phrases": ("evidence-responsibility", "warning", "責任の所在がぼやける表現を見つける"),
    "citation-needed": ("evidence-responsibility", "warning", "根拠を要する主張を見つける"),
    "absolute-claim": ("evidence-responsibility", "warning", "強い言い切りを見つける"),
    "unscoped-generalization": ("evidence-responsibility", "warning", "範囲のない一般化を見つける"),
    "no-numerics-claim": ("evidence-responsibility", "warning", "数値のない強調を見つける"),
    "abstract-noun-stack": ("semantic-density", "warning", "抽象語の重なりを見つける"),
    "nominalization-density": ("semantic-density", "warning", "名詞化の重なりを見つける"),
    "excessive-politeness": ("agency-action", "warning", "敬語の重なりを見つける"),
    "actorless-action": ("agency-action", "warning", "主体の見えない対応を見つける"),
    "deadline-missing": ("agency-action", "warning", "期限の見えない対応を見つける"),
    "same-ending": ("surface-readability", "info", "同じ文末の連続を見つける"),
    "repeated-connectors": ("surface-readability", "info", "接続語の反復を見つける"),
    "translationese": ("style-drift", "info", "重い言い回しを見つける"),
    "buzzword-density": ("semantic-density", "info", "流行語の密集を見つける"),
    "thin-sentence": ("semantic-density", "warning", "具体情報の少ない文を見つける"),
    "excessive-parentheses": ("surface-readability", "info", "括弧補足の多さを見つける"),
    "headline-decoration": ("surface-readability", "info", "見出しの飾りを見つける"),
    "over-possibility": ("style-drift", "info", "推測表現の多用を見つける"),
    "unclear-deictic": ("style-drift", "info", "指示語の多用を見つける"),
}
#: The default severity of a run, where it isn't that of the catalogue.
RUN_SEVERITY = {"over-possibility": "warning"}
ALLOW_TERM_RULES = ("absolute-claim", "citation-needed", "placeholder", "chat-response-leakage", "list-intro-padding", "empty-conclusion")

NUMBERS: dict[str, dict] = {
    "long-sentence": {"maxChars": 110, "errorChars": 170}, "long-paragraph": {"maxChars": 420, "maxSentences": 5}, "weasel-phrases": {"maxPerParagraph": 3},
    "no-numerics-claim": {"evidenceWindowChars": 50, "suppressIfNumericInWindow": True}, "abstract-noun-stack": {"minHits": 4}, "nominalization-density": {"minHits": 6, "minChars": 60},
    "excessive-politeness": {"maxSasetePerParagraph": 2}, "actorless-action": {"minChars": 12}, "deadline-missing": {"minSentenceChars": 20}, "same-ending": {"consecutive": 4},
    "repeated-connectors": {"window": 6, "minRepeats": 3}, "translationese": {"maxPerParagraph": 4}, "buzzword-density": {"maxPerParagraph": 4},
    "thin-sentence": {"minChars": 35, "bulletLeadExclusion": True, "concessionConnectorExclusion": True, "specificConditionalExclusion": True, "concreteScoreThreshold": 3},
    "excessive-parentheses": {"maxEffectivePairsPerParagraph": 4, "maxTotalPairsPerParagraph": 9, "minDensePairsPerParagraph": 5, "minEffectivePairsInDenseParagraph": 3, "maxGlossaryInnerLength": 25, "maxPairsPerParagraph": None},
    "over-possibility": {"maxPerParagraph": 2, "minParagraphChars": 100}, "unclear-deictic": {"maxPerParagraph": 3, "minParagraphChars": 80},
}
_FIXED = {"metaPhraseRegex", "sourceMarkerPatterns", "dataEvidencePatterns", "sourceNamePatterns", "technicalStateOrVersionNouns", "timeSensitiveClaimContextPattern", "evidenceContextPatterns", "policyContextPattern", "boundaryCuePattern", "concreteQuantityPattern"}

_MATRIX = """
hidden-unicode-controls ; E ; E ; E ; E ; E ; E ; E ; E ; E
placeholder ; E ; E ; E ; E ; E ; E ; E ; E ; E
chat-response-leakage ; W ; W ; W ; W ; W ; W ; W ; W ; W
list-intro-padding ; - ; I ; I ; I ; - ; I ; W ; W ; W
long-sentence ; W maxChars=140,errorChars=220 ; W maxChars=110,errorChars=170 ; W maxChars=110,errorChars=170 ; W maxChars=100,errorChars=160 ; W maxChars=130,errorChars=220 ; W maxChars=100,errorChars=160 ; W maxChars=110,errorChars=170 ; W maxChars=110,errorChars=170 ; W maxChars=90,errorChars=140
long-paragraph ; I maxChars=650,maxSentences=8 ; W maxChars=420,maxSentences=5 ; W maxChars=380,maxSentences=5 ; W maxChars=360,maxSentences=5 ; W maxChars=520,maxSentences=7 ; W maxChars=360,maxSentences=5 ; W maxChars=420,maxSentences=5 ; W maxChars=420,maxSentences=5 ; W maxChars=320,maxSentences=4
empty-conclusion ; - ; W ; W ; - ; W ; W ; W ; W ; W
weasel-phrases ; - ; W maxPerParagraph=3 ; W maxPerParagraph=2 ; - ; W maxPerParagraph=3 ; W maxPerParagraph=2 ; W maxPerParagraph=3 ; W maxPerParagraph=3 ; W maxPerParagraph=1
citation-needed ; - ; W ; W ; W ; W ; W ; W ; I ; W
absolute-claim ; - ; W ; W ; W ; W ; W ; W ; W ; W
unscoped-generalization ; - ; W ; W ; W ; E ; W ; W ; W ; E
no-numerics-claim ; - ; I ; W ; W ; E ; W ; W ; W ; E
abstract-noun-stack ; - ; W minHits=4 ; W minHits=4 ; W minHits=4 ; W minHits=4 ; W minHits=4 ; W minHits=4 ; W minHits=3 ; W minHits=3
nominalization-density ; - ; W minHits=6,minChars=60 ; W minHits=6,minChars=60 ; W minHits=6,minChars=60 ; W minHits=7,minChars=70 ; W minHits=6,minChars=60 ; W minHits=6,minChars=60 ; W minHits=5,minChars=60 ; W minHits=5,minChars=50
excessive-politeness ; - ; W maxSasetePerParagraph=2 ; W maxSasetePerParagraph=2 ; - ; - ; W maxSasetePerParagraph=2 ; I ; W maxSasetePerParagraph=2 ; W maxSasetePerParagraph=1
actorless-action ; - ; W ; W ; I ; I ; W ; I ; W ; W
deadline-missing ; - ; W ; W ; W ; W ; W ; W ; W ; E
same-ending ; - ; I ; - ; - ; - ; I ; W ; W ; W
repeated-connectors ; - ; I ; I ; - ; I ; I ; W ; W ; W
translationese ; - ; I ; I ; I ; I ; W ; I ; I ; W maxPerParagraph=3
buzzword-density ; - ; I ; W maxPerParagraph=3 ; - ; W maxPerParagraph=3 ; W maxPerParagraph=3 ; W maxPerParagraph=3 ; W maxPerParagraph=3 ; W maxPerParagraph=2
thin-sentence ; - ; W ; W ; - ; W ; W ; W ; W ; W
excessive-parentheses ; - ; I ; I ; I ; I ; I ; I ; I ; W
headline-decoration ; - ; I ; - ; - ; - ; I ; W ; I ; W
over-possibility ; - ; I ; W ; W ; W ; W ; W ; W ; E
unclear-deictic ; - ; - ; W ; W ; - ; W ; W ; W ; E
"""


def default_options(rule: str) -> dict:
    lists = {} if rule == "placeholder" else {k: v for k, v in LEXICONS.get(rule, {}).items() if k not in _FIXED}
    return lists | NUMBERS.get(rule, {})


def default_severity(rule: str) -> str:
    return RUN_SEVERITY.get(rule, RULES[rule][1])


def _profiles() -> dict[str, dict]:
    out: dict[str, dict] = {p: {"rules": {}} for p in PROFILES}
    for line in _MATRIX.strip().split("\n"):
        rule, *cells = [c.strip() for c in line.split(";")]
        for p, cell in zip(PROFILES, cells):
            letter, _, numbers = cell.partition(" ")
            options = {k: int(v) for k, v in (x.split("=") for x in numbers.split(",") if x)}
            severity = {"E": "error", "W": "warning", "I": "info", "-": False}[letter]
            out[p]["rules"][f"{NAMESPACE}/{rule}"] = [severity, options] if options else severity
    return out


PROFILE_CONFIGS = _profiles()


def rules(spark: SparkSession) -> DataFrame:
    """The catalogue: a row for each rule."""
    rows = [(f"{NAMESPACE}/{r}", r, c, s, default_severity(r), g, sum(PROFILE_CONFIGS[p]["rules"][f"{NAMESPACE}/{r}"] is not False for p in PROFILES)) for r, (c, s, g) in RULES.items()]
    return spark.createDataFrame(rows, "rule_id string, short_id string, category string, catalogue_severity string, severity string, goal string, n_profiles int")


def profile_rules(spark: SparkSession) -> DataFrame:
    """profile x rule: enabled, severity, options."""
    rows = []
    for p in PROFILES:
        for full, v in PROFILE_CONFIGS[p]["rules"].items():
            severity, options = (v[0], v[1]) if isinstance(v, list) else (v, {})
            rows.append((p, full.split("/")[1], severity is not False, severity or None, {k: str(x) for k, x in options.items()}))
    return spark.createDataFrame(rows, "profile string, rule_id string, enabled boolean, severity string, options map<string,string>")
