"""Short texts for the rules that depend on context: each with its rule and the passages that the rule finds in it.

What is expected was written from the rules' descriptions, passage by passage; it is the oracle of the query rule_cases and of a test.
"""

from __future__ import annotations

_SAME = "朝は晴れです。昼は雨です。夜は雪です。風は強いです。"
_PAIRS = "甲（一つ目の説明）と乙（二つ目の説明）と丙（三つ目の説明）と丁（四つ目の説明）と戊（五つ目の説明）を並べる。"

#: (rule, text, passages found)
CASES: list[tuple[str, str, tuple[str, ...]]] = [
    ("absolute-claim", "この手順なら必ず終わります。", ("必ず",)),
    ("absolute-claim", "必ず守り、絶対に破りません。", ("必ず", "絶対に")),
    ("absolute-claim", "強調した**必ず**も見ます。", ("必ず",)),
    ("absolute-claim", "必ず終わるとは限らない。", ()),
    ("absolute-claim", "> 必ず終わります。", ()),
    ("absolute-claim", "# 必ず終わる方法", ()),
    ("absolute-claim", "費用は100%負担します。", ()),
    ("absolute-claim", "ほぼ確実に終わります。", ()),
    ("absolute-claim", "完全に理解することはできない。", ()),
    ("absolute-claim", "三つの値すべてが一致しました。", ()),
    ("absolute-claim", "三つの**値**すべてが**一致**しました。", ()),
    ("absolute-claim", "二値を足すと100%を超える。", ()),
    ("absolute-claim", "`必ず`と書くのは避けます。", ()),
    ("absolute-claim", "保証しないこと\n\n- すべてを一気に改善する\n- 次の話", ()),
    ("absolute-claim", "箱の中身は唯一の品です。", ("唯一",)),
    ("unscoped-generalization", "どんな場面でも役に立つ。", ("どんな場面でも",)),
    ("unscoped-generalization", "常に正しいとは言えないが、常に動作する。", ("常に動作する",)),
    ("unscoped-generalization", "あらゆる手を尽くした。", ()),
    ("unscoped-generalization", "あらゆる条件が満たされるわけではない。", ()),
    ("unscoped-generalization", "本研究では、あらゆる条件を調べた。", ()),
    ("unscoped-generalization", "> いかなる道具も使えます。", ()),
    ("no-numerics-claim", "作業時間は大幅に短くなり、品質は著しく向上した。", ("著しく向上",)),
    ("no-numerics-claim", "品質は著しく向上し、費用は大幅に減少した。", ("著しく向上",)),
    ("no-numerics-claim", "売上は前年比で20%増え、大幅に増加した。", ()),
    ("no-numerics-claim", "大幅に向上したかどうかを確かめる。", ()),
    ("no-numerics-claim", "「劇的に改善」という見出しを付けた。", ()),
    ("no-numerics-claim", "大きな意味は、変化にある。", ()),
    ("actorless-action", "運用の手順を見直すこととする。", ("見直すこととする",)),
    ("actorless-action", "窓口の手順は改善が求められる。手引きの棚は対応を進める。", ("改善が求められる", "対応を進める")),
    ("actorless-action", "担当者は来月までに対応を検討する必要がある。", ()),
    ("actorless-action", "本稿では方針を検討する必要がある。", ()),
    ("actorless-action", "報告書では、検討する必要がある、という方向性が書かれています。", ()),
    ("deadline-missing", "窓口の案内と申し込みの様式を整備する予定で準備しています。", ("整備する",)),
    ("deadline-missing", "来週までに窓口の案内と様式を整備する予定で準備しています。", ()),
    ("deadline-missing", "窓口の案内と申し込みの様式を整備することができるようになりました。", ()),
    ("deadline-missing", "窓口の案内と申し込みの様式を整備するつもりではないと伝えました。", ()),
    ("deadline-missing", "このAPIに対応する要素を画面の上から順に並べて表示します。", ()),
    ("deadline-missing", "> 窓口の案内と申し込みの様式を整備する予定で準備しています。", ()),
    ("deadline-missing", "案内の文面に「様式を整備する」という見出しを付けて印刷に回しました。", ()),
    ("citation-needed", "近年、利用者は増えている。", ("近年",)),
    ("citation-needed", "世界初の装置であり、国内初でもある。", ("世界初",)),
    ("citation-needed", "近年、利用者は30人増えている。", ()),
    ("citation-needed", "近年、利用者は増えている。\n内訳は図1に示す。", ()),
    ("citation-needed", "現在のページを開いてください。", ()),
    ("citation-needed", "総務省によると、近年は減っている。", ()),
    ("citation-needed", "先行研究[1]がある。", ()),
    ("citation-needed", "近年の伸びは大きい（山田 2019）。", ()),
    ("weasel-phrases", "この説は正しいと言われている。", ("と言われている",)),
    ("weasel-phrases", "報道では、この説は正しいと言われている。", ()),
    ("weasel-phrases", "| と言われている | 値 |", ()),
    ("weasel-phrases", "税率は10%以下とされている。", ()),
    ("thin-sentence", "地域の将来を見すえた取り組みを続けていくことは、これからの暮らしを考えるうえで重要である。", ("重要である",)),
    ("thin-sentence", "地域の将来を見すえた取り組みを3年続けていくことは、これからの暮らしを考えるうえで重要である。", ()),
    ("thin-sentence", "地域の訴訟と判決を見すえた取り組みを続けていくことは、これからの暮らしと法律を考えるうえで重要である。", ()),
    ("thin-sentence", "続けることは重要である。", ()),
    ("same-ending", _SAME, (_SAME,)),
    ("same-ending", "朝は晴れです。昼は雨です。夜は雪です。風は強い。", ()),
    ("same-ending", "朝は晴れです。昼は雨です。\n\n夜は雪です。風は強いです。", ()),
    ("repeated-connectors", "また、朝は寒い。また、夜は長い。また、風が強い。", ("また",)),
    ("repeated-connectors", "また、朝は寒い。なお、夜は長い。また、風が強い。", ()),
    ("excessive-parentheses", _PAIRS, (_PAIRS,)),
    ("excessive-parentheses", "甲（ABC）と乙（DEF）と丙（GHI）と丁（JKL）と戊（MNO）を並べる。", ()),
    ("headline-decoration", "★ ● 今月の案内です", ("★ ● 今月の案内です",)),
    ("headline-decoration", "★ 今月の案内です", ()),
    ("placeholder", "ここに氏名を記入してください。", ("ここに",)),
    ("placeholder", "ダミーの画像を差し替える。", ("ダミー",)),
    ("placeholder", "```\nTODO\n```\n表は要追記です。", ("要追記",)),
    ("placeholder", "<!-- prosemill-disable placeholder -->\n日付は未定です。\n<!-- prosemill-enable placeholder -->\n場所は要確認です。", ("要確認",)),
    ("placeholder", "ここに、問題がある。", ()),
    ("placeholder", "- [ ] 資料を確認する", ()),
    ("placeholder", "カテゴリ変数からダミー変数を作成する。", ()),
    ("placeholder", "「未定」という欄名を使う。", ()),
    ("chat-response-leakage", "承知しました。資料を送ります。", ("承知しました",)),
    ("chat-response-leakage", "「承知しました」と書かれた文です。", ()),
]

#: Passages that the context rules find in the paragraphs of the derived corpus: (paragraph, passage).
PASSAGES: dict[str, list[tuple[int, str]]] = {
    "weasel-phrases": [(20, "と言われている"), (20, "とされている")],
    "citation-needed": [(21, "近年")],
    "absolute-claim": [(22, "必ず"), (22, "絶対に")],
    "unscoped-generalization": [(23, "あらゆる料理は火加減で"), (23, "いかなる道具も")],
    "no-numerics-claim": [(24, "大幅に向上"), (24, "劇的に減少")],
    "actorless-action": [(25, "検討する必要がある"), (25, "対応が求められる")],
    "deadline-missing": [(7, "進める"), (25, "検討する"), (29, "進めていく")],
    "same-ending": [(6, "ご連絡させていただきます。ご確認させていただき、ご報告させていただく予定でございます。どうぞよろしくお願いいたします。お願いさせていただくこととなりました。")],
    "repeated-connectors": [(26, "また")],
    "thin-sentence": [(4, "価値がある"), (29, "重要である")],
    "excessive-parentheses": [(27, "参加者（子どもを除く）は受付（入口の右側）で名札（青い紙の札）を受け取り、席（前から三列目まで）に着き、資料（会場で配る冊子）を読む。")],
    "headline-decoration": [(28, "★★ ☆☆ 今週のお知らせ")],
}
