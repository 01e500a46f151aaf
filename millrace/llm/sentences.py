"""Sentence units of texts in any script.

Scripts with spaces are read as a lattice of terminators: every mark that may
end a sentence is a node, quotes and brackets that match are edges over which
no sentence ends, and each node is classified by what stands before it
(abbreviations, initials, ordinals, dates) and what opens after it. Scripts
without spaces are read through a lattice of dictionary words: the word that
closes before a gap (a final particle) and the one that opens after it (a
particle that goes on, or a new start) classify the gap.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Word lists of the languages.

#: Abbreviations that stand before what they belong to: no sentence ends with them.
NEVER_LAST = frozenset(
    """mr mrs ms dr prof st rev gen col sgt capt lt gov sen rep hon no nos nr sec fig figs eq eqs vol ch chap pp p vs approx e.g i.e cf al viz est ed eds
    abs abb art bd bzw ca d.h geb hr fr hrsg inkl mio mrd s str tel u.a u.ä v vgl z.b z.t zz sog
    sr sra srta dra d.ª ud uds dpto pág págs núm n.º n.os ej p.ej cap tít av avda gral lic ing
    m mm mme mmes mlle mgr pr env c.-à-d c.à.d p.ex éd réf t chap fasc
    sig sigg dott avv pag mons
    डॉ प्रो श्री श्रीमती पं कि.मी कि मी से रु
    د أ م ص ج ت ق هـ""".split()
)
#: Abbreviations that may also close a sentence.
MAYBE_LAST = frozenset("etc inc ltd co corp llc plc jr sr. bros a.m p.m u.s u.n u.k u.s.a e.u d.c ph.d m.d b.a m.a usw usf u.s.w min max hrs hr std sek mins uu ee.uu cía s.a s.l apdo cie ste ave blvd rd dept assn km kg cm mm".split())
#: Words after a number and its dot that make it an ordinal (German).
AFTER_ORDINAL = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jahrtausend Kapitel Absatz Auflage Klasse Etage Stock Tag Woche Monat Quartal Platz Mal Weltkrieg".split())
BEFORE_ORDINAL = frozenset("am im vom zum bis beim den dem der des die das ein einem einen ab seit jeden jedem".split())
#: Words that open an English sentence after a single letter and a dot.
OPENERS = frozenset("The It In This That We He She They A An If On At But And As When After Do See Who What Why How Was Is Are There These Those You I".split())
#: Verbs of clauses that report speech, after a quotation at the start.
REPORTING = frozenset("said asked shouted wrote replied answered added called cried whispered noted explained says asks adds told rief sagte fragte antwortete dijo preguntó respondió gritó dit demanda répondit".split())
#: What goes on after a closing quote in Japanese and Korean.
GO_ON_JA = ["という", "といった", "として", "とだけ", "って", "と", "は", "が", "を", "の", "に", "で", "も", "など", "や", "へ", "から", "まで", "より"]
GO_ON_KO = ["이라고", "라고", "이라는", "라는", "이라며", "라며", "하고", "고", "는", "은", "이", "가", "을", "를", "와", "과", "의", "에", "로", "으로", "도", "만"]
#: Copulas, and words of going on that would be read as an opening word.
GO_ON_JA += ["です", "でした", "でしょう", "である", "であった", "とは", "とも", "でもいい", "でもよい", "でもない", "でもなく", "でもありません", "でもかまわない"]
#: Words that open a sentence though they begin like a particle; a mark after them is part of the word where they go on without it.
STARTS_JA = """でも では、 できれば できるだけ できる できた できない できごと でかける でかけた でたらめ でこぼこ でんわ
    とても とにかく ところで ところが ときどき ときおり ときに ときには とりあえず とりわけ とうとう とうてい とっくに とっさに とつぜん とくに ともかく ともあれ ともだち とはいえ、 とんでもない とんだ とある とびら とたんに とっても
    はい はいはい はじめ はじめて はじめに はじめは はっきり はっと はやく はやい はるか はるかに はるばる はたして はて ははは はらはら
    がっかり がんばる がんばれ がんばって がんばろう がやがや がらん がたがた がたん
    のち のちに のんびり のろのろ のど のこり のぞみ のびのび のそのそ
    にわか にわかに にこにこ にっこり にやにや にやり にぎやか にほん におい にんじん
    もし もしも もしもし もしかして もしかしたら もしかすると もしくは もちろん もう もうすぐ もういちど もっと もっとも もともと もとより もはや ものすごい ものすごく もったいない もどる もどって もらう もらった
    やはり やっぱり やっと やがて やや やあ やめて やめろ やめた やめる やさしい やった やって やる やれやれ やむなく やけに やたら やたらと
    へえ へん へや へとへと からっぽ からす からくも からから よりよい よりによって""".split()
#: Common words that follow a particle, so that a particle and such a word are read as two words.
COMMON_JA = """いい いう いった いって いえば いえない いる いた いて いない いいえ ある あった あり ない なかった なく なる なった なって する した して しない しよう される された
    この その あの どの これ それ あれ どれ ここ そこ どこ だけ だ だった です でした ます ました ため よう ように ような こと ても まだ また すぐ ただ みんな わたし あなた かれ ほど ばかり くらい おもう おもった きく きいた ちがう ちがった わかる わかった""".split()
#: Words that end like a final form and close no sentence.
NOT_FINAL_JA = "また まだ ただ いまだ あなた たった あした あいだ からだ なみだ はだ えだ まぶた ひたい いったい ぜったい だいたい せいたい あんない かない ますます あまた かなた こなた そなた どなた".split()
#: Words that close a sentence without a mark, and words that open one, in scripts without spaces.
FINAL_JA = ["です", "ます", "でした", "ました", "ません", "でしょう", "ましょう", "ください", "ですか", "ますか", "ですね", "ますね", "ですよ", "ますよ"]
FINAL_JA += ["だ", "だった", "だろう", "のだ", "んだ", "だよ", "だね", "だな", "かな", "よね", "たよ", "たね", "ないよ", "ないね"]
#: Plain forms that close a sentence or stand before a noun: before a space they close only where a word opens after it.
PLAIN_JA = ["た", "ない", "なかった", "たい", "である", "であった", "ある", "いる", "する", "なる", "できる"]
FINAL_ZH = ["吗", "吧", "呢", "啊", "呀", "了吗", "了吧"]
OPEN_JA = ["しかし", "そして", "また", "なお", "ただし", "そのため", "それでも", "つまり", "では", "さて", "次に", "この", "その", "これ", "それ", "あの", "いや", "いえ", "いいえ", "だから", "だが", "けれども", "すると", "それに", "本当に", "なぜ"] + STARTS_JA
OPEN_ZH = ["但是", "因此", "所以", "然后", "另外", "此外", "不过", "这", "那", "我们", "他们", "请", "从", "为什么", "真的", "不"]
NOT_FINAL_ZH = "酒吧 网吧 贴吧 水吧 氧吧 茶吧 咖啡吧 毛呢 花呢".split()
#: Lists as the lattice takes them.
GO_ON_JA, ANY_FINAL_JA, OPEN_JA, FINAL_ZH, OPEN_ZH = map(tuple, (GO_ON_JA, FINAL_JA + PLAIN_JA, OPEN_JA, FINAL_ZH, OPEN_ZH))
#: The dictionaries of the word lattice.
DICTIONARY_JA = frozenset([*STARTS_JA, *COMMON_JA, *NOT_FINAL_JA])
DICTIONARY_ZH = frozenset(NOT_FINAL_ZH)

# Full stops, question and exclamation marks of the scripts that have their own (Armenian, Arabic, Syriac, NKo, Samaritan, Indic, Tibetan, Burmese, Ethiopic, Canadian, Philippine, Khmer, Mongolian, Limbu, Tai Tham, Balinese, Lepcha, Ol Chiki, Lisu, Vai, Bamum, Phags-pa, Saurashtra, Kayah Li, Javanese, Cham, Meetei), and double marks.
SCRIPT_ENDS = "։؟۔܀܁܂߹࠷࠹࠽࠾।॥།༎༏༐༑။።፧፨᙮᜵᜶។៕᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"
END = ".!?…。！？｡﹒﹖﹗‼‽⁇⁈⁉⸮⸼" + SCRIPT_ENDS
WIDE, PLAIN_STRONG = frozenset("。！？｡﹖﹗"), frozenset(SCRIPT_ENDS)
EMPHATIC = frozenset("!?‼‽⁇⁈⁉⸮")
#: Chinese words of a clause's predicate. Two stretches that a space parts are two sentences if each has one, and four characters.
PREDICATES_ZH = frozenset("""是 有 没有 在 了 过 着 去 来 到 说 想 看 要 会 能 可以 应该 必须 不 没 就 都 也 还 再 把 被 让 给 叫 做 用 写 读 听 问 答 买 卖 走 跑 开 关 下雨 下雪 觉得 知道 喜欢 需要 开始 结束 成为 变成 发现 认为
    很 太 非常 更 最 已经 正在 曾经 将 刚 才 回家 上课 上班 吃饭 工作 学习 生活 发生 出现 进行 完成 使用 得 起来 下去""".split())
#: Words with such a character that are no predicate.
NOUNS_ZH = frozenset("现在 存在感 中国有限公司 有限公司 开关 过程 来源 未来 本来 后来 从来 原来 到期 会议 会员 大会 协会 社会 机会 晚会 能力 功能 性能 可能性 用户 用途 作用 费用 应用 不动产 都市 首都 还原 再生 下水 说明书 说法 看法 想法 做法 写作 读者 听众 问题 答案 走廊 着色 给水 被子 把手 要点 主要 重要 需要量 关系 关于 海关 开发区 公开 去年 将军 将来 刚性 才能 人才 天才 更新 最近 最后 太阳 太空".split())
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "“": "”", "‘": "’", "„": "“", "‚": "‘", "〔": "〕"}
BRACKETS = frozenset("([{（［【〔")
CLOSERS = frozenset(")]}）］】」』》〉»”’\"'〕")
DASHES = frozenset("—–―-")

_UNIT_LINE = re.compile(r"\s*(?:#{1,2} |[-*] |\d+\) |\||\[)")
_MARK = re.compile("[" + re.escape(END) + r"]+|[()\[\]{}（）［］【】「」『』《》〈〉«»“”‘’„‚\"'〔〕]|(?<=[ก-๎])\s+(?=[ก-๎])|(?<=[すたんういだかねよなる])[ 　]+(?=[ぁ-ヿ一-鿿])|(?<=[一-鿿])[ 　]+(?=[一-鿿])")
_HAN_BEFORE, _HAN_AFTER = re.compile(r"[一-鿿，、]+\Z"), re.compile(r"[一-鿿，、]+")
_SPACE = re.compile(r"\s*")
_TOKEN_BEFORE = re.compile(r"[^\s(\[{（「『“‘«„\"'¿¡]*\Z")
_WORD = re.compile(r"\S+")
_DATE_BEFORE = re.compile(r"(?:^|\s)\d{4}\.\s?\d{1,2}\.\s?\d{1,2}\Z")
_NUMBER_DOT = re.compile(r"\d+\.")
_NAME_LIKE = re.compile(r"(?=[^\s]*[\d_/]|[^\s]*\.\w|[^\s]*-[^\s]*\s+v?\d)[^\s]+")
_VERSIONED = re.compile(r"[a-z]+(?:-[a-z]+)+\s+v?\d+\.\d")
_DOTTED = re.compile(r"[^\W\d_](?:\.-?[^\W\d_]{1,2})+\Z")
_WORD_CASE = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]*\b(?!\.)")
_KO_FINAL = re.compile(r"[다요죠까오네음임함]\Z")


def _script(c: str) -> str:
    """h(angul), j (kana), c (Han), t(hai), n (other letters without case), u(pper), l(ower), d(igit), or empty."""
    if c.isdigit():
        return "d"
    if not c.isalpha():
        return "n" if "ऀ" <= c <= "ॿ" or "؀" <= c <= "ۿ" else "t" if "ก" <= c <= "๎" else ""
    if "가" <= c <= "힣" or "ᄀ" <= c <= "ᇿ" or "ㄱ" <= c <= "ㆎ":
        return "h"
    if "ぁ" <= c <= "ヿ":
        return "j"
    if "㐀" <= c <= "鿿" or "豈" <= c <= "﫿":
        return "c"
    if "ก" <= c <= "๎":
        return "t"
    if c.isupper() or c.istitle():
        return "u"
    return "l" if c.islower() else "n"


@functools.cache
def _lattice(words: tuple[str, ...], dictionary: frozenset[str], back: bool) -> tuple[frozenset[str], int]:
    """(the words of list and dictionary, read backwards if ``back``; the length of the longest)."""
    known = frozenset(w[::-1] if back else w for w in (*words, *dictionary))
    return known, max(map(len, known))


def _opens_word(text: str, at: int, words: tuple[str, ...], dictionary: frozenset[str]) -> str:
    """The word of the list at the start of the best path through the lattice of ``words``, ``dictionary`` and single letters, or ''.

    A path's cost is its number of words, single letters counting double, over
    a window of a few words: so a word of the list is read only where the rest
    doesn't read better without it, and yields to longer dictionary words.
    """
    known, longest = _lattice(words, dictionary, False)
    first = _first_word(text[at : at + 2 * longest], known, longest)
    return first if first in words else ""


def _first_word(window: str, known: frozenset[str], longest: int) -> str:
    n = len(window)
    cost = [0.0] * (n + 1)
    take = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        cost[i] = 2 + cost[i + 1]
        for k in range(1, min(longest, n - i) + 1):
            if window[i : i + k] in known and 1 + cost[i + k] <= cost[i]:
                cost[i], take[i] = 1 + cost[i + k], k
    return window[: take[0]]


def _closes_word(text: str, at: int, words: tuple[str, ...], dictionary: frozenset[str]) -> str:
    """As ``_opens_word``, read backwards from ``at``."""
    known, longest = _lattice(words, dictionary, True)
    last = _first_word(text[max(0, at - 2 * longest) : at][::-1], known, longest)[::-1]
    return last if last in words else ""


def _words(window: str, known: frozenset[str]) -> list[str]:
    """The words of the best path through the lattice of a stretch."""
    longest, out = max(map(len, known)), []
    while window:
        out.append(_first_word(window[: 2 * longest], known, longest))
        window = window[len(out[-1]) :]
    return out


def _closes_at_space(text: str, at: int, nxt: int) -> bool:
    """Whether a sentence in a script without spaces ends at the space from ``at`` to ``nxt``."""
    if _script(text[at - 1]) != "j":
        if _closes_word(text, at, FINAL_ZH, DICTIONARY_ZH):
            return True
        before, after = _HAN_BEFORE.search(text[max(0, at - 60) : at]), _HAN_AFTER.match(text, nxt, nxt + 60)
        return all(x is not None and len(x.group()) >= 4 and not PREDICATES_ZH.isdisjoint(_words(x.group(), PREDICATES_ZH | NOUNS_ZH)) for x in (before, after))
    word = _closes_word(text, at, ANY_FINAL_JA, DICTIONARY_JA)
    return bool(word) and (word not in PLAIN_JA or bool(_opens_word(text, nxt, OPEN_JA, DICTIONARY_JA)))


def _spans(text: str, marks: list[re.Match]) -> list[tuple[int, int]]:
    """Outermost matched quotes and brackets as (place of the opening, place after the closing)."""
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()  # what the stack holds, so that no mark looks through it in vain
    out: list[tuple[int, int]] = []
    n = len(text)

    def push(c: str, i: int) -> None:
        stack.append((c, i))
        open_[c] += 1

    for m in marks:
        c, i = m.group()[0], m.start()
        if c in END or c.isspace():
            continue
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < n else " "
        if c == "'" or c == "’":
            opened = "'" if c == "'" else "‘"
            if before.isalnum() and after.isalnum() and after.isascii():
                continue  # an apostrophe
            if c == "'" and not before.isalnum() and not after.isspace() and (before.isspace() or before in PAIRS) and not open_["'"]:
                push("'", i)
                continue
            close = opened
        elif c == '"':
            if open_['"'] and not (before.isspace() and after.isalnum()):
                close = '"'
            else:
                while open_['"']:
                    open_[stack.pop()[0]] -= 1
                push('"', i)
                continue
        elif c == "“" and open_["„"]:
            close = "„"
        elif c == "‘" and open_["‚"]:
            close = "‚"
        elif c in PAIRS:
            push(c, i)
            continue
        else:
            close = next((o for o, z in PAIRS.items() if z == c and o not in "„‚"), "")
            if c == "”" and not open_["“"] and open_["„"]:
                close = "„"
        if not open_[close]:
            continue
        while True:
            o, start = stack.pop()
            open_[o] -= 1
            if o == close:
                break
        while out and out[-1][0] > start:
            out.pop()
        out.append((start, i + 1))
    return out


def _after_dot(text: str, begin: int, dot: int, nxt: int, gap: bool) -> bool:
    """Whether the single dot at ``dot`` ends the sentence from ``begin``; the next text is at ``nxt``."""
    c = text[nxt]
    kind = _script(c)
    prev = text[dot - 1] if dot > begin else ""
    token = _TOKEN_BEFORE.search(text, max(begin, dot - 40), dot).group()
    low = token.lower()
    if not gap:
        if _script(prev) in ("h", "j", "c", "n", "t") and (kind in ("u", "d") or c in PAIRS or c in "\"'"):
            return len(token) > 1 and low not in NEVER_LAST
        if kind in ("d", "l") or c in DASHES or c in ",;:/_@&=%":
            return False
        if kind == "u":
            return len(token) > 1 and token.isalpha() and token.islower() and low not in NEVER_LAST and bool(re.match(r"[A-ZÀ-Þ][a-zà-ÿ]*[ ,]", text[nxt : nxt + 30]))
        if low in NEVER_LAST or len(token) < 2:
            return False
        return _script(prev) in ("h", "j", "c", "n", "t") or (c in PAIRS and len(token) > 2 and token.isalpha())
    if kind == "l":
        if low in NEVER_LAST or (len(token) == 1 and not token.isdigit()):
            return False
        if _VERSIONED.match(text, nxt):
            return True
        return low not in MAYBE_LAST and not _DOTTED.match(low) and len(token) > 2 and bool(_NAME_LIKE.match(text, nxt))
    if c in ",;:":
        return False
    if low in NEVER_LAST:
        return False
    if token.isdigit():
        start = dot - len(token)
        if kind == "d" and (_NUMBER_DOT.match(text, nxt) or re.search(r"\d\.\s*\Z", text[max(begin, start - 4) : start])):
            return False
        if _DATE_BEFORE.search(text[max(begin, dot - 16) : dot]):
            return False
        if start == begin and len(token) <= 2:
            return False
        if len(token) <= 2 and kind == "u":
            word = _WORD.match(text, nxt).group().strip(".,;:!?")
            if word in AFTER_ORDINAL:
                return False
            before = text[max(begin, start - 12) : start].split()
            if before and before[-1] in BEFORE_ORDINAL:
                return False
        return True
    if low in MAYBE_LAST or (_DOTTED.match(low) and not token.isdigit()):
        if kind == "u":
            return True
        return c in "“‘«„¿¡\"'—(" or (kind == "d" and low not in ("a.m", "p.m", "co", "min", "max", "km"))
    if len(token) == 1 and token.isalpha():
        if kind == "u" and token.isupper():
            before = text[max(begin, dot - 14) : dot - 1].split()
            word = _WORD_CASE.match(text, nxt)
            return bool(before) and before[-1].islower() and bool(word) and word.group() in OPENERS
        return _script(token) in ("h", "j", "c")
    if len(token) == 2 and token.isupper() and token[0] == token[1] and kind == "u":
        return False
    return True


def _after_quote(text: str, begin: int, span: tuple[int, int], end: int, nxt: int) -> bool:
    """Whether the sentence from ``begin`` ends with the closing of a span whose content ended one."""
    c = text[nxt]
    if c in END or c in ",;:、，；：" or c in CLOSERS - {"'", '"'}:
        return False
    kind, gap = _script(c), nxt > end
    at_start = _SPACE.match(text, begin).end() >= span[0]
    if text[span[0]] in BRACKETS:
        return at_start and (gap or kind in ("j", "c", "h", "") or text[span[0]] in "（【［〔")
    if c in DASHES:
        return gap and nxt + 1 < len(text) and text[nxt + 1 : nxt + 3].strip()[:1].isupper()
    if kind == "l":
        return gap and not at_start and bool(_NAME_LIKE.match(text, nxt))
    if kind == "u":
        if not gap:
            return False
        if at_start:
            return not any(w.strip(".,") in REPORTING for w in text[nxt : nxt + 60].split()[1:5])
        return True
    if kind == "h":
        if not gap:
            return False
        return not at_start and not any(text.startswith(p + " ", nxt) for p in GO_ON_KO)
    if kind in ("j", "c"):
        if _opens_word(text, nxt, GO_ON_JA, DICTIONARY_JA) and "ぁ" <= c <= "ゟ":
            return False
        return not at_start or kind == "j" or gap
    if kind in ("n", "t"):
        return not at_start and gap
    return True


def _ends(text: str, begin: int, run: str, at: int, end: int, nxt: int) -> bool:
    """Whether the terminators ``run`` at ``at``, closed at ``end``, end the sentence from ``begin``."""
    c, gap = text[nxt], nxt > end
    if not WIDE.isdisjoint(run) or not PLAIN_STRONG.isdisjoint(run):
        return True
    kind = _script(c)
    prev = _script(text[at - 1]) if at > begin else ""
    if c in DASHES:
        follow = text[nxt + 1 : nxt + 3].strip()[:1]
        if not gap or follow.islower():
            return False
    if not EMPHATIC.isdisjoint(run):
        if c in ",;:":
            return False
        if kind == "l":
            return gap and bool(_NAME_LIKE.match(text, nxt)) and "-" in _WORD.match(text, nxt).group()
        if not gap:
            return kind in ("h", "j", "c", "n", "t") or (kind == "u" and at - 1 >= begin and text[at - 1].islower()) or c in "“‘«「『《（(\"¿¡"
        return True
    if "…" in run or len(run) > 1:
        if kind == "l" or c in ",;:、，":
            return False
        if prev == "h":
            return gap and bool(_KO_FINAL.search(text, at - 1, at))
        if prev in ("j", "c"):
            closed = _closes_word(text, at, *((ANY_FINAL_JA, DICTIONARY_JA) if prev == "j" else (FINAL_ZH, DICTIONARY_ZH)))
            opened = _opens_word(text, nxt, *((OPEN_JA, DICTIONARY_JA) if prev == "j" else (OPEN_ZH, DICTIONARY_ZH)))
            return bool(closed) and (gap or bool(opened))
        return gap
    return _after_dot(text, begin, at, nxt, gap)


def _paragraph(text: str) -> list[tuple[int, int]]:
    """Sentences of a paragraph (no blank lines, no lines that are units) as (start, end)."""
    marks = list(_MARK.finditer(text))
    out: list[tuple[int, int]] = []
    n, begin = len(text), 0
    delimited = any(m.group()[0] not in END and not m.group()[0].isspace() for m in marks)
    spans = _spans(text, marks) if delimited else []
    k = 0

    def close(end: int) -> int:
        a = _SPACE.match(text, begin).end()
        b = a + len(text[a:end].rstrip())
        if b > a:
            out.append((a, b))
        return end

    skip = -1
    for m in marks:
        a, b = m.span()
        if a < skip or a < begin:
            continue
        run = m.group()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        inside = k < len(spans) and spans[k][0] <= a
        if run[0].isspace():
            if not inside:
                word = text[a - 1]
                if "฀" <= word <= "๿" or _closes_at_space(text, a, b):
                    begin = close(b)
            continue
        if inside:
            # Only the closing of the outermost span may end a sentence.
            if b != spans[k][1] or run[0] in END:
                continue
            body = text[spans[k][0] + 1 : a].rstrip()
            while body and body[-1] in CLOSERS:
                body = body[:-1].rstrip()
            if not body or body[-1] not in END:
                continue
            nxt = _SPACE.match(text, b).end()
            if nxt >= n:
                continue
            if _after_quote(text, begin, spans[k], b, nxt):
                begin = close(b)
            continue
        if run[0] not in END:
            continue
        end = b
        inner = k
        while end < n and text[end] in CLOSERS and not (inner < len(spans) and spans[inner][0] == end):
            end += 1
        nxt = _SPACE.match(text, end).end()
        if nxt >= n:
            break
        if end > b and text[end - 1] in "'\"" and text[end].isalnum():
            end = b
            nxt = _SPACE.match(text, end).end()
        if _ends(text, begin, run, a, end, nxt):
            begin = close(end)
            skip = end
    close(n)
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text, in code points, in order, without white space at the ends.

    Null, empty and blank texts have none. Lines that start as a heading, list
    item, table row or log entry are one unit each; a blank line ends a unit.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at, para = 0, -1

    def flush(end: int) -> None:
        if para >= 0:
            out.extend((para + a, para + b) for a, b in _paragraph(text[para:end]))

    for line in text.split("\n"):
        end = at + len(line)
        if not line or line.isspace():
            flush(at)
            para = -1
        elif _UNIT_LINE.match(line):
            flush(at)
            para = -1
            a = at + len(line) - len(line.lstrip())
            out.append((a, at + len(line.rstrip())))
        elif para < 0:
            para = at
        at = end + 1
    flush(len(text))
    return out


def split(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos int, end_pos int): the sentence units of every row, where it is read.

    Rows of one key are each split by themselves; other columns are left out.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                take, start, end = [], [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    for a, b in sentences(t):
                        take.append(i)
                        start.append(a)
                        end.append(b)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(take, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[key, "start_pos", "end_pos"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, start_pos int, end_pos int")
