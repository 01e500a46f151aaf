"""Defective prompt and response pairs, by a label model over noisy labelling functions.

Each defect has several labelling functions that vote for it, against it or
not at all. Votes are counted over all pairs; an expectation-maximization label
model (one latent truth per defect, a confusion table per function) is fitted
to the counts of vote patterns, of which there are few whatever the corpus, and
gives each pattern a posterior. A pair keeps every defect whose posterior
exceeds that defect's cutoff.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .sentences import sentences

#: Of several defects the first is the pair's defect.
DEFECTS = ["empty", "copied_question", "refusal", "wrong_language", "truncated"]
#: Least posteriors. Half is where both errors weigh the same; tests hold them against labelled pairs.
CUTOFFS = {"empty": 0.5, "copied_question": 0.5, "refusal": 0.5, "wrong_language": 0.5, "truncated": 0.5}

#: How often the last token of an answer occurs at most to be strange, and an ending at least to be judged: as a share of all different pairs of question and answer, and in small corpora.
STRANGE, STRANGE_N = 1 / 1000, 2
TOLD, TOLD_N = 1 / 1500, 4

# Placeholders, labels, and words of refusals, by language.

PLACEHOLDERS = frozenset("none null nil nan n/a na n.a. n.a - -- --- . .. ... … …… ? [] {} () \"\" '' “” ‘’ tbd todo empty blank undefined 없음 해당없음 무 なし 無 无 空 answer 답변 답 response 回答 答え 回复 답변없음".split())
LABELS = re.compile(r"^\s*[\[(<【]?\s*(?:answer|ans|a|response|reply|assistant|output|question|q|답변|답|응답|질문|문의|回答|答え|答案|答|質問|问题|問|问)\s*[\])>】]?\s*(?:[:：.．]|$)\s*", re.I)
REFUSAL = re.compile(
    r"모르겠|알지 못|알 수 (?:가 )?없|답(?:변)?(?:을|해)? ?드릴 수 (?:가 )?없|답(?:변)?할 수 (?:가 )?없|(?:답|내용|정보|근거)[^.]{0,12}(?:확인|찾을|알)(?:할|드릴)? ?수 (?:가 )?없|불가(?:합|능)|찾지 못|찾을 수 없|드리기 어렵|도와드리기 어|도움을 드리지 못|처리해 드릴 수 없|제공(?:할|해 드릴) 수 없|안내(?:해 드릴|할) 수 없"
    r"|\b(?:can ?not|can't|could not|couldn't|won't be able|am unable|are unable|not able|unable) (?:\w+ ){0,3}(?:answer|help|assist|say|share|give|provide|find|tell|comment|discuss|determine|respond)|\bi(?: do not|'m not sure| don't) know\b|\bi am not sure\b|\bno (?:relevant|such) (?:information|details?) (?:was|were|is|are|could)|isn't enough information|is not enough information|not enough information|cannot be processed|against (?:our |the )?policy|does not mention|doesn't mention|i can't help|i must decline|i(?:'d| would) rather not|i have to decline|won't be able to"
    r"|わかりかね|分かりかね|わかりません|分かりません|お答えでき|回答できません|見つかりません|お応えでき|記載がありません|申し上げられません|致しかねます|いたしかねます"
    r"|无法(?:回答|提供|确定|处理|帮助|告知)|不能回答|不清楚|不知道|没有相关|没有找到|未找到|未提及|没有提到|无可奉告|无法",
    re.I,
)
APOLOGY = re.compile(r"죄송(?:하지만|합니다만|스럽지만)|미안하지만|안타깝지만|아쉽지만|(?:i'm|i am|we're|we are) (?:very )?sorry,? but|sorry,? but|unfortunately,?|申し訳(?:ありません|ございません)が|恐れ入りますが|すみませんが|很抱歉|抱歉|对不起|对不起，", re.I)
CONTRAST = re.compile(r"지만|으나|는데|\bbut\b|\bhowever\b|\bthough\b|\balthough\b|ものの|ですが|ませんが|但是|但|不过|然而", re.I)
NO_ANSWER = re.compile(r"답이 없|답(?:변)? ?없음|내용 없음|근거 없음|답변 불가|정보 없음|확인 불가|알 수 없음|no answer|not stated|unanswerable|not answerable|cannot be answered|not in the (?:documents|context)|no information|記載なし|記載がない|回答なし|回答不能|答えなし|没有答案|无答案|无法回答|未提及|没有记载", re.I)
_LANGS = {"ko": r"한국어|한글|국문|Korean|韓国語|韩语|韩文", "en": r"영어|영문|English|英語|英语|英文", "ja": r"일본어|일어|Japanese|日本語|日语|日文", "zh": r"중국어|중문|Chinese|中国語|中文|汉语"}
ASKED = {k: re.compile(rf"(?:{v})(?:로|으로|で|にて)|\bin (?:{v})\b|(?:用|以|请用)(?:{v})|(?:{v})(?:回答|作答)", re.I) for k, v in _LANGS.items()}

_TOKEN = re.compile(r"[ぁ-ヿ㐀-鿿]|[^\sぁ-ヿ㐀-鿿]+|\n")
_END = re.compile(r"[.!?…。！？؟।][\"'”’»」』)\]）】]*\Z|[)\]）】」』”\"]\Z")
_KO_END = re.compile(r"(?:다|요|죠|까|네요|니다|세요|음|함|임|됨)\Z")
_JA_END = re.compile(r"(?:です|ます|でした|ました|ません|ください|である|だ|た)\Z")
_VALUE_END = re.compile(r"(?:[\w.+-]+@[\w.-]+\.\w+|@\S+|\+?\d[\d\s().-]{6,}\d|[A-Z]{1,2} ?\d[\d ]{5,}[A-Z]?|[=:/]\s*\S*\d\S*|>|\d+(?:[.,]\d+)*\s?(?:일|건|%|％|days?|日|天|개|명|원|점|km|h|시간|분)?)\Z")
_LIST_ITEM = re.compile(r"^\s*(?:[-*•·]\s+|[・•]\s*|\d+[.)]\s+)\S")
_NOT_WORD = re.compile(r"[\W_]+")
_UNSEEN = regex.compile(r"[[\p{Cf}\p{Cc}\p{Co}\p{Cs}]--[\n\t]]+", regex.V1)
_QUOTED = re.compile(r"[“\"「『(（<][^”\"」』)）>]{0,80}[”\"」』)）>]")
_SCRIPTS = [re.compile(p) for p in ("[가-힣ㄱ-ㆎ]+", "[ぁ-ヿ]+", "[㐀-鿿]+", "[A-Za-zÀ-ÿ]+")]
_PARTICLE, _SPACED, _SPACELESS = re.compile(r"(?:에서|으로|에게|은|는|이|가|을|를|의|에|로|와|과|도|만)$"), re.compile(r"[^\W_ぁ-ヿ㐀-鿿]+"), re.compile(r"[ぁ-ヿ㐀-鿿]+")


def plain(s: str) -> str:
    """Letters and digits only, folded."""
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", s).lower())


def visible(s: str | None) -> str:
    """The text without white space and invisible characters at its ends."""
    if s is None:
        return ""
    return _UNSEEN.sub("", s).strip("ㅤᅟᅠ⠀ \t\n\r　\xa0")


@functools.lru_cache(1 << 10)
def language(s: str) -> str:
    """ko, ja, zh or en by the scripts of a text; '' where there are too few letters to tell."""
    s = _QUOTED.sub(" ", s)
    # Addresses, numbers, versions and file names are of no language; words are judged one by one, so that long ones cost no more.
    s = " ".join(w for w in s.split() if not ("@" in w or "=" in w or ("." in w[:-1] and any(x.isdigit() for x in w) and w.isascii())))
    h, k, c, a = (sum(map(len, p.findall(s))) for p in _SCRIPTS)
    if 3 * (h + k + c) + a < 4:
        return ""
    best = max((3 * h, "ko"), (3 * (k + c), "cj"), (a, "en"))[1]
    return best if best != "cj" else "ja" if k >= 0.08 * (k + c) else "zh"


@functools.lru_cache(1 << 10)
def content(s: str) -> set[str]:
    """Words of a text for overlaps; pairs of letters in scripts without spaces."""
    s = unicodedata.normalize("NFKC", s).lower()
    words = {_PARTICLE.sub("", w) if "가" <= w[-1] <= "힣" and len(w) > 2 else w for w in _SPACED.findall(s)}
    runs = _SPACELESS.findall(s)
    return words | {r[i : i + 2] for r in runs for i in range(len(r) - 1)}


def _parts(s: str) -> list[str]:
    return [s[a:b] for a, b in sentences(s)]


def share(a: set[str], b: set[str]) -> float:
    """How much of ``a`` is in ``b``."""
    return len(a & b) / len(a) if a else 0.0


def end_contexts(answer: str) -> list[int]:
    """Hashes of the last one, two, three and four tokens with which the answer ends."""
    return _contexts(_tokens(answer), end_only=True)[0]


def _tokens(answer: str) -> list[str]:
    return ["<s>", *_TOKEN.findall(re.sub(r"\d+", "#", answer))]


def _contexts(tokens: list[str], end_only: bool = False) -> tuple[list[int], list[tuple[int, bool]]]:
    def h(t: list[str]) -> int:
        x = xxhash.xxh64_intdigest("\x00".join(t).encode())
        return x - (1 << 64) if x >> 63 else x

    n = len(tokens)
    ends = [h(tokens[max(0, n - k) :]) if n >= k else 0 for k in (1, 2, 3, 4)]
    if end_only:
        return ends, []
    return ends, [(h(tokens[i - k + 1 : i + 1]), i == n - 1 or tokens[i + 1] == "\n") for i in range(1, n) for k in (1, 2, 3, 4) if i - k + 1 >= 0 and tokens[i] != "\n"]


def votes(question: str | None, answer: str | None, truth: str | None, ends: list[tuple[int, int]] | None, n_pairs: int = 0) -> dict[str, list[int]]:
    """The votes of all labelling functions, per defect; 1 for it, -1 against it, 0 none.

    ``ends`` are, for the last one to four tokens of the answer, how often they
    occur among the answers of all different pairs of question and answer, of
    which there are ``n_pairs``, and how often an answer or a line ends with them.
    """
    q, a, t = visible(question), visible(answer), visible(truth)
    bare = LABELS.sub("", a, count=1).strip()
    letters = plain(a)
    out: dict[str, list[int]] = {}
    gone = not a or a.lower() in PLACEHOLDERS or bare.lower() in PLACEHOLDERS or not bare
    out["empty"] = [1 if not a else -1 if len(letters) > 12 else 0, 1 if a.lower() in PLACEHOLDERS or bare.lower() in PLACEHOLDERS else -1 if letters and bare else 0, 1 if not bare else 0, 1 if not plain(bare) else -1 if len(bare.split()) > 1 or len(letters) > 8 else 0]
    none = {d: [-1] * n for d, n in SIZES.items() if d != "empty"}
    if gone:
        return out | none
    answers, asked = _parts(a), _parts(q)
    # Copies
    qs = [p for p in (plain(LABELS.sub("", s)) for s in asked) if len(p) >= 4]
    core = max(asked, key=lambda s: (s.rstrip().endswith(("?", "？")), len(s)), default="")
    pa_, pq = plain(bare), plain(q)
    same = [p for p in (plain(LABELS.sub("", s)) for s in answers) if p]
    copied = [any(p == x or (len(p) >= 0.8 * len(x) and p in x) or (len(x) >= 6 and p == x * (len(p) // max(1, len(x)))) for x in qs) for p in same]
    rest = [s for s, c in zip([s for s in answers if plain(LABELS.sub("", s))], copied) if not c]
    cq = content(core)
    told = [share(cq, content(s)) for s in rest]
    whole = bool(pa_) and (pa_ == pq or (len(pa_) >= 0.7 * len(plain(core)) and pa_ in pq) or any(pa_ == x * k for x in qs for k in (1, 2, 3)))
    overlap = share(content(a), content(q))
    out["copied_question"] = [1 if whole else 0 if any(copied) else -1, (1 if max(told, default=0) < 0.34 else -1) if any(copied) and copied[0] else -1, 1 if overlap > 0.9 and share(cq, content(a)) > 0.8 else -1 if overlap < 0.6 else 0, 1 if a.rstrip().endswith(("?", "？")) and any(copied) else 0]
    # Refusals
    clean = [APOLOGY.sub(" ", s) for s in answers]
    sorry = [bool(REFUSAL.search(s)) or (bool(APOLOGY.search(o)) and len(s) < 60 and bool(REFUSAL.search(o))) for s, o in zip(clean, answers)]
    hedged = [r and bool(CONTRAST.search(s)) and len(s) > 24 and max(share(cq, content(s)), 0) > 0.3 for r, s in zip(sorry, clean)]
    replied = max([share(cq, content(s)) for s, r, h in zip(answers, sorry, hedged) if not r or h], default=0.0)
    hit = share(content(t), content(a)) if t and not NO_ANSWER.search(t) else 0.0
    out["refusal"] = [1 if any(r and not h for r, h in zip(sorry[:2], hedged)) else -1, (1 if sorry[0] and not hedged[0] else -1 if not any(sorry) or any(hedged) else 0) if sorry else -1, -1 if hit > 0.55 else 0, -1 if replied > 0.5 else 1 if any(sorry) and replied < 0.34 else 0]
    # Languages
    want = next((k for k, p in ASKED.items() if p.search(q)), "")
    lq, la = language(core) or language(q), language(a)
    first = next((x for x in map(language, answers) if x), la)
    lt = language(t) if t else ""

    def other(x: str) -> int:
        return 0 if not x or not lq else -1 if x == lq or x == want or ({x, lq} == {"ja", "zh"} and not re.search("[ぁ-ヿ]", a) and len(a) < 14) else 1

    out["wrong_language"] = [other(la), other(first), -1 if want and first == want else other(answers and language(max(answers, key=len)) or ""), 0 if not lt or not la else -1 if lt == first else 1 if lt == lq else 0]
    # Truncation
    end = a.rstrip()
    last = answers[-1] if answers else end
    line = end.rsplit("\n", 1)[-1]
    closed = bool(_END.search(end))
    opens = sum(end.count(o) - end.count(c) for o, c in ("()", "（）", "[]", "「」", "『』", "“”")) > 0 or end.count('"') % 2 == 1 or end.count("```") % 2 == 1
    dangling = end[-1] in ",:;、，：；(（[「『“-–—" or bool(re.search(r"(?:^|\n)\s*(?:\d+[.)]|[-*•·・])\s*\Z", end))
    pt = plain(t)
    closed = closed and not dangling
    prefix = 1 if t and len(letters) >= 3 and pt.startswith(letters) and len(letters) < len(pt) and not closed else -1 if t and letters == pt else 0
    value = bool(_VALUE_END.search(line[-160:])) and (bool(re.search(r"[=:/<+@]|\d{3}", line[-40:])) or len(end) < 12)
    item = bool(_LIST_ITEM.match(line))
    known = [(n, e) for n, e in ends or [] if n]
    longest = next(((n, e) for n, e in reversed(known) if n >= max(TOLD_N, TOLD * n_pairs)), (0, 0))
    goes_on = 0 if not longest[0] else 1 if longest[1] <= 0.04 * longest[0] else -1 if longest[1] >= 0.3 * longest[0] else 0
    strange = bool(ends) and ends[0][0] <= max(STRANGE_N, STRANGE * n_pairs)
    la_ = language(last)
    finished = closed or (la_ == "ko" and bool(_KO_END.search(end))) or (la_ == "ja" and bool(_JA_END.search(end)))
    phrase = not finished and len(answers) == 1 and not re.search(r"(?:은|는|을|를|이며|하고|에서|면)(?:\s|$)", end) and not (la_ == "en" and end[:1].isupper() and len(end.split()) > 3) and len(end) < 100
    shape = -1 if finished or value or any(sorry) else 1 if not phrase and not item else 0
    # Each function looks at one thing: the last mark, the truth, open brackets, the last character, how others go on, the last token, the grammar of the end.
    out["truncated"] = [-1 if closed else 0, prefix, 1 if opens else 0, 1 if dangling else 0, 0 if value else goes_on, 1 if strange and not value and not phrase else 0, shape]
    return out


#: Labelling functions of each defect.
SIZES = {"empty": 4, "copied_question": 4, "refusal": 4, "wrong_language": 4, "truncated": 7}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """The posterior of a defect for each vote pattern, by expectation-maximization over the patterns' counts.

    Every function has a rate of right votes given the truth; a function that
    doesn't vote says nothing. Rates start from mostly right votes and keep a
    prior of that, so that the two truths can't change places.
    """
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    k = v.shape[1]
    right = np.full((k, 2), 0.85)  # of functions that vote: the chance of -1 where the truth is no, of +1 where it is yes
    prior, pull = 0.1, max(4.0, 0.02 * n.sum())
    post = np.zeros(len(n))
    for _ in range(rounds):
        no = np.prod(np.where(v < 0, right[:, 0], np.where(v > 0, 1 - right[:, 0], 1.0)), axis=1)
        yes = np.prod(np.where(v > 0, right[:, 1], np.where(v < 0, 1 - right[:, 1], 1.0)), axis=1)
        post = prior * yes / (prior * yes + (1 - prior) * no)
        prior = float(np.clip((n * post).sum() / n.sum(), 0.001, 0.5))
        for y, w, vote_ in ((0, n * (1 - post), -1), (1, n * post, 1)):
            cast = (w[:, None] * (v != 0)).sum(axis=0)
            good = (w[:, None] * (v == vote_)).sum(axis=0)
            right[:, y] = np.clip((good + 0.85 * pull) / (cast + pull), 0.5, 0.995)
    return {p: float(x) for (p, _), x in zip(patterns, post)}


_VOTED = "log_id bigint, no_answer boolean, " + ", ".join(f"{d} string" for d in DEFECTS)


def vote(logs: DataFrame) -> DataFrame:
    """(log_id, no_answer, a string of votes per defect) of every log, each log_id once (its least texts).

    Votes are written as ``-``, ``0`` and ``+``. no_answer says that the ground
    truth itself denies an answer. How answers end is counted over all different
    pairs of question and answer, so that copies of one don't vouch for it;
    one answer to several questions counts for each.
    """
    own = logs.select("log_id", F.struct("question", "answer", "ground_truth").alias("s")).groupBy("log_id").agg(F.min("s").alias("s")).select("log_id", "s.*")

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, answered = ([visible(x) for x in batch.column(c).to_pylist()] for c in ("question", "answer"))
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(answered, pa.string())], names=["question", "answer"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, list[int]] = {}
            for a in batch.column("answer").to_pylist():
                for h, e in _contexts(_tokens(a))[1]:
                    c = seen.setdefault(h, [0, 0])
                    c[0] += 1
                    c[1] += e
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["h", "n", "e"])

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, hs = [], [], []
            for i, a in zip(batch.column("log_id").to_pylist(), batch.column("answer").to_pylist()):
                if a := visible(a):
                    for k, h in enumerate(end_contexts(a)):
                        if not h:  # the answer has no so many tokens
                            continue
                        ids.append(i)
                        no.append(k)
                        hs.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(hs, pa.int64())], names=["log_id", "k", "h"])

    different = own.select("question", "answer").mapInArrow(shown, "question string, answer string").filter("answer <> ''")
    different = cut(different.distinct().select("answer"))
    n_pairs = different.count()
    counts = different.mapInArrow(contexts, "h bigint, n bigint, e bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    ends = own.select("log_id", "answer").mapInArrow(endings, "log_id bigint, k int, h bigint").join(counts, "h")
    ends = ends.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("k", "n", "e"))).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, q, a, t, e in zip(*(batch.column(c).to_pylist() for c in ("log_id", "question", "answer", "ground_truth", "ends"))):
                tail = [(0, 0)] * 4
                for x in e or []:
                    tail[x["k"]] = (x["n"], x["e"])
                v = votes(q, a, t, tail, n_pairs)
                rows.append((i, bool(t and NO_ANSWER.search(t)), *("".join("-0+"[x + 1] for x in v[d]) for d in DEFECTS)))
            cells = list(zip(*rows)) or [()] * (2 + len(DEFECTS))
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.bool_()), *(pa.array(c, pa.string()) for c in cells[2:])], names=["log_id", "no_answer", *DEFECTS])

    joined = own.join(ends, own.log_id.eqNullSafe(ends.log_id), "left").drop(ends.log_id)
    return joined.select("log_id", "question", "answer", "ground_truth", "ends").mapInArrow(run, _VOTED)


def label(logs: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(log_id, defects array<string>, posteriors map<string,double>) of every log; no defects: an empty array.

    A pair may have several defects. A refusal isn't a defect where the ground
    truth says that there is no answer. A null answer is empty; a null question
    is compared as an empty one.
    """
    cutoffs = CUTOFFS | (cutoffs or {})
    voted = cut(vote(logs))
    pivot = voted.select(F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("x")).select("x.*")
    # At most 3^7 patterns of a defect, whatever the corpus.
    seen: dict[str, list] = {d: [] for d in DEFECTS}
    for r in pivot.groupBy("defect", "pattern").count().collect():
        seen[r.defect].append((tuple("-0+".index(c) - 1 for c in r.pattern), r["count"]))
    rows = [(d, "".join("-0+"[x + 1] for x in p), x) for d in DEFECTS for p, x in fit(sorted(seen[d])).items()]
    posts = F.broadcast(logs.sparkSession.createDataFrame(rows, "defect string, pattern string, posterior double"))
    out = voted
    for d in DEFECTS:
        own = posts.filter(F.col("defect") == d).select(F.col("pattern").alias(d), F.col("posterior").alias(f"_{d}"))
        out = out.join(own, d, "left")
    hit = {d: F.col(f"_{d}") > cutoffs[d] for d in DEFECTS}
    hit["refusal"] = hit["refusal"] & ~F.col("no_answer")
    defects = F.filter(F.array(*(F.when(hit[d], F.lit(d)) for d in DEFECTS)), lambda x: x.isNotNull())
    return out.select("log_id", defects.alias("defects"), F.map_from_arrays(F.array(*map(F.lit, DEFECTS)), F.array(*(F.col(f"_{d}") for d in DEFECTS))).alias("posteriors"))


def found(logs: DataFrame) -> DataFrame:
    """(log_id, defect): of each defective pair its first defect in the order of ``DEFECTS``."""
    return label(logs).filter(F.size("defects") > 0).select("log_id", F.col("defects")[0].alias("defect"))
