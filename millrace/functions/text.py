"""Text expressions: tokens, answer matching by characters, markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.

#: Quotes and brackets that answer matching reads as spaces, and the ASCII punctuation that it drops.
AS_SPACE = "'\"《》<>〈〉()‘’“”"
PUNCTUATION = "!#$%&*+,-./:;=?@[\\]^_`{|}~"
#: Lexical tokens: Hangul runs, Latin words, numbers and fractions.
TOKENS = r"[가-힣]+|[a-z][a-z0-9_+./-]*|[0-9]+(?:/[0-9]+)?"
#: Marks of an answer that abstains, and those that only replays of foreign logs count.
ABSTAINS = ["모른다", "모르겠", "알 수 없", "답변할 수 없", "답변하기 어렵", "정보가 없", "정보를 찾을 수 없", "제공된 정보로는 알 수 없", "확인할 수 없", "don't know", "do not know", "cannot answer", "no information", "not available", "unable to answer"]
ABSTAINS_MORE = ["확인되지 않", "찾을 수 없", "포함되어 있지 않", "언급되어 있지 않", "명시되어 있지 않", "나와 있지 않", "답변드리기 어렵", "정보가 부족", "다루지 않", "다루고 있지 않", "not mentioned", "not specified"]
#: Lengths, in characters, up to which a truth is short and from which it is long; and shares that go with them.
SHORT_TRUTH, CONTAINED, LONG_TRUTH, VERBOSE, STRIDE_PARTS = 10, 0.9, 30, 1.3, 8


def let(value: Column, body: "Callable[[Column], Column]") -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """The lexical tokens of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKENS})"), F.lit(1))


def token_count(text: Column) -> Column:
    """Number of lexical tokens, one at least."""
    return F.greatest(F.lit(1), F.size(tokens(F.coalesce(text, F.lit("")))))


def normal_answer(text: Column) -> Column:
    """An answer as it is compared: quotes to spaces, lower case, no ASCII punctuation, single spaces."""
    spaced = F.translate(F.coalesce(text, F.lit("")), AS_SPACE, " " * len(AS_SPACE))
    bare = F.translate(F.lower(spaced), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r]+", " "))


def answer_chars(text: Column) -> Column:
    """The characters of a normal answer, without spaces, as an array."""
    return F.filter(F.split(F.replace(normal_answer(text), F.lit(" "), F.lit("")), ""), lambda c: c != "")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda s, c: s + F.least(_count(a, c), _count(b, c)))


def _count(a: Column, c: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == c))


def _f1(same: Column, n_pred: Column, n_ref: Column) -> Column:
    return F.when((n_pred == 0) | (n_ref == 0) | (same == 0), 0.0).otherwise(2.0 * same / (n_pred + n_ref))


def char_f1(pred: Column, ref: Column) -> Column:
    """Character F1 of two character arrays; 0 if either is empty or nothing is shared."""
    return _f1(overlap(pred, ref), F.size(pred), F.size(ref))


def char_recall(pred: Column, ref: Column) -> Column:
    """Share of the truth's characters that the answer has; 0 for an empty truth."""
    return F.when(F.size(ref) == 0, 0.0).otherwise(overlap(pred, ref) / F.size(ref))


def window_f1(pred: Column, ref: Column) -> Column:
    """Best character F1 of a stretch of the answer as long as the truth; of the whole answer if that is no longer."""
    width, n = F.size(ref), F.size(pred)
    stride = F.greatest(F.lit(1), F.floor(width / STRIDE_PARTS).cast("int"))
    last = n - width
    starts = F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), stride), F.array(F.greatest(last, F.lit(0))))
    best = F.array_max(F.transform(starts, lambda s: overlap(F.slice(pred, s + 1, width), ref) / width))
    return F.when((width == 0) | (n == 0), 0.0).when(n <= width, char_f1(pred, ref)).otherwise(best)


def answer_match(pred: Column, ref: Column) -> Column:
    """The match of an answer with a truth (character arrays): F1, mended for short and for long truths."""
    f1, recall, n = char_f1(pred, ref), char_recall(pred, ref), F.size(ref)
    short = F.when(recall >= CONTAINED, F.greatest(f1, recall)).otherwise(f1)
    long_ = (n >= LONG_TRUTH) & (F.size(pred) >= n * VERBOSE)
    return F.when(n == 0, 0.0).when(n <= SHORT_TRUTH, short).when(long_, F.greatest(f1, window_f1(pred, ref))).otherwise(f1)


def abstains(answer: Column, more: bool = False) -> Column:
    """Whether an answer says nothing or that it can't tell."""
    low = F.lower(answer)
    marked = F.lit(False)
    for m in ABSTAINS + (ABSTAINS_MORE if more else []):
        marked = marked | F.contains(low, F.lit(m))
    return F.when(answer.isNull() | (F.btrim(answer, F.lit(" \t\n\r\u3000")) == ""), True).otherwise(marked)


def preview(text: Column, chars: int = 180) -> Column:
    """A text on one line, cut to ``chars`` with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.rtrim(F.substring(flat, 1, chars - 1)), F.lit("…"))).otherwise(flat)


def rough_sentences(text: Column) -> Column:
    """A text cut behind end marks that white space follows, by pattern alone: for scores, not for units."""
    return F.split(text, r"(?<=[.!?。？！\n])\s+", -1)
