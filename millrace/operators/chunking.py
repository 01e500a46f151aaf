"""Chunkers. The fixed one is a closed form; the greedy ones are Python table functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T

#: White space, as slices lose it at their ends.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
# Where the greedy chunkers cut, the better place first.
SEPARATORS = ["\n\n", "\n", ". ", "。", "? ", "! ", " "]
SENTENCE_SEPARATORS = [". ", ".\n", "。", "? ", "?\n", "! ", "!\n", "…", "\n\n", "\n", " "]
# Fixed value: a line that begins a problem of an exercise book.
PROBLEM = re.compile(r"^\s*(?:(?:(?:문제|예제|유제|연습문제)\s*)?(?:\[|\()?(?P<number>\d{1,4})(?:\]|\))?\s*(?:번|[.)])?|SET\s*(?P<set_number>\d{1,3}))(?=\s|$|[:：])", re.IGNORECASE)


def check_config(size: int, overlap: int) -> None:
    """Refuse sizes and overlaps that no chunker can work with."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"chunk size {size} and overlap {overlap}: 0 <= overlap < size must hold")


def fixed(df: DataFrame, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """A row per window of ``size`` characters of the trimmed text, ``size - overlap`` apart, up to the first that reaches its end.

    Keeps the other columns; adds draft_no, raw_start, raw_end, start_pos,
    end_pos, chunk_text. Blank slices, null and blank texts give no row. Raw
    spans leave no gap: the first begins at 0, the last ends with the text,
    and what a dropped slice leaves belongs to the one before. The windows of a
    text are an array of its row, so nothing is shuffled.
    """
    check_config(size, overlap)
    step = size - overlap
    body, n = F.btrim(F.col(text), F.lit(BLANKS)), F.length("_body")
    out = df.withColumn("_body", body).filter(n > 0).withColumn("_lead", F.length(text) - F.length(F.ltrim(F.col(text), F.lit(BLANKS))))
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(F.lit(0), n - size) / step).cast("int")), lambda k: k * step)
    piece = lambda at: F.substring(F.col("_body"), at + 1, F.lit(size))
    out = out.withColumn("_kept", F.filter(starts, lambda s: F.btrim(piece(s), F.lit(BLANKS)) != ""))
    out = out.select("*", F.posexplode("_kept").alias("draft_no", "_at")).withColumn("_slice", piece(F.col("_at")))
    following = F.get("_kept", F.col("draft_no") + 1)
    end = F.when(following.isNull(), F.length(text)).otherwise(F.greatest(F.col("_at") + size, following) + F.col("_lead"))
    out = out.withColumn("raw_start", F.when(F.col("draft_no") == 0, 0).otherwise(F.col("_lead") + F.col("_at"))).withColumn("raw_end", end)
    inner = F.length("_slice") - F.length(F.ltrim(F.col("_slice"), F.lit(BLANKS)))
    out = out.withColumn("chunk_text", F.btrim(F.col("_slice"), F.lit(BLANKS))).withColumn("start_pos", (F.col("_lead") + F.col("_at") + inner).cast("int"))
    return out.withColumn("end_pos", (F.col("start_pos") + F.length("chunk_text")).cast("int")).drop("_body", "_lead", "_kept", "_at", "_slice", text)


def seal(df: DataFrame, parent: list[str], order: str, start: str = "raw_start", end: str = "raw_end", length: Column | None = None) -> DataFrame:
    """Stretch raw spans to leave no gap: each end to the next start, the first to 0, the last to the parent's length."""
    w = W.Window.partitionBy(*parent).orderBy(order)
    nxt, prev = F.lead(start).over(w), F.lag(start).over(w)
    first = F.when(prev.isNull(), F.lit(0)).otherwise(F.col(start))
    last = F.greatest(F.col(end), nxt) if length is None else F.greatest(F.col(end), F.coalesce(nxt, length))
    return df.withColumn("_s", first).withColumn("_e", last).withColumn(start, F.col("_s")).withColumn(end, F.col("_e")).drop("_s", "_e")


#: A part of a text that is cut on its own: section, raw start, raw end, and its windows (start, end) in order.
Part = tuple[str | None, int, int, list[tuple[int, int]]]


def _span(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without white space at its ends; empty if it is blank."""
    piece = text[start:end]
    a = start + len(piece) - len(piece.lstrip())
    return a, a + len(piece.strip())


def windows(text: str, size: int, overlap: int, separators: list[str]) -> list[tuple[int, int]]:
    """Windows of at most ``size`` characters that end behind the best separator in their second half.

    For every position of the text, whether or not a window begins there, the
    window's end and the next window's beginning are computed at once: of each
    separator a running maximum gives the last place it ends at or before a
    position, the best that lies far enough wins. The windows are then the
    path from 0.
    """
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    at = np.arange(n)
    far = np.minimum(at + size, n)
    end = np.where(far == n, n, 0)
    half = at + np.maximum(1, (far - at) // 2)
    for s in separators:
        last = np.zeros(n + 1, np.int64)
        ends = np.array([m.start() for m in re.finditer(f"(?={re.escape(s)})", text)], np.int64) + len(s)
        last[ends] = ends
        place = np.maximum.accumulate(last)[far]
        end = np.where((end == 0) & (place - len(s) >= half), place, end)
    end = np.where(end == 0, far, end)
    solid = np.where(np.fromiter((c.isspace() for c in text), bool, n), n, at)
    solid = np.append(np.minimum.accumulate(solid[::-1])[::-1], n)
    following = np.minimum(solid[np.maximum(at + 1, end - overlap)], np.maximum(at + 1, end))
    out, k = [], 0
    while k < n:
        out.append((k, int(end[k])))
        k = n if end[k] == n else int(following[k])
    return out


def _parts(text: str, marks: list[tuple[int, str]], before: str | None) -> list[tuple[str | None, int, int, int]]:
    """(section, raw start, raw end, start) between marks (position, section); a blank part goes to the one behind it, or is left out at the end."""
    out, raw = [], 0
    for (a, name), b in zip([(0, before), *marks], [*(m[0] for m in marks), len(text)]):
        if text[a:b].strip():
            out.append((name, raw, b, a))
            raw = b
    return out


def marks(text: str, kind: str = "general") -> tuple[list[tuple[int, str]], str | None]:
    """Where sections begin, and the name of what stands before: numbered problems of an exercise book (``math``, two at least), else Markdown headings with their path."""
    lines = text.splitlines(keepends=True)
    start = [0, *accumulate(map(len, lines))]
    if kind == "math":
        found = [(a, PROBLEM.match(x.strip())) for a, x in zip(start, lines)]
        named = [(a, f"SET {m['set_number']}" if m["set_number"] else f"문제 {m['number']}") for a, m in found if m]
        if len(named) > 1:
            return named, "preamble"
    heads, path = [], []
    for a, x in zip(start, lines):
        if m := _HEAD.match(x.rstrip("\r\n")):
            path = [*path[: len(m[1]) - 1], m[2].strip()]
            heads.append((a, " > ".join(path)))
    return heads, None


_HEAD = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def sections(text: str, kind: str = "general") -> list[Part]:
    """The sections of a text, each as one window without white space at its ends; a blank text has none."""
    return [(name, raw, end, [_span(text, a, end)]) for name, raw, end, a in _parts(text, *marks(text, kind))]


Strategy = Callable[[str, int, int, str], list[Part]]


def _whole(separators: list[str]) -> Strategy:
    def cut(text: str, size: int, overlap: int, kind: str) -> list[Part]:
        a, b = _span(text, 0, len(text))
        return [(None, 0, len(text), [(a + x, a + y) for x, y in windows(text[a:b], size, overlap, separators)])]

    return cut


def _markdown_recursive(text: str, size: int, overlap: int, kind: str) -> list[Part]:
    return [(name, raw, end, [(a + x, a + y) for x, y in windows(text[a:b], size, overlap, SEPARATORS)]) for name, raw, end, [(a, b)] in sections(text, kind)]


#: Chunking strategies by name; more are added by ``register``.
STRATEGIES: dict[str, Strategy] = {"recursive": _whole(SEPARATORS), "recursive_sentence": _whole(SENTENCE_SEPARATORS), "markdown": lambda text, size, overlap, kind: sections(text, kind), "markdown_recursive": _markdown_recursive}
#: Stages of the pipeline that stand for a strategy.
ALIASES = {"1": "fixed", "stage_1": "fixed", "2": "recursive", "stage_2": "recursive", "3": "markdown_recursive", "stage_3": "markdown_recursive"}


def register(name: str, strategy: Strategy) -> None:
    """Add a strategy: a function of (text, size, overlap, document type) that gives parts with their windows."""
    if not name.strip():
        raise ValueError("a strategy needs a name")
    STRATEGIES[name.strip()] = strategy


def drafts(text: str, parts: list[Part]) -> list[tuple[int, str | None, int, int, int, int, str]]:
    """(draft_no, section, raw_start, raw_end, start_pos, end_pos, chunk_text) of the windows that aren't blank; the raw spans of a part leave no gap in it."""
    out = []
    for section, low, high, cut in parts:
        kept = [(a, b, *_span(text, a, b)) for a, b in cut if text[a:b].strip()]
        starts = [low, *(a for a, *_ in kept[1:])]
        ends = [max(b, nxt) for (_, b, *_), nxt in zip(kept, [*starts[1:], high])]
        out += [(section, min(r, a), e, x, y, text[x:y]) for (a, _, x, y), r, e in zip(kept, starts, ends)]
    return [(no, *row) for no, row in enumerate(out)]


def chunk(df: DataFrame, key: str, text: str, strategy: str, size: int = 512, overlap: int = 50, kind: str | None = None) -> DataFrame:
    """(key, draft_no, section, raw_start, raw_end, start_pos, end_pos, chunk_text) by a strategy; ``kind`` names a column with the document type.

    Greedy strategies choose each cut by the one before, so they run as an
    Arrow table function where the rows are read; nothing is shuffled.
    """
    strategy = ALIASES.get(strategy, strategy)
    check_config(size, overlap)
    if strategy == "fixed":
        out = fixed(df.select(key, text), text, size, overlap)
        return out.select(key, "draft_no", F.lit(None).cast("string").alias("section"), "raw_start", "raw_end", "start_pos", "end_pos", "chunk_text")
    cut = STRATEGIES[strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            take, rows = [], []
            for i, (t, k) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = drafts(t, cut(t, size, overlap, k or "general")) if t else []
                rows += own
                take += [i] * len(own)
            cells = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cells, kinds))], names=[key, "draft_no", "section", "raw_start", "raw_end", "start_pos", "end_pos", "chunk_text"])

    of = dict(df.dtypes)[key]
    return df.select(key, F.col(text).alias("_text"), (F.col(kind) if kind else F.lit("general")).alias("_kind")).mapInArrow(run, f"`{key}` {of}, draft_no int, section string, raw_start int, raw_end int, start_pos int, end_pos int, chunk_text string")


def dedup(chunks: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(survivors, twins) of chunks by the hash of their text, the first in order surviving; ``order`` must name a chunk.

    The survivor of each hash is an aggregate of the least order, partly made
    where the rows are. Chunks are then told apart by a join on their own
    order, so copies of one text, however many, never meet in one task.
    """
    hashed = chunks.withColumn("text_hash", F.sha2("chunk_text", 256))
    first = hashed.groupBy("text_hash").agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
    return hashed.join(first, order, "left_semi"), hashed.drop("chunk_text").join(first, order, "left_anti")


def number(chunks: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """chunk_index and chunk_id of survivors, counted anew within each document."""
    w = W.Window.partitionBy(doc).orderBy(*order)
    index = F.row_number().over(w) - 1
    return chunks.withColumn("chunk_index", index).withColumn("chunk_id", F.format_string("%s_chunk_%03d", F.col(doc).cast("string"), F.col("chunk_index"))).withColumn("token_count", T.token_count(F.col("chunk_text")))
