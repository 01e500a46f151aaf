"""Cutting oversized items at natural boundaries, by pointer doubling.

Every place of a text at which a piece may start is joined to its farthest
legal successor: the start of the next piece, overlap included. The successor
tables of a whole batch of texts are then squared again and again
(``next = next[next]``) while the set of reached starts is united with its
image, so all greedy cuts of all texts come out after log2(pieces) rounds of
array operations instead of one walk per text.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import slices as S

#: How natural a place is for a cut: within a word, between words, sentences, lines, paragraphs.
HARD, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
#: Marks that end a sentence before white space, and those that end one by themselves. Fixed values.
END_MARKS, FULL_WIDTH_MARKS = ".!?…।؟", "。！？"
CLOSERS = "\"'”’»)]}」』）】"


@dataclasses.dataclass(frozen=True)
class Limit:
    """A row of size_limits: pieces of at most ``size`` units, ``overlap`` units shared by neighbours."""

    unit: str
    size: int
    overlap: int

    def __post_init__(self) -> None:
        if self.unit not in ("chars", "words") or self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError(f"no such limit: {self}")


_LINE_END = re.compile(r"\r\n?|\n")


def normalise(text: str) -> str:
    """NFKC, line ends to ``\\n``, trailing white space of lines off, at most one blank line, ends trimmed."""
    kept: list[str] = []
    for line in map(str.rstrip, _LINE_END.split(unicodedata.normalize("NFKC", text))):
        if line or (kept and kept[-1]):
            kept.append(line)
    return "\n".join(kept).strip()


def _is(points: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(points, np.array([ord(c) for c in chars], points.dtype))


def _spaces(points: np.ndarray) -> np.ndarray:
    return (S.class_table()[points] == S.SPACE) | ((points >= 28) & (points <= 31))


def char_levels(points: np.ndarray) -> np.ndarray:
    """Level of a cut before each code point of one or more texts laid end to end, and after the last."""
    n = len(points)
    level = np.zeros(n + 1, np.int8)
    space, newline = _spaces(points), points == 10
    ends = _is(points, END_MARKS)
    closed = _is(points, CLOSERS)
    ended = ends.copy()
    ended[1:] |= closed[1:] & ends[:-1]
    wide = _is(points, FULL_WIDTH_MARKS)
    wide[1:] |= closed[1:] & wide[:-1]
    level[1:][space] = WORD
    level[2:][space[1:] & ended[:-1]] = SENTENCE
    level[1:][wide] = SENTENCE
    level[:n][space] = HARD  # a cut comes after the white space
    level[1:][newline] = LINE
    level[2:][newline[1:] & newline[:-1]] = PARAGRAPH
    return level


def word_levels(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Level of a cut before each word, and after the last; words are points[start:end]."""
    if not len(start):
        return np.zeros(1, np.int8)
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    between = np.concatenate([[0], lines[start[1:]] - lines[end[:-1]]])
    last = points[end - 1]
    ended = _is(last, END_MARKS + FULL_WIDTH_MARKS)
    before = points[np.maximum(end - 2, 0)]
    ended |= _is(last, CLOSERS) & _is(before, END_MARKS + FULL_WIDTH_MARKS) & (end - start > 1)
    level = np.full(len(start) + 1, WORD, np.int8)
    level[1:][ended] = SENTENCE
    level[:-1][between == 1] = LINE
    level[:-1][between > 1] = PARAGRAPH
    return level


def cuts(levels: np.ndarray, sizes: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, end) of all pieces of items laid end to end; ``levels`` has sizes[i] + 1 entries of each.

    A piece ends at the last most natural place of the window's farther part,
    at the size limit itself if there is none. The next piece starts
    ``overlap`` units before that end, or at the start of the word in which
    that falls, so neighbours share at least the overlap, within the limit.
    An item within the limit is one piece; an empty one has none.
    """
    size, overlap = limit.size, limit.overlap
    base = np.cumsum(sizes + 1) - (sizes + 1)
    at = np.arange(len(levels))
    item = np.repeat(np.arange(len(sizes)), sizes + 1)
    stop = (base + sizes)[item]
    least = at + max(size // 2, overlap + 1)
    reach = np.minimum(at + size, stop)
    end = np.where(at + size >= stop, stop, -1)
    for level in (PARAGRAPH, LINE, SENTENCE, WORD):
        last = np.maximum.accumulate(np.where(levels >= level, at, -1))[reach]
        end = np.where((end < 0) & (last >= least), last, end)
    end = np.where(end < 0, reach, end)
    # The next start: back by the overlap, then to the start of its word unless that is farther than the overlap again.
    back = end - overlap
    word = np.maximum.accumulate(np.where(levels >= WORD, at, -1))[np.maximum(back, 0)]
    back = np.where((overlap > 0) & (word > at) & (back - word <= overlap), word, back)
    after = np.where(end >= stop, at, np.maximum(back, at + 1))
    starts = base[sizes > 0]
    reached = np.zeros(len(levels), bool)
    reached[starts] = True
    count = len(starts)
    while count:
        reached[after[reached]] = True
        after = after[after]
        if (now := int(reached.sum())) == count:
            break
        count = now
    s = np.flatnonzero(reached)
    return item[s], s - base[item[s]], end[s] - base[item[s]]


def pieces_of(texts: list[str], limit: Limit) -> list[list[tuple[int, int, int]]]:
    """Of each text its pieces as (start, end, size): places in code points, size in the limit's unit."""
    points, offsets = S.code_points(texts)
    lengths = np.diff(offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if limit.unit == "chars":
        level = char_levels(points)
        # Each text gets its own closing entry; the first and last are places of cuts anyhow.
        at = S.flat_ranges(offsets[:-1], lengths + 1)
        item, s, e = cuts(level[at], lengths, limit)
        for i, a, b in zip(item.tolist(), s.tolist(), e.tolist()):
            out[i].append((a, b, b - a))
        return out
    space = _spaces(points)
    head = np.zeros(len(points) + 1, bool)
    head[offsets] = True
    inner = ~space
    starts = np.flatnonzero(inner & (head[:-1] | np.concatenate([[True], space[:-1]])))
    ends = np.flatnonzero(inner & (head[1:] | np.concatenate([space[1:], [True]]))) + 1
    of = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    first = np.cumsum(counts) - counts
    level = word_levels(points, starts, ends)
    item, s, e = cuts(level[S.flat_ranges(first, counts + 1)], counts, limit)
    for i, a, b in zip(item.tolist(), s.tolist(), e.tolist()):
        w = first[i]
        out[i].append((int(starts[w + a] - offsets[i]), int(ends[w + b - 1] - offsets[i]), b - a))
    return out


_HEADING = re.compile(r"^#{1,6}[ \t]+(.*?)[ \t]*#*$", re.M)
_SCHEMA = "piece_no int, n_pieces int, start_pos int, end_pos int, piece_size int, item_size int, piece_section string, piece_text string"


def split(items: DataFrame, limit: Limit, normal: bool = False, headings: bool = False, with_text: bool = True) -> DataFrame:
    """The pieces of items (item_id string, draft_no int, version, section string, text string).

    One row per piece: the item's columns but its text, then piece_no from 0,
    n_pieces, start_pos and end_pos in the (with ``normal``: normalised) text,
    the sizes of piece and item in the limit's unit, the section and, unless
    ``with_text`` is off, the text. An item within the limit is one piece; an
    empty, blank (of words) or null text is one piece of size 0. Markdown
    headings before a piece give its section if ``headings`` is set; else it is
    the item's own, null and empty ones as they are. Nothing is shuffled.
    """
    names = ["item_id", "draft_no", "version", "section"]
    kinds = dict(items.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", content_hash bigint, " + _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.portions(batch, "text"):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                if normal:
                    texts = [normalise(t) for t in texts]
                own = pieces_of(texts, limit)
                sections = part.column("section").to_pylist()
                rows: list[tuple] = []
                take: list[int] = []
                for i, (t, p) in enumerate(zip(texts, own)):
                    p = p or [(0, 0, 0)]
                    heads = [(m.start(), m.group(1)) for m in _HEADING.finditer(t)] if headings and len(p) > 1 else []
                    size = len(t) if limit.unit == "chars" else sum(x[2] for x in p) if len(p) == 1 else len(t.split())
                    inside = 0  # headings that begin at or before the piece, of which there are more with each piece
                    for k, (a, b, n) in enumerate(p):
                        while inside < len(heads) and heads[inside][0] <= a:
                            inside += 1
                        rows.append((k, len(p), a, b, n, size, heads[inside - 1][1] if inside else sections[i], t[a:b] if with_text else None))
                        take.append(i)
                index = pa.array(take, pa.int64())
                columns = [part.column(n).take(index) for n in [*names, "content_hash"]]
                types = [*[pa.int32()] * 6, pa.string(), pa.string()]
                cells = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(cells, types))], names=[*names, "content_hash", *(x.split()[0] for x in _SCHEMA.split(", "))])

    own = items.select(*names, F.xxhash64("text").alias("content_hash"), "text")
    return own.mapInArrow(run, schema)


def latest(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Of items delivered more than once the pieces of one delivery: the latest version, of equals the larger hash."""
    once = pieces.dropDuplicates([*key, "version", "content_hash", "piece_no"])
    by = W.Window.partitionBy(*key)
    return once.withColumn("_best", F.max(F.struct("version", "content_hash")).over(by)).filter(F.struct("version", "content_hash").eqNullSafe(F.col("_best"))).drop("_best")


#: Kinds of items.
KINDS = ("doc", "draft", "chunk")


def limits_of(size_limits: DataFrame) -> dict[str, Limit]:
    """The limits by item_kind; a control table of a row per kind."""
    rows = size_limits.filter(F.col("item_kind").isin(*KINDS)).limit(len(KINDS) + 1).collect()
    if sorted(r.item_kind for r in rows) != sorted(KINDS):
        raise ValueError(f"size_limits needs one row for each of {', '.join(KINDS)}")
    return {r.item_kind: Limit(r.size_unit, r.max_size, r.overlap_size) for r in rows}


def split_tables(raw_docs: DataFrame, chunk_drafts: DataFrame, chunk_rows: DataFrame, size_limits: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of all documents, drafts and chunks, each kind by its own limit."""
    limits = limits_of(size_limits)
    none = F.lit(None).cast("string")
    docs = raw_docs.select(F.col("doc_id").alias("item_id"), F.lit(-1).alias("draft_no"), F.col("ingested_at").cast("string").alias("version"), none.alias("section"), F.col("content").alias("text"))
    drafts = chunk_drafts.select(F.col("doc_id").alias("item_id"), "draft_no", none.alias("version"), "section", "text")
    chunks = chunk_rows.select(F.col("chunk_id").alias("item_id"), F.lit(-1).alias("draft_no"), none.alias("version"), none.alias("section"), "text")
    parts = [
        split(items, limits[kind], normal=kind == "doc", headings=kind == "doc", with_text=with_text).withColumn("item_kind", F.lit(kind))
        for kind, items in (("doc", docs), ("draft", drafts), ("chunk", chunks))
    ]
    return latest(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["item_kind", "item_id", "draft_no"])
