"""Main bodies of web pages: site template removal over text.

A page's text is a sequence of elements: lines, the cells of menus and joined
buttons within a line, lists under a heading, and link lines that are a fixed
word around the title of another page. Every element is hashed (digits
masked), as is, with one word left open, and by its fixed part; the hashes are
counted in Spark per host over all pages, and elements that recur across many
pages of a host are its template. Then each page loses the elements that the
templates cover, in the context of their neighbours.

Elements that are titles of pages aren't template for recurring: subheadings
repeat titles. They go only as links: in a list under a recurring list
heading, or with a fixed part around them that stands around titles elsewhere.
"""

from __future__ import annotations

import marshal
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: An element of a host's template is on this share of its pages; one of five words or more with digits on twice as many.
SHARE, WORDY_SHARE, OPEN_SHARE = 0.025, 0.05, 0.03
#: A link's fixed part stands around titles on this share of its host's pages.
LINK_SHARE = 0.002
#: What stands on fewer pages of a host says nothing; a host of fewer pages has no template of its own.
LEAST_PAGES = 3
#: From so many sites whose template it is, a line may be template of any site.
SITES = 3
#: The site of pages that belong to no host.
POOL = 0

# Classes of a hash in the templates.
TEMPLATE, LIST_HEAD, LINK_KEY, OPEN, TITLE = 1, 2, 4, 8, 16
# Kinds of counted elements.
_LINE, _CELL, _OPEN, _HEAD, _KEY, _TITLE = range(6)
_HEAD_MARK = 0x5DEECE66D

_DIGITS = re.compile(r"\d+")
_CELLS = re.compile(r"\s?[|•·]\s+|[^\S\t]{2,}|(?<=[.!?。])\s+")
_CRUMBS = re.compile(r"\s[/>»›→]\s+")
_BULLET = re.compile(r"(?:[-*•·▪◦‣]|\d+[.)])\s+")
_ENDED = re.compile(r"[.!?。！？…][\"'”’»」』)\]]*(?:\s|\Z)|[다요]\.")
_TAGS = re.compile(r"(?:#[^\s#]+\s*)+\Z|(?:태그|키워드|Tags?|Keywords?|タグ|标签)\s*[:：]", re.I)
_SUFFIX = re.compile(r"\s*(?:\(#\)|\[#\]|- \S+ #(?:,#)*)\Z")
_LABEL = re.compile(r"(\S+(?: \S+){0,3}?(?: \||:|：)) (?=\S)")
_NUMBERED = re.compile(r"#[.)]?\s+(?=\S)")


def _hash(kind: int, s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode(), kind)
    return h - (1 << 64) if h >> 63 else h


def _exact(line: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


class Line(NamedTuple):
    """The hashed elements of a line, and what it looks like."""

    line: int
    exact: int
    cells: tuple[int, ...]
    crumb: int
    keys: tuple[int, ...]
    open: tuple[int, ...]
    style: int
    short: bool
    tags: bool


def line_of(line: str) -> tuple[Line, int, list[int]] | None:
    """A line's elements, flags of its form (2: wordy, 1: digits) and, per link key, the hash of the rest; None for a blank line."""
    s = line.strip()
    if not s:
        return None
    tab = "\t" in s
    m = _DIGITS.sub("#", s)
    words = m.split()
    body = " ".join(words)
    digits = "#" in body
    n = len(words)
    if n > 40 and _ENDED.search(s):  # prose, or a notice that recurs as a whole
        return Line(_hash(_LINE, body), _exact(line), (), 0, (), (), 0, False, False), 2 + digits, []
    bullet = bool(_BULLET.match(s))
    ended = bool(_ENDED.search(s))
    cells = [c for c in _CELLS.split(m) if c] if not tab else []
    if len(cells) > 1 and ended and all(_ENDED.search(c) for c in cells):
        cells = []  # sentences only: prose, not a notice with its buttons
    crumbs = [c for c in _CRUMBS.split(m) if c] if not ended else []
    keys: list[int] = []
    rests: list[int] = []
    style = 0
    if not ended and n <= 16 and not tab:

        def key(k: str, rest: str) -> None:
            keys.append(_hash(_KEY, k))
            rests.append(_hash(_LINE, rest))

        if n > 1 and (words[0][-1] in ":：" or words[0] == "#"):
            key(words[0] + " <>", " ".join(words[1:]))
        if n > 2:
            key(" ".join(words[:2]) + " <>", " ".join(words[2:]))
        label = _LABEL.match(body)
        if label and label.group(1).count(" ") > 0:
            key(label.group(1) + " <>", body[label.end() :])
        t = _SUFFIX.search(body) if body[-1] in "#)]" else None
        if t and t.start():
            key("<>" + t.group(), body[: t.start()])
            style = 2
        if digits and not bullet and _NUMBERED.match(body):
            style = 1
    open_: list[int] = []
    if not bullet and not tab:
        if 4 <= n <= 12 and not digits:
            open_ = [_hash(_OPEN, " ".join([*words[:i], "<>", *words[i + 1 :]])) for i in range(n)]
        if 5 <= n <= 14 and not ended:
            # A longer open part between a fixed start and a fixed end.
            open_ += [_hash(_OPEN, " ".join([*words[:a], "<*>", *words[-b:]])) for a, b in ((1, 3), (2, 2), (3, 4)) if a + b + 2 <= n]
    own = Line(
        _hash(_LINE, body), _exact(line), tuple(_hash(_LINE, " ".join(c.split())) for c in cells) if len(cells) > 1 else (), _hash(_LINE, crumbs[0]) if len(crumbs) > 1 else 0,
        tuple(keys), tuple(open_), style, not ended and n <= 16 and not tab and not bullet, not ended and bool(_TAGS.match(s)),
    )
    return own, 2 * ((digits and n > 3) or tab or bullet) + digits, rests


_PAGE = "item_id string, page_id string, site bigint, title_hash bigint, text_hash bigint, lines binary, element array<bigint>, form array<tinyint>, key array<bigint>, rest array<bigint>, hashes array<bigint>"


def host_of(url: F.Column) -> F.Column:
    """The host of a url, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:@\s]+)", 1)), F.lit(""))


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for r in rows for x in r], kind))


def pages(df: DataFrame) -> DataFrame:
    """The hashed elements of items (item_id, page_id, site, title, text), see ``_PAGE``; the text itself stays behind.

    ``lines`` are packed for ``judge``. Of ``element`` and ``form`` there is one
    entry per counted element, its kind in the form; of ``key`` and ``rest`` one
    per possible link; ``hashes`` are all that the templates may know. Items
    delivered twice with the same text count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                titles, hashes, packed = [], [], []
                columns: list[list[list]] = [[] for _ in range(5)]
                for title, text in zip(part.column("title").to_pylist(), part.column("text").to_pylist()):
                    text = text or ""
                    own = [line_of(x) for x in text.split("\n")]
                    elements: dict[int, int] = {}
                    links: set[tuple[int, int]] = set()
                    wanted: set[int] = set()
                    for i, x in enumerate(own):
                        if x is None:
                            continue
                        line, form, rests = x
                        elements[line.line] = _LINE * 4 + form
                        for c in line.cells:
                            elements.setdefault(c, _CELL * 4 + form)
                        for o in line.open:
                            elements[o] = _OPEN * 4
                        if line.short and i + 1 < len(own) and own[i + 1] is not None and own[i + 1][0].style:
                            elements[line.line ^ _HEAD_MARK] = _HEAD * 4
                        links.update(zip(line.keys, rests))
                        wanted.update(line.cells, line.keys, line.open, (line.line, line.crumb))
                    title = " ".join(_DIGITS.sub("#", title or "").split())
                    titles.append(_hash(_LINE, title) if title else None)
                    hashes.append(_exact(text))
                    packed.append(marshal.dumps([None if x is None else tuple(x[0]) for x in own]))
                    wanted.discard(0)
                    for c, v in zip(columns, (elements, elements.values(), [k for k, _ in links], [r for _, r in links], wanted)):
                        c.append(list(v))
                kinds = (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("item_id", "page_id", "site")), pa.array(titles, pa.int64()), pa.array(hashes, pa.int64()), pa.array(packed, pa.binary()), *(_lists(c, k) for c, k in zip(columns, kinds))],
                    names=[x.split()[0] for x in _PAGE.split(", ")],
                )

    return df.select("item_id", "page_id", "site", "title", "text").mapInArrow(run, _PAGE).dropDuplicates(["item_id", "text_hash"])


def counted(own: DataFrame) -> DataFrame:
    """(site, hash, n_line, n_cell, n_open, n_head, n_title, wordy, digits, n_pages): on how many pages of a site an element stands, in each kind.

    One shuffle over the elements of all pages, pre-aggregated where they are
    made: a head carries the hash of its line and a title that of its text, so
    all that is known of a hash on a site meets in one row.
    """
    e = own.select("site", F.explode(F.arrays_zip("element", "form")).alias("e"))
    kind = F.shiftright(F.col("e.form").cast("int"), 2)
    bare = F.when(kind == _HEAD, F.col("e.element").bitwiseXOR(F.lit(_HEAD_MARK))).otherwise(F.col("e.element"))
    e = e.select("site", bare.alias("hash"), kind.alias("kind"), (F.col("e.form").bitwiseAND(2) > 0).alias("wordy"), (F.col("e.form").bitwiseAND(1) > 0).alias("digits"))
    titles = own.filter("title_hash is not null").select("site", F.col("title_hash").alias("hash"), F.lit(_TITLE).alias("kind"), F.lit(False).alias("wordy"), F.lit(False).alias("digits"))
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in ((_LINE, "line"), (_CELL, "cell"), (_OPEN, "open"), (_HEAD, "head"), (_TITLE, "title"))]
    by_site = e.unionByName(titles).groupBy("site", "hash").agg(*kinds, F.bool_or("wordy").alias("wordy"), F.bool_or("digits").alias("digits"))
    return by_site.join(own.groupBy("site").agg(F.count("*").alias("n_pages")), "site")


def _many(n: str, share: Column | float) -> Column:
    return F.col(n) >= F.greatest(F.lit(LEAST_PAGES), share * F.col("n_pages"))


def _classes(counts: DataFrame) -> DataFrame:
    """``counts`` with ``class``: what a hash is on its site, by how many of the site's pages it stands on."""
    share = F.when(F.col("wordy"), WORDY_SHARE).otherwise(SHARE)
    template = (F.col("n_title") == 0) & (_many("n_line", share) | _many("n_cell", share))
    # A list heading is template, and often something counted or numbered follows it.
    head = template & (F.col("n_head") > 0) & (F.col("n_head") >= 0.2 * F.col("n_line"))
    parts = ((template, TEMPLATE), (head, LIST_HEAD), (_many("n_open", OPEN_SHARE), OPEN), (F.col("n_title") > 0, TITLE))
    return counts.withColumn("class", sum((F.when(x, c).otherwise(0) for x, c in parts), F.lit(0)))


def classed(own: DataFrame) -> DataFrame:
    """(site, hash, n, class): what a line, cell or title is on its site, and on how many of its pages; what recurs otherwise, only if it has a class."""
    return _classes(counted(own)).select("site", "hash", (F.col("n_line") + F.col("n_cell")).alias("n"), F.col("class").cast("int").alias("class")).filter("n > 0 or class > 0")


def link_keys(own: DataFrame) -> DataFrame:
    """(site, hash, class): the fixed parts that stand around titles of the site's pages."""
    links = own.select("site", F.explode(F.arrays_zip("key", "rest")).alias("l")).select("site", "l.key", F.col("l.rest").alias("hash"))
    titles = own.filter("title_hash is not null").select("site", F.col("title_hash").alias("hash")).distinct().withColumn("_t", F.lit(1))
    known = links.groupBy("site", "key", "hash").agg(F.count("*").alias("n")).join(titles, ["site", "hash"], "left")
    keys = known.groupBy("site", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("_t", F.lit(0))).alias("t"))
    keys = keys.filter((F.col("t") >= 0.25 * F.col("n")) & (F.col("t") >= LEAST_PAGES)).join(own.groupBy("site").agg(F.count("*").alias("n_pages")), "site").filter(_many("t", LINK_SHARE))
    return keys.select("site", F.col("key").alias("hash"), F.lit(LINK_KEY).alias("class"))


class Known(NamedTuple):
    """Templates (site, hash, class) of all sites, and the further sites of pages (item_id, text_hash, site, hashes)."""

    classes: DataFrame
    moved: DataFrame
    owners: DataFrame  # (hash, at): lines that are template of one site only


def other_site(own: DataFrame, owners: DataFrame) -> DataFrame:
    """(item_id, text_hash, at): the site, other than its own, most of whose own lines an item has."""
    lines = own.select("item_id", "text_hash", "site", F.explode(F.arrays_zip("element", "form")).alias("e")).filter(F.shiftright(F.col("e.form").cast("int"), 2) == _LINE).select("item_id", "text_hash", "site", F.col("e.element").alias("hash"))
    votes = lines.join(owners, "hash").filter("site is null or site <> at").groupBy("item_id", "text_hash", "at").agg(F.count("*").alias("n"), F.max("site").alias("site")).filter("n >= 2 or site is null")
    return votes.groupBy("item_id", "text_hash").agg(F.max(F.struct("n", (-F.col("at")).alias("at")))["at"].alias("at")).select("item_id", "text_hash", (-F.col("at")).alias("at"))


def learn(own: DataFrame) -> Known:
    """The templates of every site from its own pages, and which pages carry the template of another site than their url names.

    A mirror keeps the chrome of the site it was copied from: a page also
    belongs to the site most of whose own lines it has (lines that are template
    of that site only; two at least, the least site on a tie). So do pages
    whose url names no site. What then belongs nowhere, or to a site of too few
    pages to count, is counted as one more site, the pool.

    A line that is template of one site says nothing about others, unless it
    is template of ``SITES`` sites at least and half of all its places are
    there: then it is template wherever it isn't a title.
    """
    named = own.filter("site is not null")
    c = cut(classed(named))
    is_template = F.col("class").bitwiseAND(TEMPLATE) > 0
    over = c.groupBy("hash").agg(F.sum("n").alias("n"), F.sum(F.when(is_template, F.col("n"))).alias("t"), F.count_if(is_template).alias("sites"), F.min(F.when(is_template, F.col("site"))).alias("at"), F.bit_or(F.when(is_template, F.col("class").bitwiseAND(TEMPLATE | LIST_HEAD)).otherwise(0)).alias("_p")).filter("sites > 0")
    over = cut(over.filter((F.col("sites") == 1) | ((F.col("sites") >= SITES) & (2 * F.col("t") >= F.col("n")))))
    everywhere = over.filter("sites > 1").select("hash", "_p")
    titled = F.col("class").bitwiseAND(TITLE) > 0
    classes = c.join(everywhere, "hash", "left").withColumn("class", F.when(titled, F.col("class")).otherwise(F.col("class").bitwiseOR(F.coalesce("_p", F.lit(0))))).filter("class > 0").select("site", "hash", "class")
    classes = cut(classes.unionByName(link_keys(named)))
    owners = over.filter("sites = 1").select("hash", "at")
    best = other_site(own, owners)
    few = named.groupBy("site").agg(F.count("*").alias("n")).filter(F.col("n") < LEAST_PAGES).select("site", F.lit(True).alias("_few"))
    narrow = own.select("item_id", "text_hash", "site", "hashes").join(best, ["item_id", "text_hash"], "left").join(few, "site", "left")
    moved = cut(narrow.withColumn("site", F.coalesce("at", F.when(F.col("site").isNull() | F.col("_few"), F.lit(POOL)))).filter("site is not null").select("item_id", "text_hash", "site", "hashes"))
    loose = own.drop("site", "hashes").join(moved.filter(F.col("site") == POOL), ["item_id", "text_hash"])
    if not loose.isEmpty():
        loose = cut(loose)
        pool = classed(loose).select("hash", "class").join(everywhere, "hash", "full").withColumn("class", F.coalesce("class", F.lit(0)))
        pool = pool.withColumn("class", F.when(titled, F.col("class")).otherwise(F.col("class").bitwiseOR(F.coalesce("_p", F.lit(0))))).filter("class > 0")
        classes = cut(classes.unionByName(pool.select(F.lit(POOL).cast("bigint").alias("site"), "hash", "class")).unionByName(link_keys(loose)))
    return Known(classes, moved, owners)


def judge(lines: list[tuple | None], own_title: int | None, known: dict[int, int]) -> list[bool]:
    """Of each line (a ``Line``) whether it is not body, by the classes of its elements and its neighbours."""

    def of(h: int, c: int) -> bool:
        return bool(known.get(h, 0) & c)

    n = len(lines)
    own = [None if x is None else Line(*x) for x in lines]
    out = [False] * n
    for i, x in enumerate(own):
        if x is None:
            continue
        out[i] = (
            of(x.line, TEMPLATE)
            or x.tags
            or (bool(x.cells) and all(of(c, TEMPLATE) for c in x.cells))
            or (x.crumb != 0 and of(x.crumb, TEMPLATE))
            or (not of(x.line, TITLE) and any(of(o, OPEN) for o in x.open))
            or (x.short and own_title != x.line and any(of(k, LINK_KEY) for k in x.keys))
        )
    # Lists under a list heading.
    i = 0
    while i < n:
        if own[i] is None or not of(own[i].line, LIST_HEAD):
            i += 1
            continue
        j = i + 1
        if j < n and own[j] is not None:
            style = own[j].style
            while j < n and own[j] is not None and own[j].short and own[j].style == style and (style or not out[j]):
                if not style and own[j].line == own_title:
                    break
                j += 1
            if not style and j < n and own[j] is not None and not out[j]:
                # The list runs into a paragraph: it ends with the last title of a page, else before the last line, the paragraph's heading.
                j = next((k + 1 for k in range(j - 1, i, -1) if of(own[k].line, TITLE)), max(j - 1, min(j, i + 2)))
            for k in range(i + 1, j):
                out[k] = True
        i = max(j, i + 1)
    return out


def _either(hashes: list[int], classes: list[int]) -> dict[int, int]:
    """The classes of a hash on either of a page's sites."""
    out: dict[int, int] = {}
    for h, c in zip(hashes, classes):
        out[h] = out.get(h, 0) | c
    return out


def judged(own: DataFrame, known: Known) -> DataFrame:
    """(item_id, text_hash, page_id, line_no, exact, out) of the non-blank lines of each item.

    The hashes of an item meet the templates of its site in a join on both, not
    in a broadcast of a set that grows with the corpus. The side of the
    templates has one row a key, so Spark can split a hot key's pages.
    """
    sited = own.filter("site is not null").select("item_id", "text_hash", "site", "hashes").unionByName(known.moved)
    met = sited.select("item_id", "text_hash", "site", F.explode("hashes").alias("hash")).join(known.classes, ["site", "hash"]).groupBy("item_id", "text_hash").agg(F.collect_list("hash").alias("_hash"), F.collect_list("class").alias("_class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                take, no, exact, out = [], [], [], []
                for r, (title, lines, h, c) in enumerate(zip(*(part.column(x).to_pylist() for x in ("title_hash", "lines", "_hash", "_class")))):
                    own_lines = marshal.loads(lines)
                    for i, (x, o) in enumerate(zip(own_lines, judge(own_lines, title, _either(h or [], c or [])))):
                        if x is not None:
                            take.append(r)
                            no.append(i)
                            exact.append(x[1])
                            out.append(o)
                index = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(index), part.column("text_hash").take(index), part.column("page_id").take(index), pa.array(no, pa.int32()), pa.array(exact, pa.int64()), pa.array(out, pa.bool_())], names=["item_id", "text_hash", "page_id", "line_no", "exact", "out"])

    both = own.select("item_id", "text_hash", "page_id", "title_hash", "lines").join(met, ["item_id", "text_hash"], "left")
    return both.select("item_id", "text_hash", "page_id", "title_hash", "lines", "_hash", "_class").mapInArrow(run, "item_id string, text_hash bigint, page_id string, line_no int, exact bigint, out boolean")


def not_body(source_docs: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """(item_id, text_hash, line_no): the lines of pages and of chunks that are not part of the body of their page.

    Templates are counted over the pages of each host and used on that host
    alone (``learn`` says what becomes of pages without one). A chunk's lines
    are lines of its page and are judged there, in their context; a line text
    that a page has several times is out if most of its places are. A chunk
    with a line that its page doesn't have, or without its page, is judged by
    itself, on its page's site or that of its url, and that whose lines it has. Null and empty texts have no
    lines; a row delivered twice counts once; an item with several texts is
    judged in each, told apart by ``text_hash``, Spark's xxhash64 of the text.
    """
    docs = source_docs.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("page_id"), F.xxhash64(host_of(F.col("url"))).alias("_h"), host_of(F.col("url")).alias("_host"), "title", "text")
    own = cut(pages(docs.withColumn("site", F.when(F.col("_host").isNotNull(), F.col("_h")))))
    known = learn(own)
    of_pages = cut(judged(own, known).select("item_id", "text_hash", "line_no", "exact", "out"))
    verdicts = of_pages.groupBy(F.col("item_id").alias("page_id"), "exact").agg((F.avg(F.col("out").cast("int")) >= 0.5).alias("out"))
    chunks = chunk_rows.select(F.col("chunk_id").alias("item_id"), F.col("doc_id").alias("page_id"), "url", "title", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = chunks.select("item_id", "text_hash", "page_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "_x")).filter(F.col("_x").rlike(r"(?U)\S"))
    lines = lines.select("item_id", "text_hash", "page_id", "line_no", F.xxhash64("_x").alias("exact")).join(verdicts, ["page_id", "exact"], "left")
    lines = cut(lines.select("item_id", "text_hash", "line_no", "out").filter("out is null or out"))
    first = of_pages.filter("out").select("item_id", "text_hash", "line_no").unionByName(lines.filter("out").select("item_id", "text_hash", "line_no"))
    alone = lines.filter("out is null").select("item_id", "text_hash").distinct()
    if not alone.isEmpty():
        sites = own.filter("site is not null").select("item_id", "site").unionByName(known.moved.select("item_id", "site")).filter(F.col("site") != POOL).groupBy(F.col("item_id").alias("page_id")).agg(F.max("site").alias("_at"))
        odd = chunks.join(alone, ["item_id", "text_hash"], "left_semi").join(sites, "page_id", "left")
        odd = odd.withColumn("site", F.coalesce("_at", F.when(host_of(F.col("url")).isNotNull(), F.xxhash64(host_of(F.col("url"))))))
        odd = cut(pages(odd))
        moved = odd.select("item_id", "text_hash", "site", "hashes").join(other_site(odd, known.owners), ["item_id", "text_hash"], "left")
        moved = moved.withColumn("site", F.coalesce("at", F.when(F.col("site").isNull(), F.lit(POOL)))).filter("site is not null").drop("at")
        by_self = judged(odd, known._replace(moved=moved)).filter("out").select("item_id", "text_hash", "line_no")
        first = first.join(alone, ["item_id", "text_hash"], "left_anti").unionByName(by_self)
    return first.distinct()


def bodies(df: DataFrame, key: str, found: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` reduced to its body: the lines that ``found`` names for this very text leave, runs of blank lines become one.

    A text of nothing else becomes empty; null stays null.
    """
    lines = found.groupBy("item_id", "text_hash").agg(F.collect_set("line_no").alias("_out")).withColumnsRenamed({"item_id": "_item", "text_hash": "_hash"})
    out = df.join(lines, (F.col(key) == F.col("_item")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_hash")), "left")
    kept = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.coalesce(~F.array_contains("_out", s["i"]), F.lit(True)))
    body = F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"), r"\n{3,}", "\n\n")
    return out.withColumn(text, F.regexp_replace(body, r"^\n+|\n+$", "")).drop("_out", "_item", "_hash")
