"""Page text: clean-up, running headers and footers, assembly with spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import window as W

BLANKS = " \t\n\r"
#: A line that only names a page, and a page mark at a line's end.
PAGE_NUMBER = r"^[-–—\[( ]*(page|p\.|쪽|페이지)? ?[0-9]{1,4}( ?(of|/) ?[0-9]{1,4})? ?(쪽|페이지)?[-–—\]) ]*$"


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(BLANKS))


def clean_body(text: Column) -> Column:
    """Join hyphenated words, join lines between Hangul, drop zero-width characters and trailing blanks, at most one blank line; in this order."""
    t = F.regexp_replace(text, "([A-Za-z])-\n([a-z])", "$1$2")
    t = F.regexp_replace(t, "([가-힣])\n(?=[가-힣])", "$1 ")
    t = F.regexp_replace(t, "[​‌‍﻿]", "")
    t = F.regexp_replace(t, "[ \t]+(\n|$)", "$1")
    return F.regexp_replace(t, "\n{3,}", "\n\n")


def line_key(line: Column) -> Column:
    """A line as repetition sees it: numbers masked, ends stripped, lower case."""
    return F.lower(strip(F.regexp_replace(line, "[0-9]+", "#")))


def pages_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_no, page): texts cut at blank lines, as pages."""
    return docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n\n", -1)).alias("page_no", "page"))


def repeated_lines(pages: DataFrame, key: str) -> DataFrame:
    """(key, place, line): first or last non-blank lines that recur at their place on most pages of a document.

    At most 80 characters, on at least max(3, 60 %) of the pages; nothing in
    documents of fewer than three pages.
    """
    lines = F.filter(F.split("page", "\n", -1), lambda x: strip(x) != "")
    n = pages.groupBy(key).agg(F.count("*").alias("_pages")).filter("_pages >= 3")
    ends = pages.withColumn("_l", lines).filter(F.size("_l") > 0)
    # A page of one line counts at its first place only.
    places = F.filter(F.array(F.struct(F.lit("first").alias("place"), F.col("_l")[0].alias("x")), F.when(F.size("_l") > 1, F.struct(F.lit("last").alias("place"), F.element_at("_l", -1).alias("x")))), lambda s: s.isNotNull())
    e = ends.select(key, F.explode(places).alias("e")).select(key, "e.place", line_key(F.col("e.x")).alias("line"), F.length("e.x").alias("_n"))
    c = e.filter("_n <= 80").groupBy(key, "place", "line").agg(F.count("*").alias("pages"))
    return c.join(n, key).filter(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("_pages") * 0.6))).select(key, "place", "line", "pages")


def spans(pages: DataFrame, key: str) -> DataFrame:
    """(key, page_no, page_start, page_end) of pages joined by a blank line; an empty page keeps its place."""
    w = W.Window.partitionBy(key).orderBy("page_no").rowsBetween(W.Window.unboundedPreceding, 0)
    end = F.sum(F.length("page") + 2).over(w) - 2
    return pages.select(key, "page_no", (end - F.length("page")).cast("int").alias("page_start"), end.cast("int").alias("page_end"))


def page_of(chunks: DataFrame, page_spans: DataFrame, key: str, start: str) -> DataFrame:
    """Add page_no to chunks: the last page that starts at or before the chunk.

    Both sides are sorted together in one window per document (a backward
    as-of join), so that no chunk meets every page.
    """
    marks = page_spans.select(key, F.col("page_start").alias("_at"), F.lit(0).alias("_kind"), F.col("page_no").alias("_page"), F.lit(None).cast("struct<x:int>").alias("_row"))
    own = F.struct(*(c for c in chunks.columns if c != key))
    rows = chunks.select(key, F.col(start).cast("int").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_page"), own.alias("_row"))
    both = marks.drop("_row").unionByName(rows, allowMissingColumns=True)
    w = W.Window.partitionBy(key).orderBy("_at", "_kind", "_page").rowsBetween(W.Window.unboundedPreceding, 0)
    return both.withColumn("page_no", F.last("_page", ignorenulls=True).over(w)).filter("_kind = 1").select(key, "_row.*", "page_no")


def normalise_document(text: Column) -> Column:
    """NFKC, one kind of line end, no trailing blanks, at most one blank line, stripped (an Arrow function: NFKC isn't built in)."""

    @F.pandas_udf(ST.StringType())
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    t = F.regexp_replace(nfkc(text), "\r\n?", "\n")
    t = F.regexp_replace(t, "(?U)[^\\S\n]+(?=\n|\\z)", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "(?U)^\\s+|\\s+$", "")


def document_type(declared: Column) -> Column:
    """The type a document's metadata declares, else general; its text is not read."""
    d = F.lower(strip(declared))
    return F.when(d.isin("math", "finance_table", "policy", "other"), d).otherwise("general")


def is_scanned(text: Column, pages: Column) -> Column:
    """Whether so little text came out of so many pages that they were images."""
    return F.length(strip(F.coalesce(text, F.lit("")))) < 50 * pages


def table_markdown(rows: Column) -> Column:
    """A table (array of arrays of strings) as Markdown; null for fewer than two rows or columns, no content, or a cell over 200 characters."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda x: F.replace(F.regexp_replace(F.coalesce(strip(x), F.lit("")), "\n+", " "), F.lit("|"), F.lit("\\|"))
    padded = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), width), lambda i: cell(F.get(r, i - 1))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    ruler = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: F.lit("---")), " | "), F.lit(" |"))
    flat = F.flatten(padded)
    bad = (F.size(rows) < 2) | (width < 2) | ~F.exists(flat, lambda x: x != "") | F.exists(flat, lambda x: F.length(x) > 200)
    md = F.array_join(F.concat(F.array(line(padded[0]), ruler), F.transform(F.slice(padded, F.lit(2), F.size(padded)), line)), "\n")
    return F.when(~bad, md)
