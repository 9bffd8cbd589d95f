"""Glyph tables: texts set in lines and pages, as a reader of page files would report them.

A page is a row with an array of glyphs in reading order. Words that a line's end divides get a hyphen, and ``fi`` is set as one
ligature, so that reading the text back takes composition and dehyphenation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLYPH = "struct<block:int,line:int,span:int,char:int,c:string,x0:double,y0:double,x1:double,y1:double>"
FIELDS = ("block", "line", "span", "char", "c", "x0", "y0", "x1", "y1")
#: What text is read from.
TEXT_FIELDS = ("block", "line", "c")
PAGES = f"doc_id long, page int, glyphs array<{GLYPH}>"
#: Lines of a block and glyphs of a span.
BLOCK_LINES, SPAN_CHARS = 10, 20
#: Width of a glyph, height of a line and of its glyphs.
ADVANCE, LEADING, HEIGHT = 6.0, 12.0, 10.0


def typeset(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", columns: int = 60, lines: int = 40) -> DataFrame:
    """(``doc_id``, ``page``, ``glyphs``): texts in lines of ``columns`` glyphs, ``lines`` a page, pages from 1 on.

    White space is a blank glyph. Null and empty texts have no pages. Repeated ids have pages of their own each.
    """
    return set_sheets(sheets(docs, doc_id, text, columns, lines), columns, lines).select("doc_id", "page", "glyphs")


def sheets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", columns: int = 60, lines: int = 40) -> DataFrame:
    """(``doc_id``, ``page``, ``sheet``): the characters of each page of ``typeset`` and the one behind them. A sheet takes a hundredth of its glyphs."""
    plain = F.replace(F.regexp_replace(F.col(text), r"(?U)\s", " "), F.lit("fi"), F.lit("ﬁ"))
    set_ = docs.where(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), plain.alias("t"))
    per_page = columns * lines
    starts = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / per_page).cast("int"))
    # one character more, to see whether a word goes on
    found = set_.select("doc_id", F.explode(F.transform(starts, lambda p: F.struct(p.alias("p"), F.substring(F.col("t"), p * per_page + 1, F.lit(per_page + 1)).alias("s")))).alias("x"))
    return found.select("doc_id", (F.col("x.p") + 1).cast("int").alias("page"), F.col("x.s").alias("sheet"))


def set_sheets(pages: DataFrame, columns: int = 60, lines: int = 40, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``pages`` of ``sheets`` with ``glyphs``, whatever other columns they have. ``fields``: what is asked of a glyph; texts take ``TEXT_FIELDS``.

    Lambdas run once a line; glyphs are zipped from arrays of their fields, which takes a fraction of a lambda for each.
    """
    n = F.least(F.size("_c"), F.lit(columns * lines))
    numbers = F.sequence(F.lit(0), F.floor((n - 1) / columns).cast("int"))

    def row(line: Column) -> Column:
        upto = (line + 1) * columns
        divided = F.concat(F.get("_c", upto - 1), F.get("_c", upto)).rlike(r"^\p{L}\p{L}$") & (n > upto)
        here = F.slice("_c", line * columns + 1, F.least(F.lit(columns), n - line * columns))
        return F.when(divided, F.concat(here, F.array(F.lit("-")))).otherwise(here)

    def by_line(value: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform("_l", lambda r, line: F.array_repeat(value(line), F.size(r))))

    def by_place(value: Callable[[int], int | float]) -> Column:
        every = F.array(*[F.lit(value(i)) for i in range(columns + 1)])
        return F.flatten(F.transform("_l", lambda r: F.slice(every, F.lit(1), F.size(r))))

    known = {
        "block": lambda: by_line(lambda l: F.floor(l / BLOCK_LINES).cast("int")), "line": lambda: by_line(lambda l: l % BLOCK_LINES), "span": lambda: by_place(lambda i: i // SPAN_CHARS), "char": lambda: by_place(lambda i: i % SPAN_CHARS),
        "c": lambda: F.flatten("_l"), "x0": lambda: by_place(lambda i: i * ADVANCE), "y0": lambda: by_line(lambda l: l * LEADING), "x1": lambda: by_place(lambda i: (i + 1) * ADVANCE), "y1": lambda: by_line(lambda l: l * LEADING + HEIGHT),
    }
    set_ = pages.withColumn("_c", F.array_remove(F.split("sheet", "", -1), "")).withColumn("_l", F.when(F.size("_c") > 0, F.transform(numbers, row)).otherwise(F.array().cast("array<array<string>>")))
    parts = [n for n in FIELDS if n in fields]
    return set_.withColumns({f"_g_{n}": known[n]() for n in parts}).withColumn("glyphs", F.arrays_zip(*[F.col(f"_g_{n}").alias(n) for n in parts])).drop("_c", "_l", *[f"_g_{n}" for n in parts])


def set_lines(pages: DataFrame, columns: int = 60, lines: int = 40) -> DataFrame:
    """``pages`` of ``sheets`` with ``lines``: the characters of each line that ``set_sheets`` sets, as a string."""
    cut = F.regexp_extract_all(F.substring("sheet", 1, columns * lines), F.lit(f"(?s).{{1,{columns}}}"), F.lit(0))

    def row(line: Column, then: Column) -> Column:
        return F.when(F.concat(F.right(line, F.lit(1)), F.left(then, F.lit(1))).rlike(r"^\p{L}\p{L}$"), F.concat(line, F.lit("-"))).otherwise(line)

    return pages.withColumn("_cut", cut).withColumn("lines", F.zip_with("_cut", F.slice("_cut", F.lit(2), F.size("_cut")), row)).drop("_cut")
