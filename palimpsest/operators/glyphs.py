"""Glyph-level operators: text from positioned glyphs, rectangles from findings, redaction and its checks.

Page tables (``doc_id``, ``page``, ``glyphs``) hold a page's glyphs as an array, so text and its map to glyphs come from
one row without a shuffle. ``typeset`` makes such tables from texts, ``paged`` from a row a glyph.

Glyphs take a hundred times the room of their text. Where pages are met with findings, ``pages`` may therefore hold what a
page is made from (a ``sheet``, a path) and ``read`` turn such rows into ``mapped_pages``: sources are shuffled, and glyphs
exist only while a page's row is worked on. Where only texts are asked for, and every glyph is one character, the strings of a
page's lines will do (``lined_pages``): no step then runs once a glyph.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_BREAK = "\n\f\n"


def nfkc(text: Column) -> Column:
    """Compatibility composition; non-breaking blanks become blanks. By the ICU library that Spark brings, so that no row waits for Python."""
    plain = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), plain, F.lit(True))


def paged(glyphs: DataFrame) -> DataFrame:
    """(``doc_id``, ``page``, ``glyphs``) from a row a glyph; missing blocks, spans and boxes count as 0."""
    kinds = {"block": "int", "line": "int", "span": "int", "char": "int", "c": "string", **dict.fromkeys(("x0", "y0", "x1", "y1"), "double")}
    fields = [(F.coalesce(F.col(n).cast(k), F.lit(0).cast(k)) if n in glyphs.columns else F.lit(0).cast(k)).alias(n) for n, k in kinds.items() if n != "c"]
    fields.insert(4, F.coalesce("c", F.lit("")).alias("c"))
    return glyphs.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("glyphs"))


#: Stand-ins within a page's text: between glyphs, for a line's end, for a character that goes.
_BETWEEN, _LINE, _GONE = "\x1f", "\n", "\x00"
#: Places in the map of a character without a glyph, and of one that goes.
_NONE, _DROPPED = -1, -2


def mapped_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``glyph_of``: for each character of it the place of its glyph in ``glyphs``, from 0, or null.

    Each glyph is composed (NFKC) by itself and may become several characters, which all map to it. A word divided by a
    hyphen at a line's end is put together, the hyphen gone; other lines are joined by a blank without a glyph. White
    space becomes one blank, mapped to its first glyph, and goes at both ends of the page. Empty and null glyphs have no
    characters; a page without others has an empty text.

    Every step replaces characters by as many, so the text stays aligned with its glyphs; what stands in for those that go is
    dropped from both at the end. Of a glyph's fields only ``block``, ``line`` and ``c`` are asked for, and each step is one pass over plain
    strings or numbers: passes over structures take several times as long.
    """
    own = F.coalesce("glyphs", F.array())
    held = F.array_join(own["c"], "", "").rlike(r"[\x00\x1c-\x1f]")
    chars = F.when(held, F.transform(own["c"], lambda c: F.regexp_replace(c, r"[\x00\x1c-\x1f]", " "))).otherwise(own["c"])
    blank = F.regexp_replace(F.array_join(chars, _BETWEEN, ""), r"(?U)[\s&&[^\x1f]]", " ")
    units = F.split(F.regexp_replace(nfkc(blank), r"(?U)[\s&&[^\x1f]]", " "), _BETWEEN, -1)
    at = F.zip_with(own["block"], own["line"], lambda b, l: b.cast("long") * 1_000_000_000 + l)
    some = pages.withColumns({"_u": F.when(F.size(own) > 0, units).otherwise(F.array().cast("array<string>")), "_at": at})
    # places of the glyphs that have characters, if not all have
    full = some.withColumn("_i", F.when(F.array_contains("_u", ""), F.filter(F.transform("_u", lambda u, i: F.when(u != "", i)), lambda i: i.isNotNull())))
    places = full.withColumns({n: F.when(F.col("_i").isNull(), F.col(n)).otherwise(F.transform("_i", functools.partial(F.get, n))) for n in ("_u", "_at")})
    ended = F.transform("_u", lambda u, i: F.when(F.get("_at", i) != F.get("_at", i - 1), F.concat(F.lit(_LINE), u)).otherwise(u))
    lined = places.withColumn("_u", ended)

    def refs(u: Column, i: Column) -> Column:
        place = F.coalesce(F.get("_i", i), i)
        several = F.array_repeat(place, F.length(u) - 1)
        return F.when(F.length(u) == 1, F.array(place)).otherwise(F.when(F.startswith(u, F.lit(_LINE)), F.concat(F.array(F.lit(_NONE)), several)).otherwise(F.concat(F.array(place), several)))

    joined = F.regexp_replace(F.array_join("_u", ""), r"-\n(?= *[\p{L}\p{N}])", _GONE + _GONE)
    single = F.regexp_replace(F.replace(joined, F.lit(_LINE), F.lit(" ")), r" (?<=^ |^\x00\x00 |  | \x00\x00 )", _GONE)
    final = F.regexp_replace(single, r" (?=\x00*$)", _GONE)
    texted = lined.withColumns({"_final": final, "_refs": F.flatten(F.transform("_u", refs))})
    # arrays meet side by side: one that is named within a lambda may be worked out again for every element
    left = F.array_remove(F.zip_with("_refs", F.split("_final", "", -1), lambda i, ch: F.when(ch == _GONE, _DROPPED).otherwise(i)), _DROPPED)
    map_ = F.transform(F.when(F.contains("_final", F.lit(_GONE)), left).otherwise(F.col("_refs")), lambda i: F.when(i >= 0, i))
    return texted.withColumns({"text": F.replace("_final", F.lit(_GONE), F.lit("")), "glyph_of": F.when(F.size("_u") > 0, map_).otherwise(F.array().cast("array<int>"))}).drop("_u", "_at", "_i", "_final", "_refs")


#: Characters that compose alike side by side and one by one, as none joins the one before it, and no white space but the blank.
_APART = r"\x1f-\x7e\u00a1-\u02ff\u0370-\u0482\u2010-\u2027\u4e00-\u9fff\ufb00-\ufb06"


def lined_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, ``n_glyphs`` and ``raw`` as ``page_facts`` of ``mapped_pages`` has them, and ``n_mapped``, the characters of ``text`` that stem from a glyph.

    ``lines`` holds a page's glyphs, one character each, as a string for each line; an empty line counts as none. All steps are passes
    over the whole string of a page.
    """
    own = F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x != "")
    held = F.array_join("_own", "").rlike(r"[\x00\x1c-\x1f]")
    chars = F.when(held, F.transform("_own", lambda x: F.regexp_replace(x, r"[\x00\x1c-\x1f]", " "))).otherwise(F.col("_own"))

    def composed(text: Column) -> Column:
        return F.regexp_replace(nfkc(F.regexp_replace(text, r"(?U)\s", " ")), r"(?U)\s", " ")

    given = pages.withColumn("_own", own).withColumns({"raw": F.array_join("_own", "\n"), "_s": F.array_join(chars, _BETWEEN)})
    # glyphs compose by themselves: a stand-in behind each keeps them from their neighbours, where there may be any to keep from
    lone = F.replace(composed(F.regexp_replace("_s", r"(?s)(.)", "$1\x1e")), F.lit("\x1e"), F.lit(""))
    units = F.when(F.col("_s").rlike(r"^[ -~\x1f]*\z"), F.col("_s")).when(F.col("_s").rlike(rf"^[{_APART}]*\z"), nfkc(F.col("_s"))).otherwise(lone)
    joined = F.regexp_replace(F.replace(units, F.lit(_BETWEEN), F.lit(_LINE)), r"-\n(?= *[\p{L}\p{N}])", "")
    single = F.regexp_replace(F.regexp_replace(joined, r"([ \n])[ \n]+", "$1"), r"^[ \n]|[ \n]\z", "")
    texted = given.withColumn("_t", single).withColumns({"text": F.replace("_t", F.lit(_LINE), F.lit(" ")), "n_mapped": F.length(F.replace("_t", F.lit(_LINE), F.lit(""))).cast("long")})
    return texted.withColumn("n_glyphs", F.length(F.array_join("_own", "")).cast("long")).drop("_own", "_s", "_t")


Read = Callable[[DataFrame], DataFrame]

#: Columns of ``page_facts``.
FACTS = ("doc_id", "page", "text", "n_glyphs", "raw")


def page_facts(mapped: DataFrame) -> DataFrame:
    """What is asked of every page later on, without its glyphs: (``doc_id``, ``page``, ``text``, ``n_glyphs``, ``raw``)."""
    return mapped.select("doc_id", "page", "text", F.size("glyphs").cast("long").alias("n_glyphs"), raw_text(F.col("glyphs")).alias("raw"))


def document_text(mapped: DataFrame) -> DataFrame:
    """(``doc_id``, ``text``, ``pages``) of ``mapped_pages``: texts of a document's pages, ``PAGE_BREAK`` between them.

    ``pages``: ``page``, ``start`` and ``end`` of each page in the text.
    """
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    docs = mapped.groupBy("doc_id").agg(parts.alias("_p")).withColumn("text", F.array_join(F.transform("_p", lambda p: p["text"]), PAGE_BREAK))
    kind = "array<struct<page:int,start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p["text"])
        return F.struct((end + len(PAGE_BREAK)).alias("at"), F.concat(a["found"], F.array(F.struct(p["page"].cast("int").alias("page"), a["at"].alias("start"), end.alias("end")))).cast(kind).alias("found"))

    return docs.select("doc_id", "text", F.aggregate("_p", start, step, lambda a: a["found"]).alias("pages"))


def page_text(glyphs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text``) of a row a glyph: lines joined, divided words put together, pages apart by a form feed."""
    return document_text(mapped_pages(paged(glyphs))).select("doc_id", "text")


def mapped_findings(found: DataFrame, mapped: DataFrame, column: str = "merged", read: Read | None = None) -> DataFrame:
    """A row for each finding of a document's text and page it touches: where it lies there, and its glyphs.

    ``found``: documents of ``document_text`` with findings. Columns: ``doc_id``, ``start``, ``end``, ``category``, ``value``,
    ``page``, ``refs`` (each glyph's block, line, span and box) and ``n_mapped``, characters other than blanks that have a glyph.
    A page is read once, after its findings have come to it. ``read``: if given, ``mapped`` holds what it reads.
    """
    rows = found.select("doc_id", F.explode(column).alias("f"), "pages").select("doc_id", F.col("f.start").alias("start"), F.col("f.end").alias("end"), "f.category", "f.value", "pages")
    met = F.filter("pages", lambda p: (p["start"] < F.col("end")) & (F.col("start") < p["end"]))
    on_page = rows.select("doc_id", "start", "end", "category", "value", F.explode(met).alias("p")).select(
        "doc_id", "start", "end", "category", "value", F.col("p.page").alias("page"), F.greatest(F.col("start") - F.col("p.start"), F.lit(0)).alias("_a"), (F.least("end", "p.end") - F.col("p.start")).alias("_e")
    )
    fields = ("start", "end", "category", "value", "_a", "_e")
    hits = on_page.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*fields)).alias("_hits"))
    pages = (mapped.select("doc_id", "page", "text", "glyphs", "glyph_of") if read is None else mapped).join(hits, ["doc_id", "page"])
    whole = pages if read is None else read(pages)
    joined = whole.select("doc_id", "page", F.col("text").alias("_text"), "glyphs", "glyph_of", F.explode("_hits").alias("h")).select("doc_id", "page", "_text", "glyphs", "glyph_of", "h.*")
    own = F.slice("glyph_of", F.col("_a") + 1, F.col("_e") - F.col("_a"))
    chars = F.split(F.substring("_text", F.col("_a") + 1, F.col("_e") - F.col("_a")), "", -1)
    solid = F.size(F.filter(F.zip_with(own, chars, lambda i, ch: i.isNotNull() & (ch != " ")), lambda x: x))
    refs = F.transform(F.array_distinct(F.filter(own, lambda i: i.isNotNull())), lambda i: F.get("glyphs", i))
    return joined.select("doc_id", "start", "end", "category", "value", "page", refs.alias("refs"), solid.cast("long").alias("n_mapped"))


#: Share of a finding's characters that must have a glyph.
SURE = 0.95


def finding_confidence(found: DataFrame, mapped: DataFrame | None, column: str = "merged", parts: DataFrame | None = None) -> DataFrame:
    """(``doc_id``, ``start``, ``end``, ``category``, ``value``, ``confidence``, ``n_boxes``, ``unsafe``) of each finding.

    ``confidence``: the share of characters other than blanks that have a glyph, 1 where there are none. A finding below ``SURE``, or
    without any box, is not safe to redact. ``parts``: the ``mapped_findings``, if they are there already.
    """
    key = ["doc_id", "start", "end", "category"]
    parts = mapped_findings(found, mapped, column) if parts is None else parts
    boxes = F.size(F.array_distinct(F.transform("refs", lambda g: F.struct(g["block"].alias("block"), g["line"].alias("line"), g["span"].alias("span")))))
    sums = parts.groupBy(*key).agg(F.sum("n_mapped").alias("_n"), F.sum(boxes).alias("_b"))
    rows = found.select("doc_id", F.explode(column).alias("f")).select("doc_id", F.col("f.start").alias("start"), F.col("f.end").alias("end"), "f.category", "f.value")
    need = F.length(F.regexp_replace("value", r"(?U)\s", ""))
    share = F.when(need > 0, F.coalesce("_n", F.lit(0)) / need).otherwise(1.0)
    joined = rows.join(sums, key, "left").withColumns({"confidence": share, "n_boxes": F.coalesce("_b", F.lit(0)).cast("long")})
    return joined.withColumn("unsafe", (F.col("confidence") < SURE) | (F.col("n_boxes") == 0)).drop("_n", "_b")


def mapped_boxes(found: DataFrame | None, mapped: DataFrame | None, column: str = "merged", parts: DataFrame | None = None) -> DataFrame:
    """One rectangle for each finding, page, block, line and span: the union of its glyphs' boxes. ``parts`` as for ``finding_confidence``."""
    refs = (mapped_findings(found, mapped, column) if parts is None else parts).select("doc_id", "start", "end", "category", "page", F.explode("refs").alias("g"))
    groups = refs.groupBy("doc_id", "start", "end", "category", "page", "g.block", "g.line", "g.span")
    return groups.agg(F.min("g.x0").alias("x0"), F.min("g.y0").alias("y0"), F.max("g.x1").alias("x1"), F.max("g.y1").alias("y1"), F.min("g.char").alias("char"), F.count("*").alias("n_glyphs"))


#: Widths of Helvetica in thousandths of the font size, for the characters of placeholders; fixed values.
LABEL_WIDTHS = {
    "A": 667, "B": 667, "C": 722, "D": 722, "E": 667, "F": 611, "G": 778, "H": 722, "I": 278, "J": 500, "K": 667, "L": 556, "M": 833, "N": 722, "O": 778, "P": 667, "Q": 778, "R": 722, "S": 667, "T": 611, "U": 722,
    "V": 667, "W": 944, "X": 667, "Y": 667, "Z": 611, "0": 556, "1": 556, "2": 556, "3": 556, "4": 556, "5": 556, "6": 556, "7": 556, "8": 556, "9": 556, "_": 556, "[": 278, "]": 278, " ": 278,
}
LABEL_SIZE = 8


def label_fits(label: Column, width: Column, height: Column, size: float = LABEL_SIZE) -> Column:
    """True where a label set in Helvetica fits a box. Other characters than a placeholder's count as wide as a digit."""
    # thousandths by character: as many characters as are left when one is taken out
    known = F.lit(0)
    for c, w in LABEL_WIDTHS.items():
        known = known + (F.length(label) - F.length(F.replace(label, F.lit(c), F.lit("")))) * (w - 556)
    return (height >= size) & ((known + F.length(label) * 556) * size / 1000 <= width)


def finding_boxes(findings: DataFrame, glyphs: DataFrame) -> DataFrame:
    """One rectangle for each finding, page, block, line and span: the union of its glyphs' boxes.

    ``glyphs`` has ``offset``, the glyph's place in its document's text.
    """
    at = findings.select("doc_id", "start", "end", "category", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1)).alias("offset"))
    met = at.join(glyphs.withColumn("offset", F.col("offset").cast("long")).select("doc_id", "offset", "page", "block", "line", "span", "x0", "y0", "x1", "y1"), ["doc_id", "offset"])
    return met.groupBy("doc_id", "start", "end", "category", "page", "block", "line", "span").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_glyphs")
    )


def mapping_confidence(findings: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Share of each finding's characters, blanks aside, that have a glyph; a mapping below 0.95 is not safe."""
    boxes = finding_boxes(findings, glyphs.where(~F.col("c").rlike(r"^\s$")))
    mapped = boxes.groupBy("doc_id", "start", "end", "category").agg(F.sum("n_glyphs").alias("mapped"))
    need = F.length(F.regexp_replace("value", r"\s", ""))
    joined = findings.select("doc_id", "start", "end", "category", need.alias("need")).join(mapped, ["doc_id", "start", "end", "category"], "left")
    share = F.when(F.col("need") > 0, F.coalesce("mapped", F.lit(0)) / F.col("need")).otherwise(1.0)
    return joined.select("doc_id", "start", "end", "category", share.alias("confidence"), (share < 0.95).alias("unsafe"))


def adjacent_merged(boxes: DataFrame, level: float = 1.5, gap: float = 2.0) -> DataFrame:
    """Rectangles of a page merged with the merged one before them where tops and bottoms agree and the gap is small.

    In order of top and left edge, each rectangle is held against what the one before it has grown to: it joins if its top and
    bottom lie less than ``level`` from that rectangle's and its left edge at most ``gap`` behind the right one. This is
    a fold over the rectangles of a page, a few hundred at most, within its row.
    """
    box = "struct<y0:double,x0:double,y1:double,x1:double,n:long>"
    pages = boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("y0", "x0", "y1", "x1")]))).alias("b"))
    start = F.struct(F.lit(None).cast(box).alias("open"), F.array().cast(f"array<{box}>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        o = a["open"]
        joins = (F.abs(x["y0"] - o["y0"]) < level) & (F.abs(x["y1"] - o["y1"]) < level) & (x["x0"] - o["x1"] <= gap)
        joins = F.coalesce(joins, F.lit(False))
        grown = F.struct(
            F.least(o["y0"], x["y0"]).alias("y0"), F.least(o["x0"], x["x0"]).alias("x0"), F.greatest(o["y1"], x["y1"]).alias("y1"), F.greatest(o["x1"], x["x1"]).alias("x1"), (o["n"] + 1).alias("n")
        )
        fresh = F.struct(x["y0"].alias("y0"), x["x0"].alias("x0"), x["y1"].alias("y1"), x["x1"].alias("x1"), F.lit(1).cast("long").alias("n"))
        closed = F.when(joins | o.isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(o)))
        return F.struct(F.when(joins, grown.cast(box)).otherwise(fresh.cast(box)).alias("open"), closed.alias("done"))

    merged = pages.select("doc_id", "page", F.explode(F.aggregate("b", start, step, lambda a: F.concat(a["done"], F.array(a["open"])))).alias("m"))
    return merged.select("doc_id", "page", "m.x0", "m.y0", "m.x1", "m.y1", "m.n")


#: How a rectangle is filled: white under a label or for ``blank``'s sake not at all, else black.
MODES = ("label", "black_box", "blank")


def placed_labels(boxes: DataFrame, mode: str = "label") -> DataFrame:
    """``boxes`` with ``label`` and ``fill``.

    ``label``: a finding's ``placeholder`` stands in its first rectangle that holds it, on white; its other rectangles are black, as are all of
    ``black_box``. ``blank`` leaves rectangles as the page is.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode != "label":
        return boxes.withColumns({"label": F.lit(None).cast("string"), "fill": F.lit("black" if mode == "black_box" else "none")})
    fits = label_fits(F.col("placeholder"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    first = Window.partitionBy("doc_id", "start", "end", "category").orderBy(F.desc("_fits"), "page", "block", "line", "span")
    ranked = boxes.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_n", F.row_number().over(first))
    labelled = ranked.withColumn("label", F.when(F.col("_fits") & (F.col("_n") == 1), F.col("placeholder")))
    return labelled.withColumn("fill", F.when(F.col("label").isNotNull(), "white").otherwise("black")).drop("_fits", "_n")


def redacted(mapped: DataFrame, found: DataFrame, column: str = "planned", mode: str = "label") -> tuple[DataFrame, DataFrame]:
    """Page tables without the glyphs under the rectangles of what is replaced, and the rectangles with their labels.

    ``found``: documents of ``document_text`` with findings that bear ``placeholder``; ``mode`` as in ``placed_labels``. A
    glyph goes if its box shares an area with a rectangle, whatever finding it belongs to.
    """
    boxes = redaction_boxes(found, mapped_findings(found, mapped, column), column, mode)
    return uncovered(mapped.select("doc_id", "page", "glyphs"), rectangles(boxes)), boxes


def redaction_boxes(found: DataFrame, parts: DataFrame, column: str = "planned", mode: str = "label") -> DataFrame:
    """``placed_labels`` of the findings of ``found``, whose ``mapped_findings`` are among ``parts``."""
    marks = found.select("doc_id", F.explode(column).alias("f")).select("doc_id", F.col("f.start").alias("start"), F.col("f.end").alias("end"), "f.category", "f.placeholder")
    return placed_labels(mapped_boxes(None, None, parts=parts).join(marks, ["doc_id", "start", "end", "category"]), mode)


def rectangles(boxes: DataFrame) -> DataFrame:
    """(``doc_id``, ``page``, ``_r``): each page's boxes as an array."""
    corners = ("x0", "y0", "x1", "y1")
    return boxes.groupBy("doc_id", "page").agg(F.collect_list(F.struct("block", "line", "span", "char", F.coalesce("label", F.lit("")).alias("c"), *corners)).alias("_r"))


def uncovered(pages: DataFrame, rects: DataFrame, read: Read | None = None, how: str = "left") -> DataFrame:
    """(``doc_id``, ``page``, ``glyphs``) without what lies under ``rectangles``, with their labels; ``inner``: only of pages that have some."""
    joined = pages.join(rects, ["doc_id", "page"], how).withColumn("_r", F.coalesce("_r", F.array()))
    joined = joined if read is None else read(joined)

    def under(g: Column) -> Column:
        return F.exists("_r", lambda r: (g["x0"] < r["x1"]) & (r["x0"] < g["x1"]) & (g["y0"] < r["y1"]) & (r["y0"] < g["y1"]))

    # no null is among them; array_sort would compare by a lambda
    left = F.sort_array(F.concat(F.filter("glyphs", lambda g: ~under(g)), F.filter("_r", lambda r: r["c"] != "")))
    return joined.select("doc_id", "page", F.when(F.size("_r") > 0, left).otherwise(F.col("glyphs")).alias("glyphs"))


def facts_after(pages: DataFrame, facts: DataFrame, rects: DataFrame, read: Read) -> DataFrame:
    """``page_facts`` after redaction. Only pages with rectangles are read again; others have the ``facts`` that they had."""
    changed = page_facts(mapped_pages(uncovered(pages, rects, read, "inner")))
    return changed.unionByName(facts.join(rects.select("doc_id", "page"), ["doc_id", "page"], "left_anti"))


def raw_text(glyphs: Column) -> Column:
    """A page's glyphs as they stand, a line feed between lines, nothing composed or joined."""
    before = F.concat(F.array(F.lit(None).cast("long")), F.transform(glyphs, lambda g: g["block"].cast("long") * 1_000_000_000 + g["line"]))
    lines = F.zip_with(glyphs, F.slice(before, 1, F.size(glyphs)), lambda g, a: F.concat(F.when(g["block"].cast("long") * 1_000_000_000 + g["line"] != a, "\n").otherwise(""), F.coalesce(g["c"], F.lit(""))))
    return F.array_join(lines, "")


#: Characters a page must have on average, below which a document looks scanned.
MIN_CHARS_PER_PAGE = 10


def inspected(mapped: DataFrame) -> DataFrame:
    """A row a document: ``page_count``, ``characters``, ``pages_without_text``, ``appears_scanned``."""
    found = mapped.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(F.length("text")).alias("characters"), F.count_if(F.length("text") == 0).alias("pages_without_text"))
    return found.withColumn("appears_scanned", F.col("characters") < MIN_CHARS_PER_PAGE * F.col("page_count"))


def page_checks(before: DataFrame, after: DataFrame, originals: DataFrame) -> DataFrame:
    """A row for each page before or after: is it still there, and how many of the document's replaced values can still be read.

    ``before``, ``after``: ``mapped_pages`` or their ``page_facts``; ``originals``: (``doc_id``, ``value``), a row for each finding that was replaced. ``text_left``
    counts values in the page's text, ``glyphs_left`` in its glyphs as they stand. A page that is gone has none left and does not
    pass, nor does one that was not there before.
    """
    values = originals.groupBy("doc_id").agg(F.collect_list("value").alias("_v"))
    before, after = (x if "n_glyphs" in x.columns else page_facts(x) for x in (before, after))
    old = before.select("doc_id", "page", F.lit(True).alias("_old"), F.col("n_glyphs").alias("glyphs_before"))
    new = after.select("doc_id", "page", F.lit(True).alias("_new"), F.col("n_glyphs").alias("glyphs_after"), F.col("text").alias("_text"), F.col("raw").alias("_raw"))
    joined = old.join(new, ["doc_id", "page"], "full").join(values, "doc_id", "left")

    def left(text: str) -> Column:
        return F.coalesce(F.size(F.filter("_v", lambda v: F.contains(F.col(text), v))), F.lit(0)).cast("long")

    state = F.when(F.col("_new").isNull(), "lost").when(F.col("_old").isNull(), "added").otherwise("kept")
    checked = joined.withColumns({"state": state, "text_left": F.when(F.col("_new"), left("_text")).otherwise(0), "glyphs_left": F.when(F.col("_new"), left("_raw")).otherwise(0)})
    passed = (F.col("state") == "kept") & (F.col("text_left") == 0) & (F.col("glyphs_left") == 0)
    return checked.select("doc_id", "page", "state", F.coalesce("glyphs_before", F.lit(0)).alias("glyphs_before"), F.coalesce("glyphs_after", F.lit(0)).alias("glyphs_after"), "text_left", "glyphs_left", passed.alias("passed"))


def document_checks(pages: DataFrame) -> DataFrame:
    """A row a document of ``page_checks``: whether all pages are kept, nothing can be read, and both."""
    found = pages.groupBy("doc_id").agg(
        F.count_if("passed").alias("pages_passed"), F.count("*").alias("pages"), F.bool_and(F.col("state") == "kept").alias("pages_kept"), F.bool_and((F.col("text_left") == 0) & (F.col("glyphs_left") == 0)).alias("redacted")
    )
    rate = F.col("pages_passed") / F.col("pages")
    return found.select("doc_id", "pages", "pages_passed", rate.alias("page_pass_rate"), "pages_kept", "redacted", (F.col("pages_kept") & F.col("redacted")).alias("passed"))


def page_rates(documents: DataFrame, confidence: DataFrame) -> DataFrame:
    """One row over ``document_checks`` and ``finding_confidence``: how many documents and pages, and the shares that were mapped, redacted, kept and verified.

    A document with a finding that is not safe to map is a mapping failure. Shares of nothing are 1.
    """
    mapped = confidence.agg(F.count("*").alias("findings"), F.count_if(~F.col("unsafe")).alias("findings_mapped"), F.count_distinct(F.when(F.col("unsafe"), F.col("doc_id"))).alias("mapping_failures"))
    sums = documents.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.count_if("redacted").alias("_r"), F.count_if("pages_kept").alias("_k"), F.count_if("passed").alias("_p"),
        F.coalesce(F.sum("pages_passed"), F.lit(0)).alias("_pp"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)

    one = sums.join(mapped)  # two rows of counts
    rates = {"mapping_accuracy": share("findings_mapped", "findings"), "redaction_rate": share("_r", "documents"), "pages_kept_rate": share("_k", "documents"), "verification_rate": share("_p", "documents"), "page_pass_rate": share("_pp", "pages")}
    return one.withColumns(rates).drop("_r", "_k", "_p", "_pp", "findings_mapped")
