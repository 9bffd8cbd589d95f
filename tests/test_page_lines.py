import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import glyphs
from palimpsest.plans import process_pages as life
from palimpsest.sources.typeset import TEXT_FIELDS, set_lines, set_sheets, sheets

KINDS = ["ab cd-ef gh ", "ab--   é ﬁ½ß", "áö x", "각 가", "😀 x-y ", "\t  a\x00\x1c\x1f\x1eb", "-\n- a", "¨´ﾞｶ ", "٣- ٤"]
WIDE, LONG = 7, 5


@pytest.fixture(scope="module")
def set_(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(rng.choice(KINDS)) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["", None, " ", "-", "a" * 35, "a" * 36, "a" * 70, "fi" * 40, "é" * 34 + "-x", *KINDS]
    return sheets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), columns=WIDE, lines=LONG)


def facts_of_glyphs(pages):
    mapped = F.size(F.filter("glyph_of", lambda i: i.isNotNull())).cast("long").alias("n_mapped")
    return glyphs.mapped_pages(pages).select("doc_id", "page", "text", F.size("glyphs").cast("long").alias("n_glyphs"), glyphs.raw_text(F.col("glyphs")).alias("raw"), mapped)


def test_lines_give_the_facts_of_glyphs(set_):
    by_line = glyphs.lined_pages(set_lines(set_, WIDE, LONG)).select(*glyphs.FACTS, "n_mapped")
    by_glyph = facts_of_glyphs(set_sheets(set_, WIDE, LONG, TEXT_FIELDS))
    assert by_glyph.count() > 1000 and sorted(by_line.collect()) == sorted(by_glyph.collect())


def test_lines_that_lost_glyphs(set_):
    whole = set_sheets(set_, WIDE, LONG)
    worn = whole.withColumn("glyphs", F.filter("glyphs", lambda g: (g["line"] != 3) | (g["char"] % 5 != 0)))
    fewer = set_lines(set_, WIDE, LONG).withColumn("lines", F.transform("lines", lambda x, i: F.when(i == 3, F.regexp_replace(x, "(?s).(.{0,4})", "$1")).otherwise(x)))
    assert sorted(glyphs.lined_pages(fewer).select(*glyphs.FACTS, "n_mapped").collect()) == sorted(facts_of_glyphs(worn).collect())


def test_pages_without_lines(spark):
    pages = spark.createDataFrame([(1, 1, None), (1, 2, []), (1, 3, ["", "a-", "", "b", " "])], "doc_id long, page int, lines array<string>")
    assert [tuple(r)[1:] for r in glyphs.lined_pages(pages).select(*glyphs.FACTS).orderBy("page").collect()] == [(1, "", 0, ""), (2, "", 0, ""), (3, "ab", 4, "a-\nb\n ")]


def test_characters_that_compose_alone():
    kept = [chr(c) for a, b in ((0x1F, 0x7E), (0xA1, 0x2FF), (0x370, 0x482), (0x2010, 0x2027), (0xFB00, 0xFB06)) for c in range(a, b + 1)]
    assert all(unicodedata.normalize("NFKC", a + b) == unicodedata.normalize("NFKC", a) + unicodedata.normalize("NFKC", b) for a, b in itertools.product(kept, kept))
    assert not any(u.isspace() and u not in " \x1f" for c in kept for u in unicodedata.normalize("NFKC", c))


def test_only_pages_with_findings_are_read_glyph_by_glyph(spark):
    docs = spark.createDataFrame([(1, "Write to first.person@example.org now."), (2, "nothing here to find at all"), (3, None)], "doc_id long, text string")
    asked = []

    def read(pages):
        asked.append({"_hits", "_r"} & set(pages.columns))
        return glyphs.mapped_pages(set_sheets(pages))

    done, _ = life.process_pages(sheets(docs), read=read, facts=lambda p: glyphs.lined_pages(set_lines(p)))
    got = {r.doc_id: (r.route, r.output) for r in done.collect()}
    assert got == {r.doc_id: (r.route, r.output) for r in life.process_pages(sheets(docs), read=read)[0].collect()} and "@" not in got[1][1]
    assert set() not in asked[: len(asked) // 2] and set() in asked[len(asked) // 2 :]
