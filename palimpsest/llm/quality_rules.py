"""Quality rules, line first: clean each line, drop the failing ones, then judge what is left.

Everything is built from DataFrame functions, so it stays in the JVM. All work is inside the row of a
document: no shuffle, and a hot source or a long text costs what its characters cost.

A line fails if it

* is navigation: two or more separators ``|`` or arrows;
* is boilerplate: it names cookies, rights reserved, a licence, a sign-up, a privacy policy and the like;
* carries symbols instead of punctuation: a symbol of ``[#*$%&|<>]`` or ``!!`` for every two words or more;
* shouts: three words or more and no lower-case letter;
* repeats itself: of five words or more, half at most are different.

A line of eight words or more without any final punctuation counts as ``n_unfinished``; it is kept, since
headings, quotes and broken lines lack it too.

A document is rejected when its failing lines hold more than ``max_loss`` of its words, or unfinished
lines more than nine tenths.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import aside, word_parts

SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (
    "(?i)(all rights reserved|cookie (policy|settings)|accept( all)? cookies|privacy policy|terms of (use|service)"
    "|subscribe to our|sign up for|click here|enable javascript|skip to (main )?content"
    "|is licensed under|licensed under the|permission is hereby granted|copyright \\(c\\)|spdx-license-identifier)"
)
NAVIGATION = "\\|[^|]*\\||(»|→|>>)[^»→]*(»|→|>>)"
#: Share of a document's words that failing lines may hold.
MAX_LOSS = 0.5
#: Words below which, and share of repeated words above which, a document fails before its lines are seen.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words in 3-word windows that list ``words`` has twice or more, the first included.

    Windows are compared by a 64-bit hash of their words. Neighbours are met by zipping a list with itself
    moved by one, never by looking into the list from a lambda: a filter on the result may make Spark put
    the list's own expression there, to be computed anew for every element.
    """
    w, n = F.col(words), F.size(words)

    def moved(array: Column, by: int, length: Column) -> Column:
        return F.slice(array, by + 1, F.greatest(length, F.lit(0)))

    pairs = F.zip_with(w, moved(w, 1, n), lambda a, b: F.xxhash64(a, b))
    hashed = df.withColumn("_grams", F.slice(F.zip_with(pairs, moved(w, 2, n), lambda h, c: F.xxhash64(h, c)), 1, F.greatest(n - 2, F.lit(0))))
    some = F.size(F.array_distinct("_grams")) < F.size("_grams")
    ranked = hashed.withColumn(
        "_ranked", F.when(some, F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    r, m = F.col("_ranked"), F.size("_ranked")
    # of two neighbours with one hash, both are marked: _same[k] tells of k and k + 1
    same = ranked.withColumn("_same", F.zip_with(r, moved(r, 1, m), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))))
    before = F.concat(F.array(F.lit(False)), F.slice("_same", 1, F.greatest(F.size("_same") - 1, F.lit(0))))
    both = F.zip_with("_same", before, lambda x, y: x | y)
    covered = F.zip_with(r, both, lambda x, y: F.when(y, F.array(x["i"], x["i"] + 1, x["i"] + 2)).otherwise(F.array().cast("array<int>")))
    marked = same.withColumn(out, F.coalesce(F.when(r.isNotNull(), F.size(F.array_distinct(F.flatten(covered)))), F.lit(0)).cast("long"))
    return marked.drop("_grams", "_ranked", "_same")


#: Each boilerplate expression contains one of these, which are found faster.
_HINTS = ("licensed under", "copyright (c)", "cookie", "reserved", "privacy policy", "terms of", "subscribe to", "sign up", "click here", "javascript", "skip to", "permission is", "spdx-")


def line_fails(line: Column, words: Column) -> Column:
    """True for a line that is navigation, boilerplate, symbols, shouting or repetition; ``words``: those of the line."""
    n = F.size(words)
    symbols = F.regexp_count(line, F.lit(SYMBOLS + "|!!"))
    low = F.lower(line)
    hinted = functools.reduce(operator.or_, (low.contains(x) for x in _HINTS))
    return (
        line.rlike(NAVIGATION)
        | ((symbols > 0) & (2 * symbols >= n))
        | ((n >= 3) & ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}"))
        | ((n >= 5) & (2 * F.size(F.array_distinct(words)) <= n))
        | (hinted & line.rlike(BOILERPLATE))
    )


_WORKING = ("_parts", "_words", "_lines", "_split", "_spoken", "_judged", "_grams", "_ranked", "_same")


def judge(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with word counts, ``cleaned`` text, ``base_failed`` and ``kept``.

    Null and empty texts have no words, fail the base rule and are not kept. Rows are judged one by one, so
    repeated rows get equal verdicts. The result columns replace columns of the same names; columns that bear
    the names of working columns stay.
    """
    docs, back = aside(docs, _WORKING)
    source = F.coalesce(F.col(text), F.lit(""))
    parts = docs.withColumn("_parts", word_parts(source))
    counted = (
        parts.withColumn("_words", F.array_remove("_parts", ""))
        .withColumn("_lines", F.split(source, "\n", -1))
        .withColumn("word_chars", (F.length(source) - F.size("_parts") + 1).cast("long"))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("n_symbols", F.regexp_count(source, F.lit(SYMBOLS)).cast("long"))
        .withColumn("_split", F.transform("_lines", lambda x: F.struct(x.alias("line"), F.array_remove(word_parts(x), "").alias("words"))))
        .withColumn("_spoken", F.filter("_split", lambda x: F.size(x["words"]) > 0))
        .withColumn("n_dup_lines", (F.size("_spoken") - F.size(F.array_distinct(F.transform("_spoken", lambda x: x["line"])))).cast("long"))
    )
    counted = with_repeat_words(counted, "_words", "n_repeat_words").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    )

    def verdict(x: Column) -> Column:
        line, n = x["line"], F.size(x["words"])
        return F.struct(
            line.alias("line"),
            n.cast("long").alias("n"),
            line_fails(line, x["words"]).alias("fails"),
            ((n >= 8) & ~line.rlike("[.!?…:;\"”»)\\]][\\x20\\x09-\\x0D]*$")).alias("unfinished"),
        )

    def words_where(flag: str) -> Column:
        return F.aggregate("_judged", F.lit(0).cast("long"), lambda a, x: a + F.when(x[flag], x["n"]).otherwise(0))

    judged = (
        counted.withColumn("_judged", F.transform("_spoken", verdict))
        .withColumn("n_failed_words", words_where("fails"))
        .withColumn("n_unfinished_words", words_where("unfinished"))
        .withColumn("cleaned", F.array_join(F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"))
    )
    n = F.col("n_words")
    return judged.withColumn(
        "kept",
        ~F.col("base_failed") & (F.col("n_failed_words") <= max_loss * n) & (10 * F.col("n_unfinished_words") <= 9 * n),
    ).drop(*_WORKING).withColumnsRenamed(back)
