"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Defined results: a null, empty or blank text has no words, fails the base rule
and is not kept; a very long text is one row like any other; repeated rows and
rows without an id give a result each; lines are parted by \\n alone, so other
line ends are characters of a line; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in that is was he for it with as his on be at by i this had not are but from or have an they which"
    " de la le et les des en un une du que est pour qui dans par au ne se pas plus"
    " el los las y del con una su al lo como para es"
    " der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= metric <= high``; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Thresholds as published for web text (n-gram repetition, symbol, line and
#: stop-word ratios); they do not depend on the size of the table.
RULES = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("dup_line_share", None, 0.4),
    Rule("ellipsis_line_share", None, 0.3),
    Rule("bullet_line_share", None, 0.9),
    Rule("letter_share", 0.6, None),
    Rule("n_stop_words", 2, None),
    Rule("upper_share", None, 0.4),
)

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, the contract's counts and the metrics that the rules name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col), text.alias("t")).select(id_col, "t", words(F.col("t")).alias("w"))
    d = d.select(
        id_col,
        "t",
        "w",
        F.size("w").alias("n"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{BLANKS}]")).alias("lines"),
        F.array_join("w", "").alias("chars"),
    )
    # A 3-word window is a 64-bit hash of its words' hashes; equal hashes stand for equal windows.
    d = d.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    d = d.select("*", F.expr("transform(slice(h, 3, n), (x, i) -> xxhash64(h[i], h[i + 1], x))").alias("g"))
    # Only texts with a repeated window are sorted: equal neighbours are the repeated windows.
    d = d.select("*", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.arrays_zip("g", F.expr("sequence(1, size(g)) AS p")))).alias("s"))
    d = d.select(
        "*",
        F.expr("sort_array(transform(filter(s, (x, i) -> (i > 0 and x.g = s[i - 1].g) or (i + 1 < size(s) and x.g = s[i + 1].g)), x -> x.p))").alias("marked"),
    )
    n, lines = F.col("n").cast("double"), F.size("lines")
    share = lambda count, of: F.when(of > 0, count / of).otherwise(F.lit(0.0))
    return d.select(
        id_col,
        # A filter on the verdict must not be evaluated below, where it would repeat all of this for each condition.
        F.monotonically_increasing_id().alias("at"),
        F.col("n").cast("long").alias("n_words"),
        F.length("chars").cast("long").alias("word_chars"),
        F.regexp_count("chars", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(
            # Of two marked positions with distance d, the later one covers min(d, 3) further words.
            F.expr("3L * size(marked) - aggregate(zip_with(slice(marked, 2, size(marked)), marked, (q, p) -> greatest(3 - (q - p), 0)), 0L, (acc, x) -> acc + coalesce(x, 0))"),
            F.lit(0).cast("long"),
        ).alias("n_repeat_words"),
        share(F.length("chars"), n).alias("mean_word_chars"),
        share(F.regexp_count("chars", F.lit("[#*$%&|<>]")), n).alias("symbols_per_word"),
        share(lines - F.size(F.array_distinct("lines")), lines).alias("dup_line_share"),
        share(F.size(F.filter("lines", lambda x: x.rlike(f"(\\.\\.\\.|…)[{BLANKS}]*\\z"))), lines).alias("ellipsis_line_share"),
        share(F.size(F.filter("lines", lambda x: x.rlike(f"^[{BLANKS}]*[-*•]"))), lines).alias("bullet_line_share"),
        share(F.length("chars") - F.regexp_count("chars", F.lit(r"\P{L}")), F.length("chars")).alias("letter_share"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, STOP_WORDS)))).alias("n_stop_words"),
        share(F.regexp_count("chars", F.lit(r"\p{Lu}")), F.length("chars")).alias("upper_share"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``."""
    base_failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = F.col("at") >= 0
    for r in rules:
        if r.low is not None:
            passed &= F.col(r.metric) >= r.low
        if r.high is not None:
            passed &= F.col(r.metric) <= r.high
    d = measured(docs, id_col=id_col, text_col=text_col).select("*", base_failed.alias("base_failed"))
    return d.select("*", (~F.col("base_failed") & passed).alias("kept")).drop("at")
