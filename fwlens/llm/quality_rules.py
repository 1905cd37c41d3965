"""Line-first quality rules. Native: DataFrame functions only, one scan and no shuffle.

Each line that has a word is judged by itself: punctuation (it must close with a sentence mark, and its words must not be
littered with marks), navigation (separators between short items) and boilerplate (set phrases). Failing lines go; a
document that loses more than a share of its word characters, or fails the base rules, is rejected.

Cases: a null or blank text has no words and fails the base rules; every row is judged alone, so repeated rows get equal
verdicts; an empty table gives an empty result; other columns of the input pass through :func:`clean` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Set phrases of page furniture, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "subscribe to our newsletter", "click here", "sign up now", "lorem ipsum", "skip to content",
)
#: A line closes with one of these, perhaps followed by quotes or brackets.
MARKS, CLOSERS = ".!?:;…。", "\"'”’»)]"


@dataclass(frozen=True)
class LineRules:
    """Thresholds, in percent of words or word characters."""

    marks_per_100_words: int = 30
    separators_per_100_words: int = 20
    boilerplate_max_words: int = 25
    lost_percent: int = 40
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8


def _without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _words(text: Column) -> Column:
    """Words of a text; none for a null or blank one. A one-character separator splits without a pattern matcher."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words whose sequence stands twice or more in the list, each word once.

    Window hashes are sorted with their places; a window repeats if a neighbour has its hash. Lists without any equal
    hashes, the usual case, are told by their distinct count and never sorted.
    """
    # hashes of 2, 4, ... words from hashes of half as many; the window is a power of two
    def doubled(hashes, half):
        def joined(h):
            count = F.greatest(F.size(h) - half, F.lit(0))
            return F.zip_with(F.slice(h, 1, count), F.slice(h, half + 1, count), lambda a, b: F.xxhash64(a, b))

        return _let(hashes, joined)

    hashed, half = F.transform(words, lambda w: F.xxhash64(w)), 1
    while half < window:
        hashed, half = doubled(hashed, half), half * 2

    def covered(pairs):
        same = F.transform(
            F.filter(
                pairs,
                lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)),
            ),
            lambda p: p["i"],
        )
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.array_sort(same), start,
            lambda s, i: F.struct(
                (s["n"] + (i + window) - F.greatest(s["end"], i)).cast("bigint").alias("n"), (i + window).alias("end")
            ),
            lambda s: s["n"],
        )

    def counted(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(_let(pairs, covered))

    return _let(hashed, counted)


def line_facts(line: Column) -> Column:
    """What the rules look at: the line, its words, marks and separators, its end."""
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.struct(
        line.alias("line"), (F.regexp_count(trimmed, F.lit(SPACE)) + 1).alias("n"),
        F.regexp_count(line, F.lit("[#*$%&<>!~=^_]")).alias("marks"), F.regexp_count(line, F.lit("[|»•·]")).alias("separators"),
        F.right(F.rtrim(trimmed, F.lit(CLOSERS)), F.lit(1)).alias("end"),
    )


def line_passes(fact: Column, rules: LineRules) -> Column:
    """Whether a line with at least one word may stay."""
    littered = fact["marks"] * 100 > fact["n"] * rules.marks_per_100_words
    navigation = fact["separators"] * 100 > fact["n"] * rules.separators_per_100_words
    boilerplate = (fact["n"] <= rules.boilerplate_max_words) & F.lower(fact["line"]).rlike("|".join(BOILERPLATE))
    return fact["end"].isin(*MARKS) & ~littered & ~navigation & ~boilerplate


def judged(documents: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``row``, a struct of all input columns, and ``verdict``, one of counts, cleaned text and the decision."""
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    parts = F.struct(
        _words(body).alias("words"),
        F.filter(F.split(body, "\n"), has_word).alias("lines"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    p = F.col("parts")
    passed = F.filter(F.transform(p["lines"], line_facts), lambda fact: line_passes(fact, rules))
    good = F.array_join(F.transform(passed, lambda fact: fact["line"]), "\n")
    counts = F.struct(
        F.size(p["words"]).cast("bigint").alias("n_words"), F.length(F.array_join(p["words"], "")).cast("bigint").alias("word_chars"), p["n_symbols"].alias("n_symbols"),
        (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("bigint").alias("n_dup_lines"),
        repeated_words(p["words"], rules.window).alias("n_repeat_words"), good.alias("clean_text"),
    )
    c = F.col("counts")
    kept_chars = F.length(_without_space(c["clean_text"])).cast("bigint")
    failed = (c["n_words"] < rules.min_words) | (c["n_repeat_words"] * 100 > c["n_words"] * rules.repeat_percent)
    lossy = kept_chars * 100 < c["word_chars"] * (100 - rules.lost_percent)
    # a generator over one struct is not folded into what reads it: each step runs once per row
    row = F.struct(*[F.col(f"`{name}`") for name in documents.columns]).alias("row")
    return (
        documents.select(row, F.explode(F.array(parts)).alias("parts"))
        .select("row", F.explode(F.array(counts)).alias("counts"))
        .select("row", F.explode(F.array(c.withField("kept_chars", kept_chars).withField("base_failed", failed).withField("kept", ~failed & ~lossy))).alias("verdict"))
    )


def quality_table(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the word characters that line rules left."""
    v = F.col("verdict")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")
    return judged(documents.select("doc_id", "text"), rules).select("row.doc_id", *[v[name].alias(name) for name in names])


def clean(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Kept documents with all their columns; the text holds the lines that passed."""
    rows = judged(documents, rules).where(F.col("verdict")["kept"])
    text = F.col("verdict")["clean_text"].alias("text")
    return rows.select(*[text if name == "text" else F.col("row")[name].alias(name) for name in documents.columns])
