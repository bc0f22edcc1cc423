"""Quality rules, line first: clean by line, then judge what is left of the document.

Every line of a text is judged by itself. A line is removed if it is

* ``punctuation``: some symbols of markup, or some marks, are a good part of its characters, or most of its words end in ``!``;
* ``navigation``: a menu or table row, cut up by separators;
* ``boilerplate``: a licence, copyright, cookie or script notice, or a link's label, fills most of it: whole words, so
  that prose in which such words occur stays;
* ``repeated``: equal to an earlier line of the text.

A document is rejected if the base rules fail (too few words, too many words in repeated three-word
windows), or if the lines removed held too much of its text. All of it is column expressions inside the
row: no shuffle, no Python, and no source or group can make one task larger than its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.llm.common import SPACE, ascii_lower

SYMBOLS = "#*$%&|<>"

MARKS = ".,;:!?-_=~^/+()[]{}'\""

#: Notices that are not prose, as patterns of a lower-case line; one that ends in [^\n]* takes the rest of the line.
BOILERPLATE = (
    r"all rights reserved", r"(?:this|the) (?:work|page|file|site|content|document|text|software|article) (?:is|was) (?:licensed|released|published) under[^\n]*",
    r"(?:licensed|released) under the[^\n]*licen[cs]e[^\n]*", r"copyright \(c\)[^\n]*", r"copyright [0-9]{4}[^\n]*", r"terms of (?:service|use)", r"(?:privacy|cookie) policy",
    r"(?:we|this site|this website|this page) uses? cookies[^\n]*", r"(?:please )?enable javascript[^\n]*", r"click here", r"read more", r"sign up", r"log in", r"lorem ipsum[^\n]*",
)
#: A notice between other words, with what parts it from them.
NOTICE = "(?:^|[ '\"(])(?:" + "|".join(BOILERPLATE) + ")(?:$|[ .,;:!?'\")])"


@dataclass(frozen=True)
class Rules:
    """Thresholds in whole numbers, so that every engine decides alike."""
    min_words: int = 50
    max_repeat_pct: int = 50
    #: symbols per 100 non-space characters of a line, from ``min_symbols`` on; marks likewise
    max_symbol_pct: int = 10
    min_symbols: int = 5
    max_mark_pct: int = 40
    min_marks: int = 5
    #: ``!`` characters per 100 words of a line
    max_shout_pct: int = 80
    #: separators (`|`, `»`, `›`, `•`) per 100 words of a line, from ``min_separators`` on
    max_separator_pct: int = 25
    min_separators: int = 3
    #: a line is a notice if it is not longer than this and notices hold that share of it
    max_notice_chars: int = 200
    min_notice_pct: int = 50
    #: text removed, per 100 non-space characters of the document
    max_lost_pct: int = 40


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def solid(text: Column) -> Column:
    """Characters that are not word-separating white space."""
    return F.length(F.translate(text, SPACE, ""))


def _without(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def line_fails(line: Column, rules: Rules) -> Column:
    """True if a line of the text is to be removed for what it holds. What costs most is asked last."""
    n = F.size(F.split(F.trim(line), r"[\x20\x09-\x0D]+"))
    symbols, marks, shouts, separators = _without(line, SYMBOLS), _without(line, MARKS), _without(line, "!"), _without(line, "|»›•")
    low = ascii_lower(line)
    notice = (F.length(line) - F.length(F.regexp_replace(low, NOTICE, ""))) * 100 >= F.length(line) * rules.min_notice_pct
    return (((symbols >= rules.min_symbols) & (symbols * 100 > solid(line) * rules.max_symbol_pct))
            | ((marks >= rules.min_marks) & (marks * 100 > solid(line) * rules.max_mark_pct))
            | ((shouts > 0) & (shouts * 100 > n * rules.max_shout_pct))
            | ((separators >= rules.min_separators) & (separators * 100 > n * rules.max_separator_pct))
            | ((F.length(line) <= rules.max_notice_chars) & notice))


def repeated_words(hashes: str = "__h") -> Column:
    """Words inside three-word windows that occur twice or more, from the sorted (hash, position) pairs in ``hashes``."""
    twice = F.expr(f"filter({hashes}, (x, i) -> (i > 0 and {hashes}[i - 1].h = x.h) or (i + 1 < size({hashes}) and {hashes}[i + 1].h = x.h))")
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the base counts, the cleaned text and the verdict added; every row and column is kept.

    Added (an input column of the same name is replaced): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines_removed, lost_chars, cleaned, kept. A null text counts as empty,
    has no words and is rejected; repeated rows are judged each for itself. Lines without a word stay as
    empty lines. Windows are compared by a 64-bit hash.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "lost_chars", "cleaned", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    rows = docs.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    rows = rows.withColumns({"__w": words(F.col("__t")), "__lines": F.split("__t", "\n", -1)})
    # a line with a word is marked L, one without is B and its number, so that only the former can be equal
    rows = rows.withColumns({
        "__h": F.expr("sort_array(transform(slice(__w, 1, greatest(size(__w) - 2, 0)), (w, i) -> struct(xxhash64(w, __w[i + 1], __w[i + 2]) as h, i as i)))"),
        "__full": F.filter("__lines", lambda x: solid(x) > 0),
        "__left": F.array_distinct(F.filter(
            F.transform("__lines", lambda x, i: F.when(solid(x) == 0, F.concat(F.lit("B"), i.cast("string"))).when(~line_fails(x, rules), F.concat(F.lit("L"), x))),
            lambda x: x.isNotNull()))})
    # the row number keeps a later filter on ``kept`` above this step; pushed below it, it would be computed again for every element of the arrays
    counts = rows.select(
        *own, F.col("__t"), F.monotonically_increasing_id().alias("__row"), F.size("__w").cast("long").alias("n_words"), solid(F.col("__t")).cast("long").alias("word_chars"),
        _without(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"), (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        repeated_words().cast("long").alias("n_repeat_words"), (F.size("__lines") - F.size("__left")).cast("long").alias("n_lines_removed"),
        F.array_join(F.transform("__left", lambda x: F.when(F.startswith(x, F.lit("L")), F.substr(x, F.lit(2))).otherwise("")), "\n").alias("cleaned"))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct)
    judged = counts.withColumns({"base_failed": failed, "lost_chars": (F.col("word_chars") - solid(F.col("cleaned"))).cast("long")})
    kept = (F.col("__row") >= 0) & ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_pct)
    return judged.select(*own, *[(kept.alias(c) if c == "kept" else F.col(c)) for c in made])


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with the lines that failed taken out of their texts; the columns of ``docs``.

    A text without a failing line is returned as it was. ``n_chars`` follows the text.
    """
    judged = measure(docs, "text", rules).filter("kept")
    fresh = {"text": F.when(F.col("n_lines_removed") > 0, F.col("cleaned")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length(fresh["text"]).cast(docs.schema["n_chars"].dataType)
    return judged.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
