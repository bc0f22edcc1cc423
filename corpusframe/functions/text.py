"""Column expressions for cleaning text. Everything here is row-local and stays on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R


def rx(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


#: Unicode white space: what ``(?U)\\s`` means in a pattern.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends. Only the ends are read, where a pattern would try every space of the text."""
    return F.btrim(c, F.lit(SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE))


def squeeze(c: Column) -> Column:
    return rx(c, r"(?U)\s+", " ")


def is_blank(c: Column) -> Column:
    return lstrip(F.coalesce(c, F.lit(""))) == ""


def words(c: Column) -> Column:
    """White-space words in order; no empty entries."""
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def any_of(c: Column, needles: list[str]) -> Column:
    """Whether one of the needles is contained; one that holds another of them adds nothing and is not looked for."""
    least = [n for n in dict.fromkeys(needles) if not any(m != n and m in n for m in needles)]
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in least])


def hits_in(c: Column, needles: list[str]) -> Column:
    """The (non-empty) needles contained in ``c``, in the order given. Hand in a column of an own step: ``c`` is read per needle.

    A second reader keeps that step apart; with one only, the optimiser would compute ``c`` again for every needle.
    """
    found = F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(c, n))
    return F.when(F.length(c) > 0, found).otherwise(F.array().cast("array<string>"))


def at_most(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def fold_rules(c: Column, rules) -> Column:
    return reduce(lambda acc, r: rx(acc, r[1], r[2]), rules, c)


# --- OCR clean-up ---------------------------------------------------------------------------

def tidy_spacing(c: Column) -> Column:
    c = strip(squeeze(c))
    c = rx(c, r"(?U)\s+([.,;:!?)])", "$1")
    return rx(c, r"(?U)([(\[])\s+", "$1")


def clean_ocr_column(c: Column, rules=R.OCR_RULES) -> Column:
    return tidy_spacing(fold_rules(c, rules))


def clean_ocr(df: DataFrame, col: str, rules=R.OCR_RULES, out: str = "cleaned") -> DataFrame:
    """Apply the ordered rules and count how many of them changed the value (``artifacts``).

    Every rule is a projection of its own, so a rule's text is computed once although it is read
    twice (by the next rule and by the counter).
    """
    steps = [f"__s{i}" for i in range(len(rules) + 1)]
    staged = df.withColumn(steps[0], F.col(col))
    for i, (_, pattern, to) in enumerate(rules):
        staged = staged.withColumn(steps[i + 1], rx(F.col(steps[i]), pattern, to))
    changed = reduce(lambda a, b: a + b, [(F.col(a) != F.col(b)).cast("int") for a, b in zip(steps, steps[1:])])
    return staged.withColumns({out: tidy_spacing(F.col(steps[-1])), "artifacts": changed}).drop(*steps)


def rule_report(df: DataFrame, col: str, rules=R.OCR_RULES) -> DataFrame:
    """One row per rule: in how many values it changed something."""
    staged = df.select(F.col(col).alias("__s0"))
    for i, (_, pattern, to) in enumerate(rules):
        staged = staged.withColumn(f"__s{i + 1}", rx(F.col(f"__s{i}"), pattern, to))
    counts = staged.agg(*[F.count_if(F.col(f"__s{i}") != F.col(f"__s{i + 1}")).alias(f"r{i}") for i in range(len(rules))])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("changed")) for i, (name, _, _) in enumerate(rules)])))


def map_strings(dtype: T.DataType, c: Column, fn) -> Column:
    if isinstance(dtype, T.StringType):
        return fn(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: map_strings(dtype.elementType, x, fn))
    if isinstance(dtype, T.StructType):
        fields = [map_strings(f.dataType, c[f.name], fn).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def clean_all_strings(df: DataFrame, rules=R.OCR_RULES) -> DataFrame:
    """Clean every string of every column, nested ones too."""
    return df.select(*[
        map_strings(f.dataType, F.col(f.name), lambda c: clean_ocr_column(c, rules)).alias(f.name)
        for f in df.schema.fields])


def clean_page_text(c: Column) -> Column:
    return strip(fold_rules(c, R.PAGE_RULES))


def fix_confusions(c: Column) -> Column:
    has_digit = F.rlike(c, F.lit(r"\p{Nd}"))
    before, after = R.CONFUSIONS_BEFORE, R.CONFUSIONS_AFTER
    c1 = fold_rules(c, before)
    c2 = F.when(has_digit, rx(c1, R.LONE_I, "1")).otherwise(rx(c1, R.LONE_I, "I"))
    return fold_rules(c2, after)


def text_quality(c: Column) -> Column:
    """Share of plausible characters; 0 when blank, 0.5 when too short to say."""
    good = F.length(rx(c, R.IMPLAUSIBLE))
    return (F.when(is_blank(c), F.lit(0.0))
            .when(F.length(c) < 10, F.lit(0.5))
            .otherwise(F.least(F.lit(1.0), F.try_divide(good, F.length(c)))))


def preserve_layout(c: Column) -> Column:
    def line(x):
        body = strip(squeeze(x))
        return F.when(body == "", F.lit("")).otherwise(
            F.concat(F.repeat(F.lit(" "), F.length(x) - F.length(lstrip(x))), body))
    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def standardise_refs(c: Column) -> Column:
    return fold_rules(c, R.REFERENCE_RULES)


def replace_terms(c: Column, terms=R.TERM_MAP) -> Column:
    return reduce(lambda acc, t: rx(acc, r"(?iu)\Q" + t[0] + r"\E", t[1]), terms, c)


def glossary_arrays(terms_by_language: dict[str, dict[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Longest term first, so that a phrase is replaced before its words."""
    return {lang: sorted(terms.items(), key=lambda kv: -len(kv[0])) for lang, terms in terms_by_language.items()}


def substitute_glossary(text: Column, lang: Column, glossary=None) -> Column:
    out = text
    for code, terms in glossary_arrays(glossary or R.GLOSSARY).items():
        replaced = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), terms, text)
        out = F.when(lang == code, replaced).otherwise(out)
    return out


# --- model responses -------------------------------------------------------------------------

def scrub(c: Column) -> Column:
    c = fold_rules(c, R.SCRUB_RULES)
    return rx(strip(squeeze(c)), r"^[. ,]+")


def answer_block(content: Column, reasoning: Column) -> Column:
    """The answer text, or the answer block inside the reasoning text when the answer is empty."""
    body = strip(F.coalesce(content, F.lit("")))
    block = strip(F.regexp_extract(F.coalesce(reasoning, F.lit("")), R.ANSWER_BLOCK, 0))
    return F.when(body != "", body).otherwise(block)


# --- small ones ------------------------------------------------------------------------------

def clean_title(c: Column, quotes: bool = True) -> Column:
    c = rx(squeeze(c), r"[.]+$")
    if quotes:
        c = rx(c, r"""^["']|["']$""")
    return strip(c)


def slug(c: Column) -> Column:
    c = rx(F.lower(c), r"[^a-z0-9]+", "_")
    return at_most(F.btrim(c, F.lit("_")), 50)


def word_set(c: Column) -> Column:
    """Distinct lower-case words with ASCII punctuation taken as space."""
    return F.array_distinct(words(F.lower(rx(c, R.ASCII_PUNCTUATION, " "))))


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2_000_000_000)))
