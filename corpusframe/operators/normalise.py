"""Enrichment of sections: hierarchy, cross references, keywords, named bodies, dates.

All of it is row-local. The hierarchy is found by splitting at the lines that open a level, so no
line has to leave its section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.functions import text as X

# What opens a subsection, clause, sub-clause, proviso, explanation.
SUBSECTION = r"^\((\p{Nd}+)\)"
CLAUSE = r"^\(([a-z])\)"
SUB_CLAUSE = r"(?i)^\((i{1,3}|iv|v|vi{0,3})\)"
PROVISO = r"(?i)(Provided that|Provided further that)"
EXPLANATION = r"(?i)(Explanation[.—:])"
MAX_KEYWORDS = 20


def _tail(c: Column) -> Column:
    return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))


def _is(line: Column, pattern: str) -> Column:
    return F.rlike(line, F.lit(pattern))


def _label(line: Column, pattern: str) -> Column:
    return F.concat(F.lit("("), F.regexp_extract(line, pattern, 1), F.lit(")"))


def _note(line: Column) -> Column:
    return _is(line, PROVISO) | _is(line, EXPLANATION)


def segments(c: Column) -> Column:
    """Stripped non-blank lines, cut before every subsection line; the first piece precedes them."""
    lines = F.filter(F.transform(F.split(c, "\n"), X.strip), lambda x: x != "")
    return F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), r"\n(?=\(\p{Nd}+\))", -1)


def _clauses(seg: Column) -> Column:
    return F.split(seg, r"\n(?=\([a-z]\))", -1)


def _joined(lines: Column, drop) -> Column:
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.filter(_tail(lines), lambda x: ~drop(x))), " ")


def subsections(segs: Column) -> Column:
    def sub_clause(line):
        return F.struct(_label(line, SUB_CLAUSE).alias("number"), line.alias("text"))

    def clause(part):
        lines = F.split(part, "\n")
        return F.struct(
            _label(part, CLAUSE).alias("number"), _joined(lines, lambda x: _is(x, SUB_CLAUSE) | _note(x)).alias("text"),
            F.transform(F.filter(_tail(lines), lambda x: _is(x, SUB_CLAUSE)), sub_clause).alias("sub_clauses"))

    def subsection(seg):
        parts = _clauses(seg)
        return F.struct(_label(seg, SUBSECTION).alias("number"), _joined(F.split(parts[0], "\n"), _note).alias("text"),
                        F.transform(_tail(parts), clause).alias("clauses"))

    return F.transform(_tail(segs), subsection)


def loose_lines(segs: Column) -> Column:
    """Lines that open nothing: where provisos and explanations are looked for."""
    def of_segment(seg):
        parts = _clauses(seg)
        in_clauses = F.flatten(F.transform(_tail(parts), lambda p: F.filter(_tail(F.split(p, "\n")), lambda x: ~_is(x, SUB_CLAUSE))))
        return F.concat(_tail(F.split(parts[0], "\n")), in_clauses)
    return F.concat(F.split(segs[0], "\n"), F.flatten(F.transform(_tail(segs), of_segment)))


def parse_hierarchy(sections: DataFrame, content: str = "content") -> DataFrame:
    """Adds subsections (with clauses and sub-clauses), provisos and explanations."""
    staged = sections.withColumn("__segs", segments(F.coalesce(content, F.lit(""))))
    staged = staged.withColumn("__loose", loose_lines(F.col("__segs")))
    proviso = lambda x: F.struct(x.alias("text"), F.replace(F.lower(F.regexp_extract(x, PROVISO, 1)), F.lit(" "), F.lit("_")).alias("type"))
    return staged.withColumns({
        "subsections": subsections(F.col("__segs")),
        "provisos": F.transform(F.filter("__loose", lambda x: _is(x, PROVISO)), proviso),
        "explanations": F.transform(F.filter("__loose", lambda x: ~_is(x, PROVISO) & _is(x, EXPLANATION)), lambda x: F.struct(x.alias("text"))),
    }).drop("__segs", "__loose")


def hierarchy_rows(parsed: DataFrame, key: list[str]) -> DataFrame:
    """The parsed hierarchy in long form: level, position path, number, text."""
    def row(level, a, b, c, number, text):
        return F.struct(F.lit(level).alias("level"), a.alias("sub"), b.alias("clause"), c.alias("item"), number.alias("number"), text.alias("text"))
    zero = F.lit(0)
    subs = F.transform("subsections", lambda s, i: row("subsection", i + 1, zero, zero, s["number"], s["text"]))
    clauses = F.flatten(F.transform("subsections", lambda s, i: F.transform(s["clauses"], lambda c, j: row("clause", i + 1, j + 1, zero, c["number"], c["text"]))))
    leaves = F.flatten(F.flatten(F.transform("subsections", lambda s, i: F.transform(s["clauses"], lambda c, j: F.transform(
        c["sub_clauses"], lambda d, k: row("sub_clause", i + 1, j + 1, k + 1, d["number"], d["text"]))))))
    provisos = F.transform("provisos", lambda p, i: row("proviso", zero, zero, i + 1, p["type"], p["text"]))
    notes = F.transform("explanations", lambda p, i: row("explanation", zero, zero, i + 1, F.lit(""), p["text"]))
    return parsed.select(*key, F.inline(F.concat(subs, clauses, leaves, provisos, notes)))


def reference_type(ref: Column) -> Column:
    low = F.lower(ref)
    has = lambda w: F.contains(low, F.lit(w))
    return (F.when(has("section") & ~has("sub"), "section").when(has("sub-section") | has("subsection"), "subsection")
            .when(has("clause") & ~has("sub"), "clause").when(has("sub-clause") | has("subclause"), "sub_clause")
            .when(has("schedule"), "schedule").when(has("form"), "form").when(has("rule"), "rule").when(has("article"), "article")
            .otherwise("other"))


def reference_target(ref: Column, compat: bool = False) -> Column:
    """The number referred to; ``compat`` also accepts letters i, v, x inside the leading word."""
    where = ref if compat else F.regexp_extract(ref, r"(?U)\s([^\s]+)$", 1)
    return X.rx(F.regexp_extract(where, r"(?i)[\p{Nd}()ivx]+", 0), r"^[()]+|[()]+$")


def cross_references(c: Column, compat: bool = False) -> Column:
    found = F.regexp_extract_all(c, F.lit(R.CROSS_REFERENCE), F.lit(0))
    return F.transform(found, lambda r: F.struct(r.alias("reference_text"), reference_type(r).alias("reference_type"),
                                                 reference_target(r, compat).alias("target")))


def keywords(low: Column, terms=R.DOMAIN_TERMS, most: int = MAX_KEYWORDS) -> Column:
    """Domain terms in a stored lower-case text."""
    listed = list(dict.fromkeys(t for ts in terms.values() for t in ts))
    return F.slice(X.hits_in(low, listed), 1, most)


def all_matches(c: Column, patterns: list[str]) -> Column:
    """Distinct matches of several patterns, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(R.uni(p)), F.lit(0)) for p in patterns])))


def normalise(sections: DataFrame, terms=R.DOMAIN_TERMS, compat: bool = False) -> DataFrame:
    """All enrichments of a section table; the content stays as it is."""
    c = F.coalesce("content", F.lit(""))
    staged = parse_hierarchy(sections).withColumn("__low", F.lower(c))
    return staged.withColumns({
        "cross_references": cross_references(c, compat), "keywords": keywords(F.col("__low"), terms), "legal_entities": all_matches(c, R.ENTITIES),
        "dates": all_matches(c, R.DATES), "authorities": all_matches(c, R.AUTHORITIES)}).drop("__low")


def normalise_report(normalised: DataFrame) -> DataFrame:
    deep = (F.size("subsections") > 0) | (F.size("provisos") > 0) | (F.size("explanations") > 0)
    return normalised.groupBy("doc_id").agg(
        F.count("*").alias("sections_processed"), F.count_if(deep).alias("with_hierarchy"), F.count_if(~deep).alias("preserved"),
        F.sum(F.size("cross_references")).alias("cross_references"), F.sum(F.size("keywords")).alias("keywords"))


def fix_section_number(sections: DataFrame) -> DataFrame:
    """Blank numbers read from ``Section N`` at the start of the content; the word Section dropped."""
    given = X.strip(F.coalesce("section_number", F.lit("")))
    read = F.regexp_extract(F.coalesce("content", F.lit("")), R.uni(r"^[Ss]ection\s+(\d+[\w.\-]*)\b"), 1)
    number = F.when(given == "", read).otherwise(given)
    plain = F.when(F.startswith(F.lower(number), F.lit("section")), X.rx(number, r"(?U)^[Ss]ection\s+")).otherwise(
        F.when((given != "") | (read == ""), F.col("section_number")).otherwise(number))
    return sections.withColumn("section_number", F.coalesce(plain, F.lit("")))


def document_stats(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg(
        F.sum(F.length("content")).alias("total_characters"), F.lit("RAG-ready").alias("processing_stage"),
        F.lit(True).alias("sections_merged"), F.lit(True).alias("normalized"))
