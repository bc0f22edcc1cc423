"""Page and section extraction. Matches become rows without leaving the row's own task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.functions import text as X
from corpusframe.operators.ordered import left_context


LINE_START = r"(?:^|\n)"


def span_array(c: Column, pattern: str, groups: dict[str, int], body: str = "body") -> Column:
    """array<struct<groups.., body>>: one entry per match, ``body`` = text up to the next match.

    Splitting at the heads gives the bodies, extracting the heads gives the groups. Everything is
    done inside the row: no ordering step, no shuffle.
    """
    if pattern.count(LINE_START) == 1:
        # with a newline put before the text a head begins with a plain newline, which is found faster
        c, pattern = F.concat(F.lit("\n"), c), pattern.replace(LINE_START, r"\n")
    pieces = F.split(c, pattern, -1)
    bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    lists = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in groups.values()]
    names = [*groups, body]
    return F.transform(F.arrays_zip(*lists, bodies), lambda s: F.struct(*[s[str(i)].alias(n) for i, n in enumerate(names)]))


def spans(df: DataFrame, text: str, pattern: str, groups: dict[str, int], body: str = "body",
          index: str = "sec_idx") -> DataFrame:
    """``span_array`` as rows numbered by ``index``."""
    kept = [c for c in df.columns]
    return df.select(*kept, F.posexplode(span_array(F.col(text), pattern, groups, body)).alias(index, "__m")) \
        .select(*kept, index, "__m.*")


def _numbered(c: Column, extra: dict[str, Column]) -> Column:
    """Entries of an array with their position and constant fields."""
    return F.transform(c, lambda s, i: F.struct(i.alias("idx"), s.alias("m"), *[v.alias(k) for k, v in extra.items()]))


def page_type(pages: DataFrame, text: str = "raw_text", words=R.PAGE_TYPE_WORDS) -> DataFrame:
    pages = pages.withColumn("__low", F.lower(F.col(text)))
    low = F.col("__low")
    contents, (name, needles), *others = words
    c = F.when(X.any_of(low, needles), F.lit(name))
    for name, needles in others:
        c = c.when(X.any_of(low, needles), F.lit(name))
    c = c.when(F.contains(low, F.lit("definition")) & (F.length(text) < 5000), F.lit("definition")).otherwise(F.lit("content"))
    # one case inside the other: a filter on contents pages then needs the first test only, not the other words
    first = F.when((F.col("page_number") <= 5) & X.any_of(low, contents[1]), F.lit(contents[0])).otherwise(c)
    return pages.withColumn("page_type", first).drop("__low")


def page_type_simple(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """The narrower rule set: preamble only on page 1, definitions need more than two ``means``."""
    pages = pages.withColumn("__low", F.lower(F.col(text)))
    has = lambda w: F.contains("__low", F.lit(w))
    means = F.size(F.split(F.col(text), "means", -1)) - 1
    c = (F.when((F.col("page_number") <= 3) & has("contents"), F.lit("table_of_contents"))
         .when((F.col("page_number") == 1) & (has("preamble") | has("introduction")), F.lit("preamble"))
         .when(has("definitions") & (means > 2), F.lit("definition"))
         .when(has("schedule"), F.lit("schedule"))
         .when(has("form") & (has("field") | has("signature")), F.lit("form"))
         .otherwise(F.lit("content")))
    return pages.withColumn("page_type", c).drop("__low")


def extraction_gate(pages: DataFrame) -> DataFrame:
    """Pages × kinds to extract: nothing on contents pages, one kind for Acts and Rules, else both."""
    kinds = (F.when(F.col("document_type").isin("Act", "Amendment Act"), F.array(F.lit("section")))
             .when(F.col("document_type") == "Rules", F.array(F.lit("rule")))
             .otherwise(F.array(F.lit("section"), F.lit("rule"))))
    return pages.filter(F.col("page_type") != "table_of_contents").withColumn("kind", F.explode(kinds))


def count_structures(pages: DataFrame) -> DataFrame:
    """Pages with the number of structures of every kind (``n_section`` ...), counted in the text.

    The same numbers as extracting everything and joining it back, without rows, shuffle or join.
    """
    heads = lambda p: F.regexp_count(F.concat(F.lit("\n"), "raw_text"), F.lit(p.replace(LINE_START, r"\n"))).cast("long")
    act, rules = F.col("document_type").isin("Act", "Amendment Act"), F.col("document_type") == "Rules"
    p = pages.withColumn("__n", F.when(F.col("page_type") == "table_of_contents", F.lit(0).cast("long")).otherwise(heads(R.HEAD_LOOSE)))
    return p.withColumns({
        "n_section": F.when(rules, F.lit(0).cast("long")).otherwise(F.col("__n")), "n_rule": F.when(act, F.lit(0).cast("long")).otherwise(F.col("__n")),
        "n_amendment": heads(R.AMENDMENT_OF), "n_definition": heads(R.DEFINITION_HEAD),
        "n_schedule": heads(R.ITEM_HEADS["schedule"]), "n_form": heads(R.ITEM_HEADS["form"])}).drop("__n")


def extract_provisions(pages: DataFrame, keep: list[str] | None = None, pattern: str = R.HEAD_LOOSE) -> DataFrame:
    """Numbered provisions of every page as rows of one section table."""
    gated = extraction_gate(pages).select("doc_id", "page_idx", "page_number", "page_type", *(keep or []), "kind", "raw_text")
    rows = spans(gated, "raw_text", pattern, {"number": 1, "head": 2})
    return rows.select(
        "doc_id", "page_idx", "page_number", "page_type", *(keep or []), "kind", "sec_idx",
        F.col("number").alias("section_number"), X.clean_title(F.col("head")).alias("section_title"),
        X.strip(F.col("body")).alias("content"), F.lit(False).alias("is_continuation"))


def fallback_array(c: Column) -> Column:
    """Provisions by the strict heads, or by the loose heads where the strict ones find nothing."""
    groups = {"number": 1, "head": 2}
    strict, loose = (_numbered(span_array(c, p, groups), {"found_by": F.lit(n)})
                     for p, n in ((R.HEAD_STRICT, "strict"), (R.HEAD_LOOSE, "loose")))
    return F.when(F.rlike(c, F.lit(R.HEAD_STRICT)), strict).otherwise(loose)


def extract_with_fallback(pages: DataFrame, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    rows = pages.select(*key, F.explode(fallback_array(F.col("raw_text"))).alias("s"))
    return rows.select(*key, F.col("s.idx").alias("sec_idx"), F.col("s.m.number").alias("section_number"),
                       X.clean_title(F.col("s.m.head"), quotes=False).alias("section_title"),
                       X.strip(F.col("s.m.body")).alias("content"), "s.found_by") \
        .filter((F.col("content") != "") | (F.col("section_title") != ""))


def amendment_action(c: Column) -> Column:
    low = F.lower(c)
    has = lambda *ws: X.any_of(low, list(ws))
    return (F.when(has("substitution", "substituted"), F.lit("substitution"))
            .when(has("insertion", "inserted"), F.lit("insertion"))
            .when(has("omission", "omitted"), F.lit("omission"))
            .when(has("repeal"), F.lit("repeal"))
            .otherwise(F.lit("amendment")))


def target_section(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?i)section\s+(\d+)", 1), F.lit("")), F.lit("unknown"))


def _whole(head: str = "s.m.head", body: str = "s.m.body") -> Column:
    return X.strip(F.concat(F.col(head), F.col(body)))


def amendment_array(c: Column, numbered: str) -> Column:
    """Substituted sections, then the numbered amending provisions, each with its whole text."""
    field = {"head": 0, "number": 1}
    subs = _numbered(span_array(c, R.SUBSTITUTION, field), {"form": F.lit("substitution")})
    rest = _numbered(span_array(c, numbered, field), {"form": F.lit("amending")})
    return F.concat(subs, rest)


def extract_amendment_sections(pages: DataFrame, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    """Substituted sections and numbered amending sections, with action and target."""
    rows = pages.select(*key, F.explode(amendment_array(F.col("raw_text"), R.AMENDING)).alias("s"))
    rows = rows.select(*key, "s.form", F.col("s.idx").alias("sec_idx"), F.col("s.m.number").alias("section_number"),
                       _whole().alias("content"))
    subst = F.col("form") == "substitution"
    rows = rows.withColumns({
        "amendment_action": F.when(subst, F.lit("substitution")).otherwise(amendment_action(F.col("content"))),
        "target_section": F.when(subst, F.col("section_number")).otherwise(target_section(F.col("content")))})
    return rows.withColumn("section_title", F.concat(X.capitalise(F.col("amendment_action")), F.lit(" of section "), "target_section"))


def extract_amendments(pages: DataFrame, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    """Amendment list of a page: substitutions as ``sub_N`` and ``N. Amendment of section M`` spans."""
    rows = pages.select(*key, F.explode(amendment_array(F.col("raw_text"), R.AMENDMENT_OF)).alias("s"))
    rows = rows.select(*key, F.col("s.idx").alias("item_idx"), "s.form", F.col("s.m.number").alias("number"), F.col("s.m.head").alias("head"),
                       _whole().alias("amendment_text"))
    subst = F.col("form") == "substitution"
    return rows.select(*key, "item_idx", F.when(subst, F.concat(F.lit("sub_"), "number")).otherwise(F.col("number")).alias("amendment_number"),
                       F.when(subst, F.col("number")).otherwise(F.regexp_extract("head", R.AMENDMENT_OF, 3)).alias("target_section"),
                       F.when(subst, F.lit("substitution")).otherwise(amendment_action(F.col("amendment_text"))).alias("amendment_action"),
                       "amendment_text")


def amendment_heads(pages: DataFrame, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    """Head-only form: number, first word as action, target, the head itself."""
    rows = spans(pages.select(*key, "raw_text"), "raw_text", R.AMENDMENT_OF, {"head": 0, "number": 1, "words": 2, "target": 3},
                 index="item_idx")
    return rows.select(*key, "item_idx", F.col("number").alias("amendment_number"), F.col("target").alias("target_section"),
                       F.lower(F.element_at(X.words(F.col("words")), 1)).alias("amendment_action"),
                       X.strip(F.col("head")).alias("amendment_text"))


def extract_definitions(pages: DataFrame, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    """``(a) "term" means`` heads of a page."""
    rows = spans(pages.select(*key, "raw_text"), "raw_text", R.DEFINITION_HEAD, {"head": 0, "clause": 1, "term": 2},
                 index="item_idx")
    return rows.select(*key, "item_idx", "clause", X.strip(F.col("term")).alias("term"),
                       X.strip(F.col("head")).alias("definition_text"))


def definition_lines(pages: DataFrame, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    """Lines of the form ``term means text``."""
    lines = pages.select(*key, F.posexplode(F.split("raw_text", "\n")).alias("line_idx", "line"))
    line = X.strip(F.col("line"))
    return lines.withColumn("line", line).filter(F.rlike("line", F.lit(R.DEFINITION_LINE))).select(
        *key, "line_idx", F.regexp_extract("line", R.DEFINITION_LINE, 1).alias("term"),
        F.regexp_extract("line", R.DEFINITION_LINE, 2).alias("definition"))


def legal_terms(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """Terms that are defined somewhere in the text."""
    found = F.regexp_extract_all(F.col(text), F.lit(R.TERM_USE_FAST), F.lit(1))
    return df.select(*key, F.posexplode(found).alias("term_idx", "term")).withColumn("term", X.strip(F.col("term"))) \
        .filter(F.col("term") != "")


def extract_items(pages: DataFrame, kinds=R.ITEM_HEADS, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    """Schedules, forms and tables as rows of one item table."""
    groups = {"head": 0, "number": 1, "rest": 2}
    found = F.concat(*[_numbered(span_array(F.col("raw_text"), p, groups), {"kind": F.lit(k)}) for k, p in kinds.items()])
    rows = pages.select(*key, F.explode(found).alias("s"))
    return rows.select(*key, F.col("s.kind").alias("item_kind"), F.col("s.idx").alias("item_idx"), "s.m.number",
                       F.nullif(X.strip(F.col("s.m.rest")), F.lit("")).alias("title"), X.strip(F.col("s.m.head")).alias("content"))


def extract_headed_lines(pages: DataFrame, heads=R.HEADED_LINES, key: list[str] = ("doc_id", "page_idx")) -> DataFrame:
    """``Section n: title`` and ``Rule n: title`` lines."""
    lines = pages.select(*key, F.posexplode(F.split("raw_text", "\n")).alias("line_idx", "line")) \
        .withColumn("line", X.strip(F.col("line")))
    kind = F.coalesce(*[F.when(F.rlike("line", F.lit(p)), F.lit(k)) for k, p in heads.items()])
    number = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in heads.values()])
    title = F.coalesce(*[F.when(F.rlike("line", F.lit(p)), F.regexp_extract("line", p, 2)) for p in heads.values()])
    return lines.select(*key, "line_idx", kind.alias("kind"), number.alias("number"), title.alias("title")) \
        .filter(F.col("kind").isNotNull())


def page_continuation(pages: DataFrame) -> DataFrame:
    """Does the page start in the middle of what the previous page left open?"""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    tail = F.struct(X.strip(F.expr("right(coalesce(raw_text, ''), 200)")).alias("end"), (text != "").alias("has_text"))
    with_prev = left_context(pages, ["doc_id"], "page_idx", tail, "__prev", n=1)
    start = X.strip(X.at_most(text, 100))
    prev = F.try_element_at("__prev", F.lit(1))
    headed = X.any_of(start, ["Section", "Rule", "Article"])
    closed = F.rlike(prev["end"], F.lit(r'[.):"]\z'))
    flag = (text != "") & F.coalesce(prev["has_text"], F.lit(False)) & ~headed & ~F.coalesce(closed, F.lit(True))
    return with_prev.withColumn("is_continuation", flag).drop("__prev")


def infer_metadata(files: DataFrame, name: str, domains=R.FILE_DOMAINS) -> DataFrame:
    """Year, domain, type and display name from a file name (without extension)."""
    c, low = F.col(name), F.lower(F.col(name))
    year = F.nullif(F.regexp_extract(c, r"(19|20)\d{2}", 0), F.lit(""))
    first = reduce(lambda acc, d: acc.when(X.any_of(low, d[1]), F.struct(F.lit(d[0]).alias("domain"), F.lit(d[2]).alias("base"))),
                   domains[1:], F.when(X.any_of(low, domains[0][1]),
                                       F.struct(F.lit(domains[0][0]).alias("domain"), F.lit(domains[0][2]).alias("base"))))
    staged = files.withColumns({"__d": first, "__y": year})
    kind = (F.when(F.col("__d").isNull(), F.lit("Other"))
            .when((F.col("__d.domain") == "Biodiversity") & F.contains(low, F.lit("amendment")), F.lit("Amendment Act"))
            .when((F.col("__d.domain") != "Biodiversity") & F.contains(low, F.lit("rule")), F.lit("Rules"))
            .otherwise(F.lit("Act")))
    staged = staged.withColumn("document_type", kind)
    dated = F.when(F.col("__y").isNotNull(), F.concat(F.lit(", "), "__y")).otherwise(F.lit(""))
    title = F.when(F.col("document_type").isin("Act", "Rules"), F.concat("__d.base", F.lit(" "), "document_type", dated)) \
        .otherwise(F.translate(c, "_-", "  "))
    return staged.withColumns({"domain": F.coalesce("__d.domain", F.lit("General Legal")), "year": F.col("__y").cast("int"),
                               "document_name": title}).drop("__d", "__y")
