"""Repair of extracted sections: missing sections, titles, contents, and text carried across pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.functions import rules as R
from corpusframe.functions import text as X
from corpusframe.operators import extract as E
from corpusframe.operators.ordered import last_event, running_sum
from corpusframe.settings import durable

PAGE = ["doc_id", "page_idx"]
KEY = [*PAGE, "kind", "sec_idx"]
FIELDS = ["section_number", "section_title", "content", "is_continuation"]

# Heads of lines at which a title or a content may stand; group 1 is the number, group 2 the rest of the line.
NUMBER = "[0-9]+[A-Za-z]{0,3}"
DOTTED = rf"^[ \t]*({NUMBER})\.(.*)$"
SPACED = rf"^[ \t]*({NUMBER})[ \t]+(.{{5,200}})"
NAMED = rf"(?i)section[ \t]+({NUMBER})[ \t]+(.{{5,200}})"
CHANGE = "(?:Amendment|Substitution|Insertion|Omission|Repeal)"
CHANGED = rf"(?i)^[ \t]*{CHANGE}[ \t]+of[ \t]+section[ \t]+({NUMBER})"
CHANGING = rf"(?i)^[ \t]*({NUMBER})\.[ \t]+(?:In|For|After)[ \t]+section[ \t]+[0-9]"
PRINCIPAL = rf"(?i)^for[ \t\n]+section[ \t\n]+({NUMBER})[ \t\n]+of[ \t\n]+the[ \t\n]+principal[ \t\n]+act"
FOR_SECTION = r"(?i)for[ \t\n]+section[ \t\n]+[0-9]"
# Lines before which a content ends.
NEXT_HEADED = r"(?i)^[ \t]*(?:[0-9]+\.[ \t]+[a-z]|chapter)|^[ \t]*$"
NEXT_NUMBERED = r"^[ \t]*[0-9]+\.[ \t]"
NEXT_CHANGED = rf"(?i)^[ \t]*[0-9]+\.[ \t]+{CHANGE}[ \t]+of[ \t]+section"
MIN_CONTENT = 20


def add_missing_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections plus those found on pages that have text but no section (``added`` is true)."""
    bare = pages.filter(F.col("raw_text") != "").join(sections.select(*PAGE).distinct(), PAGE, "left_anti")
    text = F.col("raw_text")
    entry = lambda s, form: F.struct(s["m"]["number"].alias("number"), s["m"]["head"].alias("head"), s["m"]["body"].alias("body"), form.alias("form"))
    found = F.when(F.contains(F.lower("document_name"), F.lit("amendment")),
                   F.transform(E.amendment_array(text, R.AMENDING), lambda s: entry(s, s["form"]))) \
        .otherwise(F.transform(E.fallback_array(text), lambda s: entry(s, F.lit("regular"))))
    rows = bare.select(*PAGE, "page_number", "page_type", F.posexplode(found).alias("sec_idx", "s"))
    whole = X.strip(F.concat("s.head", "s.body"))
    action = F.when(F.col("s.form") == "substitution", F.lit("substitution")).otherwise(E.amendment_action(whole))
    target = F.when(F.col("s.form") == "substitution", F.col("s.number")).otherwise(E.target_section(whole))
    regular = F.col("s.form") == "regular"
    new = rows.select(
        *PAGE, "page_number", "page_type", F.lit("section").alias("kind"), "sec_idx", F.col("s.number").alias("section_number"),
        F.when(regular, X.clean_title(F.col("s.head"), quotes=False)).otherwise(
            F.concat(X.capitalise(action), F.lit(" of section "), target)).alias("section_title"),
        F.when(regular, X.strip(F.col("s.body"))).otherwise(whole).alias("content"),
        F.lit(False).alias("is_continuation"), F.lit(True).alias("added"))
    new = new.filter((F.col("content") != "") | (F.col("section_title") != ""))
    return sections.select(*[c for c in new.columns if c != "added"]).withColumn("added", F.lit(False)).unionByName(new)


def _amending() -> Column:
    return F.contains(F.lower("document_name"), F.lit("amendment"))


def _first_after(places: str, i: Column) -> Column:
    """The first of some line positions behind line ``i``; behind the last line if there is none."""
    return F.coalesce(F.array_min(F.filter(places, lambda p: p > i)), F.size("lines"))


def _upto(i: Column, end: Column) -> Column:
    """Lines behind line ``i`` and before line ``end`` as one text."""
    return F.array_join(F.slice("lines", i + 2, end - i - 1), "\n")


def spans(pages: DataFrame) -> DataFrame:
    """Where numbers stand in a page: doc_id, page_idx, number (lower case), what (title, content), form, pos, text.

    Every page is cut into lines once, and fixed patterns find heads and ends; nothing depends on the sections that
    look for their text. Forms of a title: behind ``N.`` (on its line, or on the next one if it is alone), behind ``N``, behind
    ``section N``. Forms of a content: the lines behind the line ``N.`` up to a head, a chapter or a blank line; else the
    line and those behind it up to a numbered line. In amending documents: from ``Amendment of section N``, from ``For
    section N of the principal Act``, from ``N. In section M``, each up to the next of its kind.
    """
    places = lambda pattern: F.filter(F.transform("lines", lambda x, i: F.when(F.rlike(x, F.lit(pattern)), i)), lambda p: p.isNotNull())
    cut = pages.filter("raw_text is not null").select(*PAGE, _amending().alias("amending"), F.col("raw_text"), F.split("raw_text", "\n").alias("lines"))
    # the row numbers keep the optimiser from putting an array's expression into the function that reads it for every line
    cut = cut.select("*", places(NEXT_HEADED).alias("headed"), places(NEXT_NUMBERED).alias("numbered"), places(NEXT_CHANGED).alias("changed"), F.monotonically_increasing_id().alias("__cut"))
    entry = lambda number, what, form, pos, text: F.struct(F.lower(number).alias("number"), F.lit(what).alias("what"), F.lit(form).alias("form"), pos.cast("int").alias("pos"), text.alias("text"))
    got = lambda x, pattern, group: F.regexp_extract(x, pattern, group)

    def found(x: Column, i: Column) -> Column:
        dotted, rest = got(x, DOTTED, 1), F.ltrim(got(x, DOTTED, 2))
        title = F.when(X.is_blank(rest), F.ltrim(F.coalesce(F.get("lines", i + 1), F.lit("")))).otherwise(rest)
        plain, behind = ~F.col("amending"), F.col("amending")
        body = F.concat_ws("\n", F.nullif(rest, F.lit("")), F.nullif(_upto(i, _first_after("numbered", i)), F.lit("")))
        from_here = lambda ends: F.concat_ws("\n", x, F.nullif(_upto(i, _first_after(ends, i)), F.lit("")))
        return F.array(
            F.when((dotted != "") & (F.length(title) >= 5), entry(dotted, "title", 0, i, X.at_most(title, 200))),
            F.when(got(x, SPACED, 1) != "", entry(got(x, SPACED, 1), "title", 1, i, got(x, SPACED, 2))),
            F.when(got(x, NAMED, 1) != "", entry(got(x, NAMED, 1), "title", 2, i, got(x, NAMED, 2))),
            F.when(plain & (dotted != ""), entry(dotted, "content", 0, i, X.strip(_upto(i, _first_after("headed", i))))),
            F.when(plain & (dotted != ""), entry(dotted, "content", 1, i, X.strip(body))),
            F.when(behind & (got(x, CHANGED, 1) != ""), entry(got(x, CHANGED, 1), "content", 0, i, X.strip(from_here("changed")))),
            F.when(behind & (got(x, CHANGING, 1) != ""), entry(got(x, CHANGING, 1), "content", 2, i, X.strip(from_here("numbered")))))
    made = cut.select(*PAGE, F.when(F.col("__cut") >= 0, F.array_compact(F.flatten(F.transform("lines", found)))).alias("made"), F.monotonically_increasing_id().alias("__made"))
    by_line = made.select(*PAGE, F.explode(F.when(F.col("__made") >= 0, F.col("made"))).alias("s"))
    pieces = F.zip_with(F.regexp_extract_all("raw_text", F.lit(FOR_SECTION), F.lit(0)), F.slice(F.split("raw_text", FOR_SECTION, -1), 2, 2 ** 31 - 1), lambda a, b: F.concat(a, b))
    principal = cut.filter("amending").select(*PAGE, F.explode(F.transform(pieces, lambda t, i: entry(got(t, PRINCIPAL, 1), "content", 1, i, X.strip(t)))).alias("s")).filter("s.number != ''")
    return by_line.unionByName(principal).select(*PAGE, "s.*")


def best_texts(pages: DataFrame) -> DataFrame:
    """doc_id, page_idx, number, what, text: the first title and the first content (by form, then position) of every number of a page."""
    text = spans(pages).filter(F.length("text") > F.when(F.col("what") == "content", MIN_CONTENT).otherwise(0))
    return text.groupBy(*PAGE, "number", "what").agg(F.min_by("text", F.struct("form", "pos")).alias("text"))


def _recover(texts: DataFrame, sections: DataFrame, blank: Column, what: str, column: str, fix) -> DataFrame:
    """Sections whose ``column`` is blank take the text that the page has for their number."""
    old = ~F.col("added") if "added" in sections.columns else F.lit(True)
    need = F.coalesce(blank & (F.col("section_number") != "") & old, F.lit(False))
    best = texts.filter(F.col("what") == what).select(*PAGE, F.col("number").alias("__n"), F.col("text").alias("__text"))
    needy = sections.filter(need).withColumn("__n", F.lower("section_number")).join(best, [*PAGE, "__n"], "left")
    return needy.withColumn(column, F.coalesce(fix(F.col("__text")), F.col(column))).select(*sections.columns).unionByName(sections.filter(~need))


def recover_title(pages: DataFrame, sections: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Blank titles read from the page text after the section's number; ``texts`` are the pages' ``best_texts`` where they are at hand."""
    return _recover(best_texts(pages) if texts is None else texts, sections, X.is_blank(F.col("section_title")), "title", "section_title", lambda t: X.clean_title(t, quotes=False))


def recover_content(pages: DataFrame, sections: DataFrame, longest: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Blank contents read from the page text below the section's head; whole, unless ``longest`` characters are asked for."""
    return _recover(best_texts(pages) if texts is None else texts, sections, X.is_blank(F.col("content")), "content", "content", lambda t: t if longest is None else X.at_most(t, longest))


def repair(pages: DataFrame, sections: DataFrame, longest: int | None = None) -> DataFrame:
    """The whole repair in its order: missing sections, titles and contents of the old ones, text carried across pages."""
    whole, texts = durable(add_missing_sections(pages, sections)), durable(best_texts(pages))
    return mark_continuations(durable(recover_content(pages, recover_title(pages, whole, texts), longest, texts)))


def mark_continuations(sections: DataFrame) -> DataFrame:
    """Empty sections take the content their number has on the previous page and become continuations.

    Text flows down a run of pages. Only the first section of a number on a page passes text on;
    a section that is already flagged keeps what it has and stops the flow.
    """
    run_key = ["doc_id", "kind", "section_number"]
    numbered = sections.filter(F.col("section_number") != "").select(*run_key, "page_idx", "sec_idx", "content", "is_continuation")
    first = numbered.withColumn("__rn", F.row_number().over(W.partitionBy(*run_key, "page_idx").orderBy("sec_idx"))) \
        .filter("__rn = 1").drop("__rn", "sec_idx")
    first = durable(first)
    # consecutive pages share page_idx - (how many pages had the number so far)
    counted = running_sum(first, run_key, ["page_idx"], "page_idx", F.lit(1), "__seen").withColumn(
        "run_id", F.col("page_idx") - F.col("__seen"))
    event = F.when((F.col("content") != "") | F.col("is_continuation"), F.struct(F.col("content").alias("text")))
    leaving = last_event(counted, [*run_key, "run_id"], ["page_idx"], "page_idx", event, "__e") \
        .select(*run_key, (F.col("page_idx") + 1).alias("page_idx"), F.col("__e.text").alias("__text")).filter(F.col("__text") != "")
    joined = sections.join(leaving, [*run_key, "page_idx"], "left")
    take = ~F.col("is_continuation") & (F.col("content") == "") & F.col("__text").isNotNull()
    return joined.select(*[c for c in sections.columns if c not in ("content", "is_continuation")],
                         F.when(take, F.col("__text")).otherwise(F.col("content")).alias("content"),
                         (F.col("is_continuation") | take).alias("is_continuation")).select(*sections.columns)


def repair_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """What the repair changed: one row per section and action."""
    b = before.select(*KEY, *[F.col(f).alias(f"b_{f}") for f in FIELDS], F.lit(True).alias("__old"))
    j = after.join(b, KEY, "left")
    old = F.coalesce("__old", F.lit(False))
    entry = lambda cond, action, field, x, y: F.when(cond, F.struct(
        F.lit(action).alias("action_type"), F.lit(field).alias("field"), X.at_most(x, 200).alias("before"), X.at_most(y, 200).alias("after")))
    cont = old & ~F.col("b_is_continuation") & F.col("is_continuation")
    entries = F.array_compact(F.array(
        entry(~old, "add_sections", "sections", F.lit(""), F.col("section_title")),
        entry(old & (F.col("b_section_title") != F.col("section_title")), "recover_title", "section_title", F.col("b_section_title"), F.col("section_title")),
        entry(old & ~cont & (F.col("b_content") != F.col("content")), "recover_content", "content", F.col("b_content"), F.col("content")),
        entry(cont, "mark_continuation", "is_continuation", F.lit("false"), F.lit("true"))))
    return j.select(*KEY, F.explode(entries).alias("e")).select(*KEY, "e.*")


def repair_counters(log: DataFrame, amendments: DataFrame | None = None) -> DataFrame:
    """Per document; ``add_sections`` and amendments count pages, the others count sections."""
    n = lambda a: F.count_if(F.col("action_type") == a)
    added = F.count_distinct(F.when(F.col("action_type") == "add_sections", F.col("page_idx")))
    counters = log.groupBy("doc_id").agg(
        added.alias("sections_recovered"), n("recover_title").alias("titles_recovered"),
        n("recover_content").alias("content_recovered"), n("mark_continuation").alias("continuations_marked"))
    if amendments is None:
        return counters
    pages = amendments.select(*PAGE).distinct().groupBy("doc_id").agg(F.count("*").alias("amendments_detected"))
    j = counters.join(pages, "doc_id", "full")
    return j.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in j.columns if c != "doc_id"])
