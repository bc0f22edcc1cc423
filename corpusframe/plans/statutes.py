"""Statute-shaped corpus derived from the whole ``documents`` table.

Every document keeps all of its lines; a line gets a legal marker chosen by its length and position
(numbered heads, subsections, clauses, provisos, references, items). Four lines make a page. The same
derivation is written down in SQL for the oracle. Nothing is filtered or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.operators import extract
from corpusframe.plans.registry import table

LINES_PER_PAGE = 4
NAMES = ["Patents_Act", "Patents_Rules", "Designs_Act", "Designs_Rules", "Biological_Diversity_Act",
         "Biological_Diversity_Amendment_Act", "GI_Act", "Trade_Marks_Rules", "Copyright_Act", "General_Order"]
ITEM_PREFIX = ["Schedule IV - ", "Form 3 - ", "Table 7: ", "Section 5: ", "Rule 6: ", "ARRANGEMENT OF SECTIONS "]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def mark_line(x: Column, i: Column) -> Column:
    """Legal form of line ``x`` at 0-based position ``i``."""
    number = (F.floor(i / 12) + 1).cast("string")
    kind = F.pmod(F.length(x) + i, F.lit(10))
    nth = lambda n: F.pmod(i, F.lit(n))
    return (
        F.when(kind == 0, F.concat(number, F.lit(". "), x))
        .when(kind == 1, F.concat(number, F.lit(". In section "), (nth(9) + 1).cast("string"), F.lit(" "), x,
                                  F.lit(" shall be substituted")))
        .when(kind == 2, F.concat(number, F.lit(". Amendment of section "), (nth(5) + 1).cast("string"), F.lit("\n"), x))
        .when(kind == 3, F.concat(F.lit("("), (nth(3) + 1).cast("string"), F.lit(") "), x))
        .when(kind == 4, F.concat(F.lit("("), _pick(["a", "b", "i", "d"], nth(4)), F.lit(") "), x))
        .when(kind == 5, F.concat(F.lit("(ii) "), x))
        .when(kind == 6, F.concat(F.lit("Provided that "), x, F.lit(" under section "), (nth(7) + 1).cast("string"),
                                  F.lit("(2) and clause (a) with effect from 2003-01-01 or 1st January "),
                                  (nth(40) + 1980).cast("string")))
        .when(kind == 7, F.concat(F.lit("Explanation. The Central Government and the Registrar may grant a patent on "), x,
                                  F.lit(" subject to traditional knowledge")))
        .when(kind == 8, F.concat(F.lit('(b) "term of art" means '), x))
        .otherwise(F.concat(_pick(ITEM_PREFIX, nth(6)), x)))


def _file_name() -> Column:
    return F.concat_ws("_", _pick(NAMES, F.pmod("doc_id", F.lit(10))), (F.pmod("doc_id", F.lit(70)) + 1950).cast("string"),
                       F.col("doc_id").cast("string"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: file name, language and source label."""
    return table(spark, sf_dir, "documents").select("doc_id", _file_name().alias("file_name"), "lang", "source")


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(table(spark, sf_dir, "documents").select("doc_id", "text"), [])


def _cut(d: DataFrame, keep: list[str]) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), mark_line)
    starts = F.sequence(F.lit(0), F.floor((F.size("ms") - 1) / LINES_PER_PAGE).cast("int"))
    pages = F.transform(starts, lambda p: F.array_join(F.slice("ms", p * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n"))
    return (d.select("doc_id", *keep, marked.alias("ms"))
            .select("doc_id", *keep, F.posexplode(pages).alias("page_idx", "raw_text"))
            .withColumn("page_number", F.col("page_idx") + 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.infer_metadata(files(spark, sf_dir), "file_name")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_idx, page_number, page_type, raw_text, document_type, document_name.

    The document's fields are put on before its pages are cut, so they need no join.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", _file_name().alias("file_name"))
    return extract.page_type(_cut(extract.infer_metadata(d, "file_name"), ["document_type", "document_name"]))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_provisions(pages(spark, sf_dir), keep=["document_type", "document_name"])


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with some titles, contents and flags missing, as OCR would leave them."""
    n = F.length("content")
    return sections(spark, sf_dir).withColumns({
        "section_title": F.when(F.pmod(F.length("section_title"), F.lit(5)) == 0, F.lit("")).otherwise(F.col("section_title")),
        "content": F.when(F.pmod(n, F.lit(3)) == 1, F.lit("")).otherwise(F.col("content")),
        "is_continuation": F.pmod(n, F.lit(7)) == 2,
    })


# ------------------------------------------------------------------------------------ SQL twin

def _case(values: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


SQL_FILES = f"""files AS (
  SELECT doc_id, {_case(NAMES, 'doc_id % 10')} || '_' || (doc_id % 70 + 1950) || '_' || doc_id AS file_name, lang, source
  FROM documents)"""

SQL_RAW = f"""marked AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, j:
    CASE (length(x) + j - 1) % 10
      WHEN 0 THEN ((j-1)//12+1) || '. ' || x
      WHEN 1 THEN ((j-1)//12+1) || '. In section ' || ((j-1)%9+1) || ' ' || x || ' shall be substituted'
      WHEN 2 THEN ((j-1)//12+1) || '. Amendment of section ' || ((j-1)%5+1) || chr(10) || x
      WHEN 3 THEN '(' || ((j-1)%3+1) || ') ' || x
      WHEN 4 THEN '(' || {_case(["a", "b", "i", "d"], '(j-1)%4')} || ') ' || x
      WHEN 5 THEN '(ii) ' || x
      WHEN 6 THEN 'Provided that ' || x || ' under section ' || ((j-1)%7+1)
        || '(2) and clause (a) with effect from 2003-01-01 or 1st January ' || ((j-1)%40+1980)
      WHEN 7 THEN 'Explanation. The Central Government and the Registrar may grant a patent on ' || x
        || ' subject to traditional knowledge'
      WHEN 8 THEN '(b) "term of art" means ' || x
      ELSE {_case(ITEM_PREFIX, '(j-1)%6')} || x END) AS ms
  FROM documents),
raw_pages AS (
  SELECT doc_id, p AS page_idx, array_to_string(list_slice(ms, p*4+1, p*4+4), chr(10)) AS raw_text, p + 1 AS page_number
  FROM marked, unnest(range(0, (len(ms)+3)//4)) t(p))"""

SQL_DOCS = SQL_FILES + """,
meta0 AS (
  SELECT *, lower(file_name) AS nl, regexp_extract(file_name, '(19|20)\\d{2}') AS ys FROM files),
meta1 AS (
  SELECT *, CASE WHEN contains(nl,'biological') OR contains(nl,'biodiversity') THEN 'Biodiversity'
    WHEN contains(nl,'patent') THEN 'Patents' WHEN contains(nl,'design') THEN 'Designs'
    WHEN contains(nl,'geographical') OR contains(nl,'gi_') OR contains(nl,'gi ') THEN 'Geographical Indications'
    WHEN contains(nl,'trade_mark') OR contains(nl,'trademark') THEN 'Trademarks'
    WHEN contains(nl,'copyright') THEN 'Copyright' ELSE 'General Legal' END AS domain FROM meta0),
meta2 AS (
  SELECT *, CASE WHEN domain='General Legal' THEN 'Other'
    WHEN domain='Biodiversity' THEN CASE WHEN contains(nl,'amendment') THEN 'Amendment Act' ELSE 'Act' END
    WHEN contains(nl,'rule') THEN 'Rules' ELSE 'Act' END AS document_type FROM meta1),
docs AS (
  SELECT doc_id, file_name, lang, source, document_type, domain, CAST(nullif(ys,'') AS BIGINT) AS year,
    CASE WHEN document_type IN ('Act','Rules') THEN
      CASE domain WHEN 'Biodiversity' THEN 'Biological Diversity' WHEN 'Geographical Indications'
        THEN 'Geographical Indications of Goods' WHEN 'Trademarks' THEN 'Trade Marks' ELSE domain END
      || ' ' || document_type || CASE WHEN ys<>'' THEN ', ' || ys ELSE '' END
    ELSE replace(replace(file_name,'_',' '),'-',' ') END AS document_name
  FROM meta2)"""

SQL_PAGES = SQL_DOCS + ",\n" + SQL_RAW + """,
typed AS (
  SELECT *, lower(raw_text) AS tl FROM raw_pages),
pages_s AS (
  SELECT doc_id, page_idx, page_number, raw_text, document_type, document_name,
    CASE WHEN page_number <= 5 AND (contains(tl,'preamble') OR contains(tl,'arrangement of sections')
           OR contains(tl,'arrangement of rules') OR contains(tl,'contents')) THEN 'table_of_contents'
      WHEN contains(tl,'schedule i') OR contains(tl,'first schedule') OR contains(tl,'second schedule') THEN 'schedule'
      WHEN contains(tl,'form ') OR contains(tl,'form no') THEN 'form'
      WHEN contains(tl,'definition') AND length(raw_text) < 5000 THEN 'definition' ELSE 'content' END AS page_type
  FROM typed JOIN docs USING (doc_id))"""

HEAD = r"(?:^|\n)\s*(\d+)\.\s*([^\n]{5,200})"


def sql_spans(source: str, pattern: str, name: str, cols: str, groups: dict[str, int]) -> str:
    """CTE ``name``: one row per match of ``pattern`` in ``source.raw_text`` with its body."""
    lists = ", ".join(f"regexp_extract_all(raw_text, '{pattern}', {g}) AS l_{k}" for k, g in groups.items())
    picks = ", ".join(f"l_{k}[j] AS {k}" for k in groups)
    first = next(iter(groups))
    return f"""{name} AS (
  SELECT {cols}, j - 1 AS sec_idx, {picks}, bodies[j+1] AS body
  FROM (SELECT {cols}, string_split_regex(raw_text, '{pattern}') AS bodies, {lists} FROM {source}),
       unnest(range(1, len(l_{first})+1)) t(j))"""


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_title(x: str, quotes: bool = True) -> str:
    x = f"regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '[.]+$', '')"
    if quotes:
        x = f"""regexp_replace({x}, '^["'']|["'']$', '', 'g')"""
    return sql_strip(x)


SQL_SECTIONS = SQL_PAGES + ",\n" + sql_spans(
    "pages_s WHERE page_type <> 'table_of_contents'", HEAD, "spans",
    "doc_id, page_idx, page_number, page_type, document_type, document_name", {"num": 1, "ttl": 2}) + f""",
sections_s AS (
  SELECT doc_id, page_idx, page_number, page_type, document_type, document_name, kind, sec_idx, num AS section_number,
    {sql_title('ttl')} AS section_title, {sql_strip('body')} AS content, false AS is_continuation
  FROM spans, (VALUES ('section'), ('rule')) k(kind)
  WHERE CASE WHEN document_type IN ('Act','Amendment Act') THEN kind='section' WHEN document_type='Rules' THEN kind='rule'
    ELSE true END)"""

SQL_DAMAGED = SQL_SECTIONS + """,
damaged AS (
  SELECT * REPLACE (
    CASE WHEN length(section_title) % 5 = 0 THEN '' ELSE section_title END AS section_title,
    CASE WHEN length(content) % 3 = 1 THEN '' ELSE content END AS content,
    length(content) % 7 = 2 AS is_continuation) FROM sections_s)"""
