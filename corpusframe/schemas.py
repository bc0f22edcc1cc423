"""Explicit schemas of the nested document form. Nothing is inferred at read time."""

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


SECTION = struct(section_number=S, section_title=S, content=S, is_continuation=B, source_page=I)
RULE = struct(rule_number=S, rule_title=S, content=S, is_continuation=B, source_page=I)
DEFINITION = struct(clause=S, term=S, definition_text=S, definition=S)
AMENDMENT = struct(amendment_number=S, target_section=S, amendment_action=S, amendment_text=S, source_page=I)
SCHEDULE = struct(schedule_number=S, schedule_title=S, content=S)
FORM = struct(form_number=S, form_title=S, content=S)
TABLE = struct(table_number=S, table_title=S, content=S)
PAGE_FIELDS = dict(
    page_number=I, page_type=S, title=S, chapter=S, sections=T.ArrayType(SECTION), rules=T.ArrayType(RULE),
    definitions=T.ArrayType(DEFINITION), amendments=T.ArrayType(AMENDMENT), schedules=T.ArrayType(SCHEDULE), forms=T.ArrayType(FORM),
    tables=T.ArrayType(TABLE), raw_text=S, language=S, language_confidence=T.DoubleType())
PAGE = struct(**PAGE_FIELDS)
DOCUMENT = struct(document_name=S, document_type=S, source=S, total_pages=I, language=S, domain=S, year=I)
CORRUPT = "_corrupt_record"
#: A file is one document; a bare page object (page fields at the top level) is read as a one-page document.
CORPUS = T.StructType([T.StructField("document", DOCUMENT), T.StructField("pages", T.ArrayType(PAGE)),
                       *PAGE.fields, T.StructField(CORRUPT, S)])
QUERY_SET = struct(id=S, language=S, query=S, expected_domain=S, answerable=B)
CHUNK_FILE = struct(chunk_id=S, document=S, document_type=S, document_year=I, section_number=S, section_title=S, rule_number=S, rule_title=S,
                    text=S, embedding_text=S, source_pages=T.ArrayType(I), domain=S, keywords=T.ArrayType(S), language=S)
