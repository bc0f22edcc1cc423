"""Queries: text cleaning and language, over the documents, pages and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusframe.functions import language as L
from corpusframe.functions import rules as R
from corpusframe.functions import text as X
from corpusframe.plans import statutes as S
from corpusframe.plans.registry import query, table

W = r"\p{L}\p{N}_"
q = lambda s: s.replace("'", "''")


def rr(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{q(pattern)}', '{q(to)}', '{flags}')"


def strip(x: str) -> str:
    return rr(x, r"^\s+|\s+$")


def chain(x: str, rules) -> str:
    for r in rules:
        x = rr(x, *r)
    return x


# The OCR rules without look-around, for an engine that has none. A rule whose matches may share
# a character is applied twice.
EDGE = rf"(^|[^{W}])"
SQL_OCR = [
    [(EDGE + r"l(aw|etter|egal|ength|ink)", r"\g1\g2")],
    [(r"(^|\s|\()l([A-Z])", r"\1L\2")],
    [(r"(\p{Nd})O(\p{Nd})", r"\g10\2"), (r"(\p{Nd})O(\p{Nd})", r"\g10\2")],
    [(EDGE + r"0(ver|ther|wn)", r"\1O\2")],
    [(r"rn(\s|[aeiou])", r"m\1")],
    [(r"([a-z])\|([a-z])", r"\1i\2")],
    [(r"([a-z])1([a-z])", r"\1l\2")],
    [(r"\s{2,}", " ")],
    [("[‐-―]{2,}", "—")],
    [(r"_{2,}", "—")],
    [(rf"[^{W}\s\-:;.,()\[\]\"'—–]", "")],
]
SQL_OCR[0] = [(EDGE + r"l(aw|etter|egal|ength|ink)", r"\11\2")]
SQL_OCR[2] = [(r"(\p{Nd})O(\p{Nd})", r"\10\2")] * 2


def sql_ocr_steps(source: str, col: str, keep: str) -> str:
    """CTEs o0..o11, one per rule, so that every step is computed once."""
    parts = [f"o0 AS (SELECT {keep}, {col} AS s0 FROM {source})"]
    for i, rules in enumerate(SQL_OCR):
        parts.append(f"o{i + 1} AS (SELECT *, {chain(f's{i}', rules)} AS s{i + 1} FROM o{i})")
    return ",\n".join(parts)


def sql_tidy(x: str) -> str:
    x = strip(rr(x, r"\s+", " "))
    return rr(rr(x, r"\s+([.,;:!?)])", r"\1"), r"([(\[])\s+", r"\1")


N_OCR = len(SQL_OCR)


@query("clean_ocr", "WITH " + sql_ocr_steps("documents", "text", "doc_id") + f"""
SELECT doc_id, {sql_tidy(f's{N_OCR}')} AS cleaned,
  {' + '.join(f'(s{i} <> s{i + 1})::BIGINT' for i in range(N_OCR))} AS artifacts FROM o{N_OCR}""")
def clean_ocr(spark, sf):
    return X.clean_ocr(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "cleaned", "artifacts")


@query("clean_ocr_rule_report", "WITH " + sql_ocr_steps("documents", "text", "doc_id") + "\n" + " UNION ALL ".join(
    f"SELECT '{R.OCR_RULES[i][0]}' AS rule, count_if(s{i} <> s{i + 1})::BIGINT AS changed FROM o{N_OCR}" for i in range(N_OCR)))
def clean_ocr_rule_report(spark, sf):
    return X.rule_report(table(spark, sf, "documents"), "text")


_CLEAN = chain
SQL_CLEAN = lambda c: sql_tidy(_ocr_all(c))


def _ocr_all(c: str) -> str:
    for rules in SQL_OCR:
        c = chain(c, rules)
    return c


@query("clean_all_strings", f"""
SELECT conv_id, turn, {SQL_CLEAN('role')} AS role, {SQL_CLEAN('text')} AS text, {SQL_CLEAN("role || '__' || text")} AS tag,
  {SQL_CLEAN("'l' || 'aw  ' || text")} AS alias
FROM conversations""")
def clean_all_strings(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.struct(F.array(F.concat("role", F.lit("__"), "text"), F.concat(F.lit("law  "), "text")).alias("tags")).alias("meta"))
    return X.clean_all_strings(c).select("conv_id", "turn", "role", "text", F.col("meta.tags")[0].alias("tag"),
                                         F.col("meta.tags")[1].alias("alias"))


SQL_PAGE_RULES = [
    (rf"([{W}]+)-\s*\n\s*([{W}]+)", r"\1\2"), (r"\s+([.,;:!?)])", r"\1"), (r"([({])\s+", r"\1"), (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"), (r"[|]{2,}", ""), (r"[_]{3,}", ""),
    (rf"[^{W}\s\x{{0900}}-\x{{097F}}.,;:!?()\[\]{{}}\-'\"/]+", "[UNCLEAR]"),
]


@query("clean_page_text", f"SELECT page_id, {strip(chain('html', SQL_PAGE_RULES))} AS cleaned FROM pages")
def clean_page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_page_text(F.col("html")).alias("cleaned"))


def _lone(ch: str, to: str):
    return [(rf"(?i)(^|[^{W}]){ch}($|[^{W}])", rf"\g<1>{to}".replace(r"\g<1>", r"\1") + r"\2")] * 2


_C = chain("text", _lone("l", "l") + _lone("O", "0"))


@query("fix_confusions", f"""
WITH a AS (SELECT doc_id, text, {_C} AS c FROM documents),
b AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN {chain('c', _lone('I', '1'))}
        ELSE {chain('c', _lone('I', 'I'))} END AS c FROM a)
SELECT doc_id, {chain('c', [('(?i)rn', 'm'), ('(?i)ii', 'u'), ('(?i)1s', 'is')])} AS corrected FROM b""")
def fix_confusions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fix_confusions(F.col("text")).alias("corrected"))


_GOOD = rr("text", r"[^\p{L}\p{N} .,;:\-'\"()\[\]{}]")
SQL_QUALITY = f"""CASE WHEN {strip('text')} = '' THEN 0.0 WHEN length(text) < 10 THEN 0.5
  ELSE least(1.0, length({_GOOD})::DOUBLE / length(text)) END"""


@query("text_quality", f"""
WITH a AS (SELECT doc_id, text, {SQL_QUALITY}::DOUBLE AS quality FROM documents)
SELECT doc_id, round(quality, 6) AS quality, quality < 0.7 AS is_unclear,
  CASE WHEN quality < 0.5 THEN '[UNCLEAR]' ELSE text END AS marked FROM a""")
def text_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").withColumn("quality", X.text_quality(F.col("text")))
    return d.select("doc_id", F.round("quality", 6).alias("quality"), (F.col("quality") < 0.7).alias("is_unclear"),
                    F.when(F.col("quality") < 0.5, F.lit("[UNCLEAR]")).otherwise(F.col("text")).alias("marked"))


@query("preserve_layout", f"""
SELECT page_id, array_to_string(list_transform(string_split(html, chr(10)), lambda x:
  CASE WHEN {strip('x')} = '' THEN '' ELSE repeat(' ', length(x) - length({rr('x', '^\\s+')})) || {strip(rr('x', '\\s+', ' '))} END),
  chr(10)) AS laid_out FROM pages""")
def preserve_layout(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.preserve_layout(F.col("html")).alias("laid_out"))


SQL_REFS = [
    (r"(?i)\bAct[\s,]", "Act,"), (r"(?i)\bSec\.?\s*(\d+)", r"Section \1"),
    (r"(?i)\bSub[\-\s]+sec\.?\s*\((\d+[a-z]?)\)", r"Sub-section (\1)"), (r"(?i)\bClause\s*\(([a-z])\)", r"Clause (\1)"),
]
_REFS_IN = "text || ' under Sec. 5 and sub-sec. (2) or CLAUSE (b) of the act ' || doc_id"


@query("standardise_refs", f"SELECT doc_id, {chain('(' + _REFS_IN + ')', SQL_REFS)} AS standard FROM documents")
def standardise_refs(spark, sf):
    c = F.concat("text", F.lit(" under Sec. 5 and sub-sec. (2) or CLAUSE (b) of the act "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", X.standardise_refs(c).alias("standard"))


@query("replace_terms", f"""SELECT doc_id, {chain("(text || ' Biological Resources of ' || source)", [
    ('(?i)biological resources', 'biological resource'), ('(?i)the and', 'and the'), ('(?i)license', 'licence')])} AS termed
FROM documents""")
def replace_terms(spark, sf):
    c = F.concat("text", F.lit(" Biological Resources of "), "source")
    terms = [("biological resources", "biological resource"), ("the and", "and the"), ("license", "licence")]
    return table(spark, sf, "documents").select("doc_id", X.replace_terms(c, terms).alias("termed"))


DEMO_GLOSSARY = {"fr": {"le": "the", "le un": "the one", "eau": "water"}, "de": {"und": "and", "und die": "and the", "der": "the"},
                 "es": {"de": "of", "de la": "of the"}}


def _gloss(lang: str) -> str:
    x = "text"
    for a, b in sorted(DEMO_GLOSSARY[lang].items(), key=lambda kv: -len(kv[0])):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query("substitute_glossary", f"""SELECT doc_id, CASE lang WHEN 'fr' THEN {_gloss('fr')} WHEN 'de' THEN {_gloss('de')}
  WHEN 'es' THEN {_gloss('es')} ELSE text END AS glossed FROM documents""")
def substitute_glossary(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.substitute_glossary(F.col("text"), F.col("lang"), DEMO_GLOSSARY).alias("glossed"))


WRAPS = [("<|system|>be brief<|user|>", "<|assistant|>"), ("Thinking... about it ...done thinking. ", ""),
         ("Let me check the sources. ", "\nWe are given a text. "), ("<|think|>a\nb<|endofthink|>Answer: ", "[K \x1b[0m"),
         ("", "")]


def responses(spark, sf):
    c = table(spark, sf, "conversations")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(WRAPS)))
    pick = lambda j: F.element_at(F.array(*[F.lit(w[j]) for w in WRAPS]), (k + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(pick(0), "text", pick(1)).alias("text"))


def _wrap(j: int) -> str:
    esc = lambda s: "'" + s.replace("\n", "' || chr(10) || '").replace("\x1b", "' || chr(27) || '") + "'"
    return "CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {i} THEN {esc(w[j])}" for i, w in enumerate(WRAPS)) + " END"


SQL_RESPONSES = f"responses AS (SELECT conv_id, turn, role, {_wrap(0)} || text || {_wrap(1)} AS text FROM conversations)"
SQL_SCRUB_RULES = [
    (r"<\|(?:system|user|assistant)\|>", ""), (r"(?s)<\|think\|>.*?<\|endofthink\|>", ""),
    (r"(?s)<\|reasoning\|>.*?<\|endofreasoning\|>", ""), (r"(?s)Thinking\.\.\..*?done thinking\.", ""),
    (r"(?s)Thinking\.\.\..*?done thinking", ""), (r"(?im)^First, I need to[^.]*\.\s*", ""),
    (r"(?im)^Let me (analyze|look at|examine|check)[^.]*\.\s*", ""), (r"(?im)^Based on the context,\s*", ""),
    (r"(?im)^Looking at the context,\s*", ""), (r"(?im)^From the context,\s*", ""), (r"(?im)^According to the context,\s*", ""),
    (r"(?im)^The context (shows|indicates|states)\s+", ""), (r"(?im)^I (need to|will|should)\s+", ""),
    (r"(?im)^Let me (see|find|determine)\s+", ""), (r"(?im)^We are given[^.\n]*", ""), (r"(?im)^The context has[^.\n]*", ""),
    (r"(?im)^Let's look at[^.\n]*", ""), (r"(?im)^Let me review[^.\n]*", ""), (r"(?im)^The (question|context) is[^.\n]*", ""),
    (r"(?im)^SOURCE \d+[:.]\s*", ""), (r"(?im)^Answer[:.]?\s*", ""), (r"(?im)^Sources[:.]?\s*", ""),
    (r"(?im)^Confidence[:.]?\s*", ""), (r"(?im)^Let me check[^.\n]*", ""), (r"<\|[^|]+\|>", ""), (r"\x1b\[[0-9;]*m", ""),
    (r"\x1b\[\?[0-9]*[hl]", ""), (r"\x1b\[[0-9]*[A-Z]", ""), (r"\[\?25[hl]", ""), (r"\[\?2026[hl]", ""), (r"\[\d+G", ""),
    (r"\[K", ""), (r"\[\d+[A-Z]", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
]
SQL_SCRUB = lambda c: rr(strip(rr(chain(c, SQL_SCRUB_RULES), r"\s+", " ")), r"^[. ,]+")


@query("scrub_responses", f"""WITH {SQL_RESPONSES}, s AS (SELECT conv_id, turn, {SQL_SCRUB('text')} AS clean FROM responses)
SELECT conv_id, turn, clean, clean <> '' AS success FROM s""")
def scrub_responses(spark, sf):
    s = responses(spark, sf).select("conv_id", "turn", X.scrub(F.col("text")).alias("clean"))
    return s.withColumn("success", F.col("clean") != "")


@query("answer_block", f"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND {strip('text')} <> '' THEN {strip('text')}
  ELSE {strip("'**Answer**: ' || split_part(text, chr(10), 1)")} END AS answer FROM conversations""")
def answer_block(spark, sf):
    c = table(spark, sf, "conversations")
    content = F.when(F.pmod("turn", F.lit(2)) == 0, F.col("text")).otherwise(F.lit(""))
    reasoning = F.concat(F.lit("I look first.\n**Answer**: "), "text", F.lit("\nmore"))
    return c.select("conv_id", "turn", X.answer_block(content, reasoning).alias("answer"))


@query("clean_title", f"SELECT doc_id, {S.sql_title('text')} AS title FROM documents")
def clean_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_title(F.col("text")).alias("title"))


SQL_SLUG = lambda c: f"left({rr(rr(f'lower({c})', '[^a-z0-9]+', '_'), '^_+|_+$')}, 50)"


@query("slug", f"SELECT doc_id, {SQL_SLUG('text')} AS slug FROM documents")
def slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


PUNCT = r"[!-/:-@\[-`{-~]"
SQL_WORDS = lambda c: (f"list_filter(list_distinct(string_split_regex(lower({rr(c, PUNCT, ' ')}), '\\s+')), lambda w: w <> '')")


@query("word_set", f"SELECT conv_id, turn, array_to_string(list_sort({SQL_WORDS('text')}), '|') AS words FROM conversations")
def word_set(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_sort(X.word_set(F.col("text"))).alias("words"))


# ------------------------------------------------------------------------------------ language

DEVANAGARI = "पेटेंट क्या है यह कानून में है "
MIX_SQL = f"CASE doc_id % 4 WHEN 0 THEN repeat('{DEVANAGARI}', (length(text) // 40)::INT) || text WHEN 1 THEN repeat('{DEVANAGARI}', (length(text) // 8)::INT) || text ELSE text END"


def mixed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    k = F.pmod("doc_id", F.lit(4))
    more = lambda n: F.concat(F.repeat(F.lit(DEVANAGARI), F.floor(F.length("text") / n).cast("int")), "text")
    return d.select("doc_id", F.when(k == 0, more(40)).when(k == 1, more(8)).otherwise(F.col("text")).alias("text"))


def sql_decide(d: str, l: str, t: str) -> str:
    return f"""CASE WHEN {t} = 0 THEN 'unknown' WHEN {d}/{t} >= .5 AND {l}/{t} <= .3 THEN 'mr' WHEN {l}/{t} >= .5 AND {d}/{t} <= .3 THEN 'en'
    WHEN {d}/{t} >= .15 AND {l}/{t} >= .15 THEN 'mixed' ELSE 'unknown' END AS language,
  round(CASE WHEN {t} = 0 THEN NULL WHEN {d}/{t} >= .5 AND {l}/{t} <= .3 THEN least(.99, {d}/{t} + .1)
    WHEN {l}/{t} >= .5 AND {d}/{t} <= .3 THEN least(.99, {l}/{t} + .1)
    WHEN {d}/{t} >= .15 AND {l}/{t} >= .15 THEN least(.9, 1 - abs({d}/{t} - {l}/{t})) END, 3) AS confidence,
  CASE WHEN {t} = 0 THEN 0 ELSE round({d}/{t}, 3) END AS devanagari_ratio, CASE WHEN {t} = 0 THEN 0 ELSE round({l}/{t}, 3) END AS latin_ratio"""


DEV, LAT = r"[^\x{0900}-\x{097F}]", r"[^\x{0000}-\x{024F}]"
SQL_MIXED = f"""mixed AS (SELECT doc_id, {MIX_SQL} AS text FROM documents),
counted AS (SELECT doc_id, length({rr('text', DEV)})::DOUBLE AS d, length({rr('text', LAT)})::DOUBLE AS l,
  CASE WHEN {strip('text')} = '' THEN 0 ELSE length(text) END::DOUBLE AS t FROM mixed)"""


@query("script_language", f"WITH {SQL_MIXED} SELECT doc_id, {sql_decide('d', 'l', 't')} FROM counted")
def script_language(spark, sf):
    return L.script_language(mixed(spark, sf), "text").drop("text")


@query("document_language", f"""WITH {S.SQL_RAW}, docs AS (
  SELECT doc_id, string_agg(CASE WHEN doc_id % 3 = 0 THEN repeat('{DEVANAGARI}', 10) || raw_text ELSE raw_text END || chr(10), '' ORDER BY page_idx) AS text
  FROM raw_pages GROUP BY doc_id),
counted AS (SELECT doc_id, length({rr('text', DEV)})::DOUBLE AS d, length({rr('text', LAT)})::DOUBLE AS l,
  CASE WHEN {strip('text')} = '' THEN 0 ELSE length(text) END::DOUBLE AS t FROM docs)
SELECT doc_id, {sql_decide('d', 'l', 't')} FROM counted""")
def document_language(spark, sf):
    p = S.raw_pages(spark, sf)
    more = F.concat(F.repeat(F.lit(DEVANAGARI), 10), "raw_text")
    p = p.withColumn("raw_text", F.when(F.pmod("doc_id", F.lit(3)) == 0, more).otherwise(F.col("raw_text")))
    return L.document_language(p)


ASKED = ["", "पेटेंट क्या है ", "पेटंट म्हणजे काय? ", "പെട്ടന്റ് ", "પેટન્ટ શું છે "]


def asked(spark, sf):
    """User turns, some of them asked in other scripts (the whole text where none is put before it)."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    k = F.pmod("conv_id", F.lit(5))
    pre = F.element_at(F.array(*[F.lit(a * 40) for a in ASKED]), (k + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(pre, "text").alias("query"))


def _sql_query_language() -> str:
    pre = " ".join(f"WHEN {i} THEN '{a * 40}'" for i, a in enumerate(ASKED))
    counts = ", ".join(f"length({rr('q', '[^' + chars + ']')})::DOUBLE / v AS s_{code}" for code, _, _, chars in L.LANGUAGES)
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    share = lambda ws: f"len(list_intersect(ws, {listed(ws)}))::DOUBLE / {len(set(ws))}"
    scores = ", ".join(
        f"{{'s': s_{code}" + {"hi": " + CASE WHEN hw > mw THEN 0.3 ELSE 0 END", "mr": " + CASE WHEN mw > hw THEN 0.3 ELSE 0 END"}
        .get(code, "") + f", 'o': {-i}, 'c': '{code}', 'n': '{name}', 'p': '{script}'}}"
        for i, (code, name, script, _) in enumerate(L.LANGUAGES))
    return f"""
WITH u AS (SELECT conv_id, turn, CASE conv_id % 5 {pre} END || text AS q FROM conversations WHERE role = 'user'),
a AS (SELECT *, length({rr('q', '\\s')})::DOUBLE AS v, list_distinct(string_split_regex({rr('q', '[[:punct:]]', ' ')}, '\\s+')) AS ws FROM u),
b AS (SELECT *, {counts} FROM a),
c AS (SELECT *, CASE WHEN s_hi > 0 THEN {share(L.HINDI_WORDS)} ELSE 0 END AS hw,
  CASE WHEN s_mr > 0 THEN {share(L.MARATHI_WORDS)} ELSE 0 END AS mw FROM b),
e AS (SELECT conv_id, turn, q, list_max([{scores}]) AS best FROM c)
SELECT conv_id, turn, best.c AS language, best.n AS language_name, best.p AS script,
  round(least(1.0, best.s * 2), 2) AS language_confidence FROM e"""


@query("query_language", _sql_query_language())
def query_language(spark, sf):
    return L.query_language(asked(spark, sf), "query").drop("query")
