"""Script-based language identification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# Languages in order of precedence (code, name, script, characters counted).
LANGUAGES = [
    ("en", "English", "Latin", "a-zA-Z"),
    ("hi", "Hindi", "Devanagari", "ऀ-ॿ"),
    ("mr", "Marathi", "Devanagari", "ऀ-ॿ"),
    ("gu", "Gujarati", "Gujarati", "઀-૿"),
    ("bn", "Bengali", "Bengali", "ঀ-৿"),
    ("ta", "Tamil", "Tamil", "஀-௿"),
    ("te", "Telugu", "Telugu", "ఀ-౿"),
    ("kn", "Kannada", "Kannada", "ಀ-೿"),
    ("ml", "Malayalam", "Malayalam", "ഀ-ൿ"),
    ("pa", "Punjabi", "Gurmukhi", "਀-੿"),
]

# Words that tell Hindi from Marathi.
HINDI_WORDS = [
    "क्या", "है", "का", "के", "की", "में", "से", "को", "पर", "और", "या", "नहीं", "हैं", "था", "थी", "थे",
    "होगा", "होगी", "होंगे", "करता", "करती", "करते", "किया", "दिया", "लिया", "गया", "आई", "आया",
    "पता", "बताओ", "बताइए", "जानना", "समझ", "समझना", "पढ़ना", "लिखना", "बोलना", "सुनना",
]
MARATHI_WORDS = [
    "काय", "आहे", "चा", "चे", "ची", "मध्ये", "पासून", "ला", "वर", "आणि", "किंवा", "नाही", "आहात", "होते", "होती",
    "होईल", "करतो", "करते", "करतात", "केले", "केली", "दिले", "घेतले", "गेलं", "आलं",
    "जातो", "जाते", "जातात", "पाहिजे", "मिळतो", "मिळते", "मिळतात",
    "माहिती", "सांगा", "सांग", "समज", "समजाव", "वाच", "लिह", "बोल", "ऐक",
]
TIE_BOOST = 0.3


def count_class(c: Column, chars: str) -> Column:
    return F.length(X.rx(c, f"[^{chars}]"))


def script_counts(c: Column) -> dict[str, Column]:
    return {"devanagari": count_class(c, "ऀ-ॿ"), "latin": count_class(c, "\u0000-ɏ"), "total": F.length(c)}


def decide_script(devanagari: Column, latin: Column, total: Column) -> Column:
    """struct(language, confidence, devanagari_ratio, latin_ratio) from character counts."""
    d, l = F.try_divide(devanagari, total), F.try_divide(latin, total)
    sure = F.when((d >= 0.5) & (l <= 0.3), F.lit("mr")).when((l >= 0.5) & (d <= 0.3), F.lit("en")) \
        .when((d >= 0.15) & (l >= 0.15), F.lit("mixed")).otherwise(F.lit("unknown"))
    conf = F.when((d >= 0.5) & (l <= 0.3), F.least(F.lit(0.99), d + 0.1)) \
        .when((l >= 0.5) & (d <= 0.3), F.least(F.lit(0.99), l + 0.1)) \
        .when((d >= 0.15) & (l >= 0.15), F.least(F.lit(0.9), 1.0 - F.abs(d - l)))
    return F.when(
        total > 0,
        F.struct(sure.alias("language"), F.round(conf, 3).alias("confidence"),
                 F.round(d, 3).alias("devanagari_ratio"), F.round(l, 3).alias("latin_ratio")),
    ).otherwise(F.struct(F.lit("unknown").alias("language"), F.lit(None).cast("double").alias("confidence"),
                         F.lit(0.0).alias("devanagari_ratio"), F.lit(0.0).alias("latin_ratio")))


def script_language(df: DataFrame, col: str) -> DataFrame:
    """Adds language, confidence, devanagari_ratio, latin_ratio. Blank text is ``unknown``."""
    counts = {f"__{k}": v for k, v in script_counts(F.col(col)).items()}
    counts["__total"] = F.when(X.is_blank(F.col(col)), F.lit(0)).otherwise(F.length(F.col(col)))
    staged = df.withColumns(counts)
    staged = staged.withColumn("__r", decide_script(F.col("__devanagari"), F.col("__latin"), F.col("__total")))
    return staged.select(*df.columns, "__r.*")


def document_language(pages: DataFrame, key: str = "doc_id", text: str = "raw_text") -> DataFrame:
    """Script language of a document; the pages' counts are added up, no text is moved.

    The newline that joins pages counts as one Latin character per page.
    """
    counts = script_counts(F.col(text))
    per_page = pages.select(key, *[v.cast("long").alias(k) for k, v in counts.items()],
                            (~X.is_blank(F.col(text))).alias("has_text"))
    totals = per_page.groupBy(key).agg(
        F.sum("devanagari").alias("d"), (F.sum("latin") + F.count("*")).alias("l"),
        F.when(F.bool_or("has_text"), F.sum("total") + F.count("*")).otherwise(F.lit(0)).alias("t"))
    return totals.select(key, decide_script(F.col("d"), F.col("l"), F.col("t")).alias("r")).select(key, "r.*")


def query_language(df: DataFrame, col: str, languages=LANGUAGES, hindi=HINDI_WORDS, marathi=MARATHI_WORDS,
                   compat: bool = False) -> DataFrame:
    """Adds language, language_name, script, language_confidence for short query texts.

    ``compat`` keeps punctuation on the words that tell Hindi from Marathi, as in the original rules.
    """
    c = F.col(col)
    visible = F.length(X.rx(c, r"(?U)\s"))
    staged = df.withColumn("__visible", visible)
    staged = staged.withColumns({f"__{code}": F.coalesce(F.try_divide(count_class(c, chars), F.col("__visible")), F.lit(0.0))
                                 for code, _, _, chars in languages})
    plain = c if compat else X.rx(c, r"[\p{Punct}।]", " ")
    found = F.array_distinct(X.words(plain))
    share = lambda ws: F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in ws]))) / float(len(set(ws)))
    staged = staged.withColumns({"__hw": F.when(F.col("__hi") > 0, share(hindi)).otherwise(0.0),
                                 "__mw": F.when(F.col("__mr") > 0, share(marathi)).otherwise(0.0)})
    boosted = {"hi": F.col("__hi") + F.when(F.col("__hw") > F.col("__mw"), TIE_BOOST).otherwise(0.0),
               "mr": F.col("__mr") + F.when(F.col("__mw") > F.col("__hw"), TIE_BOOST).otherwise(0.0)}
    best = F.array_max(F.array(*[
        F.struct(boosted.get(code, F.col(f"__{code}")).alias("score"), F.lit(-i).alias("ord"), F.lit(code).alias("code"),
                 F.lit(name).alias("name"), F.lit(script).alias("script"))
        for i, (code, name, script, _) in enumerate(languages)]))
    staged = staged.withColumn("__best", best)
    ascii_only = F.length(X.rx(c, r"[^\x00-\x7F]")) == F.length(c)
    empty = X.is_blank(c)
    hit = (~empty) & (F.col("__best.score") > 0)
    pick = lambda field, fallback, nothing: F.when(hit, F.col(f"__best.{field}")) \
        .when(~empty & ascii_only, F.lit(fallback)).otherwise(F.lit(nothing))
    return staged.select(
        *df.columns, pick("code", "en", "unknown").alias("language"), pick("name", "English", "Unknown").alias("language_name"),
        pick("script", "Latin", "").alias("script"),
        F.when(hit, F.round(F.least(F.lit(1.0), F.col("__best.score") * 2), 2))
        .when(~empty & ascii_only, F.lit(0.8)).otherwise(F.lit(0.0)).alias("language_confidence"))
