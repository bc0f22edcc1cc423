"""Conformance of nested documents: a walk over a target schema makes each value and finds its issues.

The walk runs once, on the schemas, and yields one column expression a field, so documents of any depth are
conformed inside their rows. Fields are named by their place in the schema (``pages.sections.content``), issues
by their place in the document (``pages[3].sections[2].content``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe import schemas
from corpusframe.functions import rules as R

ISSUE = "array<struct<severity:string,path:string,message:string>>"

SECTION = schemas.struct(**{f.name: f.dataType for f in schemas.SECTION.fields}, subsections=T.ArrayType(T.StringType()))
#: The nested document with the optional fields of pages and sections.
DOCUMENT = schemas.struct(document=schemas.DOCUMENT, pages=T.ArrayType(schemas.struct(**{
    **schemas.PAGE_FIELDS, "sections": T.ArrayType(SECTION), "references": T.ArrayType(T.StringType())})))


@dataclass(frozen=True)
class Rules:
    """Fields that must be there (``errors``: whose absence is an error, not a warning), values a field may have, and defaults.

    A default is a value, or a function of the entry's 0-based place in its array.
    """
    required: frozenset[str] = frozenset({"document", "pages", "pages.page_number", "pages.page_type", "pages.raw_text", "pages.sections.section_number"})
    errors: frozenset[str] = frozenset({"document", "pages"})
    allowed: Mapping[str, list[str]] = field(default_factory=lambda: {"pages.page_type": R.SCHEMA_PAGE_TYPES})
    defaults: Mapping[str, object | Callable[[Column], Column]] = field(default_factory=lambda: {
        "pages.page_number": lambda i: i + 1, "pages.raw_text": "", "pages.sections.section_number": "", "pages.sections.section_title": "",
        "pages.sections.content": "", "pages.sections.is_continuation": False, "pages.rules.rule_number": "", "pages.rules.rule_title": "",
        "pages.rules.content": "", "pages.rules.is_continuation": False})


def _below(at: str, name: str) -> str:
    return f"{at}.{name}" if at else name


def _fields(have: T.DataType | None) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in have.fields} if isinstance(have, T.StructType) else {}


def _is_leaf(t: T.DataType | None) -> bool:
    return t is not None and not isinstance(t, (T.StructType, T.ArrayType, T.MapType))


def conformed(have: T.DataType | None, want: T.DataType, value: Column | None, rules: Rules, at: str = "", place: Column | None = None) -> Column:
    """``value`` of type ``have`` (None: the field is not there) as ``want``.

    Null structs become structs of defaults, null and wrongly typed arrays empty ones, values that cannot be cast
    the field's default. Fields the target does not have are left out.
    """
    if isinstance(want, T.StructType):
        own = _fields(have)
        return F.struct(*[conformed(own.get(f.name), f.dataType, value[f.name] if f.name in own else None, rules, _below(at, f.name), place).alias(f.name)
                          for f in want.fields])
    if isinstance(want, T.ArrayType):
        none = F.array().cast(want)
        if not isinstance(have, T.ArrayType):
            return none
        return F.coalesce(F.transform(value, lambda x, i: conformed(have.elementType, want.elementType, x, rules, at, i)), none)
    default = rules.defaults.get(at)
    default = default(place) if callable(default) else F.lit(default)
    return F.coalesce(value.try_cast(want), default.cast(want)) if _is_leaf(have) else default.cast(want)


def found(have: T.DataType | None, want: T.DataType, value: Column | None, path: Column, rules: Rules, at: str = "") -> Column | None:
    """The issues of ``value`` as an array; None where none can arise."""
    def issue(when: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit("error" if at in rules.errors else "warning").alias("severity"), path.alias("path"), message.alias("message")))

    present = value if value is not None else F.lit(None)
    here = [issue(present.isNull(), F.lit("missing"))] if at in rules.required else []
    parts = []
    if isinstance(want, T.StructType):
        own = _fields(have)
        if have is not None and not own:
            here.append(issue(present.isNotNull(), F.lit("not an object")))
        for f in want.fields:
            inner = _below(at, f.name)
            parts.append(found(own.get(f.name), f.dataType, value[f.name] if f.name in own else None,
                               F.concat(path, F.lit(f".{f.name}" if at else f.name)), rules, inner))
    elif isinstance(want, T.ArrayType):
        if isinstance(have, T.ArrayType):
            entries = replace(rules, required=rules.required - {at})  # the array itself is not asked for again in its entries
            if found(have.elementType, want.elementType, F.lit(None), path, entries, at) is not None:
                parts.append(F.flatten(F.transform(value, lambda x, i: found(
                    have.elementType, want.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), entries, at))))
        elif have is not None:
            here.append(issue(present.isNotNull(), F.lit("not an array")))
    elif have is not None and have != want:
        fits = value.try_cast(want) if _is_leaf(have) else F.lit(None).cast(want)
        here.append(issue(present.isNotNull() & fits.isNull(), F.lit(f"not of type {want.simpleString()}")))
    if at in rules.allowed and _is_leaf(have):
        text = value.cast("string")
        here.append(issue((text != "") & ~text.isin(list(rules.allowed[at])), F.concat(F.lit("unknown value "), text)))
    if here:
        parts.insert(0, F.array_compact(F.array(*here)))
    parts = [F.coalesce(p, F.array().cast(ISSUE)) for p in parts if p is not None]
    return (F.concat(*parts) if len(parts) > 1 else parts[0]) if parts else None


def conform(documents: DataFrame, schema: T.StructType = DOCUMENT, rules: Rules = Rules()) -> DataFrame:
    """``documents`` with the columns of ``schema`` conformed; other columns stay."""
    own = _fields(documents.schema)
    made = {f.name: conformed(own.get(f.name), f.dataType, F.col(f"`{f.name}`") if f.name in own else None, rules, f.name, F.lit(0)) for f in schema.fields}
    return documents.withColumns(made)


def issues(documents: DataFrame, keys: list[str], schema: T.StructType = DOCUMENT, rules: Rules = Rules()) -> DataFrame:
    """(keys, severity, path, message): one row an issue."""
    own = _fields(documents.schema)
    parts = [found(own.get(f.name), f.dataType, F.col(f"`{f.name}`") if f.name in own else None, F.lit(f.name), rules, f.name) for f in schema.fields]
    every = F.concat(F.array().cast(ISSUE), *[p for p in parts if p is not None])
    return documents.select(*keys, F.inline(every))
