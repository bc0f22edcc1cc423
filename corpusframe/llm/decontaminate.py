"""Benchmark decontamination with a distributed positional inverted index.

Windows of the benchmark (so many consecutive words of an item, or a whole shorter item) are searched
as phrases:

1. the corpus frequency of every benchmark term is counted,
2. each window takes its rarest terms, with their offsets, as the way into the index,
3. postings of those terms (document, position, words around it) are stored as a table,
4. the list of the rarest term is shifted by its offset, so that positions are window starts, and is
   intersected with the shifted list of the next rarest; what is left is compared word by word,
5. hit words are counted as a union of intervals; exact, whatever the hash of a term.

``near`` gives proximity matches from the same lists: the rarest terms of a window within some words.

The filters sent to the tasks have a fixed size. Joins are on the term's hash or on (document, window);
a frequent passage makes many short rows, which Spark splits. Texts are never shuffled.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.llm import textblocks as B
from corpusframe.llm.common import ascii_lower, durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Flags of the term filter: 2 ** 22 are 512 KB.
FILTER_BITS = 22
#: Terms of a window by which the index is entered.
RAREST = 2


def windows_of(items: DataFrame, width: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, window_id, words (array): each window of each item; items without a word have none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    cut = items.select(F.col(item_id).alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    each = cut.select("item_id", F.posexplode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {width - 1})), i -> slice(w, i, {width}))")).alias("n", "words"))
    return each.select("item_id", F.xxhash64(F.array_join("words", " ")).alias("window_id"), "words")


def _term_hash(term: pa.Array) -> np.ndarray:
    data, offsets = B.string_bytes(term)
    return B.hashes(np.frombuffer(data, np.uint8)[:offsets[-1]] if len(data) else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets))


def _hash_terms(terms: DataFrame) -> DataFrame:
    """``terms`` (term) with the hash under which the index keeps it."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_term_hash(batch.column(0)).view(np.int64))], names=["term", "h"])
    return terms.mapInArrow(run, "term string, h long")


def frequencies(docs: DataFrame, known, bits: int, text: str = "text") -> DataFrame:
    """h, n: occurrences in all texts of the words that the filter lets through."""
    def run(batches):
        for batch in batches:
            for _, _, raw, _ in B.blocks(batch):
                raw = B.LOWER[raw]
                h = B.hashes(raw, *B.spans(raw, B.ALNUM))
                h, n = np.unique(h[B.passes(known.value, bits, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])
    return docs.select(B.ended(text).alias("t")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def entries(windows: DataFrame, terms: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """window_id, h, offset, place: the rarest terms of each distinct window, the first of them at place 1."""
    each = windows.dropDuplicates(["window_id"]).select("window_id", F.posexplode("words").alias("offset", "term"))
    known = each.join(terms, "term").join(counts, "h", "left")
    w = W.partitionBy("window_id").orderBy(F.coalesce("n", F.lit(0)), "h", "offset")
    return known.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= rarest).select("window_id", "h", "offset", "place")


def postings(docs: DataFrame, first, later, bits: int, reach: int, text: str = "text") -> DataFrame:
    """The index: for each row of ``docs`` (key columns and text) one row without a term that has n_words, and its postings.

    Columns: the key columns, n_words, h, position, around (words from ``reach`` before the position on,
    only for terms that open a window) and at (the term's place in them).
    """
    own = [f for f in docs.schema.fields if f.name != text]
    source = docs.select(*[F.col(f.name) for f in own], B.ended(text).alias("__t"))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in own], "n_words long", "h long", "position long", "around string", "at int"])

    def run(batches):
        for batch in batches:
            for a, b, raw, ends in B.blocks(batch):
                raw = B.LOWER[raw]
                start, size = B.spans(raw, B.ALNUM)
                n, owner = B.word_counts(start, ends)
                h = B.hashes(raw, start, size)
                opens = B.passes(first.value, bits, h)
                hit = np.flatnonzero(opens | B.passes(later.value, bits, h))
                begin = np.cumsum(n) - n
                around, at, data = [], [], raw.tobytes()
                for i in hit.tolist():
                    if opens[i]:
                        lo = max(begin[owner[i]], i - reach)
                        hi = min(begin[owner[i]] + n[owner[i]], i + reach + 1)
                        around.append(" ".join(data[s:s + z].decode() for s, z in zip(start[lo:hi].tolist(), size[lo:hi].tolist())))
                        at.append(i - lo)
                    else:
                        around.append(None)
                        at.append(None)
                part = batch.slice(a, b - a)
                m = b - a
                none = lambda kind: pa.nulls(m, kind)
                names = [*batch.schema.names[:-1], "n_words", "h", "position", "around", "at"]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns - 1)], pa.array(n, pa.int64()), none(pa.int64()), none(pa.int64()),
                                                  none(pa.string()), none(pa.int32())], names=names)
                rows = pa.array(owner[hit])
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(rows) for i in range(part.num_columns - 1)], pa.array(n[owner[hit]], pa.int64()),
                                                  pa.array(h[hit].view(np.int64)), pa.array(hit - begin[owner[hit]], pa.int64()), pa.array(around, pa.string()),
                                                  pa.array(at, pa.int32())], names=names)

    return source.mapInArrow(run, schema)


KEY = ["row_id", "row_hash"]


class Index:
    """The stored index of a corpus for a benchmark, and the windows it was built for."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = 13, bits: int = FILTER_BITS):
        from corpusframe.llm.common import text_key
        self.windows = durable(windows_of(items, width))
        terms = durable(_hash_terms(self.windows.select(F.explode("words").alias("term")).distinct()))
        counts = frequencies(docs, B.filter_of(terms, "h", bits), bits)
        self.entries = durable(entries(self.windows, terms, counts))
        first, later = (B.filter_of(self.entries.filter(c), "h", bits) for c in ("place = 1", "place > 1"))
        keyed = docs.select("doc_id", *text_key(), "text")
        self.stored = durable(postings(keyed, first, later, bits, width - 1))
        self.documents = self.stored.filter("h is null").select("doc_id", *KEY, "n_words")
        self.postings = self.stored.filter("h is not null").drop("doc_id", "n_words").distinct()

    def _shifted(self, place: int) -> DataFrame:
        """Postings of each window's term at ``place``, as window starts."""
        e = self.entries.filter(F.col("place") == place).select("window_id", "h", "offset")
        return self.postings.join(e, "h").withColumn("start", F.col("position") - F.col("offset"))

    def phrases(self) -> DataFrame:
        """row key, item_id, start, size: every occurrence of every window, each once."""
        first = self._shifted(1).filter(F.col("around").isNotNull())
        second = self._shifted(2).select(*KEY, "window_id", "start").withColumn("met", F.lit(True))
        alone = self.windows.dropDuplicates(["window_id"]).select("window_id", "words")
        both = first.join(second, [*KEY, "window_id", "start"], "left").join(alone, "window_id")
        both = both.filter(F.col("met") | (F.size("words") == 1))
        exact = F.slice(F.split("around", " "), F.col("at") - F.col("offset") + 1, F.size("words")) == F.col("words")
        found = both.filter((F.col("at") >= F.col("offset"))).filter(exact).select(*KEY, "window_id", "start", F.size("words").alias("size"))
        return found.join(self.windows.select("window_id", "item_id").distinct(), "window_id").select(*KEY, "item_id", "start", "size").distinct()

    def near(self, within: int = 20) -> DataFrame:
        """row key, window_id, position, other, distance: the two rarest terms of a window at most ``within`` words apart, in either order."""
        block = lambda c: F.floor(c / F.lit(within + 1)).cast("long")
        one, two = (self.postings.join(self.entries.filter(F.col("place") == p).select("window_id", "h"), "h").select(*KEY, "window_id", "position") for p in (1, 2))
        one = one.withColumn("__b", F.explode(F.array(*[block(F.col("position")) + k for k in (-1, 0, 1)])))
        two = two.withColumnRenamed("position", "other").withColumn("__b", block(F.col("other")))
        gap = F.abs(F.col("position") - F.col("other"))
        return one.join(two, [*KEY, "window_id", "__b"]).filter((gap <= within) & (gap > 0)).select(*KEY, "window_id", "position", "other", gap.alias("distance"))


def judge(docs: DataFrame, items: DataFrame, width: int = 13, least_pct: int = 5, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, row key, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of ``docs``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, after lower-casing A-Z. A
    word is hit if it lies in an occurrence of a window; a document with hits in at least ``least_pct`` per
    cent of its words is contaminated. Null and empty texts have no words, null items no window. Repeated
    rows get the same result each; rows of one id with different texts are told apart.
    """
    index = Index(docs, items, width, bits)
    found = durable(index.phrases())
    order = W.partitionBy(*KEY).orderBy("start", "size")
    upto = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest(F.col("start"), F.coalesce(upto, F.lit(0))))
    hits = found.select(*KEY, "start", "size").distinct().withColumn("new", new).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    named = found.select(*KEY, F.col("item_id").cast("string").alias("i")).distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("i")).alias("items"))
    out = index.documents.join(hits.join(named, KEY), KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", *KEY, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * least_pct)).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated; the columns of ``docs``. Only the keys of those to remove meet the texts."""
    from corpusframe.llm.common import text_key
    bad = judge(docs, items, **options).filter("contaminated").select(*KEY).distinct()
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)], *text_key())
    return keyed.join(bad, KEY, "left_anti").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
