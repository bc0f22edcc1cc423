"""Small tables with everything that may be odd about them."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append("w" + format(r.randrange(vocabulary), "x") + ("." if r.random() < 0.1 else ""))
        out.append("\n" if r.random() < 0.05 else " ")
    return "".join(out)


def odd_texts() -> list:
    long = prose(9000, 99)
    return [None, "", " \t\n\x0b\x0c\r ", "one", "One\u3000word", "a b c d", "É è \u0130 ǅ 日本語 🎉🎉", "x" * 5000, long, long, "a\x00b \x1c c\x85d", "'s 'tis don't I'LL we'll   \n\n  end  ",
            "<|endoftext|> and <|endoftext|><|endoftext|>", "aaaaaaaaaaaaaa !!!!!!! ______ 12345", "Line.\nLine.\nLine.\n\nOther line.\n"]


def docs(spark, texts=None, start: int = 0):
    """Documents with ids from ``start`` on; the first text once more with the same id, and one with a null id."""
    texts = odd_texts() if texts is None else texts
    rows = [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, texts[-1], None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
