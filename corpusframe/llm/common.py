"""What the operators of this subpackage share: readers, word rules, keys and stored intermediate tables."""

from __future__ import annotations

import pickle
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.settings import drop_stage, durable, release_shuffles, shared_folder  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(n)


def text_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Key of a row by what it holds, so that repeated ids with other texts stay apart. Never null."""
    return [F.coalesce(F.col(doc_id), F.lit(-(2 ** 63))).alias("row_id"), F.xxhash64(F.col(text)).alias("row_hash")]


class Shipped:
    """A broadcast object of a class of this package, as bytes that carry the class: workers need not be able to import it."""

    def __init__(self, sent):
        self.sent = sent

    def __getstate__(self) -> dict:
        return {"sent": self.sent}

    @property
    def value(self):
        if "got" not in self.__dict__:
            self.got = pickle.loads(self.sent.value)
        return self.got


def ship(spark: SparkSession, value) -> Shipped:
    return Shipped(spark.sparkContext.broadcast(cloudpickle.dumps(value)))
