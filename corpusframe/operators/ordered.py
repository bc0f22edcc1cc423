"""Ordered per-document work that does not put a whole hot document into one task.

Rows carry a dense position (``page_idx``: the array position of a page). A document is cut into
blocks of consecutive positions; each block is a window partition of its own, and what has to travel
between blocks travels as one small summary row per block. A document with a third of all pages is
therefore spread over as many tasks as it has blocks.

``running_sum`` and ``last_event`` read their input twice (rows and block summaries). Hand them a
stored table (``settings.durable``) when the input is expensive. Null keys are a key like any other, rows
without a position are a block of their own before all others: no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusframe.settings import durable

BLOCK = 4096


def block_of(position: str, block: int) -> Column:
    return F.floor(F.col(position) / F.lit(block)).cast("long")


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the names are kept once."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in names else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in names]
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in names])


def left_context(df: DataFrame, keys: list[str], position: str, value: Column, out: str, n: int = 1,
                 block: int = BLOCK) -> DataFrame:
    """``out`` = array of ``value`` on the up to ``n`` previous rows, oldest first.

    ``position`` must be dense within ``keys``. Rows at the end of a block are also sent to the next
    block as context (value only), so no window spans more than ``block + n`` rows.
    """
    at_end = F.pmod(F.col(position), F.lit(block)) >= block - n
    own = block_of(position, block)
    sent = df.withColumns({"__v": value, "__b": own, "__ctx": F.lit(False)})
    heads = df.filter(at_end).select(
        *[F.col(c) if c in (*keys, position) else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns],
        value.alias("__v"), (own + 1).alias("__b"), F.lit(True).alias("__ctx"))
    w = W.partitionBy(*keys, "__b").orderBy(position).rowsBetween(-n, -1)
    both = sent.unionByName(heads)
    return both.withColumn(out, F.collect_list("__v").over(w)).filter(~F.col("__ctx")).drop("__v", "__b", "__ctx")


def running_sum(df: DataFrame, keys: list[str], order: list[str], position: str, value: Column, out: str,
                block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Running total of ``value`` within ``keys``; per block, plus the total of the earlier blocks."""
    staged = df.withColumns({"__b": block_of(position, block), "__v": value.cast("long")})
    w = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = staged.withColumn("__acc", F.sum("__v").over(w))
    blocks = staged.groupBy(*keys, "__b").agg(F.sum("__v").alias("__sum"))
    wb = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(*keys, "__b", F.sum("__sum").over(wb).alias("__in"))
    total = F.col("__acc") + F.coalesce(F.col("__in"), F.lit(0))
    if not inclusive:
        total = total - F.col("__v")
    joined = _same(inner, carried, [*keys, "__b"])
    return joined.withColumn(out, total).drop("__b", "__v", "__acc", "__in")


def last_event(df: DataFrame, keys: list[str], order: list[str], position: str, event: Column, out: str,
               block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Latest non-null ``event`` within ``keys`` up to the row (or before it, ``inclusive=False``)."""
    staged = df.withColumns({"__b": block_of(position, block), "__v": event})
    w = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    inner = staged.withColumn("__acc", F.last("__v", ignorenulls=True).over(w))
    # a block without an event takes the value of the latest earlier block that has one
    blocks = staged.groupBy(*keys, "__b").agg(
        F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__sum"))
    wb = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(*keys, "__b", F.last("__sum", ignorenulls=True).over(wb).alias("__in"))
    joined = _same(inner, carry, [*keys, "__b"])
    return joined.withColumn(out, F.coalesce(F.col("__acc"), F.col("__in"))).drop("__b", "__v", "__acc", "__in")


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str, first: int = 0) -> DataFrame:
    """Dense position within ``keys`` by ``order``, from ``first``, on two levels: ranges of the sorted table, and rows in a range.

    The table is cut at sampled bounds of (keys, order), so a key of any size is as many ranges as its rows ask
    for; a window holds one range of one key, and one count per range and key tells what comes before it. The cut is
    a stored table, so a lost executor cannot cut it otherwise. Rows that agree in ``order`` are numbered in any order.
    """
    cut = durable(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    inner = cut.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__p").orderBy(*order)))
    before = W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select(*keys, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return _same(inner, offsets, [*keys, "__p"]).withColumn(out, F.col("__off") + F.col("__rn") + (first - 1)).drop("__p", "__rn", "__off")
