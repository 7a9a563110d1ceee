"""Context that rows inherit from earlier rows of their document.

A document is scanned in blocks: each block's rows are filled from the block alone,
each block is summed up in one row (was there a reset, and what value is open at its
end), those rows are combined along the document, and what is open before a block
fills the rows that its own couldn't. The combination is associative, so a document
of any length is as many tasks as it has blocks; only one row a block meets in the
window of its document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a document that are scanned in one task, where its order counts them.
BLOCK = 100_000
#: Blocks by quantiles, where the order is of another kind.
QUANTILES = 64


@dataclass(frozen=True)
class Carried:
    """``name``: the last non-null ``value`` at or before a row, since the last row where ``reset`` holds."""

    name: str
    value: Column
    reset: Column | None = None


def counted_blocks(order: str) -> Column:
    """Blocks of an order that counts rows (lines, turns)."""
    return F.floor(F.col(order) / BLOCK)


def quantile_blocks(rows: DataFrame, order: str) -> Column:
    """Blocks between quantiles of any number or time, found in one pass; one block for other kinds."""
    if not isinstance(rows.schema[order].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(0)
    kind = rows.schema[order].dataType
    number = (F.unix_date(order) if isinstance(kind, T.DateType) else F.col(order).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else F.col(order)).cast("double")
    cuts = rows.agg(F.percentile_approx(number, [i / QUANTILES for i in range(1, QUANTILES)], 1_000)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= number)), F.lit(0))


def carry(rows: DataFrame, carried: list[Carried], doc: str, order: list[str], block: Column) -> DataFrame:
    """``rows`` with each of ``carried``; ``block`` rises along ``order`` and rows tied on ``order`` share one."""
    own = rows.withColumn("__b", block)
    for i, c in enumerate(carried):
        own = own.withColumn(f"__v{i}", c.value).withColumn(f"__r{i}", F.coalesce(c.reset, F.lit(False)) if c.reset is not None else F.lit(False))
    place = F.struct(*order)
    ends = [(F.max(F.when(F.col(f"__r{i}"), place)).alias(f"__reset{i}"), F.max_by(F.struct(place.alias("at"), F.col(f"__v{i}").alias("v")), F.when(F.col(f"__v{i}").isNotNull(), place)).alias(f"__last{i}")) for i in range(len(carried))]
    blocks = own.groupBy(doc, "__b").agg(*(e for pair in ends for e in pair))
    along = W.partitionBy(doc).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    opened = []
    for i in range(len(carried)):
        reset, last = F.col(f"__reset{i}"), F.col(f"__last{i}")
        left = F.when(reset.isNull() | (last["at"] >= reset), last["v"])
        blocks = blocks.withColumn(f"__o{i}", left).withColumn(f"__p{i}", F.sum(reset.isNotNull().cast("int")).over(along))
        since = W.partitionBy(doc, f"__p{i}").orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
        blocks = blocks.withColumn(f"__o{i}", F.last(f"__o{i}", ignorenulls=True).over(since))
        opened.append(F.lag(f"__o{i}").over(W.partitionBy(doc).orderBy("__b")).alias(f"__in{i}"))
    before = blocks.select(F.col(doc).alias("__doc"), F.col("__b").alias("__c"), *opened)
    out = own.join(before, F.col(doc).eqNullSafe(F.col("__doc")) & F.col("__b").eqNullSafe(F.col("__c")))
    run = W.partitionBy("__doc", "__c").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for i in range(len(carried)):
        out = out.withColumn(f"__p{i}", F.sum(F.col(f"__r{i}").cast("int")).over(run))
        inner = W.partitionBy("__doc", "__c", f"__p{i}").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn(f"__v{i}", F.last(f"__v{i}", ignorenulls=True).over(inner))
    names = {c.name for c in carried}
    filled = [F.coalesce(F.col(f"__v{i}"), F.when(F.col(f"__p{i}") == 0, F.col(f"__in{i}"))).alias(c.name) for i, c in enumerate(carried)]
    return out.select(*(F.col(f"`{c}`") for c in rows.columns if c not in names), *filled)


def forward_fill(rows: DataFrame, value: Column, name: str, doc: str, order: str, reset: Column | None = None) -> DataFrame:
    """``name``: the last non-null ``value`` at or before each row of its document, since the last row where ``reset`` holds; ``order`` counts the rows."""
    return carry(rows, [Carried(name, value, reset)], doc, [order], counted_blocks(order))


def heading_stack(rows: DataFrame, level: str, text: str, doc: str, order: str, levels: list[int], name: str = "path") -> DataFrame:
    """``name``: the open headings from the outermost in, joined by ' / '; a heading closes those at its level and deeper."""
    each = [Carried(f"__h{k}", F.when(F.col(level) == k, F.col(text)), F.col(level) <= k) for k in levels]
    kept = [c.name for c in each]
    return carry(rows, each, doc, [order], counted_blocks(order)).withColumn(name, F.concat_ws(" / ", *kept)).drop(*kept)


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, right_value: str, name: str, strict: bool = True) -> DataFrame:
    """Each row of ``left`` with the value of the last row of ``right`` before it (strictly), by key.

    A union and one scan in blocks instead of a join of each row with all before it;
    blocks are between quantiles of ``at``, so that a key of many rows is many tasks.
    """
    a = left.select("*", F.lit(None).cast(right.schema[right_value].dataType).alias("__value"), F.lit(0 if strict else 1).alias("__side"))
    b = right.select(F.col(key), F.col(at), F.col(right_value).alias("__value"), F.lit(1 if strict else 0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    out = carry(both, [Carried(name, F.col("__value"))], key, [at, "__side"], quantile_blocks(both, at))
    return out.where(F.col("__side") == (0 if strict else 1)).drop("__value", "__side")
