"""Places in an order over all rows, without a window over them.

Rows are dealt by ranges of the whole sort key and sorted within each range, so a
range is a run of the order whatever the keys' frequencies. Ranges are written with
each row's place in its range; how many rows the ranges before hold comes from one
count a range, and a window over those counts (as many rows as ranges) is the only
one. Nothing gathers a group of rows in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import materialised

#: Bits of ``monotonically_increasing_id`` that count within a partition; above them is the partition.
_WITHIN = 33


def numbered(rows: DataFrame, name: str, order: list[Column | str], by: list[Column | str] = ()) -> DataFrame:
    """Adds ``name``: each row's place from 0 in ``order``, from 0 again for each ``by``. Rows equal in all of these are dealt places as they come."""
    keys, groups = [f"__k{i}" for i in range(len(by) + len(order))], [f"__k{i}" for i in range(len(by))]
    keyed = rows.select("*", *((F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip([*by, *order], keys, strict=True)))
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = materialised(placed.drop(*keys[len(by) :])).withColumn("__range", F.shiftright("__at", _WITHIN))
    spans = placed.groupBy("__range", *groups).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = W.partitionBy(*groups).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select(*(F.col(g).alias(f"{g}_") for g in groups), F.col("__range").alias("__r"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"))
    same = F.col("__range") == F.col("__r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    out = placed.join(starts, same)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__start") + F.col("__at")).alias(name))
