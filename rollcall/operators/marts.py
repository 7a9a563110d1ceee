"""Report marts: reach of vendors, composition, spellings, headline numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent


def vendor_reach(facts: DataFrame) -> DataFrame:
    """facts(vendor, release, person): releases and people of each vendor.

    Distinct triples first, once for both measures, then one aggregate a measure on
    keys that no hot vendor gathers into one task unsummed.
    """
    facts = facts.select("vendor", "release", "person").distinct()
    releases = facts.select("vendor", "release").distinct().groupBy("vendor").agg(F.count("*").alias("releases"))
    people = facts.select("vendor", "person").distinct().groupBy("vendor").agg(F.count("*").alias("people"))
    return releases.join(people, "vendor")


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def mode_spelling(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def composition(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """Count and whole-per-cent share of each kind within its group."""
    n = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    return n.join(total, group).select(group, kind, "n", percent(F.col("n"), F.col("total")).alias("pct"))


def ordered_roles(rows: DataFrame, keys: list[str], value: str, order: str, sep: str = " | ") -> DataFrame:
    """Distinct values by first appearance, joined."""
    first = rows.where(F.col(value) != "").groupBy(*keys, value).agg(F.min(order).alias("o"))
    out = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", value))).alias("r"))
    return out.select(*keys, F.array_join(F.transform("r", lambda x: x[value]), sep).alias(value))
