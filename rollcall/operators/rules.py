"""Ordered pattern rules, compiled at plan time.

A rule table joined by ``rlike`` is a nested loop with a shuffle behind it; rules
are few, so their order becomes one ``coalesce(when ...)`` inside a projection.
Rule tables that live in data are read first (:func:`first_match_table`).
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialised


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None = "Other") -> Column:
    """Label of the first (pattern, label) found in ``c``."""
    hits = [F.when(c.rlike(p), F.lit(label)) for p, label in rules]
    return F.coalesce(*hits, F.lit(default)) if hits else F.lit(default)


def any_match(c: Column, patterns: list[str]) -> Column:
    """Is ``c`` empty, or does any pattern match? (the list of what isn't a person)"""
    out = c == ""
    for p in patterns:
        out = out | c.rlike(p)
    return out


#: Rules that are compiled into one expression.
BLOCK_RULES = 500


def first_match_table(rows: DataFrame, text: str, rules: DataFrame, default: str = "Other") -> DataFrame:
    """Adds ``label`` by the table rules(priority, pattern, label): read in blocks and compiled as any others.

    Of a table of any size one block is on the driver at a time; rows that a block left
    without a label go on to the next, and what one block found is written before it.
    """
    ahead = rules.orderBy("priority").select("pattern", "label").toLocalIterator()
    out, block = rows.withColumn("label", F.lit(None).cast("string")), list(islice(ahead, BLOCK_RULES))
    while block:
        after = list(islice(ahead, BLOCK_RULES))
        found = first_match(F.col(text), [(r.pattern, r.label) for r in block], None)
        out = out.withColumn("label", F.coalesce("label", found))
        out, block = materialised(out) if after else out, after
    return out.withColumn("label", F.coalesce("label", F.lit(default)))


def split_audit(rows: DataFrame, bad: Column, reason: str) -> DataFrame:
    """Adds ``kind`` (row or dropped) and ``reason``: one pass, two sinks by filter."""
    return rows.withColumn("kind", F.when(bad, "dropped").otherwise("row")).withColumn("reason", F.when(bad, reason).otherwise(""))
