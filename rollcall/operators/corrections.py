"""Hand-ruled corrections, applied in this order: names, studios, appended rows, classes.

Each correction table is joined once; Spark broadcasts those it measures as small. Each function
keeps a column ``changed`` or ``kind`` so that changes are counted and nothing
disappears without a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checks import asserted, unique


class CorrectionError(ValueError):
    """A correction table that contradicts itself."""


def name_fixes(fixes: DataFrame) -> DataFrame:
    """The fixes: one for each name, actions known, names for a fix, studios none, one, or one a name; else they raise when read."""
    names, studios = F.size(F.filter(F.split("names", "[|]"), lambda x: x != "")), F.size(F.split("studio", "[|]"))
    bad = ~F.col("action").isin("discard", "fix") | ((F.col("action") == "fix") & ((names == 0) | ((F.col("studio") != "") & (studios > 1) & (studios != names))))
    return asserted(unique(fixes, ["name_raw"], CorrectionError, "ruled on more than once"), bad, CorrectionError, "a name fix that can't be applied", "name_raw")


def studio_fixes(fixes: DataFrame) -> DataFrame:
    """The fixes that name a credit and its release: one for each, with both the wrong and the right company, or they raise when read."""
    named = fixes.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("name_raw", "game_id", "wrong_studio", "correct_studio"))).where("name_raw <> '' and game_id <> ''")
    one = unique(named, ["name_raw", "game_id"], CorrectionError, "ruled on more than once")
    return asserted(one, F.expr("wrong_studio = '' or correct_studio = ''"), CorrectionError, "company fixes need both companies", "game_id", "name_raw")


def inclusion_overrides(fixes: DataFrame, classes: list[str]) -> DataFrame:
    """One class for each release and name: of several the last by ``place``, where the table has one, else the greatest. A row without a known class or a reason raises when read."""
    good = asserted(fixes, ~F.col("inclusion_class").isin(*classes) | (F.trim("reason") == ""), CorrectionError, "overrides need a known class and a reason", "game_id", "name_raw")
    last = F.max_by("inclusion_class", "place") if "place" in fixes.columns else F.max("inclusion_class")
    return good.groupBy("game_id", "name_raw").agg(last.alias("inclusion_class"))


def apply_name_fixes(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """Rows with ``kind`` row or dropped: a discard drops, a fix gives a row for each name and clears the canonical spelling.

    Studios go to the names in turn, or a single one to all; '-' clears, '' keeps.
    """
    f = fixes.select(F.col("name_raw"), F.col("action").alias("__a"), F.split("names", "[|]").alias("__n"), F.split("studio", "[|]").alias("__s"))
    each = F.transform("__n", lambda n, i: F.struct(F.trim(n).alias("n"), F.when(F.size("__s") > 1, F.get("__s", i)).otherwise(F.get("__s", F.lit(0))).alias("s")))
    hit = rows.join(f, "name_raw", "left")
    hit = hit.withColumn("__e", F.explode_outer(F.when(F.col("__a") == "fix", F.filter(each, lambda x: x["n"] != ""))))
    fixed = F.col("__a") == "fix"
    studio = F.when(F.coalesce("__e.s", F.lit("")) == "", F.col("studio")).when(F.col("__e.s") == "-", "").otherwise(F.col("__e.s"))
    out = {
        "name_raw": F.when(fixed, F.col("__e.n")).otherwise(F.col("name_raw")),
        "name_canonical": F.when(fixed, "").otherwise(F.col("name_canonical")),
        "studio": F.when(fixed, studio).otherwise(F.col("studio")),
    }
    kind = F.when(F.col("__a") == "discard", "dropped").otherwise("row").alias("kind")
    return hit.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns], kind, F.coalesce(fixed, F.lit(False)).alias("changed"))


def conditional_update(rows: DataFrame, fixes: DataFrame, keys: list[str], column: str, wrong: str, right: str) -> DataFrame:
    """``column`` from ``right`` where it still has the value ``wrong``; else it stays."""
    f = fixes.select(*keys, F.col(wrong).alias("__w"), F.col(right).alias("__r"))
    hit = rows.join(f, keys, "left")
    fires = F.coalesce(F.col(column) == F.col("__w"), F.lit(False))
    return hit.select(*[F.when(fires, F.col("__r")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns], fires.alias("changed"))


def override(rows: DataFrame, fixes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` from the fixes where the keys are in it and the value differs."""
    f = fixes.select(*keys, F.col(column).alias("__r"))
    hit = rows.join(f, keys, "left")
    return hit.select(*[F.coalesce("__r", column).alias(c) if c == column else F.col(c) for c in rows.columns], F.coalesce(F.col("__r") != F.col(column), F.lit(False)).alias("changed"))


def append_rows(rows: DataFrame, more: DataFrame, group: str, order: str, by: list[str]) -> DataFrame:
    """``more`` behind ``rows``: numbered by ``by`` from each group's highest number + 1 (from 0 in a new group)."""
    top = rows.groupBy(group).agg(F.max(order).alias("__m"))
    start = F.coalesce(F.col("__m"), F.lit(-1)) + F.row_number().over(W.partitionBy(group).orderBy(*by))
    numbered = more.join(top, group, "left").withColumn(order, start.cast(rows.schema[order].dataType)).drop("__m")
    return rows.unionByName(numbered.select(*rows.columns))


def parse_report(rows: DataFrame, group: str, threshold: float = 0.05) -> DataFrame:
    """rows(group, kind): counts of rows, dropped, unparsed, and whether the group fails (no rows, or too large a share unparsed)."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    out = rows.groupBy(group).agg(n("row"), n("dropped"), n("unparsed")).withColumnRenamed("row", "rows")
    share = F.col("unparsed") / (F.col("rows") + F.col("unparsed"))
    return out.withColumn("failed", F.when(F.col("rows") == 0, True).otherwise(share > threshold))
