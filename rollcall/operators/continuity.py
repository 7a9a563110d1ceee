"""Continuity of people over an ordered spine of releases.

All measures come from one table of (person, release); previous and later
appearances are window functions over a person's distinct positions, so nothing
is joined with itself and the shuffle is on the person alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spine_positions(releases: DataFrame) -> DataFrame:
    """releases(release, sequence, grp) with ``position``: groups by first sequence, from 0. A release table is a handful of rows."""
    first = releases.withColumn("first", F.min("sequence").over(W.partitionBy("grp")))
    return first.withColumn("position", (F.dense_rank().over(W.orderBy("first")) - 1).cast("int")).drop("first")


def active_spine(releases: DataFrame, appearances: DataFrame) -> DataFrame:
    """:func:`spine_positions` over the groups that anyone appears in; others have a null position."""
    seen = releases.join(appearances.select("release").distinct(), "release", "left_semi").select("grp").distinct()
    active = spine_positions(releases.join(seen, "grp", "left_semi"))
    return releases.join(active.select("release", "position"), "release", "left")


def person_positions(appearances: DataFrame, spine: DataFrame) -> DataFrame:
    """Distinct (person, position) with the positions before and after."""
    at = appearances.join(spine.where("position is not null").select("release", "position"), "release")
    own = W.partitionBy("person").orderBy("position")
    return at.select("person", "position").distinct().withColumn("before", F.lag("position").over(own)).withColumn("after", F.lead("position").over(own))


def release_stats(appearances: DataFrame, spine: DataFrame) -> DataFrame:
    """Per release: headcount, newcomers, returning, continuing, departures, contractors.

    ``appearances`` holds (person, release, is_vendor), any number of rows each; a
    person is a contractor of a release with any vendor row. Releases without people stay, with zeros.
    """
    at = appearances.select("person", "release", "is_vendor").join(spine.where("position is not null").select("release", "position"), "release")
    crew = at.repartition("person").groupBy("person", "release", "position").agg(F.max("is_vendor").alias("is_vendor"))
    # releases may share a position, which is neither before nor after itself
    own = W.partitionBy("person").orderBy("position")
    before, after = own.rangeBetween(W.unboundedPreceding, -1), own.rangeBetween(1, W.unboundedFollowing)
    both = crew.withColumn("before", F.max("position").over(before)).withColumn("after", F.min("position").over(after))
    n = lambda c: F.count_if(c).cast("long")
    per = both.groupBy("release").agg(
        F.count("*").alias("headcount"),
        n(F.col("before").isNull()).alias("newcomers"),
        n(F.col("before") < F.col("position") - 1).alias("returning"),
        n(F.col("before") == F.col("position") - 1).alias("continuing"),
        n(F.col("after").isNull()).alias("departures"),
        n(F.col("is_vendor")).alias("contractors"),
    )
    return spine.select("release").join(per, "release", "left").na.fill(0)


def flows(appearances: DataFrame, spine: DataFrame) -> DataFrame:
    """(from_grp, to_grp, count) between consecutive appearances."""
    names = spine.where("position is not null").select("position", "grp").distinct()
    edges = person_positions(appearances, spine).where("after is not null").groupBy("position", "after").count()
    start = edges.join(names, "position").withColumnRenamed("grp", "from_grp").drop("position")
    return start.join(names.withColumnRenamed("position", "after"), "after").select("from_grp", F.col("grp").alias("to_grp"), "count")


def person_metrics(appearances: DataFrame, uncertain_over: int) -> DataFrame:
    """appearances(person, release, year): first, last, count, span, largest gap, uncertain (gap over the limit)."""
    own = W.partitionBy("person").orderBy("year")
    rows = appearances.select("person", "release", "year").distinct().withColumn("gap", F.col("year") - F.lag("year").over(own))
    out = rows.groupBy("person").agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count("*").alias("game_count"),
        (F.max("year") - F.min("year")).alias("span_years"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"),
    )
    return out.withColumn("uncertain", F.col("largest_gap") > uncertain_over)


#: Eras that one mask holds, beside the bit that says there was an earlier release at all.
_ERAS = 62


def lineage(appearances: DataFrame, releases: DataFrame, eras: list[str]) -> DataFrame:
    """Per release: roster and how many were in each era in an earlier release (by sequence), or in none.

    ``releases`` holds (release, sequence, era); a person may count in several eras. A
    release's era is a bit, and one running OR of a person's earlier bits (one a mask of
    62 eras) replaces the join of each appearance with all earlier ones.
    """
    masks = [eras[i : i + _ERAS] for i in range(0, len(eras), _ERAS)] or [[]]
    bits = []
    for m in masks:
        own = F.lit(1 << _ERAS)
        for k, e in enumerate(m):
            own = F.when(F.col("era") == e, F.lit((1 << _ERAS) | (1 << k))).otherwise(own)
        bits.append(own.cast("long"))
    seq = appearances.select("person", "release").distinct().join(releases, "release")
    prior = W.partitionBy("person").orderBy("sequence").rangeBetween(W.unboundedPreceding, -1)
    flagged = seq.select("*", *(b.alias(f"__b{i}") for i, b in enumerate(bits)))
    flagged = flagged.select("release", *(F.coalesce(F.bit_or(f"__b{i}").over(prior), F.lit(0)).alias(f"__m{i}") for i in range(len(masks))))
    counts = [F.count_if(F.col(f"__m{i}").bitwiseAND(F.lit(1 << k)) != 0).alias(f"from_{e}") for i, m in enumerate(masks) for k, e in enumerate(m)]
    per = flagged.groupBy("release").agg(F.count("*").alias("roster"), *counts, F.count_if(F.col("__m0") == 0).alias("no_prior"))
    return releases.select("release", "era").join(per, "release", "left").na.fill(0)
