"""The whole chain on credit data: parse, correct, resolve, measure, classify.

Order matters: names, then studios (on the fixed names), then curated rows, then
inclusion overrides, which also see the curated rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_studio
from ..operators import continuity, corrections, identity, roles
from ..sources.credits import CLASSES, Rules
from ..sources.documents import parse_documents

#: Credit studios of these classes are neither vendors nor, for independents, first party.
NOT_VENDORS = ["", "first-party", "independent"]


@dataclass
class Corrections:
    """Correction tables; none means no correction of that kind."""

    names: DataFrame | None = None
    studios: DataFrame | None = None
    curated: DataFrame | None = None
    overrides: DataFrame | None = None


#: Columns that tell which correction changed a row.
CHANGES = ["name_changed", "studio_changed", "class_changed"]


def parse_changes(docs: DataFrame, rules: Rules, fixes: Corrections | None = None) -> DataFrame:
    """The tagged frame after all corrections, with ``CHANGES``: kind row, dropped (with reason) or unparsed. Contradicting corrections raise when it is read."""
    fixes, no = fixes or Corrections(), F.lit(False)
    tagged = parse_documents(docs, rules)
    rows = tagged.where("kind = 'row'").drop("kind", "line", "reason").withColumns({c: no for c in CHANGES})
    rest = tagged.where("kind <> 'row'")
    if fixes.names is not None:
        both = corrections.apply_name_fixes(rows, corrections.name_fixes(fixes.names)).drop("name_changed").withColumnRenamed("changed", "name_changed")
        ruled = both.where("kind = 'dropped'").select("game_id", "kind", F.col("name_raw").alias("line"), F.lit("ruled-not-a-person").alias("reason"))
        rest, rows = rest.unionByName(ruled, allowMissingColumns=True), both.where("kind = 'row'").drop("kind")
    if fixes.studios is not None:
        rows = corrections.conditional_update(rows, corrections.studio_fixes(fixes.studios), ["name_raw", "game_id"], "studio", "wrong_studio", "correct_studio").drop("studio_changed").withColumnRenamed("changed", "studio_changed")
    if fixes.curated is not None:
        rows = corrections.append_rows(rows, fixes.curated.withColumns({c: no for c in CHANGES}), "game_id", "credit_order", ["place"])
    if fixes.overrides is not None:
        rows = corrections.override(rows, corrections.inclusion_overrides(fixes.overrides, CLASSES), ["game_id", "name_raw"], "inclusion_class").drop("class_changed").withColumnRenamed("changed", "class_changed")
    return rows.withColumn("kind", F.lit("row")).unionByName(rest, allowMissingColumns=True).na.fill(False, CHANGES)


def parse(docs: DataFrame, rules: Rules, fixes: Corrections | None = None) -> DataFrame:
    """:func:`parse_changes` without ``CHANGES``."""
    return parse_changes(docs, rules, fixes).drop(*CHANGES)


def studio_class(credits: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``studio_class``: '' for none, the table's class, else vendor."""
    table = classes.select(normalise_studio(F.col("studio")).alias("__k"), F.trim("class").alias("__c"))
    out = credits.withColumn("__k", normalise_studio(F.col("studio"))).join(table, "__k", "left")
    return out.withColumn("studio_class", F.when(F.col("__k") == "", "").otherwise(F.coalesce("__c", F.lit("vendor")))).drop("__k", "__c")


def appearances(credits: DataFrame, people: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(person, release, is_vendor, first_party): real people and their releases, with what any of their rows there says."""
    real = identity.real_people(people).select("person_id")
    own = facts.join(real, "person_id", "left_semi")
    said = studio_class(credits, classes).groupBy("game_id", F.col("name_raw").alias("variant")).agg(
        F.max(~F.col("studio_class").isin(*NOT_VENDORS)).alias("v"), F.max(F.col("studio_class") == "").alias("f")
    )
    # a spelling may stand for a person in a release where the row is another's: any own spelling counts
    spelled = own.select("person_id", "variant").distinct().join(said, "variant")
    per = own.select("person_id", "game_id").distinct().join(spelled, ["person_id", "game_id"], "left")
    return per.groupBy(F.col("person_id").alias("person"), F.col("game_id").alias("release")).agg(F.coalesce(F.max("v"), F.lit(False)).alias("is_vendor"), F.coalesce(F.max("f"), F.lit(False)).alias("first_party"))


def release_table(games: DataFrame, groups: dict[str, str]) -> DataFrame:
    """releases(release, sequence, grp): games under their continuity group."""
    return games.select(F.col("game_id").alias("release"), "sequence", F.coalesce(roles.mapped(F.col("game_id"), groups), F.col("game_id")).alias("grp"))


def per_game(games: DataFrame, seen: DataFrame, groups: dict[str, str]) -> DataFrame:
    spine = continuity.active_spine(release_table(games, groups), seen)
    out = continuity.release_stats(seen, spine).withColumnRenamed("release", "game_id")
    return games.select("game_id", "year", "sequence").join(out, "game_id").withColumnRenamed("continuing", "continuing_from_previous")


def flow_edges(games: DataFrame, seen: DataFrame, groups: dict[str, str]) -> DataFrame:
    return continuity.flows(seen, continuity.active_spine(release_table(games, groups), seen))


def lineages(games: DataFrame, seen: DataFrame, eras: dict[str, str]) -> DataFrame:
    """Both views: all staff, and first-party rows alone (their history too). A game without an era raises."""
    era = F.coalesce(roles.mapped(F.col("game_id"), eras), F.raise_error(F.concat(F.lit("no era for "), F.col("game_id"))))
    releases = games.select(F.col("game_id").alias("release"), "sequence", era.alias("era"))
    names = list(dict.fromkeys(eras.values()))
    every = continuity.lineage(seen, releases, names).withColumn("first_party_only", F.lit(False))
    own = continuity.lineage(seen.where("first_party"), releases, names).withColumn("first_party_only", F.lit(True))
    return every.unionByName(own)
