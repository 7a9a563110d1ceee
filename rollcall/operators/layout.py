"""The report grid: order of careers, slots for people of one column, rows of fixed width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import numbered

#: Role classes in the order of the grid's legend, by which bands are laid.
ROLE_ORDER = ["management", "production", "design", "engineering", "art", "audio", "writing", "qa", "live", "publishing", "community", "thanks", "unspecified"]


def class_rank(publisher: Column, community: Column) -> Column:
    """Developers, then the publisher's staff, then volunteers."""
    return F.when(publisher, 1).when(community, 2).otherwise(0)


def role_rank(cls: Column) -> Column:
    """Place in the legend's order; unknown and missing roles come last."""
    place = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.coalesce(cls, F.lit("")))
    return F.when(place == 0, len(ROLE_ORDER)).otherwise(place - 1).cast("int")


def ranked(people: DataFrame) -> DataFrame:
    """people(name, cols, and maybe publisher, community, roles: map of column to class) with what careers are ordered by."""
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in people.columns else F.lit(False)
    roles = F.col("roles") if "roles" in people.columns else F.lit(None).cast("map<int,string>")
    out = people.withColumn("cols", F.array_sort("cols"))
    return out.select(
        "*",
        class_rank(has("publisher"), has("community")).alias("__class"),
        F.transform("cols", lambda c: role_rank(F.try_element_at(roles, c))).alias("__roles"),
        F.array_max("cols").alias("__z"),
        F.array_min("cols").alias("__a"),
        F.transform(F.reverse("cols"), lambda c: -c).alias("__shape"),
    )


def career_rows(people: DataFrame, group_by_shape: bool = True, sink_marked: bool = True, section: Column | None = None, name: str = "row") -> DataFrame:
    """:func:`ranked` people with ``name``: their place among all careers, from 0.

    Sections first (if given), then the latest last column, then the earliest first
    one; then either the columns from the back (equal careers become neighbours),
    class and roles, or the number of columns; then the name.
    """
    order = [*([] if section is None else [section]), -F.col("__z"), F.col("__a")]
    if group_by_shape:
        order += ["__shape", *(["__class"] if sink_marked else []), "__roles", "name"]
    else:
        order += [-F.size("cols"), "name"]
    return numbered(ranked(people), name, order)


def slot_packing(people: DataFrame, width: int, group_by_shape: bool = True, sink_marked: bool = True, section: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """people(name, cols, and what :func:`ranked` knows, and maybe ``reprints``): (placed(row, col, name), overflow(col, name)).

    People of several columns own a row each, in career order, and its cells from
    the first to the last of their columns and reprints. People of one column fill
    that column's free cells from the top: by class, role and name, or by name alone
    where the marked don't sink; whoever finds none is overflow. The k-th free cell
    meets the k-th person in one equi-join.
    """
    rows = career_rows(people.where("size(cols) > 1"), group_by_shape, sink_marked, section)
    points = F.concat("cols", F.coalesce("reprints", F.array().cast("array<int>"))) if "reprints" in people.columns else F.col("cols")
    rows = rows.withColumn("__points", points)
    owned = rows.select("row", "name", F.explode("cols").alias("col"))
    taken = F.sequence(F.array_min("__points"), F.array_max("__points"))
    cells = rows.select("row", *(F.col(c) for c in ("__z", "__a")), F.explode(F.array_except(F.sequence(F.lit(0), F.lit(width - 1)), taken)).alias("col"))
    free = free_cells(cells)
    single = ranked(people.where("size(cols) = 1")).withColumn("col", F.get("cols", F.lit(0)))
    order = ["__class", F.get("__roles", F.lit(0)), "name"] if sink_marked else ["name"]
    single = numbered(single.select("name", "col", "__class", "__roles"), "k", order, ["col"]).select("name", "col", "k")
    put = single.join(free, ["col", "k"], "left")
    placed = owned.select("row", "col", "name").unionByName(put.where("row is not null").select("row", "col", "name"))
    return placed, put.where("row is null").select("col", "name")


#: Rows of the grid whose free cells are numbered in one task.
CELLS = 100_000


def free_cells(cells: DataFrame) -> DataFrame:
    """cells(row, col) with ``k``, their place in the column from 0: counted within blocks of ``CELLS`` rows, behind the counts of the blocks before."""
    block = F.floor(F.col("row") / CELLS).alias("__block")
    counts = cells.groupBy("col", block).agg(F.count("*").alias("__n"))
    before = W.partitionBy("col").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("col", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(W.partitionBy("col", "__block").orderBy("row")) - 1
    return cells.select("*", block).withColumn("__l", within).join(starts, ["col", "__block"]).select("row", "col", (F.col("__start") + F.col("__l")).alias("k"))


def sections(people: DataFrame, first_era: Column) -> DataFrame:
    """(section, row): where the section of each era of a first column begins, for people of several columns."""
    n = people.where("size(cols) > 1").groupBy(first_era.alias("section")).agg(F.count("*").alias("n"))
    before = W.orderBy("section").rowsBetween(W.unboundedPreceding, -1)  # a handful of eras
    return n.select("section", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row"))


def bins(rows: DataFrame, width: int, by: str, *order) -> DataFrame:
    """Rows numbered in order within each ``by`` into lines of ``width``: line and place."""
    out = numbered(rows, "__n", list(order), [by])
    return out.withColumn("line", F.floor(F.col("__n") / width).cast("int")).withColumn("place", F.pmod("__n", F.lit(width)).cast("int")).drop("__n")


def reprint_columns(people: DataFrame, reprints: DataFrame) -> DataFrame:
    """people(name, cols) with ``reprints``: columns that print a person's columns again, without those that are their own.

    ``reprints`` (col, again) is a small fixed map.
    """
    each = people.select("name", F.explode("cols").alias("col")).join(reprints, "col")
    more = each.groupBy("name").agg(F.collect_set("again").alias("__r"))
    out = people.join(more, "name", "left")
    return out.withColumn("reprints", F.array_sort(F.array_except(F.coalesce("__r", F.array().cast("array<int>")), "cols"))).drop("__r")


def dedup_people(rows: DataFrame, ident: str, order: str) -> DataFrame:
    """rows(ident, name, cols, flag) one for each ident: union of columns, any flag, longest spelling (first on ties)."""
    return rows.groupBy(ident).agg(
        F.max_by("name", F.struct(F.length("name"), -F.col(order))).alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cols")))).alias("cols"),
        F.bool_or("flag").alias("flag"),
    )
