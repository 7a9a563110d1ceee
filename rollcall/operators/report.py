"""Report tables over grid columns: who is drawn, by whom employed, and what a column is made of.

``columns`` is the small map (game_id, col); a column may cover several releases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_studio, percent
from ..shared import materialised
from . import layout, marts, roles


def credit_facts(credits: DataFrame, columns: DataFrame) -> DataFrame:
    """(name_raw, game_id, inclusion_class, studio, col, n, and code where credits have one): what grid and page read of credits, in one pass, written once.

    ``n`` counts the credits of a fact, ``code`` is the least of their role codes
    (see :mod:`.roles`); ``col`` is null where no column covers the release. The
    functions below read facts wherever they take credits.
    """
    code = [F.min("code").alias("code")] if "code" in credits.columns else []
    each = credits.groupBy("name_raw", "game_id", "inclusion_class", "studio").agg(F.count("*").alias("n"), *code)
    return materialised(each.join(columns, "game_id", "left"))


def at_columns(credits: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows in a column of the grid, with ``col``."""
    return credits.where("col is not null") if "col" in credits.columns else credits.join(columns, "game_id")


def people_spots(people: DataFrame, columns: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """(ident, name, col) of people, for each column of theirs, maybe more than once."""
    each = people.where(~F.col("display_name").isin(*exclude)) if exclude else people
    return each.select(F.col("person_id").alias("ident"), F.col("display_name").alias("name"), F.explode("games").alias("game_id")).join(columns, "game_id").drop("game_id")


def people_columns(people: DataFrame, columns: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """(ident, name, cols) of people with at least one column."""
    return people_spots(people, columns, exclude).groupBy("ident", "name").agg(F.array_sort(F.collect_set("col")).alias("cols"))


def community_people(credits: DataFrame, columns: DataFrame) -> DataFrame:
    """(ident, name, col) of the community class, under their own spelling, maybe more than once."""
    rows = at_columns(credits.where("inclusion_class = 'community'"), columns)
    return rows.select(F.col("name_raw").alias("ident"), F.col("name_raw").alias("name"), "col")


def drawn(parts: dict[str, DataFrame]) -> DataFrame:
    """Union by flag name of frames (ident, name, and col or cols), one row for each ident: columns united, flags or-ed, the name of the first part."""
    both = None
    for k, df in enumerate(parts.values()):
        spots = df.select("ident", "name", "col") if "col" in df.columns else df.select("ident", "name", F.explode("cols").alias("col"))
        part = spots.withColumn("part", F.lit(k))
        both = part if both is None else both.unionByName(part)
    flags = [F.bool_or(F.col("part") == k).alias(f) for k, f in enumerate(parts)]
    return both.groupBy("ident").agg(F.min(F.struct("part", "name")).alias("first"), F.array_sort(F.collect_set("col")).alias("cols"), *flags).select("ident", "first.name", "cols", *parts)


def employed(credits: DataFrame, people: DataFrame, everyone: DataFrame, columns: DataFrame, classes: DataFrame, types: DataFrame) -> DataFrame:
    """(col, name, key, studio, type, n): people drawn in a column with a vendor that a row of theirs there names, and in how many credits.

    Spellings go to display names (of several owners the greatest id's); community
    rows keep their own spelling. ``everyone`` holds name and cols.
    """
    owner = people.select("person_id", "display_name", F.explode("variants").alias("name_raw")).groupBy("name_raw").agg(F.max_by("display_name", "person_id").alias("shown"))
    n = F.col("n") if "n" in credits.columns else F.lit(1)
    rows = at_columns(credits.withColumn("n", n.cast("long")), columns).join(owner, "name_raw", "left")
    rows = rows.withColumn("name", F.coalesce("shown", F.when(F.col("inclusion_class") == "community", F.col("name_raw")))).where("name is not null")
    key = lambda t, value: t.select(normalise_studio(F.col("studio")).alias("key"), F.trim(value).alias(value))
    rows = rows.withColumn("key", normalise_studio(F.col("studio"))).where("key <> ''").join(key(classes, "class"), "key", "left").where("class is null or class = 'vendor'")
    rows = rows.join(everyone.select("name", "cols"), "name").where("array_contains(cols, col)")
    return rows.join(key(types, "type"), "key", "left").select("col", "name", "key", "studio", F.coalesce("type", F.lit("development")).alias("type"), "n")


def studio_spellings(work: DataFrame) -> DataFrame:
    """(key, studio): the most frequent spelling; of equals the least."""
    n = work.groupBy("key", "studio").agg(F.sum("n").alias("n"))
    return n.groupBy("key").agg(F.min_by("studio", F.struct(-F.col("n"), "studio")).alias("studio"))


def chips(work: DataFrame, named: list[str], studio_only: DataFrame, columns: DataFrame) -> DataFrame:
    """(col, place, studio, people): named vendors first, then by people, then companies credited without anyone (people null)."""
    from pyspark.sql import Window as W

    n = work.select("col", "key", "name").distinct().groupBy("col", "key").agg(F.count("*").alias("people")).join(studio_spellings(work), "key")
    n = n.withColumn("part", F.when(F.col("key").isin(*named), 0).otherwise(1) if named else F.lit(1))
    only = studio_only.join(columns, "game_id").select("col", "studio", F.lit(None).cast("long").alias("people"), F.lit(2).alias("part"))
    both = n.select("col", "studio", "people", "part").unionByName(only)
    return both.select("col", F.row_number().over(W.partitionBy("col").orderBy("part", F.desc("people"), "studio")).alias("place"), "studio", "people")


def composition(everyone: DataFrame, work: DataFrame, publishing: DataFrame, named: list[str]) -> DataFrame:
    """Per column: total, newcomers, vendors, named vendors, vendors by type (least type of each person), publishing, community, thanks, first party (the rest).

    ``everyone`` holds name, cols, community, special_thanks; ``publishing`` (col, name).
    Person flags and release counts are subtracted together, so shares may not add up.
    """
    at = everyone.select("name", "community", "special_thanks", F.array_min("cols").alias("first"), F.explode("cols").alias("col"))
    is_named = F.col("key").isin(*named) if named else F.lit(False)
    job = work.groupBy("col", "name").agg(F.max(F.when(is_named, F.col("key"))).alias("named"), F.min("type").alias("type"))
    pub = publishing.select("col", "name").distinct().withColumn("pub", F.lit(True))
    at = at.join(job, ["col", "name"], "left").join(pub, ["col", "name"], "left")
    n = lambda c: F.count_if(c)
    out = at.groupBy("col").agg(
        F.count("*").alias("total"),
        n(F.col("first") == F.col("col")).alias("newcomers"),
        n(F.col("type").isNotNull()).alias("vendors"),
        n(F.col("named").isNotNull()).alias("named"),
        *(n(F.col("named").isNull() & (F.col("type") == t)).alias(t.replace("-", "_")) for t in ("development", "cinematic-sound", "testing", "publishing")),
        n(F.col("pub")).alias("publishers"),
        n(F.col("community")).alias("community"),
        n(F.col("special_thanks")).alias("thanks"),
    )
    return out.withColumn("first_party", F.col("total") - F.col("vendors") - F.col("publishers") - F.col("community") - F.col("thanks"))


def role_tables(per_release: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (name, game_id, cls): (by person and column, totals, by column)."""
    totals = per_release.groupBy("cls").agg(F.count("*").alias("n"))
    by_col = per_release.join(columns, "game_id").groupBy("col", "cls").agg(F.count("*").alias("n"))
    return roles.column_fold(per_release, columns, "name", "game_id"), totals, by_col


def role_cards(per_release: DataFrame, columns: DataFrame) -> DataFrame:
    """(col, total, and a count for each class of the legend) of (name, game_id, cls): all releases of a column together, so a person of two counts twice."""
    n = per_release.join(columns, "game_id").groupBy("col").pivot("cls", layout.ROLE_ORDER).count().na.fill(0)
    total = sum((F.col(c) for c in layout.ROLE_ORDER), F.lit(0))
    return n.select("col", total.cast("long").alias("total"), *layout.ROLE_ORDER)


def role_rows(cards: DataFrame) -> DataFrame:
    """(col, cls, n, pct, start, stop, place, by_share) of cards, one row for each class that a column has.

    ``pct`` is the whole per cent; ``start`` and ``stop`` are the ends of the class's
    segment in a bar of 10,000, which they fill; ``place`` counts in the legend's order,
    ``by_share`` from the largest class, legend's order on ties. A card is one row, so
    its running sums are array work and nothing is shuffled.
    """
    each = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("cls"), F.col(c).alias("n")) for i, c in enumerate(layout.ROLE_ORDER))), lambda x: x["n"] > 0)
    before = lambda x, test: F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda a, y: a + y["n"])
    placed = F.transform("c", lambda x, k: F.struct(x["cls"].alias("cls"), x["n"].alias("n"), k.alias("place"), before(x, lambda y: y["i"] < x["i"]).alias("from"), F.size(F.filter("c", lambda y: (y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["i"] < x["i"])))).alias("by_share")))
    out = cards.withColumn("c", each).select("col", "total", F.inline(placed))
    at = lambda c: F.round(10000.0 * c / F.col("total"), 0).cast("int")
    return out.select("col", "cls", "n", percent(F.col("n"), F.col("total")).alias("pct"), at(F.col("from")).alias("start"), at(F.col("from") + F.col("n")).alias("stop"), "place", "by_share")


def era_years(columns: DataFrame) -> DataFrame:
    """(era, years) of columns(col, year, era): the label of its first column, or of its first and last."""
    ends = columns.groupBy("era").agg(F.min_by("year", "col").alias("a"), F.max_by("year", "col").alias("z"))
    return ends.select("era", F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.concat_ws("–", "a", "z")).alias("years"))


def roles_of(per_release: DataFrame, columns: DataFrame) -> DataFrame:
    """(name, roles): each person's class by column, as a map, from (name, game_id, cls)."""
    return roles_in(roles.column_fold(per_release, columns, "name", "game_id"))


def roles_in(own: DataFrame) -> DataFrame:
    """(name, roles) from (name, col, cls)."""
    return own.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("col", "cls"))).alias("roles"))


def fmt(n):
    """Whole numbers with thousands separators."""
    return F.format_number(n, 0)


def label_year(label):
    """The first year of a label like 2018-25."""
    return F.substring(label, 1, 4).cast("int")


def hero_numbers(everyone: DataFrame, work: DataFrame, columns: DataFrame, eras: list[str]) -> DataFrame:
    """The headline numbers in one row.

    ``everyone`` holds name, cols, community, publisher; ``work`` (col, name, key);
    ``columns`` the small table (col, year label, era); ``eras`` the first, the
    later and the last era. Developers are neither publishers nor volunteers; core
    staff of a column are its developers without a vendor there.
    """
    first, later, _ = eras
    at = everyone.select("name", (~F.col("community") & ~F.col("publisher")).alias("dev"), F.explode("cols").alias("col")).join(columns, "col")
    vendor = work.select("name", "col").distinct().withColumn("v", F.lit(True))
    at = at.join(vendor, ["name", "col"], "left").withColumn("v", F.coalesce("v", F.lit(False)))
    spot = F.struct("col", "era", label_year(F.col("year")).alias("year"), "v")
    p = at.groupBy("name", "dev").agg(F.array_sort(F.collect_list(spot)).alias("c"))
    size, final = F.size("c"), F.lit(columns.agg(F.max("col")).first()[0])
    steps = F.transform(F.slice("c", 2, F.greatest(size - 1, F.lit(0))), lambda b, i: F.struct((b["col"] - F.get("c", i)["col"]).alias("d"), (b["year"] - F.get("c", i)["year"]).alias("y")))
    p = p.withColumn("s", steps).withColumn("gap", F.array_max(F.transform(F.filter("s", lambda s: s["d"] > 1), lambda s: s["y"])))
    some = lambda test: F.exists("c", test)
    in_final = some(lambda x: x["col"] == final)
    core_final = F.col("dev") & some(lambda x: (x["col"] == final) & ~x["v"])
    prior = lambda era, core: some(lambda x: (x["era"] == era) & (x["col"] < final) & (~x["v"] if core else F.lit(True)))
    in_later, core_later = some(lambda x: x["era"] == later), F.col("dev") & some(lambda x: (x["era"] == later) & ~x["v"])
    n = F.count_if
    steps_of = lambda test: F.coalesce(F.sum(F.size(F.filter("s", test))), F.lit(0)).cast("long")
    longest = p.agg(F.coalesce(F.max("gap"), F.lit(0)).alias("longest"))
    of_people = p.crossJoin(longest).agg(  # one row
        F.count("*").alias("people"),
        n(some(lambda x: x["v"])).alias("with_vendor"),
        n(size > 1).alias("several"),
        steps_of(lambda s: s["d"] == 1).alias("unbroken"),
        steps_of(lambda s: s["d"] > 1).alias("returns"),
        n(core_later).alias("later_core"),
        n(core_later & some(lambda x: (x["era"] == first) & ~x["v"])).alias("later_core_first"),
        n(in_later).alias("later_all"),
        n(in_later & some(lambda x: x["era"] == first)).alias("later_all_first"),
        n(core_final).alias("final_core"),
        n(core_final & prior(later, True)).alias("final_core_later"),
        n(core_final & prior(first, True)).alias("final_core_first"),
        n(in_final).alias("final_all"),
        n(in_final & prior(later, False)).alias("final_all_later"),
        n(in_final & prior(first, False)).alias("final_all_first"),
        n(F.size(F.array_distinct(F.transform("c", lambda x: x["era"]))) == len(eras)).alias("all_eras"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"),
        n((F.col("gap") == F.col("longest")) & (F.col("gap") > 0)).alias("longest_gap_people"),
    )
    reach = marts.vendor_reach(work.select(F.col("key").alias("vendor"), F.col("col").alias("release"), F.col("name").alias("person")))
    of_vendors = reach.agg(
        F.count("*").alias("vendors"),
        n(F.col("releases") == 1).alias("vendors_once"),
        F.min_by(F.struct("vendor", "people", "releases"), F.struct(-F.col("people"), "vendor")).alias("top"),
    ).select("vendors", "vendors_once", F.col("top.vendor").alias("top_vendor"), F.col("top.people").alias("top_people"), F.col("top.releases").alias("top_releases"))
    both = of_people.crossJoin(of_vendors)  # one row with one row
    share = lambda a, b: percent(F.col(a), F.col(b))
    return both.withColumns({
        "vendor_pct": share("with_vendor", "people"), "later_pct": share("later_core_first", "later_core"), "later_all_pct": share("later_all_first", "later_all"),
        "final_later_pct": share("final_core_later", "final_core"), "final_first_pct": share("final_core_first", "final_core"), "people_text": fmt(F.col("people")),
    })
