"""Indexes generated from frozen pages: headings by reference, explicit roles, tags behind names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_targets, strip_markup
from ..operators import context, marts


#: Words that tell an agency from a department.
AGENCY_WORDS = ["llc", "inc", "ltd", "corp", "gmbh", "group", "services", "staffing"]
#: The shapes of headings and rows in frozen pages, and of a role and the people linked behind it.
_WIKI_HEADING = r"^(={2,6})\s*(.*?)\s*\1\s*$"
_HTML_HEADING = r"(?is)^<h([1-6])[^>]*>(.*?)</h\1>"
_ROLE_CELL = r'(?s)class="text-right"[^>]*>(.*?)</td>'
_PERSON_LINK = r'/person/\d+/[^"]*"[^>]*>([^<]+)</a>'


def wiki_heading_index(docs: DataFrame) -> DataFrame:
    """docs(game_id, text) to (game_id, source_ref, heading): the open headings at each line that isn't one."""
    lines = docs.select("game_id", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    level = F.length(F.regexp_extract("line", _WIKI_HEADING, 1))
    title = F.regexp_replace(F.btrim(F.regexp_extract("line", _WIKI_HEADING, 2)), "'{2,3}", "")
    rows = lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.when(level > 0, strip_markup(link_targets(title))))
    out = context.heading_stack(rows, "level", "title", "game_id", "i", [2, 3, 4, 5, 6], "heading")
    return out.where("level is null and heading <> ''").select("game_id", F.concat(F.lit("L"), (F.col("i") + 1).cast("string")).alias("source_ref"), "heading")


def table_heading_index(docs: DataFrame, prefix: str = "tr") -> DataFrame:
    """docs(game_id, text) to (game_id, source_ref, heading): for each table row the last heading before it, by place in the text."""
    cut = F.split("text", r"(?i)(?=<tr\b)|(?=<h[1-6][^>]*>)")
    parts = docs.select("game_id", F.posexplode(cut).alias("i", "part"))
    head = strip_markup(F.regexp_extract("part", _HTML_HEADING, 2))
    row = F.col("part").rlike(r"(?i)^<tr\b")
    rows = parts.withColumn("h", F.when(F.col("part").rlike(_HTML_HEADING), head)).withColumn("row", row)
    filled = context.forward_fill(rows, F.col("h"), "heading", "game_id", "i")
    from pyspark.sql import Window as W

    numbered = filled.where("row").withColumn("n", F.row_number().over(W.partitionBy("game_id").orderBy("i")) - 1)
    return numbered.where("heading <> ''").select("game_id", F.concat(F.lit(prefix), F.col("n").cast("string")).alias("source_ref"), "heading")


def explicit_roles(docs: DataFrame) -> DataFrame:
    """docs(game_id, text) to (game_id, name, roles): each linked person's roles in order, joined."""
    rows = docs.select("game_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<tr>(.*?)</tr>"), 1)).alias("i", "tr"))
    role = strip_markup(F.regexp_extract("tr", _ROLE_CELL, 1))
    people = F.regexp_extract_all("tr", F.lit(_PERSON_LINK), 1)
    each = rows.withColumn("roles", role).where("roles <> ''").select("game_id", "roles", "i", F.explode(people).alias("raw"))
    return marts.ordered_roles(each.withColumn("name", strip_markup("raw")), ["game_id", "name"], "roles", "i")


def name_tags(fixes: DataFrame, not_work: list[str]) -> DataFrame:
    """fixes(name_raw, names, place) to (name, tag): the first tag that tells the work, of fixes with one name; the first fix wins."""
    tags = F.transform(F.regexp_extract_all("name_raw", F.lit(r"\(([^)]{2,30})\)"), 1), lambda t: F.trim(t))
    stop = F.array(*map(F.lit, not_work)) if not_work else F.array().cast("array<string>")
    company = r"(?i)\b(" + "|".join(AGENCY_WORDS) + r")\b"
    work = F.filter(tags, lambda t: (t != "") & ~F.array_contains(stop, F.lower(t)) & ~t.rlike(r"^\d+$") & ~t.rlike(company))
    names = F.filter(F.transform(F.split("names", "[|]"), lambda n: F.trim(n)), lambda n: n != "")
    one = fixes.select("place", F.get(work, F.lit(0)).alias("tag"), names.alias("n")).where("tag is not null and size(n) = 1")
    return one.groupBy(F.get("n", F.lit(0)).alias("name")).agg(F.min_by("tag", "place").alias("tag"))


def marked_people(rows: DataFrame, aliases: DataFrame, columns: DataFrame, slug) -> DataFrame:
    """rows(game_id, name_raw, ord) of one inclusion class: (ident, name, cols), by alias or slug; longest spelling, first on ties."""
    from pyspark.sql import Column

    ident: Column = F.coalesce(F.col("person_id"), slug)
    al = aliases.withColumnRenamed("name_variant", "name_raw")
    at = rows.join(al, "name_raw", "left").withColumn("ident", ident).join(columns, "game_id")
    return at.groupBy("ident").agg(F.max_by("name_raw", F.struct(F.length("name_raw"), -F.col("ord"))).alias("name"), F.array_sort(F.collect_set("col")).alias("cols"))
