"""From spellings to people.

Spelling keys are computed on distinct names only (the one Python function here).
"First seen" means the order of (file name with its suffix, row), which callers
put into column ``ord``; it differs from the order of ids where one id is the
beginning of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_compound, normalise_name, slug
from .checks import asserted

UNCERTAIN_YEARS = 10


class PersonIdCollision(ValueError):
    """Two spelling keys give one person id."""


class RulingError(ValueError):
    """A review with an unknown ruling."""


def reviews_checked(reviews: DataFrame) -> DataFrame:
    """(person_id, ruling): trimmed, lower case, blanks out; anything but same and split raises when read."""
    r = reviews.select("person_id", F.lower(F.trim("ruling")).alias("ruling")).where("ruling <> ''")
    return asserted(r, ~F.col("ruling").isin("same", "split"), RulingError, "rulings are 'same' or 'split'", "person_id", "ruling")


def spelling_keys(credits: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_raw, key, canonical): the key of each spelling, and the canonical spelling where one is known."""
    target = F.when((F.col("name_canonical") != "") & ~is_compound(F.col("name_raw")), F.col("name_canonical"))
    raws = credits.groupBy("name_raw").agg(F.min_by(target, F.when(target.isNotNull(), F.col("ord"))).alias("target"), F.min("ord").alias("ord"))
    named = raws.withColumn("norm", normalise_name(F.coalesce("target", "name_raw")))
    # of several canonical spellings with one key the last-seen raw's wins
    shown = named.where("target is not null").groupBy("norm").agg(F.max_by("target", "ord").alias("canonical"))
    al = aliases.select(F.col("name_variant").alias("name_raw"), F.col("person_id").alias("alias"))
    out = named.join(shown, "norm", "left").join(al, "name_raw", "left")
    key = F.coalesce(F.concat(F.lit("alias:"), "alias"), F.col("norm"))
    return out.select("name_raw", key.alias("key"), F.when(F.col("alias").isNull(), F.col("canonical")).alias("canonical"))


def person_id(key):
    return F.when(key.startswith("alias:"), F.regexp_replace(key, "^.*alias:", "")).otherwise(slug(key))


def resolve(credits: DataFrame, games: DataFrame, aliases: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, facts): people as in the person table, facts as distinct (person_id, game_id, variant).

    Nothing runs here: bad rulings and ids that several spellings claim raise when a result is read.

    ``credits`` holds name_raw, name_canonical, game_id, ord; ``games`` game_id, sequence, year.
    """
    reviews = reviews_checked(reviews)
    split = reviews.where("ruling = 'split'").select(F.col("person_id").alias("__base"), F.lit(True).alias("__split"))
    keyed = credits.join(spelling_keys(credits, aliases), "name_raw").withColumn("__base", person_id(F.col("key")))
    keyed = keyed.join(split, "__base", "left").withColumn("is_split", F.coalesce("__split", F.lit(False)))
    key = F.when(F.col("is_split"), F.concat("key", F.lit("#"), "game_id")).otherwise(F.col("key"))
    # a slug is taken of the key without the mark before the release; an alias keeps it
    plain = slug(F.regexp_replace(key, r"(?U)[^\w ]", ""))
    keyed = keyed.withColumn("pkey", key).withColumn("person_id", F.when(F.col("is_split") & ~F.col("key").startswith("alias:"), plain).otherwise(person_id(key)))
    keyed = keyed.select("person_id", "pkey", "game_id", "name_raw", "canonical", "ord", "is_split")
    # one dealing by person serves the check, the names shown and the facts
    keys = W.partitionBy("person_id")
    keyed = keyed.withColumns({"__low": F.min("pkey").over(keys), "__high": F.max("pkey").over(keys)})
    keyed = asserted(keyed, F.col("__low") != F.col("__high"), PersonIdCollision, "claimed by several spellings", "person_id", "__low", "__high")
    shown = keyed.groupBy("person_id").agg(F.min_by(F.struct("name_raw", "canonical", "is_split"), "ord").alias("f"))
    shown = shown.select("person_id", F.when(F.col("f.is_split"), F.col("f.name_raw")).otherwise(F.coalesce("f.canonical", "f.name_raw")).alias("display_name"), F.col("f.is_split").alias("is_split"))
    own = keyed.groupBy("person_id", "game_id", F.col("name_raw").alias("variant")).agg(F.min("ord").alias("ord"))
    facts = own.unionByName(compound_facts(own, shown))
    facts = facts.groupBy("person_id", "game_id", "variant").agg(F.min("ord").alias("ord"))
    return people_table(facts, shown, games, reviews), facts.select("person_id", "game_id", "variant")


#: Stands at each word end of a marked text; a noncharacter of Unicode.
_END = "\uffff"


def word_ends_marked(c):
    """``c`` with a mark at each word end: between a word character and another or none."""
    return F.regexp_replace(c, r"(?U)\b", _END)


def whole_name(c):
    """What a marked text holds just where the name stands in it between word ends: the name with its inner word ends, and one on each side."""
    return F.concat(F.lit(_END), F.btrim(word_ends_marked(c), F.lit(_END)), F.lit(_END))


def names_inside(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text, name) for distinct texts(text) and names(name): each name that stands whole in a text.

    They meet by the first two words of the name, or its only one, which any text that
    holds the name has in a row (names without a word character meet all texts). The
    test is one containment of marked strings, so no pattern is built from a row; word
    ends are those of a name as it stands (one that ends in a stop isn't found before a
    space).
    """
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1)
    left = names.select("name", whole_name(F.col("name")).alias("__n"), F.array_join(F.slice(word(F.col("name")), 1, 2), " ").alias("__w"))
    right = texts.select("text", word_ends_marked(F.col("text")).alias("__t"), word(F.col("text")).alias("__s"))
    twos = F.array_compact(F.zip_with("__s", F.slice("__s", 2, F.size("__s")), lambda a, b: F.concat(a, F.lit(" "), b)))
    right = right.withColumn("__w", F.explode(F.array_distinct(F.concat("__s", twos, F.array(F.lit("")))))).drop("__s")
    return left.join(right, "__w").where(F.contains("__t", "__n")).select("text", "name")


def compound_facts(own: DataFrame, shown: DataFrame) -> DataFrame:
    """Whole known names inside credits of several people: each such person gets the release and the spelling, at its first place there that is another's.

    ``own`` holds a row for each person, release and spelling. Texts and names are
    compared once each, however many rows and owners they have, and
    of a text's owners in a release only the first two remain: one of them isn't the
    person whose name it holds, and has the first place that counts. So the result grows
    with people and different texts, not with people times owners.
    """
    whole = own.where(is_compound(F.col("variant")) & F.col("person_id").isNotNull()).select(F.col("variant").alias("text"), "game_id", "person_id", F.col("ord").alias("at"))
    # a rank that is at most two is taken in each task before rows are dealt, so a text of many owners is no large task
    places = whole.withColumn("rank", F.row_number().over(W.partitionBy("text", "game_id").orderBy(F.asc_nulls_last("at"), "person_id"))).where("rank <= 2")
    side = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    places = places.groupBy("text", "game_id").agg(side(1, "person_id").alias("own_id"), side(1, "at").alias("at"), side(2, "person_id").alias("next_id"), side(2, "at").alias("next_at"))
    plain = shown.where("not is_split")
    # no semi-join: Spark takes its result to be as small as a file of names and would send all names to the task of the few hits
    names = plain.select("person_id", F.col("display_name").alias("name")).union(own.join(plain.select("person_id"), "person_id").select("person_id", F.col("variant").alias("name")))
    names = names.where((F.col("name") != "") & ~is_compound(F.col("name"))).distinct()
    hit = names_inside(whole.select("text").distinct(), names.select("name").distinct())
    mine = F.col("own_id") == F.col("person_id")
    each = hit.join(places, "text").join(names, "name").where(~mine | (mine & F.col("next_id").isNotNull()))
    return each.select("person_id", "game_id", F.col("text").alias("variant"), F.when(mine, F.col("next_at")).otherwise(F.col("at")).alias("ord"))


def people_table(facts: DataFrame, shown: DataFrame, games: DataFrame, reviews: DataFrame) -> DataFrame:
    """Variants by first appearance, games by sequence, and the measures of a career."""
    variants = facts.groupBy("person_id", "variant").agg(F.min("ord").alias("ord")).groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "variant"))), lambda x: x["variant"]).alias("variants"))
    played = facts.select("person_id", "game_id").distinct().join(games.select("game_id", "sequence", "year"), "game_id")
    seq = played.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "game_id", "year"))).alias("g"))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("g") - 1, F.lit(1))), lambda i: F.when(i < F.size("g"), F.get("g", i)["year"] - F.get("g", i - 1)["year"]))
    out = seq.select(
        "person_id",
        F.transform("g", lambda x: x["game_id"]).alias("games"),
        F.get("g", F.lit(0))["game_id"].alias("first_game"),
        F.element_at("g", -1)["game_id"].alias("last_game"),
        F.size("g").alias("game_count"),
        (F.element_at("g", -1)["year"] - F.get("g", F.lit(0))["year"]).alias("span_years"),
        F.coalesce(F.array_max(gaps), F.lit(0)).alias("largest_gap_years"),
    )
    same = reviews.where("ruling = 'same'").select("person_id", F.lit(True).alias("__same"))
    out = out.join(shown.select("person_id", "display_name"), "person_id").join(variants, "person_id").join(same, "person_id", "left")
    uncertain = (F.col("largest_gap_years") > UNCERTAIN_YEARS) & F.col("__same").isNull()
    return out.select("person_id", "display_name", "variants", "first_game", "last_game", "game_count", "games", "span_years", "largest_gap_years", uncertain.alias("uncertain"))


def real_people(people: DataFrame) -> DataFrame:
    """People but for phantoms: compound display names that some other person also owns."""
    owners = people.select("person_id", F.explode("variants").alias("v")).groupBy("v").agg(F.count_distinct("person_id").alias("n")).where("n > 1")
    phantom = people.where(is_compound(F.col("display_name"))).join(owners, F.col("display_name") == F.col("v"), "left_semi").select("person_id")
    return people.join(phantom, "person_id", "left_anti")


def uncertain_review(people: DataFrame) -> DataFrame:
    """The review list: widest gap first."""
    p = people.where("uncertain").orderBy(F.desc("largest_gap_years"), "person_id")
    return p.select("person_id", F.col("display_name").alias("name"), F.concat_ws("|", "games").alias("games"), F.col("span_years").alias("years"), "largest_gap_years", F.lit("").alias("ruling"))
