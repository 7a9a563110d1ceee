"""One role class for each person and release, with provenance.

The cascade is one ``coalesce`` of numbers that code class and provenance, so each
pattern is tried once and a vote is one integer minimum; nothing is shuffled
until the votes. Word lists are fixed values of the domain; patterns are data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading_from_ref
from .rules import first_match

STATED, INFERRED = "stated", "inferred"
UNSPECIFIED = "unspecified"

#: The class that wins a vote comes first.
PRIORITY = ["management", "writing", "audio", "design", "engineering", "art", "production", "qa", "live", "publishing", "community", "thanks", "unspecified"]

#: Category to class. Publishing has none on purpose.
CATEGORY_CLASS = {"Leadership": "management", "Studio/Business": "management", "Production": "production", "Engineering": "engineering", "Art": "art", "Design": "design", "Audio": "audio", "Narrative": "writing", "Voice": "writing", "QA": "qa", "Special Thanks": "thanks"}

#: What an employer's type says; development says nothing.
VENDOR_TYPE_CLASS = {"testing": "qa", "cinematic-sound": "audio", "publishing": "publishing"}

#: Standing that decides at once, and standing that only fills silence.
STANDING_ALWAYS = {"community": "community", "babies": "thanks"}
STANDING_FALLBACK = {"publishing": "publishing", "special-thanks": "thanks"}


def mapped(c: Column, table: dict) -> Column:
    """A small dictionary as an expression; null where it has no entry."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c) if table else F.lit(None).cast("string")


def code_of(cls: str, prov: str) -> int:
    """A class and its provenance as one number: twice the rank, plus one if inferred. The least number wins a vote and says whether it was ever stated."""
    return 2 * (PRIORITY.index(cls) + 1) + (prov != STATED)


def decoded(code: Column) -> Column:
    """struct(cls, prov) of a code; null of null."""
    cls = F.element_at(F.array(*map(F.lit, PRIORITY)), F.floor(code / 2).cast("int"))
    return F.when(code.isNotNull(), F.struct(cls.alias("cls"), F.when(code % 2 == 0, STATED).otherwise(INFERRED).alias("prov")))


def _by_table(c: Column, table: dict[str, str], prov: str) -> Column:
    return mapped(c, {k: code_of(v, prov) for k, v in table.items()})


def _by_rules(c: Column, rules: list[tuple[str, str]], prov: str) -> Column:
    return F.when(c != "", first_match(c, [(p, code_of(label, prov)) for p, label in rules], None))


def text_code(headings: list[tuple[str, str]], categories: list[tuple[str, str]], **cols: Column) -> Column:
    """The code of what a credit's texts say, or null: the patterns of the cascade, apart from standing, each tried once.

    ``headings`` and ``categories`` are ordered (pattern, label). Columns: category,
    role_raw, tag, explicit, heading, vendor_type; absent ones are ''. Order:
    category, role text, name tag, explicit role (category rules, then heading
    rules), then inferred from heading and employer.
    """
    get = lambda name: F.coalesce(cols[name], F.lit("")) if name in cols else F.lit("")
    # the first category rule that maps to a class, not merely the first that matches
    usable = [(p, CATEGORY_CLASS[label]) for p, label in categories if label in CATEGORY_CLASS]
    return F.coalesce(
        _by_table(F.trim(get("category")), CATEGORY_CLASS, STATED),
        _by_rules(get("role_raw"), headings, STATED),
        _by_rules(get("tag"), headings, STATED),
        _by_rules(get("explicit"), usable, STATED),
        _by_rules(get("explicit"), headings, STATED),
        _by_rules(get("heading"), headings, INFERRED),
        _by_table(get("vendor_type"), VENDOR_TYPE_CLASS, INFERRED),
    ).cast("int")


def standing_code(text: Column, inclusion: Column) -> Column:
    """The code of standing that always holds, else of what the texts say, else of standing as a fallback, else unspecified."""
    inclusion = F.trim(F.coalesce(inclusion, F.lit("")))
    return F.coalesce(_by_table(inclusion, STANDING_ALWAYS, STATED), text, _by_table(inclusion, STANDING_FALLBACK, STATED), F.lit(code_of(UNSPECIFIED, STATED)))


def row_class(headings: list[tuple[str, str]], categories: list[tuple[str, str]], inclusion: Column | None = None, **cols: Column) -> Column:
    """struct(cls, prov) of one credit, by :func:`text_code` and :func:`standing_code`."""
    return decoded(standing_code(text_code(headings, categories, **cols), F.lit("") if inclusion is None else inclusion))


def coded(credits: DataFrame, headings: list[tuple[str, str]], categories: list[tuple[str, str]], tags: DataFrame, explicit: DataFrame, vendor_types: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Credits with ``code``: what each says of a role, by the order of :func:`text_code`, from its row and what other tables know of it.

    tags(name, tag), explicit(game_id, name, roles), vendor_types(studio, type),
    index(game_id, source_ref, heading); a company's key is its text in lower case
    without outer space, corporate suffix and all; of rows with one key the one with
    the greatest value counts. Texts of these tables are read by the patterns there,
    once each, and only their codes are joined; credits have their own texts read.
    """
    name, studio = F.trim("name_raw"), F.lower(F.trim(F.coalesce("studio", F.lit(""))))
    one = lambda t, keys, value, code, out: t.groupBy(*keys).agg(F.max(value).alias("__v")).withColumn(out, code(F.col("__v"))).drop("__v")
    usable = [(p, CATEGORY_CLASS[label]) for p, label in categories if label in CATEGORY_CLASS]
    stated, inferred = (lambda c: _by_rules(c, headings, STATED)), (lambda c: _by_rules(c, headings, INFERRED))
    tag = one(tags.where("tag <> ''"), [F.trim("name").alias("__name")], F.col("tag"), stated, "__tag")
    said = one(explicit.where("roles <> ''"), [F.col("game_id"), F.trim("name").alias("__name")], F.col("roles"), lambda c: F.coalesce(_by_rules(c, usable, STATED), stated(c)), "__said")
    kind = one(vendor_types.where("trim(studio) <> '' and trim(type) <> ''"), [F.lower(F.trim("studio")).alias("__studio")], F.lower(F.trim("type")), lambda c: _by_table(c, VENDOR_TYPE_CLASS, INFERRED), "__kind")
    out = with_heading_code(credits, index, inferred).withColumn("__name", name).withColumn("__studio", studio)
    out = out.join(tag, "__name", "left").join(said, ["game_id", "__name"], "left").join(kind, "__studio", "left")
    own = F.coalesce(_by_table(F.trim(F.coalesce("category", F.lit(""))), CATEGORY_CLASS, STATED), stated(F.coalesce("role_raw", F.lit(""))))
    code = F.coalesce(own, "__tag", "__said", "__heading", "__kind").cast("int")
    return out.select(*credits.columns, standing_code(code, F.col("inclusion_class")).alias("code"))


def classify(credits: DataFrame, headings: list[tuple[str, str]], categories: list[tuple[str, str]], tags: DataFrame, explicit: DataFrame, vendor_types: DataFrame, index: DataFrame | None = None, keys: list[str] = ("name_raw", "game_id")) -> DataFrame:
    """(keys, cls, prov): one role class for each name and release, from credit rows and what other tables know of them."""
    return code_votes(coded(credits, headings, categories, tags, explicit, vendor_types, index), list(keys))


def rank(cls: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRIORITY)), cls)


def code_votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, code): the class of highest priority, unspecified only if nothing else; a class stated once is stated."""
    best = rows.groupBy(*keys).agg(F.min("code").alias("__c"))
    return best.select(*keys, decoded(F.col("__c")).alias("__d")).select(*keys, "__d.cls", "__d.prov")


def votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`code_votes` of rows(keys, cls, prov)."""
    code = rank(F.col("cls")) * 2 + (F.col("prov") != STATED).cast("int")
    return code_votes(rows.select(*keys, code.cast("int").alias("code")), keys)


def column_fold(per_release: DataFrame, columns: DataFrame, key: str, release: str) -> DataFrame:
    """Best class of a person over the releases that one report column covers; columns(release, col) is small."""
    return per_release.join(columns, release).groupBy(key, "col").agg(F.min_by("cls", rank(F.col("cls"))).alias("cls"))


def column_classes(coded: DataFrame, key: str) -> DataFrame:
    """(key, col, cls) from rows(key, col, code): the fold of the votes of a column's releases, which is the vote of all their rows."""
    best = coded.where("col is not null").groupBy(key, "col").agg(F.min("code").alias("__c"))
    return best.select(key, "col", decoded(F.col("__c"))["cls"].alias("cls"))


def with_heading_code(credits: DataFrame, index: DataFrame | None, code) -> DataFrame:
    """Adds ``__heading``, the code of the heading: from the index by (game_id, source_ref), then by the reference before '#', then from the reference itself."""
    own = code(heading_from_ref(F.col("source_ref")))
    if index is None:
        return credits.withColumn("__heading", own)
    given = index.where("heading <> ''").groupBy("game_id", "source_ref").agg(F.max("heading").alias("__h"))
    given = given.select("game_id", "source_ref", F.struct(code(F.col("__h")).alias("code")).alias("__h"))
    full = given.withColumnRenamed("__h", "__h1")
    part = given.select("game_id", F.col("source_ref").alias("__ref"), F.col("__h").alias("__h2"))
    out = credits.withColumn("__ref", F.substring_index("source_ref", "#", 1)).join(full, ["game_id", "source_ref"], "left").join(part, ["game_id", "__ref"], "left")
    # a heading of the index counts even where it says nothing of a role
    found = F.coalesce("__h1", "__h2")
    return out.withColumn("__heading", F.when(found.isNotNull(), found["code"]).otherwise(own)).drop("__ref", "__h1", "__h2")
