"""Roles, report and careers on credits made of the order tables.

A customer is a person, an order year a release, an order line a credit whose part
says company, category and text. 1998 and 1999 share a column of the grid.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, report, roles
from ..operators.identity import uncertain_review as review
from ..shared import materialised
from . import careers
from .continuity import core_orders, person_metrics, read
from .continuity import SQL as CONTINUITY

SQL: dict[str, str] = {}
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


HEADINGS = [(r"(?i)\bsteel\b", "engineering"), (r"(?i)\b(tin|nickel)", "qa"), (r"(?i)brand#[1-3]", "live")]
CATEGORIES = [(r"(?i)\bpolished\b", "Art"), (r"(?i)copper", "Nothing"), (r"(?i)brass", "Audio")]
#: column, year label, era
COLUMNS = [(0, "1995", "A"), (1, "1996", "A"), (2, "1997", "B"), (3, "1998-99", "B"), (4, "2000", "B"), (5, "2001", "C")]
ERAS = {"y1995": "A", "y1996": "A", "y1997": "B", "y1998": "B", "y1999": "B", "y2000": "B", "y2001": "C"}
GROUPS = {"y1998": "y1998-99", "y1999": "y1998-99"}
NAMED = ["brand#21", "brand#34"]


def columns(spark):
    return spark.createDataFrame([(g, 3 if y in (1998, 1999) else y - 1995 - (y > 1999)) for g, y in ((f"y{y}", y) for y in range(1995, 2002))], "game_id string, col int")


def games(spark):
    return spark.createDataFrame([(f"y{y}", y, y - 1994) for y in range(1995, 2002)], "game_id string, year int, sequence int")


def credits(spark, d):
    """One row an order line."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("game_id"))
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type", "p_name")
    n, k, size = F.col("l_linenumber"), F.col("l_partkey"), F.col("p_size")
    cls = F.when(n == 7, "special-thanks").when(n == 6, "publishing").when((n == 5) & (k % 7 == 0), "community").otherwise("core")
    key = F.col("o_custkey").cast("string")
    name = F.when(cls == "community", F.concat(F.lit("Vol "), k.cast("string"))).when(n == 2, F.concat(F.lit("CUST "), key)).otherwise(F.concat(F.lit("Cust "), key))
    studio = F.when(n % 3 == 0, F.concat(F.col("p_brand"), F.lit(", Inc."))).when((n % 3 == 2) & (k % 2 == 0), F.upper("p_brand")).otherwise("")
    ref = F.when(k % 3 == 0, F.concat(F.lit("Unit/"), F.col("p_type"), F.lit("#"), n.cast("string"))).otherwise(F.concat(F.lit("L"), k.cast("string")))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, k == F.col("p_partkey"))
    return j.select(
        "game_id", name.alias("name_raw"), cls.alias("inclusion_class"), studio.alias("studio"), ref.alias("source_ref"),
        F.when((size > 40) & (k % 2 == 0), "Design").when(size > 40, "Publishing").otherwise("").alias("category"), F.when(size % 5 == 0, F.col("p_type")).otherwise("").alias("role_raw"),
    )


_CR = """j AS (SELECT l_linenumber AS n, l_partkey AS k, o_custkey, 'y' || year(o_orderdate) AS game_id, CAST(year(o_orderdate) AS INTEGER) AS y, p_brand, p_size, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
cr AS (SELECT o_custkey, game_id, y, CASE WHEN y IN (1998, 1999) THEN 3 WHEN y > 1999 THEN y - 1996 ELSE y - 1995 END AS col,
 CASE WHEN n = 5 AND k % 7 = 0 THEN 'Vol ' || k WHEN n = 2 THEN 'CUST ' || o_custkey ELSE 'Cust ' || o_custkey END AS name_raw,
 CASE WHEN n = 7 THEN 'special-thanks' WHEN n = 6 THEN 'publishing' WHEN n = 5 AND k % 7 = 0 THEN 'community' ELSE 'core' END AS cls,
 CASE WHEN n % 3 = 0 THEN p_brand || ', Inc.' WHEN n % 3 = 2 AND k % 2 = 0 THEN upper(p_brand) ELSE '' END AS studio, CASE WHEN n % 3 = 0 OR (n % 3 = 2 AND k % 2 = 0) THEN lower(p_brand) ELSE '' END AS key,
 CASE WHEN k % 3 = 0 THEN 'Unit/' || p_type || '#' || n ELSE 'L' || k END AS ref, CASE WHEN k % 3 = 0 THEN 'Unit ' || p_type ELSE '' END AS own_heading, k, n, p_brand, p_type,
 CASE WHEN p_size > 40 AND k % 2 = 0 THEN 'Design' WHEN p_size > 40 THEN 'Publishing' ELSE '' END AS category, CASE WHEN p_size % 5 = 0 THEN p_type ELSE '' END AS role_raw FROM j)"""


# --- roles, from credits to one class a person and release ------------------------


def context(spark, d):
    """Tags behind names, explicit roles, companies' work, headings by reference."""
    c, p = read(spark, d, "customer"), read(spark, d, "part")
    tags = c.where("c_custkey % 11 = 0").select(F.concat(F.lit(" Cust "), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Nickel Team").otherwise("Chefs").alias("tag"))
    explicit = c.where("c_custkey % 5 = 0").select(F.lit("y1997").alias("game_id"), F.concat(F.lit("Cust "), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Copper and Brass").otherwise("Tin").alias("roles"))
    types = p.select(F.concat(F.col("p_brand"), F.lit(", Inc.")).alias("studio")).distinct().where("studio like 'Brand#4%'").withColumn("type", F.when(F.col("studio") < "Brand#43", " Testing").otherwise("development"))
    index = p.where("p_partkey % 9 = 1").select(F.lit("y1999").alias("game_id"), F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("source_ref"), F.lit("Steel works").alias("heading"))
    return tags, explicit, types, index


def classes(spark, d):
    tags, explicit, types, index = context(spark, d)
    return roles.classify(credits(spark, d), HEADINGS, CATEGORIES, tags, explicit, types, index)


@query
def classified_names(spark, d):
    """Standing, category, role text, name tag, explicit role, heading, employer: the whole cascade and its votes."""
    return classes(spark, d)


def _head(t: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{c}'" for p, c in HEADINGS) + " END"


_RANK = "list_position([" + ", ".join(f"'{c}'" for c in roles.PRIORITY) + "], cls)"
_CLASSES = f"""{_CR},
x AS (SELECT *, CASE WHEN name_raw LIKE 'Cust %' AND o_custkey % 11 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Nickel Team' ELSE 'Chefs' END END AS tag,
 CASE WHEN name_raw LIKE 'Cust %' AND o_custkey % 5 = 0 AND y = 1997 THEN CASE WHEN o_custkey % 2 = 0 THEN 'Copper and Brass' ELSE 'Tin' END END AS explicit,
 CASE WHEN k % 3 <> 0 AND k % 9 = 1 AND y = 1999 THEN 'Steel works' ELSE own_heading END AS heading,
 CASE WHEN n % 3 = 0 AND p_brand LIKE 'Brand#4%' AND p_brand || ', Inc.' < 'Brand#43' THEN 'testing' END AS vt FROM cr),
s AS (SELECT *, CASE WHEN cls = 'community' THEN 'community' END AS s1, CASE WHEN category = 'Design' THEN 'design' END AS s2, {_head("role_raw")} AS s3, {_head("tag")} AS s4,
 CASE WHEN explicit = 'Copper and Brass' THEN 'audio' WHEN explicit = 'Tin' THEN 'qa' END AS s5, {_head("heading")} AS s6, CASE WHEN vt = 'testing' THEN 'qa' END AS s7,
 CASE WHEN cls = 'publishing' THEN 'publishing' WHEN cls = 'special-thanks' THEN 'thanks' END AS s8 FROM x),
r AS (SELECT name_raw, game_id, col, coalesce(s1, s2, s3, s4, s5, s6, s7, s8, 'unspecified') AS cls, coalesce(s1, s2, s3, s4, s5) IS NOT NULL OR coalesce(s6, s7) IS NULL AS st FROM s),
v AS (SELECT name_raw, game_id, col, cls, bool_or(st) AS st FROM r GROUP BY 1, 2, 3, 4),
cn AS (SELECT name_raw, game_id, any_value(col) AS col, min_by(cls, {_RANK}) AS cls, CASE WHEN min_by(st, {_RANK}) THEN 'stated' ELSE 'inferred' END AS prov FROM v GROUP BY 1, 2)"""
SQL["classified_names"] = f"WITH {_CLASSES} SELECT name_raw, game_id, cls, prov FROM cn"


def role_tables(spark, d):
    return report.role_tables(classes(spark, d).withColumnRenamed("name_raw", "name"), columns(spark))


@query
def role_by_column(spark, d):
    """Each name's class in each column of the grid."""
    return role_tables(spark, d)[0]


SQL["role_by_column"] = f"WITH {_CLASSES} SELECT name_raw AS name, CAST(col AS INTEGER) AS col, min_by(cls, {_RANK}) AS cls FROM cn GROUP BY 1, 2"


@query
def role_totals(spark, d):
    """Classes over all names and releases, and by column (-1: all)."""
    _, every, by_col = role_tables(spark, d)
    return every.select(F.lit(-1).alias("col"), "cls", "n").unionByName(by_col)


SQL["role_totals"] = f"WITH {_CLASSES} SELECT -1 AS col, cls, count(*) AS n FROM cn GROUP BY 2 UNION ALL SELECT CAST(col AS INTEGER), cls, count(*) FROM cn GROUP BY 1, 2"


def role_cards(spark, d):
    return report.role_cards(classes(spark, d).withColumnRenamed("name_raw", "name"), columns(spark))


@query
def role_rows(spark, d):
    """Each column's classes with shares, bar segments and both orders."""
    return report.role_rows(role_cards(spark, d))


_LEGEND = "list_position([" + ", ".join(f"'{c}'" for c in layout.ROLE_ORDER) + "], cls)"
SQL["role_rows"] = f"""WITH {_CLASSES}, nn AS (SELECT col, cls, {_LEGEND} AS i, count(*) AS n FROM cn GROUP BY 1, 2),
sh AS (SELECT *, sum(n) OVER (PARTITION BY col) AS total, sum(n) OVER (PARTITION BY col ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM nn)
SELECT CAST(col AS INTEGER) AS col, cls, n, CAST(round_even(100.0::DOUBLE * n / total, 0) AS INTEGER) AS pct, CAST(round(10000.0::DOUBLE * (upto - n) / total) AS INTEGER) AS start, CAST(round(10000.0::DOUBLE * upto / total) AS INTEGER) AS stop,
 CAST(row_number() OVER (PARTITION BY col ORDER BY i) - 1 AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY col ORDER BY n DESC, i) - 1 AS INTEGER) AS by_share FROM sh"""


@query
def game_cards(spark, d):
    """A column's card: its years and its era's, its roster by class, and the classes from the largest."""
    cards = role_cards(spark, d)
    cols = spark.createDataFrame(COLUMNS, "col int, year string, era string")
    first = report.role_rows(cards).groupBy("col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("by_share", "cls", "n"))), lambda x: F.concat_ws(" ", x["cls"], report.fmt(x["n"]))), ", ").alias("largest"))
    return cols.join(report.era_years(cols), "era").join(cards, "col").join(first, "col").select("col", "year", "era", "years", "total", *layout.ROLE_ORDER, "largest")


SQL["game_cards"] = f"""WITH {_CLASSES}, nn AS (SELECT col, cls, {_LEGEND} AS i, count(*) AS n FROM cn GROUP BY 1, 2), ci(col, year, era) AS (VALUES {", ".join(f"({c}, '{y}', '{e}')" for c, y, e in COLUMNS)}),
er AS (SELECT era, CASE WHEN min_by(year, col) = max_by(year, col) THEN min_by(year, col) ELSE min_by(year, col) || '–' || max_by(year, col) END AS years FROM ci GROUP BY 1)
SELECT ci.col, ci.year, ci.era, years, CAST(sum(n) AS BIGINT) AS total, {", ".join(f"CAST(coalesce(sum(n) FILTER (cls = '{c}'), 0) AS BIGINT) AS {c}" for c in layout.ROLE_ORDER)},
 string_agg(cls || ' ' || format('{{:,}}', n), ', ' ORDER BY n DESC, i) AS largest FROM ci JOIN er ON ci.era = er.era JOIN nn ON ci.col = nn.col GROUP BY 1, 2, 3, 4"""

# --- the report -------------------------------------------------------------------


def facts(spark, d):
    """What the report reads of credits, written once a query."""
    return report.credit_facts(credits(spark, d), columns(spark))


def coded_facts(spark, d):
    """The same with role codes."""
    tags, explicit, types, index = context(spark, d)
    return report.credit_facts(roles.coded(credits(spark, d), HEADINGS, CATEGORIES, tags, explicit, types, index), columns(spark))


def customer():
    """The key of a customer's spelling."""
    return F.substring("name_raw", 6, 20)


def people(f):
    """Who has a core credit: spellings and releases."""
    core = f.where("inclusion_class = 'core'").groupBy(customer().alias("key")).agg(F.array_sort(F.collect_set("game_id")).alias("games"))
    return core.select(
        F.concat(F.lit("cust-"), "key").alias("person_id"), F.concat(F.lit("Cust "), "key").alias("display_name"),
        F.array(F.concat(F.lit("Cust "), "key"), F.concat(F.lit("CUST "), "key")).alias("variants"), "games",
    )


def everyone(spark, f):
    ident, name = F.concat(F.lit("cust-"), customer()).alias("ident"), F.concat(F.lit("Cust "), customer()).alias("name")
    own = lambda cls: f.where((F.col("inclusion_class") == cls) & F.col("col").isNotNull()).select(ident, name, "col")
    return report.drawn({"staff": report.people_spots(people(f), columns(spark), ["Cust 3"]), "publisher": own("publishing"), "special_thanks": own("special-thanks"), "community": report.community_people(f, columns(spark))})


_EV = f"""{_CR},
parts AS (SELECT 'cust-' || o_custkey AS ident, 'Cust ' || o_custkey AS name, col, 0 AS part FROM cr WHERE cls = 'core' AND o_custkey <> 3
 UNION SELECT 'cust-' || o_custkey, 'Cust ' || o_custkey, col, 1 FROM cr WHERE cls = 'publishing' UNION SELECT 'cust-' || o_custkey, 'Cust ' || o_custkey, col, 2 FROM cr WHERE cls = 'special-thanks' UNION SELECT name_raw, name_raw, col, 3 FROM cr WHERE cls = 'community'),
ev AS (SELECT ident, any_value(name) AS name, list(DISTINCT col ORDER BY col) AS cols, bool_or(part = 0) AS staff, bool_or(part = 1) AS publisher, bool_or(part = 2) AS special_thanks, bool_or(part = 3) AS community FROM parts GROUP BY 1),
ec AS (SELECT DISTINCT ev.*, p.col FROM ev JOIN parts p ON ev.ident = p.ident)"""


@query
def drawn_people(spark, d):
    return everyone(spark, facts(spark, d)).withColumn("cols", F.array_join(F.transform("cols", lambda c: c.cast("string")), "|"))


SQL["drawn_people"] = f"WITH {_EV} SELECT ident, name, array_to_string(cols, '|') AS cols, staff, publisher, special_thanks, community FROM ev"


def work(spark, f, drawn):
    makers = spark.createDataFrame([("Brand#11", "first-party"), (" BRAND#12, Inc. ", "independent")], "studio string, class string")
    types = spark.createDataFrame([("Brand#21 LLC", "testing"), ("brand#22", "publishing"), ("Brand#23", "cinematic-sound")], "studio string, type string")
    return report.employed(f, people(f), drawn, columns(spark), makers, types)


def page(spark, d):
    """(facts, everyone drawn, their work), each written once for the marts that read them."""
    f = facts(spark, d)
    drawn = materialised(everyone(spark, f))
    return f, drawn, materialised(work(spark, f, drawn))


_WORK = f"""{_EV},
wk AS (SELECT cr.col, ec.name, cr.key, cr.studio, CASE cr.key WHEN 'brand#21' THEN 'testing' WHEN 'brand#22' THEN 'publishing' WHEN 'brand#23' THEN 'cinematic-sound' ELSE 'development' END AS type
 FROM cr JOIN ec ON cr.col = ec.col AND ec.name = CASE WHEN cr.cls = 'community' THEN cr.name_raw WHEN cr.o_custkey IN (SELECT o_custkey FROM cr WHERE cls = 'core') THEN 'Cust ' || cr.o_custkey END
 WHERE cr.key NOT IN ('', 'brand#11', 'brand#12'))"""


@query
def employed_people(spark, d):
    f = facts(spark, d)
    return work(spark, f, everyone(spark, f)).groupBy("col", "name", "key", "studio", "type").agg(F.sum("n").alias("n"))


SQL["employed_people"] = f"WITH {_WORK} SELECT CAST(col AS INTEGER) AS col, name, key, studio, type, count(*) AS n FROM wk GROUP BY ALL"


def alone(spark):
    return spark.createDataFrame([("y1996", "A Band", "Music", "cinematic-sound"), ("y1999", "Lab", "Tests", "testing"), ("y1998", "Lab 2", "Tests", "testing")], "game_id string, studio string, role string, type string")


@query
def vendor_chips(spark, d):
    """Named vendors, the others by people, then companies credited without anyone (-1)."""
    out = report.chips(page(spark, d)[2], NAMED, alone(spark), columns(spark))
    return out.withColumn("people", F.coalesce("people", F.lit(-1).cast("long")))


_NAMED = ", ".join(f"'{k}'" for k in NAMED)
SQL["vendor_chips"] = f"""WITH {_WORK}, sp AS (SELECT key, arg_min(studio, (-n, studio)) AS studio FROM (SELECT key, studio, count(*) AS n FROM wk GROUP BY 1, 2) x GROUP BY 1),
n AS (SELECT col, key, count(DISTINCT name) AS people FROM wk GROUP BY 1, 2),
u AS (SELECT col, studio, people, CASE WHEN n.key IN ({_NAMED}) THEN 0 ELSE 1 END AS part FROM n JOIN sp ON n.key = sp.key UNION ALL VALUES (1, 'A Band', -1, 2), (3, 'Lab', -1, 2), (3, 'Lab 2', -1, 2))
SELECT CAST(col AS INTEGER) AS col, CAST(row_number() OVER (PARTITION BY col ORDER BY part, people DESC, studio) AS INTEGER) AS place, studio, CAST(people AS BIGINT) AS people FROM u"""


@query
def page_composition(spark, d):
    """What each column is made of."""
    f, drawn, jobs = page(spark, d)
    published = f.where("inclusion_class = 'publishing' and col is not null").select("col", F.col("name_raw").alias("name"))
    return report.composition(drawn, jobs, published, NAMED)


SQL["page_composition"] = f"""WITH {_WORK}, job AS (SELECT col, name, max(CASE WHEN key IN ({_NAMED}) THEN key END) AS named, min(type) AS type FROM wk GROUP BY 1, 2),
pu AS (SELECT DISTINCT col, name_raw AS name FROM cr WHERE cls = 'publishing'),
t AS (SELECT ec.col, count(*) AS total, count(*) FILTER (ec.cols[1] = ec.col) AS newcomers, count(job.type) AS vendors, count(job.named) AS named,
 count(*) FILTER (named IS NULL AND type = 'development') AS development, count(*) FILTER (named IS NULL AND type = 'cinematic-sound') AS cinematic_sound, count(*) FILTER (named IS NULL AND type = 'testing') AS testing, count(*) FILTER (named IS NULL AND type = 'publishing') AS publishing,
 count(pu.name) AS publishers, count(*) FILTER (community) AS community, count(*) FILTER (special_thanks) AS thanks
 FROM ec LEFT JOIN job ON ec.col = job.col AND ec.name = job.name LEFT JOIN pu ON ec.col = pu.col AND ec.name = pu.name GROUP BY 1)
SELECT CAST(col AS INTEGER) AS col, * EXCLUDE (col), total - vendors - publishers - community - thanks AS first_party FROM t"""


@query
def hero_numbers(spark, d):
    """All headline numbers."""
    _, drawn, jobs = page(spark, d)
    return report.hero_numbers(drawn, jobs, spark.createDataFrame(COLUMNS, "col int, year string, era string"), ["A", "B", "C"])


_pct = lambda a, b: f"CAST(CASE WHEN {b} = 0 THEN 0 ELSE round_even(100.0::DOUBLE * {a} / {b}, 0) END AS INTEGER)"
SQL["hero_numbers"] = f"""WITH {_WORK}, ci(col, yr, era) AS (VALUES {", ".join(f"({c}, {y[:4]}, '{e}')" for c, y, e in COLUMNS)}),
pv AS (SELECT DISTINCT name, col FROM wk),
a AS (SELECT ec.name, ec.col, NOT ec.community AND NOT ec.publisher AS dev, ci.yr, ci.era, pv.name IS NOT NULL AS v FROM ec JOIN ci ON ec.col = ci.col LEFT JOIN pv ON ec.name = pv.name AND ec.col = pv.col),
tr AS (SELECT name, col - lag(col) OVER w AS dd, yr - lag(yr) OVER w AS gg FROM a WINDOW w AS (PARTITION BY name ORDER BY col)),
lg AS (SELECT coalesce(max(gg), 0) AS g FROM tr WHERE dd > 1),
p AS (SELECT name, bool_or(v) AS hasv, count(*) AS n, count(DISTINCT era) AS eras, bool_or(era = 'B') AS inb, bool_or(dev AND era = 'B' AND NOT v) AS coreb, bool_or(era = 'A') AS ina, bool_or(era = 'A' AND NOT v) AS ina_core,
 bool_or(era = 'B' AND col < 5) AS prb, bool_or(era = 'B' AND col < 5 AND NOT v) AS prb_core, bool_or(col = 5) AS inf, bool_or(dev AND col = 5 AND NOT v) AS coref FROM a GROUP BY 1),
h AS (SELECT count(*) AS people, count(*) FILTER (hasv) AS with_vendor, count(*) FILTER (n > 1) AS several, count(*) FILTER (coreb) AS later_core, count(*) FILTER (coreb AND ina_core) AS later_core_first, count(*) FILTER (inb) AS later_all, count(*) FILTER (inb AND ina) AS later_all_first,
 count(*) FILTER (coref) AS final_core, count(*) FILTER (coref AND prb_core) AS final_core_later, count(*) FILTER (coref AND ina_core) AS final_core_first, count(*) FILTER (inf) AS final_all, count(*) FILTER (inf AND prb) AS final_all_later, count(*) FILTER (inf AND ina) AS final_all_first, count(*) FILTER (eras = 3) AS all_eras FROM p),
vr AS (SELECT key, count(DISTINCT name) AS people, count(DISTINCT col) AS releases FROM wk GROUP BY 1),
vn AS (SELECT count(*) AS vendors, count(*) FILTER (releases = 1) AS vendors_once, arg_min(key, (-people, key)) AS top_vendor, arg_min(people, (-people, key)) AS top_people, arg_min(releases, (-people, key)) AS top_releases FROM vr)
SELECT h.*, vn.*, (SELECT count(*) FROM tr WHERE dd = 1) AS unbroken, (SELECT count(*) FROM tr WHERE dd > 1) AS "returns", CAST((SELECT g FROM lg) AS INTEGER) AS longest_gap, (SELECT count(DISTINCT name) FROM tr, lg WHERE dd > 1 AND gg = g AND g > 0) AS longest_gap_people,
 {_pct("with_vendor", "people")} AS vendor_pct, {_pct("later_core_first", "later_core")} AS later_pct, {_pct("later_all_first", "later_all")} AS later_all_pct, {_pct("final_core_later", "final_core")} AS final_later_pct, {_pct("final_core_first", "final_core")} AS final_first_pct, format('{{:,}}', people) AS people_text FROM h, vn"""


# --- the grid ----------------------------------------------------------------------


def grid_people(spark, d):
    """Everyone drawn, with the class in each column; written once, as packing reads them twice."""
    f = coded_facts(spark, d)
    own = report.roles_in(roles.column_classes(f.withColumnRenamed("name_raw", "name"), "name"))
    return materialised(everyone(spark, f).join(own, "name", "left"))


_SHOWN = f"{_EV}, " + _CLASSES.removeprefix(_CR + ",").strip() + f""",
rc AS (SELECT name_raw AS name, col, min_by(cls, {_RANK}) AS cls FROM cn GROUP BY 1, 2),
sg AS (SELECT ec.name, list(coalesce(list_position([{", ".join(f"'{c}'" for c in layout.ROLE_ORDER)}], rc.cls) - 1, 13) ORDER BY ec.col) AS sig FROM ec LEFT JOIN rc ON ec.name = rc.name AND ec.col = rc.col GROUP BY 1),
gp AS (SELECT ev.name, ev.cols, ev.cols[1] AS a, ev.cols[-1] AS z, len(ev.cols) AS n, CASE WHEN publisher THEN 1 WHEN community THEN 2 ELSE 0 END AS mark, sg.sig, CASE WHEN ev.cols[1] < 2 THEN 0 ELSE 1 END AS sec FROM ev JOIN sg ON ev.name = sg.name)"""
_SHAPE = "z DESC, a, list_transform(list_reverse(cols), lambda x: -x), mark, sig, name"


def first_era():
    return F.when(F.get("cols", F.lit(0)) < 2, 0).otherwise(1)


@query
def career_sort(spark, d):
    """Everyone by career: shape, class, roles, name."""
    p = layout.career_rows(grid_people(spark, d), name="place")
    return p.select("name", F.concat_ws("|", F.transform("cols", lambda x: x.cast("string"))).alias("cols"), F.col("place").cast("int").alias("place"))


SQL["career_sort"] = f"WITH {_SHOWN} SELECT name, array_to_string(cols, '|') AS cols, CAST(row_number() OVER (ORDER BY {_SHAPE}) - 1 AS INTEGER) AS place FROM gp"


@query
def career_sort_plain(spark, d):
    """The older order: number of columns instead of their shape, nobody sunk."""
    p = layout.career_rows(grid_people(spark, d), group_by_shape=False, sink_marked=False, name="place")
    return p.select("name", F.col("place").cast("int").alias("place"))


SQL["career_sort_plain"] = f"WITH {_SHOWN} SELECT name, CAST(row_number() OVER (ORDER BY z DESC, a, n DESC, name) - 1 AS INTEGER) AS place FROM gp"


@query
def slot_packing(spark, d):
    """Grid cells by section and, with row -1, people who found no cell."""
    placed, over = layout.slot_packing(grid_people(spark, d), len(COLUMNS), section=first_era())
    return placed.unionByName(over.withColumn("row", F.lit(-1))).select(F.col("row").cast("int").alias("row"), "col", "name")


SQL["slot_packing"] = f"""WITH {_SHOWN}, m AS (SELECT *, row_number() OVER (ORDER BY sec, {_SHAPE}) - 1 AS row FROM gp WHERE n > 1),
fr AS (SELECT m.row, g.col, row_number() OVER (PARTITION BY g.col ORDER BY m.row) AS k FROM m, (SELECT unnest(range(0, {len(COLUMNS)})) AS col) g WHERE g.col < m.a OR g.col > m.z),
si AS (SELECT name, a AS col, row_number() OVER (PARTITION BY a ORDER BY mark, sig[1], name) AS k FROM gp WHERE n = 1)
SELECT CAST(m.row AS INTEGER) AS row, CAST(ec.col AS INTEGER) AS col, m.name FROM m JOIN ec ON m.name = ec.name UNION ALL SELECT CAST(coalesce(fr.row, -1) AS INTEGER), CAST(si.col AS INTEGER), si.name FROM si LEFT JOIN fr ON si.col = fr.col AND si.k = fr.k"""


@query
def grid_sections(spark, d):
    out = layout.sections(grid_people(spark, d), first_era())
    return out.select("section", F.col("row").cast("int").alias("row"))


SQL["grid_sections"] = f"WITH {_SHOWN} SELECT sec AS section, CAST(sum(n) OVER (ORDER BY sec ROWS UNBOUNDED PRECEDING) - n AS INTEGER) AS row FROM (SELECT sec, count(*) AS n FROM gp WHERE n > 1 GROUP BY 1) x"


# --- careers: employers' classes, groups, eras ----------------------------------------


def seen(spark, d):
    """(person, release, is_vendor, first_party) by the careers chain."""
    f = facts(spark, d)
    core = f.where("inclusion_class = 'core'")
    spelled = core.select(F.concat(F.lit("cust-"), customer()).alias("person_id"), "game_id", F.col("name_raw").alias("variant")).distinct()
    return careers.appearances(core, people(f), spelled, studio_classes(spark))


def studio_classes(spark):
    return spark.createDataFrame([("Brand#11", "first-party"), (" BRAND#12, Inc. ", " independent ")], "studio string, class string")


@query
def classify_studio(spark, d):
    return careers.studio_class(credits(spark, d), studio_classes(spark)).groupBy("studio", "studio_class").agg(F.count("*").alias("n"))


SQL["classify_studio"] = f"WITH {_CR} SELECT studio, CASE key WHEN '' THEN '' WHEN 'brand#11' THEN 'first-party' WHEN 'brand#12' THEN 'independent' ELSE 'vendor' END AS studio_class, count(*) AS n FROM cr GROUP BY 1, 2"

_SEEN = f"{_CR}, sn AS (SELECT o_custkey AS person, game_id, y, bool_or(key NOT IN ('', 'brand#11', 'brand#12')) AS v, bool_or(key = '') AS fp FROM cr WHERE cls = 'core' GROUP BY 1, 2, 3)"


@query
def career_appearances(spark, d):
    return seen(spark, d)


SQL["career_appearances"] = f"WITH {_SEEN} SELECT 'cust-' || person AS person, game_id AS release, v AS is_vendor, fp AS first_party FROM sn"

_SPINE = """pos(game_id, yr, sequence, pos) AS (VALUES ('y1995', 1995, 1, 0), ('y1996', 1996, 2, 1), ('y1997', 1997, 3, 2), ('y1998', 1998, 4, 3), ('y1999', 1999, 5, 3), ('y2000', 2000, 6, 4), ('y2001', 2001, 7, 5)),
pp AS (SELECT person, pos, lag(pos) OVER (PARTITION BY person ORDER BY pos) AS b, lead(pos) OVER (PARTITION BY person ORDER BY pos) AS a FROM (SELECT DISTINCT person, pos FROM sn JOIN pos ON sn.game_id = pos.game_id) x)"""


@query
def career_per_game(spark, d):
    """Per release through the careers chain; two releases are one group."""
    return careers.per_game(games(spark), seen(spark, d), GROUPS)


SQL["career_per_game"] = f"""WITH {_SEEN}, {_SPINE} SELECT pos.game_id, CAST(yr AS INTEGER) AS year, sequence, count(*) AS headcount, count(*) FILTER (b IS NULL) AS newcomers, count(*) FILTER (b < pos.pos - 1) AS "returning", count(*) FILTER (b = pos.pos - 1) AS continuing_from_previous,
 count(*) FILTER (a IS NULL) AS departures, count(*) FILTER (v) AS contractors FROM sn JOIN pos ON sn.game_id = pos.game_id JOIN pp ON sn.person = pp.person AND pos.pos = pp.pos GROUP BY 1, 2, 3"""


@query
def career_flows(spark, d):
    return careers.flow_edges(games(spark), seen(spark, d), GROUPS)


SQL["career_flows"] = f"WITH {_SEEN}, {_SPINE}, g(pos, grp) AS (VALUES (0, 'y1995'), (1, 'y1996'), (2, 'y1997'), (3, 'y1998-99'), (4, 'y2000'), (5, 'y2001')) SELECT s.grp AS from_grp, t.grp AS to_grp, count(*) AS count FROM pp JOIN g s ON pp.pos = s.pos JOIN g t ON pp.a = t.pos GROUP BY 1, 2"


@query
def career_lineage(spark, d):
    """Both views by era."""
    return careers.lineages(games(spark), seen(spark, d), ERAS)


def _lineage(where: str, flag: str) -> str:
    cols = ", ".join(f"CAST(count(*) FILTER (f{e} < sequence) AS BIGINT) AS \"from_{e}\"" for e in "ABC")
    firsts = ", ".join(f"min(CASE WHEN era = '{e}' THEN sequence END) AS f{e}" for e in "ABC")
    return f"""SELECT s.game_id AS release, any_value(s.era) AS era, count(*) AS roster, {cols}, CAST(count(*) FILTER (fall = sequence) AS BIGINT) AS no_prior, {flag} AS first_party_only FROM (SELECT sn.*, sequence, er.era FROM sn JOIN pos ON sn.game_id = pos.game_id JOIN er ON sn.game_id = er.game_id WHERE {where}) s
 JOIN (SELECT person, {firsts}, min(sequence) AS fall FROM sn JOIN pos ON sn.game_id = pos.game_id JOIN er ON sn.game_id = er.game_id WHERE {where} GROUP BY 1) f ON s.person = f.person GROUP BY 1"""


SQL["career_lineage"] = f"WITH {_SEEN}, {_SPINE}, er(game_id, era) AS (VALUES {', '.join(f'({g!r}, {e!r})' for g, e in ERAS.items())}) {_lineage('true', 'false')} UNION ALL {_lineage('fp', 'true')}"


@query
def uncertain_review(spark, d):
    """The review list of people with long gaps."""
    games_of = core_orders(spark, d).groupBy(F.col("o_custkey").alias("person")).agg(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))).alias("games"))
    p = person_metrics(spark, d).join(games_of, "person")
    return review(p.select(F.col("person").cast("string").alias("person_id"), F.col("person").cast("string").alias("display_name"), "games", "span_years", F.col("largest_gap").alias("largest_gap_years"), "uncertain"))


SQL["uncertain_review"] = f"WITH m AS ({CONTINUITY['person_metrics']}), g AS (SELECT person, string_agg(CAST(y AS VARCHAR), '|' ORDER BY y) AS games FROM (SELECT DISTINCT o_custkey AS person, year(o_orderdate) AS y FROM orders WHERE o_orderstatus <> 'P') x GROUP BY 1) SELECT CAST(m.person AS VARCHAR) AS person_id, CAST(m.person AS VARCHAR) AS name, games, span_years AS years, largest_gap AS largest_gap_years, '' AS ruling FROM m JOIN g ON m.person = g.person WHERE uncertain"
