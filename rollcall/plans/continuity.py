"""Continuity and marts over orders: a customer is a person, an order year a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import continuity as op
from ..operators import layout, marts

#: release, sequence, group, era; 1998 and 1999 share a position and 2002 has nobody.
RELEASES = [(1995, 1, "1995", "A"), (1996, 2, "1996", "A"), (1997, 3, "1997", "B"), (1998, 4, "1998-99", "B"), (1999, 5, "1998-99", "B"), (2000, 6, "2000", "C"), (2001, 7, "2001", "C"), (2002, 8, "2002", "C")]
ERAS = ["A", "B", "C"]
GAP = 3


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def releases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELEASES, "release int, sequence int, grp string, era string")


#: An order's status stands for its inclusion class; measures read these, as the reader of credits does by default.
CORE = ["F", "O"]


def core_orders(spark: SparkSession, d: str, inclusion: list[str] | None = CORE) -> DataFrame:
    """Orders of the given classes; of all with None."""
    o = read(spark, d, "orders")
    return o if inclusion is None else o.where(F.col("o_orderstatus").isin(*inclusion))


def appearances(spark: SparkSession, d: str) -> DataFrame:
    o = core_orders(spark, d)
    return o.select(F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("release"), (F.col("o_orderpriority") == "1-URGENT").alias("is_vendor"), (F.col("o_orderpriority") == "5-LOW").alias("first_party"))


def spine(spark: SparkSession, d: str) -> DataFrame:
    return op.active_spine(releases(spark).drop("era"), appearances(spark, d))


_VALUES = ", ".join(f"({r}, {s}, '{g}', '{e}')" for r, s, g, e in RELEASES)
PG = f"""rel(release, sequence, grp, era) AS (VALUES {_VALUES}),
pg AS (SELECT o_custkey AS person, CAST(year(o_orderdate) AS INTEGER) AS release, o_orderpriority = '1-URGENT' AS v, o_orderpriority = '5-LOW' AS fp FROM orders WHERE o_orderstatus <> 'P'),
act AS (SELECT release, grp, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS position FROM (SELECT r.release, r.grp, min(r.sequence) OVER (PARTITION BY r.grp) AS f FROM rel r WHERE r.grp IN (SELECT rel.grp FROM rel JOIN pg ON rel.release = pg.release))),
pp AS (SELECT person, position, lag(position) OVER (PARTITION BY person ORDER BY position) AS b, lead(position) OVER (PARTITION BY person ORDER BY position) AS a FROM (SELECT DISTINCT pg.person, act.position FROM pg JOIN act ON pg.release = act.release) x)"""


def release_stats(spark, d):
    return op.release_stats(appearances(spark, d), spine(spark, d))


SQL: dict[str, str] = {}
SQL["release_stats"] = f"""WITH {PG}, crew AS (SELECT pg.person, pg.release, act.position, bool_or(pg.v) AS v FROM pg JOIN act ON pg.release = act.release GROUP BY 1, 2, 3),
per AS (SELECT c.release, count(*) AS headcount, count(*) FILTER (pp.b IS NULL) AS newcomers, count(*) FILTER (pp.b < c.position - 1) AS "returning",
 count(*) FILTER (pp.b = c.position - 1) AS continuing, count(*) FILTER (pp.a IS NULL) AS departures, count(*) FILTER (c.v) AS contractors FROM crew c JOIN pp ON c.person = pp.person AND c.position = pp.position GROUP BY 1)
SELECT rel.release, coalesce(headcount, 0) AS headcount, coalesce(newcomers, 0) AS newcomers, coalesce("returning", 0) AS "returning", coalesce(continuing, 0) AS continuing,
 coalesce(departures, 0) AS departures, coalesce(contractors, 0) AS contractors FROM rel LEFT JOIN per ON rel.release = per.release"""


def person_metrics(spark, d):
    return op.person_metrics(appearances(spark, d).withColumn("year", F.col("release")), GAP)


SQL["person_metrics"] = f"""WITH {PG}, y AS (SELECT person, release, release - lag(release) OVER (PARTITION BY person ORDER BY release) AS gap FROM (SELECT DISTINCT person, release FROM pg) x)
SELECT person, min(release) AS first_year, max(release) AS last_year, count(*) AS game_count, max(release) - min(release) AS span_years, coalesce(max(gap), 0) AS largest_gap, coalesce(max(gap), 0) > {GAP} AS uncertain FROM y GROUP BY person"""


def flows(spark, d):
    return op.flows(appearances(spark, d), spine(spark, d))


_GRP = "(SELECT DISTINCT position, grp FROM act)"
SQL["flows"] = f"WITH {PG} SELECT s.grp AS from_grp, t.grp AS to_grp, count(*) AS count FROM pp JOIN {_GRP} s ON pp.position = s.position JOIN {_GRP} t ON pp.a = t.position GROUP BY 1, 2"


def flows_never_backwards(spark, d):
    """Flow edges and the people on them by direction along the spine: all lead forwards."""
    first = releases(spark).groupBy("grp").agg(F.min("sequence").alias("s"))
    f = flows(spark, d).join(first.withColumnRenamed("grp", "from_grp"), "from_grp")
    ahead = f.join(first.select(F.col("grp").alias("to_grp"), F.col("s").alias("t")), "to_grp").withColumn("ahead", F.col("s") < F.col("t"))
    return ahead.groupBy("ahead").agg(F.count("*").alias("edges"), F.sum("count").alias("people"))


SQL["flows_never_backwards"] = f"WITH {PG} SELECT a > position AS ahead, count(DISTINCT (position, a)) AS edges, count(*) AS people FROM pp WHERE a IS NOT NULL GROUP BY 1"


def lineage_all(spark, d):
    return op.lineage(appearances(spark, d), releases(spark).drop("grp"), ERAS)


def lineage_first_party(spark, d):
    return op.lineage(appearances(spark, d).where("first_party"), releases(spark).drop("grp"), ERAS)


def lineage_union(spark, d):
    return lineage_all(spark, d).withColumn("first_party_only", F.lit(False)).unionByName(lineage_first_party(spark, d).withColumn("first_party_only", F.lit(True)))


def _lineage_with(where: str, extra: str = "") -> str:
    """By the first sequence of each person in each era."""
    cols = ", ".join(f"CAST(count(*) FILTER (f{e} < sequence) AS BIGINT) AS \"from_{e}\"" for e in ERAS)
    firsts = ", ".join(f"min(CASE WHEN era = '{e}' THEN sequence END) AS f{e}" for e in ERAS)
    zero = ", ".join(f"coalesce(\"from_{e}\", 0) AS \"from_{e}\"" for e in ERAS)
    return f"""SELECT rel.release, rel.era, coalesce(roster, 0) AS roster, {zero}, coalesce(no_prior, 0) AS no_prior{extra} FROM rel LEFT JOIN (
 SELECT s.release, count(*) AS roster, {cols}, CAST(count(*) FILTER (fall = sequence) AS BIGINT) AS no_prior FROM
 (SELECT DISTINCT pg.person, pg.release, rel.sequence FROM pg JOIN rel ON pg.release = rel.release WHERE {where}) s JOIN
 (SELECT pg.person, {firsts}, min(sequence) AS fall FROM pg JOIN rel ON pg.release = rel.release WHERE {where} GROUP BY 1) f ON s.person = f.person GROUP BY 1) l ON rel.release = l.release"""


SQL["lineage_all"] = f"WITH {PG} " + _lineage_with("true")
SQL["lineage_first_party"] = f"WITH {PG} " + _lineage_with("fp")
SQL["lineage_union"] = f"WITH {PG} " + _lineage_with("true", ", false AS first_party_only") + " UNION ALL " + _lineage_with("fp", ", true AS first_party_only")


def spine_positions(spark, d):
    """The years of all orders as releases; 1998 and 1999 are one group."""
    years = core_orders(spark, d, None).select(F.year("o_orderdate").alias("release")).distinct()
    grp = F.when(F.col("release").isin(1998, 1999), "1998-99").otherwise(F.col("release").cast("string"))
    return op.spine_positions(years.select("release", (F.col("release") - 1900).alias("sequence"), grp.alias("grp"))).select("release", "grp", "position")


SQL["spine_positions"] = "WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS release FROM orders), g AS (SELECT release, CASE WHEN release IN (1998, 1999) THEN '1998-99' ELSE CAST(release AS VARCHAR) END AS grp FROM y) SELECT release, grp, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS position FROM (SELECT release, grp, min(release) OVER (PARTITION BY grp) AS f FROM g) x"


def active_spine(spark, d):
    return spine(spark, d).select("release", "grp", F.coalesce("position", F.lit(-1)).alias("position"))


SQL["active_spine"] = f"WITH {PG} SELECT rel.release, rel.grp, coalesce(act.position, -1) AS position FROM rel LEFT JOIN act ON rel.release = act.release"


def roster_headcount(spark, d):
    return appearances(spark, d).select("person", "release").distinct().groupBy("release").agg(F.count("*").alias("headcount"))


SQL["roster_headcount"] = f"WITH {PG} SELECT release, count(DISTINCT person) AS headcount FROM pg GROUP BY 1"


def longest_gap_holders(spark, d):
    m = person_metrics(spark, d).groupBy("largest_gap").agg(F.count("*").alias("holders"))
    return m.orderBy(F.desc("largest_gap")).limit(1)


SQL["longest_gap_holders"] = f"WITH m AS ({SQL['person_metrics']}) SELECT largest_gap, count(*) AS holders FROM m WHERE largest_gap = (SELECT max(largest_gap) FROM m) GROUP BY 1"


def all_eras_people(spark, d):
    eras = appearances(spark, d).join(releases(spark), "release").select("person", "era").distinct()
    return eras.groupBy("person").agg(F.count("*").alias("n")).where(F.col("n") == len(ERAS)).select("person")


SQL["all_eras_people"] = f"WITH {PG} SELECT person FROM pg JOIN rel ON pg.release = rel.release GROUP BY 1 HAVING count(DISTINCT era) = {len(ERAS)}"


# --- marts ------------------------------------------------------------------


def facts(spark, d):
    """(vendor, release, person): the part brand credited, the order's year and customer."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("vendor"), F.year("o_orderdate").alias("release"), F.col("o_custkey").alias("person"))


_FACTS = "f AS (SELECT p_brand AS vendor, CAST(year(o_orderdate) AS INTEGER) AS release, o_custkey AS person FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def vendor_reach(spark, d):
    return marts.vendor_reach(facts(spark, d))


SQL["vendor_reach"] = f"WITH {_FACTS} SELECT vendor, count(DISTINCT release) AS releases, count(DISTINCT person) AS people FROM f GROUP BY 1"


def top_vendor(spark, d):
    return marts.top(vendor_reach(spark, d), 1, F.desc("people"), "vendor").select("vendor", "people")


SQL["top_vendor"] = f"WITH {_FACTS} SELECT vendor, count(DISTINCT person) AS people FROM f GROUP BY 1 ORDER BY people DESC, vendor LIMIT 1"


def single_release_vendors(spark, d):
    """Companies (a supplier of a part) that are credited in one release only, and their people."""
    li = read(spark, d, "lineitem").select("l_orderkey", F.concat_ws("/", "l_partkey", "l_suppkey").alias("vendor"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    f = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("vendor", F.year("o_orderdate").alias("release"), F.col("o_custkey").alias("person"))
    return marts.vendor_reach(f).where("releases = 1").select("vendor", "people")


SQL["single_release_vendors"] = "SELECT l_partkey || '/' || l_suppkey AS vendor, count(DISTINCT o_custkey) AS people FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 1"


def mode_spelling(spark, d):
    return marts.mode_spelling(read(spark, d, "events"), "user_id", "event_type", "event_id").withColumnRenamed("event_type", "spelling")


SQL["mode_spelling"] = "WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM n) SELECT user_id, event_type AS spelling, n FROM r WHERE k = 1"


def composition_share(spark, d):
    o = read(spark, d, "orders").select(F.year("o_orderdate").alias("release"), "o_orderpriority")
    return marts.composition(o, "release", "o_orderpriority").withColumnRenamed("o_orderpriority", "kind")


SQL["composition_share"] = "WITH n AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS release, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1, 2) SELECT release, kind, n, CAST(round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY release), 0) AS INTEGER) AS pct FROM n"


def columns_of(spark, d):
    """People with the distinct grid columns of their releases (1998 and 1999 share one)."""
    col = F.when(F.col("release") > 1998, F.col("release") - 1996).otherwise(F.col("release") - 1995).cast("int")
    p = appearances(spark, d).select(F.format_string("c%07d", "person").alias("name"), col.alias("col")).distinct()
    return p.groupBy("name").agg(F.array_sort(F.collect_list("col")).alias("cols"))


_COLS = "cp AS (SELECT DISTINCT printf('c%07d', o_custkey) AS name, CAST(CASE WHEN year(o_orderdate) > 1998 THEN year(o_orderdate) - 1996 ELSE year(o_orderdate) - 1995 END AS INTEGER) AS col FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT name, list(col ORDER BY col) AS cols, min(col) AS a, max(col) AS z, count(*) AS n FROM cp GROUP BY 1)"


def overflow_bins(spark, d):
    """People of one column in lines of twelve, column by column."""
    single = columns_of(spark, d).where("size(cols) = 1").select("name", F.get("cols", F.lit(0)).alias("col"))
    return layout.bins(single, 12, "col", "name")


SQL["overflow_bins"] = f"WITH {_COLS}, s AS (SELECT name, a AS col, row_number() OVER (PARTITION BY a ORDER BY name) - 1 AS k FROM c WHERE n = 1) SELECT name, col, CAST(k // 12 AS INTEGER) AS line, CAST(k % 12 AS INTEGER) AS place FROM s"


REPRINTS = [(0, 2), (0, 3), (1, 3), (2, 5), (4, 5)]


def reprint_columns(spark, d):
    again = spark.createDataFrame(REPRINTS, "col int, again int")
    out = layout.reprint_columns(columns_of(spark, d), again)
    text = lambda c: F.concat_ws("|", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return out.select("name", text("cols"), text("reprints"))


SQL["reprint_columns"] = f"""WITH {_COLS}, rp(col, again) AS (VALUES {", ".join(map(str, REPRINTS))}),
x AS (SELECT DISTINCT cp.name, rp.again FROM cp JOIN rp ON cp.col = rp.col WHERE NOT EXISTS (SELECT 1 FROM cp o WHERE o.name = cp.name AND o.col = rp.again))
SELECT c.name, array_to_string(c.cols, '|') AS cols, coalesce((SELECT string_agg(CAST(again AS VARCHAR), '|' ORDER BY again) FROM x WHERE x.name = c.name), '') AS reprints FROM c"""

QUERIES = {name: globals()[name] for name in SQL}
