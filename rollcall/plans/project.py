"""Readers, sinks and the command line over a project folder that Spark makes of the customer table.

Releases are r0 to r4; a customer is credited in the release that the nation's number
gives and, one in three, in a second one. Pages hold at most 500 customers. The
folder is in the session's shared folder.
"""

from __future__ import annotations

import json
from pathlib import Path
from uuid import uuid4

from pyspark.sql import functions as F

from ..cli import Project
from ..operators.ordered import numbered
from ..shared import folder
from ..sources import documents as io
from .continuity import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


PAGE = 500
ERAS = {"r0": "A", "r1": "A", "r2": "B", "r3": "B", "r4": "C"}


def project(spark, d) -> Project:
    root = folder(spark).removeprefix("file://").removeprefix("file:") + f"/project_{uuid4().hex}"
    put = lambda df, name: df.coalesce(1).write.csv(f"{root}/config/{name}.csv", header=True, quote='"', escape='"', emptyValue="")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("Ann K"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("name"))
    k, g = F.col("c_custkey"), F.col("c_nationkey") % 5
    seen = c.withColumn("g", F.explode(F.array_distinct(F.when(k % 3 == 0, F.array(g, (F.col("c_nationkey") + 2) % 5)).otherwise(F.array(g)))))
    line = F.concat(F.lit("* "), "name", F.when(k % 4 == 0, " (VOLT)").otherwise(""), F.lit("\n"))
    game, page = F.concat(F.lit("r"), F.col("g").cast("string")), F.floor(k / PAGE).cast("string")
    pages = seen.groupBy(game.alias("game_id"), page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "").alias("body"))
    pages = pages.select("game_id", F.concat(F.lit("raw/wikitext/"), "game_id", F.lit("-"), "page", F.lit(".txt")).alias("raw_path"), F.concat(F.lit("===Engineers===\n"), "body", F.lit("* nobody\n")).alias("text"))
    io.land(pages, f"{root}/landed")
    put(pages.select("game_id", F.lit("wikitext").alias("parser"), F.lit("").alias("url"), "raw_path", F.lit('{"inline_vendor": true}').alias("options")), "sources")
    put(spark.createDataFrame([(f"r{i}", f"Part {i}, the \"first\"", 2001 + 6 * i, i + 1, "mainline") for i in range(5)], io.TABLES["games"]), "games")
    put(spark.createDataFrame([("(?i)engineer", "Engineering", "")], io.TABLES["rules"]), "categories")
    put(c.where("c_custkey % 10 = 1").select(F.col("name").alias("name_variant"), F.concat(F.lit("p-"), k.cast("string")).alias("person_id")), "aliases")
    put(c.where("c_custkey % 20 = 2").select(F.lower(F.replace("name", F.lit(" "), F.lit("-"))).alias("person_id"), F.lit(" Same").alias("ruling")), "reviews")
    put(c.where("c_custkey % 50 = 7").select(F.col("name").alias("name_raw"), F.lit("discard").alias("action"), F.lit("").alias("names"), F.lit("").alias("studio")), "name_fixes")
    put(spark.createDataFrame([("Maker", "first-party")], io.TABLES["studio_classes"]), "studio_classes")
    spark.createDataFrame([("# not people",), ("^nobody$",)], "value string").coalesce(1).write.text(f"{root}/config/not-people.txt")
    Path(root, "config", "plan.json").write_text(json.dumps({"eras": ERAS}), encoding="utf-8")
    return Project(spark, root)


_AP = f"""ap AS (SELECT c_custkey AS c, c_nationkey % 5 AS g FROM customer UNION SELECT c_custkey, (c_nationkey + 2) % 5 FROM customer WHERE c_custkey % 3 = 0),
live AS (SELECT *, 'Ann K' || lpad(CAST(c AS VARCHAR), 7, '0') AS name, CASE WHEN c % 10 = 1 THEN 'p-' || c ELSE 'ann-k' || lpad(CAST(c AS VARCHAR), 7, '0') END AS id, lag(g) OVER w AS b, lead(g) OVER w AS a FROM ap WHERE c % 50 <> 7 WINDOW w AS (PARTITION BY c ORDER BY g)),
pages AS (SELECT g, count(DISTINCT c // {PAGE}) AS n FROM ap GROUP BY 1)"""


@query(f"""WITH {_AP} SELECT id AS person_id, name AS display_name, name AS variants, string_agg('r' || g, '|' ORDER BY g) AS games, 'r' || min(g) AS first_game, 'r' || max(g) AS last_game,
CAST(count(*) AS INTEGER) AS game_count, CAST(6 * (max(g) - min(g)) AS INTEGER) AS span_years, CAST(coalesce(max(6 * (g - b)), 0) AS INTEGER) AS largest_gap_years, coalesce(max(6 * (g - b)), 0) > 10 AND c % 20 <> 2 AS uncertain FROM live GROUP BY c, id, name""")
def project_people(spark, d):
    """Pages read, parsed, corrected and resolved by the command line's stages; the person file read back."""
    p = project(spark, d)
    p.parse(0.05)
    p.people()
    return io.read_csv(spark, f"{p.out}/people", "person_id string, display_name string, variants string, first_game string, last_game string, game_count int, games string, span_years int, largest_gap_years int, uncertain boolean")


def _said(*cols: str) -> str:
    return "concat_ws('|', " + ", ".join(cols) + ")"


@query(f"""WITH {_AP}, er(g, era) AS (VALUES {", ".join(f"({k[1]}, '{e}')" for k, e in ERAS.items())}),
fi AS (SELECT c, {", ".join(f"min(CASE WHEN era = '{e}' THEN live.g END) AS f{e}" for e in "ABC")} FROM live JOIN er ON live.g = er.g GROUP BY 1)
SELECT 'per_game' AS mart, 'r' || g AS k, {_said("2001 + 6 * g", "g + 1", "count(*)", "count(*) FILTER (b IS NULL)", "count(*) FILTER (b < g - 1)", "count(*) FILTER (b = g - 1)", "count(*) FILTER (a IS NULL)", "count(*) FILTER (c % 4 = 0)")} AS v FROM live GROUP BY g
UNION ALL SELECT 'flows', 'r' || g || '>r' || a, {_said("count(*)")} FROM live WHERE a IS NOT NULL GROUP BY g, a
UNION ALL SELECT 'lineage', 'r' || live.g, {_said("era", "count(*)", *(f"count(*) FILTER (f{e} < live.g)" for e in "ABC"), "count(*) FILTER (b IS NULL)")} FROM live JOIN er ON live.g = er.g JOIN fi ON live.c = fi.c GROUP BY live.g, era
UNION ALL SELECT 'report', 'r' || ap.g, {_said("count(*) FILTER (c % 50 <> 7)", "count(*) FILTER (c % 50 = 7) + any_value(pages.n)", "0", "'false'")} FROM ap JOIN pages ON ap.g = pages.g GROUP BY ap.g
UNION ALL SELECT 'headings', 'r' || ap.g || ' Engineers', {_said("count(*) + 2 * any_value(pages.n)")} FROM ap JOIN pages ON ap.g = pages.g GROUP BY ap.g
UNION ALL SELECT 'roles', 'r' || g || ' engineering', {_said("count(*)")} FROM live GROUP BY g
UNION ALL SELECT 'dropped', 'r' || ap.g || ' ruled-not-a-person', {_said("count(*)")} FROM ap WHERE c % 50 = 7 GROUP BY 2 UNION ALL SELECT 'dropped', 'r' || g || ' non-person', {_said("n")} FROM pages""")
def project_marts(spark, d):
    """Every file that the stages write, read back: report, logs, indexes, roles, measures by release, flows, lineage of all staff."""
    p = project(spark, d)
    p.parse(0.05)
    p.indexes()
    p.roles()
    p.stats()
    text = lambda *cols: F.concat_ws("|", *(F.col(c).cast("string") for c in cols)).alias("v")
    mart = lambda name, schema: io.read_csv(spark, f"{p.out}/{name}", schema)
    counts = ["headcount", "newcomers", "returning", "continuing_from_previous", "departures", "contractors"]
    eras = ["from_A", "from_B", "from_C"]
    parts = [
        mart("per_game", "game_id string, year int, sequence int, " + ", ".join(f"{c} long" for c in counts)).select(F.lit("per_game").alias("mart"), F.col("game_id").alias("k"), text("year", "sequence", *counts)),
        mart("flows", "from_grp string, to_grp string, count long").select(F.lit("flows"), F.concat("from_grp", F.lit(">"), "to_grp"), text("count")),
        mart("lineage", "release string, era string, roster long, " + ", ".join(f"{c} long" for c in eras) + ", no_prior long, first_party_only boolean").where("not first_party_only").select(F.lit("lineage"), "release", text("era", "roster", *eras, "no_prior")),
        mart("report", "game_id string, rows long, dropped long, unparsed long, failed boolean").select(F.lit("report"), "game_id", text("rows", "dropped", "unparsed", "failed")),
        mart("indexes/headings", io.TABLES["headings"]).groupBy(F.concat_ws(" ", "game_id", "heading").alias("k")).count().select(F.lit("headings"), "k", text("count")),
        mart("roles", "name string, game_id string, cls string, prov string").groupBy(F.concat_ws(" ", "game_id", "cls").alias("k")).count().select(F.lit("roles"), "k", text("count")),
        spark.read.csv(f"{p.out}/audit/dropped", sep="\t", header=True, schema="line string, reason string, game_id string").groupBy(F.concat_ws(" ", "game_id", "reason").alias("k")).count().select(F.lit("dropped"), "k", text("count")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(f"""WITH {_AP} SELECT game_id, sum(r) AS rows, sum(x) AS dropped, CAST(0 AS BIGINT) AS unparsed, sum(f) AS name_changed FROM (
SELECT 'r' || g AS game_id, CAST(count(*) FILTER (c % 50 <> 7) AS BIGINT) AS r, CAST(count(*) FILTER (c % 50 = 7) AS BIGINT) AS x, CAST(0 AS BIGINT) AS f FROM ap GROUP BY 1 UNION ALL SELECT 'r' || g, 0, CAST(n AS BIGINT), 0 FROM pages GROUP BY 1, n) q GROUP BY 1
UNION ALL SELECT 'observed', (SELECT count(*) FROM ap WHERE c % 50 <> 7), (SELECT count(*) FROM ap WHERE c % 50 = 7) + (SELECT CAST(sum(n) AS BIGINT) FROM pages), 0, 0""".replace("sum(r)", "CAST(sum(r) AS BIGINT)").replace("sum(x)", "CAST(sum(x) AS BIGINT)").replace("sum(f)", "CAST(sum(f) AS BIGINT)"))
def parse_observed(spark, d):
    """What one pass over the pages counted while it wrote them, beside the counts of what it wrote."""
    from . import careers

    p = project(spark, d)
    tagged = careers.parse_changes(p.docs(), p.rules(), careers.Corrections(p.table("name_fixes")))
    seen = io.write_parse(tagged, f"{p.out}/parsed")
    names = ["rows", "dropped", "unparsed", "name_changed"]
    total = spark.createDataFrame([("observed", *(seen[n] for n in names))], "game_id string, " + ", ".join(f"{n} long" for n in names))
    n = lambda k: F.count_if(F.col("kind") == k)
    written = spark.read.schema(tagged.schema).parquet(f"{p.out}/parsed")
    return written.groupBy("game_id").agg(n("row").alias("rows"), n("dropped").alias("dropped"), n("unparsed").alias("unparsed"), F.count_if("name_changed").alias("name_changed")).unionByName(total)


def order_lines(spark, d):
    """Credits made of order lines, numbered within their release in the order of orders, lines and parts."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("game_id"))
    n = F.col("l_linenumber")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cls = F.when(n == 7, "special-thanks").when(n == 6, "publishing").otherwise("core")
    blank = {c: F.lit("") for c in ("name_canonical", "category", "character", "studio", "source_ref")}
    rows = j.withColumns({"name_raw": F.concat(F.lit("Cust "), F.col("o_custkey").cast("string")), "inclusion_class": cls, "role_raw": F.col("l_partkey").cast("string"), **blank})
    return numbered(rows, "credit_order", ["l_orderkey", "l_linenumber", "l_partkey"], ["game_id"]).withColumn("credit_order", F.col("credit_order").cast("int"))


_LI = """j AS (SELECT 'y' || year(o_orderdate) AS game_id, 'Cust ' || o_custkey AS name, l_linenumber AS n, l_partkey AS part, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS credit_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_LI} SELECT game_id, count(*) AS rows, min_by(name, credit_order) AS first_name, max_by(name, credit_order) AS last_name, CAST(sum(credit_order) AS BIGINT) AS orders, count(DISTINCT name) AS names,
CAST(sum(CASE WHEN game_id = 'y1997' THEN 0 ELSE part END) AS BIGINT) AS roles FROM j WHERE n < 6 AND game_id <> 'y1996' GROUP BY 1""")
def fact_layout(spark, d):
    """Facts by class and release, one release written anew, core rows of all releases but one read in their order."""
    at = f"{folder(spark)}/facts_{uuid4().hex}"
    rows = order_lines(spark, d)
    io.write_facts(rows, at)
    io.write_facts(rows.where("game_id = 'y1997'").withColumn("role_raw", F.lit("0")), at)
    core = io.read_facts(spark, at, ["core"], [f"y{y}" for y in range(1992, 2003) if y != 1996])
    return core.groupBy("game_id").agg(
        F.count("*").alias("rows"), F.min_by("name_raw", "ord").alias("first_name"), F.max_by("name_raw", "ord").alias("last_name"), F.sum("credit_order").alias("orders"),
        F.count_distinct("name_raw").alias("names"), F.sum(F.col("role_raw").cast("long")).alias("roles"),
    )


@query(f"WITH {_LI} SELECT game_id, CAST(credit_order AS INTEGER) AS credit_order, name AS name_raw, CAST(part AS VARCHAR) AS role_raw FROM j WHERE n = 6")
def credits_by_release(spark, d):
    """Credits written as one CSV folder a release; the publisher's rows read back by the reader's filter."""
    at = f"{folder(spark)}/credits_{uuid4().hex}"
    io.write_credits(order_lines(spark, d), at)
    rows = io.read_csv(spark, at, io.CREDITS.replace("game_id string, ", "") + ", game_id string")
    return rows.where("inclusion_class = 'publishing'").select("game_id", "credit_order", "name_raw", "role_raw")


@query("""SELECT page_id, '/s/credits-' || page_id || '.js' AS address, html AS page, '"x' || page_id || '"' AS script, '== ' || url || ' ==' AS markup FROM pages""")
def frozen_artefacts(spark, d):
    """A page's script found, page and script joined and parted again, and the markup inside a wiki's answer."""
    p = read(spark, d, "pages").select("page_id", "html", F.coalesce("url", F.lit("")).alias("url"))
    page = F.concat(F.lit('<script src="/s/credits-'), F.col("page_id").cast("string"), F.lit('.js"></script>'), "html")
    p = p.withColumn("address", io.script_address(page, r'src="(/s/credits-[^"]+\.js)"'))
    p = p.withColumn("both", io.two_parts(F.col("html"), F.concat(F.lit('"x'), F.col("page_id").cast("string"), F.lit('"'))))
    p = p.withColumn("payload", F.to_json(F.struct(F.struct(F.concat(F.lit("== "), "url", F.lit(" ==")).alias("wikitext")).alias("parse"))))
    one, two = io.parts_of(F.col("both"))
    return p.select("page_id", "address", one.alias("page"), two.alias("script"), io.wikitext_of("payload").alias("markup"))


@query(r"""WITH j AS (SELECT page_id, json_object('props', json_object('pageProps', json_array(json_object('credits', json_object('page-title', coalesce(url, ''), 'deep', json_object('b', CAST(page_id AS VARCHAR), 'credits', json_object('again', 'x "y"')), 'list', json_array('x'), 'n', page_id)), json_object('credits', 's')))) AS js FROM pages),
t AS (SELECT page_id, replace(e.fullkey, '"', '') AS k, e.atom->>'$' AS message FROM j, json_tree(j.js) e WHERE e.type = 'VARCHAR')
SELECT page_id, 'credits' || regexp_extract(k, '^.*?\.credits(\..*)$', 1) AS path, message FROM t WHERE regexp_matches(k, '\.credits\.') AND NOT regexp_matches(k, '\.credits.*\[')""")
def page_messages(spark, d):
    """Texts in the data of each page, nested to any depth."""
    p = read(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    k = F.col("page_id").cast("string").alias("b")
    deep = F.struct(k, F.struct(F.lit('x "y"').alias("again")).alias("credits"))
    say = F.struct(F.col("url").alias("page-title"), deep.alias("deep"), F.array(F.lit("x")).alias("list"), F.col("page_id").alias("n"))
    body = F.concat(F.lit('{"props": {"pageProps": ['), F.to_json(F.struct(say.alias("credits"))), F.lit(', {"credits": "s"}]}}'))
    text = F.concat(F.lit('<p>a</p><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script><script>x</script>"))
    return io.message_rows(p.select("page_id", text.alias("text")), "page_id", "text")


@query("""SELECT event_id, 'k' AS option, 'BIGINT' AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, x.o, x.k, x.v FROM events, (VALUES ('name_style', 'STRING', '"plain"'), ('sections', 'ARRAY', '["a","b"]'), ('on', 'BOOLEAN', 'true')) x(o, k, v) WHERE event_id % 3 = 1""")
def source_options(spark, d):
    """Options of sources as they come: numbers, texts, lists, flags; none where the text is blank."""
    more = F.lit(',"name_style":"plain","sections":["a","b"],"on":true}')
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, F.concat(F.regexp_replace("props", r"\}\s*$", ""), more)).otherwise(F.col("props")).alias("options"))
    return io.option_rows(e, "event_id")
