"""Names, rules, corrections and context over the star schema and the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, corrections, identity, layout, roles, rules
from ..streaming import events as streams
from .continuity import read

SQL: dict[str, str] = {}
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- spellings and people -----------------------------------------------------


@query
def normalised_keys(spark, d):
    """The spelling key of each line of each document; a null text is one empty line."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    keys = lines.select("line").distinct().withColumn("key", T.normalise_name("line"))
    return lines.join(keys, "line").select("doc_id", "line_no", "key")


SQL["normalised_keys"] = r"WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), e AS (SELECT doc_id, CAST(unnest(range(0, len(x))) AS INTEGER) AS line_no, unnest(x) AS line FROM l) SELECT doc_id, line_no, trim(regexp_replace(lower(regexp_replace(strip_accents(line), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+', ' ', 'g')) AS key FROM e"


@query
def slug(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" O'Neil-Ray (Jr.)")).alias("name"))
    return c.select("c_custkey", T.slug(T.normalise_name("name")).alias("slug"))


SQL["slug"] = r"SELECT c_custkey, regexp_replace(regexp_replace(lower(regexp_replace(c_name || ' O''Neil-Ray (Jr.)', '[^\p{L}\p{N}_ ]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer"


def spellings(spark, d):
    """Credits made of suppliers: three releases, with spellings that vary by release."""
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("n"))
    # all of the releases, or all but the one that their number says
    own = F.filter(F.array(*(F.lit(x) for x in ("r1", "r2", "r3"))), lambda g: ((F.col("s_suppkey") + F.ascii(F.substring(g, 2, 1))) % 3 != 0) | (F.col("s_suppkey") % 4 == 0))
    rel = F.explode(own)
    s = s.select("*", rel.alias("game_id"))
    raw = F.when((F.col("game_id") == "r2") & (F.col("s_suppkey") % 5 == 0), F.upper("n")).when((F.col("game_id") == "r3") & (F.col("s_suppkey") % 7 == 0), F.concat("n", F.lit(" Sr."))).otherwise(F.col("n"))
    canonical = F.when((F.col("game_id") == "r3") & (F.col("s_suppkey") % 7 == 0) & (F.col("s_suppkey") % 2 == 0), F.col("n")).otherwise("")
    return s.select("s_suppkey", "game_id", raw.alias("name_raw"), canonical.alias("name_canonical"), F.struct(F.concat("game_id", F.lit(".csv")).alias("f"), F.col("s_suppkey").alias("i")).alias("ord"))


def people(spark, d):
    credits = spellings(spark, d)
    games = spark.createDataFrame([("r1", 1, 2001), ("r2", 2, 2004), ("r3", 3, 2020)], "game_id string, sequence int, year int")
    alias = credits.where("name_raw like '% Sr.' and name_canonical = ''").select(F.col("name_raw").alias("name_variant"), F.concat(F.lit("sr-"), F.col("s_suppkey").cast("string")).alias("person_id")).distinct()
    split = read(spark, d, "supplier").where("s_suppkey % 8 = 0").select(T.slug(T.normalise_name("s_name")).alias("person_id"), F.lit(" Split").alias("ruling"))
    same = read(spark, d, "supplier").where("s_suppkey % 8 = 4").select(T.slug(T.normalise_name("s_name")).alias("person_id"), F.lit("same").alias("ruling"))
    return identity.resolve(credits, games, alias, split.union(same))


@query
def resolved_people(spark, d):
    """The whole person table: canonical spellings, aliases, rulings, measures."""
    p = people(spark, d)[0]
    return p.select("person_id", "display_name", F.concat_ws("|", "variants").alias("variants"), F.concat_ws("|", "games").alias("games"), "first_game", "last_game", "game_count", "span_years", "largest_gap_years", "uncertain")


_NORM = r"trim(regexp_replace(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_ ]', '', 'g')), '\s+', ' ', 'g'))"
_SLUG = r"regexp_replace(regexp_replace({}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
CREDITS = f"""rel(game_id, sequence, year) AS (VALUES ('r1', 1, 2001), ('r2', 2, 2004), ('r3', 3, 2020)),
cr AS (SELECT s_suppkey, game_id, sequence, year, s_name,
 CASE WHEN game_id = 'r2' AND s_suppkey % 5 = 0 THEN upper(s_name) WHEN game_id = 'r3' AND s_suppkey % 7 = 0 THEN s_name || ' Sr.' ELSE s_name END AS raw,
 CASE WHEN game_id = 'r3' AND s_suppkey % 7 = 0 AND s_suppkey % 2 = 0 THEN s_name ELSE '' END AS can
 FROM supplier, rel WHERE (s_suppkey + ascii(game_id[2:2])) % 3 <> 0 OR s_suppkey % 4 = 0),
ke AS (SELECT *, CASE WHEN raw LIKE '% Sr.' AND can = '' THEN 'sr-' || s_suppkey ELSE {_SLUG.format(_NORM.format("CASE WHEN can <> '' THEN can ELSE raw END"))} END AS pid,
 {_NORM.format("CASE WHEN can <> '' THEN can ELSE raw END")} AS nk FROM cr),
sp AS (SELECT *, s_suppkey % 8 = 0 AND pid NOT LIKE 'sr-%' AS is_split FROM ke),
fa AS (SELECT *, CASE WHEN is_split THEN {_SLUG.format("nk || game_id")} ELSE pid END AS person_id FROM sp)"""
SQL["resolved_people"] = f"""WITH {CREDITS},
va AS (SELECT person_id, raw, min(game_id) AS g FROM fa GROUP BY 1, 2),
gp AS (SELECT DISTINCT person_id, game_id, sequence, year FROM fa),
ga AS (SELECT *, year - lag(year) OVER (PARTITION BY person_id ORDER BY sequence) AS gap FROM gp),
di AS (SELECT person_id, coalesce(max(CASE WHEN NOT is_split AND can <> '' THEN can END), min_by(raw, game_id)) AS display_name, bool_or(s_suppkey % 8 = 4 AND person_id NOT LIKE 'sr-%') AS same FROM fa GROUP BY 1)
SELECT di.person_id, di.display_name, (SELECT string_agg(raw, '|' ORDER BY g) FROM va WHERE va.person_id = di.person_id) AS variants,
 string_agg(game_id, '|' ORDER BY sequence) AS games, min_by(game_id, sequence) AS first_game, max_by(game_id, sequence) AS last_game,
 CAST(count(*) AS INTEGER) AS game_count, CAST(max(year) - min(year) AS INTEGER) AS span_years, CAST(coalesce(max(gap), 0) AS INTEGER) AS largest_gap_years, coalesce(max(gap), 0) > 10 AND NOT di.same AS uncertain
 FROM di JOIN ga ON di.person_id = ga.person_id GROUP BY di.person_id, di.display_name, di.same"""


@query
def person_facts(spark, d):
    return people(spark, d)[1]


SQL["person_facts"] = f"WITH {CREDITS} SELECT DISTINCT person_id, game_id, raw AS variant FROM fa"


@query
def whole_word_attribution(spark, d):
    """Part names found whole inside other parts' compound credits, by the resolver's own join."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("person_id"), "p_name", "p_type")
    own = p.select("person_id", F.lit("g").alias("game_id"), F.when(F.col("person_id") % 4 == 0, F.concat("p_name", F.lit(" and "), "p_type")).otherwise(F.col("p_name")).alias("variant"), F.col("person_id").alias("ord"))
    shown = own.select("person_id", F.col("variant").alias("display_name"), F.lit(False).alias("is_split"))
    return identity.compound_facts(own, shown).groupBy("person_id").agg(F.count_distinct("variant").alias("texts"))


SQL["whole_word_attribution"] = r"WITH n AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' and ' || p_type ELSE p_name END AS v FROM part) SELECT a.id AS person_id, count(DISTINCT b.v) AS texts FROM n a JOIN n b ON a.id <> b.id AND lower(b.v) LIKE '% and %' AND lower(a.v) NOT LIKE '% and %' AND contains(b.v, a.v) AND regexp_matches(b.v, '\b' || a.v || '\b') GROUP BY 1"


@query
def phantom_anti_join(spark, d):
    """Parts as people, their types as further spellings: compound names that others own too are phantoms."""
    p = read(spark, d, "part")
    a = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" and "), (F.col("p_partkey") % 40).cast("string"))).otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string"))))
    own = p.select(F.col("p_partkey").cast("string").alias("person_id"), a.alias("display_name"), F.array(a, F.lit("x")).alias("variants"))
    return identity.real_people(own).select("person_id", "display_name")


SQL["phantom_anti_join"] = "WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS person_id, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' and ' || (p_partkey % 40) ELSE ' ' || p_partkey END AS display_name FROM part) SELECT person_id, display_name FROM a WHERE NOT (lower(display_name) LIKE '% and %' AND (SELECT count(*) FROM a b WHERE b.display_name = a.display_name) > 1)"


@query
def marked_dedup(spark, d):
    """Customers and suppliers with one key number are one person: longest spelling, all columns, any flag."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("ident"), F.col("c_name").alias("name"), F.array(F.pmod("c_nationkey", F.lit(12))).alias("cols"), (F.col("c_acctbal") < 0).alias("flag"), F.lit(0).alias("ord"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("ident"), F.col("s_name").alias("name"), F.array(F.pmod("s_nationkey", F.lit(12))).alias("cols"), (F.col("s_acctbal") < 0).alias("flag"), F.lit(1).alias("ord"))
    out = layout.dedup_people(c.unionByName(s), "ident", "ord")
    return out.select("ident", "name", F.concat_ws("|", F.transform("cols", lambda x: x.cast("string"))).alias("cols"), "flag")


SQL["marked_dedup"] = """WITH u AS (SELECT c_custkey AS ident, c_name AS name, c_nationkey % 12 AS col, c_acctbal < 0 AS flag, 0 AS o FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey % 12, s_acctbal < 0, 1 FROM supplier),
n AS (SELECT ident, name, row_number() OVER (PARTITION BY ident ORDER BY length(name) DESC, o) AS k FROM u),
c AS (SELECT ident, string_agg(CAST(col AS VARCHAR), '|' ORDER BY col) AS cols FROM (SELECT DISTINCT ident, col FROM u) x GROUP BY 1), f AS (SELECT ident, bool_or(flag) AS flag FROM u GROUP BY 1)
SELECT n.ident, n.name, c.cols, f.flag FROM n JOIN c ON n.ident = c.ident JOIN f ON n.ident = f.ident WHERE k = 1"""


# --- rules ----------------------------------------------------------------------

RULES = [(r"(?i)\b(polished|brushed)\b", "Art"), (r"(?i)(copper|brass)", "Audio"), (r"(?i)\b(small|medium)", "Design"), (r"(?i)(plated|anodized|promo)", "Production")]


def _case(t: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{c}'" for p, c in RULES) + " ELSE 'Other' END"


def part_text():
    return F.concat_ws(" ", "p_type", "p_name", "p_brand")


_PART = "p_type || ' ' || p_name || ' ' || p_brand"


@query
def first_match_category(spark, d):
    return read(spark, d, "part").select("p_partkey", rules.first_match(part_text(), RULES).alias("category"))


SQL["first_match_category"] = f"SELECT p_partkey, {_case(_PART)} AS category FROM part"


@query
def rule_table(spark, d):
    """The same answer from rules that live in a table."""
    table = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(RULES)], "priority int, pattern string, label string")
    p = read(spark, d, "part").select("p_partkey", part_text().alias("text"))
    return rules.first_match_table(p, "text", table).select("p_partkey", F.col("label").alias("category"))


SQL["rule_table"] = SQL["first_match_category"]

DENY = [r"(?i)^all rights", r"(?i)https?://", r"^\(.*\)$", r"(?i)\bcopyright\b", r"@", r"^-{3,}$"]


def audited(spark, d):
    """Each line of each document is a row or dropped with its reason."""
    docs = read(spark, d, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line"))
    return rules.split_audit(lines, rules.any_match(F.col("line"), DENY), "non-person")


_LINES = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM documents), a AS (SELECT doc_id, source, trim(raw) AS line, " + " OR ".join(["trim(raw) = ''", *(f"regexp_matches(trim(raw), '{p}')" for p in DENY)]) + " AS bad FROM l)"


@query
def denylist_split(spark, d):
    return audited(spark, d).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


SQL["denylist_split"] = f"WITH {_LINES} SELECT doc_id, CASE WHEN bad THEN 'dropped' ELSE 'row' END AS kind, count(*) AS n FROM a GROUP BY 1, 2"


@query
def audit_log(spark, d):
    return audited(spark, d).where("kind = 'dropped'").select("doc_id", "line_no", "line", "reason")


SQL["audit_log"] = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS line_no, trim(raw) AS line, 'non-person' AS reason FROM l WHERE trim(raw) = '' OR " + " OR ".join(f"regexp_matches(trim(raw), '{p}')" for p in DENY)


@query
def parse_report_gate(spark, d):
    a = audited(spark, d).withColumn("kind", F.when(F.length("line") > 2500, "unparsed").otherwise(F.col("kind")))
    return corrections.parse_report(a, "source", 0.02)


SQL["parse_report_gate"] = f"WITH {_LINES}, c AS (SELECT source, count(*) FILTER (NOT bad AND length(line) <= 2500) AS rows, count(*) FILTER (bad AND length(line) <= 2500) AS dropped, count(*) FILTER (length(line) > 2500) AS unparsed FROM a GROUP BY 1) SELECT source, rows, dropped, unparsed, CASE WHEN rows = 0 THEN true ELSE unparsed::DOUBLE / (rows + unparsed) > 0.02 END AS failed FROM c"

HEADINGS = [(r"(?i)\bsteel\b", "engineering"), (r"(?i)\b(tin|nickel)", "qa"), (r"(?i)brand#[1-3]", "live")]


def classified(spark, d):
    """Each order line as a credit: the part says category, text and employer, the line its standing. Texts are read once a part."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    p = read(spark, d, "part").select("p_partkey", part_text().alias("t"), "p_brand", "p_size")
    said = roles.text_code(
        HEADINGS, RULES,
        category=F.when(F.col("p_size") > 20, rules.first_match(F.col("t"), RULES)).otherwise(F.lit("")),
        role_raw=F.when(F.col("p_size") % 2 == 0, F.col("t")).otherwise(F.lit("")),
        heading=F.col("p_brand"),
        vendor_type=F.when(F.col("p_size") < 5, "testing").otherwise("development"),
    )
    j = li.join(p.select("p_partkey", said.alias("said")), F.col("l_partkey") == F.col("p_partkey"))
    standing = F.when(F.col("l_linenumber") == 7, "babies").when(F.col("l_returnflag") == "R", "publishing").otherwise("core")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.year("l_shipdate").alias("y"), roles.standing_code(F.col("said"), standing).alias("code"))


def _head(t: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{c}'" for p, c in HEADINGS) + " END"


_CLASS = " ".join(f"WHEN cat = '{k}' THEN '{v}'" for k, v in roles.CATEGORY_CLASS.items())
_CL = f"""j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS y, {_PART} AS t, p_brand, p_size, CASE WHEN p_size > 20 THEN {_case(_PART)} ELSE '' END AS cat FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 'thanks' END AS s1, CASE {_CLASS} END AS s2, CASE WHEN p_size % 2 = 0 THEN {_head("t")} END AS s3, {_head("p_brand")} AS s4, CASE WHEN p_size < 5 THEN 'qa' END AS s5, CASE WHEN l_returnflag = 'R' THEN 'publishing' END AS s6 FROM j),
cl AS (SELECT *, coalesce(s1, s2, s3, s4, s5, s6, 'unspecified') AS cls, CASE WHEN coalesce(s1, s2, s3) IS NULL AND coalesce(s4, s5) IS NOT NULL THEN 'inferred' ELSE 'stated' END AS prov FROM s)"""


@query
def role_cascade_provenance(spark, d):
    n = classified(spark, d).groupBy("code").agg(F.count("*").alias("n"))
    return n.select(roles.decoded(F.col("code")).alias("c"), "n").select("c.cls", "c.prov", "n")


SQL["role_cascade_provenance"] = f"WITH {_CL} SELECT cls, prov, count(*) AS n FROM cl GROUP BY 1, 2"


@query
def role_votes(spark, d):
    return roles.code_votes(classified(spark, d).select("l_orderkey", "code"), ["l_orderkey"])


_RANK = "list_position([" + ", ".join(f"'{c}'" for c in roles.PRIORITY) + "], cls)"
SQL["role_votes"] = f"WITH {_CL}, v AS (SELECT l_orderkey, cls, bool_or(prov = 'stated') AS st FROM cl GROUP BY 1, 2) SELECT l_orderkey, min_by(cls, {_RANK}) AS cls, CASE WHEN min_by(st, {_RANK}) THEN 'stated' ELSE 'inferred' END AS prov FROM v GROUP BY 1"


@query
def column_fold(spark, d):
    per = classified(spark, d).select("l_partkey", "y", roles.decoded(F.col("code"))["cls"].alias("cls"))
    cols = spark.createDataFrame([(y, (y - 1995) // 3) for y in range(1995, 2003)], "y int, col int")
    return roles.column_fold(per, cols, "l_partkey", "y")


SQL["column_fold"] = f"WITH {_CL} SELECT l_partkey, CAST((y - 1995) // 3 AS INTEGER) AS col, min_by(cls, {_RANK}) AS cls FROM cl WHERE y BETWEEN 1995 AND 2002 GROUP BY 1, 2"


@query
def vendor_tag_split(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("  ( "), "p_brand", F.lit(" )")).alias("t"))
    name, tag = T.split_vendor_tag(F.col("t"), "any-parenthetical")
    return p.select("p_partkey", name.alias("name"), tag.alias("vendor"))


SQL["vendor_tag_split"] = r"WITH p AS (SELECT p_partkey, p_name || '  ( ' || p_brand || ' )' AS t FROM part) SELECT p_partkey, regexp_replace(t, '\s*\(\s*([^()]{1,60}?)\s*\)\s*$', '') AS name, regexp_extract(t, '\s*\(\s*([^()]{1,60}?)\s*\)\s*$', 1) AS vendor FROM p"


def companies(spark, d):
    s = read(spark, d, "supplier")
    tail = F.element_at(F.array(*map(F.lit, [", Inc.", " Co., Ltd.", "", " GmbH", " Corp, llc"])), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return s.select("s_suppkey", F.concat(F.lit(" "), "s_name", tail).alias("studio"))


_COMP = "c AS (SELECT s_suppkey, s_name, lower(s_name) AS key FROM supplier)"


@query
def studio_suffix_norm(spark, d):
    return companies(spark, d).select("s_suppkey", T.normalise_studio(F.col("studio")).alias("studio"))


SQL["studio_suffix_norm"] = f"WITH {_COMP} SELECT s_suppkey, trim(key) AS studio FROM c"


# --- corrections -------------------------------------------------------------------


def nations(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("credit_order"), F.col("n_name").alias("name_raw"), F.lit("c").alias("name_canonical"), F.col("n_regionkey").cast("string").alias("studio"))


def name_fixes(spark, d):
    n = read(spark, d, "nation")
    k = F.col("n_nationkey")
    action = F.when(k % 7 == 0, "discard").otherwise("fix")
    names = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat("n_name", F.lit(" A|"), "n_name", F.lit(" B"))).otherwise(F.concat("n_name", F.lit(" X")))
    studio = F.when(k % 5 == 0, "s1|-").when(k % 2 == 0, "-").otherwise("")
    return n.where("n_nationkey % 3 <> 1").select(F.col("n_name").alias("name_raw"), action.alias("action"), names.alias("names"), studio.alias("studio"))


_FIX = """f AS (SELECT n_nationkey AS k, n_name AS n, CAST(n_regionkey AS VARCHAR) AS st, n_nationkey % 3 <> 1 AS ruled FROM nation)"""


@query
def name_fix_expand(spark, d):
    fixes = corrections.name_fixes(name_fixes(spark, d))
    out = corrections.apply_name_fixes(nations(spark, d), fixes).where("kind = 'row'")
    return out.select("credit_order", "name_raw", "name_canonical", "studio")


SQL["name_fix_expand"] = f"""WITH {_FIX} SELECT k AS credit_order, n AS name_raw, 'c' AS name_canonical, st AS studio FROM f WHERE NOT ruled
UNION ALL SELECT k, n || ' A', '', 's1' FROM f WHERE ruled AND k % 7 <> 0 AND k % 5 = 0 UNION ALL SELECT k, n || ' B', '', '' FROM f WHERE ruled AND k % 7 <> 0 AND k % 5 = 0
UNION ALL SELECT k, n || ' X', '', CASE WHEN k % 2 = 0 THEN '' ELSE st END FROM f WHERE ruled AND k % 7 <> 0 AND k % 5 <> 0"""


@query
def name_fix_discard(spark, d):
    out = corrections.apply_name_fixes(nations(spark, d), name_fixes(spark, d)).where("kind = 'dropped'")
    return out.select("credit_order", "name_raw", F.lit("ruled-not-a-person").alias("reason"))


SQL["name_fix_discard"] = f"WITH {_FIX} SELECT k AS credit_order, n AS name_raw, 'ruled-not-a-person' AS reason FROM f WHERE ruled AND k % 7 = 0"


@query
def conditional_update(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fixes = spark.createDataFrame([("1-URGENT", "F", "O"), ("2-HIGH", "P", "X"), ("5-LOW", "none", "Y")], "o_orderpriority string, wrong string, correct string")
    return corrections.conditional_update(o, fixes, ["o_orderpriority"], "o_orderstatus", "wrong", "correct").select("o_orderkey", "o_orderstatus", "changed")


SQL["conditional_update"] = "WITH c AS (SELECT *, (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS a, (o_orderpriority = '2-HIGH' AND o_orderstatus = 'P') AS b FROM orders) SELECT o_orderkey, CASE WHEN a THEN 'O' WHEN b THEN 'X' ELSE o_orderstatus END AS o_orderstatus, a OR b AS changed FROM c"


@query
def class_override(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("cls"))
    fixes = o.where("o_orderkey % 11 = 0").select("o_orderkey", "o_custkey", F.lit("F").alias("cls"))
    return corrections.override(o, fixes, ["o_orderkey", "o_custkey"], "cls").select("o_orderkey", "cls", "changed")


SQL["class_override"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'F' ELSE o_orderstatus END AS cls, o_orderkey % 11 = 0 AND o_orderstatus <> 'F' AS changed FROM orders"


@query
def append_with_next_order(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    more = read(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))).alias("l_partkey"))
    return corrections.append_rows(li, more, "l_orderkey", "l_linenumber", ["l_partkey"])


SQL["append_with_next_order"] = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem UNION ALL SELECT o.o_orderkey, CAST(coalesce(m.m, -1) + x.k AS INTEGER), x.p FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) m ON o.o_orderkey = m.l_orderkey, (VALUES (1, -2), (2, -1)) x(k, p) WHERE o.o_orderkey % 5 = 0"


# --- context -----------------------------------------------------------------------


@query
def heading_ffill(spark, d):
    """Each turn with the last user turn at or before it."""
    c = read(spark, d, "conversations")
    return context.forward_fill(c, F.when(F.col("role") == "user", F.col("turn")), "heading", "conv_id", "turn").select("conv_id", "turn", F.coalesce("heading", F.lit(-1).cast("long")).alias("heading"))


SQL["heading_ffill"] = "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS heading FROM conversations"


@query
def carried_role_reset(spark, d):
    """The last long turn since the last user turn."""
    c = read(spark, d, "conversations")
    out = context.forward_fill(c, F.when(F.length("text") > 300, F.col("turn")), "carried", "conv_id", "turn", F.col("role") == "user")
    return out.select("conv_id", "turn", F.coalesce("carried", F.lit(-1).cast("long")).alias("carried"))


SQL["carried_role_reset"] = "WITH p AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations) SELECT conv_id, turn, coalesce(last_value(CASE WHEN length(text) > 300 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, g ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS carried FROM p"


@query
def heading_stack(spark, d):
    """Turns whose number says a heading level: the path of open headings."""
    c = read(spark, d, "conversations")
    level = F.when(F.col("turn") % 4 == 0, 2).when(F.col("turn") % 4 == 1, 3).when(F.col("turn") % 8 == 2, 4)
    rows = c.select("conv_id", "turn", level.alias("level"), F.concat(F.lit("h"), F.col("turn").cast("string")).alias("title"))
    return context.heading_stack(rows, "level", "title", "conv_id", "turn", [2, 3, 4]).select("conv_id", "turn", "path")


SQL["heading_stack"] = """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 2 WHEN turn % 4 = 1 THEN 3 WHEN turn % 8 = 2 THEN 4 END AS level, 'h' || turn AS title FROM conversations),
m AS (SELECT *, max(CASE WHEN level = 2 THEN turn END) OVER w AS a, max(CASE WHEN level = 3 THEN turn END) OVER w AS b, max(CASE WHEN level = 4 THEN turn END) OVER w AS e FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, concat_ws(' / ', 'h' || a, CASE WHEN b > coalesce(a, -1) THEN 'h' || b END, CASE WHEN e > coalesce(a, -1) AND e > coalesce(b, -1) THEN 'h' || e END) AS path FROM m"""


@query
def asof_heading(spark, d):
    """Each purchase with the id of the user's last signup before it."""
    e = read(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    signs = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup"))
    out = context.asof_backward(buys, signs.groupBy("user_id", "ts").agg(F.max("signup").alias("signup")), "user_id", "ts", "signup", "last_signup")
    return out.select("event_id", F.coalesce("last_signup", F.lit(-1).cast("long")).alias("last_signup"))


SQL["asof_heading"] = "WITH s AS (SELECT user_id, ts, max(event_id) AS signup FROM events WHERE event_type = 'signup' GROUP BY 1, 2), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT b.event_id, coalesce(s.signup, -1) AS last_signup FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.ts > s.ts"


@query
def html_items(spark, d):
    """List items of each page in order, by patterns over the whole page."""
    p = read(spark, d, "pages")
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), 1)
    out = p.select("page_id", F.posexplode(items).alias("n", "item"))
    return out.select("page_id", "n", F.btrim(F.regexp_replace("item", "<[^>]+>", "")).alias("item"))


SQL["html_items"] = r"WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS l FROM pages), y AS (SELECT page_id, unnest(l) AS item, unnest(range(0, len(l))) AS n FROM x) SELECT page_id, CAST(n AS INTEGER) AS n, trim(regexp_replace(item, '<[^>]+>', '', 'g')) AS item FROM y"



#: What DuckDB's trim takes off: all of Unicode's category Zs.
_BLANKS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


@query
def html_udtf(spark, d):
    """Headings of each page by the table function over the parsed tree, which gives them as written; of entities only four, whole ones, are read."""
    from ..sources.documents import register_written

    register_written(spark, "rollcall_html_written")
    read(spark, d, "pages").select("page_id", "html").createOrReplaceTempView("rollcall_pages")
    found = spark.sql("SELECT page_id, e.n, e.source FROM rollcall_pages, LATERAL rollcall_html_written(html, 'h1') e")
    item = F.btrim(F.regexp_replace("source", "<[^>]+>", ""), F.lit(_BLANKS))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        item = F.replace(item, F.lit(entity), F.lit(char))
    return found.select("page_id", "n", item.alias("item"))


SQL["html_udtf"] = r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1) AS l FROM pages), y AS (SELECT page_id, unnest(l) AS item, unnest(range(0, len(l))) AS n FROM x) SELECT page_id, CAST(n AS INTEGER) AS n, replace(replace(replace(replace(trim(regexp_replace(item, '<[^>]+>', '', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS item FROM y"""

@query
def roster_split(spark, d):
    """A nation's customers, 500 keys on a line: three or more people become rows, a line with a company or another spelling stays."""
    from ..sources.wikitext import roster

    first = F.when((F.col("c_nationkey") % 3 == 1) & (F.col("c_custkey") % 3 == 0), "cy").when((F.col("c_nationkey") % 3 == 2) & (F.col("c_custkey") % 7 == 0), "Bo Media").otherwise("Ann")
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat(first, F.lit(" K"), F.col("c_custkey").cast("string")).alias("n"))
    lines = c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 500).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "n"))), lambda x: x["n"]), ", ").alias("line"))
    names = F.pandas_udf(lambda t: t.map(roster), "array<string>")("line")
    return lines.withColumn("p", names).select("c_nationkey", F.explode(F.when(F.size("p") > 0, F.col("p")).otherwise(F.array("line"))).alias("name"))


SQL["roster_split"] = r"""WITH n AS (SELECT c_nationkey, c_custkey, CASE WHEN c_nationkey % 3 = 1 AND c_custkey % 3 = 0 THEN 'cy' WHEN c_nationkey % 3 = 2 AND c_custkey % 7 = 0 THEN 'Bo Media' ELSE 'Ann' END || ' K' || c_custkey AS n FROM customer),
g AS (SELECT c_nationkey, c_custkey // 500 AS page, count(*) >= 3 AND bool_and(n LIKE 'Ann %') AS ok, string_agg(n, ', ' ORDER BY c_custkey) AS line FROM n GROUP BY 1, 2)
SELECT n.c_nationkey, n.n AS name FROM n JOIN g ON n.c_nationkey = g.c_nationkey AND n.c_custkey // 500 = g.page WHERE g.ok UNION ALL SELECT c_nationkey, line FROM g WHERE NOT ok"""


@query
def json_options(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


SQL["json_options"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"


@query
def explicit_roles(spark, d):
    from ..operators import marts

    e = read(spark, d, "events")
    return marts.ordered_roles(e, ["user_id"], "event_type", "event_id").withColumnRenamed("event_type", "roles")


SQL["explicit_roles"] = "WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ' | ' ORDER BY o) AS roles FROM f GROUP BY 1"


# --- streams -------------------------------------------------------------------------


@query
def tumbling_counts(spark, d):
    return streams.tumbling_counts(read(spark, d, "events"), 60)


SQL["tumbling_counts"] = "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query
def session_windows(spark, d):
    return streams.sessions(read(spark, d, "events"), 120)


SQL["session_windows"] = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 120 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k"
