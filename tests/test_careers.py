import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.functions import text as T
from rollcall.operators import checks, continuity, corrections, identity, roles, rules
from rollcall.plans import careers
from rollcall.sources.credits import Rules
from rollcall.sources import documents as io
from rollcall.streaming import events

RULES = Rules([(r"(?i)engineer", "Engineering"), (r"(?i)\bart", "Art"), (r"(?i)publishing", "Publishing")], [r"^nobody$"])


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.clean_name(F.lit(" a <BR />  b\t"))) == "a b"
    assert T.fold("Åsa  O’Neil-Réý ﬁ") == "asa oneilrey fi"
    assert one(T.slug(F.lit("kae kazim  x"))) == "kae-kazim-x" and one(T.slug(F.lit("é"))) == "unknown"
    assert one(T.normalise_studio(F.lit(" Big  Co., Ltd. "))) == "big" and one(T.normalise_studio(F.lit("Inc"))) == "inc"
    assert [one(T.percent(F.lit(a), F.lit(b))) for a, b in ((1, 40), (3, 40), (1, 0))] == [2, 8, 0]
    name, tag = T.split_vendor_tag(F.lit("A Bee (IT) (VOLT)"), True)
    assert (one(name), one(tag)) == ("A Bee (IT)", "VOLT")
    assert one(T.split_vendor_tag(F.lit("W (www.x.com)"), "any-parenthetical")[1]) == ""
    assert [one(T.heading_from_ref(F.lit(r))) for r in ("L12", "voice:tr1", "Art/Lead#3", "")] == ["", "", "Art Lead", ""]
    assert one(T.strip_links(F.lit("a [[B|c]] [[d]]"))) == "a c d"
    assert one(rules.first_match(F.lit("an artist"), [("(?i)xyz", "no"), ("(?i)ART", "Art")])) == "Art"


def test_names_fold_without_python(spark):
    """Every character of Unicode folds as Python does it; only letters that Java doesn't know yet may differ."""
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x30000))]
    names = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    names += ["Åsa  O’Neil-Réý ﬁ", "ΑΣ Σ", "İstanbul", "½ ①②", "한국 사람", "e\u0301\u0327x", " a\u00a0b\tc ", "_x_", "", "ﷺ", "नमस्ते", "𝒜𝓫", "ẞß"]
    df = spark.createDataFrame([(n, T.fold(n)) for n in names], "n string, want string").withColumn("got", T.normalise_name("n"))
    known = "[\\p{L}\\p{N}]"
    bad = [r for r in df.where("got <> want").collect()]
    left = {ch for r in bad for ch in r.n if T.fold(ch) and T.fold(ch) not in r.got}
    unknown = {r.c for r in spark.createDataFrame([(ch, T.fold(ch)) for ch in left], "c string, f string").where(~F.col("f").rlike(known)).collect()} if left else set()
    assert left == unknown and len(bad) < len(names) // 40
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert not df.where(F.col("n").rlike("^[\\x01-\\x7F]*$") & (F.col("got") != F.col("want"))).count()


def test_markup_as_python_does_it(spark):
    import html
    import re

    texts = ["<b>a</b> &amp; b", "a<br/>b\u00a0c\u2003d", "&lt;i&gt;&#233;&copy", "", "x\x1cy  z", "1 < 2 > 3", "&nbsp;x&nbsp;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip_markup("t").alias("x")).collect()
    assert all(r.x == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", r.t)).split()) for r in got)


def test_release_stats_invariants_and_empty_group(spark):
    seen = spark.createDataFrame([("a", "g1", False), ("a", "g1", True), ("a", "g3", False), ("b", "g3", False), ("c", "g1", False), ("c", "g4", True)], "person string, release string, is_vendor boolean")
    rel = spark.createDataFrame([("g1", 1, "g1"), ("g2", 2, "g2"), ("g3", 3, "x"), ("g4", 4, "x"), ("g5", 5, "g5")], "release string, sequence int, grp string")
    spine = continuity.active_spine(rel, seen)
    got = {r.release: r for r in continuity.release_stats(seen, spine).collect()}
    assert len(got) == 5 and got["g2"].headcount == 0
    assert (got["g1"].headcount, got["g1"].newcomers, got["g1"].contractors) == (2, 2, 1)
    # the empty group holds no position: g1 and g3 are neighbours
    assert (got["g3"].continuing, got["g3"].returning, got["g3"].newcomers) == (1, 0, 1)
    assert all(r.newcomers + r.returning + r.continuing == r.headcount for r in got.values())
    assert [tuple(r) for r in continuity.flows(seen, spine).collect()] == [("g1", "x", 2)]
    empty = seen.limit(0)
    assert {r.headcount for r in continuity.release_stats(empty, continuity.active_spine(rel, empty)).collect()} == {0}


def test_role_cascade_and_votes(spark):
    heads = [(r"(?i)\bscan", "art"), (r"(?i)\btest", "qa")]
    rows = [
        ("community", "Engineering", "", "", "", "", "community", "stated"),
        ("core", "Engineering", "scan", "", "", "", "engineering", "stated"),
        ("core", "Publishing", "scan", "", "", "", "art", "stated"),
        ("core", "Other", "", "Test", "", "", "qa", "stated"),
        ("publishing", "", "", "", "Scan Hall", "testing", "art", "inferred"),
        ("core", "", "", "", "", "testing", "qa", "inferred"),
        ("core", "", "", "", "", "development", "unspecified", "stated"),
        ("special-thanks", "", "", "", "", "", "thanks", "stated"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, inclusion string, category string, role_raw string, tag string, heading string, vendor_type string, cls string, prov string")
    cols = {c: F.col(c) for c in ("inclusion", "category", "role_raw", "tag", "heading", "vendor_type")}
    bad = df.withColumn("got", roles.row_class(heads, [], **cols)).where("got.cls <> cls or got.prov <> prov").collect()
    assert not bad
    votes = spark.createDataFrame([(1, "art", "inferred"), (1, "art", "stated"), (1, "qa", "stated"), (2, "unspecified", "stated"), (2, "live", "inferred")], "k int, cls string, prov string")
    assert {tuple(r) for r in roles.votes(votes, ["k"]).collect()} == {(1, "art", "stated"), (2, "live", "inferred")}


def test_corrections_reject_contradictions(spark):
    bad = spark.createDataFrame([("a", "fix", "b|c", "x|y|z")], "name_raw string, action string, names string, studio string")
    good = spark.createDataFrame([("a", "fix", "b|c", "x|y"), ("b", "discard", "", "")], bad.schema)
    assert sorted(map(tuple, corrections.name_fixes(good).collect())) == sorted(map(tuple, good.collect()))
    tables = [corrections.name_fixes(bad), corrections.name_fixes(good.union(good))]
    tables += [corrections.studio_fixes(spark.createDataFrame([("A", "g", wrong, right, "r")] * times, io.TABLES["studio_fixes"])) for wrong, right, times in (("", "x", 1), ("x", " ", 1), ("x", "y", 2))]
    tables += [corrections.inclusion_overrides(spark.createDataFrame([("g", "A", cls, why)], io.TABLES["inclusion_overrides"]), ["core"]) for cls, why in (("cor", "r"), ("core", " "))]
    for t in tables:
        with pytest.raises(corrections.CorrectionError), checks.named(corrections.CorrectionError):
            t.collect()
    twice = spark.createDataFrame([("g", "A", "core", "r", 1), ("g", "A", "babies", "r", 0)], io.TABLES["inclusion_overrides"] + ", place int")
    assert corrections.inclusion_overrides(twice, ["core", "babies"]).first().inclusion_class == "core"


def test_whole_chain(spark, tmp_path):
    docs = spark.createDataFrame(
        [
            ("g1", "wikitext", "{}", "===Engineers===\n* Ann Bee\n* Bo Ray\n* Two People\n* nobody\n===Acme===\n* Cy Dow (ACME)\n"),
            ("g2", "wikitext", '{"inline_vendor":true}', "===Artists===\n* Ann Bee (ACME)\n* Eve Fox\nwhat is this\n"),
            ("g3", "wikitext", "{}", "===Artists===\n* Bo Ray\n* Ann Bee\n"),
        ],
        "game_id string, parser string, options string, text string",
    )
    fixes = careers.Corrections(
        names=spark.createDataFrame([("Two People", "fix", "Dee One|Dee Two", "-|Wrong"), ("Cy Dow (ACME)", "discard", "", "")], io.TABLES["name_fixes"]),
        studios=spark.createDataFrame([("Dee Two", "g1", "Wrong", "Acme", "r"), ("", "g1", "", "", "a row without a name is left out"), ("Ann Bee", "g2", "other", "x", "r")], io.TABLES["studio_fixes"]),
        curated=spark.createDataFrame([("Gil Hay", "", "Art", "", "", "", "core", "c1", "g3", 0)], "name_raw string, name_canonical string, category string, role_raw string, character string, studio string, inclusion_class string, source_ref string, game_id string, place long"),
        overrides=spark.createDataFrame([("g3", "Gil Hay", "publishing", "why")], io.TABLES["inclusion_overrides"]),
    )
    tagged = careers.parse(docs, RULES, fixes)
    rows = tagged.where("kind = 'row'")
    got = {(r.game_id, r.name_raw): r for r in rows.collect()}
    assert set(got) == {("g1", "Ann Bee"), ("g1", "Bo Ray"), ("g1", "Dee One"), ("g1", "Dee Two"), ("g2", "Ann Bee"), ("g2", "Eve Fox"), ("g3", "Bo Ray"), ("g3", "Ann Bee"), ("g3", "Gil Hay")}
    assert got["g1", "Dee Two"].studio == "Acme" and got["g1", "Dee One"].credit_order == got["g1", "Dee Two"].credit_order
    assert got["g2", "Ann Bee"].studio == "ACME"
    assert got["g3", "Gil Hay"].credit_order == 2 and got["g3", "Gil Hay"].inclusion_class == "publishing"
    report = {r.game_id: r for r in corrections.parse_report(tagged, "game_id").collect()}
    assert (report["g1"].dropped, report["g2"].unparsed, report["g2"].failed, report["g3"].failed) == (2, 1, True, False)

    io.write_credits(rows, f"{tmp_path}/out")
    io.write_audit(tagged, f"{tmp_path}/audit")
    flat = f"{tmp_path}/flat"
    (tmp_path / "flat").mkdir()
    for g in ("g1", "g2", "g3"):
        rows.where(F.col("game_id") == g).select(*[c.split()[0] for c in io.CREDITS.split(", ")]).toPandas().to_csv(f"{flat}/{g}.csv", index=False)
    credits = io.read_credits(spark, flat)
    assert credits.count() == 8 and credits.where("character is null").count() == 0
    games = spark.createDataFrame([("g1", "G 1", 2001, 1, "m"), ("g2", "G 2", 2004, 2, "m"), ("g3", "G 3", 2007, 3, "m")], io.TABLES["games"])
    none = io.read_table(spark, "aliases", f"{tmp_path}/missing.csv", optional=True)
    people, facts = identity.resolve(credits, games, none, spark.createDataFrame([], io.TABLES["reviews"]))
    classes = spark.createDataFrame([("Maker, Inc.", "first-party")], io.TABLES["studio_classes"])
    seen = careers.appearances(credits, people, facts, classes)
    stats = {r.game_id: r for r in careers.per_game(games, seen, {}).collect()}
    assert (stats["g1"].headcount, stats["g1"].contractors) == (4, 1)
    assert (stats["g3"].continuing_from_previous, stats["g3"].returning, stats["g2"].contractors) == (1, 1, 1)
    assert {tuple(r) for r in careers.flow_edges(games, seen, {}).collect()} == {("g1", "g2", 1), ("g2", "g3", 1), ("g1", "g3", 1)}
    both = careers.lineages(games, seen, {"g1": "A", "g2": "B", "g3": "B"}).collect()
    at = {(r.release, r.first_party_only): r for r in both}
    assert (at["g3", False].from_A, at["g3", False].from_B, at["g3", False].no_prior) == (2, 1, 0)
    assert (at["g3", True].from_A, at["g3", True].from_B, at["g2", True].roster) == (2, 0, 1)
    with pytest.raises(Exception, match="no era"):
        careers.lineages(games, seen, {"g1": "A"}).collect()


def test_streams_agree_with_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.write.parquet(f"{tmp_path}/e")
    want = {tuple(r) for r in events.tumbling_counts(df, 60).collect()}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    q = events.tumbling_counts(stream, 60).writeStream.outputMode("complete").format("memory").queryName("tumbling_t").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("tumbling_t").collect()} == want


def test_freeze_and_frozen_scan(spark, tmp_path):
    answers = {"http://w/x": '{"parse":{"wikitext":"===A===\\n* B C"}}', "http://b/x": '<script src="/_next/static/chunks/pages/en/credits-1.js">', "http://b/_next/static/chunks/pages/en/credits-1.js": "code"}
    assert io.freeze("http://w/x", "wikitext", f"{tmp_path}/raw/w/a b.txt", answers.get)
    assert io.freeze("http://b/x", "bundle", f"{tmp_path}/raw/b/m.txt", answers.get, {"script": r'src="(/_next/[^"]*credits-[^"]+[.]js)"'})
    assert not io.freeze("", "sheet", f"{tmp_path}/raw/none.txt")
    with pytest.raises(ValueError, match="nope"):
        io.freeze("u", "wikitext", "", lambda _: '{"error":{"code":"nope"}}')
    games = spark.createDataFrame([("g1", "t", 2001, 1, "m"), ("g2", "t", 2002, 2, "m")], io.TABLES["games"])
    src = spark.createDataFrame([("g1", "wikitext", "", "raw/w/a b.txt", ""), ("g2", "bundle", "", "raw/b/m.txt", "")], io.TABLES["sources"])
    got = {r.game_id: r.text for r in io.read_frozen(spark, f"{tmp_path}/raw", src, games).collect()}
    assert got["g1"] == "===A===\n* B C" and got["g2"].endswith("code")
    lost = spark.createDataFrame([("g1", "sheet", "", "raw/w/lost.txt", "")], io.TABLES["sources"])
    with pytest.raises(Exception, match="no game or no frozen file"):
        io.read_frozen(spark, f"{tmp_path}/raw", lost, games).collect()
    bad = spark.createDataFrame([('{"error":{"code":"nope"}}',)], "p string")
    with pytest.raises(Exception, match="nope"):
        bad.select(io.wikitext_of(F.col("p"))).collect()
