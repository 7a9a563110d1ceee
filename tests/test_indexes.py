import csv
import json

from pyspark.sql import functions as F

from rollcall import cli
from rollcall.sources import indexes


def test_heading_indexes_roles_and_tags(spark):
    wiki = "intro\n==A==\nx\n===B===\ny\n== [[t|C]] ==\n'''z'''\n"
    docs = spark.createDataFrame([("g", wiki)], "game_id string, text string")
    assert {(r.source_ref, r.heading) for r in indexes.wiki_heading_index(docs).collect()} >= {("L3", "A"), ("L5", "A / B"), ("L7", "t")}
    page = "<tr>0</tr><h2>One &amp; <b>x</b></h2><tr>1</tr><tr>2</tr><h4>Two</h4><TR>3</tr>"
    docs = spark.createDataFrame([("g", page)], "game_id string, text string")
    assert {(r.source_ref, r.heading) for r in indexes.table_heading_index(docs).collect()} == {("tr1", "One & x"), ("tr2", "One & x"), ("tr3", "Two")}
    row = lambda role, *people: f'<tr><td class="text-right">{role}</td><td>' + "".join(f'<a href="/person/1/{p}/">{p}</a>' for p in people) + "</td></tr>"
    docs = spark.createDataFrame([("g", row("Lead", "A", "B") + row("Art &amp; more", "A") + row("Lead", "A") + row("", "C"))], "game_id string, text string")
    assert {(r["name"], r.roles) for r in indexes.explicit_roles(docs).collect()} == {("A", "Lead | Art & more"), ("B", "Lead")}
    fixes = spark.createDataFrame([("A Bee (VOLT) (Tech Art)", "A Bee", 0), ("A Bee (QA)", "A Bee", 1), ("X (Big Group)", "X", 2), ("Y & Z (Art)", "Y|Z", 3), ("W (12)", "W", 4), ("V (Co-op Design)", "V", 5)], "name_raw string, names string, place int")
    assert {tuple(r) for r in indexes.name_tags(fixes, ["volt"]).collect()} == {("A Bee", "Tech Art"), ("V", "Co-op Design")}
    marked = spark.createDataFrame([("g", "Ann", 0), ("h", "Anna", 1), ("h", "Ann ", 2)], "game_id string, name_raw string, ord int")
    cols = spark.createDataFrame([("g", 0), ("h", 3)], "game_id string, col int")
    al = spark.createDataFrame([("Anna", "ann")], "name_variant string, person_id string")
    assert [(r.ident, r["name"], r.cols) for r in indexes.marked_people(marked, al, cols, F.lower(F.trim("name_raw"))).collect()] == [("ann", "Anna", [0, 3])]


def test_command_line(spark, tmp_path):
    def table(name, head, *rows):
        with open(tmp_path / "config" / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([head, *rows])

    (tmp_path / "config").mkdir()
    (tmp_path / "raw" / "w").mkdir(parents=True)
    (tmp_path / "raw/w/a.txt").write_text("===Engineers===\n* Ann Bee\n* Bo Ray (ACME)\n")
    (tmp_path / "raw/w/b.txt").write_text("===Engineers===\n* Ann Bee\n")
    table("games.csv", ["game_id", "title", "year", "sequence", "type"], ["a", "A", 2001, 1, "m"], ["b", "B", 2015, 2, "m"])
    table("sources.csv", ["game_id", "parser", "url", "raw_path", "options"], ["a", "wikitext", "", "raw/w/a.txt", '{"inline_vendor":true}'], ["b", "wikitext", "", "raw/w/b.txt", ""])
    table("categories.csv", ["pattern", "label", "note"], ["(?i)engineer", "Engineering", ""])
    table("studio_classes.csv", ["studio", "class"], ["maker", "first-party"])
    table("role_headings.csv", ["pattern", "label", "note"], ["(?i)stitch", "art", ""])
    table("name_fixes.csv", ["name_raw", "action", "names", "studio"], ["Bo Ray (Stitching)", "fix", "Bo Ray", ""])
    (tmp_path / "config/not-people.txt").write_text("# none\n\n^nobody$\n")
    (tmp_path / "config/plan.json").write_text(json.dumps({"eras": {"a": "X", "b": "Y"}}))
    assert cli.main(["all", "--root", str(tmp_path)], spark) == 0
    read = lambda name: [r.asDict() for r in spark.read.csv(f"{tmp_path}/out/{name}", header=True, inferSchema=True).collect()]
    assert [(r["game_id"], r["headcount"], r["contractors"]) for r in read("per_game")] == [("a", 2, 1), ("b", 1, 0)]
    assert [r["name"] for r in read("uncertain")] == ["Ann Bee"]
    assert {(r["from_grp"], r["to_grp"], r["count"]) for r in read("flows")} == {("a", "b", 1)}
    assert len(read("lineage")) == 4 and {r["person_id"] for r in read("people")} == {"ann-bee", "bo-ray"}
    assert {(r["name"], r["game_id"], r["cls"], r["prov"]) for r in read("roles")} == {("Ann Bee", "a", "engineering", "stated"), ("Bo Ray", "a", "engineering", "stated"), ("Ann Bee", "b", "engineering", "stated")}
    assert [r["tag"] for r in read("indexes/name_tags")] == ["Stitching"] and {r["heading"] for r in read("indexes/headings")} == {"Engineers"}
    (tmp_path / "raw/w/b.txt").write_text("nothing here\n")
    assert cli.main(["parse", "--root", str(tmp_path)], spark) == 1
