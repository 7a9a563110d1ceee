"""Each parser on a page made up for it."""

import json

import pytest

from rollcall.sources import bundle, pages, wikitext
from rollcall.sources.credits import Rules
from rollcall.sources.documents import parse_documents, register_items, register_udtf
from rollcall.sources.html import parse_html

RULES = Rules(
    [(r"(?i)\b(voice|cast)\b", "Voice"), (r"(?i)\b(engineer|program)", "Engineering"), (r"(?i)\b(art|anim)", "Art"), (r"(?i)thanks", "Special Thanks"), (r"(?i)\b(chief|lead)\b", "Leadership")],
    [r"^KEEP OUT$", r"(?i)https?://", r"(?i)^(category):"],
)


def rows(events):
    return [e for e in events if e["kind"] == "row"]


def short(events, *cols):
    return [tuple(e[c] for c in ("name_raw", *cols)) for e in rows(events)]


WIKI = """Intro prose.
{{Box
|a={{b}}
}}
==Credits==
===Programming===
'''Engineers'''
* [[Ada Lane|Ada Layne]]
* [[wikipedia:Bo Ray|Bo Ray]]
''Music plays''
* Writer: [[Cy Dow]]
* Art Director: Nobody Knows
* KEEP OUT
=== Big Studio Ltd ===
* Dee Fox (VOLT)
====Unit====
* Eve Hall
===Voice Cast===
* [[Flo Ito]]: [[Hero]]
* Gil Jay, Hal Kay, Ida Lee
===Special Thanks===
* Jim Moe - Lead
===Old Port===
* Kim Noe
plain line
==Trivia==
* Not a credit
"""


def test_wikitext():
    got = wikitext.parse(WIKI, {"inline_vendor": True, "studio_headings": ["Big Studio Ltd"], "exclude_sections": ["Old Port"], "dash_style": "name-first"}, RULES)
    assert short(got, "name_canonical", "role_raw", "studio", "character", "inclusion_class", "source_ref") == [
        ("Ada Layne", "Ada Lane", "Engineers", "", "", "core", "L8"),
        ("Bo Ray", "Bo Ray", "Engineers", "", "", "core", "L9"),
        ("Cy Dow", "", "Writer", "", "", "core", "L11"),
        ("Dee Fox", "", "Big Studio Ltd", "VOLT", "", "core", "L15"),
        ("Eve Hall", "", "Unit", "Big Studio Ltd", "", "core", "L17"),
        ("Flo Ito", "", "Voice Cast", "", "Hero", "core", "L19"),
        ("Gil Jay", "", "Voice Cast", "", "", "core", "L20"),
        ("Hal Kay", "", "Voice Cast", "", "", "core", "L20"),
        ("Ida Lee", "", "Voice Cast", "", "", "core", "L20"),
        ("Jim Moe", "", "Lead", "", "", "special-thanks", "L22"),
    ]
    assert [e["credit_order"] for e in rows(got)] == list(range(10))
    reasons = {(e["line"], e["reason"]) for e in got if e["kind"] == "dropped"}
    assert {("Intro prose.", "outside-credits-section"), ("''Music plays''", "stage-direction"), ("KEEP OUT", "non-person"), ("* Kim Noe", "excluded-section"), ("* Not a credit", "outside-credits-section")} <= reasons
    assert [(e["line"], e["source_ref"]) for e in got if e["kind"] == "unparsed"] == [("Art Director: Nobody Knows", "L12")]


def test_wikitext_dashes_and_bold_cast():
    text = "===Cast===\n'''[[Hero One|The Hero]]'''\nAnn Bee\n'''Extras'''\nCy-Dee Eff\nGuard – Gil Hay\n===Work===\nTester - Ivy Jay\nPlain Kay"
    got = wikitext.parse(text, {"name_style": "plain", "dash_style": "role-first", "cast_dash_style": "character-actor", "cast_bold_style": "character"}, RULES)
    assert short(got, "character", "role_raw", "category") == [
        ("Ann Bee", "The Hero", "Cast", "Voice"),
        ("Cy-Dee Eff", "", "Extras", "Other"),
        ("Gil Hay", "", "Guard", "Other"),
        ("Ivy Jay", "", "Tester", "Other"),
        ("Plain Kay", "", "Work", "Other"),
    ]
    with pytest.raises(ValueError):
        wikitext.parse("* A B", {"inline_vendor": "round"}, RULES)


def test_wikitext_companies_end_with_their_sections():
    text = "===Acme===\n* A One\n====Part====\n* B Two\n'''Sub Co'''\n* C Three\n'''Other'''\n* D Four\n===Next===\n* E Five"
    got = wikitext.parse(text, {"studio_headings": {"Acme": "Acme Inc", "Sub Co": "Sub"}}, RULES)
    assert short(got, "studio") == [("A One", "Acme Inc"), ("B Two", "Acme Inc"), ("C Three", "Sub"), ("D Four", "Acme Inc"), ("E Five", "")]


def test_credit_table():
    text = """<table class="table-credits x"><tr><td><h4>Game: Core Team</h4></td></tr>
<tr><td>Engineers<td><a>Ann Bee</a> (Acme), <a>Cy Dee</a> (as C.D.), <a>Eve Fox</a> (Hero)
<tr><td>Companies<td>Big Co, Small Co</tr><tr><td>only one cell</tr>
<tr><td>Hidden<td><a>Gil Hay</a></tr>
<tr><td colspan=2><h4>Other: Nope</h4></td></tr><tr><td>x<td><a>No One</a></tr>
<tr><td><h4>Game: Cast</h4></td></tr><tr><td>Queen<td><a>Ivy Jay</a></table>"""
    got = pages.credit_table(text, {"game_prefix": "Game", "studio_headings": {"Acme": "Acme Inc"}, "exclude_roles": ["Hidden"], "cast_sections": ["Cast"]}, RULES)
    assert short(got, "role_raw", "character", "studio", "category", "source_ref") == [
        ("Ann Bee", "Engineers", "", "Acme Inc", "Engineering", "tr1"),
        ("Cy Dee", "Engineers", "", "", "Engineering", "tr1"),
        ("Eve Fox", "Engineers", "Hero", "", "Voice", "tr1"),
        ("Ivy Jay", "Voice Actor", "Queen", "", "Voice", "tr8"),
    ]
    assert [(e["kind"], e["line"]) for e in got if e["kind"] != "row"] == [("dropped", "Big Co"), ("dropped", "Small Co"), ("unparsed", "only one cell")]
    assert pages.credit_table("<p>none</p>", {}, RULES) == []


def test_two_pane():
    long = "N" * 81
    text = f"""<div id="credits-employees"><table><tr class="credits-company"><td>Maker</td></tr><tr class="credits-misc"><td>Art</td></tr>
<tr><td>Ann Bee</td><td></td></tr><tr class="credits-supportcompany"><td>Helper</td><td>Testing (support company)</td></tr><tr><td>Cy Dee</td><td>Lead</td></tr>
<tr class="credits-supportcompany"><td>Friend</td><td>Art (Support Company)</td></tr><tr class="credits-company"><td>House</td></tr><tr><td>Eve Fox</td><td>x</td></tr>
<tr><td></td><td>nameless</td></tr><tr><td>{long}</td><td>x</td></tr></table></div>
<div id="credits-voice"><table><tr><td><h3>English</h3></td></tr><tr><td><div class="media-body">Gil Hay</div></td><td class="text-right">Guard (performance)</td></tr>
<tr><td><h4>French</h4></td></tr><tr><td><div class="media-body">Ida Jo</div></td><td class="text-right">Guard</td></tr></table></div>"""
    got = pages.two_pane(text, {"first_party": ["Maker"], "publishers": ["House"]}, RULES)
    assert short(got, "studio", "role_raw", "inclusion_class", "source_ref") == [
        ("Ann Bee", "", "Art", "core", "employees:tr2"),
        ("Cy Dee", "Helper", "Lead", "core", "employees:tr4"),
        ("Eve Fox", "", "x", "publishing", "employees:tr7"),
        ("Gil Hay", "", "Performance Capture", "core", "voice:tr1"),
    ]
    assert {(e["line"], e["reason"]) for e in got if e["kind"] == "dropped"} == {("Friend", "support-company-thanked"), (long, "non-person"), ("Ida Jo - Guard", "non-english-voice:French")}
    assert [e["line"] for e in got if e["kind"] == "unparsed"] == ["nameless"]


def test_span_page():
    entry = lambda *spans: '<div class="credits_entry__1">' + "".join(spans) + "</div>"
    name, title, agency = (lambda c: lambda x: f'<span{c}>{x}</span>')(""), (lambda x: f'<span class="credits_entry_title__1">{x}</span>'), (lambda x: f'<span class="credits_entry_agency__1">{x}</span>')
    text = (
        '<div class="credits_section_header__1"><h2>Art</h2></div>' + entry(name("Ann Bee"), title("Anim Lead"), agency("Acme"))
        + '<div class="credits_group_header__1"><h3>Voice Crew</h3></div>' + entry(name("Cy Dee"))
        + '<div class="credits_section_header__1"><h2>Outside Co</h2></div>' + entry(name("Eve Fox")) + entry(title("x"))
        + '<div class="credits_group_header__1"><h3>Actors</h3></div>' + entry(name("Gil Hay"))
        + '<div class="credits_section_header__1"><h2>First Game</h2></div>' + entry(name("Ida Jo"), title("Hero"))
        + '<div class="credits_software_entry__1"><div class="credits_software_name__1">Tool</div></div>'
    )
    got = pages.span_page(text, {"departments": ["Art", "First Game"], "legacy": ["^First"], "other_language": [["Outside Co", "Actors"]], "characters": [["First Game", ""]]}, RULES)
    assert short(got, "role_raw", "character", "studio", "category", "inclusion_class") == [
        ("Ann Bee", "Anim Lead", "", "Acme", "Art", "core"),
        ("Cy Dee", "Voice Crew", "", "", "Voice", "core"),
        ("Eve Fox", "", "", "Outside Co", "Other", "core"),
        ("Ida Jo", "Hero", "Hero", "", "Voice", "legacy"),
    ]
    assert [(e["line"], e.get("reason")) for e in got if e["kind"] != "row"] == [("x", None), ("Gil Hay", "non-english-voice:Outside Co/Actors"), ("Tool", "middleware")]


def test_sheet():
    line = lambda a, b="", c="": f"<tr><td class='{c}'>{a}</td><td>{b}</td></tr>"
    text = "<table>" + line("ART", c="d") + line("Acme", c="h") + line("Anim", "Ann Bee") + line("", "Cy Dee (VOLT)") + line("Sub", c="s") + line("x", "Eve Fox") + line("Other", c="h") + line("y", "Gil Hay") + line("CAST", c="h") + line("Queen", "Ida Jo") + line("In loving memory", c="d") + line("Kay Lee") + line("1960 - 2010") + "<tr><td>A tribute.</td></tr></table>"
    got = pages.sheet(text, {"ranks": {"d": 0, "h": 1, "s": 2}, "vendors": ["Acme"], "cast": ["CAST"]}, RULES)
    assert short(got, "role_raw", "character", "studio", "category") == [
        ("Ann Bee", "Anim", "", "Acme", "Art"),
        ("Cy Dee", "Anim", "", "VOLT", "Art"),
        ("Eve Fox", "x", "", "Acme", "Art"),
        ("Gil Hay", "y", "", "", "Art"),
        ("Ida Jo", "Voice Actor", "Queen", "", "Voice"),
        ("Kay Lee", "In loving memory", "", "", "Other"),
    ]
    assert [(e["line"], e["reason"]) for e in got if e["kind"] == "dropped"] == [("1960 - 2010", "memoriam-date-range"), ("A tribute.", "in-memoriam-tribute")]


def script(tiers=True):
    data = json.dumps({"props": {"credits": {"block-titles": {"one": "First Update", "two": "Second"}, "team": "The Team"}}})
    one = 'a=function(e){return t("credits.block-titles.one"),x({blockTitle:t("credits.team"),areaTitle:"Code"}),j("p",{children:[j("strong",{children:"Engineer"}),"Ann Bee",r,"Cy \\"C\\" Dee (VOLT)"]}),j("p",{children:["Eve Fox"]}),x({blockTitle:"Art by Helper Co"}),j("p",{children:["Gil \\u0048ay"]}),j("p",{children:t("credits.some-words")}),n=["Ida Jo","Kay Lee"]}'
    two = 'b=function(e){return t("credits.block-titles.two"),j("p",{children:["Other One"]})};'
    return f'<script id="__NEXT_DATA__" type="x">{data}</script>{bundle.MARKER}' + ((one + ";" + two) if tiers else one.replace("credits.block-titles.one", "nothing"))


def test_bundle():
    got = bundle.parse(script(), {"release": "first update", "functions": ["The Team"]}, RULES)
    assert short(got, "role_raw", "studio", "category", "inclusion_class") == [
        ("Ann Bee", "Engineer", "", "Engineering", "core"),
        ('Cy "C" Dee', "Engineer", "VOLT", "Engineering", "core"),
        ("Eve Fox", "Engineer", "", "Engineering", "core"),
        ("Gil Hay", "Art by Helper Co", "Helper Co", "Art", "core"),
        ("Ida Jo", "Art by Helper Co", "", "Art", "community"),
        ("Kay Lee", "Art by Helper Co", "", "Art", "community"),
    ]
    assert [e["line"] for e in got if e["kind"] == "unparsed"] == ["Some Words"]
    at = int(rows(got)[0]["source_ref"].rpartition("@")[2])
    assert script()[at:].startswith('"Ann Bee"')
    with pytest.raises(ValueError, match="no release"):
        bundle.parse(script(), {"release": "third"}, RULES)
    with pytest.raises(ValueError, match="none can be located"):
        bundle.parse(script(tiers=False), {"release": "first update"}, RULES)


def test_html_ends_tags_that_pages_leave_out():
    root = parse_html('<p>one<p>two<div>x</div><ul><li>a<li>b<ul><li>c</ul></ul><script>var t="</p>";</script><p>three<br>four')
    assert [n.text() for n in root.find("p")] == ["one", "two", "three four"]
    assert [n.text() for n in root.find("li")] == ["a", "b c", "c"]


def test_documents_and_table_functions(spark):
    docs = spark.createDataFrame([("g1", "wikitext", '{"name_style":"plain"}', "===Art===\nAnn Bee\nhttp://x.example"), ("g2", "credit_table", None, "<p>nothing</p>"), ("g3", "sheet", "", None)], "game_id string, parser string, options string, text string")
    got = parse_documents(docs, RULES).collect()
    assert [(r.game_id, r.kind, r.name_raw, r.credit_order, r.line, r.reason) for r in got] == [("g1", "row", "Ann Bee", 0, None, None), ("g1", "dropped", None, None, "http://x.example", "non-person")]
    docs.createOrReplaceTempView("docs_t")
    register_udtf(spark, RULES)
    same = spark.sql("SELECT game_id, p.kind, p.name_raw FROM docs_t, LATERAL parse_credits(text, parser, options) p").collect()
    assert sorted((r.game_id, r.kind) for r in same) == sorted((r.game_id, r.kind) for r in got)
    register_items(spark)
    assert [r.item for r in spark.sql("SELECT * FROM html_elements('<ul><li>a<li>b</ul>', 'li')").collect()] == ["a", "b"]


def test_headings_as_their_sql_reads_them(spark, tmp_path):
    """Entities that are cut or not among the SQL's four stay, blanks inside too; only plain tags count."""
    import duckdb

    import __spark_entry__

    heads = ["a &amp", "a &amp; b &lt", "&amp;lt; &quot;x&quot &#x27; &nbsp;", " a\n", "\u00a0\u3000a \t", "a<b>b</b> <i>c</i>", "a < b > c", "", "&copy; é 漢\U0001f600", "one<h1>two"]
    pages = [f"<p>é\r\n😀<h1>{h}</h1>\n<p>x<h1>again</h1>" for h in heads]
    pages += ["<H1>x</H1><h1 class=a>y</h1><h1>z", "<h1>a<p>b</h1><li><h1>c</h1>", "<h1></h1><h1>b</h1 >c</h1>", "", None]
    docs = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()["html_udtf"](spark, str(tmp_path))
    assert got.columns == ["page_id", "n", "item"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["html_udtf"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 2 * len(heads) + 4
