"""Page parsers on pages made of the customer table: a page a nation, a block of markup a customer.

A suite lists its blocks with the events that each one has to give, written down by
hand. The page is the blocks in turn; the SQL is the events in turn, with credit
order and references counted by windows. ``@N@`` stands for a customer's name (12
characters) and ``@K@`` for its number (7), so every block has a known length.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.text import normalise_name, slug
from ..sources import bundle, indexes
from ..sources.credits import Rules
from ..sources.documents import parse_documents, register_line_parser
from . import careers
from .continuity import read

RULES = Rules(
    [(r"(?i)\b(voice|cast)\b", "Voice"), (r"(?i)\b(engineer|program)", "Engineering"), (r"(?i)\b(art|anim)", "Art"), (r"(?i)\b(chief|lead)\b", "Leadership")],
    [r"^KEEP OUT", r"(?i)https?://"],
)
NAME, KEY = "@N@", "@K@"
COLUMNS = ["name", "canonical", "category", "role", "character", "studio", "cls", "ref", "line", "reason"]


def row(at: int, name: str, role: str, category: str = "Other", ref: str = "", **more: str) -> dict:
    return {"at": at, "kind": "row", "name": name, "role": role, "category": category, "ref": ref, "cls": "core"} | more


def drop(line: str, reason: str) -> dict:
    return {"at": 0, "kind": "dropped", "line": line, "reason": reason}


def fail(at: int, line: str, ref: str = "") -> dict:
    return {"at": at, "kind": "unparsed", "line": line, "ref": ref}


def filled(text: str, name: str = "Ann K0000000", key: str = "0000000") -> str:
    return text.replace(NAME, name).replace(KEY, key)


#: Pages hold a nation's customers, 500 keys each, whatever their number.
PAGE_KEY = "c_nationkey || '-' || (c_custkey // 500)"


def page_key():
    return F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 500).cast("string"))


@dataclass
class Suite:
    """``blocks``: (markup, events). ``units`` counts what references count; ``ref`` comes before the count unless an event has its own."""

    parser: str
    options: dict
    blocks: list[tuple[str, list[dict]]]
    units: Callable[[str], int]
    ref: str = ""
    head: str = ""
    foot: str = ""
    #: Units before the first block, and events of head and foot.
    before: int = 0
    around: list[dict] = field(default_factory=list)
    name: str = ""

    def pages(self, spark, d):
        texts = F.array(*(F.lit(t) for t, _ in self.blocks))
        key = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
        block = F.element_at(texts, (F.col("c_custkey") % len(self.blocks) + 1).cast("int"))
        block = F.replace(F.replace(block, F.lit(NAME), F.concat(F.lit("Ann K"), key)), F.lit(KEY), key)
        each = read(spark, d, "customer").select(F.concat(F.lit(self.name), page_key()).alias("game_id"), F.struct("c_custkey", block.alias("t")).alias("b"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "")
        pages = each.groupBy("game_id").agg(F.concat(F.lit(self.head), body, F.lit(self.foot)).alias("text"))
        return pages.select("game_id", F.lit(self.parser).alias("parser"), F.lit(json.dumps(self.options)).alias("options"), "text")

    def sql(self) -> str:
        text = lambda x: "'" + str(x).replace("'", "''") + "'"
        events = []
        for c, (_, found) in enumerate(self.blocks):
            for j, e in enumerate(found):
                e = {"ref": self.ref} | {k: v for k, v in e.items() if k != "ref" or v}
                events.append(f"({c}, {j}, {e['at']}, {text(e['kind'])}, {', '.join(text(e.get(k, '')) for k in COLUMNS)})")
        units = ", ".join(f"({c}, {self.units(filled(t))})" for c, (t, _) in enumerate(self.blocks))
        put = lambda c: f"replace(replace({c}, '{NAME}', 'Ann K' || k), '{KEY}', k) AS {c}"
        extra = "".join(f" UNION ALL SELECT DISTINCT g, {(2**31) * (i > 0)} - 1, {i}, 0, 0, {text(e['kind'])}, '0', {', '.join(text(e.get(k, '')) for k in COLUMNS)} FROM b" for i, e in enumerate(self.around))
        # character is a word of SQL's own
        cols = ", ".join(f'"{c}"' for c in COLUMNS)
        puts = ", ".join(put(f'"{c}"') for c in COLUMNS)
        return f"""(WITH p AS (SELECT '{self.name}' || {PAGE_KEY} AS g, c_custkey AS o, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS k, c_custkey % {len(self.blocks)} AS c FROM customer),
u(c, units) AS (VALUES {units}), b AS (SELECT p.*, sum(units) OVER (PARTITION BY g ORDER BY o ROWS UNBOUNDED PRECEDING) - units AS base FROM p JOIN u ON p.c = u.c),
e(c, j, off, kind, {cols}) AS (VALUES {", ".join(events)}),
x AS (SELECT g, o, j, base + {self.before}, off, kind, k, {cols} FROM b JOIN e ON b.c = e.c{extra}),
y AS (SELECT g, o, j, base, off, kind, {puts} FROM x AS x(g, o, j, base, off, kind, k, {cols}))
SELECT g AS game_id, kind, CASE WHEN kind = 'row' THEN CAST(row_number() OVER (PARTITION BY g, kind ORDER BY o, j) - 1 AS INTEGER) ELSE -1 END AS credit_order, name AS name_raw, canonical AS name_canonical, category,
 role AS role_raw, "character", studio, cls AS inclusion_class, CASE WHEN kind = 'dropped' THEN '' ELSE "ref" || CAST(base + off AS BIGINT) END AS source_ref, line, reason FROM y)"""


QUERIES, SQL = {}, {}


def register(name: str, *suites: Suite, lines_too: bool = True) -> None:
    def run(spark, d):
        pages = None
        for s in suites:
            pages = s.pages(spark, d) if pages is None else pages.unionByName(s.pages(spark, d))
        out = parse_documents(pages, RULES)
        return out.select(*[F.coalesce(c, F.lit(-1 if c == "credit_order" else "")).alias(c) for c in out.columns])

    def by_line(spark, d):
        """The same from a table of lines, by the table function that is dealt them by page."""
        pages = None
        for s in suites:
            pages = s.pages(spark, d) if pages is None else pages.unionByName(s.pages(spark, d))
        lines = pages.select("game_id", "parser", "options", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        register_line_parser(spark, RULES, "rollcall_parse_lines")
        out = spark.sql("SELECT * FROM rollcall_parse_lines(TABLE({lines}), 'tagged')", lines=lines)
        return out.select(*[F.coalesce(c, F.lit(-1 if c == "credit_order" else "")).alias(c) for c in out.columns])

    for i, s in enumerate(suites):
        s.name = s.name or f"{name}-{i}-"
    if lines_too:
        QUERIES[f"{name}_by_line"], SQL[f"{name}_by_line"] = by_line, " UNION ALL ".join(f"SELECT * FROM {s.sql()}" for s in suites)
    QUERIES[name], SQL[name] = run, " UNION ALL ".join(f"SELECT * FROM {s.sql()}" for s in suites)


def lines(text: str) -> int:
    return text.count("\n")


# --- wiki markup -------------------------------------------------------------

register("wikitext_credits", Suite(
    "wikitext", {"inline_vendor": True, "dash_style": "name-first", "article_prefixes": ["Sister"], "babies_headings": [r"(?i)\btiny ones\b"]},
    [
        ("===Crew===\n* [[:sister: @N@|Shown @K@]]\n* [[Other: @N@|Long @K@]]\n", [row(2, "Shown @K@", "Crew", canonical=NAME), row(3, "Long @K@", "Crew", canonical="Other: @N@")]),
        ("===The Tiny Ones===\n* @N@\n", [row(2, NAME, "The Tiny Ones", cls="babies")]),
        ("===Programming===\n'''Engineers'''\n* [[Known @N@|@N@]]\n", [row(3, NAME, "Engineers", "Engineering", canonical="Known @N@")]),
        ("===Programming===\n* [[Wikipedia:@N@|@N@]]\n", [row(2, NAME, "Programming", "Engineering", canonical=NAME)]),
        ("===Texts===\n* Writer: [[@N@]]\n", [row(2, NAME, "Writer")]),
        ("===Crew===\n* Gil A@K@, Hal B@K@, Ida C@K@\n", [row(2, f"{n}@K@", "Crew") for n in ("Gil A", "Hal B", "Ida C")]),
        ("===Crew===\n* Epic Games, Turtle Rock Studios, Ida C@K@\n", [row(2, "Epic Games, Turtle Rock Studios, Ida C@K@", "Crew")]),
        ("===Unit===\n* @N@ (VOLT)\n", [row(2, NAME, "Unit", studio="VOLT")]),
        ("===Cast===\n* [[@N@]]: [[Hero @K@]]\n", [row(2, NAME, "Cast", "Voice", character="Hero @K@")]),
        ("===Crew===\n* Art Director: @N@\nplain line @K@\n", [fail(2, "Art Director: @N@"), fail(3, "plain line @K@")]),
        ("===Crew===\n* KEEP OUT @K@\n''Music @K@ plays''\n", [drop("KEEP OUT @K@", "non-person"), drop("''Music @K@ plays''", "stage-direction")]),
        ("===Special Thanks===\n* @N@ - Lead\n", [row(2, NAME, "Lead", "Leadership", cls="special-thanks")]),
        ("===Crew===\n* [[:Category:Things by @N@|@N@]]\n\n", [row(2, NAME, "Crew")]),
        ("===Marketing Team===\n{{Note|\n{{x}}}}\n* @N@\n", [row(4, NAME, "Marketing Team", cls="publishing")]),
        ("===Production Babies===\n* @N@\n", [row(2, NAME, "Production Babies", cls="babies")]),
    ],
    lines, "L", "Intro prose.\n{{Box\n|a={{b}}\n}}\n==Credits==\n", "==Trivia==\n* Not a credit\n", 5,
    [drop("Intro prose.", "outside-credits-section"), drop("* Not a credit", "outside-credits-section")],
))

register("wikitext_scopes", Suite(
    "wikitext", {"studio_headings": {"Acme Works": "Acme Inc", "Sub Co": "Sub"}, "exclude_sections": ["Old Port"]},
    [
        ("===Acme Works===\n* @N@\n====Part====\n* Bo @K@\n'''Sub Co'''\n* Cy @K@\n'''Other'''\n* Di @K@\n", [
            row(2, NAME, "Acme Works", studio="Acme Inc"), row(4, "Bo @K@", "Part", studio="Acme Inc"),
            row(6, "Cy @K@", "Sub Co", studio="Sub"), row(8, "Di @K@", "Other", studio="Acme Inc"),
        ]),
        ("===Old Port===\n* @N@\n====Deeper====\n* Bo @K@\n", [drop("* @N@", "excluded-section"), drop("* Bo @K@", "excluded-section")]),
        ("===Next===\n* @N@\n", [row(2, NAME, "Next")]),
    ],
    lines, "L",
))

register(
    "wikitext_dashes",
    Suite(
        "wikitext", {"name_style": "plain", "dash_style": "role-first", "cast_dash_style": "character-actor", "cast_bold_style": "character"},
        [
            ("===Work===\nTester - @N@\nPlain @K@\n", [row(2, NAME, "Tester"), row(3, "Plain @K@", "Work")]),
            ("===Voice Cast===\n'''[[Hero @K@|The Hero]]'''\n@N@\n'''Extras'''\nCy-Dee @K@\n", [row(3, NAME, "Voice Cast", "Voice", character="The Hero"), row(5, "Cy-Dee @K@", "Extras")]),
            ("===Cast===\nGuard @K@ – @N@\n", [row(2, NAME, "Cast", "Voice", character="Guard @K@")]),
            ("===Work===\nHalf- @N@\n", [row(2, NAME, "Half")]),
        ],
        lines, "L",
    ),
    Suite(
        "wikitext", {"name_style": "plain", "dash_style": "name-first", "cast_dash_style": "actor-character"},
        [("===Work===\n@N@ — Tester\n", [row(2, NAME, "Tester")]), ("===Cast===\n@N@ - Guard\n", [row(2, NAME, "Cast", "Voice", character="Guard")])],
        lines, "L",
    ),
)

# --- pages in HTML -------------------------------------------------------------


def elements(tag: str) -> Callable[[str], int]:
    return lambda text: text.count(f"<{tag}")


def section(text: str) -> str:
    return f"<tr><td><h4>{text}</h4></td></tr>"


register("credit_table_rows", Suite(
    "credit_table", {"game_prefix": "Game", "studio_headings": {"Acme": "Acme Inc"}, "exclude_roles": ["Hidden"], "cast_sections": ["Cast"]},
    [
        (section("Game: Core Team") + "<tr><td>Engineers<td><a>@N@</a> (Acme), <a>Cy @K@</a> (as C.D.), <a>Eve @K@</a> (Hero)</tr>", [
            row(1, NAME, "Engineers", "Engineering", studio="Acme Inc"), row(1, "Cy @K@", "Engineers", "Engineering"), row(1, "Eve @K@", "Engineers", "Voice", character="Hero"),
        ]),
        (section("Game: Core Team") + "<tr><td>Companies<td>Big @K@, Small @K@</tr><tr><td>only @K@</tr>", [drop("Big @K@", "studio-mention"), drop("Small @K@", "studio-mention"), fail(2, "only @K@")]),
        (section("Other: Nope") + "<tr><td>x<td><a>@N@</a></tr>", []),
        (section("Game: Cast") + "<tr><td>Queen<td><a>@N@</a></tr>", [row(1, NAME, "Voice Actor", "Voice", character="Queen")]),
        (section("Game: Core Team") + "<tr><td>Hidden<td><a>@N@</a></tr><tr><td>Crew<td><a>KEEP OUT @K@</a></tr>", [drop("KEEP OUT @K@", "non-person")]),
        (section("Game: Special Thanks") + "<tr><td>Art Lead<td><a>@N@</a></tr>", [row(1, NAME, "Art Lead", "Art", cls="special-thanks")]),
        (section("Game: Acme") + "<tr><td>Lead<td><a>@N@</a></tr>", [row(1, NAME, "Lead", "Leadership", studio="Acme Inc")]),
        (section("Game: Marketing") + "<tr><td>Chief<td><a>@N@</a></tr>", [row(1, NAME, "Chief", "Leadership", cls="publishing")]),
    ],
    elements("tr"), "tr", '<table class="table-credits x">', "</table>",
))


def pane_row(kind: str, *cells: str) -> str:
    return f'<tr class="credits-{kind}">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


_LONG = "N" * 74 + KEY
register("two_pane_staff", Suite(
    "two_pane", {"first_party": ["Maker"], "publishers": ["House"]},
    [
        (pane_row("company", "Maker") + pane_row("misc", "Art") + pane_row("x", NAME, "") + pane_row("supportcompany", "Helper @K@", "Testing (support company)") + pane_row("x", "Cy @K@", "Lead"), [
            row(2, NAME, "Art", "Art"), row(4, "Cy @K@", "Lead", "Art", studio="Helper @K@"),
        ]),
        (pane_row("misc", "Art") + pane_row("supportcompany", "Friend @K@", "Art (Support Company)") + pane_row("x", "", "nameless @K@") + pane_row("x", _LONG, "x"), [
            drop("Friend @K@", "support-company-thanked"), fail(2, "nameless @K@"), drop(_LONG, "non-person"),
        ]),
        (pane_row("company", "House") + pane_row("misc", "Ops") + pane_row("x", NAME, "x"), [row(2, NAME, "x", cls="publishing")]),
        (pane_row("misc", "Crew") + pane_row("company", "Other @K@") + pane_row("x", NAME, "Chief"), [row(2, NAME, "Chief", "Leadership", studio="Other @K@")]),
        (pane_row("misc", "Special Thanks") + pane_row("x", NAME, "x"), [row(1, NAME, "x", cls="special-thanks")]),
    ],
    elements("tr"), "employees:tr", '<div id="credits-employees"><table>', "</table></div>",
))


def voice(name: str, character: str) -> str:
    return f'<tr><td><div class="media-body">{name}</div></td><td class="text-right">{character}</td></tr>'


register("two_pane_voices", Suite(
    "two_pane", {},
    [
        ("<tr><td><h3>English</h3></td></tr>" + voice(NAME, "Guard (performance)"), [row(1, NAME, "Performance Capture", "Voice", character="Guard (performance)")]),
        ("<tr><td><h4>French</h4></td></tr>" + voice(NAME, "Guard"), [drop("@N@ - Guard", "non-english-voice:French")]),
        ("<tr><td><h3>English</h3></td></tr>" + voice(NAME, "Queen") + "<tr><td>odd @K@</td></tr>", [row(1, NAME, "Voice Actor", "Voice", character="Queen"), fail(2, "odd @K@")]),
    ],
    elements("tr"), "voice:tr", '<div id="credits-voice"><table>', "</table></div>",
))


def head(kind: str, level: int, text: str) -> str:
    return f'<div class="credits_{kind}_header__1"><h{level}>{text}</h{level}></div>'


def entry(name: str = "", title: str = "", agency: str = "") -> str:
    parts = [(c, t) for c, t in (("", name), (' class="credits_entry_title__1"', title), (' class="credits_entry_agency__1"', agency)) if t]
    return '<div class="credits_entry__1">' + "".join(f"<span{c}>{t}</span>" for c, t in parts) + "</div>"


register("span_page_entries", Suite(
    "span_page", {"departments": ["Art", "First Game"], "legacy": ["^First"], "community_headings": [r"(?i)\bsentinels\b"], "other_language": [["Outside Co", "Actors"]], "characters": [["First Game", ""]]},
    [
        (head("section", 2, "Art") + entry(NAME, "Anim Lead", "Acme"), [row(1, NAME, "Anim Lead", "Art", "Art/#", studio="Acme")]),
        (head("section", 2, "Art") + head("group", 3, "Voice Crew") + entry(NAME), [row(2, NAME, "Voice Crew", "Voice", "Art/Voice Crew#")]),
        (head("section", 2, "Outside Co") + entry(NAME) + entry("", "x @K@"), [row(1, NAME, "", ref="Outside Co/#", studio="Outside Co"), fail(2, "x @K@", "Outside Co/#")]),
        (head("section", 2, "Outside Co") + head("group", 3, "Actors") + entry(NAME), [drop(NAME, "non-english-voice:Outside Co/Actors")]),
        (head("section", 2, "First Game") + entry(NAME, "Hero"), [row(1, NAME, "Hero", "Voice", "First Game/#", character="Hero", cls="legacy")]),
        ('<div class="credits_software_entry__1"><div class="credits_software_name__1">Tool @K@</div></div>', [drop("Tool @K@", "middleware")]),
        (head("section", 2, "Sentinels") + entry(NAME), [row(1, NAME, "", ref="Sentinels/#", studio="Sentinels", cls="community")]),
    ],
    elements("div"),
))


def cells(left: str, right: str = "", style: str = "") -> str:
    return f"<tr><td class='{style}'>{left}</td><td>{right}</td></tr>"


register("sheet_rows", Suite(
    "sheet", {"ranks": {"d": 0, "h": 1, "s": 2}, "vendors": ["Acme"], "cast": ["CAST"]},
    [
        (cells("ART", style="d") + cells("Acme", style="h") + cells("Anim", NAME) + cells("", "Cy @K@ (VOLT)") + cells("Sub", style="s") + cells("x", "Eve @K@") + cells("Other", style="h") + cells("y", "Gil @K@"), [
            row(2, NAME, "Anim", "Art", "ART/Acme#", studio="Acme"), row(3, "Cy @K@", "Anim", "Art", "ART/Acme#", studio="VOLT"),
            row(5, "Eve @K@", "x", "Art", "ART/Sub#", studio="Acme"), row(7, "Gil @K@", "y", "Art", "ART/Other#"),
        ]),
        (cells("CREW", style="d") + cells("CAST", style="h") + cells("Queen", NAME), [row(2, NAME, "Voice Actor", "Voice", "CREW/CAST#", character="Queen")]),
        (cells("ART", style="d") + "<tr><td>odd @K@</td></tr>", [fail(1, "odd @K@", "ART/ART#")]),
        (cells("SPECIAL THANKS", style="d") + cells("Lead", NAME), [row(1, NAME, "Lead", "Leadership", "SPECIAL THANKS/SPECIAL THANKS#", cls="special-thanks")]),
    ],
    elements("tr"), "", "<table>", "</table>",
), Suite(
    # a memorial is the last section of its page
    "sheet", {"ranks": {"d": 0}},
    [(cells("Kay @K@") + cells("1960 - 2010") + "<tr><td>A tribute @K@.</td></tr>", [
        row(0, "Kay @K@", "In loving memory", ref="In loving memory/In loving memory#"), drop("1960 - 2010", "memoriam-date-range"), drop("A tribute @K@.", "in-memoriam-tribute"),
    ])],
    elements("tr"), "", "<table>" + cells("In loving memory", style="d"), "</table>", 1,
))

# --- the script bundle -----------------------------------------------------------

_PAGE = json.dumps({"props": {"credits": {"block-titles": {"one": "First Update", "two": "Second"}, "team": "The Team"}}})
_HEAD = f'<script id="__NEXT_DATA__" type="x">{_PAGE}</script>{bundle.MARKER}a=function(e){{return t("credits.block-titles.one"),'
_FOOT = 'k(0)};b=function(e){return t("credits.block-titles.two"),j("p",{children:["Other One"]})};'


def spoken(block: str, needle: str) -> int:
    """Where a string begins in a block whose names are filled in."""
    return filled(block).index(filled(needle))


_TEAM = 'x({blockTitle:t("credits.team"),areaTitle:"Code"}),j("p",{children:[j("strong",{children:"Engineer"}),"@N@",r,"Cy @K@ (VOLT)"]}),j("p",{children:["Eve @K@"]}),'
_HELP = 'x({blockTitle:"Art by Helper @K@"}),j("p",{children:["Gil \\u0048ay @K@"]}),'
_WORDS = 'x({blockTitle:"Crew"}),j("p",{children:t("credits.some-words")}),'
_ROSTER = 'x({blockTitle:"Sentinels"}),n=["Ida @K@","Kay @K@"],'
_THANKS = 'x({blockTitle:"Special Thanks"}),j("p",{children:["@N@"]}),'
_AT = "First Update/The Team/Code@"
register("bundle_tiers", Suite(
    "bundle", {"release": "first update", "functions": ["The Team", "Special Thanks"]},
    [
        (_TEAM, [
            row(spoken(_TEAM, '"@N@"'), NAME, "Engineer", "Engineering", _AT), row(spoken(_TEAM, '"Cy'), "Cy @K@", "Engineer", "Engineering", _AT, studio="VOLT"),
            row(spoken(_TEAM, '"Eve'), "Eve @K@", "Engineer", "Engineering", _AT),
        ]),
        (_HELP, [row(spoken(_HELP, '"Gil'), "Gil Hay @K@", "Art by Helper @K@", "Art", "First Update/Art by Helper @K@/@", studio="Helper @K@")]),
        (_WORDS, [fail(spoken(_WORDS, '"credits'), "Some Words", "First Update/Crew/@")]),
        (_ROSTER, [row(spoken(_ROSTER, '"Ida'), "Ida @K@", "Sentinels", ref="First Update/Sentinels@", cls="community"), row(spoken(_ROSTER, '"Kay'), "Kay @K@", "Sentinels", ref="First Update/Sentinels@", cls="community")]),
        (_THANKS, [row(spoken(_THANKS, '"@N@"'), NAME, "Special Thanks", ref="First Update/Special Thanks/@", cls="special-thanks")]),
    ],
    len, "", _HEAD, _FOOT, len(_HEAD),
))

# --- indexes generated from pages --------------------------------------------------

_KEY = "lpad(CAST(c_custkey AS VARCHAR), 7, '0')"


def pages_of(spark, d, block, start: str = "", stop: str = ""):
    """docs(game_id, text): a nation's customers in turn, by a column made of key (7 characters) and custkey."""
    c = read(spark, d, "customer").select("c_nationkey", "c_custkey", F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("k"))
    each = c.select(F.concat(F.lit("n"), page_key()).alias("game_id"), F.struct("c_custkey", block(F.col("k"), F.col("c_custkey")).alias("t")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "")
    return each.groupBy("game_id").agg(F.concat(F.lit(start), body, F.lit(stop)).alias("text"))


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_PLACED = f"c AS (SELECT 'n' || {PAGE_KEY} AS g, c_custkey AS o, {_KEY} AS k, row_number() OVER (PARTITION BY {PAGE_KEY} ORDER BY c_custkey) - 1 AS i FROM customer)"


@query("wiki_heading_index", f"""WITH {_PLACED} SELECT g AS game_id, 'L' || (5 * i + x.off + 1) AS source_ref, replace(x.h, '@', k) AS heading
FROM c, (VALUES (1, 'Page @'), (3, 'Page @ / Part A & B'), (4, 'Page @ / Part A & B')) x(off, h)
UNION ALL SELECT g, 'L' || (5 * max(i) + 6), 'Page ' || arg_max(k, i) || ' / Part A & B' FROM c GROUP BY g""")  # fmt: skip
def wiki_heading_index(spark, d):
    """The open headings at each line, links as where they lead to."""
    text = lambda k, _: F.concat(F.lit("== [[Page "), k, F.lit("|shown]] ==\nplain\n==='''Part''' <b>A</b> &amp; B===\n* x\ny\n"))
    # the last line feed begins one more line, which has a heading too
    return indexes.wiki_heading_index(pages_of(spark, d, text, "", ""))


@query("table_heading_index", f"""WITH {_PLACED} SELECT g AS game_id, 'tr' || (3 * i + x.off) AS source_ref, replace(x.h, '@', k) AS heading
FROM c, (VALUES (0, 'One & two @'), (1, 'One & two @'), (2, 'Deep')) x(off, h)""")  # fmt: skip
def table_heading_index(spark, d):
    """For each table row of a page the last heading before it."""
    text = lambda k, _: F.concat(F.lit("<h2 class='x'>One &amp; <i>two</i>\n"), k, F.lit("</h2><tr><td>a</td></tr><TR id=1></TR><h4>Deep</h4><tr></tr>"))
    return indexes.table_heading_index(pages_of(spark, d, text))


@query("page_roles", f"""WITH {_PLACED} SELECT g AS game_id, 'Ann ' || k AS name, CASE WHEN o % 2 = 0 THEN 'Lead | Art & more' ELSE 'Lead' END AS roles FROM c
UNION ALL SELECT g, 'Every One', 'Lead' FROM c GROUP BY 1""")  # fmt: skip
def page_roles(spark, d):
    """Each linked person's roles on a page, in order, without repeats."""
    person = lambda n: F.concat(F.lit('<a href="/person/12/x">'), n, F.lit("</a>"))
    line = lambda role, *who: F.concat(F.lit(f'<tr><td class="text-right">{role}</td><td>'), *who, F.lit("</td></tr>"))

    def text(k, o):
        ann = person(F.concat(F.lit("Ann "), k))
        return F.concat(line("Lead", ann, person(F.lit("Every One"))), F.when(o % 2 == 0, line("Art &amp; <b>more</b>", ann)).otherwise(""), line("Lead", ann), line("", person(F.lit("No Role"))))

    return indexes.explicit_roles(pages_of(spark, d, text))


@query("name_tag_recovery", """SELECT 'Ann ' || c_custkey AS name, CASE c_custkey % 6 WHEN 0 THEN 'Tech Art' WHEN 1 THEN 'Co-op Design' WHEN 2 THEN 'Engineering' ELSE 'QA' END AS tag
FROM customer WHERE c_custkey % 6 < 4""")
def name_tag_recovery(spark, d):
    """The work that credits print behind names: no company, nickname or number, and no line of several people."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Ann "), k.cast("string"))
    tags = F.when(k % 6 == 0, " (VOLT) (Tech Art)").when(k % 6 == 1, " ( Co-op Design )").when(k % 6 == 2, " (12) (Big Staffing) (Engineering) (QA)").when(k % 6 == 3, " (Nick) (QA)").when(k % 6 == 4, " (Acme Inc.)").otherwise(" (Art)")
    names = F.when(k % 6 == 5, F.concat(name, F.lit("|Bo"))).otherwise(F.concat(F.lit(" "), name, F.lit("|")))
    fixes = read(spark, d, "customer").select(F.concat(name, tags).alias("name_raw"), names.alias("names"), k.alias("place"))
    later = fixes.select(F.concat("name_raw", F.lit(" (Later)")).alias("name_raw"), "names", (F.col("place") + 10**9).alias("place"))  # the first of a name wins
    return indexes.name_tags(fixes.where("name_raw not like '%Acme%'").unionByName(fixes.where("name_raw like '%Acme%'")).unionByName(later.where("name_raw not like '%Acme%'")), ["volt", "nick"])


@query("marked_people", """WITH r AS (SELECT c_custkey AS o, 'y' || x.y AS game, CASE WHEN x.y = 2 AND c_custkey % 3 = 0 THEN 'Annabel ' ELSE 'Ann ' END || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN 'same-' || (c_custkey // 10) ELSE 'ann-' || c_custkey END AS ident FROM customer, (VALUES (1), (2)) x(y)),
s AS (SELECT CASE WHEN name LIKE 'Annabel%' AND o % 5 <> 0 THEN 'annabel-' || o ELSE ident END AS ident, name, game, o FROM r)
SELECT ident, arg_max(name, (length(name), -o)) AS name, string_agg(DISTINCT right(game, 1), '|' ORDER BY right(game, 1)) AS cols FROM s GROUP BY 1""")
def marked_people(spark, d):
    """Credits of one standing by alias or slug: the longest spelling and the columns."""
    k = F.col("c_custkey")
    y = F.explode(F.array(F.lit(1), F.lit(2))).alias("y")
    c = read(spark, d, "customer").select("c_custkey", y)
    raw = F.concat(F.when((F.col("y") == 2) & (k % 3 == 0), "Annabel ").otherwise("Ann "), k.cast("string"))
    rows = c.select(F.concat(F.lit("y"), F.col("y").cast("string")).alias("game_id"), raw.alias("name_raw"), k.alias("ord"))
    alias = F.when(k % 5 == 0, F.concat(F.lit("same-"), F.floor(k / 10).cast("string")))
    aliases = c.select(raw.alias("name_variant"), alias.alias("person_id")).dropna().distinct()
    cols = spark.createDataFrame([("y1", 1), ("y2", 2)], "game_id string, col int")
    out = indexes.marked_people(rows, aliases, cols, slug(normalise_name("name_raw")))
    return out.select("ident", "name", F.array_join(F.transform("cols", lambda x: x.cast("string")), "|").alias("cols"))


# --- a parse and all its corrections -------------------------------------------------


@query("corrected_parse", f"""WITH {_PLACED},
r AS (SELECT g, o, i, 'Ann K' || k AS n, k, o % 10 AS m FROM c),
f AS (SELECT g, i, 'A ' || k AS name, '' AS studio, m FROM r WHERE m = 0 UNION ALL SELECT g, i, 'B ' || k, '', m FROM r WHERE m = 0
 UNION ALL SELECT g, i, n, CASE WHEN m = 2 THEN 'Acme' ELSE 'VOLT' END, m FROM r WHERE m > 1),
top AS (SELECT g, max(i) + 1 AS o FROM f GROUP BY 1)
SELECT g AS game_id, 'row' AS kind, CAST(i AS INTEGER) AS credit_order, name AS name_raw, studio, CASE WHEN m = 3 THEN 'publishing' ELSE 'core' END AS inclusion_class, '' AS reason FROM f
UNION ALL SELECT g, 'dropped', -1, '', '', '', 'ruled-not-a-person' FROM r WHERE m = 1 UNION ALL SELECT g, 'row', CAST(o AS INTEGER), 'Late Comer', '', 'special-thanks', '' FROM top""")
def corrected_parse(spark, d):
    """Pages parsed, then names fixed or discarded, companies fixed, rows added, standing overridden."""
    text = lambda k, _: F.concat(F.lit("* Ann K"), k, F.lit(" (VOLT)\n"))
    docs = pages_of(spark, d, text).withColumns({"parser": F.lit("wikitext"), "options": F.lit('{"inline_vendor": true}')})
    k, m = F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.col("c_custkey") % 10
    c = read(spark, d, "customer").select(F.concat(F.lit("n"), page_key()).alias("game_id"), F.concat(F.lit("Ann K"), k).alias("name_raw"), k.alias("k"), m.alias("m"))
    fixes = careers.Corrections(
        names=c.where("m < 2").select("name_raw", F.when(F.col("m") == 0, "fix").otherwise("discard").alias("action"), F.when(F.col("m") == 0, F.concat(F.lit("A "), "k", F.lit("| B "), "k")).otherwise("").alias("names"), F.when(F.col("m") == 0, "-").otherwise("").alias("studio")),
        studios=c.select("name_raw", "game_id", F.when(F.col("m") == 2, "VOLT").otherwise("Other").alias("wrong_studio"), F.lit("Acme").alias("correct_studio"), F.lit("r").alias("reason")),
        curated=c.select("game_id").distinct().select("game_id", F.lit("Late Comer").alias("name_raw"), *(F.lit("").alias(x) for x in ("name_canonical", "category", "role_raw", "character", "studio")), F.lit("core").alias("inclusion_class"), F.lit("c1").alias("source_ref"), F.lit(0).alias("place")),
        overrides=c.where("m = 3").select("game_id", "name_raw", F.lit("publishing").alias("inclusion_class"), F.lit("r").alias("reason")).union(c.select("game_id").distinct().select("game_id", F.lit("Late Comer"), F.lit("special-thanks"), F.lit("r"))),
    )
    out = careers.parse(docs, RULES, fixes)
    return out.select("game_id", "kind", *(F.coalesce(x, F.lit(-1 if x == "credit_order" else "")).alias(x) for x in ("credit_order", "name_raw", "studio", "inclusion_class", "reason")))
