"""Rule tables of any size, templates of any number, messages of any depth, line tables."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rollcall.operators import report, rules
from rollcall.sources import bundle, wikitext
from rollcall.sources import documents as io
from rollcall.sources.credits import Rules


def test_rule_table_in_blocks(spark, monkeypatch):
    table = [(i, f"^x{i % 40}$" if i % 3 else f"y{i}", f"label{i}") for i in range(90)]
    df = spark.createDataFrame(table, "priority int, pattern string, label string").repartition(3)
    rows = spark.createDataFrame([(f"x{i}",) for i in range(50)] + [("some y33 y3",), ("none",)], "t string")
    want = {t: next((label for _, p, label in table if re.search(p, t)), "Other") for t in [f"x{i}" for i in range(50)] + ["some y33 y3", "none"]}
    for size in (7, 1000):
        monkeypatch.setattr(rules, "BLOCK_RULES", size)
        assert {r.t: r.label for r in rules.first_match_table(rows, "t", df).collect()} == want
    assert {r.label for r in rules.first_match_table(rows, "t", df.limit(0)).collect()} == {"Other"}


def plain_templates(text):
    """Innermost first, to a fixed point."""
    while True:
        new = re.sub(r"\{\{[^{}]*\}\}", lambda m: "\n" * m[0].count("\n"), text)
        if new == text:
            return text
        text = new


def test_templates():
    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice(["{{", "}}", "{{", "}}", "{", "}", "a", "\n", "|b"]) for _ in range(rnd.randrange(14)))
        assert wikitext.without_templates(text).count("\n") == text.count("\n")
        if not re.search(r"(?<!\{)\{(?!\{)|(?<!\})\}(?!\})|\{\{\{|\}\}\}", text):
            assert wikitext.without_templates(text) == plain_templates(text), text
    many = "{{a}}\n" * 100_000
    assert wikitext.without_templates(many) == "\n" * 100_000
    deep = "{{" * 50_000 + "x" + "}}" * 50_000 + "y"
    assert wikitext.without_templates(deep) == "y"


def test_messages_as_the_page_reader_has_them(spark):
    rnd = random.Random(8)

    def tree(depth):
        kind = rnd.randrange(10 if depth else 3)
        if kind < 3:
            return [rnd.choice(["t", "é \"q\"", ""]), rnd.randrange(9), None][kind]
        if kind == 3:
            return [tree(depth - 1) for _ in range(rnd.randrange(3))]
        return {rnd.choice(["credits", "a", "b-c", "d"]): tree(depth - 1) for _ in range(rnd.randrange(1, 5))}

    pages = [(i, f'<p></p><script id="__NEXT_DATA__" x>{json.dumps({"p": tree(6), "q": {"credits": tree(4)}})}</script>') for i in range(60)] + [(60, "no data"), (61, '<script id="__NEXT_DATA__">{bad</script>'), (62, None)]
    got = {}
    for r in io.message_rows(spark.createDataFrame(pages, "id int, t string"), "id", "t").collect():
        got.setdefault(r.id, {}).setdefault(r.path, set()).add(r.message)
    for i, text in pages:
        want = bundle.messages(text or "")
        assert set(got.get(i, {})) == set(want) and all(want[k] in got[i][k] for k in want)
    assert sum(map(len, got.values())) > 30


def test_options_that_are_no_object_raise(spark):
    df = spark.createDataFrame([("g", '{"a": [1, 2], "b": "x"}'), ("h", " "), ("i", None)], "game_id string, options string")
    assert sorted(map(tuple, io.option_rows(df).collect())) == [("g", "a", "ARRAY", "[1,2]"), ("g", "b", "STRING", '"x"')]
    with pytest.raises(Exception, match="aren't an object"):
        io.option_rows(spark.createDataFrame([("g", "[1]")], df.schema)).collect()


def test_line_parser_schema_by_argument(spark):
    io.register_line_parser(spark, Rules([(r"(?i)engineer", "Engineering")], [r"^nobody$"]), "parse_lines_here")
    lines = [("g", "wikitext", "{}", i, x) for i, x in enumerate("===Engineers===\n* Ann Bee\n* nobody\n".split("\n"))]
    df = spark.createDataFrame(lines, "game_id string, parser string, options string, line_no int, line string").repartition(4)
    tagged = spark.sql("SELECT * FROM parse_lines_here(TABLE({t}), 'tagged')", t=df)
    rows = spark.sql("SELECT * FROM parse_lines_here(TABLE({t}), 'rows')", t=df)
    assert "kind" in tagged.columns and "kind" not in rows.columns
    assert [(r.kind, r.name_raw or r.line) for r in tagged.orderBy("kind").collect()] == [("dropped", "nobody"), ("row", "Ann Bee")]
    assert [(r.game_id, r.name_raw, r.source_ref) for r in rows.collect()] == [("g", "Ann Bee", "L2")]
    with pytest.raises(Exception, match="tagged"):
        spark.sql("SELECT * FROM parse_lines_here(TABLE({t}), 'other')", t=df).collect()


def test_cards_fill_their_bars(spark):
    per = spark.createDataFrame([(f"p{i}", "a" if i % 3 else "b", ["qa", "art", "live"][i % 3 if i % 2 else 0]) for i in range(70)] + [("x", "zz", "art")], "name string, game_id string, cls string")
    cards = report.role_cards(per, spark.createDataFrame([("a", 0), ("b", 1)], "game_id string, col int"))
    rows = report.role_rows(cards).orderBy("col", "place").collect()
    for col in (0, 1):
        own = [r for r in rows if r.col == col]
        assert own[0].start == 0 and own[-1].stop == 10_000 and all(a.stop == b.start for a, b in zip(own, own[1:]))
        assert [r.n for r in sorted(own, key=lambda r: r.by_share)] == sorted((r.n for r in own), reverse=True)
    years = report.era_years(spark.createDataFrame([(0, "1995", "A"), (1, "1998-99", "A"), (2, "2001", "B")], "col int, year string, era string"))
    assert {(r.era, r.years) for r in years.collect()} == {("A", "1995–1998-99"), ("B", "2001")}
    assert cards.agg(F.sum("total")).first()[0] == 70
