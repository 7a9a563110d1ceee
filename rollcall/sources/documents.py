"""Frozen pages in, credit rows and audit rows out.

Parsing is one pass of Python over documents, each of which is parsed by itself
(``mapInArrow``; a table function does the same in SQL). One tagged frame holds
rows, drops and unparsed lines; sinks filter it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import bundle, pages, wikitext
from .credits import FIELDS, Rules

PARSERS: dict[str, Callable[[str, dict, Rules], list[dict]]] = {
    "wikitext": wikitext.parse,
    "credit_table": pages.credit_table,
    "two_pane": pages.two_pane,
    "span_page": pages.span_page,
    "sheet": pages.sheet,
    "bundle": bundle.parse,
}

_COLUMNS = ["kind", *FIELDS, "line", "reason"]
SCHEMA = "game_id string, kind string, " + ", ".join(f"{c} {'int' if c == 'credit_order' else 'string'}" for c in [*FIELDS, "line", "reason"])


def parse_one(text: str, parser: str, options: str | None, rules: Rules) -> list[dict]:
    if parser not in PARSERS:
        raise ValueError(f"unknown parser {parser!r}; there are {sorted(PARSERS)}")
    return PARSERS[parser](text or "", json.loads(options or "{}"), rules)


def parse_documents(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs(game_id, parser, options, text): the tagged frame of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for game, parser, options, text in zip(*(b.column(i) for i in range(4)), strict=True):
                got = parse_one(text.as_py(), parser.as_py(), options.as_py(), rules)
                cols = [pa.array([e.get(c) for e in got], pa.int32() if c == "credit_order" else pa.string()) for c in _COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array([game.as_py()] * len(got), pa.string()), *cols], ["game_id", *_COLUMNS])

    return docs.select("game_id", "parser", "options", "text").mapInArrow(run, SCHEMA)


def register_udtf(spark: SparkSession, rules: Rules, name: str = "parse_credits") -> None:
    """The same as a table function: ``SELECT ... FROM docs, LATERAL parse_credits(text, parser, options)``."""
    from pyspark.sql.functions import udtf

    class ParseCredits:
        def eval(self, text: str, parser: str, options: str):
            for e in parse_one(text, parser, options, rules):
                yield tuple(e.get(c) for c in _COLUMNS)

    spark.udtf.register(name, udtf(ParseCredits, returnType=SCHEMA.removeprefix("game_id string, ")))


def register_line_parser(spark: SparkSession, rules: Rules, name: str = "parse_lines") -> None:
    """The same over a table of lines: ``SELECT * FROM parse_lines(TABLE(lines), 'tagged')``.

    The table holds game_id, parser, options, line_no, line. Spark deals it by page and
    sorts it by line, as the function asks for when the query is analysed, so callers
    needn't build a string a page; the second argument says what comes out and so the
    schema: 'tagged' (rows, drops and unparsed lines) or 'rows' (credits alone).
    """
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

    tagged = StructType.fromDDL(SCHEMA)
    credits = StructType([f for f in tagged if f.name not in ("kind", "line", "reason")])

    class ParseLines:
        def __init__(self) -> None:
            self.page, self.lines, self.output = None, [], "tagged"

        @staticmethod
        def analyze(lines: AnalyzeArgument, output: AnalyzeArgument) -> AnalyzeResult:
            if output.value not in ("tagged", "rows"):
                raise ValueError(f"parse_lines gives 'tagged' or 'rows', not {output.value!r}")
            return AnalyzeResult(schema=tagged if output.value == "tagged" else credits, partitionBy=[PartitioningColumn("game_id")], orderBy=[OrderingColumn("line_no")])

        def eval(self, row, output: str) -> None:
            self.page, self.output = (row["game_id"], row["parser"], row["options"]), output
            self.lines.append(row["line"] or "")

        def terminate(self):
            if self.page is None:
                return
            game, parser, options = self.page
            for e in parse_one("\n".join(self.lines), parser, options, rules):
                if self.output == "tagged":
                    yield (game, *(e.get(c) for c in _COLUMNS))
                elif e["kind"] == "row":
                    yield (game, *(e.get(c) for c in FIELDS))

    spark.udtf.register(name, udtf(ParseLines))


class Items:
    """Table function body: the text of each element of one tag, in order, with end tags that pages leave out."""

    def eval(self, html: str, tag: str):
        from .html import parse_html

        for n, node in enumerate(parse_html(html or "").find(tag)):
            yield n, node.text()


def register_items(spark: SparkSession, name: str = "html_elements") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Items, returnType="n int, item string", useArrow=True))


class Written:
    """Table function body: the source inside each element of one tag, in order, entities and markup as they stand."""

    def eval(self, html: str, tag: str):
        from .html import written

        yield from enumerate(written(html or "", tag))


def register_written(spark: SparkSession, name: str = "html_written") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Written, returnType="n int, source string", useArrow=True))


# --- readers --------------------------------------------------------------------

CREDITS = "game_id string, credit_order int, name_raw string, name_canonical string, category string, role_raw string, character string, studio string, inclusion_class string, source_ref string"
TABLES = {
    "games": "game_id string, title string, year int, sequence int, type string",
    "sources": "game_id string, parser string, url string, raw_path string, options string",
    "aliases": "name_variant string, person_id string",
    "reviews": "person_id string, ruling string",
    "name_fixes": "name_raw string, action string, names string, studio string",
    "studio_fixes": "name_raw string, game_id string, wrong_studio string, correct_studio string, reason string",
    "inclusion_overrides": "game_id string, name_raw string, inclusion_class string, reason string",
    "studio_classes": "studio string, class string",
    "vendor_types": "studio string, type string",
    "headings": "game_id string, source_ref string, heading string",
    "name_tags": "name string, tag string",
    "explicit_roles": "game_id string, name string, roles string",
    "studio_only": "game_id string, studio string, role string, type string",
    "rules": "pattern string, label string, note string",
}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with doubled quotes; blank is the empty string, never null."""
    df = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.na.fill("")


def read_table(spark: SparkSession, name: str, path: str, optional: bool = False) -> DataFrame:
    """One of TABLES; a missing optional file is an empty table."""
    try:
        return read_csv(spark, path, TABLES[name])
    except Exception as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], TABLES[name])
        raise


def read_credits(spark: SparkSession, folder: str, inclusion: list[str] | None = ("core",)) -> DataFrame:
    """Credit rows with ``ord``: (file name with its suffix, row), the order in which files are read."""
    df = read_csv(spark, f"{folder}/*.csv", CREDITS)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = df.withColumn("__f", name).withColumn("ord", F.struct(F.col("__f").alias("file"), F.monotonically_increasing_id().alias("row"))).drop("__f")
    return df if inclusion is None else df.where(F.col("inclusion_class").isin(*inclusion))


def read_curated(spark: SparkSession, folder: str) -> DataFrame:
    """Curated rows, one file a release, whose name is the key."""
    schema = ", ".join(c for c in CREDITS.split(", ") if c.split()[0] not in ("game_id", "credit_order"))
    key = F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    return read_csv(spark, f"{folder}/*.csv", schema).withColumn("game_id", key).withColumn("place", F.monotonically_increasing_id())


def read_rules(spark: SparkSession, path: str, labels: list[str] | None = None) -> list[tuple[str, str]]:
    """Ordered (pattern, label) of a rule file, blanks and unknown labels left out; rule files are small."""
    rows = read_table(spark, "rules", path).coalesce(1).toLocalIterator()
    return [(r.pattern, r.label) for r in rows if r.pattern and r.label and (labels is None or r.label in labels)]


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """One pattern a line; blank lines and comments left out."""
    return [r.value for r in spark.read.text(path).coalesce(1).toLocalIterator() if r.value.strip() and not r.value.startswith("#")]


def read_json(path: str) -> dict | list:
    """Editorial texts of a report: a small file, read where the report is put together."""
    from pathlib import Path

    return json.loads(Path(path).read_text("utf-8"))


def read_frozen(spark: SparkSession, root: str, sources: DataFrame, games: DataFrame) -> DataFrame:
    """docs(game_id, sequence, parser, options, text): each source's frozen file, whole. A source without its game or file raises."""
    files = spark.read.text(f"{root}/*/*", wholetext=True)
    return with_texts(sources, games, files.select(F.url_decode(F.input_file_name()).alias("raw_path"), F.col("value").alias("text")))


def land(pages: DataFrame, path: str) -> None:
    """pages(raw_path, text) as a table: the landing zone of sources too many for a file each."""
    pages.select("raw_path", "text").write.mode("overwrite").parquet(path)


def read_landed(spark: SparkSession, path: str, sources: DataFrame, games: DataFrame) -> DataFrame:
    """:func:`read_frozen` from the table of :func:`land`."""
    return with_texts(sources, games, spark.read.schema("raw_path string, text string").parquet(path))


def with_texts(sources: DataFrame, games: DataFrame, files: DataFrame) -> DataFrame:
    """Sources with their game's sequence and their text, by the last two parts of ``raw_path``; what lacks either raises."""
    at = F.array_join(F.slice(F.split("raw_path", "/"), -2, 2), "/").alias("at")
    out = sources.withColumn("at", at).join(games.select("game_id", "sequence"), "game_id", "left").join(files.select(at, "text"), "at", "left")
    lacks = F.raise_error(F.concat(F.lit("no game or no frozen file for "), F.col("game_id")))
    return out.select("game_id", "sequence", "parser", "options", F.when(F.col("sequence").isNull() | F.col("text").isNull(), lacks).otherwise(F.col("text")).alias("text"))


def wikitext_of(payload: str) -> Column:
    """The wiki markup inside an API answer; an answer that is an error raises."""
    code = F.get_json_object(payload, "$.error.code")
    bad = F.raise_error(F.concat(F.lit("wiki API error: "), F.coalesce(code, F.lit("unknown"))))
    return F.when(F.get_json_object(payload, "$.error").isNotNull(), bad).otherwise(F.get_json_object(payload, "$.parse.wikitext"))


def message_rows(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, message): all texts below any object ``credits`` of the pages' data, by dotted path, as :func:`.bundle.messages` reads them page by page.

    The data is a VARIANT, and a recursive query opens one level of all pages at a time:
    as many steps as the deepest page has levels, whatever the number of pages. Spark
    stops recursions at a number of rows that is meant for runaway ones; depth bounds
    this one, so the session's limit is lifted.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    data = pages.select(F.col(key).alias("page"), F.regexp_extract(text, bundle.PAGE_DATA, 1).alias("js"))
    rows = spark.sql(
        """WITH RECURSIVE t(page, path, v) MAX RECURSION LEVEL 500 AS (
        SELECT page, '' AS path, try_parse_json(js) AS v FROM {data}
        UNION ALL
        SELECT t.page, CASE WHEN t.path <> '' THEN concat(t.path, '.', e.key) WHEN e.key = 'credits' AND startswith(schema_of_variant(e.value), 'OBJECT<') THEN 'credits' ELSE '' END, e.value
        FROM t, LATERAL variant_explode(t.v) AS e WHERE t.path = '' OR e.key IS NOT NULL)
        SELECT page, path, CAST(v AS STRING) AS message FROM t WHERE path <> '' AND schema_of_variant(v) = 'STRING'""",
        data=data,
    )
    return rows.withColumnRenamed("page", key)


def option_rows(sources: DataFrame, key: str = "game_id", options: str = "options") -> DataFrame:
    """(key, option, kind, value): each option of each source, by its kind and as JSON; blank options are none, and text that isn't an object raises."""
    held = F.when(F.coalesce(F.trim(options), F.lit("")) == "", F.lit("{}")).otherwise(F.col(options))
    v = F.parse_json(held)
    whole = F.when(F.schema_of_variant(v).startswith("OBJECT<"), v).otherwise(F.raise_error(F.concat(F.lit("options of a source aren't an object: "), held)).cast("variant"))
    each = sources.sparkSession.sql("SELECT k, e.key AS option, e.value AS v FROM {src}, LATERAL variant_explode(o) AS e", src=sources.select(F.col(key).alias("k"), whole.alias("o"))).withColumnRenamed("k", key)
    return each.select(key, "option", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).alias("kind"), F.to_json("v").alias("value"))


def script_address(page: Column, pattern: str) -> Column:
    """The address of a page's script, which ``pattern`` finds as its group; a page that names none raises."""
    found = F.regexp_extract(page, pattern, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.lit("the page names no credits script")))


def two_parts(page: Column, script: Column) -> Column:
    """Page, marker and script as one text."""
    return F.concat_ws("\n", page, F.lit(bundle.MARKER), script)


def parts_of(text: Column) -> tuple[Column, Column]:
    """(page, script) of :func:`two_parts`."""
    cut = F.lit(f"\n{bundle.MARKER}\n")
    place = F.instr(text, cut)
    return F.substring(text, F.lit(1), place - 1), F.substring(text, place + F.length(cut), F.length(text))


# --- freezing: on the driver, before Spark starts -----------------------------------


def http_get(url: str) -> str:
    """The page as strict UTF-8: a damaged one fails here and not in a name."""
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": "rollcall/0.1"})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return answer.read().decode("utf-8", "strict")


def script_url(page: str, origin: str, pattern: str) -> str:
    """The address of the page's script: ``pattern`` is the site's, with the address as its group."""
    import re

    m = re.search(pattern, page)
    if not m:
        raise ValueError("the page names no credits script")
    return origin + m[1]


def freeze(url: str, parser: str, path: str, get: Callable[[str], str] = http_get, options: dict | None = None) -> bool:
    """Writes a source's text as it came; False without a url.

    Bundles are page, marker and script, whose address the option ``script`` finds; wikis the markup in the answer.
    """
    from pathlib import Path
    from urllib.parse import urlsplit

    if not url:
        return False
    text = get(url)
    if parser == "bundle":
        parts = urlsplit(url)
        text = f"{text}\n{bundle.MARKER}\n{get(script_url(text, f'{parts.scheme}://{parts.netloc}', (options or {})['script']))}"
    elif parser == "wikitext":
        data = json.loads(text)
        if "error" in data:
            raise ValueError(f"wiki API error: {data['error'].get('code', 'unknown')}")
        text = data["parse"]["wikitext"]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8", newline="\n")
    return True


# --- sinks -----------------------------------------------------------------------


def write_credits(rows: DataFrame, path: str) -> None:
    """CSV by release, in credit order."""
    rows.select(*[c.split()[0] for c in CREDITS.split(", ")]).repartition("game_id").sortWithinPartitions("game_id", "credit_order").write.mode("overwrite").partitionBy("game_id").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_facts(rows: DataFrame, path: str) -> None:
    """Parquet by class and release, in credit order; releases that ``rows`` hold are replaced and others stay.

    Rows are dealt by ranges of the order, so a large release is several tasks, whose
    files stand in order by name.
    """
    cols = [c.split()[0] for c in CREDITS.split(", ")]
    keys = ["inclusion_class", "game_id", "credit_order"]
    rows.select(*cols).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("inclusion_class", "game_id").parquet(path)


def read_facts(spark: SparkSession, path: str, inclusion: list[str] | None = ("core",), games: list[str] | None = None) -> DataFrame:
    """Facts of :func:`write_facts` with ``ord`` (file of the release, part, row), in which they were written; only wanted classes and releases are opened."""
    df = spark.read.schema(CREDITS).parquet(path)
    if inclusion is not None:
        df = df.where(F.col("inclusion_class").isin(*inclusion))
    if games is not None:
        df = df.where(F.col("game_id").isin(*games))
    return df.withColumn("ord", F.struct(F.concat("game_id", F.lit(".csv")).alias("file"), F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row")))


def write_parse(tagged: DataFrame, path: str) -> dict[str, int]:
    """The tagged frame as Parquet by kind and release; the counts of that one pass: rows, dropped, unparsed, and what corrections changed."""
    seen = Observation()
    n = lambda c, name: F.count_if(c).alias(name)
    kinds = [n(F.col("kind") == k, name) for k, name in (("row", "rows"), ("dropped", "dropped"), ("unparsed", "unparsed"))]
    changes = [n(F.col(c), c) for c in tagged.columns if c.endswith("_changed")]
    tagged.observe(seen, *kinds, *changes).write.mode("overwrite").partitionBy("kind", "game_id").parquet(path)
    return seen.get


def write_people(people: DataFrame, path: str) -> None:
    """One CSV by person id; lists joined by '|'."""
    flat = people.withColumn("variants", F.concat_ws("|", "variants")).withColumn("games", F.concat_ws("|", "games"))
    flat.orderBy("person_id").coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_mart(mart: DataFrame, path: str, *order: str) -> None:
    """A small result as one CSV."""
    mart.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_audit(tagged: DataFrame, path: str) -> None:
    """Two tab-separated logs by release: dropped (line, reason) and unparsed (ref, line)."""
    for kind, cols in (("dropped", ["line", "reason"]), ("unparsed", ["source_ref", "line"])):
        tagged.where(F.col("kind") == kind).select("game_id", *cols).write.mode("overwrite").partitionBy("game_id").csv(f"{path}/{kind}", sep="\t", header=True)
