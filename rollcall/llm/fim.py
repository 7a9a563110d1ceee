r"""Fill-in-middle transformation by relational units.

A text's units are the matches of a pattern (lines, for the query). Their lengths
are exploded with their places, a window sums them to the place where each unit
ends, the documents' cut requests (how many units the prefix and the prefix with
the middle have) are joined by place, the two offsets are gathered by document, and
three substrings give prefix, middle and suffix. Where a request falls is a hash of
the id alone, so it is the same in every run and on every cluster.

Rows are known by an MD5 of id and text, so that rows which are wholly alike share
one list of units. Lengths cross the shuffle as one array a row (four bytes a unit);
texts cross it once, to meet their offsets. The window, the requests' join and the
gathering all keep to that one dealing by row, whose keys are distinct: no hot key.

Forms: ``psm`` is mark P, prefix, mark S, suffix, mark M, middle; ``spm`` is mark S,
suffix, mark P, prefix, mark M, middle; ``plain`` is the text itself, for empty
texts, for those that hold a mark and for those outside the rate.

Defined results: a null text is empty (plain, no units); a null id counts as an
empty one; text between units, if the pattern leaves any, isn't lost by whole-text
patterns only, so a pattern must cover the text (lines do); texts of any length are
cut whole, up to the 2 GB of one value; repeated rows are all returned, with equal
results; both cuts may fall on one place (an empty middle) and on the ends; an empty
table gives no rows; other columns pass through, except those named like a result,
which it replaces.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, table

LINE = r"[^\n]*\n|[^\n]+"
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class Marks:
    """The strings before the three parts. None may begin as another ends, so that each is found again where it was put."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if len(set(astuple(self))) < 3 or "" in astuple(self):
            raise ValueError("marks are three different strings")
        for a, b in product(astuple(self), repeat=2):
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def drawn(id_col: Column, seed: int) -> list[Column]:
    """Four numbers from the id: the first groups of eight hex digits of a SHA-256 of seed and id."""
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(said, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def unit_ends(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, sizes: array of unit lengths) as (key, ord, stop): where the first ``ord`` units end, from 0 units on."""
    each = rows.select(key, F.posexplode(F.concat(F.array(F.lit(0)), "sizes")).alias("ord", "size"))
    running = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return each.select(key, "ord", F.sum("size").over(running).alias("stop"))


def cut_offsets(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, sizes, first, second) as (key, n, a, b): the requests ``first`` and ``second``, in units, as code points.

    Place is a condition and not a key of the join: its sides are dealt by row already.
    """
    asked = rows.select(F.col(key).alias("__asked"), F.size("sizes").cast("long").alias("n"), "first", "second")
    met = unit_ends(rows, key).join(asked, (F.col(key) == F.col("__asked")) & ((F.col("ord") == F.col("first")) | (F.col("ord") == F.col("second"))))
    at = lambda place, name: F.max(F.when(F.col("ord") == F.col(place), F.col("stop"))).alias(name)
    return met.groupBy(key).agg(F.max("n").alias("n"), at("first", "a"), at("second", "b"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, rate: int = 100, spm: int = 50, marks: Marks = Marks()) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (null if plain) and output.

    Of 100 texts ``rate`` are cut, and of 100 of those ``spm`` put the suffix first.
    """
    key, text, stays = fresh([*docs.columns, *RESULTS, "sizes", "first", "second", "a", "b", "ord", "stop", "cut"], "__key", "__text", "__stays")
    h1, h2, h3, h4 = drawn(F.col(id_col), seed)
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(text, F.coalesce(text_col, F.lit(""))).withColumn(key, F.md5(F.concat(F.length(own).cast("string"), F.lit(":"), own, text)))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(unit), F.lit(0)), F.length)
    places = F.size("sizes") + 1
    rows = keyed.select(key, h1.alias("h1"), h2.alias("h2"), sizes.alias("sizes"))
    rows = rows.select(key, F.least(F.col("h1") % places, F.col("h2") % places).cast("int").alias("first"), F.greatest(F.col("h1") % places, F.col("h2") % places).cast("int").alias("second"), "sizes")
    rows = rows.groupBy(key).agg(F.first(F.struct("first", "second", "sizes")).alias("r")).select(key, "r.*")
    offsets = cut_offsets(rows, key)
    whole = F.col(text)
    holds = [F.contains(whole, F.lit(m)) for m in astuple(marks)]
    full = keyed.join(offsets.select(F.col(key), *(F.col(c).alias(f"{key}_{c}") for c in "nab")).hint("shuffle_hash"), key)
    n, a, b = (F.col(f"{key}_{c}") for c in "nab")
    full = full.withColumn(stays, (whole == "") | holds[0] | holds[1] | holds[2] | (h3 % 100 >= rate))
    part = lambda start, length=None: F.substring(whole, (start + 1).cast("int"), F.lit(2**31 - 1) if length is None else length.cast("int"))
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b)
    p, s, m = map(F.lit, astuple(marks))
    form = F.when(F.col(stays), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    cut = lambda c: F.when(~F.col(stays), c.cast("long"))
    output = F.when(F.col(stays), whole).when(h4 % 100 < spm, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    return full.select(*(F.col(f"`{c}`") for c in kept), n.alias("n"), form.alias("form"), cut(a).alias("prefix_chars"), cut(b - a).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column, marks: Marks = Marks()) -> Column:
    """The text, from output and form alone."""
    p, s, m = astuple(marks)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    body = before(output, m)  # all but the mark and text of the middle
    psm = F.concat(after(before(body, s), p), after(output, m), after(body, s))
    spm = F.concat(after(body, p), after(output, m), after(before(body, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
