r"""Phrase collocation mining over compressed position bitmaps.

Texts are cut to shards of bounded size, one language each. A shard keeps, for each
of its words, a bitmap of the positions where it stands, compressed to the blocks of
8 positions that hold it (block number and 8 bits), as one row of a table; one
empty position parts two pieces, so no phrase is found across them. A phrase's
bitmap, shifted by one and ANDed with the bitmaps of the words in the same blocks,
gives the bitmaps of all phrases one word longer; their popcounts are the shard's
counts. Phrases are extended depth-first, in batches of siblings that bound memory.

Counts are summed over shards by Spark. What can't be frequent is pruned by exact
global counts at three levels: words are counted first and only frequent ones get
ids and keep their bitmaps; pairs are counted next; the depth-first walk then takes
only steps whose pair is frequent. The frequent pairs of a shard come back to it by
the window that sums them, so no table of phrases is sent to every task.

Scores and the rule on longer phrases are joins of the phrase table with itself;
integers are exact (decimals where products may pass 64 bits). A language's first
rows are found among the first rows of many parts of it.

Defined results: a null text is empty, a null language ``und``; an empty text or
table has no phrases; a piece of any length is one shard's whole; repeated rows count
each; ties in score and count go by the phrase's bytes, ties of cuts to the first;
words are whatever stands between spaces and tabs, control characters too; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, small_batches, table, written

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
#: Words that a worker holds before it closes its largest shard.
POSITIONS = 4_000_000
#: AND operations at a time.
STEPS = 1_000_000
#: Parts of a language that are ranked apart before their first rows meet.
PARTS = 256

GAP = b"\xff"  # in no UTF-8 text
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
_ENTRY = np.dtype([("block", "<u4"), ("mask", "u1")])
_ROW = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("bits", pa.binary())])


class Positions:
    """The words of one shard in the order in which they stand; 0 is a gap."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        self.ids[GAP]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        said = text.translate(_BYTES).replace(GAP, b" \xff ").split()
        at = np.fromiter(map(self.ids.__getitem__, said), np.int32, len(said))
        gap = at == 0
        if len(at):
            gap[1:] &= gap[:-1]
            self.parts += [at[~gap], np.zeros(1, np.int32)]
            self.size += len(at)
        return len(at)

    def rows(self, shard: int, lang: str) -> pa.Table:
        """One row a word: its count and its bitmap."""
        at = np.concatenate(self.parts)
        place = np.flatnonzero(at)
        word = at[place]
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        block, bit = (place >> 3).astype(np.uint32), (1 << (place & 7)).astype(np.uint8)
        first = np.ones(len(word), bool)
        first[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(first)
        entry = np.empty(len(start), _ENTRY)
        entry["block"], entry["mask"] = block[start], np.bitwise_or.reduceat(bit, start) if len(start) else bit
        stops = np.concatenate([[0], np.cumsum(np.bincount(word[start], minlength=len(self.ids))[1:])]).astype(np.int32) * _ENTRY.itemsize
        words = pa.array(list(self.ids)[1:], pa.binary()).cast(pa.string())
        bits = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(entry.tobytes())])
        n = np.bincount(word, minlength=len(self.ids))[1:]
        return pa.table([pa.array(np.full(len(words), shard)), pa.array([lang] * len(words), pa.string()), words, pa.array(n), bits], _ROW)


def position_bitmaps(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(shard, lang, word, n, bits): the vertical form of the texts."""
    small_batches(docs.sparkSession)
    limit = POSITIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Positions] = defaultdict(Positions)
        size, numbers = 0, count(TaskContext.get().partitionId() << 32)

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal size
            shard = held.pop(lang)
            size -= shard.size
            if shard.parts:
                yield from shard.rows(next(numbers), lang).to_batches(50_000)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                size += held[lang].add(text.as_py())
                if size >= limit:
                    yield from closed(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield from closed(lang)

    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "shard long, lang string, word string, n long, bits binary")


def _firsts(rising: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, rising[1:] != rising[:-1])) if len(rising) else np.empty(0, np.int64)


def _spread(key: np.ndarray) -> np.ndarray:
    """20 bits of a product hash."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


class Bitmaps:
    """A shard's compressed bitmaps by word and by block; words are numbered by rising id."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.select(["id", "bits"]).sort_by("id").combine_chunks()
        self.ids, bits = rows["id"].to_numpy(), pa.concat_arrays(rows["bits"].chunks or [pa.array([], pa.binary())])
        offsets = np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1) if len(bits) else np.zeros(1, np.int32)
        data = np.frombuffer(bits.buffers()[2] or b"", _ENTRY, int(offsets[-1]) // _ENTRY.itemsize)
        self.word = np.repeat(np.arange(len(bits)), np.diff(offsets) // _ENTRY.itemsize)
        self.block, self.mask = data["block"].astype(np.int64), np.ascontiguousarray(data["mask"])
        by_block = np.argsort(self.block)
        self.in_word, self.in_mask = self.word[by_block], self.mask[by_block]
        blocks = int(self.block.max()) + 2 if len(self.block) else 1
        self.starts = np.searchsorted(self.block[by_block], np.arange(blocks + 1))

    def extended(self, node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(node, word, block, mask) of all one word longer, whole nodes at a time; ``node`` rises."""
        carry = np.flatnonzero(mask >> 7)
        node = np.concatenate([node, node[carry]])
        order = np.argsort(node, kind="stable")  # two rising runs
        node, block, mask = node[order], np.concatenate([block, block[carry] + 1])[order], np.concatenate([mask << 1, np.ones(len(carry), np.uint8)])[order]
        begin = self.starts[block]
        reach = self.starts[block + 1] - begin
        work = np.cumsum(reach)
        shift = begin - (work - reach)
        ends = np.append(np.flatnonzero(node[1:] != node[:-1]) + 1, len(node)) if len(node) else node
        low = 0
        while low < len(node):
            # as many nodes as fit, one at least
            done = work[low - 1] if low else 0
            high = ends[max(np.searchsorted(work[ends - 1], done + STEPS, "right") - 1, np.searchsorted(ends, low, "right"))]
            n = reach[low:high]
            other = np.arange(done, work[high - 1]) + np.repeat(shift[low:high], n)
            both = np.repeat(mask[low:high], n) & self.in_mask[other]
            hit = np.flatnonzero(both)
            own = np.repeat(np.arange(low, high), n)[hit]
            yield node[own], self.in_word[other[hit]], block[own], both[hit]
            low = high

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of the words, counts) of all pairs."""
        for node, word, _, mask in self.extended(self.word, self.block, self.mask):
            key = np.sort(np.repeat(node * len(self.ids) + word, np.bitwise_count(mask)))
            first = _firsts(key)
            n = np.diff(np.append(first, len(key)))
            yield self.ids[np.stack([key[first] // len(self.ids), key[first] % len(self.ids)], 1)], n

    def longer(self, steps: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of the words, counts) of all phrases of three words and more whose pairs are all among ``steps`` (a, b)."""
        local = np.searchsorted(self.ids, steps)
        allowed = np.unique(local[:, 0] * len(self.ids) + local[:, 1])
        rough = np.zeros(1 << 20, bool)  # most steps that aren't allowed fail here
        rough[_spread(allowed)] = True

        def walk(phrases: np.ndarray, node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for node, word, block, mask in self.extended(node, block, mask):
                step = phrases[node, -1] * len(self.ids) + word
                may = np.flatnonzero(rough[_spread(step)])
                at = np.searchsorted(allowed, step[may])
                may = may[allowed[np.minimum(at, len(allowed) - 1)] == step[may]]
                if not len(may):
                    continue
                key = node[may] * len(self.ids) + word[may]
                order = np.argsort(key)
                key, may = key[order], may[order]
                first = _firsts(key)
                grown = np.column_stack([phrases[key[first] // len(self.ids)], key[first] % len(self.ids)])
                if grown.shape[1] > 2:
                    yield self.ids[grown], np.add.reduceat(np.bitwise_count(mask[may]), first, dtype=np.int64)
                if grown.shape[1] < longest:
                    yield from walk(grown, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key)))), block[may], mask[may])

        if len(allowed):
            begins = np.isin(self.word, allowed // len(self.ids))
            yield from walk(np.arange(len(self.ids))[:, None], self.word[begins], self.block[begins], self.mask[begins])


def frequent_words(bitmaps: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id): words that occur often enough, each with a number of its own."""
    f = bitmaps.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return written(f.withColumn("id", F.monotonically_increasing_id()))


def frequent_pairs(kept: DataFrame, least: int) -> DataFrame:
    """(shard, a, b, f): frequent pairs of words, with their counts over all shards, for each shard that has them."""

    def run(rows: pa.Table) -> pa.Table:
        shard, out = rows["shard"][0].as_py(), list(Bitmaps(rows).pairs())
        ids = np.concatenate([np.empty((0, 2), np.int64), *(i for i, _ in out)])
        n = np.concatenate([np.empty(0, np.int64), *(n for _, n in out)])
        return pa.table([pa.array(np.full(len(n), shard)), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(n)], ["shard", "a", "b", "n"])

    each = kept.groupBy("shard").applyInArrow(run, "shard long, a long, b long, n long")
    every = each.withColumn("f", F.sum("n").over(W.partitionBy("a", "b")))
    return every.where(F.col("f") >= least).drop("n")


def longer_phrases(kept: DataFrame, pairs: DataFrame, longest: int, least: int) -> DataFrame:
    """(ids, f): frequent phrases of three words and more, by the depth-first walk of each shard."""
    names = [f"w{i}" for i in range(longest)]

    def run(rows: pa.Table, steps: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[] for _ in names]
        counts = []
        if rows.num_rows and steps.num_rows:
            for ids, n in Bitmaps(rows).longer(np.column_stack([steps["a"].to_numpy(), steps["b"].to_numpy()]), longest):
                counts.append(n)
                for i, c in enumerate(cols):
                    c.append(ids[:, i] if i < ids.shape[1] else np.full(len(n), -1))
        joined = [np.concatenate([np.empty(0, np.int64), *c]) for c in (*cols, counts)]
        return pa.table([pa.array(c) for c in joined], [*names, "n"])

    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    each = kept.groupBy("shard").cogroup(pairs.select("shard", "a", "b").groupBy("shard")).applyInArrow(run, schema)
    f = each.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return f.select(F.filter(F.array(*names), lambda x: x >= 0).alias("ids"), "f")


def exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """phrases(ids, f) as (ids, a, l, r, score) by the lowest-scoring cut; ``known`` (ids, f) holds every part."""
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, F.size("ids")))
    part = lambda key, name: known.select(F.col("ids").alias(key), F.col("f").alias(name))
    both = cuts.join(part("first", "l"), "first").join(part("rest", "r"), "rest")
    score = F.expr("cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.select("ids", F.struct(score.alias("score"), "k", "a", "l", "r").alias("c")).groupBy("ids").agg(F.min("c").alias("c"))
    return best.select("ids", "c.a", "c.l", "c.r", "c.score")


def uncovered(phrases: DataFrame, covered: int) -> DataFrame:
    """phrases(ids, f) without those of which ``covered`` percent or more stand in one longer phrase."""
    size = F.size("ids")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ids", i, n))))
    inside = phrases.where(size > 2).select(F.explode(F.array_distinct(parts)).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("above"))
    left = phrases.join(inside, "ids", "left")
    return left.where(F.col("above").isNull() | (exact(F.col("above")) * 100 < exact(F.col("f")) * covered)).select("ids", "f")


def first_rows(rows: DataFrame, by: str, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of each ``by``, with ``rank``: first of each of its parts, then of those."""
    spread = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = spread.withColumn("rank", F.row_number().over(W.partitionBy(by, "__part").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("__part")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first collocations of 2 to ``longest`` words."""
    spark = docs.sparkSession
    bitmaps = written(position_bitmaps(docs, lang_col, text_col))
    totals = written(bitmaps.groupBy("lang").agg(F.sum("n").alias("n")).coalesce(1))
    words = frequent_words(bitmaps, least)
    kept = written(bitmaps.join(words, ["lang", "word"]).select("shard", "id", "bits"))
    dropped(spark, bitmaps)
    pairs = written(frequent_pairs(kept, least))
    two = pairs.select("a", "b", "f").distinct().select(F.array("a", "b").alias("ids"), "f")
    phrases = two.unionByName(longer_phrases(kept, pairs, longest, least)) if longest > 2 else two
    phrases = written(phrases)
    for t in (kept, pairs):
        dropped(spark, t)
    known = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    best = scored(uncovered(phrases, covered), known)
    each = best.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = each.groupBy("ids", "lang", "a", "l", "r", "score").agg(said.alias("phrase")).join(totals, "lang")
    ranked = first_rows(named, "lang", top, F.desc("score"), F.desc("a"), F.col("phrase"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, doc, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) AS k FROM d),
w AS (SELECT lang, doc, k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT lang, doc, k, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p) x),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY doc, k ORDER BY i)),
c AS (SELECT lang, [w1] AS ids, count(*) AS f FROM g GROUP BY 1, 2 UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST}
 UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST} UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
ph AS (SELECT * FROM c WHERE len(ids) > 1),
sub AS (SELECT lang, ids[i:i + n - 1] AS ids, max(f) AS above FROM ph, (VALUES (2), (3)) ns(n), (VALUES (1), (2), (3)) st(i) WHERE n < len(ids) AND i + n - 1 <= len(ids) GROUP BY 1, 2),
kept AS (SELECT ph.* FROM ph LEFT JOIN sub ON ph.lang = sub.lang AND ph.ids = sub.ids WHERE above IS NULL OR 100 * above::HUGEINT < {COVERED} * ph.f::HUGEINT),
cut AS (SELECT kept.lang, kept.ids, kept.f AS a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * kept.f // (l.f::HUGEINT + r.f) AS BIGINT) AS score FROM kept, (VALUES (1), (2), (3)) ks(k), c l, c r
 WHERE k < len(kept.ids) AND l.lang = kept.lang AND r.lang = kept.lang AND l.ids = kept.ids[1:k] AND r.ids = kept.ids[k + 1:]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) AS pick FROM cut),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT best.lang, array_to_string(ids, ' ') AS phrase, a, l, r, n, score FROM best JOIN n ON best.lang = n.lang WHERE pick = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= {TOP}
"""
