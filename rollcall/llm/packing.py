r"""Packing documents into fixed sequences by cutting-stock column generation.

A document is its token ids and an end id. Documents over the sequence length
are cut into full pieces and a rest. Piece lengths up to 64 of 4096 tokens are classes
of their own; longer ones are rounded up to multiples of 4, and from 512 on of 16 (see
:func:`billed`: at most 400 classes, and under 3 % rounding for any piece on average).
Their histogram, which no input size enlarges, goes to the driver. There a linear program picks
patterns (how many pieces of each class share a sequence): the restricted
master is solved by its basis inverse, and a knapsack dynamic programme over the
dual prices finds the next column until none has a reduced cost. Pattern counts
are rounded down; the pieces left (fewer than classes times pieces a pattern)
fill further patterns by best fit. Pieces are ranked within their class by task
number and by place in the task, so that a class with a third of all pieces is
still ranked in many tasks, and the rank gives the sequence; offsets are running
sums of true lengths in each sequence.

Defined results: null or empty texts have the end id alone; texts of any length are
cut into pieces, none is left out; pieces tied on their class are ranked by task and
place, so repeated rows are packed each; an empty table gives no rows; extra columns
are ignored. The linear program ends at its optimum (no pattern is worth more than
one sequence, by ``WORTH``), however many columns that takes; its demands are moved
apart by less than a piece in all, so that no pivot is degenerate and none returns.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, table

SIZE, END_ID = 4096, 2
WORTH = 1e-6
CACHED, LEFT, CHARS = 800_000, 250_000, 40
BREAK = "<|endoftext|>"


#: Code points that may compose with the letter before them, and all that might; and marks of special tokens.
_UNSURE = r"<\||[\x{300}-\x{1FFF}\x{2070}-\x{10FFFF}]"


def folded(texts: pa.Array) -> pa.Array:
    """ASCII letters in lower case where that is surely the tokenizer's own: no special tokens, nothing that composes."""
    return pc.if_else(pc.match_substring_regex(texts, _UNSURE), texts, pc.ascii_lower(texts))


class Ids:
    """Token ids as little-endian 32-bit bytes, with a cache of space-delimited chunks.

    The tokenizer never joins characters across a space or a line feed, so a text's
    ids are its chunks' ids in turn; the same holds for letters and the signs behind
    them, and case is folded first. Chunks not known yet are encoded in one call
    each batch, parted by a special token. The cache is emptied when full and
    changes no result.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.breaks, self.closes = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.breaks[self.tok.token_to_id(BREAK)] = True
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, chunks: list[str]) -> None:
        """Adds the chunks' ids. Words of small Latin-1 letters go without the signs behind them, which the tokenizer itself takes apart."""
        known, words, others, parted = self.known, set(), set(), []
        for c in chunks:
            stem = c.rstrip(punctuation)
            if not stem.isalpha() or stem != stem.lower() or not (stem.isascii() or max(stem) <= "\xff"):
                others.add(c)
                continue
            if stem not in known:
                words.add(stem)
            if stem is not c:
                signs = c[len(stem) :]
                parted.append((c, stem, signs))
                if signs not in known:
                    others.add(signs)
        # each word of letters ends in one token that closes a word
        words = list(words)
        for i in range(0, len(words), 512):
            self._keep(words[i : i + 512], " ", self.closes, 4, 4)
        for c in [c for c in others if "<|" in c]:
            known[c] = np.array(self.tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            others.discard(c)
        others = list(others)
        for i in range(0, len(others), 512):
            self._keep(others[i : i + 512], BREAK, self.breaks, 0, 4)
        for c, low, signs in parted:
            known[c] = known[low] + known[signs]

    def _keep(self, part: list[str], between: str, parts: np.ndarray, end: int, start: int) -> None:
        """Encodes the chunks together; ``parts`` tells which ids part them, of which a chunk holds the bytes up to ``end``."""
        ids = np.array(self.tok.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(parts[ids]) * 4
        raw, ends = ids.tobytes(), (cuts + end).tolist()
        if not end:
            ends.append(len(raw))
        starts = [0, *(cuts + start).tolist()][: len(ends)]
        self.known.update(zip(part, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))

    def __call__(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Each text's ids. Splitting, distinct chunks and the ids' way back into the texts are columnar."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(folded(pc.fill_null(column, "")), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        every, at = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        new = [c for c in every if c not in self.known]  # a set difference would walk the whole cache
        if len(self.known) + len(new) > CACHED:
            self.known = {"": b""}
            new = [c for c in every if c]
        self._learn(new)
        raw = list(map(self.known.__getitem__, every))
        for c in new:
            if len(c) > CHARS:
                self.known.pop(c, None)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first, n = (np.cumsum(size) - size)[at], size[at]
        stop = np.cumsum(n)
        ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(first - stop + n, n) + np.arange(n.sum())]
        ends = np.concatenate(([0], stop))[split.offsets.to_numpy()].tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            yield ids[a:b].tobytes()

    def trim(self) -> None:
        """Leaves what was learned first, which is what is frequent: idle Python workers hold little."""
        if len(self.known) > LEFT:
            self.known = dict(islice(self.known.items(), LEFT))


@lru_cache(1)
def ids_of(tokenizer: str) -> Ids:
    """One for all tasks of a Python worker; found through the module, as globals of a task's closure are copies."""
    return Ids(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's pieces of at most ``size`` ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, start, length, crc, total = [], [], [], [], []
                for i, raw in enumerate(ids(b.column(1))):
                    raw += end
                    n = len(raw) // 4
                    for a in range(0, n, size):
                        row.append(i), start.append(a), length.append(min(size, n - a)), total.append(n)
                        crc.append(zlib.crc32(raw[a * 4 : (a + size) * 4]))
                cols = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens"])
        ids.trim()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def billed(length, size: int = SIZE):
    """The class of a piece: the tokens it is planned with."""
    exact, middle = max(1, size // 64), size // 8
    fine, coarse = max(1, size // 1024), max(1, size // 256)
    up = lambda step: F.least(F.ceil(length / step) * step, F.lit(size))
    return F.when(length <= exact, length).when(length <= middle, up(fine)).otherwise(up(coarse)).cast("int")


def knapsack(price: np.ndarray, weight: np.ndarray, room: int) -> np.ndarray:
    """Counts of each item that maximise the price within the room; ``weight`` rises."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(weight, np.arange(room + 1), "right").tolist()
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if n := fitting[w]:
            value = best[w - weight[:n]] + price[:n]
            k = int(value.argmax())
            if value[k] > best[w]:
                best[w], pick[w] = value[k], k
    counts, w = np.zeros(len(weight), int), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= weight[pick[w]]
    return counts


def start(weight: np.ndarray, need: np.ndarray, room: int) -> np.ndarray:
    """A first basis: patterns filled largest class first, each used until it exhausts a class.

    The column of a class is the pattern that exhausts it and later columns lack it,
    so the basis is triangular and its solution isn't negative.
    """
    left, basis = need.astype(float), np.zeros((len(weight), len(weight)))
    alive = np.ones(len(weight), bool)
    while alive.any():
        column, free = np.zeros(len(weight)), room
        for k in np.flatnonzero(alive)[::-1]:
            n = min(free // weight[k], max(1, int(left[k])))
            column[k] = n
            free -= n * weight[k]
        held = np.flatnonzero(column)
        ratio = left[held] / column[held]
        k = held[ratio.argmin()]
        left[held] -= ratio.min() * column[held]
        left[k] = 0
        basis[:, k], alive[k] = column, False
    return basis


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots, in plain array steps.

    This and :func:`times` run on the driver, where a threaded LAPACK may wait for its
    own threads for ever beside those of the Java gateway.
    """
    m = len(a)
    both = np.concatenate((a.astype(float), np.eye(m)), axis=1)
    for k in range(m):
        p = k + int(abs(both[k:, k]).argmax())
        if p != k:
            both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        column = both[:, k].copy()
        column[k] = 0
        some = np.flatnonzero(column)
        both[some] -= column[some, None] * both[k]
    return both[:, m:]


def times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, v)


def patterns(demand: dict[int, int], room: int) -> list[tuple[np.ndarray, float]]:
    """Column generation: (pattern over the sorted classes, how often), the linear optimum."""
    weight = np.array(sorted(demand))
    m = len(weight)
    need = np.array([demand[w] for w in weight], float) + np.linspace(0, 1e-3, m) / m
    basis = start(weight, need, room)
    inverse = inverted(basis)
    amount = times(inverse, need)
    since = 0
    while True:
        price = inverse.sum(axis=0)
        column = knapsack(np.maximum(price, 0), weight, room)
        if (price * column).sum() <= 1 + WORTH:
            break
        step = times(inverse, column.astype(float))
        ratio = np.where(step > 1e-7, amount / np.where(step > 1e-7, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        out = int(np.where(ratio <= ratio.min() + 1e-9, step, 0).argmax())  # of tied rows the largest pivot
        basis[:, out] = column
        since += 1
        if since % 40 == 0:
            inverse = inverted(basis)
        else:  # the new column replaces one: a rank-one change of the inverse
            pivot = inverse[out] / step[out]
            inverse = inverse - np.outer(step, pivot)
            inverse[out] = pivot
        amount = np.maximum(times(inverse, need), 0)
    return [(basis[:, j].astype(int), float(amount[j])) for j in range(m)]


def plan(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns ({class: pieces}, how often) that hold exactly the demand."""
    demand = {k: n for k, n in demand.items() if n}
    if not demand:
        return []
    out, left = [], dict(demand)
    order = sorted(demand)
    for column, amount in patterns(demand, room):
        items = {k: int(n) for k, n in zip(order, column, strict=True) if n}
        times = int(amount + 1e-6)
        times = min([times, *(left[k] // n for k, n in items.items())]) if items else 0
        if times > 0:
            out.append((items, times))
            for k, n in items.items():
                left[k] -= n * times
    # best fit of what the rounding left, largest first; rooms[r]: open patterns with that much room
    rooms: dict[int, list[dict[int, int]]] = {}
    wide: list[int] = []  # the rooms there are, rising
    rest: list[dict[int, int]] = []
    for k in sorted(left, reverse=True):
        while left[k]:
            i = bisect_left(wide, k)
            if i == len(wide):
                rest.append(at := {})
                r = room
            else:
                r = wide[i]
                at = rooms[r].pop()
                if not rooms[r]:
                    del rooms[r], wide[i]
            n = min(left[k], r // k)
            left[k] -= n
            at[k] = at.get(k, 0) + n
            if r := r - n * k:
                if r not in rooms:
                    insort(wide, r)
                rooms.setdefault(r, []).append(at)
    return out + [(at, 1) for at in rest]


def slots(planned: list[tuple[dict[int, int], int]], room: int):
    """For each class: sorted first ranks, and for each: pieces a sequence, first sequence, place in it."""
    by: list[list[tuple[int, int, int]]] = [[] for _ in range(room + 1)]
    ranks, sequence = [0] * (room + 1), 0
    for items, times in planned:
        for k, n in items.items():
            by[k].append((ranks[k], n, sequence))
            ranks[k] += n * times
        sequence += times
    return [tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else None for rows in by]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    cut = pieces(docs, tokenizer, id_col, text_col, size)
    cut = cut.withColumn("cls", billed(F.col("length"), size)).withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    cut = checkpointed(cut)
    counts = cut.groupBy("task", "cls").count()
    demand = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum("count").alias("n")).collect()}
    placed = spark.sparkContext.broadcast(slots(plan(demand, size), size))
    earlier = Window.partitionBy("cls").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "cls", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("task", "cls").orderBy("row")) - 1
    ranked = cut.withColumn("local", local).join(first, ["task", "cls"]).select("id", "start", "length", "ids_crc32", "doc_tokens", "cls", (F.col("first") + F.col("local")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = placed.value
        for b in batches:
            cls, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            seq, place = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for k in np.unique(cls):
                of = cls == k
                start, n, sequence = by[k]
                at = np.searchsorted(start, rank[of], "right") - 1
                seq[of] = sequence[at] + (rank[of] - start[at]) // n[at]
                place[of] = (rank[of] - start[at]) % n[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(seq), pa.array(place)], ["id", "start", "length", "ids_crc32", "doc_tokens", "cls", "sequence_id", "place"])

    dealt = ranked.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls int, sequence_id long, place long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "place").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
