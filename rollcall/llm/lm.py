r"""Language-model scoring: Katz backoff.

Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, then one end token;
before a text's first token stand start marks. Training documents are those whose
crc32 of the id as text isn't 2 modulo 7 (a null id counts as an empty text).

Model, of any ``order``. Counts up to five are discounted by Good-Turing, for each
length of n-gram (the counts of counts come from all training documents; where
these don't give discounts between 0 and 1, fewer counts are discounted, at last
by a constant). A seen n-gram has p(w|h) = d c(h, w) / c(h). What the discounts of
h free is M(h) / c(h) and goes to unseen words by alpha(h) p(w|h'), where h' is h
without its first word and alpha(h) = M(h) / c(h) / (1 - sum of p(w|h') over h's
seen words) makes p(.|h) sum to one exactly; a history whose counts are all over
five keeps 1 / (c(h) + 1) for them. An unseen history leaves p(w|h'). Unigrams are
discounted alike and what is freed is the one unknown word's.

Evaluation. Count tables are parted by the hash of their key (64 bits; words and
n-grams alike), and no table ever meets in one task or on the driver. Documents
are tokenised once into blocks of about ``BLOCK`` tokens, written bucketed by
block. A block sends its distinct n-grams with their counts to those parts of the
tables that hold any of them and gets each one's total back, so a word or n-gram
in a third of all rows is one entry a block. The block that an n-gram's part names
its owner adds it to its history's sums, which are parted and returned in the same
way, order by order, as p(w|h') has to be known; then each token is evaluated from
its longest n-gram down and summed by document. What moves is the distinct keys of
blocks, sorted and delta-coded; blocks themselves stay. Scores are written; blocks
and answers are removed.

Defined results: null and empty texts are the end token alone; texts of any length
are scored whole (one is never split over blocks); repeated rows count each and
are all returned; without training documents each token has probability 1; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, scratch, small_batches, table, words, written

BLOCK = 1_300_000
#: Length of the longest n-grams; see the README on what a longer one costs.
ORDER = 2
#: Tokens for each part of the count tables; at least LEAST parts.
PART, LEAST = 2_500_000, 8
CUTOFF, FOLDS, HELD_OUT = 5, 7, 2
END, START = b" end", b" start"  # with a space: never words


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


# --- blocks ---------------------------------------------------------------


def _blocks(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, index = TaskContext.get().partitionId() << 24, count()

        def fresh():
            return [], [], [], defaultdict(count().__next__)

        def out():
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in local], np.uint64)
            idx = np.concatenate(tokens)
            row = [[first | next(index)], [ids], [np.array(sizes, "<i8").tobytes()], [hashes.tobytes()], [idx.astype("<u4").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["block", "ids", "sizes", "hashes", "tokens"])

        types, total = [pa.int64(), None, pa.binary(), pa.binary(), pa.binary()], 0
        ids, sizes, tokens, local = fresh()
        for b in batches:
            types[1] = pa.list_(b.schema.field(0).type)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = words(text.as_py())
                if not ids:
                    local[START], local[END]  # places 0 and 1
                part = np.empty(len(ws) + 1, np.uint32)
                part[:-1] = np.fromiter(map(local.__getitem__, ws), np.uint32, len(ws))
                part[-1] = 1
                ids.append(doc_id), sizes.append(len(part)), tokens.append(part)
                total += len(part)
                if total >= size:
                    yield out()
                    ids, sizes, tokens, local = fresh()
                    total = 0
        if ids:
            yield out()

    return run, f"block long, ids array<{kind}>, sizes binary, hashes binary, tokens binary"


def _bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, str]:
    """Written to the shared folder, bucketed, so that grouping by ``key`` moves none of it; and the table's name."""
    spark, name = df.sparkSession, f"rollcall_{uuid4().hex}"
    df.write.option("path", f"{scratch(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name), name


# --- keys on the way --------------------------------------------------------


def _pack(a: np.ndarray) -> bytes:
    """Eight-byte numbers with equal bytes together, as compressors like them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorting order of the keys, the parts that have any, where each of these starts, and the end)."""
    order = np.argsort(keys, kind="stable")
    part = ((keys[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    some, first = np.unique(part, return_index=True)
    return order, some, np.append(first, len(keys))


SENT = "q int, block long, keys binary, a binary, b binary"
_SENT = ["q", "block", "keys", "a", "b"]


def _send(block: int, keys: np.ndarray, parts: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.Table:
    order, some, at = _deal(keys, parts)
    rows = [[], [], [], [], []]
    for q, start, stop in zip(some.tolist(), at.tolist(), at[1:].tolist(), strict=False):
        of = order[start:stop]
        for col, x in zip(rows, (q, block, _pack(np.diff(keys[of], prepend=np.uint64(0))), _pack(a[of]), None if b is None else _pack(b[of])), strict=True):
            col.append(x)
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], _SENT)


def _returned(rows: list[tuple[int, bytes]], keys: np.ndarray, parts: int, kind) -> np.ndarray:
    """Values in the keys' order from the parts' answers."""
    order, *_ = _deal(keys, parts)
    out = np.empty(len(keys), kind)
    out[order] = np.concatenate([_unpack(raw, kind) for _, raw in sorted(rows, key=lambda r: r[0])]) if rows else np.empty(0, kind)
    return out


BACK = "block long, kind int, q int, a binary, b binary, stat array<double>"
_BACK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("q", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("stat", pa.list_(pa.float64()))])


def _totals(kind: int):
    """Of one part: sums over blocks, each returned to the blocks that asked. ``kind`` is the n-grams' length, or less one of its histories."""
    histories, words = kind < 0, kind == 1

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        keys = [np.cumsum(_unpack(k.as_py(), np.uint64), dtype=np.uint64) for k in t["keys"]]
        ends = np.cumsum([len(k) for k in keys]).tolist()
        unique, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        del keys
        number = np.float64 if histories else np.uint64
        sums = lambda c: np.bincount(at, np.concatenate([_unpack(x.as_py(), number) for x in t[c]]), len(unique))
        a, b, stat = sums("a"), sums("b") if histories else None, None
        if not histories:
            stat = [a.sum(), float((a > 0).sum()), *(float((a == c).sum()) for c in range(1, CUTOFF + 2))]
            a = a.astype(np.uint64)
        if not histories and not words:  # the lowest bit tells the one block that adds the n-gram to its history
            own = np.zeros(len(at), np.uint64)
            own[first[a > 0]] = 1
            a = a[at] * np.uint64(2) + own
        else:
            a, b = a[at], b[at] if b is not None else None
        q = t["q"][0].as_py()
        rows = []
        for block, start, end in zip(t["block"].to_pylist(), [0, *ends[:-1]], ends, strict=True):
            rows.append((block, kind, q, _pack(a[start:end]), None if b is None else _pack(b[start:end]), stat))
            stat = None
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BACK, strict=True)], schema=_BACK)

    return run


# --- a block's own arrays -----------------------------------------------------


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their histories and last words."""
    with np.errstate(over="ignore"):
        k = h * np.uint64(0x9E3779B97F4A7C15) ^ (w >> np.uint64(29) | w << np.uint64(35))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            k = (k ^ (k >> np.uint64(shift))) * np.uint64(factor)
        return k ^ (k >> np.uint64(31))


class _Block:
    """A block's distinct n-grams of each length k: key[k]; the one that ends at each token: of[k]; history, last word and suffix of each."""

    def __init__(self, row: dict, order: int = 1):
        self.block, self.ids = row["block"], row["ids"]
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        words, tokens = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["tokens"], "<u4")
        self.train = np.array([not held_out(i) for i in self.ids])
        self.learn = np.repeat(self.train, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.key, self.of, self.history, self.word, self.suffix = {1: words}, {1: tokens.astype(np.int64)}, {}, {}, {}
        n, start = len(words), {1: 0}  # start[k]: k start marks
        for k in range(2, order + 1):
            before = np.empty(len(tokens), np.int64)
            before[1:] = self.of[k - 1][:-1]
            before[self.starts] = start[k - 1]
            code, self.of[k] = np.unique(before * n + self.of[1], return_inverse=True)
            self.history[k], self.word[k] = np.divmod(np.append(code, start[k - 1] * n), n)
            self.key[k] = _mixed(self.key[k - 1][self.history[k]], words[self.word[k]])
            start[k] = len(code)
            self.suffix[k] = np.full(len(code) + 1, start[k - 1])
            self.suffix[k][self.of[k]] = self.of[k - 1]
        self.start = start

    def counts(self, k: int) -> np.ndarray:
        return np.bincount(self.of[k], self.learn, len(self.key[k])).astype(np.uint64)

    def histories(self, k: int) -> np.ndarray:
        return np.unique(self.history[k])

    def take(self, back: pa.Table, parts: int) -> None:
        """Totals by kind."""
        rows = defaultdict(list)
        for kind, q, a, b in zip(*(back[c].to_pylist() for c in ("kind", "q", "a", "b")), strict=True):
            rows[kind].append((q, a, b))
        self.c, self.own, self.freed, self.covered = {}, {}, {}, {}
        for kind, got in rows.items():
            k = abs(kind)
            if kind < 0:
                at, size = self.histories(k), len(self.key[k - 1])
                keys = self.key[k - 1][at]
                self.freed[k], self.covered[k] = np.zeros(size), np.zeros(size)
                self.freed[k][at] = _returned([r[:2] for r in got], keys, parts, np.float64)
                self.covered[k][at] = _returned([(q, b) for q, _, b in got], keys, parts, np.float64)
            else:
                total = _returned([r[:2] for r in got], self.key[k], parts, np.uint64)
                if k > 1:
                    self.own[k] = (total & np.uint64(1)).astype(bool)
                    total = total >> np.uint64(1)
                self.c[k] = total.astype(np.float64)

    def before(self, k: int) -> np.ndarray:
        """How often each (k - 1)-gram is a history: as often as it occurs, and start marks as often as ends."""
        c = self.c[k - 1].copy()
        c[self.start[k - 1]] = self.c[1][1]
        return c

    def probability(self, k: int, model: list[Discounts], free: float) -> np.ndarray:
        """p(w|h) of each k-gram: its own, or what backing off to its suffix leaves, down to words."""
        if k == 1:
            return model[0].unigram(self.c[1], free)
        c, freed, h, seen = self.before(k), self.freed[k], self.history[k], self.c[k] > 0
        lower = self.probability(k - 1, model, free)[self.suffix[k]]
        full = freed == 0  # nothing discounted
        mass = np.where(full, 1 / (c + 1), freed / np.maximum(c, 1))
        alpha = np.where(c > 0, mass / np.maximum(1 - self.covered[k], 1e-15), 1.0)
        scale = np.where(full, c / (c + 1), 1.0) / np.maximum(c, 1)
        return np.where(seen, model[k - 1].share(self.c[k]) * scale[h], alpha[h] * lower)


class Discounts:
    """Good-Turing from (N, V, n_1 ... n_6); share(c) is d_c c and unigram(c) a probability."""

    def __init__(self, stat: list[float]):
        self.total, self.types, n = stat[0], stat[1], [0.0, *stat[2:]]
        self.d = np.ones(CUTOFF + 1)
        for k in range(CUTOFF, 0, -1):
            if all(n[1 : k + 2]):
                a = (k + 1) * n[k + 1] / n[1]
                d = [((c + 1) * n[c + 1] / (c * n[c]) - a) / (1 - a) if a < 1 else -1.0 for c in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    self.d[1 : k + 1] = d
                    return
        flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        self.d[1:] = [(c - flat) / c for c in range(1, CUTOFF + 1)]

    def share(self, c: np.ndarray) -> np.ndarray:
        return c * self.d[np.where(c <= CUTOFF, c, 0).astype(np.int64)]

    def unigram(self, c: np.ndarray, free: float) -> np.ndarray:
        """``free``: mass of the unknown word, the sum over all words of c - share(c) over N."""
        if not self.total:
            return np.ones(len(c))
        if not free:  # no count is discounted: the unknown word counts as one more token
            return np.where(c > 0, c, 1) / (self.total + 1)
        return np.where(c > 0, self.share(c) / self.total, free)

    def free(self, n: list[float]) -> float:
        return sum((1 - self.d[c]) * c * n[c - 1] for c in range(1, CUTOFF + 1)) / self.total if self.total else 1.0


def _history_sums(k: int, parts: int, model: list[Discounts], free: float):
    """Of the k-grams that a block owns, what discounts free and what their suffixes' probabilities cover, by history."""

    def run(state: pa.Table, back: pa.Table) -> pa.Table:
        b = _Block(state.to_pylist()[0], k)
        b.take(back, parts)
        n, own, h = len(b.key[k - 1]), b.own[k], b.history[k]
        lower = b.probability(k - 1, model, free)[b.suffix[k]]
        freed = np.bincount(h, np.where(own, b.c[k] - model[k - 1].share(b.c[k]), 0), n)
        covered = np.bincount(h, np.where(own, lower, 0), n)
        at = b.histories(k)
        return _send(b.block, b.key[k - 1][at], parts, freed[at], covered[at])

    return run


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, parts: int, model: list[Discounts], free: float, kind: str):
    def run(state: pa.Table, back: pa.Table) -> pa.Table:
        b = _Block(state.to_pylist()[0], order)
        b.take(back, parts)
        uni = model[0]
        score = np.log10(b.probability(order, model, free))
        base = np.log10((b.c[1] + 1) / (uni.total + uni.types + 1))
        add = lambda x: np.add.reduceat(x, b.starts)
        cols = [
            pa.array(b.ids, state["ids"].type.value_type),
            pa.array(~b.train),
            pa.array(b.sizes),
            pa.array(add((b.c[1] > 0)[b.of[1]].astype(np.int64))),
            pa.array(np.full(len(b.sizes), int(uni.total))),
            pa.array(add(base[b.of[1]])),
            pa.array(add(score[b.of[order]])),
        ]
        return pa.Table.from_arrays(cols, ["id", *(x.split()[0] for x in SCORES.split(", "))])

    return run, f"id {kind}, {SCORES}"


def _each(k: int, parts: int):
    """What each block sends of its k-grams, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row, k)
                yield from _send(block.block, block.key[k], parts, block.counts(k)).to_batches()

    return run


def _stat(back: DataFrame) -> list[float]:
    n = CUTOFF + 3
    row = back.where("stat is not null").agg(*(F.sum(F.col("stat")[i]).alias(f"s{i}") for i in range(n))).first()
    return [float(x or 0) for x in row]


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    make, schema = _blocks(kind, block)
    state, name = _bucketed(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(make, schema), "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens = state.agg(F.sum(F.length("tokens"))).first()[0] or 0
    parts = max(LEAST, tokens // 4 // PART)
    tables, model, free = [], [], 1.0
    for k in range(1, order + 1):
        tables.append(written(state.mapInArrow(_each(k, parts), SENT).groupBy("q").applyInArrow(_totals(k), BACK)))
        stat = _stat(tables[-1])
        model.append(Discounts(stat))
        free = model[0].free(stat[2:]) if k == 1 else free
    back = reduce(DataFrame.union, tables)
    own = lambda k: state.groupBy("block").cogroup(back.where(F.abs("kind") <= k).groupBy("block"))
    for k in range(2, order + 1):
        sums = own(k).applyInArrow(_history_sums(k, parts, model[:k], free), SENT)
        tables.append(written(sums.groupBy("q").applyInArrow(_totals(-k), BACK)))
        back = back.union(tables[-1])
    run, out = _scores(order, parts, model, free, kind)
    done = written(own(order).applyInArrow(run, out))
    for t in (state, *tables):
        dropped(spark, t)
    spark.sql(f"DROP TABLE {name}")
    return done.withColumnRenamed("id", id_col)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
