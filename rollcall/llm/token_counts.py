r"""Token counts by trie-shared dynamic programming.

A unigram model scores a segmentation by the sum of its pieces' log-probabilities
and the best one gives the token count. Pieces are those of a public vocabulary
file, which is only read. Their probabilities are estimated from the documents:
each piece's count over all words as that file's own tokenizer cuts them, plus one,
over the sum; a character without a piece falls back to its UTF-8 bytes, which are
counted alike. Ties go to fewer tokens.

Pre-tokens are words ``[^\x20\x09-\x0D]+`` behind the vocabulary's word mark. The
distinct new ones of a batch are sorted, which is the order of a walk through their
trie, depth first: the nodes on the path to a word hold the forward score
(log-probability and tokens) of their prefix, the next word leaves the path where it
parts and grows it from there, and the score at its end is its terminal count. So a
prefix that words of a batch share is scored once, and a node costs two numbers. A
worker keeps terminal counts, so a word it has met isn't walked to again; beyond
``CACHED`` words it starts anew. A document's count is the sum over its words. Words
over ``LONG`` characters are scored apart, in a window as long as the longest piece.
None of this changes a result.

Two passes over the documents: one for the model (a count a piece leaves each
task), one for the counts. Nothing else is shuffled.

Defined results: null and empty texts have no tokens; texts and words of any length
are counted whole; repeated rows count each and are all returned; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
CACHED, LEFT, KEPT_BYTES = 1_000_000, 200_000, 64
LONG = 1_000
#: Pieces of this length or more are looked for only behind their last characters; shorter ones always.
ENDING = 4
SHORT = tuple(range(2, ENDING))
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def split_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the word at each place or -1 between two spaces, each text's end among the places)."""
    _, offsets, data = pa.concat_arrays([pc.fill_null(column.cast(pa.string()), "")]).buffers()
    raw = b"" if data is None else data.to_pybytes().translate(_SPACES)
    split = pc.split_pattern(pa.StringArray.from_buffers(len(column), offsets, pa.py_buffer(raw)), " ")
    chunks = split.flatten().cast(pa.binary()).dictionary_encode()
    every, at = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
    if b"" in every:
        empty = every.index(b"")
        every[empty], last = every[-1], len(every) - 1
        every.pop()
        at = np.where(at == empty, -1, np.where(at == last, empty, at))
    return every, at, split.offsets.to_numpy()


@dataclass
class Pieces:
    """Log-probability of each piece, and of each byte that stands for itself."""

    score: dict[str, float]
    byte: list[float]
    sizes: dict[str, list[int]] = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.score), default=1)
        ends: dict[str, set] = {}  # by their last ENDING characters: how long pieces are
        for p in self.score:
            if len(p) >= ENDING:
                ends.setdefault(p[-ENDING:], set()).add(len(p))
        self.sizes = {k: sorted(v) for k, v in ends.items()}
        #: Characters whose own piece is clearly likelier than their bytes.
        self.one_wins = {c for c, s in self.score.items() if len(c) == 1 and s > self.bytes_of(c)[0] + 1e-6}

    def single(self, ch: str, best: float, used: int) -> tuple[float, int]:
        """A character behind a prefix: the better of its own piece, if there is one, and its bytes."""
        s, size = self.bytes_of(ch)
        spelt, own = (best + s, used + size), self.score.get(ch)
        if own is None:
            return spelt
        whole = best + own, used + 1
        return spelt if spelt[0] > whole[0] or spelt[0] == whole[0] and spelt[1] < whole[1] else whole

    def bytes_of(self, ch: str) -> tuple[float, int]:
        raw = ch.encode("utf-8", "replace")
        return sum(self.byte[b] for b in raw), len(raw)


@lru_cache(1)
def tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def model_of(path: str, counts: dict[int, int]) -> Pieces:
    """From counts by piece number."""
    sp = tokenizer(path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    total = math.log(sum(counts.get(i, 0) + 1 for i in ids))
    score, byte = {}, [-total] * 256
    for i in ids:
        p, piece = math.log(counts.get(i, 0) + 1) - total, sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(piece[3:5], 16)] = p  # <0xHH>
        else:
            score[piece] = p
    return Pieces(score, byte)


def piece_counts(docs: DataFrame, model: str, text_col: str = "text") -> dict[int, int]:
    """How often each piece of the vocabulary occurs in all words of all documents: a bounded number of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, total = tokenizer(model), None
        for b in batches:
            every, at, _ = split_words(b.column(0))
            n = np.bincount(at[at >= 0], minlength=len(every))
            cut = sp.encode([w.decode("utf-8", "replace") for w in every], num_threads=1)
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            ids = np.fromiter(chain.from_iterable(cut), np.int64, int(sizes.sum()))
            part = np.bincount(ids, np.repeat(n, sizes), sp.get_piece_size()).astype(np.int64)
            total = part if total is None else total + part
        if total is not None:
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["piece", "n"])

    small_batches(docs.sparkSession)
    got = docs.select(F.col(text_col)).mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got["piece"].to_pylist(), got["n"].to_pylist(), strict=True))


class Trie:
    """Pre-tokens by their prefixes, each a node with its best score and that one's tokens."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.path, self.top, self.fewest = "", [0.0], [0]

    def tokens(self, raw: str) -> int:
        """The word's terminal count; of words in rising order each shared prefix is scored once."""
        n, path, best, used = len(raw), self.path, self.top, self.fewest
        if n > LONG:
            return self.apart(raw)
        low, most = 0, min(n, len(path))
        while low < most and raw[low] == path[low]:
            low += 1
        del best[low + 1 :], used[low + 1 :]
        self.path = raw
        score, sizes, sure = self.pieces.score.get, self.pieces.sizes.get, self.pieces.one_wins
        top, fewest = best[low], used[low]
        for end in range(low + 1, n + 1):
            ch = raw[end - 1]
            if ch in sure:
                top, fewest = top + score(ch), fewest + 1
            else:
                top, fewest = self.pieces.single(ch, top, fewest)
            for size in (*SHORT, *sizes(raw[end - ENDING : end], ())) if end >= ENDING else SHORT:
                if size > end:
                    break
                s = score(raw[end - size : end])
                if s is not None:
                    s += best[end - size]
                    if s > top or s == top and used[end - size] + 1 < fewest:
                        top, fewest = s, used[end - size] + 1
            best.append(top), used.append(fewest)
        return fewest

    def apart(self, raw: str) -> int:
        """The same without nodes, for words that no other begins with."""
        pieces, keep = self.pieces, self.pieces.longest + 1
        best, used, first = [0.0], [0], 0  # of prefixes first, first + 1, ...
        for end, ch in enumerate(raw, 1):
            s, size = pieces.bytes_of(ch)
            top, fewest = best[-1] + s, used[-1] + size
            for start in range(max(0, end - pieces.longest), end):
                s = pieces.score.get(raw[start:end])
                if s is not None:
                    s += best[start - first]
                    if s > top or s == top and used[start - first] + 1 < fewest:
                        top, fewest = s, used[start - first] + 1
            best.append(top), used.append(fewest)
            if len(best) > 2 * keep:
                first += len(best) - keep
                del best[:-keep], used[:-keep]
        return used[-1]


class Counter:
    """Token counts of words, kept by a Python worker."""

    def __init__(self, pieces: Pieces):
        self.trie, self.counts = Trie(pieces), {}

    def __call__(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[int, int]]:
        """(words, tokens) of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        every, at, ends = split_words(column)
        counts, tokens = self.counts, self.trie.tokens
        new = [w for w in every if w not in counts]  # a set difference would walk the whole store
        if len(counts) + len(new) > CACHED:
            counts.clear()
            new = every
        for w in sorted(new):
            counts[w] = tokens(MARK + w.decode("utf-8", "replace"))
        each = np.fromiter(chain(map(counts.__getitem__, every), (0,)), np.int64, len(every) + 1)  # -1 is the last
        sums = np.concatenate(([0], np.cumsum(each[at])))[ends]
        words = np.concatenate(([0], np.cumsum(at >= 0)))[ends]
        for w in new:
            if len(w) > KEPT_BYTES:
                del counts[w]
        yield from zip(np.diff(words).tolist(), np.diff(sums).tolist(), strict=True)

    def trim(self) -> None:
        """Leaves what was learned first, which is what is frequent: idle Python workers hold little."""
        if len(self.counts) > LEFT:
            self.counts = dict(islice(self.counts.items(), LEFT))


_counters: dict[str, Counter] = {}


def _counter(name: str, pieces: Pieces) -> Counter:
    """One for all tasks of a Python worker that have the same model."""
    if name not in _counters:
        _counters.clear()
        _counters[name] = Counter(pieces)
    return _counters[name]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens), a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, model_of(model, piece_counts(docs, model, text_col))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                got = list(counter(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], ["id", "n_words", "n_tokens"])
        counter.trim()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_path())
