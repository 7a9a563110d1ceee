r"""Benchmark decontamination with a generalised suffix automaton.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased. All items'
word sequences go into one suffix automaton. A document's words are streamed
through it while the length of the longest match that ends at each word is
tracked: from ``length`` words (10) on, those words are hit, and the state tells
which items hold that window. An item of fewer words is a window of its own and
is found on the suffix links. A document that holds no probe (every window holds
a run of four words that starts at a multiple of seven in the document) is not
walked; the probes are exact and only save time.

Documents are only mapped, never shuffled. Items are read in blocks of at most
``BLOCK_WORDS`` words; each block is broadcast (its size is that bound) and all
documents pass it. What a pass finds is written to the shared folder before the
next block's pass and the table before it removed, so a benchmark of any size
takes more passes and not more memory.

Defined results: null or empty texts have no words and no hits, null or wordless
items no windows; texts of any length are walked whole; an item without an id
hits but isn't listed; repeated items count once an id; repeated rows of
documents are all returned; empty tables give no rows or no hits; extra columns,
of any name, are ignored by :func:`scan` and kept by :func:`clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fresh, small_batches, table, written

LENGTH, PROBE, BLOCK_WORDS = 10, 4, 400_000
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CUT = " … "
MARK = CUT.strip().encode()
STATE = ["id", "text", "n_words", "n_hit", "hit", "items"]


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_SPACES).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows' items at its states."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], length: int = LENGTH):
        self.width = length
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.probes: dict[int, set] = {}
        items = [(k, w) for k, w in items if w]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        for key, ws in items:
            self._mark(key, ws)
        # nearest state on the suffix links, itself included, where a short item ends
        self.chain = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.len.__getitem__):
            self.chain[s] = s if s in self.short else self.chain[self.link[s]] if s else -1

    def _new(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow), self.len.append(length), self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state for the strings of q that p's extension by w reaches."""
        if self.len[p] + 1 == self.len[q]:
            return q
        c = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, w, q)
        new, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _mark(self, key: str | None, ws: list[bytes]) -> None:
        width, s = min(self.width, len(ws)), 0
        grams = self.probes.setdefault(width, set())
        g = min(PROBE, width)
        grams.update(zip(*(ws[i:] for i in range(g)), strict=False))
        for i, w in enumerate(ws):
            s = self.next[s][w]
            if i + 1 >= width:
                at = s = self._of_length(s, width)
                if width == self.width:
                    self.items.setdefault(at, set()).add(key)
                elif (width, key) not in self.short.setdefault(at, []):
                    self.short[at].append((width, key))

    def _of_length(self, s: int, width: int) -> int:
        """The state of the last ``width`` words. From a state that was itself of that length a word before, this is one link at most."""
        while self.len[self.link[s]] >= width:
            s = self.link[s]
        return s

    def may_hit(self, ws: list[bytes]) -> bool:
        for width, grams in self.probes.items():
            g = min(PROBE, width)
            step = width - g + 1
            if len(ws) >= width and not grams.isdisjoint(zip(*(ws[i::step] for i in range(g)), strict=False)):
                return True
        return False

    def walk(self, ws: list[bytes]) -> tuple[np.ndarray | None, set]:
        """(which words are hit, or None for none; the items hit)."""
        if not self.may_hit(ws):
            return None, set()
        follow, link, length, width, chain = self.next, self.link, self.len, self.width, self.chain
        edge, found, s, run = None, set(), 0, 0
        for i, w in enumerate(ws):
            t = follow[s].get(w)
            while t is None and s:
                s = link[s]
                run = length[s]
                t = follow[s].get(w)
            if t is None:
                run = 0
                continue
            s, run = t, run + 1
            if run >= width:
                # only the last words are kept, so that a step costs the same however long the match
                s, run = self._of_length(s, width), width
                found |= self.items[s]
                edge = np.zeros(len(ws) + 1, np.int64) if edge is None else edge
                edge[i + 1 - run] += 1
                edge[i + 1] -= 1
            c = chain[s]
            while c >= 0:
                for n, key in self.short[c]:
                    if n <= run:
                        found.add(key)
                        edge = np.zeros(len(ws) + 1, np.int64) if edge is None else edge
                        edge[i + 1 - n] += 1
                        edge[i + 1] -= 1
                c = chain[link[c]] if link[c] >= 0 else -1
        if edge is None:
            return None, found
        return edge[:-1].cumsum() > 0, found


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list]:
    """The items in lists of at most BLOCK_WORDS words (or one item)."""
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t")).distinct().toLocalIterator():
        ws = item_words(r.t)
        if block and size + len(ws) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.k, ws))
        size += len(ws)
    yield block


_built: dict = {}


def _automaton(shared, length: int) -> Automaton:
    """Built once a Python worker for the block at hand; blocks carry a name of their own."""
    name, block = shared.value
    if (name, length) not in _built:
        _built.clear()
        _built[name, length] = Automaton(block, length)
    return _built[name, length]


def _either(hit: np.ndarray | None, old: bytes | None, n: int) -> np.ndarray | None:
    """The words hit now or in the packed bits of the blocks before."""
    if old is None:
        return hit
    was = np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
    return was if hit is None else hit | was


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_hit, items: the ids hit, sorted as strings), a row for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))

    def one(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shared, length)
            for b in batches:
                n, sums, hits, items = [], [], [], []
                for t, old, known in zip(b.column(1), b.column(4), b.column(5), strict=True):
                    ws = item_words(t.as_py())
                    hit, found = auto.walk(ws)
                    hit = _either(hit, old.as_py(), len(ws))
                    n.append(len(ws))
                    sums.append(0 if hit is None else int(hit.sum()))
                    hits.append(None if hit is None else np.packbits(hit).tobytes())
                    items.append(sorted({*(known.as_py() or ()), *(found - {None})}))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], STATE)

        return run

    return _passes(state, blocks(items), lambda block, _: one(spark.sparkContext.broadcast((uuid4().hex, block)))).select(F.col("id").alias(id_col), "n_words", "n_hit", "items")


def _passes(state: DataFrame, ahead: Iterator[list], one) -> DataFrame:
    """``state`` mapped by one(block, is it the last?) for each block, with a table between passes."""
    schema, before = state.schema, None
    block = next(ahead)
    while True:
        after = next(ahead, None)
        state = state.mapInArrow(one(block, after is None), schema)
        if after is None:
            return state
        state = written(state)
        if before is not None:
            dropped(state.sparkSession, before)
        before, block = state, after


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", size_col: str = "n_chars", length: int = LENGTH, coverage: float = 0.5) -> DataFrame:
    """``docs`` without hit spans; a document hit over more than ``coverage`` of its words goes, as does one left without words.

    Hits are gathered over all blocks before a document is judged and cut, so blocks
    don't change the result. Each hit span gives way to an ellipsis, which is a word
    of its own, so the words on either side don't become neighbours; only items with
    that word can hit a text once it is cut, and then it is cut until none does. The
    ellipsis itself is left then, so that every round takes words away and the last
    one comes. ``size_col``, if there, follows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names, at = docs.columns, docs.columns.index(text_col)
    (mark,) = fresh(names, "hit")

    def one(shared, last: bool, alone: bool, share: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shared, length)
            for b in batches:
                texts, hits, keep, changed = b.column(at).to_pylist(), b.column(len(names)).to_pylist(), [], False
                for i, t in enumerate(texts):
                    ws = item_words(t)
                    hit = auto.walk(ws)[0]
                    hit = _either(_but_marks(hit, ws) if again else hit, hits[i], len(ws))
                    hits[i] = None if hit is None else np.packbits(hit).tobytes()
                    keep.append(not last or hit is None or hit.sum() <= share * len(ws))
                    if last and hit is not None and keep[-1]:
                        texts[i], changed = cut(t, hit), True
                        while alone and (hit := _but_marks(auto.walk(ws := item_words(texts[i]))[0], ws)) is not None:
                            texts[i] = cut(texts[i], hit)
                        keep[-1] = bool(WORD.search(texts[i].replace(CUT, " ")))
                cols = list(b.columns)
                cols[-1] = pa.array(hits, pa.binary())
                if changed:
                    cols[at] = pa.array(texts, b.schema.field(at).type)
                    if size_col in names:
                        k = names.index(size_col)
                        cols[k] = pa.array([len(new) if new != old else n for new, old, n in zip(texts, b.column(at).to_pylist(), b.column(k).to_pylist(), strict=True)], b.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(cols, [*names, mark]).filter(pa.array(keep, pa.bool_()))

        return run

    again = False
    while True:
        ahead = blocks(items)
        some = list(islice(ahead, 2))
        alone, share = len(some) == 1, 1.0 if again else coverage
        marked = _passes(docs.withColumn(mark, F.lit(None).cast("binary")), chain(some, ahead), lambda block, last: one(spark.sparkContext.broadcast((uuid4().hex, block)), last, alone, share))
        if alone or not _has_mark(items):
            return marked.select(*names)
        marked = written(marked)
        if not marked.where(F.col(mark).isNotNull()).limit(1).count():
            return marked.select(*names)
        docs, again = marked.select(*names), True


def _but_marks(hit: np.ndarray | None, ws: list[bytes]) -> np.ndarray | None:
    """The words hit that don't stand for what was cut before; None if there are none."""
    if hit is None:
        return None
    hit = hit & np.fromiter((w != MARK for w in ws), bool, len(ws))
    return hit if hit.any() else None


def _has_mark(items: DataFrame, text_col: str = "text") -> bool:
    """Does an item hold the word that stands for what was cut?"""
    return bool(items.where(F.col(text_col).contains(MARK.decode())).limit(1).count())


def cut(text: str, hit: np.ndarray) -> str:
    """The text without the words hit."""
    spans = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).reshape(-1, 2)
    for a, z in edges.tolist():
        parts += [text[at : spans[a][0]], CUT]
        at = spans[z - 1][1]
    return "".join(parts) + text[at:]


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH iw AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
dp AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT dp.doc_id, dp.i, dp.n, win.item_id FROM dp JOIN win ON dp.n = win.n AND dp.k = win.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""
