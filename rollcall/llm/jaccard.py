r"""Near-duplicates by similarity of shingle sets: SimHash with covering tables, MinHash bands, then the exact figure.

Words as for :mod:`simhash`; shingles of five words joined by spaces (fewer words:
the whole sequence), XXH64 with seed 42 of each; a document is the set of these.
Two sets are linked where Jaccard is at least 0.8, computed on the sets themselves.

Pairs to compare share a bucket of one of two kinds, and agree in ``LEAST`` of 80
MinHash values, which a pair at 0.8 fails to with probability 0.00001.

* The covering tables of :mod:`simhash` over the SimHash of a set (the bits that over
  half of its shingles set): every pair within three bits meets in one of them.
* ``BANDS`` bands of ``ROWS`` MinHash values each, for similar pairs beyond three bits,
  which most at 0.8 are: such a pair meets with probability 1 - (1 - 0.8^4)^20 = 0.99997.

Equal sets are one point. Points that share no bucket leave first; only the others'
sets are taken, by a second reading of the texts behind a bitmap of their hashes.

1. In each bucket a point is compared with the one before that agrees most, among
   the ``WINDOW`` before it; in a bucket of at most ``SMALL`` with all. That is a
   bounded number a bucket and a point, and gives most components.
2. What is left are larger buckets in which several components meet. Their points
   are dealt with their sets in blocks of ``BLOCK``, and in the task of two blocks
   every pair of two components that agrees in ``LEAST`` values is compared by
   products of member matrices; a task hands on one link for two components, not
   pairs to compare. Pairs inside a component change nothing, so no link is lost.

Defined results: those of :mod:`simhash`; texts without words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, dropped, small_batches, words, written
from .graph import components
from .simhash import masks

SIMILAR, SHINGLE, SEED, BANDS, ROWS = 0.8, 5, 42, 20, 4
LEAST, SMALL, WINDOW, BLOCK = 48, 16, 256, 1024
#: Bits of the map of text hashes: 8 MB at most on the driver and in a worker.
BITS = 26
CHUNK = 1 << 13
_ODD = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes, as unsigned 64-bit numbers."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    joined, n, h = b" ".join(ws), max(1, len(ws) - SHINGLE + 1), xxhash.xxh64_digest
    ends = np.fromiter(map(len, ws), np.int64, len(ws)).cumsum() + np.arange(len(ws))
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    raw = b"".join([h(joined[a:z], SEED) for a, z in zip(starts, ends[-n:].tolist(), strict=True)])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def point(s: np.ndarray) -> int:
    """A signed 64-bit name for the set."""
    h = xxhash.xxh64_intdigest(s.tobytes(), SEED)
    return h - 2**64 if h >= 2**63 else h


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of the set as a signed long: a bit is set where over half of the members set it; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), CHUNK):
        counts += np.unpackbits(s[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(s)).view(">i8")[0])


def least(s: np.ndarray) -> np.ndarray:
    """The MinHash values."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), CHUNK):
        part = s[at : at + CHUNK]
        out = np.minimum(out, np.fromiter(((part * a).min() for a in _ODD), np.uint64, len(_ODD)))
    return out


def bands(values: np.ndarray) -> list[int]:
    """A signed key for each band."""
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - 2**63 for b, r in enumerate(values.reshape(BANDS, ROWS))]


def signature(values: np.ndarray) -> bytes:
    """The low byte of each value: unequal values agree by chance once in 256."""
    return (values & np.uint64(255)).astype(np.uint8).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def text_hash(raw: bytes) -> int:
    h = xxhash.xxh64_intdigest(raw, SEED)
    return h - 2**64 if h >= 2**63 else h


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp: the set's name, h: the text's hash, sim: its SimHash, keys of its bands, sig: its signature), written to the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for t in b.column(1):
                text = t.as_py() or ""
                s = shingles(text)
                values = least(s)
                for col, x in zip(rows, (point(s), text_hash(text.encode("utf-8", "replace")), fingerprint(s), bands(values), signature(values)), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows, kinds)], ["id", "fp", "h", "sim", "keys", "sig"])

    small_batches(docs.sparkSession)
    return written(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long, h long, sim long, keys array<long>, sig binary"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which low BITS of the hashes of column ``h`` occur: a bounded number of words whatever the rows."""
    low = hashes.select(F.col("h").bitwiseAND(F.lit(2**BITS - 1)).alias("b"))
    found = low.groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toArrow()
    out = np.zeros(2 ** (BITS - 6), np.uint64)
    out[found["w"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    return out


def sets_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(fp, shingles) of the points in wanted(fp, h), written: a text once a task is taken where the bitmap has its hash."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for b in batches:
            hs, sets = [], []
            for t in b.column(0):
                text = t.as_py() or ""
                h = text_hash(text.encode("utf-8", "replace"))
                low = h & (2**BITS - 1)
                if int(bits[low >> 6]) >> (low & 63) & 1 and h not in seen:
                    seen.add(h)
                    hs.append(h), sets.append(shingles(text).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(sets, pa.binary())], ["h", "shingles"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col(text_col)).mapInArrow(run, "h long, shingles binary")
    return written(found.join(wanted, "h").dropDuplicates(["fp"]).select("fp", "shingles"))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values in which each signature of a agrees with each of b, in pieces of bounded size."""
    out = np.empty((len(a), len(b)), np.uint8)
    for at in range(0, len(a), 64):
        out[at : at + 64] = (a[at : at + 64, None, :] == b[None, :, :]).sum(axis=2, dtype=np.uint8)
    return out


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _near(small: int, window: int):
    """(u, v) of the points of each bucket, which come sorted by table and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fps, sigs, size = None, np.empty(0, np.int64), np.empty((0, BANDS * ROWS), np.uint8), 0
        for b in batches:
            if not b.num_rows:
                continue
            t, k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            s = _signatures(b.column(3))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            us, vs = [], []
            for a, z in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(t)])).tolist(), strict=True):
                if held != (t[a], k[a]):
                    held, fps, sigs, size = (t[a], k[a]), f[:0], s[:0], 0
                for x in range(a, z, window):
                    y = min(z, x + window)
                    fps, sigs, n = np.concatenate((fps, f[x:y])), np.concatenate((sigs, s[x:y])), y - x
                    old = len(fps) - n
                    same = agreement(sigs[old:], sigs)
                    same[np.arange(len(fps))[None, :] >= old + np.arange(n)[:, None]] = 0  # itself and what comes after
                    rows, cols = np.arange(n), same.argmax(axis=1)
                    us.append(fps[cols]), vs.append(fps[old + rows])
                    good = same[rows, cols] >= LEAST
                    us[-1], vs[-1] = us[-1][good], vs[-1][good]
                    few = size + rows < small
                    i, j = np.nonzero((same >= LEAST) & few[:, None])
                    us.append(fps[j]), vs.append(fps[old + i])
                    size += n
                    fps, sigs = fps[-window:], sigs[-window:]
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many members each set of a shares with each of b, by products of member matrices ``width`` members wide."""
    def flat(sets, members):
        ids = np.searchsorted(members, np.concatenate(sets))
        order = np.argsort(ids, kind="stable")
        return ids[order], np.repeat(np.arange(len(sets)), list(map(len, sets)))[order]

    out, members = np.zeros((len(a), len(b)), np.int64), np.unique(np.concatenate([*a, *b]))
    (ia, ra), (ib, rb) = flat(a, members), flat(b, members)
    for at in range(0, len(members), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, i, r in ((x, ia, ra), (y, ib, rb)):
            part = slice(*np.searchsorted(i, (at, at + width)))
            m[r[part], i[part] - at] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _across(key: tuple, rows: pa.Table) -> pa.Table:
    """(u, v): a similar pair for each two components among the rows (fp, comp, sig, shingles, blk) of two blocks of a bucket, or of one.

    A pair that shares an earlier band is compared there.
    """
    t = key[0].as_py()
    fp, comp, blk = (rows[c].to_numpy() for c in ("fp", "comp", "blk"))
    sig, low = _signatures(rows["sig"].combine_chunks()), blk == blk.min()
    bands = sig.view(np.uint32)[:, :t]
    a, b = np.flatnonzero(low), np.flatnonzero(low if low.all() else ~low)
    near = (agreement(sig[a], sig[b]) >= LEAST) & (comp[a][:, None] != comp[b][None, :])
    for k in range(min(t, BANDS)):
        near &= bands[a, k][:, None] != bands[b, k][None, :]
    a, b, near = a[near.any(axis=1)], b[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
    u = v = np.empty(0, np.int64)
    if near.any():
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["shingles"].combine_chunks()]
        own, other = [sets[i] for i in a], [sets[i] for i in b]
        both = intersections(own, other)
        union = np.array(list(map(len, own)))[:, None] + np.array(list(map(len, other)))[None, :] - both
        i, j = np.nonzero(near & (both / np.maximum(union, 1) >= SIMILAR))
        _, first = np.unique(np.stack((comp[a[i]], comp[b[j]])), axis=1, return_index=True)
        u, v = fp[a[i[first]]], fp[b[j[first]]]
    return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""
    side = lambda x, s: sets.select(F.col("fp").alias(x), F.col("shingles").alias(s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(*(np.frombuffer(x.as_py(), np.uint64) for x in s)) >= SIMILAR for s in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def link(docs: DataFrame, sketches: DataFrame, text_col: str, small: int = SMALL, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(u, v): each point that isn't the least of its component, with that least one."""
    covering = F.array(*(F.col("sim").bitwiseAND(F.lit(m)) for m in masks()))  # tables BANDS and on
    points = sketches.select("fp", F.concat("keys", covering).alias("keys")).dropDuplicates(["fp"])
    keyed = points.select("fp", F.posexplode("keys").alias("t", "key")).select("t", "key", "fp")
    bucket = W.partitionBy("t", "key").orderBy("fp")
    met = keyed.withColumn("met", F.coalesce(F.lag("fp").over(bucket), F.lead("fp").over(bucket)).isNotNull()).where("met").drop("met")
    met = checkpointed(met, thin=True)
    own = sketches.select("fp", "h", "sig").join(met.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h"), F.min("sig").alias("sig"))
    own = checkpointed(own, thin=True)
    sets = sets_of(docs, text_col, own.select("fp", "h"))
    met = met.join(own.select("fp", "sig"), "fp").select("t", "key", "fp", "sig")
    dealt = met.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    labels = components(_linked(dealt.mapInArrow(_near(small, window), "u long, v long").distinct(), sets))
    comp = met.join(labels.select(F.col("u").alias("fp"), F.col("v").alias("comp")), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    whole = W.partitionBy("t", "key")
    left = comp.withColumn("n", F.count("*").over(whole)).withColumn("some", F.min("comp").over(whole) != F.max("comp").over(whole)).where(f"n > {small} and some")
    left = left.withColumn("blk", F.floor((F.row_number().over(whole.orderBy("comp", "fp")) - 1) / block)).withColumn("o", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")))
    blocks = left.join(sets, "fp").select("t", "key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "fp", "comp", "sig", "shingles", "blk")
    more = checkpointed(blocks.groupBy("t", "key", "i", "j").applyInArrow(_across, "u long, v long").distinct(), thin=True)
    if more.limit(1).count():
        labels = components(labels.union(more))
    dropped(docs.sparkSession, sets)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(id, fingerprint: the set's name as 16 hex digits, component_id: the least id reachable through links, component)."""
    from .simhash import grouped

    sketches = sketched(docs, id_col, text_col)
    return grouped(sketches.select("id", "fp"), link(docs, sketches, text_col, **sizes), id_col)


def name(text: str | None) -> int:
    return point(shingles(text))
