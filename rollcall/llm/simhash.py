r"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprint: words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, shingles of
three words joined by spaces (fewer words: the whole sequence), XXH64 with seed
42 of each; a bit is set where over half of the shingles set it. No words: 0.

Links: fingerprints that differ in at most three bits. Position i of the 64 gets
a nonzero vector m(i) of four bits, and table v (1 to 15) keeps the positions
where m(i) and v have odd overlap. The at most three vectors of a pair's
differing positions leave some v orthogonal to them all, so that pair's keys are
equal in table v: no pair within the radius is missed. Distinct fingerprints
only enter the tables; within a table rows are sorted by key and streamed, a
bucket is linked by its components and gives one edge a member, never all pairs.
A bucket of over ``DENSE`` is linked in time linear in its size through its
members' one-bit and two-bit neighbours, and one of over ``HOT`` leaves the task
and is linked by the same neighbours in joins.

Defined results: null, empty and blank texts have fingerprint 0 and link like
any other; repeated rows are all returned; a null id counts for nothing in the
component's least id and takes that id from the others (null if none has one);
texts of any length are hashed whole, shingle by shingle; a bit that just half of the
shingles set is 0, and documents tied on their fingerprint are one point with one
component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, small_batches, table, words
from .graph import components

RADIUS, SHINGLE, SEED = 3, 3, 42
DENSE, HOT = 1500, 200_000
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed long."""
    ws = words(text)
    if not ws:
        return 0
    joined, n = b" ".join(ws), max(1, len(ws) - SHINGLE + 1)
    ends = np.fromiter(map(len, ws), np.int64, len(ws)).cumsum() + np.arange(len(ws))
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    h, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    spans = zip(starts, ends, strict=True)
    for at in range(0, n, CHUNK):
        raw = b"".join([h(joined[a:b], SEED) for a, b in islice(spans, min(CHUNK, n - at))])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long), a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], ["id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """A mask for each table, as signed longs."""
    size = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, size + 1):
        m = sum(1 << i for i in range(64) if bin((i % size + 1) & v).count("1") % 2)
        out.append(m - 2**64 if m >= 2**63 else m)
    return out


def _label(adjacent, n: int) -> np.ndarray:
    """Component number of each of n points; adjacent(i) gives a boolean row."""
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                near = np.flatnonzero(adjacent(todo.pop()) & (label < 0))
                label[near] = i
                todo += near.tolist()
    return label


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of many pairs: lowers roots until all pairs agree."""
    while True:
        ra, rb = _find(parent, a), _find(parent, b)
        differ = ra != rb
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])


def linked(fps: np.ndarray, free: list[int] | None = None) -> np.ndarray:
    """For distinct fingerprints of one bucket, sorted: the index of each one's component's least member."""
    n = len(fps)
    if n <= DENSE:
        return _label(lambda i: np.bitwise_count(fps ^ fps[i]) <= RADIUS, n)
    # d(x, y) <= 3 just if some z has d(x, z) <= 1 and d(z, y) <= 2. Owners of one z are within 2 of each other.
    bits = [np.int64(np.uint64(1 << i).view(np.int64)) for i in (free if free is not None else range(64))]
    parent, every = np.arange(n), np.arange(n)
    z = np.concatenate([fps] + [fps ^ b for b in bits])
    owner = np.tile(every, len(bits) + 1)
    order = np.argsort(z, kind="stable")
    z, owner = z[order], owner[order]
    head = np.concatenate(([True], z[1:] != z[:-1]))
    first = owner[head]
    _join(parent, owner, first[np.cumsum(head) - 1])
    z = z[head]
    for i, p in enumerate(bits):
        for q in bits[i + 1 :]:
            y = fps ^ (p ^ q)
            at = np.minimum(np.searchsorted(z, y), len(z) - 1)
            hit = z[at] == y
            if hit.any():
                _join(parent, every[hit], first[at[hit]])
    return _find(parent, every)


def _bucket_edges(dense: int, hot: int):
    frees = [[i for i in range(64) if not (m >> i) & 1] for m in masks()]

    def flush(t: int, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        fps = np.sort(np.concatenate(parts))
        least = fps[linked(fps, frees[t])]
        moved = least != fps
        return fps[moved], least[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size = None, [], 0

        def out(u, v, hot_rows=False):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), hot_rows))], ["u", "v", "hot"])

        for b in batches:
            if not b.num_rows:
                continue
            t, k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            cut = np.concatenate(([0], cut, [len(t)]))
            us, vs = [], []
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if key != (t[a], k[a]):
                    if 1 < size <= hot:
                        u, v = flush(int(key[0]), parts)
                        us.append(u), vs.append(v)
                    key, parts, size = (t[a], k[a]), [], 0
                parts.append(f[a:z])
                size += z - a
                if size > hot:  # what came before and all that follows goes to the joins
                    for rows in parts:
                        yield out(rows, rows, True)
                    parts = []
            if us:
                yield out(np.concatenate(us), np.concatenate(vs))
        if 1 < size <= hot:
            yield out(*flush(int(key[0]), parts))

    return run


def _hot_edges(fps: DataFrame) -> DataFrame:
    """Edges among the fingerprints of column ``u`` by joins on shared neighbours: 2,017 two-bit and 65 one-bit neighbours each."""
    lit = lambda i: F.lit(1).cast("long") if not i else F.shiftleft(F.lit(1).cast("long"), i)
    singles = [F.col("u")] + [F.col("u").bitwiseXOR(lit(i)) for i in range(64)]
    ones = fps.select("u", F.explode(F.array(*singles)).alias("z"))
    least = ones.groupBy("z").agg(F.min("u").alias("v"))
    near = ones.join(least, "z").where("u <> v").select("u", "v")
    pos = F.explode(F.sequence(F.lit(0), F.lit(63)))
    two = fps.select("u", pos.alias("i")).select("u", "i", pos.alias("j")).where("i < j")
    two = two.select("u", F.expr("u ^ shiftleft(1L, i) ^ shiftleft(1L, j)").alias("z"))
    return near.union(two.join(least, "z").where("u <> v").select("u", "v")).distinct()


def link(fps: DataFrame, dense: int = DENSE, hot: int = HOT) -> DataFrame:
    """(u, v): each distinct fingerprint of column ``fp`` that isn't the least of its component, with that least one."""
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())))
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp")
    dealt = keyed.repartition("t", "key").sortWithinPartitions("t", "key")
    edges = checkpointed(dealt.mapInArrow(_bucket_edges(dense, hot), "u long, v long, hot boolean").distinct(), thin=True)
    plain = edges.where("not hot").select("u", "v")
    crowd = edges.where("hot").select("u").distinct()
    if crowd.limit(1).count():
        plain = plain.union(_hot_edges(crowd))
    return components(plain)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the least id reachable through links, component: its least fingerprint as a signed long)."""
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    return grouped(fps, link(fps.select("fp").distinct(), hot=hot), id_col)


def grouped(fps: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(id, fingerprint, component_id, component) from rows (id, fp) and each linked fingerprint's root."""
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = labels.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    members = labels.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(roots)
    # checkpointed, so that both sides of the joins behind are plain exchanges, and AQE can split a component of
    # many fingerprints and a fingerprint of many copies
    lowest = checkpointed(members.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id")), thin=True)
    of_fp = distinct.join(members.join(lowest, "root").select("fp", "root", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    of_fp = checkpointed(of_fp, thin=True)
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return fps.join(of_fp, "fp").select(F.col("id").alias(id_col), text("fp").alias("fingerprint"), "component_id", text("root").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near=near_duplicates, mark=fingerprint) -> DataFrame:
    """One row of ``docs`` for each component: a row with its least id (without an id only where no row has one).

    Where several rows of a component share that id, the one with the least
    fingerprint, then the least row, stays. ``near`` gives the components and
    ``mark`` a text's fingerprint in them.
    """
    near = near(docs, id_col, text_col)
    k, f = fresh(docs.columns, "k", "f")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("none"))
    rows_of = near.groupBy(key.alias(k)).agg(F.count("*").alias("n"))
    first = near.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct(F.col("fingerprint").alias("f"), key.alias("k"))).alias("r"))
    chosen = first.select(F.col("r.k").alias(k), F.col("r.f").alias(f)).join(rows_of, k)
    chosen = checkpointed(chosen, thin=True)
    rows = docs.withColumn(k, key)
    once = rows.join(chosen.where("n = 1").select(k), k, "left_semi").drop(k)
    if not chosen.where("n > 1").limit(1).count():  # ids don't repeat, as they shouldn't
        return once
    again = rows.join(chosen.where("n > 1").select(k).distinct(), k, "left_semi")
    fp = F.pandas_udf(lambda t: t.map(lambda x: f"{mark(x) % 2**64:016x}"), "string")
    again = again.withColumn(f, fp(F.coalesce(text_col, F.lit("")))).join(chosen.select(k, f), [k, f], "left_semi")
    least = again.groupBy(k, f).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return once.unionByName(least)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
