"""Quality by hierarchical empirical Bayes.

1. A logistic regression over the presence of words and stems and binned form features (symbols,
   capitals, digits, repeats, ...) gives each document the evidence p that it is
   good (quality 1 and not toxic). It is fitted on a bounded sample: the ``SAMPLE``
   labelled ids with the least hash. Their features meet in one task, which gives
   back a model of some 100 kB; the driver holds nothing else.
2. Grouped aggregation of p over all documents gives each host and each path of
   a host its count and sum. Between-site variance is found by moments; it sets
   how many documents' worth a prior counts. A host's posterior shrinks its mean
   toward the global one, a path's shrinks toward its host's, so sparse sites
   rest on their priors.
3. The score is p moved by its path's log-odds over the global log-odds.

In the synthetic tables ``source`` is the host and ``lang`` the path. Each text is
scored once and written with its p; sums are partial in every task, so a host
with a third of all rows is one row a task. The path table is broadcast only if
it has at most ``BROADCAST_ROWS`` rows.

Defined results: null or empty texts have the form features of no words; texts of
any length are scored whole; null host or path is a site of its own (as is the
lone character U+0000, with it); labels with a null are left out, a document
labelled twice is good only if all its labels are, and where rows share a
labelled id the one with the least text is learned from; ids tied on their hash
are ordered by themselves; repeated rows count each; without labels of both kinds
p is the labels' share of good (1 without labels); empty tables give no rows;
extra columns are kept, of any name in :func:`filtered`; in :func:`scores` those
named as its own results give way.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checkpointed, fresh, small_batches, table, written

SAMPLE, VOCABULARY, BINS, CERTAIN, STEM = 12_000, 3000, 8, 3.0, 5
BROADCAST_ROWS = 20_000
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-\"")
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def features(text: str | None) -> tuple[list[float], set[bytes]]:
    """(form features, distinct words of letters and their stems: the first bytes)."""
    raw = (text or "").encode("utf-8", "replace")
    size = max(len(raw), 1)
    chunks = raw.split()
    n = max(len(chunks), 1)
    lines = raw.split(b"\n")
    low = raw.translate(_LETTERS).split()
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    form = [
        share(_SYMBOLS),
        share(_UPPER),
        share(_DIGITS),
        sum(map(eq, chunks, chunks[1:])) / n,
        len(set(chunks)) / n,
        len(raw) / n,
        1 - len(set(lines)) / len(lines),
        raw.count(b"!") / n,
        raw.count(b"|") / n,
    ]
    own = set(low)
    return form, own | {w[:STEM] + b"-" for w in own if len(w) > STEM}


@dataclass
class Model:
    bias: float
    words: dict[bytes, float] = field(default_factory=dict)
    edges: list[list[float]] = field(default_factory=list)
    bins: list[list[float]] = field(default_factory=list)

    def __call__(self, text: str | None) -> float:
        if not self.bins:
            return 1 / (1 + math.exp(-self.bias))
        form, own = features(text)
        z = self.bias + sum(map(self.words.get, own & self.words.keys()))
        for x, edge, w in zip(form, self.edges, self.bins, strict=True):
            z += w[int(np.searchsorted(edge, x))]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


Row = tuple[list[float], bytes, int]  # form features, distinct words and stems joined by spaces, good


def distinct(rows: list[Row]) -> list[Row]:
    """One row of those with the same set of words and the same label: copies of one text are one piece of evidence."""
    return list({(ws, good): (form, ws, good) for form, ws, good in rows}.values())


def fit(rows: list[Row], rounds: int = 500, ridge: float = 2e-5) -> Model:
    """Logistic regression by accelerated gradient steps; words are counted by hash, so the driver holds four bytes each."""
    y = np.array([g for *_, g in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 1.0, 1e-6), 1 - 1e-6)
        return Model(math.log(share / (1 - share)))
    hashed = [np.array([zlib.crc32(w) for w in ws.split()], np.uint32) for _, ws, _ in rows]
    every, at = np.unique(np.concatenate(hashed), return_inverse=True)
    total = np.bincount(at, minlength=len(every)) + 1.0
    a = np.bincount(at[np.repeat(y > 0, list(map(len, hashed)))], minlength=len(every)) + 0.5
    del at
    b = total - a
    # how many standard errors a word's log-odds are from zero
    z = abs(np.log(a / (y.sum() + 1)) - np.log(b / (len(y) - y.sum() + 1))) / np.sqrt(1 / a + 1 / b)
    some = np.flatnonzero((total >= 6) & (z >= CERTAIN))
    chosen = np.sort(every[some[np.lexsort((every[some], -z[some]))[:VOCABULARY]]])
    index, own = {}, []
    for (_, ws, _), h in zip(rows, hashed, strict=True):
        i = np.minimum(np.searchsorted(chosen, h), max(len(chosen) - 1, 0))
        hit = np.flatnonzero(chosen[i] == h) if len(chosen) and len(h) else np.empty(0, int)
        own.append(i[hit])
        split = ws.split() if len(hit) else []
        index.update((split[k], int(i[k])) for k in hit.tolist())
    words = chosen
    forms = np.array([f for f, *_ in rows])
    edges = [np.unique(np.quantile(forms[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).tolist() for j in range(forms.shape[1])]
    at, places, fixed = len(words), [], []
    for j, e in enumerate(edges):
        fixed.append(at + np.searchsorted(e, forms[:, j]))
        places.append((at, at + len(e) + 1))
        at += len(e) + 1
    fixed.append(np.full(len(rows), at))
    # the rows' features, one after the other: each row has at least its bins and the constant
    cols = np.concatenate([np.concatenate((o, f)) for o, f in zip(own, np.stack(fixed, axis=1), strict=True)]).astype(np.int64)
    sizes = np.array([len(o) + len(fixed) for o in own])
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
    theta = look = np.zeros(at + 1)
    step = 4 / sizes.mean()
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(look[cols], starts), -30, 30)))
        new = look - step * (np.bincount(cols, (p - y)[of], at + 1) / len(rows) + ridge * look)
        look = new + k / (k + 3) * (new - theta)
        theta = new
    return Model(float(theta[-1]), {w: float(theta[i]) for w, i in index.items()}, edges, [theta[a:z].tolist() for a, z in places])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    good = labels.where("quality is not null and toxic is not null").groupBy(id_col).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    chosen = good.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("id"), "good")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in got], pa.list_(pa.float64())), pa.array([b" ".join(sorted(w)) for _, w in got], pa.binary()), b.column(1)], ["form", "words", "good"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(distinct(sorted(rows))))], pa.binary())], ["model"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("good").alias("good"))
    rows = texts.select("text", "good").mapInArrow(read, "form array<double>, words binary, good int")
    return pickle.loads(rows.repartition(1).mapInArrow(learn, "model binary").first().model)


def evidence(docs: DataFrame, model: Model, text_col: str, name: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the evidence under ``name``."""
    used = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at = used.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([score(t.as_py()) for t in b.column(at)], pa.float64())], [*keep, name])

    small_batches(docs.sparkSession)
    return used.mapInArrow(run, StructType([*docs.select(*keep).schema.fields, StructField(name, DoubleType())]))


def _prior(sites: DataFrame) -> float:
    """Documents' worth of a prior, by moments, over rows (n, s, m): s - n m is what the prior mean m leaves."""
    r = sites.agg(
        F.sum(F.pow(F.col("s") - F.col("n") * F.col("m"), 2) / F.col("n")).alias("between"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("within"),
        F.sum("n").alias("weight"),
        F.avg(F.col("m") * (1 - F.col("m"))).alias("spread"),
        F.count("*").alias("k"),
    ).first()
    if not r.k or not r.spread:
        return 1.0
    # E[(s - n m)^2 / n] = spread + (n - 1) tau^2 for sites of n documents
    tau = max(r.between - r.within, 0.0) / max(r.weight - r.k, 1)
    return float(min(max(r.spread / tau - 1 if tau > 0 else 1e6, 1.0), 1e6))


def _place(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("\x00"))


def posteriors(scored: DataFrame, host_col: str, path_col: str, p: str = "__p") -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) and the global mean, from the evidence ``p`` of all rows."""
    paths = scored.select(_place(host_col).alias("host"), _place(path_col).alias("path"), F.round(p, 9).cast("decimal(18,9)").alias("p")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").cast("double").alias("s"))
    paths = checkpointed(paths, thin=True)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5
    k = _prior(hosts.withColumn("m", F.lit(mean)))
    hosts = hosts.select("host", ((F.lit(k * mean) + F.col("s")) / (F.lit(k) + F.col("n"))).alias("host_posterior"))
    both = paths.join(hosts, "host")
    kp = _prior(both.withColumn("m", F.col("host_posterior")))
    return both.select("host", "path", "host_posterior", ((F.lit(kp) * F.col("host_posterior") + F.col("s")) / (F.lit(kp) + F.col("n"))).alias("path_posterior")), mean


RESULTS = ["p_doc", "host_posterior", "path_posterior", "score", "keep"]


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, keep: list[str]) -> tuple[DataFrame, str]:
    """The columns ``keep`` and a struct of RESULTS, and that struct's name."""
    model = train(docs, labels, id_col, text_col)
    p, result, host, path, site = fresh(keep, "p", "result", "host", "path", "site")
    scored = written(evidence(docs, model, text_col, p, keep))
    sites, mean = posteriors(scored, host_col, path_col, p)
    sites = sites.select(F.col("host").alias(host), F.col("path").alias(path), F.struct("host_posterior", "path_posterior").alias(site))
    few = sites.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    odds = lambda c: F.log(c / (1 - c))
    safe = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), c))
    both = scored.withColumns({host: _place(host_col), path: _place(path_col)}).join(F.broadcast(sites) if few else sites, [host, path])
    score = 1 / (1 + F.exp(-(odds(safe(F.col(p))) + odds(safe(F.col(f"{site}.path_posterior"))) - F.lit(math.log(mean / (1 - mean))))))
    cols = [F.col(p), F.col(f"{site}.host_posterior"), F.col(f"{site}.path_posterior"), score, score >= 0.5]
    return both.select(*keep, F.struct(*(c.alias(n) for c, n in zip(cols, RESULTS, strict=True))).alias(result)), result


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all unless given; host and path among them) with p_doc, host_posterior, path_posterior, score and keep."""
    judged, result = _judged(docs, labels, id_col, text_col, host_col, path_col, keep or docs.columns)
    return judged.select(*[c for c in judged.columns[:-1] if c.lower() not in RESULTS], *(F.col(f"{result}.{c}").alias(c) for c in RESULTS))


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept."""
    judged, result = _judged(docs, labels, id_col, text_col, host_col, path_col, docs.columns)
    return judged.where(F.col(f"{result}.keep")).select(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    got = scores(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "source", "lang"])
    places = lambda c: F.round(c, 6).alias(c)
    return got.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), *map(places, ("p_doc", "host_posterior", "path_posterior", "score")), "keep")
