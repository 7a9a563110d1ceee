r"""Personal data: fixed patterns, and terms that reveal protected entities.

Base spans, leftmost and non-overlapping within each kind:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip    four groups of digits joined by dots, each at most 255
* card  digits with single spaces or hyphens between, 14 to 19 of them, Luhn-valid
* phone ``\+[0-9][\x20().0-9-]+[0-9]`` with 10 to 15 digits

Each distinct value found is a protected entity e. Over all documents, c(e) and
c(t) count those that hold e and term t, c(e, t) those that hold both, N all. A
term discloses PMI(e; t) = log2(N c(e, t) / (c(e) c(t))) of the IC(e) =
log2(N / c(e)) bits that e is worth. Where PMI / IC is at least ``DISCLOSURE``,
the term reveals e: in the documents that hold e it gets a span of kind ``term``
and :func:`sanitise` generalises it. Entities and pairs of any count are scored.
PMI is shrunk alike at every count: with n different texts that hold both, the share
c(e, t) / c(t) of e among the documents of t counts as n texts against ``PRIOR``
texts that hold e at its rate c(e) / N. So an entity of one text has for terms
the words of no other text once a table has some 110 documents: by co-occurrence
alone such words tell the text that the entity is in, ordinary ones too.

Texts are scanned once; what is kept is thin, with the text itself only where an
entity is. Each task sums its texts' terms before it hands them on, so a term in
a third of all rows is a sum a task.

Defined results: null and empty texts have no spans; texts of any length are
scanned whole; spans that start together stand in the order of their kinds;
repeated rows are all returned; a null id is kept; empty tables give no rows;
extra columns, of any name, are ignored by :func:`spans` and kept by
:func:`sanitise`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, small_batches, table

DISCLOSURE, TERM_BYTES = 0.9, 4
#: Weight of the base rate, in texts.
PRIOR = 0.6
#: Terms, or pairs of entity and term, that a task holds before it hands its counts on.
HELD = 250_000
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at-sign once: the local part is the longest run before it, so no run is scanned twice."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _long(raw: bytes) -> int:
    """As Spark's ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(raw, 42)
    return h - 2**64 if h >= 2**63 else h


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """A hash for each distinct value: digits alone for cards and phones, lower case for addresses."""
    value = lambda k, v: v.lower() if k == "email" else v if k == "ip" else "".join(_DIGIT.findall(v))
    return sorted({_long(f"{k}:{value(k, text[a:b])}".encode("utf-8", "replace")) for k, a, b in spans})


def _terms(text: str) -> set[bytes]:
    return {w for w in text.encode("utf-8", "replace").translate(_LETTERS).split() if len(w) >= TERM_BYTES}


def _term_spans(text: str, base: list[tuple[str, int, int]], hashes: set[int]) -> list[tuple[str, int, int]]:
    """Spans of the terms with these hashes outside the base spans."""
    wanted = {w for w in _terms(text) if _long(w) in hashes}
    out, k, stop = [], 0, 0
    for m in _TERM.finditer(text) if wanted else ():
        while k < len(base) and base[k][1] < m.end():
            stop, k = max(stop, base[k][2]), k + 1
        if m.start() >= stop and m[0].encode("utf-8", "replace").translate(_LETTERS) in wanted:
            out.append(("term", *m.span()))
    return out


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (the text's hash), base (joined spans), entities, and the text where there are any."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, base, ents, texts = [], [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                hs.append(_long(text.encode("utf-8", "replace")))
                base.append(_joined(spans))
                ents.append(_entities(text, spans))
                texts.append(text if spans else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, pa.int64()), pa.array(base, pa.string()), pa.array(ents, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["id", "h", "base", "entities", "text"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, h long, base string, entities array<long>, text string")


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, by hash; n: documents that hold it). Each task hands on sums of at most HELD terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Counter()

        def out():
            rows = [pa.array([_long(t) for t in terms], pa.int64()), pa.array(list(terms.values()), pa.int64())]
            terms.clear()
            return pa.RecordBatch.from_arrays(rows, ["term", "n"])

        for b in batches:
            for t in b.column(0):
                terms.update(_terms(t.as_py() or ""))
                if len(terms) > HELD:
                    yield out()
        yield out()

    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("c_t"))


def revealing(docs: DataFrame, base: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """(h, terms): for texts that hold an entity, by hash, the hashes of the terms that reveal it. ``base`` comes from :func:`found`."""
    total = max(base.count(), 1)
    holding = base.where("text is not null").groupBy("h").agg(F.count("*").alias("w"), F.first("text").alias("text"), F.first("entities").alias("entities"))
    # entities of the same texts reveal alike: one stands for all, so that a text of many entities of its own has one
    alike = holding.select("h", "w", F.explode("entities").alias("e")).groupBy("e").agg(F.sum("w").alias("c_e"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    known = alike.groupBy("x", "s", "n").agg(F.min("e").alias("e"), F.min("c_e").alias("c_e"))
    known = checkpointed(known.select("e", "c_e"), thin=True)
    held = holding.select("h", "w", F.explode("entities").alias("e")).join(known.select("e"), "e", "left_semi")
    holding = held.groupBy("h").agg(F.collect_set("e").alias("entities")).join(holding.select("h", "w", "text"), "h")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = Counter(), Counter()

        def out():
            cols = [e for e, _ in sums], [x for _, x in sums], list(sums.values()), list(n.values())
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["e", "term", "w", "n"])
            sums.clear(), n.clear()
            return batch

        for b in batches:
            for es, w, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                inside = [_long(x) for x in _terms(t)]
                for e in es:
                    for x in inside:
                        sums[e, x] += w
                        n[e, x] += 1
                    if len(sums) > HELD:
                        yield out()
        yield out()

    both = holding.select("entities", "w", "text").mapInArrow(pairs, "e long, term long, w long, n long").repartition("term").groupBy("term", "e").agg(F.sum("w").alias("c_et"), F.sum("n").alias("texts_et"))
    share, rate, n = F.col("c_et") / F.col("c_t"), F.col("c_e") / F.lit(float(total)), F.col("texts_et")
    # no pair of a lesser share reveals: PMI >= d IC says share >= (c(e) / N)^(1 - d), and c(e) is 1 at least
    close = both.join(term_counts(docs, text_col), "term").where(share >= 0.999 * total ** (disclosure - 1))
    scored = close.join(known, "e")
    shrunk = (n * share + PRIOR * rate) / (n + PRIOR)
    pmi = F.log2(shrunk / rate)
    reveals = scored.where(pmi >= disclosure * F.log2(F.lit(float(total)) / F.col("c_e"))).where(F.col("c_e") < total).select("e", "term")
    return held.select("h", "e").join(reveals, "e").groupBy("h").agg(F.collect_set("term").alias("terms"))


#: Rows of (text hash, terms), and terms in them, up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_TERMS = 20_000, 1_000_000


def _joinable(terms: DataFrame) -> DataFrame:
    """Checkpointed, so that AQE can split a text of many copies in a join, or broadcast where they are few."""
    terms = checkpointed(terms, thin=True)
    rows, n = terms.agg(F.count("*"), F.coalesce(F.sum(F.size(terms.columns[1])), F.lit(0))).first()
    return F.broadcast(terms) if rows <= BROADCAST_ROWS and n <= BROADCAST_TERMS else terms


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """(id, base, spans): joined spans, a row for each row of ``docs``."""
    base = checkpointed(found(docs, id_col, text_col))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column(1).to_pylist()
            for i, (text, terms) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if terms:
                    own = _split(out[i])
                    both = own + _term_spans(text, own, set(terms))
                    out[i] = _joined(sorted(both, key=lambda s: (s[1], (*KINDS, "term").index(s[0]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "base", "spans"])

    full = base.join(_joinable(revealing(docs, base, text_col, disclosure)), "h", "left").select("id", "base", "text", "terms")
    return full.mapInArrow(run, f"id {kind}, base string, spans string").withColumnRenamed("id", id_col)


def _split(joined: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in joined.split(",") if s)]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with each span generalised to its kind in brackets; ``size_col``, if there, follows."""
    base = checkpointed(found(docs, id_col, text_col))
    names = docs.columns
    at, (key, terms) = names.index(text_col), fresh(names, "h", "terms")
    revealed = revealing(docs, base, text_col, disclosure).select(F.col("h").alias(key), F.col("terms").alias(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, hashes = b.column(at).to_pylist(), b.column(len(names)).to_pylist()
            new = [generalised(t, set(h or ())) for t, h in zip(old, hashes, strict=True)]
            cols = [*b.columns[: len(names)]]
            if new != old:
                cols[at] = pa.array(new, b.schema.field(at).type)
                if size_col in names:
                    k = names.index(size_col)
                    cols[k] = pa.array([len(y) if x != y else n for x, y, n in zip(old, new, b.column(k).to_pylist(), strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    return keyed.join(_joinable(revealed), key, "left").select(*names, terms).mapInArrow(run, docs.schema)


def generalised(text: str | None, hashes: set[int]) -> str | None:
    base = base_spans(text)
    every = sorted(base + (_term_spans(text, base, hashes) if hashes else []), key=lambda s: (s[1], -s[2]))
    if not every:
        return text
    parts, at = [], 0
    for kind, a, b in every:
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return every.select("doc_id", *map(count, KINDS), F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")
