import random
import zlib

import numpy as np
import pytest

from rollcall.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def check(spark, texts, extra=()):
    docs = spark.createDataFrame([(t, i, "x") for i, t in enumerate(texts)], "text string, doc_id long, offset string")
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    tok = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
    return len(by_seq), sum(r.length for r in got)


def test_every_id_lies_in_one_piece(spark):
    rnd = random.Random(1)
    syl = ["the", "Of", "ion", "é", "ß", "12", "a'll", "|", "***", " ", "<|endoftext|>", "Ié", "x\x1cy", " ", "é", "\t"]
    texts = [None, "", " ", "one", "<|endoftext|>", "a <|startoftext|>b"] + ["same words again"] * 40
    texts += ["".join(rnd.choice(syl) + rnd.choice(["", " ", "\n"]) for _ in range(int(10 ** rnd.uniform(0, 3.6)))) for _ in range(150)]
    texts.append("long word" * 3 + " and rest " * 9000)
    check(spark, texts)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).count() == 0


def billed(n):
    return n if n <= 64 else -(-n // 4) * 4 if n <= 512 else -(-n // 16) * 16


def held(plan, room):
    out = {}
    for items, times in plan:
        assert sum(k * c for k, c in items.items()) <= room
        for k, c in items.items():
            out[k] = out.get(k, 0) + c * times
    return out


def test_padding_is_small():
    rnd = random.Random(2)
    for n, least, short in ((500, 0.95, 0), (100_000, 0.99, 0), (100_000, 0.99, 0.34), (50_000, 0.98, 1)):
        sizes = [rnd.choice([1, 1, 5, 70]) if rnd.random() < short else min(4096, int(rnd.lognormvariate(6.8, 0.8)) + 1) for _ in range(n)]
        demand = {}
        for s in sizes:
            demand[billed(s)] = demand.get(billed(s), 0) + 1
        plan = packing.plan(demand, 4096)
        assert held(plan, 4096) == demand
        # but for the last few sequences
        assert sum(sizes) / 4096 / (sum(t for _, t in plan) - 3) > least


def test_against_the_least_number_of_sequences():
    def least(sizes, room):
        """Exact: the best over all subsets that a first sequence may hold, by bit masks."""
        n = len(sizes)
        fits = [m for m in range(1, 1 << n) if sum(s for i, s in enumerate(sizes) if m >> i & 1) <= room]
        best = [0] + [n] * ((1 << n) - 1)
        for m in range(1, 1 << n):
            best[m] = min(best[m & ~f] + 1 for f in fits if f & m == f and f & (m & -m))
        return best[-1]

    rnd = random.Random(6)
    over = 0
    for _ in range(60):
        room = rnd.choice([7, 10, 16])
        sizes = [rnd.randrange(1, room + 1) for _ in range(rnd.randrange(1, 9))]
        demand = {s: sizes.count(s) for s in sizes}
        plan = packing.plan(demand, room)
        assert held(plan, room) == demand
        over += (got := sum(t for _, t in plan)) - (want := least(sizes, room))
        assert want <= got <= want + 1
    assert over <= 6


def test_linear_optimum_against_all_patterns():
    """At the prices of the last basis no pattern at all is worth more than a sequence, which proves the optimum."""
    rnd = random.Random(7)
    for _ in range(30):
        demand = {w: rnd.randrange(1, 50) for w in rnd.sample(range(2, 16), 6)}
        weight, found = sorted(demand), packing.patterns(demand, 16)
        basis = np.array([column for column, _ in found], float)
        price = np.linalg.solve(basis, np.ones(len(found)))
        every = [[]]
        for w in weight:
            every = [[*e, n] for e in every for n in range(16 // w + 1) if sum(x * y for x, y in zip(e, weight)) + n * w <= 16]
        assert max((price * e).sum() for e in every) <= 1 + 1e-5
        assert abs(basis.T @ [a for _, a in found] - [demand[w] for w in weight]).max() < 1e-2 and min(a for _, a in found) >= 0


def test_short_texts_share_sequences(spark):
    sequences, ids = check(spark, [""] * 2000)
    assert (sequences, ids) == (1, 2000)
    sequences, ids = check(spark, [None] * 3000 + ["one two three"] * 1500)
    assert sequences <= -(-ids // 4096) + 1


def test_inverse():
    rnd = np.random.default_rng(3)
    for m in (1, 2, 40, 256):
        a = rnd.integers(0, 4, (m, m)) + np.diag(np.full(m, 9.0)) * rnd.choice([-1, 1], m)
        a = a[rnd.permutation(m)]
        assert abs(a @ packing.inverted(a) - np.eye(m)).max() < 1e-8


def test_small_cache_changes_nothing(monkeypatch):
    ids = packing.Ids(packing.tokenizer_path())
    texts = [f"word{i} the of {i % 7}" for i in range(300)]
    want = list(ids(texts))
    monkeypatch.setattr(packing, "CACHED", 50)
    small = packing.Ids(packing.tokenizer_path())
    assert [b for i in range(0, 300, 7) for b in small(texts[i : i + 7])] == want
