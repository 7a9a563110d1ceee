import itertools
import random

import numpy as np
import xxhash

from rollcall.llm import simhash


def brute_fp(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    ws = [w for w in ws if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if bin(a ^ b).count("1") <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


def near_texts():
    rnd = random.Random(5)
    base = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 6) for _ in range(400))
    texts = [None, "", " \n", "One", "one", "ONE two", "one two Three", "ÀB çd", base]
    for k in range(60):
        w = base.split()
        for _ in range(k // 6 + 1):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 5)}"
        texts.append(" ".join(w))
    return texts + [base, base.upper()]


def test_query_against_brute_force(spark):
    texts = near_texts()
    ids = list(range(100, 100 + len(texts) - 1)) + [None]
    docs = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts)], "doc_id long, text string, component_id int")
    docs = docs.select("component_id", "text", "doc_id")
    fps = [brute_fp(t) for t in texts]
    want = sorted(zip(map(str, ids), (f"{f:016x}" for f in fps), brute_components(ids, fps)))
    for hot in (simhash.HOT, 3):
        got = simhash.near_duplicates(docs, hot=hot).collect()
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_texts_and_ties(spark):
    rnd = random.Random(11)
    long = [" ".join(rnd.choice(["alpha", "Beta", "gamma", "delta", "é"]) for _ in range(60_000)) for _ in range(2)]
    # two shingles set a bit in one of two at most: just half of them is no majority
    texts = [*long, long[0].upper().replace("É", "é"), "one two three four", "one two three four", "w " * 200_000]
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fp(t) for t in texts]
    want = brute_components([9 - i for i in range(len(texts))], fps)
    assert got == {9 - i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, want))}


def test_linear_linking_agrees_with_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 12)
    fps = [base]
    for _ in range(40):
        fps.append(fps[-1] ^ (1 << rng.integers(0, 63, 12)) ^ (1 << rng.integers(0, 63, 12)))
    fps = np.unique(np.concatenate(fps).astype(np.int64))
    pairs = simhash.linked(fps)
    dense, simhash.DENSE = simhash.DENSE, 0
    try:
        assert (simhash.linked(fps) == pairs).all()
    finally:
        simhash.DENSE = dense


def test_every_close_pair_meets_in_a_table():
    ms = simhash.masks()
    assert len(ms) == 15
    rnd = random.Random(2)
    for _ in range(3000):
        diff = sum(1 << i for i in rnd.sample(range(64), 3))
        assert any(not diff & m for m in ms)


def test_one_of_each(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (2, "other words here now", "z"), (1, "a b c d", "y"), (None, "q r s t u", "n"), (None, None, "m"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in got.collect()) == [("1", "y"), ("2", "z"), ("9", "e"), ("None", "n")]
