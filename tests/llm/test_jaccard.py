import itertools
import random

import xxhash

from rollcall.llm import jaccard, simhash


def brute(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_near_copies_at_0_8_are_joined(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    texts = [None, "", " \n", "one two", "One TWO", "one two three"]
    for k in range(40):
        w = [word() for _ in range(120)]
        texts.append(" ".join(w))
        for at in rnd.sample(range(5, 115), 1 + k % 4):
            w[at] = word()
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sets, root = [brute(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root
    kept = simhash.one_of_each(docs, near=jaccard.near_duplicates, mark=jaccard.name)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_near_copies_that_fingerprints_miss(spark):
    import corpus_pipeline

    rnd, texts = random.Random(8), []
    for _ in range(20):
        w = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(120)]
        texts += [" ".join(w), " ".join([*w[:30], "x", *w[31:80], "y", *w[81:]])]
        assert alike(*map(brute, texts[-2:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.one_of_each(docs).count() > 20
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_large_buckets_lose_no_link(spark):
    """Families that share most bands but aren't similar, and bridges between some of them."""
    rnd, texts = random.Random(11), []
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    base = [word() for _ in range(300)]
    for family in range(5):
        own = base[:]
        for at in range(10, 290, 40):
            own[at : at + 3] = [f"f{family}{at}{i}" for i in range(3)]
        for _ in range(12):
            w = own[:]
            for at in rnd.sample(range(300), 3):
                w[at] = word()
            texts.append(" ".join(w))
        if family == 3:
            texts += [" ".join(own[:cut] + base[cut:]) for cut in (50, 120, 200, 260)]
    texts.append(" ".join(base))
    sets, root, n = [brute(t) for t in texts], list(range(len(texts))), 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        n += 0.6 < len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8
        if alike(sets[i], sets[j]):
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert n > 100 and 1 < len(set(root)) < len(texts) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ({}, {"small": 3, "window": 2, "block": 7}):
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, **sizes).collect()}
        assert [got[i] for i in range(len(texts))] == root, sizes


def test_covering_tables_join_every_similar_pair_within_three_bits(spark):
    """The SimHash tables by themselves: bands are given keys that no two points share."""
    from pyspark.sql import functions as F

    rnd, texts = random.Random(21), []
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    for k in range(60):
        w = [word() for _ in range(300)]
        texts += [" ".join(w), " ".join([*w[:150], word(), *w[151:]]), " ".join([*w[: 10 + k], word(), *w[11 + k :], word()])]
    base = [word() for _ in range(400)]
    texts += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 400, 10)]
    sets = [brute(t) for t in texts]
    sims = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in ([xxhash.xxh64_intdigest(x.encode(), 42) for x in s] for s in sets)]
    assert [jaccard.fingerprint(jaccard.shingles(t)) % 2**64 for t in texts] == sims and jaccard.fingerprint(jaccard.shingles("")) == 0
    root, similar = list(range(len(texts))), 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        similar += alike(sets[i], sets[j])
        if alike(sets[i], sets[j]) and bin(sims[i] ^ sims[j]).count("1") <= 3:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert similar > 200 and 60 < len(set(root)) < len(texts) - 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketches = jaccard.sketched(docs, "doc_id", "text")
    apart = sketches.withColumn("keys", F.transform("keys", lambda k: F.col("fp")))
    for sizes in ({}, {"small": 3, "window": 2, "block": 7}):
        labels = jaccard.link(docs, apart, "text", **sizes)
        got = {r.doc_id: r.component_id for r in simhash.grouped(sketches.select("id", "fp"), labels, "doc_id").collect()}
        # a pair of more bits may meet by chance and is then compared as well, so classes may be larger but none is split
        assert all(got[i] == got[r] for i, r in enumerate(root)), sizes
        assert all(alike(sets[i], sets[j]) or got[i] != got[j] for i in range(0, 180, 3) for j in range(3, 180, 3) if i != j), sizes
