import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from rollcall.llm import collocations as c

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP))]


def brute(rows, least, longest=4, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, seen in f.items():
        often = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        above = Counter()
        for q, fq in often.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    above[q[i : i + k]] = max(above[q[i : i + k]], fq)
        best = []
        for p, a in often.items():
            if 100 * above[p] >= covered * a:
                continue
            score, k = min((2000000 * a // (seen[p[:k]] + seen[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def documents(seed=3, n=60):
    rnd = random.Random(seed)
    vocab = ["the", "of", "The", "é", "漢字", "x y", "a\x1cb", "it's", "-", "AND", "and", "\x00", "😀", "no"]
    out = [(None, None), ("en", ""), ("en", None), ("fr", "."), ("en", " \t "), ("en", "a b c d " * 50), ("en", "A b, c d " * 50), (None, "x y\nx y " * 40), ("de", "new york city. " * 3)]
    for _ in range(n):
        said = " ".join(rnd.choice(vocab[:6] if rnd.random() < 0.7 else vocab) + rnd.choice(["", "", "", ",", ".", "\n", "\x0b", "!", "\t", " "]) for _ in range(rnd.randrange(90)))
        out.append((rnd.choice(["en", "en", "fr", "", None]), said))
    out += [("en", "of the same kind of the same kind; " * 12)] * 3
    return out + [("long", "one two three four five " * 30_000)]


def test_against_brute_force(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], "lang string, text string, rank int, phrase string").repartition(3)
    for limit, args in ((c.POSITIONS, {"least": 5}), (200, {"least": 8, "top": 12, "covered": 60}), (200, {"least": 4, "longest": 2}), (60, {"least": 6, "longest": 5})):
        monkeypatch.setattr(c, "POSITIONS", limit)  # so that a language has several shards
        got = c.mine(df, **args)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, **args)
    assert c.mine(df.limit(0)).count() == 0 and c.mine(df.where("text is null")).count() == 0


def test_query(spark, tmp_path):
    rows = documents(5)
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in c.op13_collocations(spark, str(tmp_path)).collect()) == brute(rows, 30)


def test_bitmaps_by_small_batches(monkeypatch):
    """The walk gives the same counts whatever the size of its batches."""
    shard = c.Positions()
    texts = [t for _, t in documents(8, 30)[:-1]]
    for t in texts:
        shard.add((t or "").encode())
    rows = shard.rows(1, "x")
    words = rows["word"].to_pylist()
    ids = pa.array([7 * len(words) - 5 * i for i in range(len(words))])  # any order of ids
    table = pa.table({"id": ids, "bits": rows["bits"]})
    word_of = dict(zip(ids.to_pylist(), words))
    want = Counter(tuple(w[i : i + k]) for t in texts for w in pieces(t) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    assert dict(zip(words, rows["n"].to_pylist())) == {p[0]: n for p, n in want.items() if len(p) == 1}
    steps = np.array([[a, b] for a in word_of for b in word_of if want[word_of[a], word_of[b]] >= 9])
    pairs = {tuple(word_of[x] for x in p) for p in steps.tolist()}
    for size in (1, 50, 10**6):
        monkeypatch.setattr(c, "STEPS", size)
        bitmaps = c.Bitmaps(table)
        got = Counter()
        for found, n in bitmaps.pairs():
            for p, k in zip(found.tolist(), n.tolist()):
                assert tuple(word_of[x] for x in p) not in got
                got[tuple(word_of[x] for x in p)] = k
        assert got == {p: n for p, n in want.items() if len(p) == 2}
        got = {}
        for found, n in bitmaps.longer(steps, 4):
            got |= {tuple(word_of[x] for x in p): k for p, k in zip(found.tolist(), n.tolist())}
        assert got == {p: n for p, n in want.items() if len(p) > 2 and all(q in pairs for q in zip(p, p[1:]))}


def test_products_beyond_64_bits(spark):
    big = 9 * 10**18
    phrases = spark.createDataFrame([([1, 2], big), ([1, 2, 3], big)], "ids array<long>, f long")
    known = spark.createDataFrame([([1], big), ([2], big + 7), ([3], big), ([1, 2], big), ([2, 3], big + 1)], "ids array<long>, f long")
    assert sorted((r.ids, r.l, r.r, r.score) for r in c.scored(phrases, known).collect()) == [([1, 2], big, big + 7, 999999), ([1, 2, 3], big, big + 1, 999999)]
    assert [r.ids for r in c.uncovered(phrases, 80).collect()] == [[1, 2, 3]]
