import math
import random
import zlib
from collections import Counter

from rollcall.llm import lm


def toks(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() + ["</s>"]


def discounts(counts):
    """The same rule, from a Counter."""
    n = Counter(counts.values())
    for k in range(5, 0, -1):
        if all(n[c] for c in range(1, k + 2)):
            a = (k + 1) * n[k + 1] / n[1]
            d = {c: ((c + 1) * n[c + 1] / (c * n[c]) - a) / (1 - a) if a < 1 else -1 for c in range(1, k + 1)}
            if all(0 < x < 1 for x in d.values()):
                return lambda c: d.get(c, 1.0)
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return lambda c: (c - flat) / c if c <= 5 else 1.0


class Brute:
    def __init__(self, texts, order=2):
        self.order, self.n_grams = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            ws = toks(t)
            for k in range(1, order + 1):
                padded = ["<s>"] * (k - 1) + ws
                self.n_grams[k].update(zip(*(padded[i:] for i in range(k))))
        self.uni = Counter({g[0]: c for g, c in self.n_grams[1].items()})
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.hist, self.follow = Counter(), {}
        for k in range(2, order + 1):
            for g, c in self.n_grams[k].items():
                self.hist[g[:-1]] += c
                self.follow.setdefault(g[:-1], []).append(g[-1])
        self.d = [None, *(discounts(self.n_grams[k]) for k in range(1, order + 1))]
        self.free = sum((1 - self.d[1](c)) * c for c in self.uni.values()) / self.n if self.n else 1
        self.kept = {}

    def p1(self, w):
        if not self.n:
            return 1.0
        c = self.uni[w]
        if not self.free:
            return (c or 1) / (self.n + 1)
        return self.d[1](c) * c / self.n if c else self.free

    def p(self, h, w):
        """By the history's own n-grams, or else by the shorter history."""
        if not h:
            return self.p1(w)
        total, k = self.hist[h], len(h) + 1
        if not total:
            return self.p(h[1:], w)
        if h not in self.kept:
            freed = sum((1 - self.d[k](self.n_grams[k][*h, x])) * self.n_grams[k][*h, x] for x in self.follow[h])
            mass = 1 / (total + 1) if not freed else freed / total
            self.kept[h] = freed, mass / (1 - sum(self.p(h[1:], x) for x in self.follow[h]))
        freed, alpha = self.kept[h]
        if c := self.n_grams[k][*h, w]:
            return c / (total + 1) if not freed else self.d[k](c) * c / total
        return alpha * self.p(h[1:], w)


def corpus():
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(60)] + ["É", "The", "x,"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    texts = [None, "", " \n", "never-seen-elsewhere", "same text here"] + ["same text here"] * 9
    texts += [" ".join(rnd.choices(vocab, weights, k=rnd.randint(1, 80))) for _ in range(220)]
    return texts


def compare(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = lm.scored(docs, **how).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    m = Brute([t for i, t in rows if not held(i)], how.get("order", 2))
    want = []
    for i, t in rows:
        ws = toks(t)
        base = sum(math.log10((m.uni[w] + 1) / (m.n + m.v + 1)) for w in ws)
        padded = ["<s>"] * (m.order - 1) + ws
        score = sum(math.log10(m.p(tuple(padded[i : i + m.order - 1]), w)) for i, w in enumerate(ws))
        want.append((str(i), held(i), len(ws), sum(m.uni[w] > 0 for w in ws), m.n, base, score))
    key = lambda r: (r[0], r[2], r[6])
    mine = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9), (a, b)
    return m


def test_query_against_brute_force(spark):
    texts = corpus()
    rows = [*enumerate([*texts, "w1 long w2 " * 4000]), (None, "without an id"), (3, "w1 w2 an id again")]
    m = compare(spark, rows, block=700)
    # exactly normalised over the words and one unknown word
    for h in ["<s>", "w0", "w7", "same", "never-seen-elsewhere"]:
        assert math.isclose(sum(m.p((h,), w) for w in [*m.uni, "<unk>"]), 1, rel_tol=1e-9)
    # and with longer n-grams, in many parts
    for order in (1, 3, 4):
        m = compare(spark, rows, block=1900, order=order)
        for h in [("<s>", "<s>", "w0"), ("w0", "w1", "w0"), ("text", "here", "w0"), ("same", "text", "here")]:
            assert math.isclose(sum(m.p(h[: order - 1], w) for w in [*m.uni, "<unk>"]), 1, rel_tol=1e-9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rollcall_") and not t.isTemporary]


def test_little_or_no_training(spark):
    compare(spark, [(2, "a b"), (5, "a a a a a a a a a a")])
    none = [i for i in range(200) if lm.held_out(i)][:3]
    compare(spark, [(i, "a b c") for i in none])
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_text_is_better_than_the_base(spark):
    rnd = random.Random(8)
    follow = {f"w{i}": [f"w{rnd.randrange(50)}" for _ in range(3)] for i in range(50)}

    def walk():
        w, out = "w0", []
        for _ in range(100):
            w = rnd.choice(follow[w])
            out.append(w)
        return " ".join(out)

    docs = spark.createDataFrame([(i, walk()) for i in range(120)], "doc_id long, text string")
    got = [r for r in lm.scored(docs).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)
