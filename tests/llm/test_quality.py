import bisect
import math
import random
import re

from pyspark.sql import functions as F

from rollcall.llm import quality


def corpus(n=900):
    rnd = random.Random(9)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        ws = rnd.choices(words, k=rnd.randint(20, 120))
        kind = rnd.choices("gjt", [7, 2, 1])[0]
        if kind == "j":
            ws = [w + "%%%" for w in ws]
        if kind == "t":
            for k in range(0, len(ws), 6):
                ws[k] = rnd.choice(["vile", "nasty"])
        docs.append((i, " ".join(ws), "big" if i % 3 else f"host{i % 40}", rnd.choice(["a", None]), kind))
        if i % 2:
            labels.append((i, int(kind != "j"), int(kind == "t")))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    kept = {r.doc_id for r in quality.filtered(d, lab).collect()}
    unseen = [r for r in docs if not r[0] % 2]
    right = sum((r[0] in kept) == (r[4] == "g") for r in unseen)
    assert right / len(unseen) > 0.97
    assert quality.filtered(d, lab).columns == d.columns


def test_posteriors_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(f"h{min(int(rnd.expovariate(0.4)), 9)}", rnd.choice(["x", "y", None])) for _ in range(500)]
    rows = [(h, q, float(min(max(rnd.gauss(0.5 + 0.04 * int(h[1]), 0.2), 0), 1))) for h, q in rows]
    got, mean = quality.posteriors(spark.createDataFrame(rows, "source string, lang string, __p double"), "source", "lang")
    ps = [p for *_, p in rows]
    assert math.isclose(mean, sum(ps) / len(ps), rel_tol=1e-6)

    def sites(key):
        out = {}
        for h, q, p in rows:
            n, s = out.get(key(h, q), (0, 0.0))
            out[key(h, q)] = (n + 1, s + p)
        return out

    def prior(table):
        spread = sum(m * (1 - m) for _, _, m in table) / len(table)
        tau = max(sum((s - n * m) ** 2 / n for n, s, m in table) - spread * len(table), 0) / max(sum(n for n, *_ in table) - len(table), 1)
        return min(max(spread / tau - 1, 1), 1e6) if tau > 0 else 1e6

    hosts = sites(lambda h, q: h)
    k = prior([(n, s, mean) for n, s in hosts.values()])
    post = {h: (k * mean + s) / (k + n) for h, (n, s) in hosts.items()}
    paths = sites(lambda h, q: (h, q))
    kp = prior([(n, s, post[h]) for (h, _), (n, s) in paths.items()])
    want = {(h, q or "\x00"): (post[h], (kp * post[h] + s) / (kp + n)) for (h, q), (n, s) in paths.items()}
    mine = {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in got.collect()}
    assert mine.keys() == want.keys()
    for key in want:
        assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(mine[key], want[key]))


def test_defined_results(spark):
    docs, labels = corpus(60)
    docs += [(None, None, None, None, None), (5, "", "big", "a", ""), (5, "", "big", "a", "")]
    labels += [(7, None, 0), (None, 1, 0)]
    d, lab = frames(spark, docs, labels)
    assert quality.scores(d.drop("score"), lab).count() == len(docs)
    assert quality.filtered(d, lab.limit(0)).count() == len(docs)
    assert quality.filtered(d.limit(0), lab).count() == 0


def plain_features(text):
    """Form features and words, by characters and lists."""
    raw = text or ""
    size, chunks, lines = max(len(raw.encode()), 1), raw.split(), raw.split("\n")
    n = max(len(chunks), 1)
    share = lambda test: sum(map(test, raw)) / size
    form = [
        share(lambda c: 33 <= ord(c) < 127 and not c.isalnum() and c not in ".,'-\""),
        share(lambda c: "A" <= c <= "Z"),
        share(lambda c: "0" <= c <= "9"),
        sum(a == b for a, b in zip(chunks, chunks[1:])) / n,
        len(set(chunks)) / n,
        len(raw.encode()) / n,
        1 - len(set(lines)) / len(lines),
        raw.count("!") / n,
        raw.count("|") / n,
    ]
    words = {w.lower().encode() for w in re.findall(r"[A-Za-z]+", raw)}
    return form, words | {w[:5] + b"-" for w in words if len(w) > 5}


def test_query_against_brute_force(spark, tmp_path):
    docs, labels = corpus(500)
    docs += [(901, None, "big", "a", ""), (902, "", None, None, ""), (903, "long words " * 40_000, "big", "a", ""), (904, docs[0][1], "\x00", "a", "")]
    d, lab = frames(spark, docs, labels)
    d.write.parquet(f"{tmp_path}/documents.parquet"), lab.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.train(d, lab)
    plain = {r[0]: plain_features(r[1]) for r in docs}
    score = lambda z: 1 / (1 + math.exp(-z))

    def parts(f):
        """Each weight that a text takes part in, by name."""
        form, words = f
        return {"bias": model.bias, **{w: model.words[w] for w in words & model.words.keys()}, **{(j, k): model.bins[j][k] for j, k in ((j, bisect.bisect_left(model.edges[j], x)) for j, x in enumerate(form))}}

    # the weights are the optimum of the logistic loss: no weight's gradient is left
    good = {i: int(q == 1 and t == 0) for i, q, t in labels}
    seen, left = {}, {}
    for i, y in good.items():
        seen.setdefault((frozenset(plain[i][1]), y), i)
    for (_, y), i in seen.items():
        own = parts(plain[i])
        p = score(sum(own.values()))
        for k, w in own.items():
            left[k] = left.get(k, 2e-5 * w) + (p - y) / len(seen)
    assert max(map(abs, left.values())) < 2e-4
    # and every document's score follows from them and the sites' posteriors
    p_doc = {i: score(sum(parts(f).values())) for i, f in plain.items()}
    got = {r.doc_id: r for r in quality.op8_quality(spark, str(tmp_path)).collect()}
    rows = spark.createDataFrame([(r[2], r[3], p_doc[r[0]]) for r in docs], "source string, lang string, __p double")
    sites, mean = quality.posteriors(rows, "source", "lang")
    post = {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in sites.collect()}
    assert len(got) == len(docs)
    for i, _, host, path, _ in docs:
        h, q = post["\x00" if host is None else host, "\x00" if path is None else path]
        odds = lambda x: math.log(x / (1 - x))
        want = score(odds(p_doc[i]) + odds(q) - odds(mean))
        r = got[i]
        assert (r.host, r.path, r.keep) == (host, path, want >= 0.5)
        assert all(abs(a - b) < 2e-6 for a, b in ((r.p_doc, p_doc[i]), (r.host_posterior, h), (r.path_posterior, q), (r.score, want)))


def test_clashing_names(spark):
    docs, labels = corpus(80)
    d, lab = frames(spark, [r[:4] + ("s",) for r in docs], labels)
    for c in ("p", "result", "host", "path", "site", "keep", "__p", "P_DOC"):
        d = d.withColumn(c, F.lit("own"))
    kept = quality.filtered(d, lab)
    assert kept.columns == d.columns and {(r.score, r.keep, r.P_DOC) for r in kept.collect()} == {("s", "own", "own")}
    out = quality.scores(d, lab)
    assert out.columns[-5:] == quality.RESULTS and not {"score", "P_DOC", "keep"} & set(out.columns[:-5]) and out.where("keep is null").count() == 0
