import hashlib
import random
import re

from rollcall.llm import decontaminate as d

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    ws, hit, found = words(text), set(), set()
    for key, t in items:
        iw = words(t)
        n = min(10, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[k : k + n]:
                    hit.update(range(i, i + n))
                    if key is not None:
                        found.add(str(key))
    return len(ws), len(hit), sorted(found)


def tables(seed=3):
    rnd = random.Random(seed)
    vocab = ["a", "B", "c1", "é", "Dd", "x"]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    items = [(i, text(rnd.choice([1, 3, 9, 10, 11, 25]) + (8 if i % 3 else 0))) for i in range(14)]
    items += [(2, items[2][1]), (90, None), (91, "?!"), (None, "q w e r t y u i o p"), (92, "solo")]
    docs = [None, "", "...", "solo", "SOLO, solo", "q w e r t y u i o p", "z q-w e.r t y u i o p z"]
    for i in range(60):
        base = text(rnd.randint(0, 60))
        it = rnd.choice(items[:14])[1]
        cut = it.split(" ")[rnd.randint(0, 2) :]
        docs.append(f"{base}, {' - '.join(cut).upper()}! {text(5)}" if i % 2 else base)
    docs.append(" ".join(["long"] * 40_000) + " " + items[4][1])
    return items, docs


def test_query_against_brute_force(spark, monkeypatch):
    items, docs = tables()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = [brute(t, items) for t in docs]
    for block in (d.BLOCK_WORDS, 30):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        got = {r.doc_id: r for r in d.scan(df, it).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i]["items"]) for i in range(len(docs))] == want
    assert d.scan(df, it.limit(0)).where("n_hit > 0").count() == 0
    assert d.scan(df.limit(0), it).count() == 0


def test_clean_leaves_no_window_and_touches_no_clean_text(spark, monkeypatch):
    items, docs = tables(4)
    items = [x for x in items if len(words(x[1])) >= 9]
    df = spark.createDataFrame([(t, i, len(t or "")) for i, t in enumerate(docs)], "text string, doc_id long, n_chars long")
    it = spark.createDataFrame(items, "item_id long, text string")
    for block in (d.BLOCK_WORDS, 30):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        out = d.clean(df, it)
        assert out.columns == df.columns
        got = {r.doc_id: r for r in out.collect()}
        for i, t in enumerate(docs):
            n, hit, _ = brute(t, items)
            if not hit:
                assert got[i].text == t
            elif i in got:
                assert brute(got[i].text, items)[1] == 0 and got[i].n_chars == len(got[i].text)
            else:
                assert hit > 0


def test_clean_is_the_same_for_any_blocks(spark, monkeypatch):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    line = lambda *parts: " ".join(x for p in parts for x in p)
    items = [(1, line(w[:12])), (2, line(w[20:32])), (3, line(w[6:18])), (4, line(w[40:46], ["\u2026"], w[60:66]))]
    docs = [
        line(w[:12], w[80:96], w[20:32]),  # each item hits 30 %, both 60 %
        line(w[70:90], w[:18], w[90:99]),  # windows of two items overlap
        line(w[70:90], w[40:46], w[20:32], w[60:66], w[90:99]),  # hit again once cut
        line(w[70:99]),
    ]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(docs)], "doc_id long, text string, n_chars long")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for block in (d.BLOCK_WORDS, 12):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        got[block] = sorted((r.doc_id, r.text, r.n_chars) for r in d.clean(df, it).collect())
        assert [i for i, _, _ in got[block]] == [1, 2, 3]
        assert all(words(t.replace("\u2026", " ")) == [*w[70:90], *w[90:99]] for i, t, _ in got[block] if i < 3)
    assert len({str(g) for g in got.values()}) == 1


def test_clean_ends_where_the_cut_mark_is_an_item(spark, monkeypatch):
    w = [f"w{chr(97 + i)}" for i in range(26)]
    items = [(1, "\u2026"), (2, " ".join(w[:10])), (3, " ".join([*w[10:14], "\u2026", *w[14:19]]))]
    docs = [" ".join([*w[10:14], *w[:10], *w[14:19], *w[19:26], *w[19:26]]), "\u2026", "a \u2026 b", " ".join(w[10:])]
    df = spark.createDataFrame([(i, t, len(t), b"x") for i, t in enumerate(docs)], "doc_id long, text string, n_chars long, __hit binary")
    it = spark.createDataFrame(items, "item_id long, text string")
    for block in (d.BLOCK_WORDS, 3):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        out = d.clean(df, it)
        assert out.columns == df.columns
        got = {r.doc_id: words(r.text.replace("\u2026", " ")) for r in out.collect()}
        assert got == {0: [*w[19:26], *w[19:26]], 2: ["a", "b"], 3: w[10:]}


def test_a_pass_a_block(spark, monkeypatch):
    """Blocks aren't chained in one plan: each has a table behind it, and one automaton is held at a time."""
    items, docs = tables(7)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    monkeypatch.setattr(d, "BLOCK_WORDS", 30)
    out = d.scan(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_digest(spark, tmp_path):
    spark.createDataFrame([(1, "p q r s t u v w x y z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "q r s t u v w x y z"), (9, "p q r s t u v w x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = d.op4_decontaminate(spark, str(tmp_path)).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (11, 11, 2, True)
    assert r.items_sha256 == hashlib.sha256(b"10,9").hexdigest()


def test_long_runs_of_one_word_take_linear_time():
    """An item of 100,000 equal words, and texts that repeat it, are built and walked a constant step a word."""
    import time

    n, begin = 100_000, time.perf_counter()
    auto = d.Automaton([("junk", [b"w"] * n), ("short", [b"a", b"w"])], 10)
    hit, found = auto.walk([b"x", b"a"] + [b"w"] * n + [b"x"] + [b"w"] * 9)
    assert time.perf_counter() - begin < 6
    assert found == {"junk", "short"} and hit[1 : n + 2].all() and not hit[0] and not hit[n + 2 :].any()
