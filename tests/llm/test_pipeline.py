import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from corpus_pipeline import STAGES, run  # noqa: E402


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghij", k=4)) for _ in range(n))


def test_each_stage_does_its_work(spark, tmp_path):
    good = {i: words(i, 30 + i % 90) + (f" write to n{i}.m@c.example.org now" if i % 4 < 2 else "") for i in range(200)}
    bad = {1000 + i: " ".join(f"{w}%%%" for w in words(i, 30 + i).split()) for i in range(60)}
    toxic = {2000 + i: words(300 + i, 30 + i) + " vile nasty vile nasty vile" for i in range(60)}
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = {**good, **bad, **toxic, 3000: good[3], 3001: good[4].upper(), 3002: f"{words(900, 40)} {item} {words(901, 40)}", 3003: words(902, 60) + " write to a.b@c.example.org now", 3004: item}
    docs = [(i, t, "en", "s0", len(t)) for i, t in texts.items()] + [(None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in list(good)[::2]] + [(i, 0, 0) for i in list(bad)[::2]] + [(i, 1, 1) for i in list(toxic)[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in STAGES[:-1]:
        got = stage(spark, df, str(tmp_path))
        assert got.columns == df.columns
        df = spark.createDataFrame(got.collect(), df.schema)
        kept.append({r.doc_id: r for r in df.collect()})
    assert not kept[0].keys() & {*bad, *toxic} and kept[0].keys() >= good.keys()
    assert kept[1].keys() >= good.keys() and not kept[1].keys() & {3000, 3001}
    assert "alpha" not in kept[2][3002].text and 3004 not in kept[2] and kept[2][3002].n_chars == len(kept[2][3002].text)
    assert all(kept[2][i].text == good[i] for i in good)
    assert "[EMAIL]" in kept[3][3003].text and all(kept[3][i].text == good[i] if i % 4 > 1 else kept[3][i].text.endswith("write to [EMAIL] now") for i in good)
    pieces = run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept[3])


def test_defined_results(spark, tmp_path):
    """Null, empty and very long texts, repeated rows and ids, clashing names, and empty tables."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, keep boolean, __k string, h string, hit string, terms string, p string, cls int"
    texts = [words(i, 50) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, words(77, 60)), (None, words(78, 60)), (None, None), (50, ""), (51, None), (52, words(79, 30_000)), (53, texts[5])]
    docs = [(i, t, None if i == 4 else "en", "s", len(t or ""), 0.5, False, "k", "h", "x", "t", "p", 1) for i, t in rows]
    for name, some in (("a", docs), ("b", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(some, columns).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        pieces = run(spark, d).collect()
        if not some:
            assert pieces == []
            continue
        # of equal texts the one with the least id stays, of those without words one; a null id goes behind any other
        held = {r.doc_id for r in pieces}
        assert held == {*range(40), 50, 52, None} and 53 not in held
        assert sum(r.start == 0 for r in pieces if r.doc_id == 3) == 2
        long = [r for r in pieces if r.doc_id == 52]
        assert sum(r.length for r in long) == long[0].doc_tokens > 30_000
    df = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in STAGES[:-1]:
        df = stage(spark, df, f"{tmp_path}/a")
        assert df.columns == [c.split()[0] for c in columns.split(", ")]
        df = spark.createDataFrame(df.collect(), df.schema)
    assert {(r.score, r.keep, r["__k"], r.h, r.hit, r.terms, r.p) for r in df.collect()} == {(0.5, False, "k", "h", "x", "t", "p")}
