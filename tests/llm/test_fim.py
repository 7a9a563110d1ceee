import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rollcall.llm import fim

TEXTS = [None, "", "\n", "a", "a\n", "a\nb", "\n\n\nx", "é漢😀\n😀", "has <P> inside\nx", "<S>", "x<M", "<S<P\n>", "one\ntwo\nthree\nfour\nfive", "\r\n \x0b\n", "l\n" * 3000, "z" * 100_000 + "\n" + "y" * 70_000]


def brute(doc_id, text, unit=fim.LINE, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    t, digest = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    units = [m[0] for m in re.finditer(unit, t)]
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if not t or any(x in t for x in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    out = s + suffix + p + prefix + m + middle if h[3] % 100 < spm else p + prefix + s + suffix + m + middle
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle), out


def rows(n=5):
    out = [(i * 100 + j, t) for i in range(n) for j, t in enumerate(TEXTS)]
    return out + [(7, "one\ntwo\n")] * 3 + [(7, "another\ntext")] + [(None, "no\nid\n"), (None, "no\nid\n"), (None, None), (-5, "x\ny\nz")]


def test_against_brute_force(spark):
    given = rows()
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in given], "doc_id long, text string, form string, N int")
    for args in ({}, {"seed": 3, "rate": 40, "spm": 10, "marks": fim.Marks("[pre]", "[suf]", "[mid]")}, {"unit": r"(?s).", "seed": 1}):
        plain = dict(args, marks=("[pre]", "[suf]", "[mid]")) if "marks" in args else args
        if "unit" in args:
            docs = docs.where("length(text) < 4000 or text is null")
            given = [(i, t) for i, t in given if t is None or len(t) < 4000]
        out = fim.transform(docs, **args).withColumn("back", fim.restored(F.col("form"), F.col("output"), args.get("marks", fim.Marks())))
        assert out.columns == ["doc_id", "text", *fim.RESULTS, "back"]
        got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
        assert got == sorted(((i, t, *brute(i, t, **plain)) for i, t in given), key=repr)
        assert out.where("back <> coalesce(text, '')").count() == 0
    assert fim.transform(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    given = rows(2)
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.op11_fim(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, *(w := brute(i, t))[:4], sha(w[4]), sha(t or "")) for i, t in given), key=repr)


def test_one_dealing_of_units(spark):
    """Window, requests and gathering share one shuffle by row, also where nothing is small enough to broadcast."""
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = fim.transform(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") == 3  # texts, and the units twice, which are one at run time
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_marks_are_found_where_they_were_put():
    for bad in (("", "b", "c"), ("a", "a", "c"), ("<>", "><", "x"), ("ab", "b", "c")):
        with pytest.raises(ValueError, match="marks"):
            fim.Marks(*bad)
