"""The scan in blocks against plain walks and against one window a document."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollcall.operators import context


def test_blocks_against_a_walk(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(d, i, rnd.choice([None, None, f"v{i}"]), rnd.choice([None, False, False, True]), rnd.choice([None, 2, 3, 4])) for d in ("a", "b", None, "c") for i in range(60)]
    want, open_, stack = {}, {}, {}
    for d, i, v, r, level in rows:
        if r:
            open_[d] = None
        open_[d] = v if v is not None else open_.get(d)
        s = stack.setdefault(d, [])
        if level:
            s[:] = [(k, t) for k, t in s if k < level] + [(level, f"h{i}")]
        want[d, i] = (open_[d], " / ".join(t for _, t in s))
    df = spark.createDataFrame(rows, "doc string, i int, v string, r boolean, level int").repartition(3)
    for size in (1, 7, 1000):
        monkeypatch.setattr(context, "BLOCK", size)
        filled = {(x.doc, x.i): x.out for x in context.forward_fill(df, F.col("v"), "out", "doc", "i", F.col("r")).collect()}
        assert filled == {k: v[0] for k, v in want.items()}
        titled = df.withColumn("t", F.concat(F.lit("h"), F.col("i").cast("string")))
        paths = {(x.doc, x.i): x.path for x in context.heading_stack(titled, "level", "t", "doc", "i", [2, 3, 4]).collect()}
        assert paths == {k: v[1] for k, v in want.items()}
    assert context.forward_fill(df.limit(0), F.col("v"), "out", "doc", "i").count() == 0


def test_asof_of_a_hot_key(spark):
    rnd, start = random.Random(3), datetime(2024, 1, 1)
    moment = lambda: start + timedelta(minutes=rnd.randrange(400))
    left = [(i, "hot" if i % 3 else f"k{i % 5}", moment()) for i in range(400)]
    right = [(k, t, i) for i, (k, t) in enumerate({("hot" if i % 2 else f"k{i % 5}", moment()) for i in range(300)})]
    a, b = spark.createDataFrame(left, "id int, key string, at timestamp"), spark.createDataFrame(right, "key string, at timestamp, v int")
    for strict in (True, False):
        got = {r.id: r.found for r in context.asof_backward(a, b, "key", "at", "v", "found", strict).collect()}
        for i, k, t in left:
            before = [(u, v) for q, u, v in right if q == k and (u < t or (not strict and u == t))]
            assert got[i] == (max(before)[1] if before else None)
    blocks = a.select(context.quantile_blocks(a, "at").alias("b"), "key").where("key = 'hot'").groupBy("b").count().collect()
    assert len(blocks) > 30 and max(r["count"] for r in blocks) < 30


def test_one_long_document_is_many_tasks(spark, monkeypatch):
    """600,000 lines in one document: equal to the window over the document, and no task has more than a part of them."""
    monkeypatch.setattr(context, "BLOCK", 20_000)
    n = 600_000
    lines = spark.range(n).select(F.lit("one").alias("doc"), F.col("id").alias("i"), F.when(F.xxhash64("id") % 90_001 == 0, F.col("id")).alias("v"), (F.xxhash64("id", F.lit(1)) % 300_007 == 0).alias("r"))
    got = context.forward_fill(lines, F.col("v"), "out", "doc", "i", F.col("r"))
    run = W.partitionBy("doc").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    part = lines.withColumn("p", F.sum(F.col("r").cast("int")).over(run))
    want = part.withColumn("out", F.last("v", ignorenulls=True).over(W.partitionBy("doc", "p").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    digest = lambda df: df.agg(F.sum(F.xxhash64("i", "out").cast("decimal(38,0)")), F.count("out"), F.count("*")).first()
    assert digest(got) == digest(want)
    assert lines.groupBy(context.counted_blocks("i")).count().agg(F.max("count")).first()[0] == 20_000
