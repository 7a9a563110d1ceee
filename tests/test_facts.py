"""Layout of facts, places by ranges, and what plans read."""

import random

from pyspark.sql import functions as F

from rollcall.operators.ordered import numbered
from rollcall.plans import credits
from rollcall.sources import documents as io


def test_only_wanted_partitions_are_opened(spark, tmp_path):
    rows = [(g, i, f"n{i % 7}", "", "Art", "", "", "", c, f"L{i}") for g in ("a", "b", "b-2") for c in ("core", "publishing") for i in range(40)]
    df, at = spark.createDataFrame(rows, io.CREDITS).repartition(5), f"{tmp_path}/facts"
    io.write_facts(df, at)
    io.write_facts(df.where("game_id = 'b' and credit_order < 3"), at)
    core = io.read_facts(spark, at, ["core"], ["a", "b"])
    plan = core.where("name_raw = 'n1'")._jdf.queryExecution().executedPlan().toString()
    assert "inclusion_class#" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0] and "game_id#" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "EqualTo(name_raw,n1)" in plan.split("PushedFilters:")[1]
    # the release that was written anew is replaced in the classes it has, others stay
    assert {(r.game_id, r["count"]) for r in core.groupBy("game_id").count().collect()} == {("a", 40), ("b", 3)}
    got = [(r.game_id, r.credit_order) for r in core.orderBy("ord").collect()]
    assert got == sorted(got)
    assert io.read_facts(spark, at, None).count() == 2 * 40 + 2 * 40 + 2 * 3


def test_places_by_ranges(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "x", None]), [rnd.randrange(3), rnd.randrange(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, g string, k array<int>").repartition(7)
    for by in ([], ["g"]):
        got = {r.i: r.place for r in numbered(df, "place", ["k", -F.col("i")], by).collect()}
        groups = {}
        for i, g, k in sorted(rows, key=lambda r: (r[2], -r[0])):
            groups.setdefault(g if by else 0, []).append(i)
        assert got == {i: p for rows_ in groups.values() for p, i in enumerate(rows_)}
    assert numbered(df.limit(0), "place", ["i"]).count() == 0


def test_grid_reads_credits_once(spark, tmp_path):
    """The marts of grid and page read written facts, not the order lines."""
    rnd, d = random.Random(1), str(tmp_path)
    spark.createDataFrame([(o, o % 12, f"{1995 + rnd.randrange(7)}-03-01") for o in range(80)], "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(rnd.randrange(80), rnd.randrange(30), rnd.randrange(1, 8)) for _ in range(300)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 5 + 1}{k % 4 + 1}", rnd.randrange(1, 50), rnd.choice(["STEEL", "TIN CAN", "BRASS"]), "tin") for k in range(30)], "p_partkey long, p_brand string, p_size int, p_type string, p_name string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k,) for k in range(12)], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    for name in ("slot_packing", "hero_numbers"):
        plan = credits.QUERIES[name](spark, d)._jdf.queryExecution().analyzed().toString()
        assert plan.count("l_linenumber") == 0 and plan.count("lineitem") == 0
