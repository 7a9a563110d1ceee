"""The grid against a plain walk over rows and columns."""

import random

from pyspark.sql import functions as F

from rollcall.operators import layout

ORDER = layout.ROLE_ORDER


def plain(people, width, by_shape, sink):
    """(placed, overflow) person by person."""
    mark = lambda p: 1 if p["publisher"] else 2 if p["community"] else 0
    role = lambda p, c: ORDER.index(p["roles"][c]) if c in p["roles"] else len(ORDER)

    def key(p):
        c = p["cols"]
        if by_shape:
            return (c[0] >= 3, -c[-1], c[0], [-x for x in reversed(c)], mark(p) if sink else 0, [role(p, x) for x in c], p["name"])
        return (c[0] >= 3, -c[-1], c[0], -len(c), p["name"])

    rows = sorted((p for p in people if len(p["cols"]) > 1), key=key)
    placed = [(i, c, p["name"]) for i, p in enumerate(rows) for c in p["cols"]]
    taken = [range(min(p["cols"] + p["reprints"]), max(p["cols"] + p["reprints"]) + 1) for p in rows]
    over = []
    for c in range(width):
        single = sorted((p for p in people if p["cols"] == [c]), key=lambda p: (mark(p), role(p, c), p["name"]) if sink else p["name"])
        free = [i for i, t in enumerate(taken) if c not in t]
        placed += [(i, c, p["name"]) for i, p in zip(free, single)]
        over += [(c, p["name"]) for p in single[len(free) :]]
    return sorted(placed), sorted(over)


def test_slot_packing_against_brute_force(spark, monkeypatch):
    rnd, people = random.Random(12), []
    for i in range(260):
        cols = sorted(rnd.sample(range(6), rnd.choice([1, 1, 1, 2, 3])))
        people.append({"name": f"p{rnd.randrange(10**6):06d}{i}", "cols": cols, "publisher": rnd.random() < 0.2, "community": rnd.random() < 0.2, "roles": {c: rnd.choice(ORDER) for c in cols if rnd.random() < 0.8}, "reprints": rnd.sample(range(6), 1) if rnd.random() < 0.3 else []})
    df = spark.createDataFrame(people, "name string, cols array<int>, publisher boolean, community boolean, roles map<int,string>, reprints array<int>")
    section = F.when(F.array_min("cols") < 3, 0).otherwise(1)
    for by_shape, sink in ((True, True), (True, False), (False, False)):
        placed, over = layout.slot_packing(df, 6, by_shape, sink, section)
        want = plain(people, 6, by_shape, sink)
        assert sorted(tuple(r) for r in placed.select("row", "col", "name").collect()) == want[0]
        assert sorted(tuple(r) for r in over.collect()) == want[1]
    monkeypatch.setattr(layout, "CELLS", 7)  # free cells are numbered in several groups
    placed, _ = layout.slot_packing(df, 6, section=section)
    assert sorted(tuple(r) for r in placed.select("row", "col", "name").collect()) == plain(people, 6, True, True)[0]
    n = sum(len(p["cols"]) > 1 and min(p["cols"]) < 3 for p in people)
    assert sorted(tuple(r) for r in layout.sections(df, section).collect()) == [(0, 0), (1, n)]


def test_without_marks_or_roles(spark):
    df = spark.createDataFrame([("b", [1, 0]), ("a", [0, 1]), ("c", [2])], "name string, cols array<int>")
    placed, over = layout.slot_packing(df, 3)
    assert sorted(tuple(r) for r in placed.collect()) == [(0, 0, "a"), (0, 1, "a"), (0, 2, "c"), (1, 0, "b"), (1, 1, "b")] and not over.count()
    assert layout.slot_packing(df.limit(0), 3)[0].count() == 0
