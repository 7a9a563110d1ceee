from rollcall.operators import report


def test_report_tables(spark):
    columns = spark.createDataFrame([("a", 0), ("b", 1), ("b2", 1)], "game_id string, col int")
    people = spark.createDataFrame([("p1", "Ann", ["Ann", "Anne"], ["a", "b"]), ("p2", "Bo", ["Bo"], ["b", "b2"]), ("p3", "Out", ["Out"], ["zz"]), ("p4", "Not Me", ["Not Me"], ["a"])], "person_id string, display_name string, variants array<string>, games array<string>")
    credits = spark.createDataFrame(
        [("a", "Anne", "Acme, Inc.", "core"), ("b", "Ann", "ACME", "core"), ("b", "Bo", "Acme, Inc.", "core"), ("b2", "Bo", "Probe", "core"), ("b", "Vol", "", "community"), ("b", "Ann", "Maker", "publishing"), ("a", "Bo", "Acme", "core")],
        "game_id string, name_raw string, studio string, inclusion_class string",
    )
    staff = report.people_columns(people, columns, ["Not Me"])
    assert {(r.ident, tuple(r.cols)) for r in staff.collect()} == {("p1", (0, 1)), ("p2", (1,))}
    thanks = spark.createDataFrame([("p2", "Bo B.", [0])], "ident string, name string, cols array<int>")
    everyone = report.drawn({"staff": staff, "community": report.community_people(credits, columns), "special_thanks": thanks})
    got = {r["name"]: r for r in everyone.collect()}
    assert set(got) == {"Ann", "Bo", "Vol"} and got["Bo"].cols == [0, 1] and got["Bo"].special_thanks and not got["Ann"].community
    classes = spark.createDataFrame([("maker", "first-party")], "studio string, class string")
    types = spark.createDataFrame([("Probe", "testing")], "studio string, type string")
    work = report.employed(credits, people, everyone, columns, classes, types)
    assert {(r.col, r["name"], r.key, r.type) for r in work.collect()} == {(0, "Ann", "acme", "development"), (1, "Ann", "acme", "development"), (1, "Bo", "acme", "development"), (1, "Bo", "probe", "testing"), (0, "Bo", "acme", "development")}
    only = spark.createDataFrame([("b", "Band", "music", "x")], "game_id string, studio string, role string, type string")
    chips = report.chips(work, ["probe"], only, columns).where("col = 1").orderBy("place").collect()
    assert [(c.studio, c.people) for c in chips] == [("Probe", 1), ("Acme, Inc.", 2), ("Band", None)]
    publishing = spark.createDataFrame([(1, "Ann")], "col int, name string")
    bar = {r.col: r for r in report.composition(everyone, work, publishing, ["probe"]).collect()}
    assert (bar[1].total, bar[1].newcomers, bar[1].vendors, bar[1].named, bar[1].development, bar[1].publishers, bar[1].community) == (3, 1, 2, 1, 1, 1, 1)
    per = spark.createDataFrame([("Bo", "b", "qa"), ("Bo", "b2", "art"), ("Ann", "a", "live"), ("X", "zz", "live")], "name string, game_id string, cls string")
    own, totals, by_col = report.role_tables(per, columns)
    assert {tuple(r) for r in own.collect()} == {("Bo", 1, "art"), ("Ann", 0, "live")}
    assert {tuple(r) for r in totals.collect()} == {("qa", 1), ("art", 1), ("live", 2)} and by_col.count() == 3
