import random

from kinweave.operators.fill import fill_by_dependencies, fill_persons, filled_cells, mine_dependencies

P = "id string, name string, sex string, birth int, death int, birth_imputed int, death_imputed int, loaded_at int"


def tables(spark, persons, parents=(), spouses=(), labels=()):
    mk = spark.createDataFrame
    return mk(list(persons), P), mk(list(parents), "parent_id string, child_id string"), mk(list(spouses), "a string, b string"), mk(list(labels), "id string, dynasty string")


def test_cells_and_sources(spark):
    persons = [("1", "A", "M", 1000, 1050, 0, 0, 1), ("1", "A", "M", 1000, 1050, 0, 0, 2), ("2", "B", "F", None, 1060, 9, 0, 1), ("3", "C", "", 99999, None, None, -1, 1), ("4", None, None, None, None, None, None, 1)]
    out = fill_persons(*tables(spark, persons, [("1", "2"), ("1", None), ("zz", "3"), ("1", "1")], [("2", "3")], [("4", "X"), ("4", ""), ("9", None)]))
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 4
    assert rows["1"]["birth"] == 1000 and rows["1"]["birth_source"] == "observed"
    assert rows["2"]["birth_source"] == "kin" and rows["2"]["birth"] == 1027 and rows["2"]["birth_imputed"] == 1
    assert rows["3"]["birth_was_missing"] and rows["3"]["death"] >= rows["3"]["birth"]
    cells = {(r["person_id"], r["field_name"]) for r in filled_cells(out).collect()}
    assert cells == {("2", "birth"), ("2", "birth_imputed"), ("3", "birth"), ("3", "death"), ("3", "birth_imputed"), ("3", "death_imputed"), *(("4", f) for f in ("birth", "death", "birth_imputed", "death_imputed"))}
    assert all(rows[i][f] is not None for i in rows for f in ("birth", "death", "birth_imputed", "death_imputed"))


def test_empty_and_hopeless(spark):
    assert fill_persons(*tables(spark, [])).count() == 0
    rows = fill_persons(*tables(spark, [("1", "A", "M", None, None, None, None, 1)])).collect()
    assert rows[0]["birth"] is None and rows[0]["birth_source"] == "unfilled"


def test_dependencies_are_mined(spark):
    """k gives good, two columns together give both, noise gives nothing; supersets of what holds are left out."""
    rng = random.Random(1)
    rows = [(f"r{i}", f"k{i % 10}", i % 7, rng.randrange(50), i % 10, (i % 10) * 7 + i % 7, None if i % 3 else rng.randrange(1000)) for i in range(420)]
    df = spark.createDataFrame(rows, "id string, k string, a int, noise int, good int, both int, gaps int")
    got = {(v.dependency.determinants, v.dependency.target): v.confidence for v in mine_dependencies(df, ["k", "a", "noise"], {"good": 0, "both": 0, "gaps": 0})}
    assert got == {(("k",), "good"): 1.0, (("k", "a"), "both"): 1.0}


def test_tolerance_and_triples(spark):
    rows = [(f"r{i}", i % 3, i % 5, i % 7, 1000 + 20 * (i % 105) + i // 105) for i in range(420)]
    df = spark.createDataFrame(rows, "id string, a int, b int, c int, year int")
    assert [v.dependency.determinants for v in mine_dependencies(df, ["a", "b", "c"], {"year": 4}, max_size=3)] == [("a", "b", "c")]
    assert mine_dependencies(df, ["a", "b", "c"], {"year": 2}, max_size=3) == []


def test_filled_like_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", f"k{i % 40}", i % 2, None if rng.random() < 0.3 else (i % 40) * 3) for i in range(200)] + [("x", None, 1, None), ("y", "k3", None, None), ("z", "other", 0, None)]
    df = spark.createDataFrame(rows, "id string, k string, a int, t int")
    verified = mine_dependencies(df, ["k", "a"], {"t": 0})
    got = {r["id"]: (r["t_filled"], r["t_source"]) for r in fill_by_dependencies(df, verified, {"t": 0}).collect()}
    known = {k: t for _, k, _, t in rows if t is not None}
    want = {i: (t, "observed") if t is not None else (known[k], "fd:k") if k in known else (None, None) for i, k, _, t in rows}
    assert got == want


def test_dictionary_fills(spark):
    persons = [(f"{i}", f"N{i // 2}", "M", 1000 + i // 2, 1050 + i // 2, 0, 0, 1) for i in range(40)] + [("x", "N3", "M", None, 1053, 0, 0, 1)]
    row = fill_persons(*tables(spark, persons)).where("id = 'x'").first()
    assert row["birth"] == 1003 and row["birth_source"].startswith("fd:")


def test_coparents_fill(spark):
    """Parents of one set of children were born within ten years of each other: the set tells a missing year."""
    persons = [(f"{s}{i}", f"P{s}{i}", s, 1000 + 40 * i + (3 if s == "F" else 0), None, 0, 0, 1) for i in range(8) for s in "MF"] + [("a", "A", "M", 1200, None, 0, 0, 1), ("b", "B", "F", None, None, 0, 0, 1)]
    links = [(f"{s}{i}", f"c{i}") for i in range(8) for s in "MF"] + [("a", "c"), ("b", "c")]
    row = fill_persons(*tables(spark, persons, links)).where("id = 'b'").first()
    assert (row["birth"], row["birth_source"], row["birth_imputed"]) == (1200, "fd:children", 0)
