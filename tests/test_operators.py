import math

import pytest
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.functions import stats
from kinweave.functions import text as X
from kinweave.operators import community, econ, graph, panel, relational, sampling
from kinweave.operators.components import connected_components
from kinweave.plans.runner import Run, Stage, numeric_tokens, verify_tables
from kinweave.sources import readers, sinks


def test_scalars(spark):
    df = spark.createDataFrame([("12.7", "m"), (" ", "x"), ("nan", None), ("abc", "F"), (None, " f ")], "y string, s string")
    assert [r[0] for r in df.select(S.to_year("y")).collect()] == [12, None, None, None, None]
    assert [r[0] for r in df.select(S.norm_sex("s")).collect()] == ["M", "", "", "F", "F"]
    n = spark.createDataFrame([(k, n) for k, n in ((1, 2), (0, 0), (5, 5))], "k int, n int")
    rows = n.select(*[c.alias(a) for c, a in zip(S.wilson("k", "n"), "pab", strict=True)]).collect()
    assert rows[1]["p"] is None and 0 < rows[0]["a"] < 0.5 < rows[0]["b"]
    assert spark.createDataFrame([(-7,)], "x int").select(S.bucket("x", 10)).first()[0] == -10


def test_distributions():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.073388, abs=1e-5)
    lo, hi = stats.clopper_pearson(186, 195)
    assert (round(100 * lo, 1), round(100 * hi, 1)) == (91.4, 97.9)
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-5)
    assert stats.clopper_pearson(0, 0) == (0.0, 1.0)


def test_range_join_matches_theta(spark):
    pts = spark.createDataFrame([(i, y) for i, y in enumerate([1000, 1024, 1025, 1026, None, 1300])], "i int, y int")
    iv = spark.createDataFrame([("a", 900, 1010), ("b", 1040, 1041), ("c", 1026, 1100), ("d", None, 1000), ("e", 1000, 1400)], "k string, s int, e int")
    got = {(r["i"], r["k"]) for r in relational.range_join(pts, iv, "y", "s", "e", 15).collect()}
    want = {(r["i"], r["k"]) for r in pts.join(iv, (iv.s <= pts.y + 15) & (iv.e >= pts.y - 15)).collect()}
    assert got == want
    assert relational.range_join(pts, iv, "y", "s", "e", 15).count() == len(want)


def test_asof(spark):
    d = spark.createDataFrame([("a", 1, 5), ("b", 4, 6), ("c", 10, 12)], "v string, s int, e int")
    x = spark.createDataFrame([(5,), (8,), (0,), (None,), (11,)], "t int")
    assert {(r["t"], r["v"]) for r in relational.asof_interval(x, d, "t", "s", "e", "v").collect()} == {(5, "b"), (8, "b"), (0, None), (None, None), (11, "c")}


def test_attach_keeps_clashing_names(spark):
    a = spark.createDataFrame([(1, 2)], "id int, x int")
    b = spark.createDataFrame([(1, 3)], "id int, x int")
    assert relational.attach(a, b, on="id").columns == ["id", "x", "x_1"]


def test_windows_keep_empty(spark):
    df = spark.createDataFrame([(805, 1), (855, 0), (None, 1)], "y int, f int")
    rows = panel.window_panel(df, "y", 50, 10, 800, 900, ["f"]).orderBy("window_start").collect()
    assert [r["window_start"] for r in rows] == [800, 810, 820, 830, 840, 850]
    assert rows[0]["n"] == 1 and rows[0]["share_f"] == 1.0 and rows[5]["n_f"] == 0
    empty = panel.window_panel(df.limit(0), "y", 50, 10, 800, 900, ["f"]).collect()
    assert len(empty) == 6 and all(r["share_f"] is None for r in empty)


def test_kappa_and_rand(spark):
    df = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")], "a string, b string")
    r = panel.kappa(df, "a", "b").first()
    assert r["n"] == 50 and r["kappa"] == pytest.approx(0.4)
    assert panel.adjusted_rand(df.withColumn("c", F.col("a")), "a", "c").first()["ari"] == pytest.approx(1.0)


def test_reciprocity(spark):
    claims = spark.createDataFrame([("1", "2", "a"), ("1", "2", "b"), ("3", "4", "a"), ("3", "5", "b"), ("6", "7", "b")], "a string, b string, side string")
    rows = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    assert {tuple(r) for r in panel.reciprocity_report(claims, rows).collect()} == {("mirrored", 1), ("a_only_with_row", 1), ("b_only_with_row", 1), ("b_only_no_row", 1)}


def test_gate_blocks_paths(spark):
    adj = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "s string, t string")
    births = spark.createDataFrame([("a", 1000), ("b", 1100), ("c", 900)], "id string, birth int")
    seeds = graph.plain_seeds(spark.createDataFrame([("a", 1050)], "id string, y int"), "id", F.col("y"))
    assert {r["node"] for r in graph.gated_ball(seeds, adj, births, 3).collect()} == {"a"}
    assert {r["node"] for r in graph.gated_ball(seeds, adj, None, 3).collect()} == {"a", "b", "c"}


def test_label_ties(spark):
    adj = spark.createDataFrame([("x", "m"), ("m", "x"), ("y", "m"), ("m", "y")], "s string, t string")
    anchors = spark.createDataFrame([("x", "small"), ("y", "big"), ("far", "big")], "id string, label string")
    got = {r["id"]: r["label"] for r in graph.propagate_labels(adj, anchors).collect()}
    assert got["m"] == "big" and got["x"] == "small"


def test_multigraph_degree(spark):
    parents = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "b")], "parent_id string, child_id string")
    spouses = spark.createDataFrame([("b", "a"), ("a", "b")], "a string, b string")
    degree = lambda m: graph.degrees(graph.build_graph(parents, spouses, multigraph=m)).where("id = 'a'").first()["degree"]
    assert degree(True) == 2 and degree(False) == 1


def test_components(spark):
    df = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("z", "z"), (None, "q"), ("x", "y")], "a string, b string")
    assert {(r["node"], r["component"]) for r in connected_components(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "z")}
    assert connected_components(df.limit(0)).count() == 0


def test_heiress_cases(spark):
    persons = spark.createDataFrame([("g", "M", 1000, 1050), ("s", "M", 1030, 1040), ("k", "M", 1035, None), ("d", "F", 1032, 1090)], "id string, sex string, birth int, death int")
    kids = spark.createDataFrame([("g", "s", "M"), ("g", "d", "M"), ("s", "k", "M"), ("d", "zz", "F")], "parent_id string, child_id string, parent_sex string")
    focal = spark.createDataFrame([("g", 1045)], "id string, t int")
    down = graph.male_line_descendants(focal, kids)
    assert {r["node"] for r in down.collect()} == {"g", "s", "k", "d"}
    assert graph.line_status(down, persons, focal).first()["status"] == "unknown"
    cut = graph.male_line_descendants(focal, kids, spark.createDataFrame([("k",)], "id string"))
    assert graph.line_status(cut, persons, focal).first()["status"] == "extinct"
    ruled = graph.line_status(cut, persons, focal, spark.createDataFrame([("g", "open")], "id string, status string"))
    assert ruled.first()["status"] == "open"


def test_imputation_rules(spark):
    persons = spark.createDataFrame([("p", "", 1000, None), ("c", "M", None, None), ("g", "F", None, None), ("lone", "M", None, 1100)], "id string, sex string, birth int, death int")
    parents = spark.createDataFrame([("p", "c"), ("c", "g")], "parent_id string, child_id string")
    rows = {r["id"]: r for r in graph.impute_years(persons, parents, spark.createDataFrame([], "a string, b string")).collect()}
    assert rows["c"]["birth"] == 1027 and rows["g"]["birth"] == 1057 and rows["lone"]["birth"] == 1040
    assert rows["p"]["birth_imputed"] == 0 and rows["c"]["birth_imputed"] == 1 and rows["p"]["death"] == 1060


def test_communities():
    a = [(f"a{i}", f"a{j}", 1.0) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 1.0) for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]
    for algo in (community.louvain, community.leiden):
        part = algo(a)
        assert len(set(part.values())) == 2 and len({part[f"a{i}"] for i in range(5)}) == 1


def test_fwl_equals_dummies_and_two_way(spark):
    rows = [(float(i % 5) + (i % 3) * 2.0 + (i * 7 % 11) / 10, float(i % 5), f"f{i % 3}", f"g{i % 4}", "one") for i in range(48)]
    df = spark.createDataFrame(rows, "y double, x double, f string, g string, o string")
    full = econ.ols(df, "y", ["x"], ["f"], ["g"])
    res = econ.residualize(df, ["y", "x"], [], ["f"])
    slope = res.agg(F.sum(F.col("x_res") * F.col("y_res")) / F.sum(F.col("x_res") ** 2)).first()[0]
    assert full.row("x")["beta"] == pytest.approx(slope)
    within = econ.within(df, ["y", "x"], ["f"]).agg(F.sum(F.col("x_dm") * F.col("y_dm")) / F.sum(F.col("x_dm") ** 2)).first()[0]
    assert within == pytest.approx(slope)
    iv = econ.iv(df, "y", ["x"], ["x"], [], ["f"], ["g"])
    assert iv.row("x")["beta"] == pytest.approx(slope) and iv.row("x")["se"] == pytest.approx(full.row("x")["se"])


def test_poisson_recovers(spark):
    df = spark.createDataFrame([(float(round(math.exp(0.5 + 0.3 * (i % 7)))), float(i % 7)) for i in range(140)], "y double, x double")
    assert econ.poisson(df, "y", ["x"]).row("x")["beta"] == pytest.approx(0.3, abs=0.05)


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(100)], "id int, s string")
    first = sampling.stratified_sample(df, "s", "id", 30, 1)
    assert first.count() == 30 and first.where("s = 'b'").count() == 10
    other = sampling.disjoint_sample(df, first, ["id"], "s", "id", 20, 2)
    assert other.join(first, "id").count() == 0 and other.count() == 20
    items, key = sampling.per_class_sample(df, "s", "id", 3, 1, ["s"])
    assert items.columns == ["id", "item_id"] and key.count() == 6


def test_text(spark):
    df = spark.createDataFrame([("<i>A</i> &amp; b  c", '[{"date_deb_annee": "x"}, {"date_deb_annee": 1200}]'), (None, '{"date_deb_annee": "1199.0"}')], "t string, d string")
    assert [r[0] for r in df.select(X.unescape(X.strip_tags("t"))).collect()] == ["A & b c", None]
    assert [r[0] for r in df.select(X.first_json_year("d")).collect()] == [1200, 1199]
    assert df.select(X.first_name_token(F.lit("Sir 2nd Hugo of X, Count"), ["sir", "of"])).first()[0] == "hugo"


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken\n[1]\n{"x": 2}\n{"x":\n')
    assert sorted(r["x"] for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "d.json").write_text('{"items": [{"k": "a"}, {"k": "b"}]}')
    assert readers.read_json_items(spark, str(tmp_path / "d.json"), "items", "struct<k:string>").count() == 2
    df = spark.createDataFrame([("a", None), ("b,\"c\"\nd", "e")], "x string, y string")
    sinks.write_csv(df, str(tmp_path / "csv"), quote_all=True)
    back = readers.read_csv_strings(spark, str(tmp_path / "csv"), ["x", "y"])
    assert {tuple(r) for r in back.collect()} == {("a", ""), ("b,\"c\"\nd", "e")}
    kept, dropped = sinks.rejects(df, {"y": F.col("y").isNotNull()}, "x", 3)
    assert kept.count() == 1 and dropped.first()["reason"] == "y"
    assert "\\toprule" in sinks.to_latex(df, "t") and "| x | y |" in sinks.to_markdown(df, "t")
    assert readers.optional_table(spark, str(tmp_path / "none"), "a int").count() == 0
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("p.csv", "a,b\n1,2\n")
    assert tuple(readers.read_zip_csv(spark, str(tmp_path / "z.zip"), ["a", "b", "c"]).first()) == ("1", "2", "")
    old, new = (spark.createDataFrame(x, "file string, modified double") for x in ([("a", 1.0), ("b", 1.0), ("c", 1.0)], [("a", 1.5), ("b", 3.0), ("d", 1.0)]))
    assert {tuple(r) for r in readers.manifest_diff(old, new).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "removed"), ("d", "new")}


def test_runner(spark, tmp_path):
    stages = [Stage("1", "make", lambda t, n=3: {"a": spark.range(n).toDF("id")}, (), ("a",)), Stage("2", "use", lambda t: {"b": t["a"].where("id > 0")}, ("a",), ("b",)), Stage("3", "boom", lambda t: 1 / 0, skip=True)]
    run = Run(spark, stages, str(tmp_path))
    assert [x["status"] for x in run.run(overrides={"1": {"n": 5}})] == ["ok", "ok"]
    assert run.table("b").count() == 4
    with pytest.raises(ZeroDivisionError):
        run.run(only=["3"])
    assert run.run(start="2")[0]["stage"] == "2"
    assert spark.read.text(f"{tmp_path}/run_log").count() == 4
    assert numeric_tokens("a & 1,200 & .5 \\\\\n\\caption{3}") == [["1200", ".5"]]
    assert verify_tables("x & 1\n", "x & 2\n") == [(0, ["1"], ["2"])]


def test_streaming(spark, tmp_path):
    from kinweave.streaming import windows

    src = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:10:00", "a"), (2, "2024-01-03 00:00:00", "b")], "u int, t string, k string").select("u", F.to_timestamp("t").alias("ts"), "k")
    src.write.parquet(str(tmp_path / "in"))
    s = windows.file_stream(spark, str(tmp_path / "in"), src.schema)
    q = windows.tumbling_counts(s, "ts", "k").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}
    assert windows.latest_per_key(src.where("k = 'b'"), src.where("k = 'a'"), "u", "ts").count() == 2


def test_salted_join_splits_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(1000)] + [(k, k) for k in range(2, 12)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (99, "d")], "k int, v string")
    got = relational.salted_join(left, right, ["k"], rows_per_task=100)
    assert sorted(map(tuple, got.select("k", "x", "v").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "v").collect()))
    assert relational.salted_join(left.limit(0), right, ["k"]).count() == 0


def test_spread_left_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", None), (4, "z", 1)], "id int, k string, y int")
    right = spark.createDataFrame([("a", 5, "hit"), (None, 5, "never")], "k string, y int, v string")
    got = {r["id"]: r["v"] for r in relational.spread_left_join(left, right, ["k", "y"], "id").collect()}
    assert got == {1: "hit", 2: None, 3: None, 4: None}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 9), ("b", 3), ("b", None), ("c", None)], "k string, y int")
    assert {r["k"]: r["m"] for r in df.groupBy("k").agg(S.upper_median("y").alias("m")).collect()} == {"a": 4, "b": 3, "c": None}


def test_range_totals_are_those_of_the_join(spark):
    """Counts and least keys without pairs: 2,000,000 points in 40 years, 50,000 intervals; the pairs would be 10^10."""
    points = spark.createDataFrame([(i, 1000 + i % 7) for i in range(30)] + [(99, None)], "i int, y int")
    spans = spark.createDataFrame([(k, 990 + k, 996 + 2 * k) for k in range(12)] + [(50, 995, 1001), (51, 1003, 1001), (52, None, 1001)], "id int, s int, e int")
    pairs = relational.range_join(points, spans, "y", "s", "e", 2)
    for born_before, joined in ((False, pairs), (True, pairs.where("s < y"))):
        want = {(r["i"], r["n"], r["f"]) for r in joined.groupBy("i").agg(F.count("*").alias("n"), F.min("id").alias("f")).collect()}
        got = [(r["i"], r["n"], r["first_id"]) for r in relational.range_totals(points, spans, "y", "s", "e", "id", 2, born_before=born_before).collect()]
        assert set(got) == want and len(got) == len(want)
    many = spark.range(2_000_000).select("id", (1000 + F.col("id") % 40).cast("int").alias("y"))
    lives = spark.range(50_000).select(F.col("id").alias("k"), (990 + F.col("id") % 10).cast("int").alias("s"), F.lit(1050).alias("e"))
    assert relational.range_totals(many, lives, "y", "s", "e", "k", 0).agg(F.sum("n")).first()[0] == 2_000_000 * 50_000
