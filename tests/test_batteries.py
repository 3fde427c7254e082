import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import community, econ, relational
from kinweave.operators.battery import Spec, battery
from kinweave.plans import battery_queries


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 300
    z, w, g = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 6, n)
    x = z + 0.5 * w + rng.normal(size=n)
    y = 2 * x - w + 0.3 * g + rng.normal(size=n)
    return [(float(a), float(b), float(c), float(d), f"g{k}", int(i % 2)) for i, (a, b, c, d, k) in enumerate(zip(y, x, z, w, g, strict=True))]


def plain(rows, instrument, clusters=True):
    y, x, z, w = (np.array([r[i] for r in rows]) for i in range(4))
    g = np.array([r[4] for r in rows])
    c = np.column_stack([np.ones(len(y)), w, *[(g == k).astype(float) for k in sorted(set(g))[1:]]])
    left = lambda v: v - c @ np.linalg.lstsq(c, v, rcond=None)[0]
    y, x, q = left(y), left(x), left(z if instrument else x)
    beta = (q @ y) / (q @ x)
    psi = q * (y - beta * x) / (q @ x)
    k = c.shape[1] + 1
    per = np.array([psi[g == v].sum() for v in sorted(set(g))])
    return beta, np.sqrt((per**2).sum() * len(per) / (len(per) - 1) * (len(y) - 1) / (len(y) - k))


def test_battery_equals_plain_algebra(spark, rows):
    df = spark.createDataFrame([*rows, (1.0, None, 1.0, 1.0, "g1", 0)], "y double, x double, z double, w double, g string, half int")
    specs = [Spec("ols", "y", "x", ("w",), ("g",), "g"), Spec("iv", "y", "x", ("w",), ("g",), "g", "z"), Spec("half", "y", "x", ("w",), ("g",), "g", sample="half = 1"), Spec("none", "y", "x", cluster="g", sample="half = 7"), Spec("same", "y", "x", ("x", "w"), ("g",), "g")]
    got = {r["spec"]: r for r in battery(df, specs).collect()}
    for name, part, instrument in (("ols", rows, False), ("iv", rows, True), ("half", [r for r in rows if r[5] == 1], False)):
        beta, se = plain(part, instrument)
        assert got[name]["beta"] == pytest.approx(beta, rel=1e-8) and got[name]["se"] == pytest.approx(se, rel=1e-8) and got[name]["n"] == len(part)
    assert got["none"]["n"] == 0 and got["none"]["beta"] is None and got["same"]["beta"] is None


def test_wild_bootstrap(spark, rows):
    df = spark.createDataFrame([(a, b, f"c{i % 40}") for i, (a, b, *_) in enumerate(rows)], "y double, x double, c string")
    t = {r["draw"]: r["t"] for r in econ.wild_bootstrap(df, "y", "x", "c", 400, 1).collect()}
    xy = np.array([sum(r["x"] * r["y"] for r in part) for part in _parts(df)])
    xx = np.array([sum(r["x"] ** 2 for r in part) for part in _parts(df)])
    beta = xy.sum() / xx.sum()
    assert t[0] == pytest.approx(beta / (np.sqrt(((xy - beta * xx) ** 2).sum()) / xx.sum()), rel=1e-6)
    rest = np.array([t[d] for d in range(1, 401)])
    assert len(t) == 401 and abs(rest.mean()) < 0.5 and 0.5 < rest.std() < 2


def _parts(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["c"], []).append(r)
    return [by[c] for c in sorted(by)]


def test_levels_find_planted_groups(spark):
    """Rings of cliques: cliques settle first, and the levels go on until nothing merges."""
    edges = [(f"{k}-{i}", f"{k}-{j}", 1.0) for k in range(6) for i in range(5) for j in range(i)] + [(f"{k}-0", f"{(k + 1) % 6}-1", 0.1) for k in range(6)]
    got = {r["id"]: r["label"] for r in community.louvain_distributed(spark.createDataFrame(edges, "a string, b string, w double")).collect()}
    assert all(len({got[f"{k}-{i}"] for i in range(5)}) == 1 for k in range(6)) and len(set(got.values())) >= 3


def test_null_pairs(spark):
    people = spark.createDataFrame([(f"p{i}", 1000, 1100) for i in range(9)] + [("late", 1050, 1200)], "id string, birth int, death int")
    dyads = spark.createDataFrame([("d1", 1040), ("d2", 1150), ("d3", 1060)], "dyad_id string, year int")
    got = relational.null_pairs(dyads, people, 20, 3).collect()
    assert {r["dyad_id"] for r in got} == {"d1", "d3"} and len(got) == 40  # in 1150 one person is alive
    assert all(r["a"] < r["b"] for r in got) and not any("late" in (r["a"], r["b"]) for r in got if r["dyad_id"] == "d1")


def test_hot_bin_of_a_range_join(spark):
    """Half of the points in one year: bins above the row count are split, nothing is lost or doubled."""
    points = spark.range(400).select("id", F.when(F.col("id") < 200, 1000).otherwise(F.col("id") + 800).alias("at"))
    spans = spark.createDataFrame([(f"s{k}", 990 + 10 * k, 1005 + 10 * k) for k in range(30)], "s string, lo int, hi int")
    got = {(r["id"], r["s"]) for r in relational.range_join(points, spans, "at", "lo", "hi", 3).collect()}
    want = {(i, f"s{k}") for i in range(400) for k in range(30) if 990 + 10 * k <= (1000 if i < 200 else i + 800) + 3 and 1005 + 10 * k >= (1000 if i < 200 else i + 800) - 3}
    assert got == want
    small = relational.salted_join(points.withColumnRenamed("at", "lo"), spans, ["lo"], rows_per_task=10)
    assert small.count() == points.withColumnRenamed("at", "lo").join(spans, "lo").count()


def test_factor_of_more_levels_than_a_design_holds(spark):
    """4,000 houses, two persons each, two controls of which one is constant within the houses."""
    rng = np.random.default_rng(8)
    n = 8_000
    g = np.arange(n) // 2
    z, w, c = rng.normal(size=n), rng.normal(size=n), (g % 7).astype(float)
    x = z + w + rng.normal(size=n)
    y = 2 * x - w + (g % 5) + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r[:5]), f"g{r[5]}") for r in zip(y, x, z, w, c, g, strict=True)], "y double, x double, z double, w double, c double, g string")
    got = battery(df, [Spec("iv", "y", "x", ("w", "c"), ("g",), "g", "z")]).first()
    within = lambda v: v - (np.bincount(g, v) / 2)[g]
    y, x, z, w = map(within, (y, x, z, w))
    left = lambda v: v - w * (w @ v) / (w @ w)
    beta = left(z) @ left(y) / (left(z) @ left(x))
    per = np.bincount(g, left(z) * (left(y) - beta * left(x)) / (left(z) @ left(x)))
    se = np.sqrt((per**2).sum() * 4000 / 3999 * (n - 1) / (n - 4002))
    assert got["n"] == n and got["clusters"] == 4000
    assert got["beta"] == pytest.approx(beta, rel=1e-8) and got["se"] == pytest.approx(se, rel=1e-8)


@pytest.fixture(scope="module")
def houses(spark):
    """4,000 houses of two persons: the frame of the queries that absorb them."""
    cols = ["y", "reach", "mother_reach", *battery_queries.BASE]
    x = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).alias(c) for i, c in enumerate(cols)]
    return spark.range(8_000).select("id", F.concat(F.lit("g"), F.floor(F.col("id") / 2)).alias("label"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("early"), *x).localCheckpoint()


def _left(rows, names):
    """Columns without their house's means and the controls."""
    of = lambda c: np.array([float(r[c]) for r in rows])
    g = np.array([int(r["label"][1:]) for r in rows])
    within = lambda v: v - (np.bincount(g, v) / 2)[g]
    c = np.column_stack([within(of(x)) for x in names])
    return of, g, lambda v: (w := within(v)) - c @ np.linalg.lstsq(c, w, rcond=None)[0]


def test_interaction_with_many_houses(spark, houses, monkeypatch):
    monkeypatch.setattr(battery_queries, "frame", lambda *_: houses)
    got = {r["term"]: r["beta"] for r in battery_queries.op_227_interaction(spark, "").collect()}
    of, _, left = _left(houses.collect(), ("early", *battery_queries.BASE))
    x, z = (np.column_stack([left(of(c)), left(of(c) * of("early"))]) for c in ("reach", "mother_reach"))
    want = np.linalg.solve(z.T @ x, z.T @ left(of("y")))
    assert [got["reach"], got["reach_early"]] == pytest.approx(list(want), abs=1e-5)


def test_leverage_with_many_houses(spark, houses, monkeypatch):
    monkeypatch.setattr(battery_queries, "frame", lambda *_: houses)
    got = {r["label"]: r["share"] for r in battery_queries.op_230_leverage(spark, "").collect()}
    of, g, left = _left(houses.collect(), battery_queries.BASE)
    per = np.bincount(g, left(of("mother_reach")) ** 2)
    assert len(got) == 4000 and [got[f"g{k}"] for k in range(4000)] == pytest.approx(list(per / per.sum()), abs=1e-6)


def test_permutations_without_a_row_for_each_draw(spark):
    """The order within a cell is that of the hashes of seed, draw and key; keys may be NULL or empty."""
    rows = [(f"c{i % 3}", None if i == 4 else "" if i == 7 else f"k{i * 7 % 40:02}", float(i), float(i % 5)) for i in range(40)] + [("c0", "x", None, 1.0)]
    df = spark.createDataFrame(rows, "cell string, key string, y double, z double")
    test = econ.permutation_test(df, "cell", "key", "y", "z", 20, 9)
    want = {}
    for d in range(21):
        mark = lambda r, d=d: hashlib.md5("|".join(str(x) for x in (9, d, r[1]) if x is not None).encode()).hexdigest() if d else ""
        of = [sorted((r for r in rows if r[0] == f"c{k}" and r[2] is not None), key=lambda r: (r[1] is not None, r[1] or "")) for k in range(3)]
        want[d] = sum(a[3] * b[2] for c in of for a, b in zip(c, sorted(c, key=mark), strict=True))
    assert {r["draw"]: r["stat"] for r in test.collect()} == pytest.approx(want)
    assert "Window" not in test._jdf.queryExecution().toString()


def test_draws_by_component(spark):
    """Each component is a run of Louvain's with the weight of the whole graph; the order of the rows has no effect."""
    ring = [(f"{g}{i}", f"{g}{(i + 1) % 9}", 1.0 + (i % 3 == 0)) for g in "ab" for i in range(9)]
    got = {d: {} for d in (0, 7)}
    for rows, parts in ((ring, 1), (ring[::-1], 3)):
        for r in community.louvain_draws(spark.createDataFrame(rows, "a string, b string, w double").repartition(parts), [0, 7]).collect():
            assert got[r["draw"]].setdefault(r["id"], r["label"]) == r["label"]
    for d, part in got.items():
        want = [community.louvain(sorted(e for e in ring if e[0][0] == g), f"{d} {g}0", 1.0, 2 * sum(e[2] for e in ring)) for g in "ab"]
        assert part == want[0] | want[1]
    assert community.louvain_draws(spark.createDataFrame([], "a string, b string, w double"), [0]).isEmpty()


def test_seed_sweep_with_many_houses(spark, tmp_path, monkeypatch):
    """60,000 houses that marry in pairs, 8,000 sons of theirs: more than one process or one design was to hold."""
    n, sons = 60_000, 8_000
    p, m = spark.range(n), spark.range(sons)
    man = m.selectExpr("concat('m', id) AS id", "'M' AS sex", "1200 AS birth", "1240 AS death")
    pair = p.selectExpr("concat('p', id) AS id", "'F' AS sex", "CAST(if(id % 2 = 0, 1150, 1140) AS INT) AS birth", "1180 AS death")
    tables = {
        "persons_imputed": man.union(pair), "parent_pairs": m.selectExpr("concat('p', id) AS parent_id", "concat('m', id) AS child_id"),
        "spouse_pairs": p.where("id % 2 = 0").selectExpr("concat('p', id) AS a", "concat('p', id + 1) AS b"),
        "dynasty_labels": p.selectExpr("concat('p', id) AS id", "concat('H', id) AS dynasty").union(m.selectExpr("concat('m', id)", f"concat('H', {sons} + id)")),
        "doc_matches_ai_extracted_high": spark.createDataFrame([("x", "d", 1230, "m1")], "match_id string, doc_id string, doc_year int, person_id string"),
        "matched_docs_coded": spark.createDataFrame([("d", "other")], "doc_id string, domain string"),
    }
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    frames = []
    monkeypatch.setattr(battery_queries, "battery", lambda d, specs: frames.append(d) or battery(d, specs))
    got = battery_queries.op_231_seed_sweep(spark, str(tmp_path), 2).collect()
    assert {(r["spec"], r["n"], r["n_labels"]) for r in got} == {("seed 0", sons, n // 2), ("seed 1", sons, n // 2)}
    # a son's mother and her spouse are of one community, he of another
    rows = frames[0].groupBy("draw", "reach", "mother_reach", "father_reach", "mother_size").agg(F.count("*").alias("k"), F.count_distinct("label").alias("labels")).collect()
    assert {(r["draw"], r["reach"], r["mother_reach"], r["father_reach"], r["k"], r["labels"]) for r in rows if r["mother_size"] > 0} == {(d, 2.0, 1.0, 0.0, sons // 2, sons // 2) for d in (0, 1)}
    assert sum(r["k"] for r in rows) == 2 * sons
