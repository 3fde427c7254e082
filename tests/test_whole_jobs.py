import pytest

from kinweave.plans import registry


@pytest.fixture(scope="module")
def line(spark, tmp_path_factory):
    """One line of 20 generations, a letter that names the first and each of the others, and the tables to go with it."""
    at = tmp_path_factory.mktemp("line")
    n = 20
    tables = {
        "persons_imputed": ([(f"p{i:02}", "M", 800 + 25 * i, 840 + 25 * i) for i in range(n)], "id string, sex string, birth int, death int"),
        "parent_pairs": ([(f"p{i:02}", f"p{i + 1:02}") for i in range(n - 1)], "parent_id string, child_id string"),
        "spouse_pairs": ([], "a string, b string"),
        "dynasty_labels": ([(f"p{i:02}", f"L{i:02}") for i in range(n)], "id string, dynasty string"),
        "doc_matches_ai_extracted_high": ([(f"m{i}", "d", 1500, f"p{i:02}") for i in range(n)] + [("x0", "e", 1000, "p00"), ("x9", "e", 1000, "p09")], "match_id string, doc_id string, doc_year int, person_id string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_distance_to_15(spark, line):
    got = {(r["a"], r["b"], r["year"]): r["distance"] for r in registry.QUERIES["op_173_gated_distance_15"](spark, line).collect()}
    want = {(f"p{i:02}", f"p{j:02}", 1500): min(j - i, 16) for i in range(20) for j in range(i + 1, 20)}
    # p09 is born after the year of the letter
    assert got == want | {("p00", "p09", 1000): 16}


def test_pedigree_of_7_generations(spark, line):
    got = {r["id"]: (r["slots"], r["ancestors"]) for r in registry.QUERIES["op_186_pedigree_7"](spark, line).collect()}
    assert got == {f"p{i:02}": (min(i, 7), min(i, 7)) for i in range(6, 20)}


def test_bands_to_7(spark, line):
    got = {r["seed"]: r for r in registry.QUERIES["op_170_bands_7"](spark, line).collect()}
    assert [got["p10"][f"n_{a}_{b}"] for a, b in ((7, 7), (1, 2), (3, 7), (2, 7), (4, 7), (3, 4), (3, 5))] == [1, 2, 5, 6, 4, 2, 3]


def test_names_of_whole_jobs():
    assert {"op_162_khop_4", "op_167_reach_increment_4", "op_213_permutation_999"} <= set(registry.QUERIES)


@pytest.mark.parametrize(("name", "n"), [("op_089_interval_join", 100_000), ("op_091_alive_at", None)])
def test_letters_of_one_year(spark, tmp_path, name, n):
    """300,000 letters and 100,000 lives in one year: the pairs would be 3 * 10^10."""
    spark.range(300_000).selectExpr("id * 600 AS o_orderkey", "id AS o_custkey", "'p' AS o_orderpriority", "'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(100_000).selectExpr("id * 600 AS l_orderkey", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    rows = got.groupBy("n").count().collect()
    assert [(r["n"], r["count"]) for r in rows] == ([(n, 300_000)] if n else [])  # nobody is alive before the year of birth
