"""Queries of the graph, kin and regression operators over the persons and letters of the project, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import community, econ, graph, panel, relational
from kinweave.operators.components import connected_components
from kinweave.plans.relational_queries import r6
from kinweave.runtime import checkpoint, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Kin:
    """Persons, links and labels of a data folder in clean form."""

    def __init__(self, spark: SparkSession, sf: str):
        year = lambda c: F.min(F.when(F.col(c).between(700, 1600), F.col(c))).alias(c)
        t = lambda n: table(spark, sf, n)
        self.persons = t("persons_imputed").groupBy("id").agg(F.min("sex").alias("sex"), year("birth"), year("death"))
        self.parents = t("parent_pairs").where("parent_id <> '' AND child_id <> '' AND parent_id <> child_id").select("parent_id", "child_id").distinct()
        self.spouses = t("spouse_pairs").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        self.labels = t("dynasty_labels").where("dynasty <> ''").groupBy("id").agg(F.min("dynasty").alias("label"))
        self.births = self.persons.select("id", "birth")
        sexed = self.parents.join(self.persons.select(F.col("id").alias("parent_id"), "sex"), "parent_id")
        self.order = sexed.groupBy("child_id").agg(F.min(F.when(F.col("sex") == "M", F.col("parent_id"))).alias("father_id"), F.min(F.when(F.col("sex") == "F", F.col("parent_id"))).alias("mother_id"))
        self.kin = relational.ancestors(self.order)
        self.adj = graph.build_graph(self.parents, self.spouses, self.persons)


KIN = """
WITH RECURSIVE P AS (SELECT id, min(sex) AS sex, min(CASE WHEN birth BETWEEN 700 AND 1600 THEN birth END) AS birth, min(CASE WHEN death BETWEEN 700 AND 1600 THEN death END) AS death FROM persons_imputed GROUP BY id),
PP AS (SELECT DISTINCT parent_id, child_id FROM parent_pairs WHERE parent_id <> '' AND child_id <> '' AND parent_id <> child_id),
SP AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM spouse_pairs WHERE a <> b),
L AS (SELECT id, min(dynasty) AS label FROM dynasty_labels WHERE dynasty <> '' GROUP BY id),
E AS (SELECT parent_id AS s, child_id AS t FROM PP UNION SELECT a, b FROM SP),
ADJ AS (SELECT s, t FROM (SELECT s, t FROM E UNION SELECT t, s FROM E) WHERE s IN (SELECT id FROM P) AND t IN (SELECT id FROM P)),
FM AS (SELECT child_id, min(CASE WHEN sex = 'M' THEN parent_id END) AS father_id, min(CASE WHEN sex = 'F' THEN parent_id END) AS mother_id FROM PP JOIN P ON id = parent_id GROUP BY child_id),
KIN AS (SELECT a.child_id, a.father_id, a.mother_id, b.father_id AS mgf_id FROM FM a LEFT JOIN FM b ON b.child_id = a.mother_id)"""

BALL = """,
BALL AS (SELECT id AS seed, birth AS cut, id AS node, 0 AS d FROM P WHERE birth IS NOT NULL UNION
 SELECT seed, cut, p.id, BALL.d + 1 FROM BALL JOIN ADJ ON s = node JOIN P p ON p.id = t WHERE BALL.d < 4 AND p.birth < cut),
B AS (SELECT seed, any_value(cut) AS cut, node, min(d) AS d FROM BALL GROUP BY seed, node)"""


def ball(k: Kin, hops: int) -> DataFrame:
    seeds = graph.plain_seeds(k.persons.where("birth IS NOT NULL"), "id", F.col("birth"))
    return checkpoint(graph.gated_ball(seeds, k.adj, k.births, hops))


def ball4(k: Kin) -> DataFrame:
    return ball(k, 4)


@query(KIN + " SELECT s AS id, count(*) AS degree FROM ADJ GROUP BY s")
def op_160_degree(spark, sf):
    return graph.degrees(Kin(spark, sf).adj)


@query(KIN + """, LIVE AS (SELECT id FROM P WHERE birth <= 1300 AND death >= 1100), KEEP AS (SELECT id FROM LIVE UNION SELECT t FROM ADJ WHERE s IN (SELECT id FROM LIVE))
SELECT s, t FROM ADJ WHERE s IN (SELECT id FROM KEEP) AND t IN (SELECT id FROM KEEP)""")
def op_161_active_subgraph(spark, sf):
    k = Kin(spark, sf)
    return graph.active_subgraph(k.adj, k.persons, 1100, 1300)


@query(KIN + """, BALL AS (SELECT id AS seed, id AS node, 0 AS d FROM P UNION SELECT seed, t, d + 1 FROM BALL JOIN ADJ ON s = node WHERE d < 3), B AS (SELECT seed, node, min(d) AS d FROM BALL GROUP BY 1, 2)
SELECT seed, 'ego' AS role, count(DISTINCT CASE WHEN d <= 2 THEN label END) AS reach_2, count(*) FILTER (d BETWEEN 1 AND 2) AS nodes_2, count(DISTINCT label) AS reach_3, count(*) FILTER (d > 0) AS nodes_3 FROM B LEFT JOIN L ON id = node GROUP BY seed""")
def op_162_khop(spark, sf):
    k = Kin(spark, sf)
    return graph.reach(graph.gated_ball(graph.plain_seeds(k.persons), k.adj, None, 3), k.labels, [2, 3])


@query()
def op_162_khop_4(spark, sf):
    k = Kin(spark, sf)
    return graph.reach(graph.gated_ball(graph.plain_seeds(k.persons), k.adj, None, 4), k.labels, [3, 4])


@query(KIN + BALL + """ SELECT seed, 'ego' AS role, count(DISTINCT CASE WHEN d <= 3 THEN label END) AS reach_3, count(*) FILTER (d BETWEEN 1 AND 3) AS nodes_3, count(DISTINCT label) AS reach_4, count(*) FILTER (d > 0) AS nodes_4 FROM B LEFT JOIN L ON id = node GROUP BY seed""")
def op_163_gated_reach(spark, sf):
    k = Kin(spark, sf)
    return graph.reach(ball4(k), k.labels, [3, 4])


ROLES = KIN + """, SEEDS AS (SELECT id AS seed, 'ego' AS role, id AS node, death + 1 AS cut FROM P WHERE death IS NOT NULL
 UNION ALL SELECT child_id, 'mother', mother_id, birth FROM KIN JOIN P ON id = child_id WHERE mother_id IS NOT NULL AND birth IS NOT NULL
 UNION ALL SELECT child_id, 'father', father_id, birth FROM KIN JOIN P ON id = child_id WHERE father_id IS NOT NULL AND birth IS NOT NULL
 UNION ALL SELECT child_id, 'mgf', mgf_id, birth FROM KIN JOIN P ON id = child_id WHERE mgf_id IS NOT NULL AND birth IS NOT NULL),
BALL AS (SELECT seed, role, cut, node, 0 AS d FROM SEEDS UNION SELECT seed, role, cut, p.id, BALL.d + 1 FROM BALL JOIN ADJ ON s = node JOIN P p ON p.id = t WHERE BALL.d < {hops} AND p.birth < cut),
B AS (SELECT seed, role, node, min(d) AS d FROM BALL GROUP BY 1, 2, 3)
"""


@query(ROLES.replace("{hops}", "3") + """SELECT seed, role, count(DISTINCT CASE WHEN d <= 2 THEN label END) AS reach_2, count(*) FILTER (d BETWEEN 1 AND 2) AS nodes_2, count(DISTINCT label) AS reach_3, count(*) FILTER (d > 0) AS nodes_3 FROM B LEFT JOIN L ON id = node GROUP BY 1, 2""")
def op_165_role_reach(spark, sf):
    k = Kin(spark, sf)
    return graph.reach(graph.gated_ball(graph.role_seeds(k.persons, k.kin), k.adj, k.births, 3), k.labels, [2, 3])


@query(KIN + """, SEEDS AS (SELECT child_id AS seed, 'mother' AS role, mother_id AS node, birth AS cut FROM KIN JOIN P ON id = child_id WHERE mother_id IS NOT NULL AND birth IS NOT NULL
 UNION ALL SELECT child_id, 'father', father_id, birth FROM KIN JOIN P ON id = child_id WHERE father_id IS NOT NULL AND birth IS NOT NULL),
BALL AS (SELECT seed, role, cut, node, 0 AS d FROM SEEDS UNION SELECT seed, role, cut, p.id, BALL.d + 1 FROM BALL JOIN ADJ ON s = node JOIN P p ON p.id = t WHERE BALL.d < 3 AND p.birth < cut),
S AS (SELECT seed, label, bool_or(role = 'father') AS f, bool_or(role = 'mother') AS m FROM BALL JOIN L ON id = node GROUP BY 1, 2)
SELECT seed, CAST(count(*) FILTER (f AND NOT m) AS INTEGER) AS only_a, CAST(count(*) FILTER (m AND NOT f) AS INTEGER) AS only_b, CAST(count(*) FILTER (f AND m) AS INTEGER) AS both, CAST(count(*) AS INTEGER) AS either FROM S GROUP BY 1""")
def op_167_reach_increment(spark, sf):
    k = Kin(spark, sf)
    seeds = graph.role_seeds(k.persons, k.kin).where("role IN ('mother', 'father')")
    return graph.reach_increment(graph.gated_ball(seeds, k.adj, k.births, 3), k.labels, 3)


@query()
def op_167_reach_increment_4(spark, sf):
    k = Kin(spark, sf)
    ball = checkpoint(graph.gated_ball(graph.role_seeds(k.persons, k.kin).where("role IN ('mother', 'father')"), k.adj, k.births, 4))
    at = [graph.reach_increment(ball, k.labels, h).withColumn("hops", F.lit(h)) for h in (3, 4)]
    return at[0].unionByName(at[1])


@query(KIN + """, D AS (SELECT s, count(*) AS deg FROM ADJ GROUP BY 1), H AS (SELECT s, sum(n * n) / (sum(n) * sum(n))::DOUBLE AS hhi FROM (SELECT s, label, count(*) AS n FROM ADJ JOIN L ON id = t GROUP BY 1, 2) GROUP BY 1),
T AS (SELECT x.s, count(*) AS tri FROM ADJ x JOIN ADJ y ON x.s = y.s AND x.t < y.t JOIN ADJ z ON z.s = x.t AND z.t = y.t GROUP BY 1)
SELECT D.s AS id, deg, round(hhi, 6) AS hhi, CASE WHEN deg >= 2 THEN round(coalesce(tri, 0) * 2.0 / (deg * (deg - 1)), 6) END AS clustering FROM D LEFT JOIN H ON H.s = D.s LEFT JOIN T ON T.s = D.s""")
def op_166_cohesion(spark, sf):
    k = Kin(spark, sf)
    return r6(graph.cohesion(k.adj, k.labels))


FEATURES_SQL = ", M AS (SELECT person_id AS id, min(doc_year) AS event_year FROM doc_matches_ai_extracted_high WHERE person_id IS NOT NULL GROUP BY 1), BR AS (SELECT s AS id, count(DISTINCT label) AS breadth FROM ADJ JOIN L ON id = t GROUP BY 1), FT AS (SELECT P.id, event_year, breadth FROM P LEFT JOIN M USING (id) LEFT JOIN BR USING (id))"


def features(spark, sf, k: Kin) -> DataFrame:
    m = graph.event_years(table(spark, sf, "doc_matches_ai_extracted_high"), "person_id", "doc_year", {}, 1100, 1300).select("id", F.col("first_year").alias("event_year"))
    return k.persons.select("id").join(m, "id", "left").join(graph.breadth(k.adj, k.labels), "id", "left")


@query(KIN + BALL + FEATURES_SQL + """ SELECT seed, 'ego' AS role, count(*) AS n_peers, round(avg(CASE WHEN event_year < cut THEN 1.0 ELSE 0.0 END), 6) AS share_event_year, round(avg(breadth), 6) AS mean_breadth FROM B LEFT JOIN FT ON id = node WHERE d > 0 GROUP BY seed""")
def op_169_peer_stats(spark, sf):
    k = Kin(spark, sf)
    return r6(graph.peer_stats(ball4(k), features(spark, sf, k), ["event_year"], ["breadth"]))


@query(KIN + BALL + FEATURES_SQL + """ SELECT seed, 'ego' AS role, count(*) FILTER (d BETWEEN 1 AND 2) AS n_1_2, round(avg(breadth) FILTER (d BETWEEN 1 AND 2), 6) AS mean_1_2, count(*) FILTER (d BETWEEN 1 AND 2 AND breadth > 0) AS with_1_2, least(count(*) FILTER (d BETWEEN 1 AND 2 AND breadth > 0), 10) AS capped_1_2,
 count(*) FILTER (d BETWEEN 3 AND 4) AS n_3_4, round(avg(breadth) FILTER (d BETWEEN 3 AND 4), 6) AS mean_3_4, count(*) FILTER (d BETWEEN 3 AND 4 AND breadth > 0) AS with_3_4, least(count(*) FILTER (d BETWEEN 3 AND 4 AND breadth > 0), 10) AS capped_3_4 FROM B LEFT JOIN FT ON id = node WHERE d > 0 GROUP BY seed""")
def op_170_bands(spark, sf):
    k = Kin(spark, sf)
    return r6(graph.band_exposures(ball4(k), features(spark, sf, k), "breadth", [(1, 2), (3, 4)]))


@query()
def op_170_bands_7(spark, sf):
    k = Kin(spark, sf)
    rings = [(d, d) for d in range(1, 8)]
    return r6(graph.band_exposures(ball(k, 7), features(spark, sf, k), "breadth", [*rings, (1, 2), (3, 7), (2, 7), (4, 7), (3, 4), (3, 5)]))


def _disputes(spark: SparkSession, sf: str, cap: int) -> DataFrame:
    k = Kin(spark, sf)
    m = table(spark, sf, "doc_matches_ai_extracted_high").where("person_id IS NOT NULL").select("doc_id", "person_id", "doc_year").distinct()
    two = m.where("doc_year IS NOT NULL").withColumnRenamed("person_id", "a").join(m.select("doc_id", F.col("person_id").alias("b")).distinct(), "doc_id").where("a < b")
    return graph.gated_distance(two.select("a", "b", F.col("doc_year").alias("year")), k.adj, k.births, cap=cap)


@query(KIN + """, PR AS (SELECT DISTINCT x.person_id AS a, y.person_id AS b, x.doc_year AS year FROM doc_matches_ai_extracted_high x JOIN doc_matches_ai_extracted_high y ON x.doc_id = y.doc_id AND x.person_id < y.person_id WHERE x.doc_year IS NOT NULL),
W AS (SELECT a, b, year, a AS node, 0 AS d FROM PR UNION SELECT a, b, year, p.id, d + 1 FROM W JOIN ADJ ON s = node JOIN P p ON p.id = t WHERE d < 5 AND p.birth < year)
SELECT PR.a, PR.b, PR.year, coalesce(min(d) FILTER (node = W.b), 6) AS distance FROM PR LEFT JOIN W ON W.a = PR.a AND W.b = PR.b AND W.year = PR.year GROUP BY 1, 2, 3""")
def op_173_gated_distance(spark, sf):
    return _disputes(spark, sf, 5)


@query()
def op_173_gated_distance_15(spark, sf):
    return _disputes(spark, sf, 15)


@query(KIN + """, A AS (SELECT id, min(dynasty) AS label FROM dynasty_anchors GROUP BY id), K AS (SELECT label, count(*) AS k FROM A GROUP BY 1),
W AS (SELECT id, label, id AS anchor, 0 AS d FROM A UNION SELECT t, label, anchor, d + 1 FROM W JOIN ADJ ON s = W.id WHERE d < 6),
R AS (SELECT W.id, W.label, d, row_number() OVER (PARTITION BY W.id ORDER BY d, k DESC, W.label, anchor) AS rn FROM W JOIN K USING (label))
SELECT id, label, d AS depth FROM R WHERE rn = 1""")
def op_174_propagate(spark, sf):
    k = Kin(spark, sf)
    anchors = table(spark, sf, "dynasty_anchors").groupBy("id").agg(F.min("dynasty").alias("label"))
    return graph.propagate_labels(k.adj, anchors, 6)


@query(KIN + ", X0 AS MATERIALIZED (SELECT id, label, 0 AS pass FROM L)" + "".join(f", X{i} AS MATERIALIZED (SELECT * FROM X{i - 1} UNION ALL SELECT child_id, min(coalesce(f.label, m.label)), {i} FROM KIN LEFT JOIN X{i - 1} f ON f.id = father_id LEFT JOIN X{i - 1} m ON m.id = mother_id WHERE coalesce(f.label, m.label) IS NOT NULL AND child_id NOT IN (SELECT id FROM X{i - 1}) GROUP BY child_id)" for i in range(1, 31)) + " SELECT * FROM X30")
def op_175_bilineal(spark, sf):
    k = Kin(spark, sf)
    return graph.bilineal_extension(k.labels, k.kin)


@query(KIN + """, U AS (SELECT father_id AS s, child_id AS t FROM FM WHERE father_id IS NOT NULL), V AS (SELECT s, t FROM U UNION SELECT t, s FROM U),
R AS (SELECT s AS id, s AS x FROM V UNION SELECT R.id, t FROM R JOIN V ON s = R.x), C AS (SELECT id, min(x) AS c FROM R GROUP BY id)
SELECT id, 'PL' || (dense_rank() OVER (ORDER BY c) - 1) AS label FROM C""")
def op_177_patrilines(spark, sf):
    k = Kin(spark, sf)
    return graph.patrilines(k.kin.where("father_id IS NOT NULL").select("father_id", "child_id"))


@query(KIN + """ SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, count(*) AS w FROM SP JOIN L x ON x.id = SP.a JOIN L y ON y.id = SP.b WHERE x.label <> y.label GROUP BY 1, 2""")
def op_178_quotient(spark, sf):
    k = Kin(spark, sf)
    return graph.quotient_graph(k.spouses, k.labels)


@query(KIN + """, J AS (SELECT x.label AS la, y.label AS lb FROM ADJ JOIN L x ON x.id = s JOIN L y ON y.id = t WHERE s < t), T AS (SELECT count(*) AS t, count(*) FILTER (la = lb) AS i FROM J), D AS (SELECT l, count(*) AS d FROM (SELECT la AS l FROM J UNION ALL SELECT lb FROM J) GROUP BY 1)
SELECT round(any_value(i) / any_value(t)::DOUBLE - sum(d * d) / (4.0 * any_value(t) * any_value(t)), 6) AS modularity, count(*) AS n_communities FROM D, T""")
def op_182_modularity(spark, sf):
    k = Kin(spark, sf)
    e = k.adj.where("s < t").select(F.col("s").alias("a"), F.col("t").alias("b"), F.lit(1).alias("w"))
    return r6(graph.modularity(e, k.labels))


@query(KIN + """, K AS (SELECT id FROM P WHERE birth >= 1000 AND birth < 1200), G AS (SELECT s AS a, t AS b FROM ADJ WHERE s < t AND s IN (SELECT id FROM K) AND t IN (SELECT id FROM K))
SELECT count(*) AS edges, count(*) FILTER (x.label <> y.label) AS spanning, round(count(*) FILTER (x.label <> y.label) / count(*)::DOUBLE, 6) AS share FROM G JOIN L x ON x.id = a JOIN L y ON y.id = b""")
def op_184_spanning(spark, sf):
    k = Kin(spark, sf)
    return r6(graph.spanning_edges(graph.induced_window(k.adj, k.births, 1000, 1200), k.labels))


@query(KIN + """, W AS (SELECT id FROM P WHERE birth >= 1000 AND birth < 1200), E2 AS (SELECT DISTINCT s AS a, t AS b FROM ADJ WHERE s < t AND s IN (SELECT id FROM W) AND t IN (SELECT id FROM W)),
V AS (SELECT a AS s, b AS t FROM E2 UNION SELECT b, a FROM E2), R AS (SELECT s AS id, s AS x FROM V UNION SELECT R.id, V.t FROM R JOIN V ON V.s = R.x), C AS (SELECT id, min(x) AS c FROM R GROUP BY 1),
K AS (SELECT c FROM C GROUP BY c HAVING count(*) >= ceil(0.01 * (SELECT count(*) FROM C))) SELECT a, b FROM E2 JOIN C ON id = a WHERE c IN (SELECT c FROM K)""")
def op_183_big_components(spark, sf):
    k = Kin(spark, sf)
    return graph.induced_window(k.adj, k.births, 1000, 1200, 0.01)


@query(KIN + """, W AS (SELECT child_id AS id, parent_id AS node, 1 AS d FROM PP UNION ALL SELECT W.id, parent_id, d + 1 FROM W JOIN PP ON child_id = node WHERE d < 5),
S AS (SELECT id, node, min(d) AS f, count(*) AS m, sum(pow(2.0, -d)) AS w FROM W GROUP BY 1, 2)
SELECT id, CAST(sum(m) AS BIGINT) AS slots, count(*) AS ancestors, round(sum(pow(2.0, -f)) / sum(w), 6) AS "index" FROM S WHERE id IN (SELECT id FROM P) GROUP BY 1 HAVING sum(m) >= 6""")
def op_186_pedigree(spark, sf):
    k = Kin(spark, sf)
    return r6(graph.pedigree_uniqueness(k.parents, k.persons, depth=5))


@query()
def op_186_pedigree_7(spark, sf):
    k = Kin(spark, sf)
    return r6(graph.pedigree_uniqueness(k.parents, k.persons, depth=7))


@query(KIN + """, V AS (SELECT person_id AS id, count(DISTINCT match_id) AS value FROM doc_matches_ai_extracted_high WHERE person_id IS NOT NULL GROUP BY 1),
W AS (SELECT child_id AS id, father_id AS node, 1 AS g FROM FM WHERE father_id IS NOT NULL UNION ALL SELECT W.id, father_id, g + 1 FROM W JOIN FM ON child_id = node WHERE father_id IS NOT NULL AND g < 6),
A AS (SELECT W.id, max(g) AS length, sum(value) AS total, sum(value) FILTER (g > 1) AS above FROM W LEFT JOIN V ON V.id = node GROUP BY 1)
SELECT P.id, coalesce(length, 0) AS length, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(above, 0) AS BIGINT) AS total_above FROM P LEFT JOIN A USING (id)""")
def op_187_male_line(spark, sf):
    k = Kin(spark, sf)
    v = table(spark, sf, "doc_matches_ai_extracted_high").where("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("match_id").alias("value"))
    return graph.male_line(k.kin.select("child_id", "father_id"), k.persons, v)


@query(KIN + """, H AS (SELECT parent_id, child_id FROM PP JOIN P ON id = parent_id WHERE sex = 'M'), W AS (SELECT id AS root, id AS node FROM P WHERE sex = 'M' UNION SELECT root, child_id FROM W JOIN H ON parent_id = node),
A AS (SELECT root, count(*) AS males, count(*) FILTER (p.death >= r.death AND p.birth < r.death) AS alive, count(*) FILTER (p.death IS NULL) AS unknown FROM W JOIN P p ON p.id = node JOIN P r ON r.id = root WHERE node <> root AND p.sex = 'M' AND r.death IS NOT NULL GROUP BY root)
SELECT id, coalesce(males, 0) AS males, coalesce(alive, 0) AS alive, coalesce(unknown, 0) AS unknown, CASE WHEN coalesce(males, 0) = 0 THEN 'empty' WHEN alive > 0 THEN 'open' WHEN unknown > 0 THEN 'unknown' ELSE 'extinct' END AS status FROM P LEFT JOIN A ON root = id WHERE sex = 'M' AND death IS NOT NULL""")
def op_189_line_status(spark, sf):
    k = Kin(spark, sf)
    kids = k.parents.join(k.persons.select(F.col("id").alias("parent_id"), F.col("sex").alias("parent_sex")), "parent_id")
    roots = k.persons.where("sex = 'M' AND death IS NOT NULL")
    return graph.line_status(graph.male_line_descendants(roots, kids, max_depth=200), k.persons, roots.select("id", F.col("death").alias("t")))


@query(KIN + """, BS AS (SELECT KIN.child_id AS id, mother_id, mgf_id, birth AS B FROM KIN JOIN P ON id = child_id WHERE mgf_id IS NOT NULL),
N AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM SP UNION ALL SELECT b FROM SP) GROUP BY 1), KD AS (SELECT father_id, child_id, sex FROM FM JOIN P ON id = child_id WHERE father_id IS NOT NULL),
SM AS (SELECT DISTINCT mother_id AS m FROM FM JOIN P ON id = child_id WHERE sex = 'M' AND mother_id IS NOT NULL),
F AS (SELECT id, CASE WHEN coalesce((SELECT n FROM N WHERE x = mgf_id), 0) >= 2 THEN 1 ELSE 0 END AS h1,
 CASE WHEN NOT EXISTS (SELECT 1 FROM KD WHERE KD.father_id = mgf_id AND sex = 'M') AND EXISTS (SELECT 1 FROM KD WHERE KD.father_id = mgf_id AND sex = 'F' AND child_id <> mother_id AND child_id IN (SELECT m FROM SM)) THEN 1 ELSE 0 END AS h2,
 CASE WHEN EXISTS (SELECT 1 FROM FM g JOIN KD k ON k.father_id = g.father_id JOIN P p ON p.id = k.child_id WHERE g.child_id = mgf_id AND k.sex = 'M' AND k.child_id <> mgf_id AND p.birth < BS.B AND p.death >= BS.B) THEN 1 ELSE 0 END AS h3 FROM BS)
SELECT id, h1, h2, h3, greatest(h1, h2, h3) AS "any" FROM F""")
def op_190_conflict_flags(spark, sf):
    k = Kin(spark, sf)
    return graph.conflict_flags(k.kin, k.persons, k.spouses, k.persons)


def _impute_sql(start: str, rounds: int = 14) -> str:
    """The rounds of imputation written out one after the other; rounds in which nothing happens change nothing."""
    gap = "CASE p.sex WHEN 'M' THEN 30.0 WHEN 'F' THEN 25.0 ELSE 27.5 END"
    out = f""", LK AS MATERIALIZED (SELECT parent_id, child_id FROM PP JOIN P ON P.id = parent_id),
W AS MATERIALIZED (SELECT a, b FROM SP UNION SELECT b, a FROM SP),
SIB AS MATERIALIZED (SELECT DISTINCT x.child_id AS a, y.child_id AS b FROM PP x JOIN PP y USING (parent_id) WHERE x.child_id <> y.child_id),
S0 AS MATERIALIZED ({start})"""
    for i in range(rounds):
        out += f""", B{i} AS MATERIALIZED (SELECT id, CAST(round_even(median(e), 0) AS INTEGER) AS e FROM (
 SELECT child_id AS id, CAST(trunc(coalesce(p.b, p.d - 60) + {gap}) AS INTEGER) AS e FROM LK JOIN S{i} p ON p.id = parent_id
 UNION ALL SELECT parent_id, CAST(trunc(coalesce(c.b, c.d - 60) - {gap}) AS INTEGER) FROM LK JOIN S{i} p ON p.id = parent_id JOIN S{i} c ON c.id = child_id
 UNION ALL SELECT x.id, y.b + CASE WHEN x.sex = 'M' AND y.sex = 'F' THEN -3 WHEN x.sex = 'F' AND y.sex = 'M' THEN 3 ELSE 0 END FROM W JOIN S{i} x ON x.id = W.a JOIN S{i} y ON y.id = W.b
 UNION ALL SELECT id, d - 60 FROM S{i}
 UNION ALL SELECT SIB.a, CAST(round_even(median(y.b), 0) AS INTEGER) FROM SIB JOIN S{i} y ON y.id = SIB.b GROUP BY 1) GROUP BY id),
H{i} AS MATERIALIZED (SELECT s.id, sex, coalesce(b, e) AS b, d FROM S{i} s LEFT JOIN B{i} USING (id)),
D{i} AS MATERIALIZED (SELECT id, CAST(round_even(median(e), 0) AS INTEGER) AS e FROM (SELECT id, b + 60 AS e FROM H{i}
 UNION ALL SELECT child_id, p.d + 25 FROM LK JOIN S{i} p ON p.id = parent_id
 UNION ALL SELECT parent_id, c.b + 30 FROM LK JOIN S{i} c ON c.id = child_id
 UNION ALL SELECT x.id, y.d FROM W JOIN S{i} x ON x.id = W.a JOIN S{i} y ON y.id = W.b
 UNION ALL SELECT SIB.a, CAST(round_even(median(y.d), 0) AS INTEGER) FROM SIB JOIN S{i} y ON y.id = SIB.b GROUP BY 1) GROUP BY id),
S{i + 1} AS MATERIALIZED (SELECT h.id, sex, b, coalesce(d, e) AS d FROM H{i} h LEFT JOIN D{i} USING (id))"""
    return out + f", ST AS (SELECT id, b, d FROM S{rounds})"


HIDDEN = "md5(id) < '2' AND birth IS NOT NULL AND death IS NOT NULL"


@query(KIN + _impute_sql("SELECT id, sex, birth AS b, death AS d FROM P") + """
SELECT id, b AS birth, d AS death, CASE WHEN b IS NOT NULL THEN CAST(birth IS NULL AS INTEGER) END AS birth_imputed, CASE WHEN d IS NOT NULL THEN CAST(death IS NULL AS INTEGER) END AS death_imputed FROM ST JOIN P USING (id)""")
def op_191_impute_years(spark, sf):
    k = Kin(spark, sf)
    return graph.impute_years(k.persons, k.parents, k.spouses).drop("round")


@query(KIN + _impute_sql(f"SELECT id, sex, CASE WHEN NOT ({HIDDEN}) THEN birth END AS b, CASE WHEN NOT ({HIDDEN}) THEN death END AS d FROM P").replace("CASE WHEN NOT (", "CASE WHEN NOT coalesce(").replace("death IS NOT NULL) THEN", "death IS NOT NULL, false) THEN") + f"""
, V AS (SELECT 'birth' AS field, b - birth AS e FROM P JOIN ST USING (id) WHERE {HIDDEN} UNION ALL SELECT 'death', d - death FROM P JOIN ST USING (id) WHERE {HIDDEN})
SELECT field, count(*) AS n, count(e) AS covered, round(avg(e), 6) AS bias, median(e) AS median_error, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse,
 round(avg(CAST(abs(e) <= 1 AS INTEGER)), 6) AS within_1, round(avg(CAST(abs(e) <= 5 AS INTEGER)), 6) AS within_5, round(avg(CAST(abs(e) <= 10 AS INTEGER)), 6) AS within_10, round(avg(CAST(abs(e) <= 20 AS INTEGER)), 6) AS within_20 FROM V GROUP BY 1""")
def op_192_impute_validation(spark, sf):
    """Both years of a hash sample of fully dated persons are hidden, imputed again and scored (OP-192)."""
    k = Kin(spark, sf)
    hidden = k.persons.where(HIDDEN).select("id", F.col("birth").alias("true_birth"), F.col("death").alias("true_death"))
    masked = k.persons.join(hidden.select("id", F.lit(True).alias("hide")), "id", "left")
    masked = masked.select("id", "sex", *[F.when(F.col("hide").isNull(), F.col(c)).alias(c) for c in ("birth", "death")])
    est = graph.impute_years(masked, k.parents, k.spouses).join(hidden, "id")
    rows = [est.select(F.lit(f).alias("field"), F.col("true_" + f).alias("truth"), F.col(f).alias("est")) for f in ("birth", "death")]
    return r6(panel.error_metrics(rows[0].union(rows[1]), "truth", "est", ["field"]))


@query(KIN + """ SELECT id, count(DISTINCT y.child_id) AS n_siblings FROM PP x JOIN PP y ON x.parent_id = y.parent_id AND x.child_id <> y.child_id JOIN P ON id = x.child_id GROUP BY 1""")
def op_193_sibling_counts(spark, sf):
    k = Kin(spark, sf)
    return graph.sibling_counts(k.parents).join(k.persons.select("id"), "id", "left_semi")


@query(KIN + """ SELECT s AS id, count(DISTINCT label) AS breadth FROM ADJ JOIN L ON id = t GROUP BY 1""")
def op_195_breadth(spark, sf):
    k = Kin(spark, sf)
    return graph.breadth(k.adj, k.labels)


@query("""SELECT person_id AS id, min(doc_year) AS first_year, min(doc_year) FILTER (doc_is_mandement = 1) AS first_mandement, CASE WHEN coalesce(bool_or(doc_year BETWEEN 1100 AND 1300), false) THEN 1 ELSE 0 END AS in_window FROM doc_matches_ai_extracted_high WHERE person_id IS NOT NULL GROUP BY 1""")
def op_196_event_years(spark, sf):
    return graph.event_years(table(spark, sf, "doc_matches_ai_extracted_high"), "person_id", "doc_year", {"mandement": F.col("doc_is_mandement") == 1}, 1100, 1300)


@query(KIN + """, M AS (SELECT label, P.id, row_number() OVER (PARTITION BY label ORDER BY n DESC, P.id) AS rn, count(*) OVER (PARTITION BY label) AS size FROM L JOIN P USING (id) LEFT JOIN (SELECT person_id, count(DISTINCT match_id) AS n0 FROM doc_matches_ai_extracted_high GROUP BY 1) q ON person_id = P.id, LATERAL (SELECT coalesce(n0, 0) AS n))
SELECT label, size, id, CAST(rn AS INTEGER) AS rank FROM M WHERE rn <= 2""")
def op_198_roster(spark, sf):
    k = Kin(spark, sf)
    n = table(spark, sf, "doc_matches_ai_extracted_high").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("match_id").alias("n"))
    d = k.labels.join(k.persons.select("id"), "id").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = d.groupBy("label").agg(F.count("*").alias("size"))
    return relational.top_k(d, ["label"], [F.col("n").desc(), F.col("id")], 2).join(size, "label").select("label", "size", "id", "rank")


@query()
def op_179_louvain(spark, sf):
    k = Kin(spark, sf)
    return community.communities(graph.quotient_graph(k.spouses, k.labels), "louvain")


@query()
def op_180_leiden(spark, sf):
    k = Kin(spark, sf)
    return community.communities(graph.quotient_graph(k.spouses, k.labels), "leiden")


@query()
def op_179_louvain_distributed(spark, sf):
    k = Kin(spark, sf)
    e = k.adj.where("s < t").select(F.col("s").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("w"))
    return community.louvain_distributed(e)


@query(KIN + """, R AS (SELECT s AS node, s AS x FROM ADJ UNION SELECT R.node, t FROM R JOIN ADJ ON s = x) SELECT node, min(x) AS component FROM R GROUP BY 1""")
def op_177_components(spark, sf):
    k = Kin(spark, sf)
    return connected_components(k.adj, "s", "t")


# ---- regression on lineitem: y = log1p(price), x = quantity, z = discount, cells = line numbers


def _reg(spark, sf) -> DataFrame:
    d = table(spark, sf, "lineitem")
    return d.select(F.log1p("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("w"), (F.col("l_quantity") + F.col("l_tax") * 10).alias("z"), F.col("l_returnflag").alias("fe"), "l_suppkey", "l_linenumber", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"))


REG = "WITH d AS (SELECT ln(1 + l_extendedprice) AS y, l_quantity AS x, l_quantity + l_tax * 10 AS z, l_returnflag AS fe, l_suppkey AS g FROM lineitem), m AS (SELECT y - avg(y) OVER (PARTITION BY fe) AS y, x - avg(x) OVER (PARTITION BY fe) AS x, z - avg(z) OVER (PARTITION BY fe) AS z, g FROM d)"


@query(REG + """, b AS (SELECT sum(x * y) / sum(x * x) AS beta, count(*) AS n, sum(x * x) AS xx FROM m), s AS (SELECT g, sum(x * (y - beta * x)) AS s FROM m, b GROUP BY 1), c AS (SELECT sum(s * s) AS q, count(*) AS G FROM s)
SELECT 'ols' AS spec, 'x' AS term, round(beta, 6) AS beta, round(sqrt(q / (xx * xx) * G / (G - 1.0) * (n - 1.0) / (n - 4.0)), 6) AS se, n FROM b, c""")
def op_206_fe_ols_cluster(spark, sf):
    d = _reg(spark, sf)
    f = econ.ols(d, "y", ["x"], ["fe"], ["l_suppkey"])
    return r6(econ.tidy(spark, {"ols": (f, ["x"])}).select("spec", "term", "beta", "se", "n"))


@query(REG + """ SELECT 'iv' AS spec, 'x' AS term, round(sum(z * y) / sum(z * x), 6) AS beta, count(*) AS n FROM m""")
def op_203_iv(spark, sf):
    f = econ.iv(_reg(spark, sf), "y", ["x"], ["z"], [], ["fe"], ["l_suppkey"])
    return r6(econ.tidy(spark, {"iv": (f, ["x"])}).select("spec", "term", "beta", "n"))


@query()
def op_207_two_way(spark, sf):
    f = econ.iv(_reg(spark, sf), "y", ["x"], ["z"], ["w"], ["fe"], ["l_suppkey", "l_linenumber"])
    return r6(econ.tidy(spark, {"two_way": (f, ["x", "w"])}))


@query(REG + """ SELECT round(sum(x * y) / sum(x * x), 6) AS slope, round(corr(x, y), 6) AS partial_corr FROM m""")
def op_200_fwl(spark, sf):
    res = econ.residualize(_reg(spark, sf).select("y", "x", "fe"), ["y", "x"], [], ["fe"])
    return r6(res.agg((F.sum(F.col("x_res") * F.col("y_res")) / F.sum(F.col("x_res") * F.col("x_res"))).alias("slope"), F.corr("x_res", "y_res").alias("partial_corr")))


@query(REG.split(", m AS")[0] + """, m AS (SELECT y - avg(y) OVER (PARTITION BY fe) AS y, x - avg(x) OVER (PARTITION BY fe) AS x FROM d) SELECT round(1 - sum((y - b * x) * (y - b * x)) / sum(y * y), 6) AS within_r2 FROM m, (SELECT sum(x * y) / sum(x * x) AS b FROM m)""")
def op_202_within_r2(spark, sf):
    d = econ.within(_reg(spark, sf).select("y", "x", "fe"), ["y", "x"], ["fe"])
    c = F.corr("x_dm", "y_dm")
    return r6(d.agg((c * c).alias("within_r2")))


@query("""
WITH s AS (SELECT l_suppkey AS g, count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s)
SELECT g AS l_suppkey, round(((t.n - s.n) * (t.sxy - s.sxy) - (t.sx - s.sx) * (t.sy - s.sy)) / ((t.n - s.n) * (t.sxx - s.sxx) - (t.sx - s.sx) * (t.sx - s.sx)), 3) AS beta FROM s, t""")
def op_211_leave_one_out(spark, sf):
    d = econ.leave_one_out(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity")
    return d.select("l_suppkey", F.round("beta", 3).alias("beta"))


@query()
def op_212_wild_bootstrap(spark, sf):
    res = econ.residualize(_reg(spark, sf).select("y", "x", "fe", "l_suppkey"), ["y", "x"], [], ["fe"])
    t = econ.wild_bootstrap(res, "y_res", "x_res", "l_suppkey", 9_999, 7)
    observed = t.where("draw = 0").select(F.abs("t").alias("t0"))
    return t.where("draw > 0").crossJoin(observed).agg(F.count("*").alias("draws"), F.avg((F.abs("t") >= F.col("t0")).cast("double")).alias("p"))  # one row


@query("""
WITH d AS (SELECT 0 AS draw UNION ALL SELECT range FROM range(1, 6)), b AS (SELECT c_custkey, c_nationkey, c_acctbal, c_custkey % 7 AS z FROM customer),
r AS (SELECT draw, c_nationkey, c_acctbal, z, row_number() OVER (PARTITION BY draw, c_nationkey ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY draw, c_nationkey ORDER BY CASE WHEN draw = 0 THEN '' ELSE md5(concat_ws('|', '9', draw::VARCHAR, c_custkey::VARCHAR)) END, c_custkey) AS j FROM b, d)
SELECT x.draw, round(sum(x.z * y.c_acctbal), 2) AS stat FROM r x JOIN r y ON x.draw = y.draw AND x.c_nationkey = y.c_nationkey AND x.i = y.j GROUP BY 1""")
def op_213_permutation(spark, sf):
    d = table(spark, sf, "customer").withColumn("z", F.col("c_custkey") % 7)
    return econ.permutation_test(d, "c_nationkey", "c_custkey", "c_acctbal", "z", 5, 9).select("draw", F.round("stat", 2).alias("stat"))


@query()
def op_213_permutation_999(spark, sf):
    d = table(spark, sf, "customer").withColumn("z", F.col("c_custkey") % 7)
    return econ.permutation_test(d, "c_nationkey", "c_custkey", "c_acctbal", "z", 999, 9).select("draw", F.round("stat", 2).alias("stat"))


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY l_suppkey) - 1 AS no, count(*) OVER () AS g, * FROM (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS sx, sum(ln(1 + l_extendedprice)) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * ln(1 + l_extendedprice)) AS sxy FROM lineitem GROUP BY 1)),
d AS (SELECT draw, turn, CAST('0x' || substr(md5('3|' || draw || '|' || turn), 1, 12) AS BIGINT) % (SELECT max(g) FROM s) AS no FROM (SELECT range + 1 AS draw FROM range(20)), (SELECT no AS turn FROM s)),
t AS (SELECT draw, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM d JOIN s USING (no) GROUP BY 1) SELECT draw, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) AS stat FROM t""")
def op_215_cluster_draws(spark, sf):
    return r6(econ.cluster_bootstrap(_reg(spark, sf), "l_suppkey", "y", "x", 20, 3))


@query()
def op_215_cluster_bootstrap(spark, sf):
    d = econ.cluster_bootstrap(_reg(spark, sf), "l_suppkey", "y", "x", 200, 3)
    return panel.boot_summary(d)


@query()
def op_216_poisson(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), (F.col("l_quantity") / 10).alias("x"), F.col("l_returnflag").alias("fe"))
    return r6(econ.tidy(spark, {"poisson": (econ.poisson(d, "y", ["x"], ["fe"]), ["x"])}))


@query()
def op_217_control_function(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_quantity") / 10 + F.col("l_tax")).alias("z"), F.col("l_discount").alias("w"), F.col("l_returnflag").alias("fe"))
    f = econ.control_function(d, "y", "x", "z", ["w"], ["fe"])
    return r6(econ.tidy(spark, {"cf": (f, ["x", "x_res"])}))


@query()
def op_218_oster(spark, sf):
    d = _reg(spark, sf)
    short, long = econ.ols(d, "y", ["x"]), econ.ols(d, "y", ["x", "w"], ["fe"])
    b = econ.oster(short.row("x")["beta"], 1 - short.rss / short.tss, long.row("x")["beta"], 1 - long.rss / long.tss)
    return spark.createDataFrame([(k, v["rmax"], v["delta"], v["beta_star"], v["robust"]) for k, v in b.items()], "rule string, rmax double, delta double, beta_star double, robust boolean")


@query()
def op_219_margins(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("double").alias("y"), F.col("l_quantity").alias("x"), (F.col("l_quantity") + F.col("l_tax") * 10).alias("z"), F.col("l_returnflag").alias("fe"), "l_suppkey")
    return r6(econ.margins(d, "y", "x", "z", [], ["fe"], ["l_suppkey"]))


@query("""
WITH r AS (SELECT l_suppkey AS g, l_tax AS z, l_discount AS e FROM lineitem), p AS (SELECT g, sum(z * z) AS a, abs(sum(z * e)) AS b FROM r GROUP BY 1)
SELECT round(sum(a) * sum(a) / sum(a * a), 4) AS by_instrument, round(sum(b) * sum(b) / sum(b * b), 4) AS by_score FROM p""")
def op_145_effective_clusters(spark, sf):
    d = econ.effective_clusters(table(spark, sf, "lineitem"), "l_tax", "l_discount", "l_suppkey")
    return d.select(F.round("by_instrument", 4).alias("by_instrument"), F.round("by_score", 4).alias("by_score"))
