"""Queries of scalar functions, filters, joins by role, summaries and specification grids, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.functions import stats
from kinweave.functions import text as X
from kinweave.operators import community, econ, graph, panel, relational
from kinweave.plans.graph_queries import KIN, REG, ROLES, Kin, _reg, ball, features
from kinweave.plans.relational_queries import part_lives, r6
from kinweave.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


@query("""SELECT DISTINCT match_id, TRY_CAST(trunc(TRY_CAST(trim(substring(match_id, 2, 9)) AS DOUBLE)) AS INTEGER) AS n, TRY_CAST(trunc(TRY_CAST(trim(confidence) AS DOUBLE)) AS INTEGER) AS bad FROM doc_matches_ai_extracted_high""")
def op_030_to_year(spark, sf):
    (m,) = _t(spark, sf, "doc_matches_ai_extracted_high")
    return m.select("match_id", S.to_year(F.substring("match_id", 2, 9)).alias("n"), S.to_year("confidence").alias("bad")).distinct()


@query("""SELECT CASE WHEN upper(trim(sex)) IN ('M', 'F') THEN upper(trim(sex)) ELSE '' END AS sex, count(DISTINCT id) AS n FROM persons_imputed GROUP BY 1""")
def op_031_norm_sex(spark, sf):
    (p,) = _t(spark, sf, "persons_imputed")
    return p.groupBy(S.norm_sex("sex").alias("sex")).agg(F.count_distinct("id").alias("n"))


@query("""SELECT c_nationkey, CAST(round_even(median(c_custkey), 0) AS INTEGER) AS med FROM customer GROUP BY 1""")
def op_033_bround_median(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(S.bround_median("c_custkey").alias("med"))


@query("""SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) AS lg, round(exp(c_custkey % 10) - 1, 3) AS ex, round(pow(2.0, -(c_custkey % 8)), 6) AS w, greatest(least(c_acctbal, 5000.0), 1.0) AS clipped FROM customer""")
def op_035_logs_and_clips(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.round(F.log1p(F.abs("c_acctbal")), 6).alias("lg"), F.round(F.expm1(F.col("c_custkey") % 10), 3).alias("ex"), F.round(F.pow(F.lit(2.0), -(F.col("c_custkey") % 8)), 6).alias("w"), S.clip("c_acctbal", 1.0, 5000.0).alias("clipped"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(split_part(lower(p_name), ',', 1), '^[a-z]+$') THEN split_part(lower(p_name), ',', 1) ELSE list_filter(string_split_regex(trim(split_part(lower(p_name), ',', 1)), '\\s+'), lambda t: regexp_matches(t, '^[a-z]+$') AND t NOT IN ('part', 'the'))[1] END AS token FROM part""".replace("\\\\", "\\"))
def op_041_first_token(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.first_name_token("p_name", ["part", "the"]).alias("token"))


@query("""SELECT doc_id, coalesce(contains(lower(text), 'abba') OR contains(lower(text), 'prior'), false) AS hit, coalesce(contains(lower(text), 'rex') OR contains(lower(text), 'dux'), false) AS marked FROM documents""")
def op_042_contains_any(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.contains_any(F.lower("text"), F.array(F.lit("abba"), F.lit("prior"))).alias("hit"), X.has_marker("text", ["rex", "dux"]).alias("marked"))


@query("""SELECT DISTINCT item_id_telma, CASE WHEN genre = 'mandement' THEN 1 ELSE 0 END AS is_mandement, CASE WHEN genre LIKE '[%' THEN array_to_string(CAST(json_extract_string(genre, '$[*]') AS VARCHAR[]), ' | ') ELSE genre END AS genre FROM aposcripta_dataset""")
def op_049_genre(spark, sf):
    a = table(spark, sf, "aposcripta_dataset")
    return a.select("item_id_telma", F.coalesce((F.col("genre") == "mandement").cast("int"), F.lit(0)).alias("is_mandement"), X.list_or_text("genre").alias("genre")).distinct()


@query("""SELECT DISTINCT item_id_telma, CASE WHEN length(trim("analyse")) > 0 THEN "analyse" WHEN length(trim(regeste)) > 0 THEN regeste END AS text, substring("analyse", 1, 60) AS head, coalesce(length("analyse") > 60, false) AS cut FROM aposcripta_dataset""")
def op_050_fallback_and_cut(spark, sf):
    a = table(spark, sf, "aposcripta_dataset")
    head, cut = S.truncate("analyse", 60)
    return a.select("item_id_telma", S.first_text("analyse", "regeste").alias("text"), head.alias("head"), cut.alias("cut")).distinct()


@query("""SELECT DISTINCT doc_id, CASE domain WHEN 'clerical_discipline' THEN 'other' ELSE domain END AS domain, CASE WHEN year <= 1215 THEN 'early' WHEN year > 1215 THEN 'late' END AS era FROM matched_docs_coded""")
def op_056_remap_and_era(spark, sf):
    m = table(spark, sf, "matched_docs_coded")
    return m.select("doc_id", S.remap("domain", {"clerical_discipline": "other"}).alias("domain"), F.when(F.col("year") <= 1215, "early").when(F.col("year") > 1215, "late").alias("era")).distinct()


@query(KIN + """ SELECT SP.a, SP.b, CAST(floor((x.birth + y.birth) / 2.0) AS INTEGER) AS by_birth, CAST(floor((x.death + y.death) / 2.0) AS INTEGER) AS by_death, CAST(floor((floor((x.birth + x.death) / 2.0) + floor((y.birth + y.death) / 2.0)) / 2.0) AS INTEGER) AS by_midlife FROM SP JOIN P x ON x.id = a JOIN P y ON y.id = b""")
def op_061_couple_year(spark, sf):
    k = Kin(spark, sf)
    j = relational.role_join(k.spouses, k.persons.select("id", "birth", "death"), {"x": "a", "y": "b"}).join(k.persons.select(F.col("id").alias("a")), "a", "left_semi").join(k.persons.select(F.col("id").alias("b")), "b", "left_semi")
    return j.select("a", "b", *[S.couple_year("x_birth", "x_death", "y_birth", "y_death", p).alias("by_" + p) for p in ("birth", "death", "midlife")])


@query("""WITH n AS (SELECT doc_id, count(DISTINCT match_id) AS prior FROM doc_matches_ai_extracted_high GROUP BY 1) SELECT DISTINCT item_id_telma, CASE WHEN prior >= 5 THEN 'rich' WHEN prior IS NOT NULL THEN 'poor' ELSE 'none' END AS stratum, coalesce(prior, 0) AS prior FROM aposcripta_dataset LEFT JOIN n ON doc_id = item_id_telma""")
def op_063_stratum(spark, sf):
    a, m = _t(spark, sf, "aposcripta_dataset", "doc_matches_ai_extracted_high")
    n = m.groupBy(F.col("doc_id").alias("item_id_telma")).agg(F.count_distinct("match_id").alias("prior"))
    j = a.select("item_id_telma").distinct().join(n, "item_id_telma", "left")
    return j.select("item_id_telma", F.when(F.col("prior") >= 5, "rich").when(F.col("prior").isNotNull(), "poor").otherwise("none").alias("stratum"), F.coalesce("prior", F.lit(0)).alias("prior"))


@query(KIN + """ SELECT id, round(ln(1 + coalesce(breadth, 0)), 6) AS log_breadth, coalesce(breadth, 0) AS breadth FROM P LEFT JOIN (SELECT s, count(DISTINCT label) AS breadth FROM ADJ JOIN L ON id = t GROUP BY 1) ON s = id""")
def op_064_role_logs(spark, sf):
    k = Kin(spark, sf)
    j = k.persons.select("id").join(graph.breadth(k.adj, k.labels), "id", "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    return r6(j.select("id", F.log1p("breadth").alias("log_breadth"), "breadth"))


@query(KIN + """ SELECT id FROM P WHERE birth <= 1300 AND death >= 1100""")
def op_071_overlap(spark, sf):
    k = Kin(spark, sf)
    return k.persons.where(S.overlaps("birth", "death", 1100, 1300)).select("id")


@query("""WITH p AS (SELECT DISTINCT name, id, birth FROM persons_imputed WHERE name IS NOT NULL), c AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM p) SELECT name, id FROM c WHERE n = 1 OR birth IS NULL OR birth BETWEEN 800 AND 1050""")
def op_073_multimatch(spark, sf):
    p = table(spark, sf, "persons_imputed").where("name IS NOT NULL").select("name", "id", "birth").distinct()
    return relational.filter_multimatch(p, "name", "birth").select("name", "id")


@query("""SELECT count(*) FILTER (birth IS NULL) AS no_year, count(*) FILTER (birth < 50) AS too_early, count(*) AS "all" FROM persons_imputed""")
def op_074_min_year(spark, sf):
    return relational.min_year(table(spark, sf, "persons_imputed"), "birth")[1]


@query("""SELECT DISTINCT id FROM persons_imputed WHERE regexp_matches(lower(coalesce(name, '')), 'comt|count|graf|conte') AND sex = 'M' AND id NOT IN (SELECT id FROM dynasty_anchors)""")
def op_079_sample_predicate(spark, sf):
    p, a = _t(spark, sf, "persons_imputed", "dynasty_anchors")
    return relational.prune(p.where("lower(coalesce(name, '')) RLIKE 'comt|count|graf|conte' AND sex = 'M'").select("id").distinct(), a, "id")


@query(KIN + """ SELECT P.id, label, father_id, mother_id FROM P LEFT JOIN L USING (id) LEFT JOIN FM ON child_id = P.id""")
def op_080_attach(spark, sf):
    k = Kin(spark, sf)
    return relational.attach(k.persons.select("id"), k.labels, k.order.withColumnRenamed("child_id", "id"), on="id")


@query(KIN + """ SELECT child_id, father_id, mother_id, mgf_id FROM KIN""")
def op_083_ancestors(spark, sf):
    return Kin(spark, sf).kin


@query(KIN + """ SELECT child_id, f.birth AS father_birth, m.birth AS mother_birth FROM FM LEFT JOIN P f ON f.id = father_id LEFT JOIN P m ON m.id = mother_id""")
def op_085_role_join(spark, sf):
    k = Kin(spark, sf)
    return relational.role_join(k.order, k.births, {"father": "father_id", "mother": "mother_id"}).select("child_id", "father_birth", "mother_birth")


@query("""WITH n AS (SELECT DISTINCT anchor_name || CASE WHEN dynasty LIKE '%e%' THEN '  ' ELSE '' END AS name FROM dynasty_anchors), e AS (SELECT name, min(id) AS id FROM persons_imputed GROUP BY 1), t AS (SELECT trim(name) AS name, min(id) AS id FROM persons_imputed GROUP BY 1)
SELECT n.name, coalesce(e.id, t.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN t.id IS NOT NULL THEN 'trimmed' END AS tier FROM n LEFT JOIN e ON e.name = n.name LEFT JOIN t ON t.name = trim(n.name)""")
def op_092_name_lookup(spark, sf):
    a, p = _t(spark, sf, "dynasty_anchors", "persons_imputed")
    n = a.select(F.concat("anchor_name", F.when(F.col("dynasty").contains("e"), "  ").otherwise("")).alias("name")).distinct()
    return relational.name_lookup(n, p)


@query(KIN + """ SELECT SP.a, SP.b, x.label AS label_a, y.label AS label_b FROM SP LEFT JOIN L x ON x.id = a LEFT JOIN L y ON y.id = b""")
def op_093_label_endpoints(spark, sf):
    k = Kin(spark, sf)
    return relational.label_endpoints(k.spouses, k.labels).select("a", "b", "label_a", "label_b")


@query()
def op_097_null_pairs(spark, sf):
    k = Kin(spark, sf)
    d = table(spark, sf, "matched_docs_coded").where("year IS NOT NULL").select(F.col("doc_id").alias("dyad_id"), F.col("year").cast("int").alias("year")).distinct()
    return relational.null_pairs(d, k.persons, 3, 7)


@query("""SELECT DISTINCT k FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)""")
def op_100_union_claims(spark, sf):
    li, o = _t(spark, sf, "lineitem", "orders")
    return relational.union_claims(li.where("l_quantity > 45").select(F.col("l_orderkey").alias("k")), o.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("k")))


@query(KIN + """ SELECT SP.a, SP.b, count(y.child_id) AS common FROM SP LEFT JOIN PP x ON x.parent_id = SP.a LEFT JOIN PP y ON y.parent_id = SP.b AND y.child_id = x.child_id GROUP BY 1, 2""")
def op_102_common_children(spark, sf):
    k = Kin(spark, sf)
    x = k.parents.select(F.col("parent_id").alias("a"), "child_id")
    y = k.parents.select(F.col("parent_id").alias("b"), F.col("child_id").alias("c2"))
    j = k.spouses.join(x, "a", "left")
    return j.join(y, (j["b"] == y["b"]) & (j["child_id"] == y["c2"]), "left").groupBy("a", j["b"]).agg(F.count("c2").alias("common"))


@query("""SELECT id, 1 AS n FROM persons_imputed GROUP BY 1 UNION ALL SELECT item_id_telma, 2 FROM aposcripta_dataset GROUP BY 1""")
def op_101_stack(spark, sf):
    p, a = _t(spark, sf, "persons_imputed", "aposcripta_dataset")
    return relational.stack([p.select("id", F.lit(1).alias("n")).dropDuplicates(["id"]), a.select(F.col("item_id_telma").alias("id"), F.lit(2).alias("n")).dropDuplicates(["id"])])


@query("""WITH w AS (SELECT o_orderkey, o_custkey AS c0, o_orderpriority AS c1, o_orderstatus AS c2 FROM orders) SELECT o_orderkey, CAST(position AS INTEGER) AS position, value FROM (SELECT o_orderkey, 0 AS position, CAST(c0 AS VARCHAR) AS value FROM w UNION ALL SELECT o_orderkey, 1, c1 FROM w UNION ALL SELECT o_orderkey, 2, c2 FROM w) WHERE length(trim(value)) > 0""")
def op_112_wide_to_long(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c0_link"), F.col("o_orderpriority").alias("c1_link"), F.col("o_orderstatus").alias("c2_link"))
    return relational.wide_to_long(o, "o_orderkey", "c", 3)


@query("""WITH m AS (SELECT DISTINCT match_id, person_id, doc_year, inferred_subjects FROM doc_matches_ai_extracted_high WHERE person_id IS NOT NULL AND doc_year BETWEEN 1100 AND 1300)
SELECT person_id, count(*) AS total, count(*) FILTER (list_contains(string_split(inferred_subjects, ';'), 'marriage')) AS marriage, count(*) - count(*) FILTER (list_contains(string_split(inferred_subjects, ';'), 'marriage')) AS rest FROM m GROUP BY 1""")
def op_126_inwindow_counts(spark, sf):
    m = table(spark, sf, "doc_matches_ai_extracted_high").where("person_id IS NOT NULL AND doc_year BETWEEN 1100 AND 1300").select("match_id", "person_id", "inferred_subjects").distinct()
    hit = F.count_if(F.array_contains(F.split("inferred_subjects", ";"), "marriage"))
    return m.groupBy("person_id").agg(F.count("*").alias("total"), hit.alias("marriage")).withColumn("rest", F.col("total") - F.col("marriage"))


@query("""SELECT max_by(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders""")
def op_133_argmax(spark, sf):
    return table(spark, sf, "orders").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("""WITH m AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS x FROM lineitem) SELECT round(corr(x, y), 6) AS partial_corr FROM m""")
def op_136_partial_corr(spark, sf):
    d = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_returnflag")
    return r6(econ.partial_corr(d, "l_quantity", "l_extendedprice", [], ["l_returnflag"]))


@query()
def op_140_exact_precision(spark, sf):
    """Exact interval of the share of disputes per confidence, and Fisher's test of high against the rest."""
    m = table(spark, sf, "matched_docs_coded").select("doc_id", "is_dispute", "is_dispute_conf").distinct()
    rows = m.groupBy("is_dispute_conf").agg(F.count_if(F.col("is_dispute") == "yes").alias("k"), F.count("*").alias("n")).collect()  # one row per confidence
    out = []
    for r in rows:
        lo, hi = stats.clopper_pearson(r["k"], r["n"])
        others = [x for x in rows if x["is_dispute_conf"] != r["is_dispute_conf"]]
        k2, n2 = sum(x["k"] for x in others), sum(x["n"] for x in others)
        out.append((r["is_dispute_conf"], r["k"], r["n"], lo, hi, stats.fisher_exact(r["k"], r["n"] - r["k"], k2, n2 - k2)))
    return spark.createDataFrame(out, "confidence string, k long, n long, lo double, hi double, fisher_p double")


@query("""SELECT lower(trim(confidence)) AS confidence, lower(trim(role)) AS role, count(DISTINCT match_id) AS n FROM doc_matches_ai_extracted_high GROUP BY 1, 2""")
def op_142_tally(spark, sf):
    m = table(spark, sf, "doc_matches_ai_extracted_high")
    return m.groupBy(F.lower(F.trim("confidence")).alias("confidence"), F.lower(F.trim("role")).alias("role")).agg(F.count_distinct("match_id").alias("n"))


@query("""SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 1) AS mean FROM orders""")
def op_146_group_mean_back(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.group_back(o, ["o_custkey"], "o_totalprice", "avg").select("o_orderkey", F.round("avg_o_totalprice", 1).alias("mean"))


@query("""WITH m AS (SELECT median(c_acctbal) AS m FROM customer) SELECT count(*) AS B, round(1.4826 * median(abs(c_acctbal - m)), 6) AS robust_sd, round(quantile_cont(c_acctbal, 0.025), 6) AS lo, round(quantile_cont(c_acctbal, 0.975), 6) AS hi, round(greatest(2 * least(avg(CASE WHEN c_acctbal <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0 END)), 1.0 / count(*)), 6) AS p FROM customer, m""")
def op_148_boot_summary(spark, sf):
    return r6(panel.boot_summary(table(spark, sf, "customer").select(F.col("c_acctbal").alias("stat"))))


@query("""SELECT count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round((9000 - avg(c_acctbal)) / stddev_samp(c_acctbal), 6) AS z, round((1 + count(*) FILTER (abs(c_acctbal) >= 9000)) / (1 + count(*))::DOUBLE, 6) AS p FROM customer""")
def op_149_perm_summary(spark, sf):
    return r6(panel.perm_summary(table(spark, sf, "customer").select(F.col("c_acctbal").alias("stat")), 9000.0))


@query("""SELECT l_linenumber AS depth, round(count(*) / (SELECT count(*) FROM lineitem WHERE l_linenumber BETWEEN 3 AND 7)::DOUBLE, 6) AS weight FROM lineitem WHERE l_linenumber BETWEEN 3 AND 7 GROUP BY 1""")
def op_149b_profile(spark, sf):
    return r6(panel.profile(table(spark, sf, "lineitem"), "l_linenumber", 3, 7))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN l_linenumber <= 5 THEN 1.0 ELSE 0 END), 6) AS reachable, round(avg(l_linenumber) FILTER (l_linenumber <= 5), 6) AS mean, median(l_linenumber) FILTER (l_linenumber <= 5)::DOUBLE AS median, round(avg(l_linenumber) FILTER (l_linenumber BETWEEN 2 AND 5), 6) AS mean_beyond_1 FROM lineitem GROUP BY 1""")
def op_149c_distance_summary(spark, sf):
    return r6(panel.distance_summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", 5))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def op_152_first_in_group(spark, sf):
    return relational.first_in_group(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20""")
def op_154_top(spark, sf):
    return table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(20).select("c_custkey")


@query(ROLES.replace("{hops}", "6") + "SELECT seed, role, " + ", ".join(f"count(DISTINCT CASE WHEN d <= {h} THEN label END) AS reach_{h}, count(*) FILTER (d BETWEEN 1 AND {h}) AS nodes_{h}" for h in (3, 4, 5, 6)) + " FROM B LEFT JOIN L ON id = node GROUP BY 1, 2")
def op_164_hop_sweep(spark, sf):
    k = Kin(spark, sf)
    ball = graph.gated_ball(graph.role_seeds(k.persons, k.kin), k.adj, k.births, 6)
    return graph.reach(ball, k.labels, [3, 4, 5, 6])


@query()
def op_170_ring_profile(spark, sf):
    k = Kin(spark, sf)
    rings = ball(k, 7)
    return r6(graph.ring_profile(rings, features(spark, sf, k), "breadth", panel.profile(rings, "depth", 1, 7)))


@query()
def op_181_fixed_k(spark, sf):
    k = Kin(spark, sf)
    return community.fixed_k(graph.quotient_graph(k.spouses, k.labels), 5)[1]


@query("""WITH d AS (SELECT l_linenumber AS g, avg(l_quantity) AS y, ln(count(*)) AS x FROM lineitem GROUP BY 1), c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM d) SELECT g, round(y - a - b * x + m, 4) AS y_adj FROM d, c""")
def op_185_edge_controlled(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("g")).agg(F.avg("l_quantity").alias("y"), F.count("*").alias("n"))
    return graph.edge_controlled(d, "y", "n").select("g", F.round("y_adj", 4).alias("y_adj"))


@query(KIN + """, W AS (SELECT id AS root, id AS node FROM P WHERE sex = 'M' UNION SELECT root, child_id FROM W JOIN (SELECT parent_id, child_id FROM PP JOIN P ON id = parent_id WHERE sex = 'M') ON parent_id = node) SELECT root, count(*) - 1 AS n FROM W GROUP BY 1""")
def op_188_male_line_descendants(spark, sf):
    k = Kin(spark, sf)
    kids = k.parents.join(k.persons.select(F.col("id").alias("parent_id"), F.col("sex").alias("parent_sex")), "parent_id")
    d = graph.male_line_descendants(k.persons.where("sex = 'M'"), kids, max_depth=200)
    return d.groupBy("root").agg((F.count("*") - 1).alias("n"))


@query(KIN + """, S AS (SELECT s AS node, 0 AS depth FROM (SELECT s, count(*) AS n FROM ADJ GROUP BY 1 ORDER BY n DESC, s LIMIT 1)), W AS (SELECT node, depth FROM S UNION SELECT t, depth + 1 FROM W JOIN ADJ ON s = node WHERE depth < 2)
SELECT node, min(depth) AS depth, any_value(label) AS label FROM W LEFT JOIN L ON id = node GROUP BY 1""")
def op_194_ego_network(spark, sf):
    k = Kin(spark, sf)
    seed = k.adj.groupBy("s").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "s").first()
    return graph.ego_network(k.adj, seed["s"] if seed else "", 2, k.labels)[0]


@query(KIN + """, M AS (SELECT DISTINCT match_id, person_id, doc_region FROM doc_matches_ai_extracted_high WHERE doc_region IS NOT NULL), C AS (SELECT label, doc_region, count(*) AS n FROM M JOIN L ON id = person_id GROUP BY 1, 2), R AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, doc_region) AS rn, sum(n) OVER (PARTITION BY label) AS t FROM C)
SELECT label, doc_region AS mode, round(n / t::DOUBLE, 6) AS share FROM R WHERE rn = 1""")
def op_197_group_region(spark, sf):
    """Region of each dynasty: the one most of the letters that name its members come from."""
    k = Kin(spark, sf)
    m = table(spark, sf, "doc_matches_ai_extracted_high").where("doc_region IS NOT NULL").select("match_id", F.col("person_id").alias("id"), "doc_region").distinct()
    return r6(panel.mode_label(m.join(k.labels, "id"), ["label"], "doc_region"))


@query("""WITH d AS (SELECT ln(1 + l_extendedprice) AS y, l_quantity AS x, l_discount AS w, l_quantity + l_tax * 10 AS z, l_returnflag AS fe FROM lineitem), e AS (SELECT *, x * w AS x2, z * w AS z2 FROM d),
m AS (SELECT y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, w - avg(w) OVER p AS w, z - avg(z) OVER p AS z, x2 - avg(x2) OVER p AS x2, z2 - avg(z2) OVER p AS z2 FROM e WINDOW p AS (PARTITION BY fe)),
q AS (SELECT y - w * (sum(y * w) OVER () / sum(w * w) OVER ()) AS y, x - w * (sum(x * w) OVER () / sum(w * w) OVER ()) AS x, z - w * (sum(z * w) OVER () / sum(w * w) OVER ()) AS z, x2 - w * (sum(x2 * w) OVER () / sum(w * w) OVER ()) AS x2, z2 - w * (sum(z2 * w) OVER () / sum(w * w) OVER ()) AS z2 FROM m),
s AS (SELECT sum(z * x) AS a, sum(z * x2) AS b, sum(z2 * x) AS c, sum(z2 * x2) AS d, sum(z * y) AS e, sum(z2 * y) AS f, count(*) AS n FROM q)
SELECT 'x' AS term, round((d * e - b * f) / (a * d - b * c), 6) AS beta, n FROM s UNION ALL SELECT 'x2', round((a * f - c * e) / (a * d - b * c), 6), n FROM s""")
def op_204_two_endogenous(spark, sf):
    d = _reg(spark, sf).withColumn("x2", F.col("x") * F.col("w")).withColumn("z2", F.col("z") * F.col("w"))
    return r6(econ.tidy(spark, {"interaction": (econ.iv(d, "y", ["x", "x2"], ["z", "z2"], ["w"], ["fe"], ["l_suppkey"]), ["x", "x2"])}).select("term", "beta", "n"))


@query(REG + """, b AS (SELECT sum(z * x) / sum(z * z) AS beta, count(*) AS n, sum(z * z) AS zz FROM m), s AS (SELECT g, sum(z * (x - beta * z)) AS s FROM m, b GROUP BY 1), c AS (SELECT sum(s * s) AS q, count(*) AS G FROM s)
SELECT round(beta * beta / (q / (zz * zz) * G / (G - 1.0) * (n - 1.0) / (n - 4.0)), 2) AS f_first FROM b, c""")
def op_205_first_stage(spark, sf):
    f = econ.iv(_reg(spark, sf), "y", ["x"], ["z"], [], ["fe"], ["l_suppkey"])
    return spark.createDataFrame([(round(f.first_stage_f, 2),)], "f_first double")


@query(REG + """ SELECT 'reduced' AS spec, round(sum(z * y) / sum(z * z), 6) AS beta FROM m""")
def op_209_reduced_form(spark, sf):
    f = econ.ols(_reg(spark, sf), "y", ["z"], ["fe"], ["l_suppkey"])
    return r6(econ.tidy(spark, {"reduced": (f, ["z"])}).select("spec", "beta"))


@query()
def op_214_group_permutation(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("z", (F.col("o_custkey") % 7).cast("double"))
    draws = econ.group_permutation(d, "c_nationkey", "o_custkey", "o_totalprice", "z", 50, 11)
    observed = draws.where("draw = 0").first()["stat"]
    return r6(panel.perm_summary(draws.where("draw > 0"), float(observed)))


@query(REG + """, b AS (SELECT sum(z * y) / sum(z * x) AS b, sum(z * x) AS w, count(*) AS n FROM m), s AS (SELECT g, sum(z * (y - b * x)) AS v FROM m, b GROUP BY 1), c AS (SELECT sum(v * v) AS q, count(*) AS G FROM s), sd AS (SELECT stddev_samp(x) AS sd FROM d)
SELECT round(b * sd, 6) AS beta_per_sd, round(sqrt(q / (w * w) * G / (G - 1.0) * (n - 1.0) / (n - 4.0)) * sd, 6) AS se_per_sd FROM b, c, sd""")
def op_229_scaled(spark, sf):
    d = _reg(spark, sf)
    sd = d.agg(F.stddev_samp("x").alias("s")).first()["s"]
    f = econ.iv(d, "y", ["x"], ["z"], [], ["fe"], ["l_suppkey"]).row("x")
    return spark.createDataFrame([(round(f["beta"] * sd, 6), round(f["se"] * sd, 6))], "beta_per_sd double, se_per_sd double")


@query("""SELECT CASE WHEN l_tax < 0.001 THEN '<0.001' ELSE printf('%.3f', l_tax) END AS p, CASE WHEN l_tax < 0.01 THEN '***' WHEN l_tax < 0.05 THEN '**' WHEN l_tax < 0.1 THEN '*' ELSE '' END AS stars, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def op_027_formats(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.format_p("l_tax").alias("p"), S.stars("l_tax").alias("stars")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, window_start, count(*) AS n FROM (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start FROM events) GROUP BY 1, 2""")
def op_l_daily_windows(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").alias("window_start"))
    return e.groupBy("user_id", "window_start").agg(F.count("*").alias("n")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""SELECT b, count(*) AS n FROM ({"SELECT l_partkey AS id, min(800 + l_orderkey % 600) AS b FROM lineitem GROUP BY 1"}) GROUP BY 1""")
def op_196_first_years(spark, sf):
    return part_lives(spark, sf).groupBy("b").agg(F.count("*").alias("n"))


