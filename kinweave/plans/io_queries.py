"""Queries of sources and sinks (written to the shared folder and read back) and of small column operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.functions import text as X
from kinweave.operators import relational
from kinweave.plans.relational_queries import r6
from kinweave.runtime import scratch, table
from kinweave.sources import readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PERSONS = "SELECT DISTINCT id, name, sex, birth, death FROM persons_imputed WHERE id IS NOT NULL"


def _persons(spark, sf):
    return table(spark, sf, "persons_imputed").where("id IS NOT NULL").select("id", "name", "sex", "birth", "death").distinct()


# ---- sources and sinks


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM customer")
def op_001_csv_strings(spark, sf):
    cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf, "customer").select(*[F.col(c).cast("string").alias(c) for c in cols]), path)
    return readers.read_csv_strings(spark, path, cols)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def op_002_csv_typed(spark, sf):
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), path)
    return readers.read_csv(spark, path, "c_custkey bigint, c_nationkey int, c_acctbal double")


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, s_nationkey FROM supplier")
def op_003_csv_ids(spark, sf):
    """Ids with leading zeros stay text."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("id"), "s_nationkey"), path)
    return readers.read_csv(spark, path, "id string, s_nationkey int")


@query("SELECT DISTINCT id, coalesce(name, '') AS name, coalesce(sex, '') AS sex FROM persons_imputed WHERE id IS NOT NULL")
def op_005_csv_bom_quotes(spark, sf):
    """A byte order mark, every field quoted, names with accents and odd characters (OP-004, OP-005, OP-021)."""
    path = scratch(spark, "csv")
    sinks.write_csv(_persons(spark, sf).select("id", "name", "sex").distinct(), path, quote_all=True, bom=True)
    return readers.read_csv_strings(spark, path, ["id", "name", "sex"])


@query("SELECT n_nationkey, n_name FROM nation")
def op_007_json_documents(spark, sf):
    """One document per file; here every part file holds one (OP-007, OP-023)."""
    path = scratch(spark, "json")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    n.repartition(32, "n_nationkey").write.json(path)
    return spark.read.schema("n_nationkey int, n_name string").json(path)


@query("SELECT n_nationkey, n_name FROM nation")
def op_008_jsonl(spark, sf):
    """Broken lines and lines that are no object are skipped."""
    path = scratch(spark, "jsonl")
    n = table(spark, sf, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    broken = spark.createDataFrame([('{"n_nationkey": 1, "n_na',), ("[1, 2]",), ("",), ("words",)], "value string")
    n.union(broken).write.text(path)
    return readers.read_jsonl(spark, path, "n_nationkey int, n_name string").drop("file")


@query("SELECT p_partkey, p_name FROM part")
def op_009_gzip(spark, sf):
    path = scratch(spark, "gz")
    table(spark, sf, "part").select("p_partkey", "p_name").write.options(header=True, compression="gzip", escape='"').csv(path)
    return readers.read_csv(spark, path, "p_partkey bigint, p_name string")


@query("SELECT * FROM (VALUES ('M', 30), ('F', 25)) t(sex, gap)")
def op_011_literal(spark, sf):
    return readers.literal_table(spark, [("M", 30), ("F", 25)], "sex string, gap int")


@query("SELECT 'nation' AS \"check\", CASE WHEN count(*) = 25 THEN 'ok' ELSE 'differs' END AS status, count(*) || ' of 25' AS detail FROM nation UNION ALL SELECT 'nowhere', 'missing', 'expected 1'")
def op_012_check_inputs(spark, sf):
    return readers.check_inputs(spark, {"nation": table(spark, sf, "nation")}, {"nation": 25, "nowhere": 1})


@query("SELECT n_nationkey, n_name FROM nation")
def op_013_optional(spark, sf):
    schema = "n_nationkey int, n_name string"
    there, missing = (readers.optional_table(spark, f"{sf}/{n}.parquet", schema) for n in ("nation", "no_such_table"))
    return there.select("n_nationkey", "n_name").union(missing)


@query("SELECT * FROM (VALUES ('a', 'unchanged'), ('b', 'modified'), ('c', 'removed'), ('d', 'new')) t(file, status)")
def op_015_manifest(spark, sf):
    old = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0)], "file string, modified double")
    new = spark.createDataFrame([("a", 10.4), ("b", 12.0), ("d", 10.0)], "file string, modified double")
    return readers.manifest_diff(old, new)


@query("SELECT 2 * count(*) AS n, count(DISTINCT n_nationkey) AS keys FROM nation")
def op_022_append(spark, sf):
    path, n = scratch(spark, "append"), table(spark, sf, "nation")
    sinks.append_table(n, path)
    sinks.append_table(n, path)
    return spark.read.schema(n.schema).parquet(path).agg(F.count("*").alias("n"), F.count_distinct("n_nationkey").alias("keys"))


@query("""SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_nationkey":' || s_nationkey || '}' AS json FROM supplier""")
def op_023_json_rows(spark, sf):
    return sinks.json_rows(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")


@query(r"""SELECT '## Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) || chr(10) AS report FROM region""")
def op_025_markdown(spark, sf):
    return spark.createDataFrame([(sinks.to_markdown(table(spark, sf, "region").orderBy("r_regionkey"), "Regions"),)], "report string")


@query(r"""SELECT '\begin{table}' || chr(10) || '\caption{Regions}' || chr(10) || '\begin{tabular}{ll}' || chr(10) || '\toprule' || chr(10) || 'r\_regionkey & r\_name \\' || chr(10) || '\midrule' || chr(10) || string_agg(r_regionkey || ' & ' || replace(r_name, '_', '\_') || ' \\', chr(10) ORDER BY r_regionkey) || chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' || chr(10) || '\end{table}' || chr(10) AS report FROM region""")
def op_026_latex(spark, sf):
    return spark.createDataFrame([(sinks.to_latex(table(spark, sf, "region").orderBy("r_regionkey"), "Regions"),)], "report string")


# ---- columns


@query("SELECT o_orderkey, CAST(floor(o_totalprice / 50) * 50 AS INTEGER) AS bucket FROM orders")
def op_032_bucket(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.bucket("o_totalprice", 50).alias("bucket"))


@query("SELECT c_custkey, greatest(least(c_acctbal, 5000.0), -100.0) AS clipped FROM customer")
def op_036_clip(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.clip("c_acctbal", -100.0, 5000.0).alias("clipped"))


@query("SELECT p_partkey, contains(lower(p_name), 'part_1') OR contains(lower(p_name), 'part_7') AS marked FROM part")
def op_043_marker(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.has_marker("p_name", ["part_1", "part_7"]).alias("marked"))


#: A preset of OP-045: word beginnings of a letter's addressee or place, in order of rank.
REGIONS = [("anglia|angl|london|cantuar|eborac", "England"), ("scoti|scot", "Scotland"), ("franci|gall|paris|remen|senon|turon", "France"), ("burgund|arelat|vienn", "Burgundy"), ("teuton|aleman|german|colon|magunt|trever", "Empire"), ("hispan|castell|aragon|legion|portugal", "Iberia"), ("sicili|apuli|calabr|neapol", "Sicily"), ("ital|roman|tusc|lombard|mediolan|pisan", "Italy")]


@query("SELECT DISTINCT item_id_telma, CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(destinataire, '') || ' ' || coalesce(transcription, '')), '\\b({p})') THEN '{r}'" for p, r in REGIONS) + " ELSE 'unknown' END AS region FROM aposcripta_dataset")
def op_045_region(spark, sf):
    """Region of a letter by the first of eight patterns that its address or text holds."""
    text = F.lower(F.concat_ws(" ", F.coalesce("destinataire", F.lit("")), F.coalesce("transcription", F.lit(""))))
    rules = [(rf"\b({p})", r) for p, r in REGIONS]
    return table(spark, sf, "aposcripta_dataset").select("item_id_telma", X.ordered_class(text, rules, "unknown").alias("region")).distinct()


@query("SELECT p_partkey, substring(p_name, 1, 7) AS cut, length(p_name) > 7 AS was_cut FROM part")
def op_051_truncate(spark, sf):
    cut, was = S.truncate("p_name", 7)
    return table(spark, sf, "part").select("p_partkey", cut.alias("cut"), was.alias("was_cut"))


@query("SELECT n_nationkey, printf('M%03d', n_nationkey) AS item FROM nation")
def op_060_item_id(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", S.item_id("n_nationkey").alias("item"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def op_062_pick_columns(spark, sf):
    """The first column of each list of names that the table has."""
    c = table(spark, sf, "customer")
    pick = relational.pick_columns(c, {"id": ["id", "person_id", "c_custkey"], "name": ["title", "c_name"]})
    return c.select(*pick)


@query("SELECT c_mktsegment, count(*) AS n, round(avg(CAST(c_acctbal > 0 AS INTEGER)), 6) AS p FROM customer GROUP BY 1")
def op_115_share(spark, sf):
    return r6(table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") > 0).cast("int")).alias("p")))


@query("""WITH t AS (SELECT c_nationkey AS g, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS k FROM customer GROUP BY 1), z AS (SELECT 1.959963984540054 AS z), w AS (SELECT g, k / n::DOUBLE AS p, n, z FROM t, z)
SELECT g, round(p, 6) AS p, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS lo, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS hi FROM w""")
def op_122_wilson(spark, sf):
    t = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k"))
    p, lo, hi = S.wilson("k", "n")
    return r6(t.select("g", p.alias("p"), lo.alias("lo"), hi.alias("hi")))


# ---- filters, joins and sets


@query(f"SELECT id, birth FROM ({_PERSONS}) WHERE birth BETWEEN 1000 AND 1200")
def op_070_between(spark, sf):
    return _persons(spark, sf).where(F.col("birth").between(1000, 1200)).select("id", "birth")


@query(f"SELECT id, birth FROM ({_PERSONS}) WHERE 1000 <= birth AND birth < 1050")
def op_072_half_open(spark, sf):
    return _persons(spark, sf).where("1000 <= birth AND birth < 1050").select("id", "birth")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def op_075_prune(spark, sf):
    out = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return relational.prune(table(spark, sf, "customer"), out, "c_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IS DISTINCT FROM (SELECT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 1)")
def op_076_drop_largest(spark, sf):
    """Everything but the largest level of a column."""
    return relational.drop_levels(table(spark, sf, "customer"), "c_mktsegment").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey % 3 = 1")
def op_077_predicate(spark, sf):
    """A row predicate given as text."""
    return table(spark, sf, "orders").where(F.expr("o_totalprice > 1000 AND o_custkey % 3 = 1")).select("o_orderkey")


@query(f"SELECT id, name FROM ({_PERSONS}) WHERE regexp_matches(name, '\\b(comte|Comte|Graf|Count)\\b')")
def op_079a_name_filter(spark, sf):
    return _persons(spark, sf).where(F.col("name").rlike(r"\b(comte|Comte|Graf|Count)\b")).select("id", "name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def op_081_inner(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return relational.attach(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, on="o_custkey", how="inner").select("o_orderkey", "c_name")


@query("""SELECT n_nationkey, c.n AS customers, s.n AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) c USING (n_nationkey) LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY 1) s USING (n_nationkey)""")
def op_082_fold(spark, sf):
    count = lambda t, c, n: table(spark, sf, t).groupBy(F.col(c).alias("n_nationkey")).agg(F.count("*").alias(n))
    return relational.attach(table(spark, sf, "nation").select("n_nationkey"), count("customer", "c_nationkey", "customers"), count("supplier", "s_nationkey", "suppliers"), on="n_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def op_086_semi(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT DISTINCT parent_id, child_id FROM parent_pairs p WHERE parent_id IS NOT NULL AND child_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spouse_pairs s WHERE s.a = p.parent_id AND s.b = p.child_id)")
def op_087_anti(spark, sf):
    s = table(spark, sf, "spouse_pairs").select(F.col("a").alias("parent_id"), F.col("b").alias("child_id"))
    p = table(spark, sf, "parent_pairs").where("parent_id IS NOT NULL AND child_id IS NOT NULL")
    return relational.closed_set_split(p, s, ["parent_id", "child_id"])[1].distinct()


@query("SELECT spec, era, outcome FROM (VALUES ('S0'), ('S1')) a(spec), (VALUES ('early'), ('late')) b(era), (VALUES ('y'), ('z')) c(outcome)")
def op_095_grid(spark, sf):
    """Specifications by samples by outcomes: three fixed lists."""
    return relational.grid(spark, {"spec": ["S0", "S1"], "era": ["early", "late"], "outcome": ["y", "z"]})


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS orders FROM (SELECT c_custkey % 50 AS k, count(*) AS n FROM customer WHERE c_custkey % 50 < 40 GROUP BY 1) a FULL JOIN (SELECT o_custkey % 50 AS k, count(*) AS n FROM orders WHERE o_custkey % 50 > 10 GROUP BY 1) b ON a.k = b.k""")
def op_096_outer(spark, sf):
    a = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 50).where("k < 40").groupBy("k").agg(F.count("*").alias("customers"))
    b = table(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 50).where("k > 10").groupBy("k").agg(F.count("*").alias("orders"))
    return relational.full_join(a, b, ["k"])


@query("SELECT DISTINCT id, dynasty FROM dynasty_labels WHERE dynasty <> ''")
def op_104_distinct(spark, sf):
    return table(spark, sf, "dynasty_labels").where("dynasty <> ''").select("id", "dynasty").distinct()


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_no FROM orders")
def op_153_sorted(spark, sf):
    return relational.with_row_no(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", (F.col("row_no") + 1).alias("row_no"))


@query("SELECT l_suppkey, max(l_quantity) - min(l_quantity) AS spread, count(*) FILTER (l_discount > 0.05) AS many FROM lineitem GROUP BY 1")
def op_250_group_lambda(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"), F.count_if(F.col("l_discount") > 0.05).alias("many"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS kind FROM customer")
def op_251_row_apply(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "owes").when(F.col("c_acctbal") > 5000, "rich").otherwise("plain").alias("kind"))


@query("""WITH a AS (SELECT DISTINCT doc_id, doc_year FROM doc_matches_ai_extracted_high WHERE doc_year IS NOT NULL AND doc_id IS NOT NULL), p AS (SELECT id, min(birth) AS birth, min(death) AS death FROM persons_imputed GROUP BY 1), l AS (SELECT DISTINCT id FROM dynasty_labels WHERE dynasty <> ''),
c AS (SELECT doc_id, doc_year, id, row_number() OVER (PARTITION BY doc_id, doc_year ORDER BY birth, id) AS r FROM a JOIN p ON birth < doc_year AND death >= doc_year AND birth <= death JOIN l USING (id))
SELECT doc_id, doc_year, string_agg(id, chr(10) ORDER BY r) AS payload FROM c WHERE r <= 20 GROUP BY 1, 2""")
def op_256_candidates(spark, sf):
    """For each letter and year the first 20 labelled persons alive, as lines of a payload (OP-255's input, OP-256)."""
    a = table(spark, sf, "doc_matches_ai_extracted_high").where("doc_year IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "doc_year").distinct()
    p = table(spark, sf, "persons_imputed").groupBy("id").agg(F.min("birth").alias("birth"), F.min("death").alias("death"))
    p = p.join(table(spark, sf, "dynasty_labels").where("dynasty <> ''").select("id").distinct(), "id", "left_semi")
    years = relational.alive_at(a.select("doc_year").distinct(), p, "doc_year")
    top = relational.top_k(years, ["doc_year"], [F.col("birth"), F.col("id")], 20)
    lines = top.groupBy("doc_year").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("c"))  # 20 at most
    payload = lines.select("doc_year", F.array_join(F.transform("c", lambda x: x["id"]), "\n").alias("payload"))
    return a.join(payload, "doc_year").select("doc_id", "doc_year", "payload")


@query("""WITH p AS (SELECT DISTINCT id, trim(name) AS name FROM persons_imputed WHERE id IS NOT NULL), n AS (SELECT name, count(*) AS n, min(id) AS id FROM p GROUP BY 1), i AS (SELECT DISTINCT id FROM p)
SELECT a.id AS anchor_id, dynasty, n.id AS found_id, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.n > 1 THEN 'several' WHEN n.id = a.id THEN 'same' ELSE 'other' END AS status, i.id IS NOT NULL AS id_known FROM dynasty_anchors a LEFT JOIN n ON n.name = trim(a.anchor_name) LEFT JOIN i ON i.id = a.id""")
def op_176_anchors(spark, sf):
    """Each anchor looked up among the persons by its name, and what became of it: the audit relation."""
    p = table(spark, sf, "persons_imputed").where("id IS NOT NULL").select("id", F.trim("name").alias("name")).distinct()
    return relational.locate(table(spark, sf, "dynasty_anchors"), p, "anchor_name").select(F.col("id").alias("anchor_id"), "dynasty", "found_id", "status", "id_known")
