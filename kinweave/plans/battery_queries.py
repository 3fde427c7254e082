"""The estimation frame over the persons of the project, and the batteries fitted on it, with their SQL.

The SQL of a coefficient demeans by the factor and takes the controls out one after the other, which is the same
projection as the operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import community, econ, graph, relational
from kinweave.operators.battery import Spec, battery, control_string
from kinweave.operators.components import connected_components
from kinweave.plans.graph_queries import BALL, KIN, Kin, ball
from kinweave.plans.relational_queries import r6
from kinweave.runtime import checkpoint, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
LO, HI = 1100, 1300  # the window of letters
UNIVERSE = "birth <= 1350 AND death >= 1050"  # whom letters are matched with
SAMPLE = f"sex = 'M' AND birth IS NOT NULL AND death IS NOT NULL AND birth <= {HI} AND death >= {LO}"
CODE = "regexp_replace(lower(trim(domain)), '[^a-z]+', '_'{g})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the frame


def _people(spark, sf: str, k: Kin) -> DataFrame:
    """Persons with label, letters and whether letters could be matched with them."""
    codes = table(spark, sf, "matched_docs_coded").where("domain IS NOT NULL").groupBy("doc_id").agg(F.min(F.expr(CODE.format(g=""))).alias("code"))
    found = table(spark, sf, "doc_matches_ai_extracted_high").where(F.col("doc_year").between(LO, HI) & F.col("person_id").isNotNull()).select("match_id", "doc_id", "person_id").distinct()
    docs = found.join(codes, "doc_id", "left").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("match_id").alias("n"), F.count_distinct(F.when(F.col("code") == "secular_territorial", F.col("match_id"))).alias("n_secular"))
    people = k.persons.join(k.labels, "id", "left").join(docs, "id", "left").withColumn("y", F.log1p(F.coalesce("n", F.lit(0)))).withColumn("matchable", F.coalesce(F.expr(f"label IS NOT NULL AND {UNIVERSE}"), F.lit(False)))
    return checkpoint(people)


def frame(spark, sf: str) -> DataFrame:
    """One row per labelled, dated man whose life meets the window and whose mother's reach is known (OP-079b): own and
    ancestors' reach and size in the gated neighbourhood of four links, bands, peers, letters by subject, dates."""
    k = Kin(spark, sf)
    around = ball(k, 4)
    people = _people(spark, sf, k)
    nodes = around.select("seed", "node", "depth").join(people.select(F.col("id").alias("node"), "label", "y", "matchable"), "node")
    near, peer = F.col("depth").between(1, 2), F.col("depth") >= 1
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    about = nodes.groupBy(F.col("seed").alias("id")).agg(
        F.count_distinct("label").cast("double").alias("reach"), F.log1p(F.count_if(peer)).alias("size"), F.log1p(F.count_if(near)).alias("near"), F.log1p(F.count_if(peer & ~near)).alias("far"),
        zero(F.avg(F.when(peer, F.col("y")))).alias("zb"), zero(F.avg(F.when(peer & F.col("matchable"), F.col("y")))).alias("zd"), zero(F.avg(F.when(peer, F.col("matchable").cast("int")))).alias("share"),
        F.count_if(peer & F.col("matchable")).alias("n_matchable"),
        zero(F.avg(F.when(near, F.col("y")))).alias("z12"), zero(F.avg(F.when(F.col("depth").between(2, 4), F.col("y")))).alias("z24"), zero(F.avg(F.when(F.col("depth").between(3, 4), F.col("y")))).alias("z34"), F.sum(F.when(peer, F.col("y")).otherwise(0.0)).alias("zsum"), F.sum(F.when(peer, F.col("y") * F.pow(F.lit(2.0), -F.col("depth"))).otherwise(0.0)).alias("zw"),
    )
    about = checkpoint(about)
    of = lambda who: about.select(F.col("id").alias(f"{who}_id"), F.col("reach").alias(f"{who}_reach"), F.col("size").alias(f"{who}_size"))
    letters = lambda who: people.select(F.col("id").alias(f"{who}_id"), F.col("y").alias(f"{who}_docs"))
    fathers = k.kin.where("father_id IS NOT NULL").select(F.col("father_id").alias("a"), F.col("child_id").alias("b"))
    line = connected_components(fathers).select(F.col("node").alias("id"), F.col("component").alias("line"))
    d = people.where(SAMPLE).where("label IS NOT NULL").join(k.kin.withColumnRenamed("child_id", "id"), "id").join(about, "id").join(of("mother"), "mother_id").join(of("father"), "father_id", "left").join(of("mgf"), "mgf_id", "left")
    for who in ("mother", "father", "mgf"):
        d = d.join(letters(who), f"{who}_id", "left")
    d = d.join(line, "id", "left")
    fill = [f"{who}_{c}" for who in ("mother", "father", "mgf") for c in ("reach", "size", "docs")]
    num = lambda c: F.floor(F.col(c) / 10).cast("double")
    d = d.select(
        "id", "label", F.coalesce("line", "id").alias("line"), F.coalesce("mgf_id", "id").alias("mgf"), "mother_id",
        "y", F.log1p(F.coalesce("n_secular", F.lit(0))).alias("y_secular"), (F.coalesce("n", F.lit(0)) > 0).cast("double").alias("any"),
        "reach", "size", "near", "far", "zb", "zd", "share", "z12", "z24", "z34", "zsum", "zw", "n_matchable", *[zero(F.col(c)).alias(c) for c in fill],
        num("birth").alias("birth_dec"), num("death").alias("death_dec"), num("birth").cast("string").alias("birth_fe"), num("death").cast("string").alias("death_fe"),
        (F.least("death", F.lit(HI)) - F.greatest("birth", F.lit(LO)) + 1).cast("double").alias("years"), "birth", "death", (F.col("birth") < 1200).cast("int").alias("early"),
    )
    return checkpoint(d)


FRAME = KIN + BALL + f""",
CD AS (SELECT doc_id, min({CODE.format(g=", 'g'")}) AS code FROM matched_docs_coded WHERE domain IS NOT NULL GROUP BY 1),
DC AS (SELECT person_id AS id, count(DISTINCT match_id) AS n, count(DISTINCT CASE WHEN code = 'secular_territorial' THEN match_id END) AS n_secular FROM doc_matches_ai_extracted_high LEFT JOIN CD USING (doc_id) WHERE doc_year BETWEEN {LO} AND {HI} AND person_id IS NOT NULL GROUP BY 1),
PE AS MATERIALIZED (SELECT P.*, label, n, n_secular, ln(1 + coalesce(n, 0)) AS y, coalesce(label IS NOT NULL AND {UNIVERSE}, false) AS matchable FROM P LEFT JOIN L USING (id) LEFT JOIN DC USING (id)),
RB AS MATERIALIZED (SELECT seed AS id, CAST(count(DISTINCT label) AS DOUBLE) AS reach, ln(1 + count(*) FILTER (d >= 1)) AS size, ln(1 + count(*) FILTER (d BETWEEN 1 AND 2)) AS near, ln(1 + count(*) FILTER (d >= 3)) AS far,
 coalesce(avg(y) FILTER (d >= 1), 0) AS zb, coalesce(avg(y) FILTER (d >= 1 AND matchable), 0) AS zd, coalesce(avg(CAST(matchable AS INTEGER)) FILTER (d >= 1), 0) AS share, count(*) FILTER (d >= 1 AND matchable) AS n_matchable,
 coalesce(avg(y) FILTER (d BETWEEN 1 AND 2), 0) AS z12, coalesce(avg(y) FILTER (d BETWEEN 2 AND 4), 0) AS z24, coalesce(avg(y) FILTER (d BETWEEN 3 AND 4), 0) AS z34, coalesce(sum(y) FILTER (d >= 1), 0) AS zsum, coalesce(sum(y * pow(2.0, -d)) FILTER (d >= 1), 0) AS zw
 FROM B JOIN PE ON PE.id = node GROUP BY 1),
FE AS (SELECT father_id AS a, child_id AS b FROM KIN WHERE father_id IS NOT NULL UNION SELECT child_id, father_id FROM KIN WHERE father_id IS NOT NULL),
CL AS (SELECT a, a AS b FROM FE UNION SELECT CL.a, FE.b FROM CL JOIN FE ON FE.a = CL.b), LN AS (SELECT a AS id, min(b) AS line FROM CL GROUP BY 1),
FR AS MATERIALIZED (SELECT p.id, p.label, coalesce(line, p.id) AS line, coalesce(mgf_id, p.id) AS mgf, mother_id, p.y, ln(1 + coalesce(p.n_secular, 0)) AS y_secular, CAST(coalesce(p.n, 0) > 0 AS DOUBLE) AS "any",
 r.reach, r.size, r.near, r.far, r.zb, r.zd, r.share, r.z12, r.z24, r.z34, r.zsum, r.zw, r.n_matchable,
 m.reach AS mother_reach, m.size AS mother_size, coalesce(mp.y, 0) AS mother_docs, coalesce(f.reach, 0) AS father_reach, coalesce(f.size, 0) AS father_size, coalesce(fp.y, 0) AS father_docs, coalesce(g.reach, 0) AS mgf_reach, coalesce(g.size, 0) AS mgf_size, coalesce(gp.y, 0) AS mgf_docs,
 floor(p.birth / 10.0) AS birth_dec, floor(p.death / 10.0) AS death_dec, floor(p.birth / 10.0) AS birth_fe, floor(p.death / 10.0) AS death_fe, least(p.death, {HI}) - greatest(p.birth, {LO}) + 1 AS years, p.birth, p.death, CAST(p.birth < 1200 AS INTEGER) AS early
 FROM PE p JOIN KIN ON child_id = p.id JOIN RB r ON r.id = p.id JOIN RB m ON m.id = mother_id LEFT JOIN RB f ON f.id = father_id LEFT JOIN RB g ON g.id = mgf_id
 LEFT JOIN PE mp ON mp.id = mother_id LEFT JOIN PE fp ON fp.id = father_id LEFT JOIN PE gp ON gp.id = mgf_id LEFT JOIN LN ON LN.id = p.id WHERE p.label IS NOT NULL AND {SAMPLE.replace("sex", "p.sex").replace("birth", "p.birth").replace("death", "p.death")})"""


def _left_sql(i: int, s: Spec) -> tuple[str, str, int]:
    """CTEs that leave y, x, z without factor and controls; the name of the last one, and how many controls there are."""
    fe = s.factors[0] if s.factors else "1"
    dm = lambda c, a: f"{c} - avg({c}) OVER (PARTITION BY {fe}) AS {a}"
    cs = [f"c{j}" for j in range(len(s.controls))]
    out = f", Q{i}_0 AS MATERIALIZED (SELECT {fe} AS fe, {s.cluster} AS g, {dm(s.y, 'y')}, {dm(s.term, 'x')}, {dm(s.instrument or s.term, 'z')}{''.join(', ' + dm(c, a) for c, a in zip(s.controls, cs, strict=True))}, 0 AS r FROM FR WHERE {s.sample})"
    for j, c in enumerate(cs):
        b = lambda a, c=c: f"{a} - {c} * CASE WHEN sum({c} * {c}) OVER () > 1e-6 THEN sum({a} * {c}) OVER () / sum({c} * {c}) OVER () ELSE 0 END AS {a}"
        out += f", Q{i}_{j + 1} AS MATERIALIZED (SELECT fe, g, {', '.join(b(a) for a in ('y', 'x', 'z', *cs[j + 1 :]))}, r + CASE WHEN sum({c} * {c}) OVER () > 1e-6 THEN 1 ELSE 0 END AS r FROM Q{i}_{j})"
    return out, f"Q{i}_{len(cs)}", len(cs)


def battery_sql(specs: list[Spec]) -> str:
    ctes, rows = "", []
    for i, s in enumerate(specs):
        own, last, _ = _left_sql(i, s)
        ctes += own + f", V{i} AS (SELECT CASE WHEN abs(sum(z * x)) > 1e-6 AND count(*) - (count(DISTINCT fe) + coalesce(max(r), 0) + 1) >= 2 THEN sum(z * y) / sum(z * x) END AS b, sum(z * x) AS w, count(*) AS n, count(DISTINCT fe) + coalesce(max(r), 0) + 1 AS k FROM {last}), U{i} AS (SELECT g, sum(z * (y - b * x)) / any_value(w) AS v FROM {last}, V{i} WHERE b IS NOT NULL GROUP BY 1), T{i} AS (SELECT count(*) AS g, sum(v * v) AS q FROM U{i})"
        rows.append(f"SELECT '{s.name}' AS spec, '{s.term}' AS term, round(b, 6) AS beta, CASE WHEN g > 1 AND n > k THEN round(sqrt(q * g / (g - 1.0) * (n - 1.0) / (n - k)), 6) END AS se, n, CASE WHEN b IS NOT NULL THEN g END AS clusters FROM V{i}, T{i}")
    return FRAME + ctes + "\n" + "\nUNION ALL ".join(rows)


def _register(name: str, doc: str, specs: list[Spec]) -> None:
    def run(spark, sf):
        return r6(battery(frame(spark, sf), specs))

    run.__name__, run.__doc__ = name, doc
    query(battery_sql(specs))(run)


ANC = ("mother_size", "father_size", "mgf_size", "mother_docs", "father_docs", "mgf_docs", "mgf_reach")
BASE = (*ANC, "death_dec")
HOUSE = ("label",)
ERAS = {"all": "true", "early": "early = 1", "late": "early = 0"}
OUTCOMES = ("y", "y_secular")


def _grid(specs: dict[str, dict], eras: tuple[str, ...] = ("all", "early", "late"), outcomes: tuple[str, ...] = OUTCOMES) -> list[Spec]:
    """Every specification for every era and outcome."""
    out = []
    for e in eras:
        for y in outcomes:
            for name, s in specs.items():
                own = {"factors": HOUSE, "controls": BASE} | s
                sample = " AND ".join(x for x in (ERAS[e], own.pop("sample", "true")) if x != "true") or "true"
                out.append(Spec(f"{name}|{e}|{y}", own.pop("y", y), sample=sample, **own))
    return out


IV = {"term": "reach", "instrument": "mother_reach"}
_register("op_220_spec_grid", "Specifications S0 to S4 by outcome and era (OP-220): bare, house, dates, ancestors, all.", _grid({
    "S0": {"term": "zb", "controls": (), "factors": ()}, "S1": {"term": "zb", "controls": ()}, "S2": {"term": "zb", "controls": ("death_dec",)},
    "S3": {"term": "zb"}, "S4": {"term": "zb", "controls": ("reach", *BASE)},
}))
_register("op_221_censoring", "Peers' letters where some peers can have none (OP-221): matchable peers only, and the share of them as a control.", _grid({
    "C1": {"term": "zd", "controls": ("reach", *BASE), "sample": "n_matchable > 0"}, "C2": {"term": "zb", "controls": ("share", "reach", *BASE)}, "C3": {"term": "zd", "controls": ("share", "reach", *BASE)},
}))
_register("op_222_break_sweep", "Both sides of five cuts of the year of birth, a gap of ten years left out, and the sample without the middle (OP-222).", [
    Spec(f"{c}|{side}", "y", "zb", ("reach", *BASE), HOUSE, sample=f"birth {'<' if side == 'before' else '>'} {c + (-10 if side == 'before' else 10)}") for c in (1120, 1160, 1200, 1240, 1280) for side in ("before", "after")
] + [Spec("donut", "y", "zb", ("reach", *BASE), HOUSE, sample="birth NOT BETWEEN 1180 AND 1220")])
_register("op_223_band_battery", "Peers of the near and the far band against each other, fourteen gates by era and outcome (OP-223).", _grid({
    "near": {"term": "z12", "controls": ("z34", "reach", *BASE)}, "far": {"term": "z34", "controls": ("z12", "reach", *BASE)}, "size": {"term": "z34", "controls": ("z12", "reach", "near", "far", *BASE)},
    "family": {"term": "z34", "controls": ("z12", "reach", "mother_reach", "father_reach", *BASE)}, "share": {"term": "z34", "controls": ("z12", "reach", "share", *BASE)}, "matchable": {"term": "z34", "controls": ("z12", "reach", *BASE), "sample": "n_matchable > 0"},
    "band 2-4": {"term": "z24", "controls": ("z12", "reach", *BASE)}, "weighted": {"term": "zw", "controls": ("reach", *BASE)}, "sum": {"term": "zsum", "controls": ("reach", *BASE)}, "sum and size": {"term": "zsum", "controls": ("reach", "size", *BASE)},
    "exposure": {"term": "z34", "controls": ("z12", "reach", "years", *BASE)}, "no reach": {"term": "z34", "controls": ("z12", *BASE)}, "no house": {"term": "z34", "controls": ("z12", "reach", *BASE), "factors": ()}, "fathers known": {"term": "z34", "controls": ("z12", "reach", *BASE), "sample": "father_size > 0"},
}, ("early", "late")))
_register("op_224_control_variants", "Instrumented reach with exposure, with a control that the reach itself moves, with ambient peers, and for persons with letters only (OP-224).", _grid({
    "headline": IV, "exposure": IV | {"controls": ("years", *BASE)}, "bad control": IV | {"controls": ("size", *BASE)}, "ambient": IV | {"controls": ("zb", *BASE)}, "ambient both": IV | {"controls": ("zb", "zd", *BASE)}, "principals": IV | {"sample": "y > 0"},
}))
_register("op_225_fe_variants", "Fixed effects and clusters exchanged: decades of birth, male lines (OP-225).", [
    Spec(f"{v}|{e}|{t}", "y", t, controls, factors, cluster, sample=ERAS[e]) for e in ("early", "late") for t in ("zb", "zd")
    for v, controls, factors, cluster in (("V0", BASE, HOUSE, "label"), ("V1", (*ANC, "birth_dec"), HOUSE, "label"), ("V1 factor", ANC, ("birth_fe",), "label"), ("V2", BASE, ("line",), "line"), ("V3", BASE, HOUSE, "line"))
])
_register("op_226_reverse_form", "Reach on an ancestor's letters, and on whether there are any, with and without the other ancestors' (OP-226).", [
    Spec(f"{who}|{kind}|{rung}", "reach", f"{who}_docs", tuple(c for c in BASE if c != f"{who}_docs" and (rung == "full" or not c.endswith("_docs"))), HOUSE, sample="true" if kind == "all" else f"{who}_docs > 0") for who in ("father", "mother", "mgf") for kind in ("all", "with letters") for rung in ("full", "alone")
])
_register("op_227_bin_gates", "Instrumented reach within bins of the mother's house, through gates (OP-227).", [
    Spec(f"{b}|{g}", "y_secular", "reach", controls, HOUSE, instrument="mother_reach", sample=sample) for b, sample in (("known grandfather", "mgf_reach > 0"), ("no grandfather", "mgf_reach = 0"))
    for g, controls in (("baseline", BASE), ("family", ("father_reach", *BASE)), ("size", ("size", "early", *BASE)))
])
_register("op_228_split_sample", "Instrumented reach inside and outside a group, gates and other clusters (OP-228).", [
    Spec(f"{g}|{v}", y, "reach", controls, HOUSE, cluster, "mother_reach", sample) for g, sample in (("in", "share >= 0.5"), ("out", "share < 0.5"))
    for v, y, controls, cluster in (("base", "y", BASE, "label"), ("secular", "y_secular", BASE, "label"), ("family", "y", ("father_reach", *BASE), "label"), ("size", "y", ("size", "early", *BASE), "label"), ("by mother", "y", BASE, "mother_id"), ("by grandfather", "y", BASE, "mgf"))
])


# ---- two instrumented terms, samples, leverage


INTER = FRAME + f""", D AS (SELECT *, reach * early AS reach_early, mother_reach * early AS mother_early FROM FR),
Q0 AS MATERIALIZED (SELECT {', '.join(f'{c} - avg({c}) OVER (PARTITION BY label) AS {c}' for c in ('y', 'reach', 'reach_early', 'mother_reach', 'mother_early', 'early', *BASE))} FROM D)"""
for _j, _c in enumerate(("early", *BASE)):
    _rest = ("y", "reach", "reach_early", "mother_reach", "mother_early", *("early", *BASE)[_j + 1 :])
    INTER += f", Q{_j + 1} AS MATERIALIZED (SELECT {', '.join(f'{a} - {_c} * CASE WHEN sum({_c} * {_c}) OVER () > 1e-6 THEN sum({a} * {_c}) OVER () / sum({_c} * {_c}) OVER () ELSE 0 END AS {a}' for a in _rest)} FROM Q{_j})"
INTER += f""", S AS (SELECT sum(mother_reach * reach) AS a, sum(mother_reach * reach_early) AS b, sum(mother_early * reach) AS c, sum(mother_early * reach_early) AS d, sum(mother_reach * y) AS e, sum(mother_early * y) AS f, count(*) AS n FROM Q{len(BASE) + 1})
SELECT 'reach' AS term, round((d * e - b * f) / (a * d - b * c), 5) AS beta, n FROM S UNION ALL SELECT 'reach_early', round((a * f - c * e) / (a * d - b * c), 5), n FROM S"""


def _demeaned(d: DataFrame, cols: list[str], factor: str) -> DataFrame:
    """Complete rows of d with the columns less their means over a factor of any number of levels."""
    own = econ.complete(d, [*cols, factor]).select("id", factor, *cols)
    return econ.within(own, cols, [factor]).select("id", factor, *[F.col(c + "_dm").alias(c) for c in cols])


@query(INTER)
def op_227_interaction(spark, sf):
    """Instrumented reach and its product with the era, with both instruments (OP-204, OP-227)."""
    d = frame(spark, sf).withColumn("reach_early", F.col("reach") * F.col("early")).withColumn("mother_early", F.col("mother_reach") * F.col("early"))
    # houses are absorbed: a column of the design for each would make cross-products that grow with their square
    d = _demeaned(d, ["y", "reach", "reach_early", "mother_reach", "mother_early", "early", *BASE], "label")
    f = econ.iv(d, "y", ["reach", "reach_early"], ["mother_reach", "mother_early"], ["early", *BASE])
    return spark.createDataFrame([(t, round(float(f.row(t)["beta"]), 5), f.n) for t in ("reach", "reach_early")], "term string, beta double, n long")


@query(FRAME + " SELECT id, label, line, mother_id, early FROM FR")
def op_079b_estimation_sample(spark, sf):
    return frame(spark, sf).select("id", "label", "line", "mother_id", "early")


@query(KIN + f" SELECT id, label FROM P JOIN L USING (id) WHERE {UNIVERSE}")
def op_079c_matching_universe(spark, sf):
    k = Kin(spark, sf)
    return k.persons.join(k.labels, "id").where(UNIVERSE).select("id", "label")


_VARIANTS = {"plain": {}, "papacy, level": {"time": "papacy", "father": "level"}, "split, six links": {"hop": 6, "documents": "split"}, "own, no house": {"own_size": True, "own_visibility": True, "house": False, "father": "none"}}
_STRINGS = {
    "plain": "title_rank + death_decade + log_degree + mother_title_rank + mother_log_size_4 + mother_log_documents + mother_log_degree + father_title_rank + father_log_size_4 + father_log_documents + father_log_degree + mgf_title_rank + mgf_log_size_4 + mgf_log_documents + mgf_log_degree + father_extra_4 + mgf_reach_4 + house",
    "papacy, level": "title_rank + papacy + log_degree + mother_title_rank + mother_log_size_4 + mother_log_documents + mother_log_degree + father_title_rank + father_log_size_4 + father_log_documents + father_log_degree + mgf_title_rank + mgf_log_size_4 + mgf_log_documents + mgf_log_degree + father_reach_4 + mgf_reach_4 + house",
    "split, six links": "title_rank + death_decade + log_degree + mother_title_rank + mother_log_size_6 + mother_log_disputes + mother_log_others + mother_log_degree + father_title_rank + father_log_size_6 + father_log_disputes + father_log_others + father_log_degree + mgf_title_rank + mgf_log_size_6 + mgf_log_disputes + mgf_log_others + mgf_log_degree + father_extra_6 + mgf_reach_6 + house",
    "own, no house": "title_rank + death_decade + log_degree + own_log_size_4 + own_log_visibility + mother_title_rank + mother_log_size_4 + mother_log_documents + mother_log_degree + father_title_rank + father_log_size_4 + father_log_documents + father_log_degree + mgf_title_rank + mgf_log_size_4 + mgf_log_documents + mgf_log_degree + mgf_reach_4",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _STRINGS.items()) + ") t(variant, rhs)")
def op_210_control_string(spark, sf):
    return spark.createDataFrame([(v, control_string(**s)) for v, s in _VARIANTS.items()], "variant string, rhs string")


_LEV = Spec("lev", "y", "reach", BASE, HOUSE, instrument="mother_reach")


@query(FRAME + _left_sql(0, _LEV)[0] + f" SELECT g AS label, round(sum(z * z) / (SELECT sum(z * z) FROM {_left_sql(0, _LEV)[1]}), 6) AS share FROM {_left_sql(0, _LEV)[1]} GROUP BY 1")
def op_230_leverage(spark, sf):
    """Each house's share of the squared instrument that is left after factor and controls (OP-230)."""
    res = econ.residualize(_demeaned(frame(spark, sf), ["mother_reach", *BASE], "label"), ["mother_reach"], list(BASE), [])
    per = res.groupBy("label").agg(F.sum(F.col("mother_reach_res") * F.col("mother_reach_res")).alias("v"))
    return r6(per.crossJoin(per.agg(F.sum("v").alias("t"))).select("label", (F.col("v") / F.col("t")).alias("share")))  # one row


ANCESTORS = ("mother", "father", "mgf")


def _reach_by_draw(met: DataFrame, part: DataFrame, seeds: list[int]) -> DataFrame:
    """(draw, seed, reach): how many communities each seed's neighbourhood meets, from the houses (seed, label) in it."""
    drawn = met.where("label IS NOT NULL").select("seed", "label", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("draw")).join(part, ["draw", "label"], "left")
    return drawn.groupBy("draw", "seed").agg(F.count_distinct(F.coalesce("community", "label")).cast("double").alias("reach"))


def drawn_frame(spark, sf: str, k: Kin, part: DataFrame, seeds: list[int]) -> DataFrame:
    """The rows of frame for each draw, houses merged by part (draw, label, community), with the columns of the headline.

    Neighbourhoods, letters and sizes don't depend on the draw; they are made once, for the men and their ancestors."""
    people = _people(spark, sf, k)
    dated = people.where("birth IS NOT NULL").select(F.col("id").alias("mother_id"))
    men = checkpoint(people.where(SAMPLE).where("label IS NOT NULL").select("id", "label", "y", F.floor(F.col("death") / 10).cast("double").alias("death_dec")).join(k.kin.withColumnRenamed("child_id", "id"), "id").join(dated, "mother_id", "left_semi"))
    used = men.select(F.explode(F.array("id", *[f"{who}_id" for who in ANCESTORS])).alias("id")).distinct()
    starts = k.persons.where("birth IS NOT NULL").join(used, "id", "left_semi")
    around = graph.gated_ball(graph.plain_seeds(starts, "id", F.col("birth")), k.adj, k.births, 4)
    met = checkpoint(around.join(k.labels.withColumnRenamed("id", "node"), "node", "left").groupBy("seed", "label").agg(F.count_if(F.col("depth") >= 1).alias("n")))
    sizes = checkpoint(met.groupBy("seed").agg(F.log1p(F.sum("n")).alias("size")))
    reach = checkpoint(_reach_by_draw(met, part, seeds))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for who in ANCESTORS:
        own = sizes.join(people.select(F.col("id").alias("seed"), F.col("y").alias("docs")), "seed", "full").select(F.col("seed").alias(f"{who}_id"), F.col("size").alias(f"{who}_size"), F.col("docs").alias(f"{who}_docs"))
        men = relational.spread_left_join(men, own, [f"{who}_id"], "id")
    d = men.withColumn("draw", F.explode(F.array(*[F.lit(s) for s in seeds]))).join(part, ["draw", "label"], "left").withColumn("label", F.coalesce("community", "label"))
    d = d.join(reach.withColumnRenamed("seed", "id"), ["draw", "id"], "left")
    for who in ANCESTORS:
        d = relational.spread_left_join(d, reach.select("draw", F.col("seed").alias(f"{who}_id"), F.col("reach").alias(f"{who}_reach")), ["draw", f"{who}_id"], "id")
    fill = ["reach", *[f"{who}_{c}" for who in ANCESTORS for c in ("reach", "size", "docs")]]
    return checkpoint(d.select("draw", "id", "label", "y", "death_dec", *[zero(F.col(c)).alias(c) for c in fill]))


@query()
def op_231_seed_sweep(spark, sf, seeds: int = 3):
    """Houses merged into communities drawn anew for each seed, features rebuilt with them, the headline refitted (OP-231)."""
    k, draws = Kin(spark, sf), list(range(seeds))
    drawn = community.louvain_draws(graph.quotient_graph(k.spouses, k.labels), draws)
    part = checkpoint(drawn.select("draw", F.col("id").alias("label"), F.col("label").alias("community")))
    fit = battery(drawn_frame(spark, sf, k, part, draws), [Spec(f"seed {s}", "y", "reach", BASE, HOUSE, instrument="mother_reach", sample=f"draw = {s}") for s in draws])
    # houses that married no other stay as they are
    gone = part.groupBy("draw").agg((F.count("*") - F.count_distinct("community")).alias("gone")).select(F.concat(F.lit("seed "), "draw").alias("spec"), "gone")
    fit = fit.join(gone, "spec", "left").crossJoin(k.labels.agg(F.count_distinct("label").alias("houses")))  # one row
    return r6(fit.select("spec", "term", "beta", "se", "n", "clusters", (F.col("houses") - F.coalesce("gone", F.lit(0))).alias("n_labels")))
