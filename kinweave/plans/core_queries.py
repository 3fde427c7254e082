"""Queries of the core operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import fill, hierarchy
from kinweave.runtime import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf, "parent_pairs"))


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy_paths(table(spark, sf, "parent_pairs"))


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return fill.fill_persons(t("persons_imputed"), t("parent_pairs"), t("spouse_pairs"), t("dynasty_labels"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return fill.filled_cells(_filled(spark, sf)).select("person_id", "field_name")


def p5_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf)


def p5_sources(spark: SparkSession, sf: str) -> DataFrame:
    return fill.filled_cells(_filled(spark, sf)).groupBy("field_name", "source").agg(F.count("*").alias("n"))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p5_found": p5_found, "p5_filled": p5_filled, "p5_sources": p5_sources}

SQL = {
    "p3_paths": """
WITH RECURSIVE l AS (
  SELECT DISTINCT parent_id AS p, child_id AS c FROM parent_pairs
  WHERE parent_id IS NOT NULL AND child_id IS NOT NULL AND parent_id <> '' AND child_id <> ''),
reach AS (SELECT p AS s, c AS t FROM l UNION SELECT reach.s, l.c FROM reach JOIN l ON l.p = reach.t),
cyc AS (SELECT DISTINCT s AS v FROM reach WHERE s = t),
n AS (SELECT p AS v FROM l UNION SELECT c FROM l EXCEPT SELECT v FROM cyc),
u AS (SELECT c AS v, min(p) AS up FROM l WHERE p NOT IN (SELECT v FROM cyc) AND c NOT IN (SELECT v FROM cyc) GROUP BY 1),
a AS (SELECT v, v AS anc FROM n UNION SELECT a.v, u.up FROM a JOIN u ON u.v = a.anc),
z AS (SELECT anc AS v, count(*) AS size FROM a GROUP BY 1),
heavy AS (SELECT max_by(u.v, (size, u.v)) AS v FROM u JOIN z ON z.v = u.v GROUP BY up),
t AS (SELECT v, v AS root, 0 AS depth, v AS path, v AS chain, 0 AS pos FROM n WHERE v NOT IN (SELECT v FROM u)
  UNION ALL SELECT u.v, t.root, t.depth + 1, t.path || '/' || u.v, CASE WHEN h.v IS NOT NULL THEN t.chain ELSE u.v END, CASE WHEN h.v IS NOT NULL THEN t.pos + 1 ELSE 0 END
  FROM t JOIN u ON u.up = t.v LEFT JOIN heavy h ON h.v = u.v)
SELECT t.v AS person_id, root AS root_id, depth, path, size - 1 AS n_descendants, chain AS chain_id, pos AS chain_pos FROM t JOIN z ON z.v = t.v
UNION ALL SELECT v, 'cycle', -1, NULL, NULL, NULL, NULL FROM cyc""",
    "p3_found": """
WITH RECURSIVE l AS (
  SELECT DISTINCT parent_id AS p, child_id AS c FROM parent_pairs
  WHERE parent_id IS NOT NULL AND child_id IS NOT NULL AND parent_id <> '' AND child_id <> ''),
reach AS (SELECT p AS s, c AS t FROM l UNION SELECT reach.s, l.c FROM reach JOIN l ON l.p = reach.t),
cyc AS (SELECT DISTINCT s AS v FROM reach WHERE s = t),
roots AS (SELECT DISTINCT p AS r FROM l WHERE p NOT IN (SELECT c FROM l)),
walk AS (SELECT r, r AS v, 0 AS d FROM roots UNION SELECT walk.r, l.c, walk.d + 1 FROM walk JOIN l ON l.p = walk.v WHERE walk.d < (SELECT count(DISTINCT c) FROM l))
SELECT v AS person_id, r AS root_id, CAST(min(d) AS INTEGER) AS depth FROM walk WHERE v NOT IN (SELECT v FROM cyc) GROUP BY v, r
UNION ALL SELECT v, 'cycle', -1 FROM cyc""",
    "p5_found": """
WITH p AS (SELECT id, min(birth) AS birth, min(death) AS death, min(birth_imputed) AS bi, min(death_imputed) AS di FROM persons_imputed WHERE id IS NOT NULL GROUP BY id)
SELECT id AS person_id, 'birth' AS field_name FROM p WHERE birth IS NULL OR birth NOT BETWEEN 700 AND 1600
UNION ALL SELECT id, 'death' FROM p WHERE death IS NULL OR death NOT BETWEEN 700 AND 1600
UNION ALL SELECT id, 'birth_imputed' FROM p WHERE bi IS NULL OR bi NOT IN (0, 1)
UNION ALL SELECT id, 'death_imputed' FROM p WHERE di IS NULL OR di NOT IN (0, 1)""",
}
