"""Queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import garble, linkage, lookalike, mixing, people, split, subjects, tokens, variants
from kinweave.runtime import table


def _values(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "persons_imputed").select(F.lit("name").alias("field_name"), F.col("id").alias("record_key"), F.col("name").alias("value"))
    letters = table(spark, sf, "aposcripta_dataset").select(F.lit("transcription").alias("field_name"), F.col("item_id_telma").alias("record_key"), F.col("transcription").alias("value"))
    return names.union(letters)


def p1_links(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.link(table(spark, sf, "doc_matches_ai_extracted_high"), table(spark, sf, "persons_imputed"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_links(spark, sf).where("accepted").select("match_id", "person_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_pairs(table(spark, sf, "persons_imputed"), table(spark, sf, "doc_matches_ai_extracted_high"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return variants.variant_persons(people.prepare(table(spark, sf, "persons_imputed"), table(spark, sf, "doc_matches_ai_extracted_high")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.found_records(_values(spark, sf))


def p4_unified(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.unify(_values(spark, sf))


def p6_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.assign(table(spark, sf, "aposcripta_dataset"), table(spark, sf, "matched_docs_coded"), table(spark, sf, "subject_areas"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_subjects(spark, sf).select("item_id_telma", "subject")


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    letters = table(spark, sf, "aposcripta_dataset")
    parts = [split.split_oversized(letters, "item_id_telma", f, limit, overlap).withColumn("field_name", F.lit(f)) for f, limit, overlap in (("transcription", 4000, 200), ("regeste", 1000, 80))]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pieces(spark, sf).where("piece_no = 1").select("item_id_telma", "field_name").distinct()


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ids = tokens.encode(table(spark, sf, "documents").select("doc_id", "text"))
    return tokens.decode(ids, into="back").select("doc_id", F.size("ids").alias("n_tokens"), F.coalesce(F.col("back") == F.coalesce("text", F.lit("")), F.lit(False)).alias("exact"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p10_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return garble.repair(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return garble.repair(table(spark, sf, "documents"), restore=False).where("garbled").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_groups, p4_found, p4_unified, p6_found, p6_subjects, p7_found, p7_pieces, p8_ids, p8_roundtrip, p9_mix, p9_report, p10_found, p10_repaired)}

SQL: dict[str, str] = {
    "p7_found": """
SELECT DISTINCT item_id_telma, 'transcription' AS field_name FROM aposcripta_dataset WHERE length(transcription) > 4000
UNION ALL SELECT DISTINCT item_id_telma, 'regeste' FROM aposcripta_dataset WHERE length(regeste) > 1000""",
}
