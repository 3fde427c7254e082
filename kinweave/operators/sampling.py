"""Reproducible samples: rows are ranked by a hash of seed and key, the same in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mark(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_ids(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n keys, the smallest marks (OP-240): a top-n, each partition keeps n at most."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(mark(key, seed), key).limit(n)


def _first(df: DataFrame, stratum: str, key: str, k: Column | int, seed: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy(stratum).orderBy(mark(key, seed), key))
    return df.withColumn("__r", r).where(F.col("__r") <= k)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows in equal parts per stratum, the remainder to the first strata in order, gaps of small strata filled from
    the others by mark; shuffled by mark (OP-241). Rows of a NULL stratum form one too."""
    d = df.withColumn("__s", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    strata = d.groupBy("__s").agg(F.count("*").alias("__n"))
    m = strata.count()
    if not m:
        return df
    quota = strata.withColumn("__q", F.lit(n // m) + (F.row_number().over(W.orderBy("__s")) <= n % m).cast("int")).select("__s", "__q")  # one row per stratum
    ranked = d.join(F.broadcast(quota), "__s").withColumn("__r", F.row_number().over(W.partitionBy("__s").orderBy(mark(key, seed), key))).where(F.col("__r") <= n)
    chosen = ranked.withColumn("__in", (F.col("__r") <= F.col("__q")).cast("int"))
    return chosen.orderBy(F.col("__in").desc(), mark(key, seed), key).limit(n).select(*df.columns)


def disjoint_sample(df: DataFrame, excluded: DataFrame, on: list[str], stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """A stratified sample without the keys of an earlier one (OP-242)."""
    return stratified_sample(df.join(excluded.select(*on).distinct(), on, "left_anti"), stratum, key, n, seed)


def per_class_sample(df: DataFrame, cls: str, key: str, k: int, seed: int, blind: list[str]) -> tuple[DataFrame, DataFrame]:
    """k rows of each class, shuffled and numbered M001...; the items without the blinded columns, and the key (OP-243)."""
    picked = _first(df.where(F.col(cls).isNotNull()), cls, key, k, seed).drop("__r")
    numbered = picked.withColumn("item_id", F.format_string("M%03d", F.row_number().over(W.orderBy(mark(key, seed + 1), key))))  # k rows per class
    return numbered.drop(*blind), numbered.select("item_id", key, cls)
