"""Sources: explicit schemas everywhere, nothing is inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8", header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a given schema; gzip by its suffix, quoted line breaks, fields of any length (OP-001 to OP-005, OP-009)."""
    return spark.read.schema(schema).options(header=header, sep=sep, encoding=encoding, multiLine=True, maxCharsPerColumn="-1", quote='"', escape='"', enforceSchema=True).csv(path)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, empty text for empty fields (OP-001)."""
    df = read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]), encoding)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def strip_bom(df: DataFrame) -> DataFrame:
    """A byte order mark taken off the first column's name (OP-005)."""
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def read_json_items(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """Members of an array field of whole-document JSON files (OP-006). item: schema of a member."""
    doc = spark.read.schema(f"{field} array<{item}>").option("multiLine", True).json(path)
    return doc.select(F.explode(field).alias("x")).select("x.*")


def read_json_files(spark: SparkSession, path: str, schema: str, id_pattern: str = "doc_(.+)\\.json$") -> DataFrame:
    """One document per file, its id taken from the file's name (OP-007)."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), id_pattern, 1).alias("file_id"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; broken lines and lines that are no object are skipped (OP-008). The file's name is kept."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_name").alias("file"))
    # a broken line would still give an object of NULLs: the corrupt column tells it apart
    full = T._parse_datatype_string(schema).add("_bad", T.StringType())
    parsed = lines.where(F.col("value").startswith("{")).select("file", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._bad IS NULL").select("file", *[F.col(f"r.{f.name}") for f in full if f.name != "_bad"])


def read_zip_csv(spark: SparkSession, path: str, columns: list[str], member: str | None = None) -> DataFrame:
    """CSV members of zip files as text columns (OP-010). A zip file can't be split: one task reads one file, in blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".csv") and (member is None or name == member):
                            with z.open(name) as f:
                                for block in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=50_000):
                                    yield block.reindex(columns=columns, fill_value="")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A preset as a relation (OP-011)."""
    return spark.createDataFrame(rows, schema)


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parquet table, or an empty one of that schema where there is none (OP-013)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def check_inputs(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(check, status, detail): presence and number of rows of each expected table (OP-012)."""
    out = []
    for name, n in expected.items():
        if name not in tables:
            out.append((name, "missing", f"expected {n}"))
        else:
            have = tables[name].count()
            out.append((name, "ok" if have == n else "differs", f"{have} of {n}"))
    return spark.createDataFrame(out, "check string, status string, detail string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, size) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def manifest_diff(old: DataFrame, new: DataFrame, seconds: float = 1.0) -> DataFrame:
    """(file, status): new, modified (time moved by at least so many seconds), unchanged or removed (OP-015)."""
    j = old.select("file", F.col("modified").alias("m0")).join(new.select("file", F.col("modified").alias("m1")), "file", "full_outer")
    moved = F.abs(F.col("m1").cast("double") - F.col("m0").cast("double")) >= seconds
    return j.select("file", F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "removed").when(moved, "modified").otherwise("unchanged").alias("status"))
