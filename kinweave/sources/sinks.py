"""Sinks: tables, audits and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, quote_all: bool = False, bom: bool = False, mode: str = "overwrite") -> None:
    """Fixed header, NULL as empty (OP-020 to OP-022). The header is repeated per part file; bom marks each part."""
    out = df.select(*(columns or df.columns))
    if bom:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.mode(mode).options(header=True, nullValue="", emptyValue="", quoteAll=quote_all, escape='"').csv(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, json): one document per row (OP-023)."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("json"))


def rejects(df: DataFrame, rules: dict[str, Column], text: str | None = None, width: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all rules, and the others with the first broken rule as reason and text cut (OP-024). A rule that
    gives NULL is broken."""
    reason = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, F.lit(name)) if reason is None else reason.when(bad, F.lit(name))
    tagged = df.withColumn("reason", reason)
    dropped = tagged.where("reason IS NOT NULL")
    return tagged.where("reason IS NULL").drop("reason"), dropped.withColumn(text, F.substring(text, 1, width)) if text else dropped


def to_markdown(df: DataFrame, title: str, max_rows: int = 1000) -> str:
    """A small table as Markdown (OP-025); more than max_rows is an error, not a cut."""
    rows = _small(df, max_rows)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def to_latex(df: DataFrame, caption: str, align: str | None = None, max_rows: int = 1000) -> str:
    """A small table with booktabs rules (OP-026)."""
    esc = lambda v: "" if v is None else str(v).replace("\\", "\\textbackslash{}").replace("&", "\\&").replace("%", "\\%").replace("_", "\\_").replace("#", "\\#")
    rows = _small(df, max_rows)
    body = "\n".join(" & ".join(map(esc, r)) + r" \\" for r in rows)
    return "\n".join([r"\begin{table}", rf"\caption{{{esc(caption)}}}", rf"\begin{{tabular}}{{{align or 'l' * len(df.columns)}}}", r"\toprule", " & ".join(map(esc, df.columns)) + r" \\", r"\midrule", body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"


def _small(df: DataFrame, max_rows: int) -> list:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows are no report")
    return rows
