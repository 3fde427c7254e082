"""Stages in order, restartable, with a log of times; comparison of results with published ones."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A step: fn(context, **params) -> name -> table (OP-260). skip: only run when asked by id."""

    id: str
    desc: str
    fn: Callable[..., dict[str, DataFrame]]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    skip: bool = False
    params: dict = field(default_factory=dict)


class Run:
    """Runs stages over a folder of parquet tables.

    A table is looked for among frozen artefacts first, then among generated ones (OP-014). A failing stage ends the
    run; a later run can start from it (OP-261, OP-262).
    """

    def __init__(self, spark: SparkSession, stages: list[Stage], folder: str, frozen: dict[str, str] | None = None):
        self.spark, self.stages, self.folder, self.frozen = spark, stages, folder.rstrip("/"), frozen or {}

    def listing(self) -> list[tuple[str, str, bool]]:
        return [(s.id, s.desc, s.skip) for s in self.stages]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.frozen.get(name, f"{self.folder}/{name}"))

    def run(self, only: list[str] | None = None, start: str | None = None, overrides: dict[str, dict] | None = None) -> list[dict]:
        """overrides: parameters of stages for this run alone; nothing has to be restored after it (OP-265)."""
        log, begun = [], start is None
        for s in self.stages:
            begun = begun or s.id == start
            if only is not None and s.id not in only or not begun or s.skip and (only is None or s.id not in only):
                continue
            t = time.time()
            try:
                tables = s.fn({n: self.table(n) for n in s.inputs}, **(s.params | (overrides or {}).get(s.id, {})))
                for n in s.outputs:
                    tables[n].write.mode("overwrite").parquet(f"{self.folder}/{n}")
                log.append({"stage": s.id, "status": "ok", "sec": round(time.time() - t, 2)})
            except Exception as e:
                log.append({"stage": s.id, "status": "failed", "sec": round(time.time() - t, 2), "error": str(e)[:500]})
                self._append(log)
                raise
        self._append(log)
        return log

    def _append(self, log: list[dict]) -> None:
        if log:
            self.spark.createDataFrame([(json.dumps(x),) for x in log], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/run_log")


_NUMBER = re.compile(r"(?<![A-Za-z\\])-?\d[\d,]*\.?\d*|(?<!\d)-?\.\d+")


def numeric_tokens(text: str) -> list[list[str]]:
    """Numbers per line of a table in LaTeX or Markdown, commands and lines of notes left out."""
    out = []
    for line in text.splitlines():
        if re.match(r"\s*(\\(caption|label|note|begin|end|cmidrule|footnotesize)|%|Notes?:)", line):
            continue
        tokens = [t.replace(",", "").rstrip(".") for t in _NUMBER.findall(re.sub(r"\\[A-Za-z]+(\[[^\]]*\])?", " ", line))]
        if tokens:
            out.append(tokens)
    return out


def verify_tables(generated: str, published: str) -> list[tuple[int, list[str], list[str]]]:
    """Rows of numbers that differ between two versions of a table; empty if they agree (OP-263)."""
    a, b = numeric_tokens(generated), numeric_tokens(published)
    rows = max(len(a), len(b))
    a, b = a + [[]] * (rows - len(a)), b + [[]] * (rows - len(b))
    return [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]


def compare(a: DataFrame, b: DataFrame, on: list[str], cols: list[str], tol: float = 1e-9) -> DataFrame:
    """(column, rows, mismatches, correlation, within_1) of two builds of one table (OP-264). A NULL equals only a NULL."""
    left = a.select(*on, *[F.col(c).cast("double").alias("a_" + c) for c in cols])
    right = b.select(*on, *[F.col(c).cast("double").alias("b_" + c) for c in cols])
    j = left.join(right, on)
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("a_" + c).alias("x"), F.col("b_" + c).alias("y")) for c in cols])).alias("p")
    d = j.select(pair).select("p.*")
    same = F.coalesce(F.abs(F.col("x") - F.col("y")) <= tol, F.col("x").isNull() & F.col("y").isNull())
    return d.groupBy("column").agg(F.count("*").alias("rows"), F.count_if(~same).alias("mismatches"), F.corr("x", "y").alias("correlation"), F.avg((F.abs(F.col("x") - F.col("y")) <= 1).cast("int")).alias("within_1"))
