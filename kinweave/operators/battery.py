"""Batteries of regressions on one frame: many specifications, two passes over the data for each sample.

The first pass sums the cross-products of all columns that the specifications of a sample and factor use, less their
means over the factor, which may have any number of levels. Every coefficient comes from blocks of that one small matrix by
partialling the controls out (exact, also with instruments). The second pass sums, per cluster, the influence of its rows
on each coefficient, so a specification costs one number per cluster; the sums of squares are the clustered variances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.econ import Design, _sum_outer, complete, design, within
from kinweave.runtime import discard

TINY = 1e-6  # a residual sum of squares below this is none: the column is a combination of the others
NONE = 1e-10  # the same, as a part of the sum of squares


@dataclass(frozen=True)
class Spec:
    """y on term (instrumented by instrument, if given) with numeric controls and factors, on the rows where sample holds."""

    name: str
    y: str
    term: str
    controls: tuple[str, ...] = ()
    factors: tuple[str, ...] = ()
    cluster: str = "label"
    instrument: str | None = None
    sample: str = "true"


@dataclass
class _Solved:
    spec: Spec
    columns: list[int] = field(default_factory=list)
    weights: dict = field(default_factory=dict)
    beta: float | None = None
    n: int = 0
    rank: int = 0


def _kept(gram: np.ndarray, raw: np.ndarray) -> list[int]:
    """Positions of the columns that aren't combinations of those before them, by taking them out one after the other."""
    left, kept = gram.copy(), []
    for j in range(len(gram)):
        if left[j, j] > max(TINY, NONE * raw[j]):
            kept.append(j)
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return kept


def _solve(spec: Spec, gram: np.ndarray, raw: np.ndarray, names: list[str], levels: int) -> _Solved:
    """Coefficient and what the second pass needs, from the cross-products of the columns called names, which are demeaned
    by a factor of so many levels. raw: sums of squares of the columns as they were."""
    out = _Solved(spec, n=int(round(gram[0, 0])) if len(gram) else 0)
    if not out.n:
        return out
    at = {c: i for i, c in enumerate(names)}
    # of several factors, the last ones are dummies
    c = [*(at[x] for x in spec.controls), *(i for i, x in enumerate(names) if any(x.startswith(f"{f}=") for f in spec.factors[1:]))]
    c = [c[j] for j in _kept(gram[np.ix_(c, c)], raw[c])]
    scale = np.sqrt(np.diag(gram)[c])
    inv = np.linalg.pinv(gram[np.ix_(c, c)] / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    x, y, z = at[spec.term], at[spec.y], at[spec.instrument or spec.term]
    gamma = {k: inv @ gram[c, k] for k in {x, y, z}}
    left = lambda a, b: gram[a, b] - gram[c, a] @ gamma[b]
    bottom = left(z, x)
    out.rank = levels + len(c) + 1
    if abs(bottom) < max(TINY, NONE * math.sqrt(raw[z] * raw[x])) or out.n - out.rank < 2:
        return out
    out.beta = float(left(z, y) / bottom)
    out.columns = c
    out.weights = {"x": x, "y": y, "z": z, "gamma": gamma, "bottom": bottom}
    return out


def battery(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """(spec, term, beta, se, n, clusters), a row per specification; beta and se are NULL where the term is not identified
    or fewer than two degrees of freedom are left.

    Errors are clustered, G/(G-1) * (n-1)/(n-K). Rows with a NULL in any column that the specifications of a sample use
    are left out of that sample, so its specifications have the same rows. An empty sample gives n = 0. The first factor of
    a specification may have any number of levels; others are dummies, of at most econ.MAX_COLUMNS levels.
    """
    spark, rows = df.sparkSession, {}
    for sample in dict.fromkeys(s.sample for s in specs):
        of = [s for s in specs if s.sample == sample]
        numeric = list(dict.fromkeys(c for s in of for c in (s.y, s.term, *s.controls, *([s.instrument] if s.instrument else []))))
        clusters = list(dict.fromkeys(s.cluster for s in of))
        every = list(dict.fromkeys(f for s in of for f in s.factors))
        cols = list(dict.fromkeys([*numeric, *every, *clusters]))
        data = complete(df.where(sample).select(*cols), cols)
        for factors in dict.fromkeys(s.factors for s in of):
            _fit(data, [s for s in of if s.factors == factors], list(factors), rows)
    return spark.createDataFrame([rows[s.name] for s in specs], "spec string, term string, beta double, se double, n long, clusters long")


def _fit(data: DataFrame, own: list[Spec], factors: list[str], rows: dict[str, tuple]) -> None:
    """The rows of specifications of one sample and one set of factors."""
    numeric = list(dict.fromkeys(c for s in own for c in (s.y, s.term, *s.controls, *([s.instrument] if s.instrument else []))))
    clusters = list(dict.fromkeys(s.cluster for s in own))
    # further factors: their dummies lose their means over the first one like any column
    d = design(data, numeric, factors[1:])
    dummies = {x: f"__d{i}" for i, x in enumerate(d.names[1 + len(numeric) :])}
    split = {x: x.split("=", 1) for x in dummies}
    hot = [(F.col(split[x][0]).cast("string") == split[x][1]).cast("double").alias(a) for x, a in dummies.items()]
    absorbed = "__absorbed"  # one level, the intercept, where there is no factor
    named = data.select(*[F.col(c).cast("double").alias(f"__n{i}") for i, c in enumerate(numeric)], *[F.col(c).cast("string").alias(f"__c{i}") for i, c in enumerate(clusters)], *hot, (F.col(factors[0]) if factors else F.lit(1)).alias(absorbed))
    values = [*[f"__n{i}" for i in range(len(numeric))], *dummies.values()]
    demeaned = within(named, values, [absorbed])
    levels = demeaned.select(absorbed).distinct().count()
    plain = Design([v + "_dm" for v in values], {})
    gram = _sum_outer(demeaned, plain.matrix, plain.numeric)
    squares = demeaned.agg(*[F.sum(F.col(v) * F.col(v)) for v in values]).first()
    raw = np.array([1.0, *[v or 0.0 for v in squares]])
    solved = [_solve(s, gram, raw, d.names, levels) for s in own]
    told = [s for s in solved if s.beta is not None]
    for s in solved:
        rows[s.spec.name] = (s.spec.name, s.spec.term, s.beta, None, s.n, None)
    where = {c: f"__c{i}" for i, c in enumerate(clusters)}

    def influence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = plain.matrix(b)
            for i, s in enumerate(told):
                w, c = s.weights, m[:, s.columns]
                res = lambda k, w=w, c=c, m=m: m[:, k] - c @ w["gamma"][k]
                psi = res(w["z"]) * (res(w["y"]) - s.beta * res(w["x"])) / w["bottom"]
                per = pd.Series(psi).groupby(b[where[s.spec.cluster]].to_numpy()).sum()
                yield pd.DataFrame({"i": i, "g": per.index.astype(str), "v": per.to_numpy()})

    if told:
        sums = demeaned.select(*plain.numeric, *where.values()).mapInPandas(influence, "i int, g string, v double").groupBy("i", "g").agg(F.sum("v").alias("v"))
        for r in sums.groupBy("i").agg(F.count("*").alias("g"), F.sum(F.col("v") * F.col("v")).alias("q")).collect():  # one row per specification
            s, g = told[r["i"]], r["g"]
            se = math.sqrt(r["q"] * g / (g - 1) * (s.n - 1) / (s.n - s.rank)) if g > 1 and s.n > s.rank else None
            rows[s.spec.name] = (s.spec.name, s.spec.term, s.beta, se, s.n, g)
    discard(demeaned)


def control_string(hop: int = 4, time: str = "decade", house: bool = True, father: str = "increment", documents: str = "total", own_size: bool = False, own_visibility: bool = False) -> str:
    """The right-hand side of a specification, from its switches (OP-210)."""
    parts = ["title_rank", {"decade": "death_decade", "papacy": "papacy"}[time], "log_degree"]
    parts += [f"own_log_size_{hop}"] * own_size + ["own_log_visibility"] * own_visibility
    for who in ("mother", "father", "mgf"):
        counts = [f"{who}_log_disputes", f"{who}_log_others"] if documents == "split" else [f"{who}_log_documents"]
        parts += [f"{who}_title_rank", f"{who}_log_size_{hop}", *counts, f"{who}_log_degree"]
    parts += {"increment": [f"father_extra_{hop}"], "level": [f"father_reach_{hop}"], "none": []}[father]
    parts.append(f"mgf_reach_{hop}")
    return " + ".join(parts + ["house"] * house)
