"""Regression on distributed frames: cross-products are summed in Spark, the small systems are solved on the driver.

A design is numeric columns plus factors (absorbed as dummies, first level dropped by the pseudo-inverse). One pass sums
X'X, X'Z, X'y over partitions in numpy; a second one sums the scores per cluster. What reaches the driver has the size
of the design (checked against max_columns), never of the data.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.stats import normal_two_sided, t_two_sided

MAX_COLUMNS = 3_000


@dataclass
class Design:
    numeric: list[str]
    factors: dict[str, list[str]]
    names: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.names = ["(intercept)", *self.numeric, *[f"{f}={v}" for f, vs in self.factors.items() for v in vs[1:]]]

    def matrix(self, df: pd.DataFrame) -> np.ndarray:
        parts = [np.ones((len(df), 1)), *[df[[c]].to_numpy(float) for c in self.numeric]]
        for f, levels in self.factors.items():
            code = pd.Categorical(df[f].astype(str), categories=levels).codes
            hot = np.zeros((len(df), len(levels)))
            hot[np.arange(len(df)), code] = 1.0
            parts.append(hot[:, 1:])
        return np.hstack(parts)


def design(df: DataFrame, numeric: list[str], factors: list[str], max_columns: int = MAX_COLUMNS) -> Design:
    """The design's columns; the levels of factors are counted before they are fetched."""
    levels = {}
    for f in factors:
        rows = df.select(F.col(f).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(max_columns + 1).collect()
        if len(rows) > max_columns:
            raise ValueError(f"factor {f} has more than {max_columns} levels; absorb it with `within` instead")
        levels[f] = sorted(r["v"] for r in rows)
    return Design(numeric, levels)


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without NULL or NaN in the model's columns."""
    return df.dropna(subset=[c for c in dict.fromkeys(cols) if c in df.columns])


def _sum_outer(df: DataFrame, left, cols: list[str]) -> np.ndarray:
    """Sum of L'L over all rows, L = left(pandas)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            m = left(b)
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()]})

    out = None
    for r in df.select(*cols).mapInPandas(part, "g array<double>").toLocalIterator():
        v = np.asarray(r["g"])
        out = v if out is None else out + v
    k = int(math.isqrt(len(out))) if out is not None else 0
    return out.reshape(k, k) if out is not None else np.zeros((0, 0))


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    k: int
    rss: float
    tss: float
    clusters: dict[str, int]
    first_stage_f: float | None = None

    def row(self, name: str) -> dict:
        i = self.names.index(name)
        se = math.sqrt(max(self.vcov[i, i], 0.0))
        t = self.beta[i] / se if se > 0 else math.nan
        df = min(self.clusters.values()) - 1 if self.clusters else self.n - self.k
        p = t_two_sided(float(t), df) if se > 0 else math.nan
        return {"term": name, "beta": float(self.beta[i]), "se": float(se), "t": float(t), "p": float(p), "n": self.n, "f_first": None if self.first_stage_f is None else float(self.first_stage_f)}


def _psd(v: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh((v + v.T) / 2)
    return (q * np.maximum(w, 0)) @ q.T


def _cluster_meat(df: DataFrame, d: Design, y: str, beta: np.ndarray, x_cols: list[str], z_cols: list[str] | None, cluster: list[str]) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer product of their scores, and the number of clusters.

    Scores are summed per cluster in Spark; their outer products are summed per partition.
    """
    k = len(d.names)
    cols = list(dict.fromkeys([y, *x_cols, *(z_cols or []), *d.numeric, *d.factors, *cluster]))

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _with(d, b, x_cols)
            z = x if z_cols is None else _with(d, b, z_cols)
            u = b[y].to_numpy(float) - x @ beta
            s = pd.DataFrame(z * u[:, None])
            key = b[cluster].astype(str).agg("|".join, axis=1).to_numpy()
            g = s.groupby(key).sum()
            yield pd.DataFrame({"key": g.index.astype(str), "s": list(g.to_numpy())})

    per = df.select(*cols).mapInPandas(scores, "key string, s array<double>")
    summed = per.select("key", F.posexplode("s").alias("j", "v")).groupBy("key", "j").agg(F.sum("v").alias("v")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s")).select(F.transform("s", lambda e: e["v"]).alias("s"))

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, k)), 0
        for b in batches:
            if len(b):
                m = np.vstack(b["s"].to_numpy())
                total += m.T @ m
                n += len(b)
        yield pd.DataFrame({"g": [total.ravel()], "n": [n]})

    meat, groups = np.zeros((k, k)), 0
    for r in summed.mapInPandas(outer, "g array<double>, n long").toLocalIterator():
        meat += np.asarray(r["g"]).reshape(k, k)
        groups += r["n"]
    return meat, groups


def _with(d: Design, b: pd.DataFrame, cols: list[str]) -> np.ndarray:
    return Design(cols, d.factors).matrix(b)


def fit(df: DataFrame, y: str, x: list[str], factors: list[str] | None = None, clusters: list[str] | None = None, endogenous: list[str] | None = None, instruments: list[str] | None = None) -> Fit:
    """OLS, or two-stage least squares with endogenous regressors and as many or more instruments (OP-200 to OP-209).

    x: exogenous numeric regressors. clusters: none for the usual, one for CRV1, two for two-way (CGM, made positive
    semi-definite) errors with ssc G/(G-1) * (n-1)/(n-K). Collinear columns get their share by the pseudo-inverse.
    first_stage_f is the squared t of the excluded instrument where there is one.
    """
    factors, clusters, endogenous, instruments = factors or [], clusters or [], endogenous or [], instruments or []
    data = complete(df, [y, *x, *factors, *clusters, *endogenous, *instruments])
    x_cols, z_cols = [*endogenous, *x], [*instruments, *x]
    d = design(data, x_cols, factors)
    k = len(d.names)
    cols = list(dict.fromkeys([y, *x_cols, *z_cols, *factors]))

    def left(b: pd.DataFrame) -> np.ndarray:
        xm = _with(d, b, x_cols)
        return np.hstack([xm, _with(d, b, z_cols), b[[y]].to_numpy(float)]) if endogenous else np.hstack([xm, b[[y]].to_numpy(float)])

    g = _sum_outer(data, left, cols)
    if not len(g):
        raise ValueError("no complete rows")
    n = int(round(g[0, 0]))
    yy = g[-1, -1]
    ysum = g[0, -1]
    first_f = None
    if endogenous:
        m = len(_names(d, z_cols))
        xx, xz, zz, zy, xy = g[:k, :k], g[:k, k : k + m], g[k : k + m, k : k + m], g[k : k + m, -1], g[:k, -1]
        pz = np.linalg.pinv(zz)
        a = np.linalg.pinv(xz @ pz @ xz.T)
        beta = a @ xz @ pz @ zy
        project = xz @ pz  # scores are formed with Z and brought to X
        rss = yy - 2 * beta @ xy + beta @ xx @ beta
        bread = a
        if len(endogenous) == 1 and len(instruments) == 1:
            first = fit(data, endogenous[0], [*instruments, *x], factors, clusters)
            r = first.row(instruments[0])
            first_f = r["t"] ** 2
    else:
        xx, xy = g[:k, :k], g[:k, -1]
        bread = np.linalg.pinv(xx)
        beta = bread @ xy
        rss = yy - beta @ xy
        project = None
    rank = int(np.linalg.matrix_rank(xx))
    counts: dict[str, int] = {}

    def one(cl: list[str]) -> np.ndarray:
        meat, groups = _cluster_meat(data, d, y, beta, x_cols, z_cols if endogenous else None, cl)
        counts["|".join(cl)] = groups
        if project is not None:
            meat = project @ meat @ project.T
        ssc = groups / max(groups - 1, 1) * (n - 1) / max(n - rank, 1)
        return bread @ meat @ bread * ssc

    if not clusters:
        vcov = bread * rss / max(n - rank, 1)
    elif len(clusters) == 1:
        vcov = one(clusters)
    else:
        vcov = _psd(one([clusters[0]]) + one([clusters[1]]) - one(clusters))
        counts.pop("|".join(clusters))
    return Fit(_names(d, x_cols), beta, vcov, n, rank, float(rss), float(yy - ysum * ysum / n), counts, first_f)


def _names(d: Design, cols: list[str]) -> list[str]:
    return Design(cols, d.factors).names


def ols(df: DataFrame, y: str, x: list[str], factors: list[str] | None = None, clusters: list[str] | None = None) -> Fit:
    return fit(df, y, x, factors, clusters)


def iv(df: DataFrame, y: str, endogenous: list[str], instruments: list[str], x: list[str] | None = None, factors: list[str] | None = None, clusters: list[str] | None = None) -> Fit:
    return fit(df, y, x or [], factors, clusters, endogenous, instruments)


def tidy(spark, fits: dict[str, tuple[Fit, list[str]]]) -> DataFrame:
    """One row per specification and term (OP-208)."""
    rows = [(spec, r["term"], r["beta"], r["se"], r["t"], r["p"], r["n"], r["f_first"]) for spec, (f, terms) in fits.items() for r in map(f.row, terms)]
    return spark.createDataFrame(rows, "spec string, term string, beta double, se double, t double, p double, n long, f_first double")


def residualize(df: DataFrame, ys: list[str], x: list[str], factors: list[str]) -> DataFrame:
    """df with <y>_res: what is left of each y after numeric columns and factors (OP-200). Rows with a gap in the model
    are dropped."""
    data = complete(df, [*ys, *x, *factors])
    d = design(data, x, factors)
    k = len(d.names)
    g = _sum_outer(data, lambda b: np.hstack([d.matrix(b), b[ys].to_numpy(float)]), list(dict.fromkeys([*ys, *x, *factors])))
    coef = np.linalg.pinv(g[:k, :k]) @ g[:k, k:] if len(g) else np.zeros((k, len(ys)))
    schema = data.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            res = b[ys].to_numpy(float) - d.matrix(b) @ coef
            yield b.assign(**{f"{c}_res": res[:, i] for i, c in enumerate(ys)})

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"`{c}_res` double" for c in ys])
    return data.mapInPandas(run, out)


def within(df: DataFrame, cols: list[str], factors: list[str], rounds: int = 50, tol: float = 1e-8) -> DataFrame:
    """df with <col>_dm: demeaned by factors of any number of levels, by alternating projections in Spark (OP-202)."""
    from kinweave.runtime import checkpoint, discard

    cur = checkpoint(df.select("*", *[F.col(c).cast("double").alias(c + "_dm") for c in cols]))
    for _ in range(rounds if len(factors) > 1 else 1):
        out = cur
        for f in factors:
            means = out.groupBy(f).agg(*[F.avg(c + "_dm").alias("__m_" + c) for c in cols])
            out = out.join(means, f).select(*cur.columns, *["__m_" + c for c in cols])
            out = out.withColumns({c + "_dm": F.col(c + "_dm") - F.col("__m_" + c) for c in cols}).select(*cur.columns)
        new = checkpoint(out)
        shift = 0.0
        if len(factors) > 1:
            m = new.groupBy(factors[0]).agg(*[F.avg(c + "_dm").alias(c) for c in cols]).agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
            shift = max((m[c] or 0.0) for c in cols)
        discard(cur)
        cur = new
        if shift < tol:
            break
    return cur


def partial_corr(df: DataFrame, x: str, y: str, controls: list[str], factors: list[str]) -> DataFrame:
    """One row: correlation of what is left of x and y after the controls (OP-136)."""
    return residualize(df, [x, y], controls, factors).agg(F.corr(x + "_res", y + "_res").alias("partial_corr"))


def effective_clusters(df: DataFrame, z: str, e: str, g: str) -> DataFrame:
    """One row: 1 / sum of squared cluster shares of z^2 and of |z e| (OP-145)."""
    per = df.groupBy(g).agg(F.sum(F.col(z) * F.col(z)).alias("a"), F.abs(F.sum(F.col(z) * F.col(e))).alias("b"))
    t = per.agg(F.sum("a").alias("A"), F.sum("b").alias("B"), F.sum(F.col("a") * F.col("a")).alias("a2"), F.sum(F.col("b") * F.col("b")).alias("b2"))
    return t.select((F.col("A") * F.col("A") / F.col("a2")).alias("by_instrument"), (F.col("B") * F.col("B") / F.col("b2")).alias("by_score"))


def poisson(df: DataFrame, y: str, x: list[str], factors: list[str] | None = None, rounds: int = 50, tol: float = 1e-9) -> Fit:
    """Poisson pseudo-maximum likelihood by iterated weighted least squares; groups of a factor whose outcomes are all
    zero are dropped first (OP-216). Errors are robust to clustering by row."""
    factors = factors or []
    data = complete(df, [y, *x, *factors])
    for f in factors:
        data = data.join(data.groupBy(f).agg(F.max(y).alias("__m")).where("__m > 0").select(f), f, "left_semi")
    d = design(data, x, factors)
    k = len(d.names)
    cols = list(dict.fromkeys([y, *x, *factors]))
    mean = data.agg(F.avg(y).alias("m")).first()["m"]
    beta = np.zeros(k)
    beta[0] = math.log(mean) if mean else 0.0
    n = 0
    for _ in range(rounds):
        b0 = beta.copy()

        def left(b: pd.DataFrame, b0: np.ndarray = b0) -> np.ndarray:
            m = d.matrix(b)
            eta = np.clip(m @ b0, -30, 30)
            mu = np.exp(eta)
            w = np.sqrt(mu)[:, None]
            work = eta + (b[y].to_numpy(float) - mu) / mu
            return np.hstack([m * w, work[:, None] * w, np.ones((len(b), 1))])

        g = _sum_outer(data, left, cols)
        n = int(round(g[-1, -1]))
        beta = np.linalg.pinv(g[:k, :k]) @ g[:k, k]
        if np.max(np.abs(beta - b0)) < tol:
            break
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    bread = np.linalg.pinv(g[:k, :k])

    def score(b: pd.DataFrame) -> np.ndarray:
        m = d.matrix(b)
        return m * (b[y].to_numpy(float) - np.exp(np.clip(m @ beta, -30, 30)))[:, None]

    meat = _sum_outer(data, score, cols)
    return Fit(d.names, beta, bread @ meat @ bread * n / max(n - 1, 1), n, k, math.nan, math.nan, {})


def control_function(df: DataFrame, y: str, endogenous: str, instrument: str, x: list[str], factors: list[str]) -> Fit:
    """Poisson with the first stage's residual among the regressors (OP-217)."""
    data = complete(df, [y, endogenous, instrument, *x, *factors])
    return poisson(residualize(data, [endogenous], [instrument, *x], factors), y, [endogenous, endogenous + "_res", *x], factors)


def oster(beta_short: float, r_short: float, beta_long: float, r_long: float, factor: float = 1.3) -> dict:
    """Selection bounds at Rmax = min(factor * R, 1) and 1: delta* that makes the effect zero, and beta* at delta = 1 (OP-218)."""
    out = {}
    for name, rmax in (("rule", min(factor * r_long, 1.0)), ("one", 1.0)):
        move, gain = (beta_short - beta_long) * (rmax - r_long), r_long - r_short
        delta = math.inf if abs(move) < 1e-15 else beta_long * gain / move
        bstar = beta_long - move / gain if gain > 0 else math.nan
        out[name] = {"rmax": rmax, "delta": delta, "beta_star": bstar, "robust": delta < 0 or delta >= 1}
    return out


def margins(df: DataFrame, y: str, regressor: str, instrument: str, x: list[str], factors: list[str], clusters: list[str]) -> DataFrame:
    """Total log effect split into the extensive part log 2 * 1{y > 0} and the intensive rest (OP-219)."""
    d = df.withColumn("__total", F.log1p(y)).withColumn("__ext", F.lit(math.log(2)) * (F.col(y) > 0).cast("double")).withColumn("__int", F.col("__total") - F.col("__ext"))
    fits = {n: (iv(d, c, [regressor], [instrument], x, factors, clusters), [regressor]) for n, c in (("total", "__total"), ("extensive", "__ext"), ("intensive", "__int"))}
    return tidy(df.sparkSession, fits)


def leave_one_out(df: DataFrame, g: str, y: str, x: str) -> DataFrame:
    """(g, beta): slope of y on x without each cluster, all from one table of cluster sums (OP-211)."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(g).isNotNull()).groupBy(g).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    t = s.agg(*[F.sum(c).alias("t_" + c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    r = s.crossJoin(t)  # one row
    v = {c: F.col("t_" + c) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    return r.select(g, ((v["n"] * v["sxy"] - v["sx"] * v["sy"]) / (v["n"] * v["sxx"] - v["sx"] * v["sx"])).alias("beta"))


def permutation_test(df: DataFrame, cell: str, key: str, y: str, z: str, draws: int, seed: int) -> DataFrame:
    """(draw, stat): sum of z times y with y permuted within cells, draw 0 unpermuted (OP-213).

    A permutation is a sort by md5 of seed, draw and key within the cell. Rows are put in order once; a task permutes
    one cell for one block of draws, so memory goes with the largest cell, and no row is written once a draw.
    """
    base = df.select(F.col(cell).alias("cell"), F.col(key).alias("key"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z")).where("z IS NOT NULL AND y IS NOT NULL AND cell IS NOT NULL")
    cores = df.sparkSession.sparkContext.defaultParallelism
    block = math.ceil((draws + 1) / cores)
    # dealt out by number: adaptive execution goes by bytes and would leave few rows with many draws to one task
    blocks = base.withColumn("name", F.col("key").cast("string")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(draws // block)))).repartition(4 * cores, "block", "cell")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable", na_position="first")
        names, ys, zs = [b"" if x is None else f"|{x}".encode() for x in part["name"]], part["y"].to_numpy(), part["z"].to_numpy()
        first, out = int(part["block"].iloc[0]) * block, []
        for draw in range(first, min(first + block, draws + 1)):
            order = np.arange(len(ys))
            if draw:
                start = hashlib.md5(f"{seed}|{draw}".encode())
                marks = []
                for x in names:
                    m = start.copy()
                    m.update(x)
                    marks.append(m.digest())
                two = np.frombuffer(b"".join(marks), dtype=">u8").reshape(-1, 2)
                order = np.lexsort((order, two[:, 1], two[:, 0]))
            out.append((draw, float(zs @ ys[order])))
        return pd.DataFrame(out, columns=["draw", "stat"])

    return blocks.groupBy("block", "cell").applyInPandas(run, "draw int, stat double").groupBy("draw").agg(F.sum("stat").alias("stat"))


def group_permutation(df: DataFrame, stratum: str, group: str, y: str, z: str, draws: int, seed: int) -> DataFrame:
    """(draw, stat): the z of whole groups is permuted within strata and inherited by the members (OP-214)."""
    per = df.groupBy(stratum, group).agg(F.avg(z).alias("z"), F.sum(y).alias("y"))
    return permutation_test(per, stratum, group, "y", "z", draws, seed)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number of each, by the usual shifts and multiplications."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wild_bootstrap(df: DataFrame, y: str, x: str, cluster: str, draws: int = 999, seed: int = 1, weights: str = "rademacher") -> DataFrame:
    """(draw, t): restricted wild cluster bootstrap of one residualised regressor (OP-212); draw 0 is the sample's t.

    Under the null a draw depends on the data through three sums over clusters, weighted by signs that a hash of cluster
    and draw gives; they are summed where the clusters are, so any number of clusters will do.
    """
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cluster).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    s = s.select(F.xxhash64(F.col(cluster), F.lit(seed)).alias("h"), F.col("xy").cast("double").alias("xy"), F.col("xx").cast("double").alias("xx"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        webb = np.array([-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)])
        step = np.arange(draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total = np.zeros((5, draws + 1))
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.iloc[k : k + 200]
                h = part["h"].to_numpy().astype(np.uint64)
                bits = _mixed(h[:, None] + step[None, :])
                v = np.where(bits >> np.uint64(63), 1.0, -1.0) if weights == "rademacher" else webb[(bits % np.uint64(6)).astype(int)]
                v[:, 0] = 1.0
                xy, xx = part["xy"].to_numpy(), part["xx"].to_numpy()
                total += np.stack([v.T @ xy, v.T @ (xy * xx), (v * v).T @ (xy * xy), np.full(draws + 1, (xx * xx).sum()), np.full(draws + 1, xx.sum())])
        yield pd.DataFrame({"draw": np.arange(draws + 1), **{f"s{i}": total[i] for i in range(5)}})

    sums = s.mapInPandas(run, "draw long, s0 double, s1 double, s2 double, s3 double, s4 double").groupBy("draw").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)])
    beta = F.col("s0") / F.col("s4")
    se = F.sqrt(F.col("s2") - 2 * beta * F.col("s1") + beta * beta * F.col("s3")) / F.col("s4")
    return sums.where("s4 > 0").select("draw", F.when(se > 0, beta / se).otherwise(F.lit(float("nan"))).alias("t"))


def cluster_bootstrap(df: DataFrame, cluster: str, y: str, x: str, draws: int, seed: int) -> DataFrame:
    """(draw, stat): slope of y on x under resampled clusters (OP-215). Each draw takes as many clusters as there are, with
    replacement; one drawn twice counts as two. Clusters are numbered in their order, a hash of draw and turn picks one."""
    from kinweave.operators.relational import with_row_no

    sums = ("n", "sx", "sy", "sxx", "sxy")
    s = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    s = with_row_no(s, [F.col(cluster)]).select(F.col("row_no").cast("long").alias("no"), *sums)
    g = s.count()
    if not g:
        return df.sparkSession.createDataFrame([], "draw long, stat double")
    turns = df.sparkSession.range(0, draws * g).select((F.floor(F.col("id") / g) + 1).alias("draw"), (F.col("id") % g).alias("turn"))
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw"), F.col("turn"))), 1, 12), 16, 10).cast("long")
    # how often a draw takes each cluster, before the clusters are joined
    taken = turns.groupBy("draw", (mark % g).alias("no")).agg(F.count("*").alias("w"))
    t = taken.join(s, "no").groupBy("draw").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])
    return t.select("draw", ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))).alias("stat"))


def z_to_p(z: float) -> float:
    return normal_two_sided(z)
