"""Aggregations: windows over years, metric tables, distributions, agreement and precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.scalars import upper_median, wilson


def window_spine(spark, lo: int, hi: int, length: int, stride: int) -> DataFrame:
    """(window_start): every window of a length inside [lo, hi], in steps of stride."""
    return spark.range(lo, hi - length + 1, stride).select(F.col("id").cast("int").alias("window_start"))


def _covered(y: str, lo: int, hi: int, length: int, stride: int) -> Column:
    """Starts of the windows that hold a year: at most length / stride of them."""
    last = F.least(F.floor((F.col(y) - lo) / stride) * stride + lo, F.lit(lo + (hi - length - lo) // stride * stride))
    first = F.greatest(F.ceil((F.col(y) - length + 1 - lo) / stride) * stride + lo, F.lit(lo))
    return F.when((F.col(y) >= lo) & (first <= last), F.sequence(first.cast("int"), last.cast("int"), F.lit(stride)))


def window_panel(df: DataFrame, y: str, length: int, stride: int, lo: int, hi: int, flags: list[str], weight: str | None = None) -> DataFrame:
    """Sliding windows [start, start + length) with rows, and per 0/1 flag count, share and Wilson interval (OP-121 to OP-123).

    Empty windows stay, with NULL shares. With a weight, counts are sums of it, and it is the interval's n as well.
    Rows are summed per year first, so each year is spread to its windows once, however many rows it has.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    per_year = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("__y")).agg(F.sum(w).alias("n"), *[F.sum(F.coalesce(F.col(f), F.lit(0)) * w).alias("n_" + f) for f in flags])
    spread = per_year.withColumn("window_start", F.explode(_covered("__y", lo, hi, length, stride))).groupBy("window_start").agg(F.sum("n").alias("n"), *[F.sum("n_" + f).alias("n_" + f) for f in flags])
    out = window_spine(df.sparkSession, lo, hi, length, stride).join(spread, "window_start", "left")
    cols = [F.col("window_start"), (F.col("window_start") + length).alias("window_end"), F.coalesce("n", F.lit(0)).alias("n")]
    for f in flags:
        k = F.coalesce("n_" + f, F.lit(0))
        p, a, b = wilson(k, F.coalesce("n", F.lit(0)))
        cols += [k.alias("n_" + f), p.alias("share_" + f), a.alias("lo_" + f), b.alias("hi_" + f)]
    return out.select(*cols)


def tumbling_ci(df: DataFrame, y: str, width: int, x: str, z: float = 1.96) -> DataFrame:
    """Per bucket of years: n, mean, sd, half width of the normal interval; mid is the middle of the bucket (OP-124)."""
    mid = (F.floor(F.col(y) / width) * width + width / 2).alias("mid")
    out = df.where(F.col(y).isNotNull()).groupBy(mid).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return out.withColumn("half", z * F.col("sd") / F.sqrt("n"))


def metric_table(df: DataFrame, metrics: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, metric, value): named aggregates in one pass, as rows (OP-113)."""
    by = by or []
    wide = df.groupBy(*by).agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    return wide.unpivot(by, list(metrics), "metric", "value") if by else wide.unpivot([], list(metrics), "metric", "value")


def explode_cohorts(df: DataFrame, cohorts: dict[str, Column]) -> DataFrame:
    """One row per cohort a row belongs to; cohorts may overlap (OP-114)."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in cohorts.items()]), lambda x: x.isNotNull())
    return df.withColumn("cohort", F.explode(names))


def rates(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias("rate_" + f) for f in flags])


def dist_stats(df: DataFrame, cols: list[str], probs: tuple[float, ...] = (0.75, 0.9, 0.99)) -> DataFrame:
    """(column, n, mean, median, p.., max, share_zero) with exact quantiles by linear interpolation (OP-117)."""
    out = [df.agg(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), *[F.percentile(c, p).alias(f"p{round(p * 100)}") for p in probs], F.max(c).cast("double").alias("max"), F.avg((F.col(c) == 0).cast("int")).alias("share_zero")) for c in cols]
    return reduce(DataFrame.union, out)


def approx_dist_stats(df: DataFrame, cols: list[str], probs: tuple[float, ...] = (0.5, 0.75, 0.9, 0.99), accuracy: int = 10_000) -> DataFrame:
    """The same by quantile sketches: one pass of bounded state, for tables where exact quantiles cost too much."""
    out = [df.agg(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), *[F.percentile_approx(c, p, accuracy).cast("double").alias(f"p{round(p * 100)}") for p in probs]) for c in cols]
    return reduce(DataFrame.union, out)


def histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) (OP-118)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x"))
    return long.groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def trimmed_quantiles(df: DataFrame, x: Column, lo: float, hi: float, by: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    d = df.withColumn("__x", x).where(F.col("__x").between(lo, hi))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"), *[F.percentile("__x", p).alias(f"q{round(p * 100)}") for p in probs])


def decade_panel(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, decade, n) (OP-120)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.floor(F.col(f) / 10) * 10).cast("int").alias("decade")) for f in fields])).alias("x")).select("x.*").where("decade IS NOT NULL")
    return long.groupBy("field", "decade").agg(F.count("*").alias("n"))


def reciprocity_report(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """(status, n): links by which side claims them and whether the silent side has a row (OP-110).

    claims: (a, b, side) with side 'a' or 'b', the end that states the link; rows: (id).
    """
    e = claims.groupBy("a", "b").agg(F.bool_or(F.col("side") == "a").alias("by_a"), F.bool_or(F.col("side") == "b").alias("by_b"))
    silent = F.when(F.col("by_a") & F.col("by_b"), None).when(F.col("by_a"), F.col("b")).otherwise(F.col("a"))
    j = e.withColumn("id", silent).join(rows.select("id", F.lit(True).alias("has")).distinct(), "id", "left")
    status = F.when(F.col("by_a") & F.col("by_b"), "mirrored").otherwise(F.concat(F.when(F.col("by_a"), "a_only").otherwise("b_only"), F.when(F.col("has").isNotNull(), "_with_row").otherwise("_no_row")))
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def first_nonnull_merge(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key with the first value that isn't NULL of each column, in order (OP-111). Partially aggregated."""
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def person_summary(matches: DataFrame, person: str, doc: str, year: str, subjects: Column, subject_names: list[str], role: str, roles: list[str]) -> DataFrame:
    """Per person: records, letters, upper median and rounded mean year, records per subject and role (OP-125 to OP-127).

    A subject counts once per record.
    """
    d = matches.where(F.col(person).isNotNull()).withColumn("__s", F.array_distinct(subjects))
    agg = [F.count("*").alias("n_matches"), F.count_distinct(doc).alias("n_docs"), upper_median(year).alias("median_year"), F.bround(F.avg(year)).cast("int").alias("mean_year")]
    agg += [F.count_if(F.array_contains("__s", s)).alias("n_" + s) for s in subject_names]
    agg += [F.count_if(F.lower(F.trim(F.col(role))) == r).alias("role_" + r) for r in roles]
    return d.groupBy(F.col(person).alias("person_id")).agg(*agg)


def pivot_counts(df: DataFrame, key: str, col: str, values: list[str]) -> DataFrame:
    """Counts per key and value, zero filled, with their total (OP-128); the values are given, so one pass is enough."""
    out = df.groupBy(key).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values])
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(v) for v in values]))


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in values])


def excess_share(df: DataFrame, key: str, flag: Column, unit: str) -> DataFrame:
    """Per key: units, flagged units, and how many more than the corpus share gives (OP-130)."""
    total = df.agg((F.count_distinct(F.when(flag, F.col(unit))) / F.count_distinct(unit)).alias("p"))
    per = df.groupBy(key).agg(F.count_distinct(unit).alias("n_all"), F.count_distinct(F.when(flag, F.col(unit))).alias("n_flag"))
    return per.crossJoin(total).select(key, "n_all", "n_flag", (F.col("n_flag") - F.col("p") * F.col("n_all")).alias("excess"))  # one row


def mode_label(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """Most frequent label of a group, the smaller of equals, and its share (OP-131): two aggregations, no window."""
    c = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("n"))
    m = c.groupBy(*group).agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("mode"))
    return m.select(*group, "mode", (F.col("top") / F.col("all")).alias("share"))


def error_metrics(df: DataFrame, truth: str, est: str, by: list[str], within: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """n, coverage, bias, median and mean absolute error, rmse and shares within k (OP-134)."""
    e = F.col(est) - F.col(truth)
    d = df.where(F.col(truth).isNotNull()).withColumn("__e", e)
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.count("__e").alias("covered"), F.avg("__e").alias("bias"), F.median("__e").alias("median_error"), F.avg(F.abs("__e")).alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), *[F.avg((F.abs("__e") <= k).cast("int")).alias(f"within_{k}") for k in within])


def hhi(df: DataFrame, group: list[str], label: str) -> DataFrame:
    c = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("n"))
    return c.groupBy(*group).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, raw agreement and Cohen's kappa of two codings; rows with a missing code don't count (OP-138)."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra = c.groupBy("a").agg(F.sum("n").alias("na"))
    rb = c.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, "a").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("s"))
    seen = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    j = seen.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("s", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return j.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def precision_table(df: DataFrame, verdict: str, by: list[str]) -> DataFrame:
    """Per stratum: yes, no, unsure, precision without the unsure and its Wilson interval (OP-139, OP-142)."""
    v = F.lower(F.trim(F.col(verdict)))
    out = df.groupBy(*by).agg(F.count_if(v == "y").alias("yes"), F.count_if(v == "n").alias("no"), F.count_if(v == "u").alias("unsure"))
    p, a, b = wilson("yes", F.col("yes") + F.col("no"))
    return out.select(*by, "yes", "no", "unsure", p.alias("precision"), a.alias("lo"), b.alias("hi"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, adjusted Rand index and share of agreeing pairs of two partitions (OP-143), from the contingency table."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda x: (F.col(x).cast("double") * (F.col(x) - 1) / 2)
    cells = c.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n"))
    ra = c.groupBy(a).agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("sa"))
    rb = c.groupBy(b).agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("sb"))
    j = cells.crossJoin(ra).crossJoin(rb).withColumn("all", F.col("n").cast("double") * (F.col("n") - 1) / 2)  # one row each
    exp = F.col("sa") * F.col("sb") / F.col("all")
    top = (F.col("sa") + F.col("sb")) / 2
    return j.select("n", F.when(top != exp, (F.col("s") - exp) / (top - exp)).otherwise(1.0).alias("ari"), ((F.col("all") + 2 * F.col("s") - F.col("sa") - F.col("sb")) / F.col("all")).alias("pair_agreement"))


def unchanged_mates(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and rows whose group has exactly the same members in both partitions (OP-144)."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("j"))
    ca, cb = c.groupBy(a).agg(F.sum("j").alias("na")), c.groupBy(b).agg(F.sum("j").alias("nb"))
    j = c.join(ca, a).join(cb, b)
    return j.agg(F.sum("j").alias("n"), F.sum(F.when((F.col("j") == F.col("na")) & (F.col("j") == F.col("nb")), F.col("j")).otherwise(0)).alias("unchanged"))


def terciles(df: DataFrame, x: str) -> DataFrame:
    """df with tercile 1..3 by the exact 33rd and 67th percentiles (OP-147)."""
    q = df.agg(F.percentile(x, 0.33).alias("__a"), F.percentile(x, 0.67).alias("__b"))
    return df.crossJoin(q).withColumn("tercile", F.when(F.col(x) <= F.col("__a"), 1).when(F.col(x) <= F.col("__b"), 2).when(F.col(x).isNotNull(), 3)).drop("__a", "__b")  # one row


def boot_summary(draws: DataFrame, x: str = "stat") -> DataFrame:
    """One row: robust sd (1.4826 MAD), percentile interval, two-sided p not below 1/B (OP-148)."""
    m = draws.agg(F.median(x).alias("m"))
    d = draws.crossJoin(m)  # one row
    below, above = F.avg((F.col(x) <= 0).cast("double")), F.avg((F.col(x) >= 0).cast("double"))
    return d.agg(F.count(x).alias("B"), (1.4826 * F.median(F.abs(F.col(x) - F.col("m")))).alias("robust_sd"), F.percentile(x, 0.025).alias("lo"), F.percentile(x, 0.975).alias("hi"), F.greatest(2 * F.least(below, above), 1 / F.count(x)).alias("p"))


def perm_summary(draws: DataFrame, observed: float, x: str = "stat") -> DataFrame:
    """One row: mean, sd, z of the observed value and p = (1 + #) / (1 + n) (OP-149)."""
    return draws.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count_if(F.abs(F.col(x)) >= abs(observed)).alias("k")).select("n", "mean", "sd", ((F.lit(observed) - F.col("mean")) / F.col("sd")).alias("z"), ((1 + F.col("k")) / (1 + F.col("n"))).alias("p"))


def summary_table(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Long rows (by, variable, n, mean, sd, median, share_positive, median_positive, p90_positive, max) (OP-149a)."""
    by = by or []
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])).alias("v")).select(*by, "v.*")
    pos = F.when(F.col("x") > 0, F.col("x"))
    return long.groupBy(*by, "variable").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.median("x").alias("median"), F.avg((F.col("x") > 0).cast("int")).alias("share_positive"), F.median(pos).alias("median_positive"), F.percentile(pos, 0.9).alias("p90_positive"), F.max("x").alias("max"))


def profile(df: DataFrame, d: str, lo: int, hi: int) -> DataFrame:
    """(depth, weight): shares of the distances in [lo, hi] (OP-149b)."""
    c = df.where(F.col(d).between(lo, hi)).groupBy(F.col(d).alias("depth")).agg(F.count("*").alias("n"))
    return c.crossJoin(c.agg(F.sum("n").alias("t"))).select("depth", (F.col("n") / F.col("t")).alias("weight"))  # one row


def distance_summary(df: DataFrame, kind: list[str], d: str, cap: int = 15) -> DataFrame:
    """Per kind: n, share reachable, mean and median of those, and of those above one (OP-149c)."""
    ok = F.when(F.col(d) <= cap, F.col(d))
    return df.groupBy(*kind).agg(F.count("*").alias("n"), F.avg((F.col(d) <= cap).cast("int")).alias("reachable"), F.avg(ok).alias("mean"), F.median(ok).alias("median"), F.avg(F.when(F.col(d) > 1, ok)).alias("mean_beyond_1"))


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, known, share) (OP-149d)."""
    wide = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in cols])
    return wide.unpivot(["__n"], cols, "column", "known").select("column", F.col("__n").alias("n"), "known", F.when(F.col("__n") > 0, F.col("known") / F.col("__n")).alias("share"))


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with z_<col>: centred and scaled by the sample's own mean and sd (OP-057), from one aggregated row."""
    s = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))])
    out = df.crossJoin(s)  # one row
    return out.select(*df.columns, *[((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).alias("z_" + c) for c in cols])


def fill_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL replaced by the column's median (OP-059)."""
    s = df.agg(*[F.median(c).alias(f"__m_{c}") for c in cols])
    return df.crossJoin(s).select(*[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])  # one row


def cumulative_share(df: DataFrame, order: str, x: str) -> DataFrame:
    """Per value of a low-cardinality order column the running share of x."""
    c = df.groupBy(order).agg(F.sum(x).alias("s"))
    return c.select(order, (F.sum("s").over(W.orderBy(order)) / F.sum("s").over(W.partitionBy())).alias("share"))
