"""Mixing sources to target weights by entropy balancing.

Every document of a source gets the rate min(max_repeats, exp(lambda_s * x)), x being its tokens over the mean of the
corpus: the rates nearest to one (in relative entropy) under which the source has its tokens. The multipliers solve a
convex dual; Newton's method on it needs two sums per source and round, with bisection as a safeguard. A rate depends on
source and size only, so the documents are counted by these once and the rounds run on the counts. Rates become whole copies by systematic sampling along documents of like size, so the
tokens that a source gets differ from its target by a few documents only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm import tokens
from kinweave.runtime import checkpoint


@dataclass
class Multiplier:
    source: str
    target: float
    cap: int
    reachable: bool
    lam: float = 0.0
    lo: float = -64.0
    hi: float = 64.0
    done: bool = False


def _rate(lam: Column, cap: Column, x: Column) -> Column:
    return F.least(cap.cast("double"), F.exp(F.least(lam * x, F.lit(50.0))))


def balance(sized: DataFrame, targets: list[tuple[str, float, int]], total_tokens: float | None = None, tolerance: float = 1e-6, max_rounds: int = 500, least_used: float = 0.0) -> tuple[list[Multiplier], float, float]:
    """Multipliers per source, the total aimed at and the mean size, for documents (source, n_tokens).

    total_tokens: tokens of the mixture; by default the most with which every source that has tokens reaches its
    share, or least_used times the tokens of the sources if that is more. A source whose documents times max_repeats can't give its share is used in full and marked. The driver
    holds one row per source of the targets.
    """
    wanted = F.broadcast(sized.sparkSession.createDataFrame([(s,) for s, _, _ in targets], "source string").distinct())  # one row per target
    sizes = checkpoint(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")).join(wanted, "source"))
    sums = {r["source"]: (r["n"], float(r["t"] or 0)) for r in sizes.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("n_tokens") * F.col("docs")).alias("t")).collect()}
    n, t = sum(a for a, _ in sums.values()), sum(b for _, b in sums.values())
    mean = t / n if n and t else 1.0
    have = {s: sums.get(s, (0, 0.0))[1] * cap for s, _, cap in targets}
    if total_tokens is None:
        total_tokens = min((have[s] / share for s, share, _ in targets if share > 0 and have[s] > 0), default=0.0)
        total_tokens = max(total_tokens, least_used * t)
    state = []
    for s, share, cap in targets:
        want = share * total_tokens
        ok = have[s] >= want * (1 - 1e-9) and have[s] > 0
        state.append(Multiplier(s, want, cap, ok, lam=0.0, done=have[s] <= 0))
    for m in state:
        if not m.done and have[m.source] <= m.target * (1 + 1e-9):
            m.lam, m.done = 64.0, True  # in full
        if not m.done and m.target <= 0:
            m.lam, m.done = -64.0, True
    spark = sized.sparkSession
    for _ in range(max_rounds):
        open_ = [m for m in state if not m.done]
        if not open_:
            break
        lam = F.broadcast(spark.createDataFrame([(m.source, m.lam, m.cap) for m in open_], "source string, lam double, cap int"))
        x = F.col("n_tokens") / F.lit(mean)
        r = _rate(F.col("lam"), F.col("cap"), x)
        free = F.exp(F.least(F.col("lam") * x, F.lit(50.0))) < F.col("cap")
        got = {g["source"]: g for g in sizes.join(lam, "source").groupBy("source").agg(F.sum(r * F.col("n_tokens") * F.col("docs")).alias("f"), F.sum(F.when(free, r * F.col("n_tokens") * x * F.col("docs")).otherwise(0.0)).alias("h")).collect()}
        for m in open_:
            f, h = got[m.source]["f"], got[m.source]["h"]
            gap = m.target - f
            if abs(gap) <= tolerance * max(m.target, 1.0) or m.hi - m.lo < 1e-12:
                m.done = True
                continue
            m.lo, m.hi = (m.lam, m.hi) if gap > 0 else (m.lo, m.lam)
            step = m.lam + gap / h if h > 0 else math.inf
            m.lam = step if m.lo < step < m.hi else (m.lo + m.hi) / 2
    if not all(m.done for m in state):
        raise RuntimeError(f"no balance after {max_rounds} rounds")
    return state, total_tokens, mean


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", total_tokens: float | None = None, vocabulary: str = tokens.VOCABULARY, cell_rows: int = 20_000, least_used: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(copies, report): copies has (key, source, n_tokens, rate, copies), report one row per source.

    Documents without tokens (NULL, empty text) get one copy at rate one and no share; documents of a source that isn't
    in targets, or of none, get no copies. A target without documents, or one that can't be reached with max_repeats,
    is reported with reachable = false. report: source, target_share, max_repeats, docs, tokens, mixed_tokens,
    actual_share, used_share (of the tokens of the source, those in at least one copy), max_copies, reachable. Where one
    scarce source leaves most of the corpus unused, least_used sets the least share of it that the total has to come to;
    the scarce source is then used in full and reported as not reachable. Empty tables give an empty mixture.
    """
    sized = tokens.count_tokens(docs.select(F.col(key).alias("k"), "source", F.col(text).alias("t")), "t").select("k", "source", "n_tokens")
    sized = checkpoint(sized)
    goal = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats >= 1").distinct().collect()]
    state, _, mean = balance(sized, goal, total_tokens, least_used=least_used)
    spark = docs.sparkSession
    lam = F.broadcast(spark.createDataFrame([(m.source, m.lam, m.cap, m.reachable) for m in state], "source string, lam double, cap int, reachable boolean"))
    rated = sized.join(lam, "source", "left").withColumn("rate", F.when(F.col("cap").isNull(), 0.0).when(F.col("n_tokens") == 0, 1.0).otherwise(_rate(F.col("lam"), F.col("cap"), F.col("n_tokens") / F.lit(mean))))
    # systematic sampling: documents in order of size, then of hash; running sums of the fractions in two levels
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate")).withColumn("size", F.floor(F.log2(F.col("n_tokens") + 1) * 8)).withColumn("mark", F.xxhash64("k"))
    n = max(1, sized.count())
    fine = max(1, math.ceil(n / cell_rows))
    rated = rated.withColumn("cell", F.pmod("mark", F.lit(fine)))
    cells = rated.groupBy("source", "size", "cell").agg(F.sum("part").alias("s"))
    before = F.coalesce(F.sum("s").over(W.partitionBy("source", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    by_size = cells.groupBy("source", "size").agg(F.sum("s").alias("s2"))
    by_size = by_size.withColumn("ahead", F.coalesce(F.sum("s2").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    starts = cells.withColumn("inside", before).join(by_size, ["source", "size"]).select("source", "size", "cell", (F.col("inside") + F.col("ahead")).alias("start"))
    own = F.coalesce(F.sum("part").over(W.partitionBy("source", "size", "cell").orderBy("mark", "k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = rated.withColumn("own", own).join(starts, ["source", "size", "cell"], "left")
    at = F.coalesce("start", F.lit(0.0)) + F.col("own") + 0.5
    extra = F.floor(at + F.col("part") + 1e-9) - F.floor(at + 1e-9)
    copies = placed.select(F.col("k").alias(key), "source", "n_tokens", "rate", F.when(F.col("cap").isNull(), 0).otherwise(F.least(F.col("whole") + extra, F.col("cap"))).cast("int").alias("copies"))
    copies = checkpoint(copies)
    per = copies.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum(F.when(F.col("copies") > 0, F.col("n_tokens")).otherwise(0)).alias("used"), F.max("copies").alias("max_copies"))
    want = spark.createDataFrame([(m.source, s, m.cap, m.reachable) for m, (_, s, _) in zip(state, goal, strict=True)], "source string, target_share double, max_repeats int, reachable boolean")
    whole = per.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = want.join(per, "source", "full").crossJoin(whole)  # whole has one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = report.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", zero("docs"), zero("tokens"), zero("mixed_tokens"), F.when(F.col("all_tokens") > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), F.when(F.col("tokens") > 0, F.col("used") / F.col("tokens")).otherwise(0.0).alias("used_share"), zero("max_copies"), F.coalesce("reachable", F.lit(False)).alias("reachable"))
    return copies, report
