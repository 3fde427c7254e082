"""Joins, set operations, filters and shape changes."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.runtime import checkpoint

# ---- filters


def filter_multimatch(df: DataFrame, key: str, birth: str, lo: int = 800, hi: int = 1050) -> DataFrame:
    """Of keys with several rows only those whose birth is NULL or in [lo, hi]; single rows stay (OP-073)."""
    n = F.count("*").over(W.partitionBy(key))
    return df.withColumn("__n", n).where((F.col("__n") == 1) | F.col(birth).isNull() | F.col(birth).between(lo, hi)).drop("__n")


def min_year(df: DataFrame, y: str, lo: int = 50) -> tuple[DataFrame, DataFrame]:
    """Rows from year lo on, and one row of counts of what was dropped (OP-074)."""
    metrics = df.agg(F.count_if(F.col(y).isNull()).alias("no_year"), F.count_if(F.col(y) < lo).alias("too_early"), F.count("*").alias("all"))
    return df.where(F.col(y) >= lo), metrics


def prune(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows without the excluded ids (OP-075)."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def min_support(df: DataFrame, keys: list[str], k: int, where: Column | None = None) -> DataFrame:
    """Rows of groups with at least k (matching) rows (OP-078)."""
    n = df if where is None else df.where(where)
    return df.join(n.groupBy(*keys).count().where(F.col("count") >= k).select(*keys), keys, "left_semi")


# ---- joins


def attach(df: DataFrame, *features: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Features joined one after the other (OP-080 to OP-082); names that clash are told apart by a suffix."""
    keys = [on] if isinstance(on, str) else on
    out = df
    for i, f in enumerate(features):
        taken = {c.lower() for c in out.columns} - {k.lower() for k in keys}
        f = f.select(*[F.col(c).alias(f"{c}_{i + 1}" if c.lower() in taken else c) for c in f.columns])
        out = out.join(f, keys, how)
    return out


def resolve_parents(parent_order: DataFrame, sex: DataFrame) -> DataFrame:
    """(child_id, father_id, mother_id): the first parent of the sex, in the order given (OP-083, OP-084)."""
    s0 = sex.select(F.col("id").alias("parent0_id"), F.col("sex").alias("s0"))
    s1 = sex.select(F.col("id").alias("parent1_id"), F.col("sex").alias("s1"))
    both = parent_order.join(s0, "parent0_id", "left").join(s1, "parent1_id", "left")
    pick = lambda s: F.coalesce(F.when(F.col("s0") == s, F.col("parent0_id")), F.when(F.col("s1") == s, F.col("parent1_id")))
    return both.select("child_id", pick("M").alias("father_id"), pick("F").alias("mother_id"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(child_id, father_id, mother_id, mgf_id): two levels of parents by self-join (OP-083)."""
    up = parents.select(F.col("child_id").alias("mother_id"), F.col("father_id").alias("mgf_id"))
    return parents.join(up, "mother_id", "left").select("child_id", "father_id", "mother_id", "mgf_id")


def role_join(df: DataFrame, dim: DataFrame, roles: dict[str, str], key: str = "id") -> DataFrame:
    """The same table joined once per role; its columns get the role as prefix (OP-085). roles: prefix -> key of df."""
    out = df
    for prefix, col in roles.items():
        out = out.join(dim.select(*[F.col(c).alias(col if c == key else f"{prefix}_{c}") for c in dim.columns]), col, "left")
    return out


def closed_set_split(rows: DataFrame, allowed: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose composite key is allowed, and the others (OP-087, OP-088)."""
    keys = allowed.select(*on).distinct()
    return rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, k: int = 15, width: int = 25, on: list[str] | None = None) -> DataFrame:
    """Points joined with the closed intervals that meet [at - k, at + k] (OP-089, OP-091).

    An interval stands in every bin of its own years, a point in the bins of its window; a pair that meets in several
    bins is kept in the first only, so no distinct is needed. NULL ends never meet. Column names have to differ
    apart from on.
    """
    on = on or []
    p = points.where(F.col(at).isNotNull()).withColumn("__lo", (F.col(at) - k)).withColumn("__hi", (F.col(at) + k))
    p = p.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    i = intervals.where(F.col(start).isNotNull() & F.col(stop).isNotNull() & (F.col(start) <= F.col(stop)))
    i = i.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    # bins that hold much of the points are split over several tasks
    out = salted_join(p, i, ["__bin", *on]).where((F.col(start) <= F.col("__hi")) & (F.col(stop) >= F.col("__lo")))
    first = F.floor(F.greatest(F.col("__lo"), F.col(start)) / width)
    return out.where(F.col("__bin") == first).drop("__bin", "__lo", "__hi")


def alive_at(df: DataFrame, persons: DataFrame, y: str, birth: str = "birth", death: str = "death", width: int = 25) -> DataFrame:
    """Rows joined with the persons born before the year and not dead before it (OP-091)."""
    return range_join(df, persons, y, birth, death, 0, width).where(F.col(birth) < F.col(y))


def range_totals(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, key: str, k: int = 15, width: int = 25, born_before: bool = False) -> DataFrame:
    """Points with n, the number of the intervals that range_join meets them with, and first_<key>, the least key of these
    (OP-089, OP-091). born_before: only of those that start before the point. Points without an interval are left out.

    Points of one time have the same intervals, and intervals of one start and stop the same points, so the join sees each
    time and each pair of ends once; nothing grows with the pairs of rows.
    """
    first = f"first_{key}"
    spans = intervals.groupBy(F.col(start).alias("__start"), F.col(stop).alias("__stop")).agg(F.count("*").alias("__n"), F.min(key).alias("__first"))
    met = range_join(points.select(F.col(at).alias("__at")).distinct(), spans, "__at", "__start", "__stop", k, width)
    if born_before:
        met = met.where("__start < __at")
    per = met.groupBy("__at").agg(F.sum("__n").alias("n"), F.min("__first").alias(first))
    return points.join(per, points[at] == per["__at"]).select(*points.columns, "n", first)


def asof_interval(df: DataFrame, dim: DataFrame, at: str, start: str, stop: str, value: str) -> DataFrame:
    """df with the value of the interval that holds the time, the latest-started one; if none does, of the one that ended
    last before it; else NULL (OP-090). Two sort-merge style passes over the union, no range blow-up."""
    events = df.select(*df.columns).withColumn("__id", F.monotonically_increasing_id())
    a = events.select("__id", F.col(at).alias("__t")).where("__t IS NOT NULL")
    d = dim.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(F.col(start).alias("__s"), F.col(stop).alias("__e"), F.col(value).alias("__v"))
    inside = range_join(a, d, "__t", "__s", "__e", 0).groupBy("__id").agg(F.max_by("__v", F.struct("__s", "__v")).alias("__in"))
    ends = d.groupBy("__e").agg(F.max("__v").alias("__v"))
    # the last end before a time: years are few, so the table of (year, value) is made once per year and joined
    years = a.select(F.col("__t")).distinct().select(F.col("__t").alias("y"), F.lit(None).cast(dict(dim.dtypes)[value]).alias("v"), F.lit(0).alias("k"))
    marks = ends.select(F.col("__e").alias("y"), F.col("__v").alias("v"), F.lit(1).alias("k")).union(years)
    last = marks.withColumn("f", F.last("v", ignorenulls=True).over(W.orderBy("y", "k").rowsBetween(W.unboundedPreceding, W.currentRow))).where("k = 0").select(F.col("y").alias("__t"), F.col("f").alias("__before"))
    out = events.join(inside, "__id", "left").join(last, events[at] == F.col("__t"), "left")
    return out.select(*df.columns, F.coalesce("__in", "__before").alias(value))


def name_lookup(names: DataFrame, persons: DataFrame, name: str = "name") -> DataFrame:
    """names with the ids of persons of exactly that name, else of that name trimmed (OP-092)."""
    exact = persons.groupBy(F.col("name").alias("__n")).agg(F.min("id").alias("__exact"))
    trimmed = persons.groupBy(F.trim("name").alias("__t")).agg(F.min("id").alias("__trim"))
    out = names.join(exact, names[name] == F.col("__n"), "left").join(trimmed, F.trim(names[name]) == F.col("__t"), "left")
    return out.select(*names.columns, F.coalesce("__exact", "__trim").alias("id"), F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__trim").isNotNull(), "trimmed").alias("tier"))


def label_endpoints(edges: DataFrame, labels: DataFrame, a: str = "a", b: str = "b", label: str = "label") -> DataFrame:
    """Edges with the labels of both ends (OP-093)."""
    la = labels.select(F.col("id").alias(a), F.col(label).alias("label_a"))
    lb = labels.select(F.col("id").alias(b), F.col(label).alias("label_b"))
    return edges.join(la, a, "left").join(lb, b, "left")


def pairs_in_group(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(a, b, value): unordered pairs of members of a group, with the least value over their groups (OP-094).

    Members are distinct per group first. The result is as large as the pairs; where a group may be hot, give
    groups of bounded size.
    """
    d = df.where(F.col(member).isNotNull() & F.col(group).isNotNull()).groupBy(group, member).agg(F.min(value).alias("v"))
    a, b = d.select(group, F.col(member).alias("a"), F.col("v").alias("va")), d.select(group, F.col(member).alias("b"), F.col("v").alias("vb"))
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.min(F.least("va", "vb")).alias("value"))


def spread_left_join(df: DataFrame, right: DataFrame, on: list[str], by: str, parts: int = 256) -> DataFrame:
    """Left join whose rows with a NULL key, which match nothing, are spread by a hash of another column.

    A shuffle would send all of them to one task.
    """
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    left = df.withColumn("__spread", F.when(null, F.pmod(F.xxhash64(by), F.lit(parts)) + 1).otherwise(F.lit(0).cast("long")))
    return left.join(right.withColumn("__spread", F.lit(0).cast("long")), [*on, "__spread"], "left").drop("__spread")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], rows_per_task: int = 100_000) -> DataFrame:
    """Inner equi-join in which a hot key of the left side is split over several tasks.

    Keys with more than rows_per_task left rows are counted first; there are at most rows / rows_per_task of them, so
    their table is small whatever the data. Their left rows are spread by a hash of the row, their right rows repeated
    once per part; all other keys join as usual.
    """
    hot = left.groupBy(*on).count().where(F.col("count") > rows_per_task).select(*on, F.ceil(F.col("count") / rows_per_task).cast("int").alias("__parts"))
    hot = checkpoint(hot)
    if hot.isEmpty():
        return left.join(right, on)
    hot = F.broadcast(hot)
    a = left.join(hot, on, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("__parts")).cast("int"))).drop("__parts")
    b = right.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return a.join(b, [*on, "__part"]).drop("__part")


def full_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "full_outer")


def pick_columns(df: DataFrame, wanted: dict[str, list[str]]) -> list[Column]:
    """For each name the first of its candidates that df has, renamed (OP-062); it is an error if df has none."""
    out = []
    for name, candidates in wanted.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found is None:
            raise ValueError(f"none of {candidates} for {name}")
        out.append(F.col(found).alias(name))
    return out


def drop_levels(df: DataFrame, col: str, levels: list | None = None) -> DataFrame:
    """Rows without the given levels of a column, or without its most frequent one, the least of equals (OP-076). Rows
    with NULL stay."""
    if levels is None:
        largest = df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(1).collect()  # one row
        levels = [r[0] for r in largest]
    return df.where(F.col(col).isNull() | ~F.col(col).isin(levels)) if levels else df


def grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of fixed lists (OP-095)."""
    return spark.createDataFrame(list(product(*axes.values())), ", ".join(f"{a} string" for a in axes))


def locate(anchors: DataFrame, persons: DataFrame, name: str) -> DataFrame:
    """Anchors (id, name, ...) with found_id, the person (id, name) of that name, and a status: same id, other id,
    several persons of the name (the least id is given), missing; id_known tells whether the anchor's own id is a
    person's (OP-176)."""
    by_name = persons.groupBy(F.col("name").alias("__name")).agg(F.count("*").alias("__n"), F.min("id").alias("found_id"))
    ids = persons.select("id").distinct().withColumn("id_known", F.lit(True))
    j = anchors.withColumn("__name", F.trim(name)).join(by_name, "__name", "left").join(ids, "id", "left")
    status = F.when(F.col("found_id").isNull(), "missing").when(F.col("__n") > 1, "several").when(F.col("found_id") == F.col("id"), "same").otherwise("other")
    return j.withColumn("status", status).withColumn("id_known", F.coalesce("id_known", F.lit(False))).drop("__name", "__n")


def null_pairs(dyads: DataFrame, persons: DataFrame, k: int, seed: int, year: str = "year") -> DataFrame:
    """(dyad_id, draw, a, b): k pairs of different persons alive in the year of each dyad, drawn by hash (OP-097).

    The living of each year are numbered once, in buckets of a hash, so no year is sorted in one task; a draw picks two
    numbers and looks them up. Dyads whose year has fewer than two living persons give no pair.
    """
    alive = alive_at(dyads.select(year).distinct(), persons.select("id", "birth", "death"), year).select(year, "id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(256)).alias("part"))
    alive = checkpoint(alive.withColumn("r", F.row_number().over(W.partitionBy(year, "part").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("id"))), "id"))))
    sizes = alive.groupBy(year, "part").agg(F.count("*").alias("m"))
    w = W.partitionBy(year)
    starts = sizes.withColumn("start", F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("m").over(w))
    numbered = checkpoint(alive.join(starts, [year, "part"]).select(year, "id", (F.col("start") + F.col("r") - 1).alias("no")))
    draws = dyads.select("dyad_id", year).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k)))).join(starts.select(year, "n").distinct(), year).where("n >= 2")
    mark = lambda side: F.xxhash64(F.lit(seed), F.col("dyad_id"), F.col("draw"), F.lit(side))
    draws = draws.withColumn("i", F.pmod(mark(0), F.col("n"))).withColumn("j", F.pmod(mark(1), F.col("n") - 1))
    draws = draws.withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("int"))  # never the first one again
    of = lambda no, name: numbered.select(year, F.col("no").alias(no), F.col("id").alias(name))
    both = draws.join(of("i", "x"), [year, "i"]).join(of("j", "y"), [year, "j"])
    return both.select("dyad_id", "draw", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pending(inputs: DataFrame, outputs: DataFrame, on: str, n: int | None = None) -> DataFrame:
    """Inputs without an output, in key order, the first n if asked (OP-098)."""
    out = inputs.join(outputs.select(on).distinct(), on, "left_anti").orderBy(on)
    return out if n is None else out.limit(n)


def enrich(df: DataFrame, dim: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with defaults for what is missing (OP-099)."""
    out = df.join(dim, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# ---- sets


def union_claims(*claims: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, claims).distinct()


def stack(frames: list[DataFrame], allow_missing: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def set_sizes(a: Column, b: Column) -> list[Column]:
    """Sizes of a minus b, b minus a, both, either of two array columns (OP-103)."""
    return [F.size(F.array_except(a, b)).alias("only_a"), F.size(F.array_except(b, a)).alias("only_b"), F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either")]


def key_diff(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys with new, removed or common (OP-105)."""
    a, b = left.select(*on).distinct().withColumn("l", F.lit(1)), right.select(*on).distinct().withColumn("r", F.lit(1))
    return a.join(b, on, "full_outer").select(*on, F.when(F.col("l").isNull(), "new").when(F.col("r").isNull(), "removed").otherwise("common").alias("status"))


def universe(sources: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """All ids with one 0/1 column per source (OP-106), in one aggregation."""
    tagged = reduce(DataFrame.union, [d.select(F.col(key).alias(key), F.lit(n).alias("s")) for n, d in sources.items()])
    return tagged.groupBy(key).agg(*[F.max((F.col("s") == n).cast("int")).alias("in_" + n) for n in sources])


def overlap_cells(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of both, only a, only b, neither (OP-107)."""
    cell = F.when(a & b, "both").when(a, "a_only").when(b, "b_only").otherwise("neither")
    return df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


# ---- windows and shape


def first_in_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("__r = 1").drop("__r")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (OP-132). Spark prunes with a partial top-k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def group_back(df: DataFrame, group: list[str], x: str, how: str = "avg") -> DataFrame:
    """An aggregate of a group joined back to its rows (OP-146, OP-150): aggregated first, so a hot group is no burden."""
    agg = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how]
    return df.join(df.groupBy(*group).agg(agg(x).alias(f"{how}_{x}")), group, "left")


def permute_within(df: DataFrame, cell: list[str], key: str, col: str, seed: int, draw: int) -> DataFrame:
    """(key, cell, col_permuted): a column shuffled within cells by hash order (OP-151)."""
    natural = F.row_number().over(W.partitionBy(*cell).orderBy(key))
    shuffled = F.row_number().over(W.partitionBy(*cell).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit(draw), F.col(key).cast("string"))), key))
    a = df.select(*cell, key, natural.alias("rn"))
    b = df.select(*cell, F.col(col).alias(col + "_permuted"), shuffled.alias("rn"))
    return a.join(b, [*cell, "rn"]).drop("rn")


def with_row_no(df: DataFrame, order: list[Column]) -> DataFrame:
    """A row number without gaps in a given order (OP-155), in two levels: counts per range partition, then within."""
    # written once: the ranges are sampled, and both uses have to see the same ones
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("m0"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(starts.select("__p", "start", "m0")), "__p").withColumn("row_no", F.col("start") + F.col("__m") - F.col("m0")).drop("__p", "__m", "start", "m0")


def wide_to_long(df: DataFrame, key: str, prefix: str, n: int, suffix: str = "_link", value: str = "value") -> DataFrame:
    """(key, position, value) of prefix0..prefixN columns, blanks dropped (OP-112)."""
    cols = [f"{prefix}{i}{suffix}" for i in range(n) if f"{prefix}{i}{suffix}" in df.columns]
    long = df.select(key, F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("position", value))
    return long.where(F.length(F.trim(value)) > 0)
