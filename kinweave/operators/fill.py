"""Filling missing values from similar records, with provenance.

Three layers, each applied only to cells the former left open:

1. *functional dependencies*: determinant sets are mined level by level from the columns of the complete records (single
   columns, then pairs, ...); a set is verified for a target if, of the records that share its values with another
   record, at least min_confidence lie in groups whose targets all agree (within a tolerance, for years). A superset of
   a verified set is not looked at, nor one of a set that too few records share. The verified sets become dictionaries
   determinant -> value, which are left-joined to the missing cells;
2. *group fallback*: relatives (children, parents, spouses, siblings, shifted by generation gaps mined from the
   complete records), the record's own other year (shifted by the mined life span), the dynasty, everybody;
3. flags of filled years are 1, other missing flags take the value of the dictionary or of the group.

All parents, children and spouses of a person count as a set each, by a fingerprint that is summed up, so no family is
gathered in one place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.relational import spread_left_join
from kinweave.runtime import checkpoint


@dataclass(frozen=True)
class Dependency:
    """determinants -> target."""

    determinants: tuple[str, ...]
    target: str


@dataclass(frozen=True)
class Verified:
    dependency: Dependency
    confidence: float
    groups: int


def _keyed(df: DataFrame, sets: list[tuple[str, ...]], keep: list[str]) -> DataFrame:
    """A row for each record and set of columns that are all known: set_no, two hashes of the columns' values, keep."""
    known = lambda x: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in x])
    one = [F.when(known(x), F.struct(F.lit(i).alias("set_no"), F.xxhash64(*x).alias("h1"), F.xxhash64(F.lit(1), *x).alias("h2"))) for i, x in enumerate(sets)]
    return df.select(*keep, F.explode(F.filter(F.array(*one), lambda e: e.isNotNull())).alias("e")).select(*keep, "e.*")


def _statistics(df: DataFrame, sets: list[tuple[str, ...]], targets: dict[str, float]) -> dict[tuple[int, str], tuple[int, int, int]]:
    """(number of the set, target) -> groups of two or more complete records, records in them, those in groups that
    agree. One pass for all sets and targets; a row for each set comes to the driver."""
    groups = _keyed(df, sets, list(targets)).groupBy("set_no", "h1", "h2")
    groups = groups.agg(*[f(t).alias(f"{t}_{n}") for t in targets for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    shared = lambda t: F.col(f"{t}_n") > 1
    agree = lambda t, tol: shared(t) & (F.col(f"{t}_hi") - F.col(f"{t}_lo") <= tol)
    cols = []
    for t, tol in targets.items():
        n = F.col(f"{t}_n")
        cols += [F.count_if(shared(t)).alias(f"{t}_g"), F.sum(F.when(shared(t), n).otherwise(0)).alias(f"{t}_r"), F.sum(F.when(agree(t, tol), n).otherwise(0)).alias(f"{t}_a")]
    return {(r["set_no"], t): (r[f"{t}_g"], r[f"{t}_r"], r[f"{t}_a"]) for r in groups.groupBy("set_no").agg(*cols).collect() for t in targets}


def mine_dependencies(df: DataFrame, columns: list[str], targets: dict[str, float], trivial: dict[str, set[str]] | None = None, max_size: int = 2, min_confidence: float = 0.9, min_groups: int = 5) -> list[Verified]:
    """The minimal dependencies that hold, best first, by a level-wise search over the sets of columns.

    targets: target -> tolerance (0: values must be equal). trivial: target -> columns made from it, which are no
    determinants of it. A set is dropped, with all that contain it, when fewer than 2 * min_groups records share its
    values. Levels end at max_size.
    """
    trivial = {t: (trivial or {}).get(t, set()) | {t} for t in targets}
    found: dict[str, list[Verified]] = {t: [] for t in targets}
    level: list[tuple[str, ...]] = [(c,) for c in columns]
    for size in range(1, max_size + 1):
        if not level:
            break
        stats = _statistics(df, level, targets)
        alive = set()
        for i, x in enumerate(level):
            for t in targets:
                groups, rows, agree = stats.get((i, t), (0, 0, 0))
                if trivial[t] & set(x) or any(set(v.dependency.determinants) <= set(x) for v in found[t]):
                    continue
                if groups >= min_groups and agree >= min_confidence * rows:
                    found[t].append(Verified(Dependency(x, t), agree / rows, groups))
                elif rows >= 2 * min_groups:
                    alive.add(x)  # a larger set may still hold
        grown = {tuple(sorted({*x, c}, key=columns.index)) for x in alive for c in columns if c not in x}
        level = sorted(x for x in grown if all(y in alive for y in combinations(x, size)) and not any(set(x) <= trivial[t] for t in targets))
    return sorted((v for vs in found.values() for v in vs), key=lambda v: (-v.confidence, -v.groups, v.dependency.determinants, v.dependency.target))


def fill_by_dependencies(df: DataFrame, verified: list[Verified], targets: dict[str, float], key: str = "id") -> DataFrame:
    """Adds for each target {target}_filled and {target}_source ('observed', 'fd:a,b', or NULL where no dictionary knows
    the value). A dictionary has the groups whose complete records agree; their mean is the value. Of several that know
    a value, the one of higher confidence counts. All dictionaries are one table, joined once to the missing cells."""
    observed = [x for t in targets for x in (F.col(t).alias(f"{t}_filled"), F.when(F.col(t).isNotNull(), F.lit("observed")).alias(f"{t}_source"))]
    if not verified:
        return df.select("*", *observed)
    sets = [v.dependency.determinants for v in verified]
    target = [v.dependency.target for v in verified]
    label = F.create_map(*[x for i, v in enumerate(verified) for x in (F.lit(i), F.lit("fd:" + ",".join(v.dependency.determinants)))])
    value = lambda: F.element_at(F.create_map(*[x for i, t in enumerate(target) for x in (F.lit(i), F.col(t).cast("double"))]), F.col("set_no"))
    tol = F.element_at(F.create_map(*[x for i, t in enumerate(target) for x in (F.lit(i), F.lit(float(targets[t])))]), F.col("set_no"))
    rows = _keyed(df, sets, [key, *targets]).select(key, "set_no", "h1", "h2", value().alias("x"))
    known = rows.where("x IS NOT NULL").groupBy("set_no", "h1", "h2").agg(F.avg("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).where(F.col("hi") - F.col("lo") <= tol)
    cells = rows.where("x IS NULL").select(key, "set_no", "h1", "h2").join(known, ["set_no", "h1", "h2"]).select(key, "set_no", F.bround("v").cast("int").alias("v"))
    # the numbers of the sets go by confidence
    best = cells.groupBy(key).agg(*[F.min(F.when(F.col("set_no").isin([i for i, u in enumerate(target) if u == t]), F.struct("set_no", "v"))).alias(f"__{t}") for t in targets])
    out = df.join(best, key, "left")
    cols = [x for t in targets for x in (F.coalesce(t, F.col(f"__{t}.v")).alias(f"{t}_filled"), F.when(F.col(t).isNotNull(), F.lit("observed")).otherwise(F.element_at(label, F.col(f"__{t}.set_no"))).alias(f"{t}_source"))]
    return out.select(*df.columns, *cols)


def set_key(links: DataFrame, of: str, member: str, name: str) -> DataFrame:
    """(id, name): a fingerprint of the set of members that links give each id; equal sets have equal ones."""
    own = links.select(F.col(of).alias("id"), F.col(member).alias("m")).distinct()
    print_ = F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(F.xxhash64("m")).cast("string"), F.bit_xor(F.xxhash64(F.lit(1), "m")).cast("string"))
    return own.groupBy("id").agg(print_.alias(name))


def _year(name: str, lo: int, hi: int) -> Column:
    return F.when(F.col(name).between(lo, hi), F.col(name).cast("int"))


def clean_persons(persons: DataFrame, lo: int = 700, hi: int = 1600) -> DataFrame:
    """One row per id: impossible years and flags other than 0 and 1 become NULL."""
    flag = lambda c: F.when(F.col(c).isin(0, 1), F.col(c).cast("int"))
    own = persons.where("id IS NOT NULL").select("id", "name", "sex", _year("birth", lo, hi).alias("birth"), _year("death", lo, hi).alias("death"), flag("birth_imputed").alias("birth_imputed"), flag("death_imputed").alias("death_imputed"))
    # a repeated id is the same record loaded again: one row of it is kept, the same at every run
    return own.groupBy("id").agg(F.min(F.struct("name", "sex", "birth", "death", "birth_imputed", "death_imputed")).alias("r")).select("id", "r.*")


def fill_persons(persons: DataFrame, parents: DataFrame, spouses: DataFrame, labels: DataFrame, lo: int = 700, hi: int = 1600, min_confidence: float = 0.9, min_groups: int = 5, tolerance: int = 10, bin_years: int = 25, max_size: int = 2) -> DataFrame:
    """Persons with every missing birth, death and flag filled.

    Returns id, and for each field f of birth, death, birth_imputed, death_imputed: f (filled), f_source and
    f_was_missing. NULL and impossible years count as missing, and so do flags other than 0 and 1. Links to unknown
    persons, repeated links and NULL ends have no effect; an empty persons table gives an empty result; with no
    complete record at all a cell stays NULL with source 'unfilled'. Years of a group agree if they lie within tolerance;
    years as determinants also count in bins of bin_years. Determinants have at most max_size columns.
    """
    base = clean_persons(persons, lo, hi)
    label = labels.where("dynasty IS NOT NULL AND dynasty <> '' AND id IS NOT NULL").groupBy("id").agg(F.min("dynasty").alias("dynasty"))
    links = parents.where("parent_id IS NOT NULL AND child_id IS NOT NULL AND parent_id <> '' AND child_id <> '' AND parent_id <> child_id").select("parent_id", "child_id").distinct()
    pairs = spouses.where("a IS NOT NULL AND b IS NOT NULL AND a <> '' AND b <> '' AND a <> b").select("a", "b")
    both = pairs.union(pairs.select("b", "a")).distinct()
    base = base.join(label, "id", "left")
    for name, table, of, member in (("parents", links, "child_id", "parent_id"), ("children", links, "parent_id", "child_id"), ("spouses", both, "a", "b")):
        base = base.join(set_key(table, of, member, name), "id", "left")
    base = base.withColumn("name_key", F.when(F.length(F.trim("name")) > 0, F.lower(F.trim("name")))).withColumn("sex_key", F.when(F.col("sex").isin("M", "F"), F.col("sex")))
    base = checkpoint(base.withColumn("birth_bin", F.floor(F.col("birth") / bin_years)).withColumn("death_bin", F.floor(F.col("death") / bin_years)))

    targets = {"birth": float(tolerance), "death": float(tolerance), "birth_imputed": 0.0, "death_imputed": 0.0}
    columns = ["name_key", "sex_key", "dynasty", "parents", "children", "spouses", "birth", "death", "birth_bin", "death_bin"]
    verified = mine_dependencies(base, columns, targets, {"birth": {"birth_bin"}, "death": {"death_bin"}}, max_size, min_confidence, min_groups)
    out = checkpoint(fill_by_dependencies(base, verified, targets))

    # group fallback: gaps mined from complete records, then estimates from relatives
    years = base.select("id", "birth", "death")
    pb = years.select(F.col("id").alias("parent_id"), F.col("birth").alias("pb"))
    cb = years.select(F.col("id").alias("child_id"), F.col("birth").alias("cb"))
    family = links.join(pb, "parent_id").join(cb, "child_id")
    gap = family.where("pb IS NOT NULL AND cb IS NOT NULL AND cb > pb AND cb - pb < 80").agg(F.avg(F.expr("cb - pb")).alias("gap"))
    stats = base.agg(F.avg(F.expr("CASE WHEN death >= birth AND death - birth < 110 THEN death - birth END")).alias("span"), F.avg("birth").alias("all_birth"), F.avg("death").alias("all_death"), F.avg("birth_imputed").alias("all_bi"), F.avg("death_imputed").alias("all_di")).crossJoin(gap)  # one row each
    g = stats.first()
    gap_y, span = float(g["gap"] or 27.0), float(g["span"] or 50.0)
    estimates = [
        family.where("pb IS NOT NULL").select(F.col("child_id").alias("id"), (F.col("pb") + gap_y).alias("e")),
        family.where("cb IS NOT NULL").select(F.col("parent_id").alias("id"), (F.col("cb") - gap_y).alias("e")),
        both.join(years.select(F.col("id").alias("b"), "birth"), "b").where("birth IS NOT NULL").select(F.col("a").alias("id"), F.col("birth").cast("double").alias("e")),
    ]
    # siblings by way of the mean of a parent's dated children: no pairs of siblings are made
    brood = family.where("cb IS NOT NULL").groupBy("parent_id").agg(F.avg("cb").alias("e"))
    estimates.append(links.join(brood, "parent_id").select(F.col("child_id").alias("id"), "e"))
    kin = reduce(DataFrame.union, estimates).groupBy("id").agg(F.avg("e").alias("kin"))
    house = base.where("dynasty IS NOT NULL").groupBy("dynasty").agg(F.avg("birth").alias("house_birth"), F.avg("death").alias("house_death"), F.avg("birth_imputed").alias("house_bi"), F.avg("death_imputed").alias("house_di"))
    out = spread_left_join(out.join(kin, "id", "left"), house, ["dynasty"], "id")

    def pick(observed: str, steps: list[tuple[str, Column]]) -> tuple[Column, Column]:
        value, source = F.col(f"{observed}_filled"), F.col(f"{observed}_source")
        for name, step in steps:
            source = F.coalesce(source, F.when(step.isNotNull(), F.lit(name)))
            value = F.coalesce(value, F.bround(step).cast("int"))
        return value, F.coalesce(source, F.lit("unfilled"))

    num = lambda x: F.lit(None if x is None else float(x)).cast("double")
    birth, birth_src = pick("birth", [("kin", F.col("kin")), ("own_death", F.col("death_filled") - span), ("dynasty", F.col("house_birth")), ("all", num(g["all_birth"]))])
    death, death_src = pick("death", [("own_birth", F.col("birth_filled") + span), ("kin", F.col("kin") + span), ("dynasty", F.col("house_death")), ("all", num(g["all_death"]))])
    made = lambda f, flag: F.when(F.col(f).isNull(), F.lit(1.0))
    bi, bi_src = pick("birth_imputed", [("year_filled", made("birth", "birth_imputed")), ("dynasty", F.round("house_bi")), ("all", F.round(num(g["all_bi"])))])
    di, di_src = pick("death_imputed", [("year_filled", made("death", "death_imputed")), ("dynasty", F.round("house_di")), ("all", F.round(num(g["all_di"])))])
    # an estimated year never turns a life round: an estimate is moved to the known other end
    birth = F.when((birth_src != "observed") & (F.col("death").isNotNull()), F.least(birth, F.col("death"))).otherwise(birth)
    death = F.when((death_src != "observed") & (F.col("birth").isNotNull()), F.greatest(death, F.col("birth"))).otherwise(death)
    cells = [("birth", birth, birth_src), ("death", death, death_src), ("birth_imputed", bi, bi_src), ("death_imputed", di, di_src)]
    return out.select("id", *[x for f, v, s in cells for x in (v.alias(f), s.alias(f"{f}_source"), F.col(f).isNull().alias(f"{f}_was_missing"))])


def filled_cells(filled: DataFrame) -> DataFrame:
    """(person_id, field_name, value, source): the cells that were missing."""
    fields = ("birth", "death", "birth_imputed", "death_imputed")
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.col(f"{f}_source").alias("source"), F.col(f"{f}_was_missing").alias("missing")) for f in fields]))
    return filled.select(F.col("id").alias("person_id"), cell.alias("cell")).select("person_id", "cell.*").where("missing").drop("missing")
