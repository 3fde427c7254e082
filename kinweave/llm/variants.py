"""Variant spellings of names: which entries, and which quotes of one letter, mean one person.

Records that agree in all parts are one representative each. The tokens of a name are sorted into given name, place and
the rest. Representatives meet in blocks of the phonetic codes of their places (people.near_places) and of near years;
they are compared in given name (nickname table, Jaro-Winkler), place, numeral, epithet, rank, sex and years, and the
accepted pairs are clustered by connected components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import people as P
from kinweave.operators.components import connected_components
from kinweave.operators.relational import salted_join
from kinweave.runtime import checkpoint

LIFE = 95
SPAN = 50  # years of a block in which an entry with only a birth meets those with only a death
SIDE = ("given", "cls", "latin", "short", "numeral", "epithet", "place", "rank", "sex")


#: Epithets that are the same but for a slip in four letters.
EPITHETS = "(epithet = epithet2 OR levenshtein(epithet, epithet2) * 4 <= greatest(length(epithet), length(epithet2)))"


def _other(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c + "2") for c in df.columns])


def _components(pairs: DataFrame) -> DataFrame:
    return connected_components(checkpoint(pairs.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))), "a", "b")


def _ends(pairs: DataFrame, person: DataFrame) -> DataFrame:
    """(abbr, name, full, ...) of the pairs of an abbreviation and a full name; full is the person that the name belongs to."""
    out = pairs.where("short <> short2").withColumn("abbr", F.when(F.col("short"), F.col("rep")).otherwise(F.col("rep2"))).withColumn("name", F.when(F.col("short"), F.col("rep2")).otherwise(F.col("rep"))).drop("rep", "rep2", "short", "short2")
    return out.join(person.select(F.col("node").alias("name"), F.col("component").alias("full")), "name", "left").withColumn("full", F.coalesce("full", "name"))


def _over_gaps(gaps: DataFrame, reps: DataFrame, person: DataFrame) -> DataFrame:
    """The pairs of an entry with only a birth and one with only a death whose persons, so far, have no year of the other
    kind and no other such partner: namesakes of one place and time can't be told apart by that little."""
    whole = reps.join(person.withColumnRenamed("node", "rep"), "rep", "left").withColumn("person", F.coalesce("component", "rep"))
    known = whole.groupBy("person").agg(F.max("birth").alias("birth"), F.max("death").alias("death"))
    of = checkpoint(whole.select("rep", "person").join(known.select("person", (F.col("birth").isNull() | F.col("death").isNull()).alias("half")), "person"))
    met = gaps.join(of, "rep").join(_other(of), "rep2").where("half AND half2")
    both = checkpoint(met.select("rep", "rep2", "person", "person2").unionByName(met.select("rep", "rep2", F.col("person2").alias("person"), F.col("person").alias("person2"))))
    many = both.groupBy("person").agg(F.count_distinct("person2").alias("k")).where("k > 1").select("person")
    sure = both.join(many, "person", "left_anti").join(many.withColumnRenamed("person", "person2"), "person2", "left_anti").select("rep", "rep2").distinct()
    return sure.select("rep", "rep2", F.lit(False).alias("short"), F.lit(False).alias("short2"), F.lit(2).alias("apart"))


def variant_persons(people: P.People, max_years: int = 2, min_given: float = 0.86, min_place: float = 0.88, hot_rows: int = 100_000) -> DataFrame:
    """(id, component): ids that record one person carry one component (the smallest representative).

    Only ids with a given name and a place can be linked. One without any year is linked where all dated entries of its
    given name's class, numeral and epithet at a like place are one person; otherwise namesakes can't be told apart. Years may differ by max_years; numerals and epithets have to agree. Persons with only births and persons with
    only deaths are linked by full names if the two years make a life of at most LIFE years and neither has another
    such partner. NULL names, empty tables and repeated
    rows give no links.
    """
    told = people.who.where("given <> '' AND place <> ''")
    usable, undated = told.where("birth IS NOT NULL OR death IS NOT NULL"), told.where("birth IS NULL AND death IS NULL AND NOT short")
    parts = [*SIDE, "gid", "birth", "death"]
    reps = checkpoint(usable.groupBy(*parts).agg(F.min("id").alias("rep")))
    # a block: a place and a year, in steps so that years within max_years share one; the left side stands in the blocks of
    # all places like its own
    step = 2 * max_years + 1
    around = lambda y: F.array_distinct(F.array(F.floor(F.col(y) / step), F.floor((F.col(y) + max_years) / step)))
    marks = lambda c: F.when(F.col(c).isNotNull(), F.transform(around(c), lambda y: F.concat(F.lit(c[0]), y.cast("string")))).otherwise(F.array().cast("array<string>"))
    lives = F.when(F.col("death").isNull(), F.sequence(F.floor(F.col("birth") / SPAN), F.floor((F.col("birth") + LIFE) / SPAN))).when(F.col("birth").isNull(), F.array(F.floor(F.col("death") / SPAN))).otherwise(F.array().cast("array<bigint>"))
    years = F.concat(marks("birth"), marks("death"), F.transform(lives, lambda y: F.concat(F.lit("l"), y.cast("string"))))
    slim = reps.withColumn("years", years).select("place", "years", F.explode("years").alias("block"), "rep", "birth", "death", "numeral", "sex", "rank", "epithet", "short", "gid")
    near = lambda c: f"({c} IS NULL OR {c}2 IS NULL OR abs({c} - {c}2) <= {max_years})"
    gap = "(birth IS NULL AND death2 IS NULL OR death IS NULL AND birth2 IS NULL)"
    left = slim.join(people.near, "place").drop("place")
    pairs = salted_join(left, _other(slim).withColumnRenamed("block2", "block"), ["block", "place2"], hot_rows).where(f"rep < rep2 AND {near('birth')} AND {near('death')} AND (NOT {gap} OR coalesce(death, death2) - coalesce(birth, birth2) BETWEEN 0 AND {LIFE}) AND (block NOT LIKE 'l%' OR {gap}) AND numeral = numeral2 AND (sex = '' OR sex2 = '' OR sex = sex2) AND (rank = '' OR rank2 = '' OR rank = rank2) AND p >= {min_place} AND {EPITHETS}")
    # a pair counts in the first block that it shares (pairs over a gap share no other kind), so no distinct follows
    shared = f"IF({gap}, filter(array_intersect(years, years2), y -> y LIKE 'l%'), array_intersect(years, years2))[0]"
    pairs = checkpoint(pairs.where(f"block = {shared}").select("rep", "rep2", "gid", "gid2", "short", "short2", "birth", "birth2", "death", "death2"))
    # two abbreviations tell less: then both years have to speak for it
    both = "(birth IS NOT NULL AND birth2 IS NOT NULL AND death IS NOT NULL AND death2 IS NOT NULL)"
    good = P.given_scores(pairs, people).where(f"g >= {min_given} OR (g >= 0.7 AND (short OR short2) AND {both}) OR (g >= 0.8 AND (short OR short2))")
    apart = F.coalesce(F.abs(F.col("birth") - F.col("birth2")), F.lit(1)) + F.coalesce(F.abs(F.col("death") - F.col("death2")), F.lit(1))
    good = checkpoint(good.select("rep", "rep2", "short", "short2", apart.alias("apart"), F.expr(gap).alias("gap")))
    gaps, good = good.where("gap AND NOT short AND NOT short2").select("rep", "rep2"), good.where("NOT gap").drop("gap")
    good = checkpoint(good.unionByName(_over_gaps(gaps, reps, _components(good.where("NOT short AND NOT short2")))))
    person = _components(good.where("NOT short AND NOT short2"))
    # an abbreviation that fits several persons of full names means the one whose years are nearest, or none if that is no single one;
    # all spellings that are linked are one person
    ends = checkpoint(_ends(good, person))
    per = ends.groupBy("abbr", "full").agg(F.min("apart").alias("apart"))
    best = per.groupBy("abbr").agg(F.min("apart").alias("least"), F.min_by("full", "apart").alias("meant"))
    ties = per.join(best, "abbr").groupBy("abbr").agg(F.count_if(F.col("apart") == F.col("least")).alias("k"), F.first("meant").alias("meant"))
    clear = ties.select("abbr", F.when(F.col("k") == 1, F.col("meant")).alias("meant"))
    fit = ends.join(clear, "abbr").where("meant = full").select(F.col("abbr").alias("rep"), F.col("name").alias("rep2"))
    vague = clear.where("meant IS NULL").select(F.col("abbr").alias("rep"))
    rest = good.where("short = short2").select("rep", "rep2").join(vague, "rep", "left_anti").join(vague.withColumnRenamed("rep", "rep2"), "rep2", "left_anti").select("rep", "rep2")
    links = fit.unionByName(rest).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    comp = connected_components(checkpoint(links), "a", "b")
    named = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    same = [F.col(c).eqNullSafe(F.col("r_" + c)) for c in parts]
    right = named.select(*[F.col(c).alias("r_" + c) for c in parts], "component")
    dated = checkpoint(usable.join(right, same).select("id", "component"))
    # entries without a year: namesakes are one row per place and sex before they are met
    kin = named.where("NOT short").groupBy("place", "cls", "numeral", "epithet", "sex").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    fits = undated.select("id", "place", "cls", "numeral", "epithet", "sex").join(people.near.select("place", F.col("place2").alias("place_")), "place").drop("place")
    fits = fits.join(kin.withColumnRenamed("place", "place_").withColumnRenamed("sex", "sex2"), ["place_", "cls", "numeral", "epithet"]).where("sex = '' OR sex2 = '' OR sex = sex2")
    alone = fits.groupBy("id").agg(F.min("lo").alias("component"), F.max("hi").alias("hi")).where("component = hi").select("id", "component")
    return dated.unionByName(alone)


def variant_quotes(people: P.People, min_given: float = 0.86, min_place: float = 0.86) -> DataFrame:
    """(match_id, doc_id, quoted_latin, component): quotes of one letter that mean one person share a component.

    dominus and domina are said of every rank. A quote has to name a given name, at least by its initial, and a place; anything less is too vague. An initial
    that fits two different names of a place in the letter is too vague as well.
    """
    usable = people.said.where("doc_id IS NOT NULL AND quoted_latin IS NOT NULL AND given <> '' AND place <> ''")
    parts = ["doc_id", *SIDE, "gid"]
    reps = checkpoint(usable.groupBy(*parts).agg(F.min("match_id").alias("rep")))
    pairs = reps.join(people.near, "place").join(_other(reps).withColumnRenamed("doc_id2", "doc_id"), ["doc_id", "place2"]).where(f"rep < rep2 AND {P.AGREE}")
    pairs = pairs.where("(sex = '' OR sex2 = '' OR sex = sex2) AND (rank IN ('', 'lord') OR rank2 IN ('', 'lord') OR rank = rank2) AND (numeral = numeral2 OR numeral = 0 OR numeral2 = 0)")
    pairs = checkpoint(pairs.where(F.col("p") >= min_place).select("rep", "rep2", "gid", "gid2", "short", "short2"))
    good = checkpoint(P.given_scores(pairs, people).where(f"g >= {min_given} OR (g >= 0.7 AND (short OR short2))").select("rep", "rep2", "short", "short2"))
    # an abbreviation next to two persons of full names in its letter says nothing; spellings that are linked are one
    ends = _ends(good, _components(good.where("NOT short AND NOT short2")))
    vague = checkpoint(ends.groupBy(F.col("abbr").alias("rep")).agg(F.count_distinct("full").alias("k")).where("k > 1").select("rep"))
    links = good.join(vague, "rep", "left_anti").join(vague.withColumnRenamed("rep", "rep2"), "rep2", "left_anti").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    comp = connected_components(checkpoint(links), "a", "b")
    named = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return usable.join(named.select(*parts, "component"), parts).select("match_id", "doc_id", "quoted_latin", "component")


def variant_pairs(persons: DataFrame, quotes: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of ids of one person, and of quotes of one letter, differing as
    strings, that mean one person."""
    people = P.prepare(persons, quotes)
    ids = checkpoint(variant_persons(people))
    ids = ids.join(ids.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi")
    a = ids.select(F.col("id").alias("key_a"), "component").join(ids.select(F.col("id").alias("key_b"), "component"), "component").where("key_a < key_b").select("key_a", "key_b")
    q = checkpoint(variant_quotes(people))
    q = q.join(q.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi")
    b = q.select(F.col("match_id").alias("key_a"), "component", F.col("quoted_latin").alias("t1")).join(q.select(F.col("match_id").alias("key_b"), "component", F.col("quoted_latin").alias("t2")), "component").where("key_a < key_b AND t1 <> t2").select("key_a", "key_b")
    return a.union(b)
