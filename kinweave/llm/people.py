"""What the linkage of quotes and the search for variant spellings share: parsed people, mined name classes, similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import names
from kinweave.runtime import broadcast_if_small, checkpoint

FORM = ("given", "cls", "latin", "short")  # what a gid stands for
TASKS_A_CORE = 16
PARTS = "struct<given:string,stem:string,initial:string,short:boolean,numeral:int,epithet:string,place:string,rank:string,sex:string>"


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    fields = ["given", "stem", "initial", "short", "numeral", "epithet", "place", "rank", "sex"]
    empty = dict.fromkeys(fields, "") | {"short": True, "numeral": 0}
    for s in batches:
        yield pd.DataFrame([names.parse(t) or empty for t in s], columns=fields)


def parsed(df: DataFrame, text: str) -> DataFrame:
    """df with the parts of a name; NULL and text without letters have empty parts."""
    parts = F.pandas_udf(_parse, PARTS)
    return df.withColumn("__parts", parts(F.col(text))).select(*df.columns, "__parts.*")


def persons(df: DataFrame, lo: int = 700, hi: int = 1600) -> DataFrame:
    """One parsed row per id; impossible years are NULL."""
    year = lambda c: F.when(F.col(c).between(lo, hi), F.col(c).cast("int")).alias(c)
    own = df.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(F.col("name"), F.col("sex").alias("given_sex"), F.col("birth"), F.col("death"))).alias("r")).select("id", "r.name", "r.given_sex", year("r.birth").alias("birth"), year("r.death").alias("death"))
    out = parsed(own, "name")
    return out.withColumn("sex", F.when(F.col("given_sex").isin("M", "F"), F.col("given_sex")).otherwise(F.col("sex"))).drop("given_sex")


def mine_classes(people: DataFrame, quotes: DataFrame, min_share: float = 0.5, min_class: int = 5) -> DataFrame:
    """(given, cls, latin): the Latin name that quotes of persons of this given name use; the nickname table.

    Mined from all quotes whose person is known. A name seen once is taken only if its Latin name is a common one.
    """
    seen = quotes.where("NOT short AND person_id IS NOT NULL").select("person_id", F.col("stem").alias("cls"), F.col("given").alias("latin"))
    own = people.where("NOT short").select(F.col("id").alias("person_id"), "given")
    # counted per person first: a person with very many quotes meets the join as a few rows
    seen = seen.groupBy("person_id", "cls", "latin").agg(F.count("*").alias("n"))
    counts = checkpoint(seen.join(own, "person_id").groupBy("given", "cls", "latin").agg(F.sum("n").alias("n")))
    per = counts.groupBy("given", "cls").agg(F.sum("n").alias("n"))
    top = per.groupBy("given").agg(F.max_by("cls", F.struct("n", "cls")).alias("cls"), F.max("n").alias("n"), F.sum("n").alias("all"))
    common = counts.groupBy("cls").agg(F.sum("n").alias("m"), F.max_by("latin", F.struct("n", "latin")).alias("latin")).where(F.col("m") >= min_class)
    # the mark = tells a common class from a name's own stem
    return top.where(F.col("n") >= min_share * F.col("all")).join(common, "cls").select("given", F.concat(F.lit("="), "cls").alias("cls"), "latin")


def latin_classes(quotes: DataFrame, classes: DataFrame) -> DataFrame:
    """(given, cls, latin) for the Latin forms that quotes use: the stem itself, marked where it is a common class."""
    own = quotes.where("NOT short").select("given", "stem").distinct()
    common = classes.select("cls", F.substring("cls", 2, 1000).alias("stem")).distinct()
    return own.join(common, "stem", "left").groupBy("given").agg(F.min(F.coalesce("cls", "stem")).alias("cls")).select("given", "cls", F.col("given").alias("latin"))


def classed(df: DataFrame, classes: DataFrame) -> DataFrame:
    """df with cls and latin: the mined class of the given name, or its own stem and form."""
    out = df.join(broadcast_if_small(classes), "given", "left")
    out = out.withColumn("cls", F.coalesce("cls", "stem")).withColumn("latin", F.coalesce("latin", "given"))
    return out.withColumn("gid", F.xxhash64("given", "cls", "latin", "short"))


@dataclass
class People:
    """Parsed and classed persons (one row per id), quotes (one row per match_id), like places and what a gid stands for
    (given, cls, latin, short), each written once."""

    who: DataFrame
    said: DataFrame
    near: DataFrame
    forms: DataFrame


def given_scores(pairs: DataFrame, people: People) -> DataFrame:
    """pairs (gid, gid2, ...) with g, the similarity of the given names; every pair of distinct forms is scored once."""
    met = pairs.select("gid", "gid2").distinct()
    one = people.forms
    two = one.select(*[F.col(c).alias(c + "2") for c in one.columns])
    score = F.pandas_udf(_given, "double")
    scores = dealt(met.join(broadcast_if_small(one), "gid").join(broadcast_if_small(two), "gid2"))
    scores = checkpoint(scores.select("gid", "gid2", score(*[c + x for x in ("", "2") for c in FORM]).alias("g")))
    return pairs.join(broadcast_if_small(scores), ["gid", "gid2"])


def prepare(persons_df: DataFrame, quotes: DataFrame) -> People:
    """Both tables parsed once, the name classes mined once. Rows without a key are dropped, repeated rows count once."""
    who = checkpoint(persons(persons_df))
    rows = quotes.where("match_id IS NOT NULL").groupBy("match_id").agg(F.min(F.struct("doc_id", "doc_year", "person_id", "quoted_latin")).alias("r")).select("match_id", "r.*")
    said = checkpoint(parsed(rows, "quoted_latin"))
    classes = checkpoint(mine_classes(who, said))
    near = near_places(who.select("place").union(said.select("place")))
    who, said = checkpoint(classed(who, classes)), checkpoint(classed(said, latin_classes(said, classes)))
    forms = checkpoint(who.select("gid", *FORM).union(said.select("gid", *FORM)).where("given <> ''").distinct())
    return People(who, said, near, forms)


@lru_cache(maxsize=50_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(n, m) // 2 - 1
    used, hits = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    k = len(hits)
    if not k:
        return 0.0
    other = [b[j] for j in range(m) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    same = 0
    while same < min(4, n, m) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@lru_cache(maxsize=20_000)
def given_similarity(a: str, a_cls: str, a_latin: str, a_short: bool, b: str, b_cls: str, b_latin: str, b_short: bool) -> float:
    """1 for one class, Jaro-Winkler of the spellings otherwise; abbreviations agree with what they begin."""
    if not a or not b:
        return 0.0
    if a_cls[:1] == "=" and b_cls[:1] == "=" and a_cls != b_cls and not (a_short or b_short):
        return 0.0  # two common names
    a_cls, b_cls = a_cls.lstrip("="), b_cls.lstrip("=")
    if a_short or b_short:
        if not a_short or (b_short and len(b) > len(a)):
            a, a_cls, a_latin, b, b_cls, b_latin, a_short, b_short = b, b_cls, b_latin, a, a_cls, a_latin, b_short, a_short
        # now a is an abbreviation; where both are, a is the longer one
        if b_short:
            fits = a.startswith(b) or (names.sound(b) != "" and names.sound(a).startswith(names.sound(b)))
            return (0.72 if len(b) < 2 else 0.85) if fits else 0.0
        forms = {b, b_latin, names.sound(b), b_cls, names.sound(b_latin)}
        sounded = names.sound(a)
        fits = any(f.startswith(a) for f in forms) or (sounded != "" and any(f.startswith(sounded) for f in forms)) or (a == "g" and b_cls.startswith("u"))
        if not fits and len(a) >= 4:
            near = max(jaro_winkler(sounded, f[: len(sounded)]) for f in forms)
            return 0.85 * near if near >= 0.88 else 0.0
        return (0.8 if len(a) < 2 else 0.95) if fits else 0.0
    if a_cls == b_cls:
        return 1.0
    return max(jaro_winkler(a_cls, b_cls), jaro_winkler(names.sound(a), names.sound(b)) if a and b else 0.0, jaro_winkler(names.sound(a), names.sound(b_latin)), jaro_winkler(names.sound(b), names.sound(a_latin)))


def sound_similarity(x: str, y: str) -> float:
    """Jaro-Winkler of two stems in coarse spelling; a misspelled ending leaves one stem the beginning of the other."""
    if not x or not y:
        return 0.0
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if len(short) >= 5 and long.startswith(short) and len(long) - len(short) <= 4:
        return 0.97
    return jaro_winkler(x, y)


def place_similarity(a: str, b: str) -> float:
    return sound_similarity(names.sound(a), names.sound(b))


def _given(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for cols in batches:
        yield pd.Series([given_similarity(a, b, c, bool(d), e, f, g, bool(h)) for a, b, c, d, e, f, g, h in zip(*cols, strict=True)], dtype="float64")


#: Of two rows with SIDE and SIDE2: the one case in which given_similarity is 0 whatever the spelling, two common names.
AGREE = "NOT (cls LIKE '=%' AND cls2 LIKE '=%' AND cls <> cls2 AND NOT short AND NOT short2)"


def phonetic_codes(s: str) -> list[str]:
    """Codes of a place in coarse spelling (names.sound), of which two spellings of one place share at least one.

    A code is the word without its vowels, the first letter kept. It stands with up to two of its letters left out, so
    two slips in the consonants, and any number in the vowels, leave a code in common; its beginning stands with up to
    one left out, for stems of different length.
    """
    k = s[:1] + "".join(c for c in s[1:] if c not in "aeiou")
    out = {k}
    for r in (1, 2):
        out |= {"".join(c for i, c in enumerate(k) if i not in cut) for cut in combinations(range(len(k)), r)}
    out = {c for c in out if len(c) >= 2} | {k}
    start = k[:5]
    if len(start) >= 4:
        out |= {"t:" + start} | {f"t:{start[:i]}{start[i + 1 :]}" for i in range(len(start))}
    if len(s) >= 5:
        out.add("p:" + s[:5])
    return sorted(out)


def _coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for words in batches:
        sounds = words.map(names.sound)
        yield pd.DataFrame({"sound": sounds, "codes": sounds.map(phonetic_codes)})


def _like(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([sound_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df written and dealt out in parts of so many rows: adaptive execution goes by bytes and would leave slim rows with
    much work on them to one task. The driver keeps an entry for each pair of tasks before and after, so the number of
    parts is bounded by the cores; beyond that, parts get more rows, which stream through."""
    df = checkpoint(df)
    most = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(most, math.ceil(df.count() / rows))))


def near_places(df: DataFrame, least: float = 0.86) -> DataFrame:
    """(place, place2, p) of places of df, in both directions and with themselves, that place_similarity finds alike.

    Distinct places meet in the blocks of their phonetic codes; a pair is judged once, if an edit distance that the
    similarity can't do without allows it.
    """
    words = checkpoint(df.where("place <> ''").distinct())
    coded = checkpoint(words.withColumn("c", F.pandas_udf(_coded, "struct<sound:string,codes:array<string>>")("place")).select("place", "c.sound", F.explode("c.codes").alias("code")))
    other = coded.select(F.col("place").alias("place2"), F.col("sound").alias("sound2"), "code")
    pairs = coded.join(other, "code").where("place < place2 AND levenshtein(sound, sound2) <= greatest(4, 0.35 * greatest(length(sound), length(sound2)))")
    pairs = dealt(pairs.select("place", "place2", "sound", "sound2").distinct())
    found = checkpoint(pairs.withColumn("p", F.pandas_udf(_like, "double")("sound", "sound2")).where(F.col("p") >= least).select("place", "place2", "p"))
    back = found.select(F.col("place2").alias("place"), F.col("place").alias("place2"), "p")
    return checkpoint(found.union(back).union(words.select("place", F.col("place").alias("place2"), F.lit(1.0))))
