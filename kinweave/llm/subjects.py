"""Subject area of each letter by labelling functions and a latent model of their accuracy.

Labelling functions, each saying yes, no or nothing on every subject: a lexicon over the sentences of the abstract, of
the text and of the register entry, the addressee, and the earlier code of another source. How often each function finds
a subject, and how often it names a wrong one, is learned without labels by expectation-maximisation over the counts of
vote patterns; there are at most a few hundred patterns per subject, whatever the size of the corpus. Letters take the
subjects of high posterior probability.

The lexicon is learned from the coded letters: words and pairs of words that go with one code much more often than the
code is frequent. A sentence is about the subject of which it holds most such words, two at least. Sentences that name a
matter in passing (dates, witnesses, closing clauses, bearers) stand in letters of every code, so their words are in no
lexicon. A subject that no letter is coded with is read by the word beginnings of its name and description.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.names import fold, fold_text
from kinweave.runtime import checkpoint, spread

_BREAK = re.compile(r"[.;:\n\r|!?]+|\s/+\s")
_TAG = re.compile(r"<[^>]*>")
_EDIT = re.compile(r"[\[\]()<>{}⟨⟩]")
_WORDS = re.compile("[a-z]{2,}")
CLERGY = re.compile(r"^\s*(?:abbat|prior|episcop|archiepiscop|decan|capitul|preposit|canonic|convent|rector|archidiacon|abbatiss)")
FUNCTIONS = ("abstract", "body", "register", "address", "code")
STEM = 6  # letters of a description's word that a word of a letter has to begin with


@dataclass(frozen=True)
class Lexicon:
    """words: word or pair of words -> number of its subject; stems: beginning of a word -> subject's number."""

    subjects: tuple[str, ...]
    words: dict[str, int] = field(hash=False)
    stems: dict[str, int] = field(hash=False)
    second: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        object.__setattr__(self, "second", frozenset(w.split(" ")[1] for w in self.words if " " in w))


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in folded spelling, without markup and editorial brackets."""
    if not text or not text.strip():
        return []
    t = _EDIT.sub("", html.unescape(_TAG.sub(" ", text)))
    return [x for x in _BREAK.split(fold_text(t)) if len(x) >= 5]


def features(sentence: str) -> list[str]:
    """Words and pairs of neighbours."""
    w = _WORDS.findall(sentence)
    return w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]


def about(sentence: str, lexicon: Lexicon) -> int:
    """The number of the subject that a sentence is about, -1 for none."""
    words, second, hits, last = lexicon.words, lexicon.second, {}, ""
    for w in _WORDS.findall(sentence):
        k = words.get(w)
        if k is not None:
            hits[k] = hits.get(k, 0) + 1
        if w in second:
            k = words.get(f"{last} {w}")
            if k is not None:
                hits[k] = hits.get(k, 0) + 1
        last = w
    if hits:
        k, n = min(hits.items(), key=lambda x: (-x[1], x[0]))
        if n >= 2:
            return k
    if lexicon.stems:
        found = {lexicon.stems[w[:STEM]] for w in _WORDS.findall(sentence) if w[:STEM] in lexicon.stems}
        if found:
            return min(found)
    return -1


def named_in(text: str | None, lexicon: Lexicon, known: dict[str, int]) -> set[str]:
    """The subjects that the sentences of a text are about. known: sentences read before, in a bounded number."""
    found = set()
    for sentence in sentences(text):
        k = known.get(sentence)
        if k is None:
            k = about(sentence, lexicon)
            if len(sentence) <= 300 and len(known) < 30_000:
                known[sentence] = k
        if k >= 0:
            found.add(lexicon.subjects[k])
    return found


def for_clergy(address: str | None) -> bool:
    return bool(address and CLERGY.match(fold(address)))


def _labeller(spark, lexicon: Lexicon):
    shared = spark.sparkContext.broadcast(lexicon)  # as many words as learn_lexicon lets in

    def label(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for analyse, body, register, address in batches:
            rows = []
            for a, b, r, d in zip(analyse, body, register, address, strict=True):
                rows.append((*([*sorted(named_in(t, shared.value, known))] for t in (a, b, r)), for_clergy(d)))
            yield pd.DataFrame(rows, columns=["abstract", "body", "register", "clergy"])

    return F.pandas_udf(label, "struct<abstract:array<string>,body:array<string>,register:array<string>,clergy:boolean>")


def _features_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for parts in batches:
        yield pd.Series([sorted({f for t in texts for x in sentences(t) for f in features(x)}) for texts in zip(*parts, strict=True)])


def learn_lexicon(letters: DataFrame, coded: DataFrame, subjects: DataFrame, max_labelled: int = 10_000, min_letters: int = 5, min_share: float = 0.5, z: float = 2.0, max_words: int = 50_000) -> Lexicon:
    """The lexicon of the letters (item_id_telma, analyse, transcription, regeste) with codes (item_id_telma, code).

    It is fitted on at most max_labelled coded letters, those of the least hash. A word is taken for the code it goes
    with in at least min_share of min_letters letters or more, if the lower bound of that share (at z standard errors)
    is at least 0.4 and 1.6 times the share of the code. At most max_words come to the driver, the surest first.
    """
    names = tuple(sorted(r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect()))  # the subject list: fixed and small
    of = {s: i for i, s in enumerate(names)}
    ids = letters.select("item_id_telma").distinct().join(coded, "item_id_telma").orderBy(F.xxhash64("item_id_telma", F.lit(7)), "item_id_telma").limit(max_labelled)
    ids = checkpoint(ids)
    texts = ("analyse", "transcription", "regeste")
    fits = letters.join(F.broadcast(ids), "item_id_telma").groupBy("item_id_telma", "code").agg(F.min(F.struct(*texts)).alias("r")).select("item_id_telma", "code", "r.*")  # bounded
    seen = checkpoint(fits.select("code", F.pandas_udf(_features_of, "array<string>")(*texts).alias("f")).select("code", F.explode("f").alias("word")).groupBy("word", "code").agg(F.count("*").alias("k")))
    share = {r["code"]: r["n"] for r in ids.groupBy("code").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    top = seen.groupBy("word").agg(F.sum("k").alias("n"), F.max(F.struct("k", "code")).alias("top")).where(F.col("n") >= min_letters)
    p = F.col("top.k") / F.col("n")
    n = F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    words: dict[str, int] = {}
    if total:
        usual = F.element_at(F.create_map(*[x for c, m in share.items() for x in (F.lit(c), F.lit(m / total))]), F.col("top.code"))
        sure = top.withColumn("low", low).where((p >= min_share) & (F.col("low") >= F.greatest(F.lit(0.4), 1.6 * usual)))
        words = {r["word"]: of[r["code"]] for r in sure.orderBy(F.desc("low"), "word").limit(max_words).select("word", "top.code").collect()}
    stems: dict[str, int] = {}
    for r in sorted(subjects.where("subject IS NOT NULL").select("subject", "description").distinct().collect(), key=lambda r: (r["subject"], r["description"] or "")):
        if of[r["subject"]] not in words.values() and r["subject"] != "other":
            for w in _WORDS.findall(fold_text(f"{r['subject']} {r['description'] or ''}".replace("_", " "))):
                if len(w) >= STEM:
                    stems.setdefault(w[:STEM], of[r["subject"]])
    return Lexicon(names, words, stems)


def learn(patterns: list[tuple[str, str, int]], rounds: int = 100) -> dict[tuple[str, str], float]:
    """Posterior of every (subject, pattern) from counts (subject, pattern, n); a pattern has y, n or - per function.

    Per subject: prior, and of each function its rate of yes among the letters on the subject and among the others.
    """
    out: dict[tuple[str, str], float] = {}
    for subject in sorted({s for s, _, _ in patterns}):
        own = [(p, n) for s, p, n in patterns if s == subject]
        k = len(own[0][0])
        total = sum(n for _, n in own)
        prior, hit, false = 0.15, [0.85] * k, [0.05] * k
        hit[FUNCTIONS.index("address")] = false[FUNCTIONS.index("address")] = 0.5
        post: dict[str, float] = {}
        for _ in range(rounds):
            for p, _n in own:
                a, b = prior, 1 - prior
                for j, v in enumerate(p):
                    if v == "y":
                        a, b = a * hit[j], b * false[j]
                    elif v == "n":
                        a, b = a * (1 - hit[j]), b * (1 - false[j])
                post[p] = a / (a + b) if a + b else 0.0
            old = prior
            prior = (sum(post[p] * n for p, n in own) + 1) / (total + 2)
            for j in range(k):
                seen = [(p, n) for p, n in own if p[j] != "-"]
                pos, neg = sum(post[p] * n for p, n in seen), sum((1 - post[p]) * n for p, n in seen)
                # one yes and one no as prior counts; a function never does worse than chance
                hit[j] = (sum(post[p] * n for p, n in seen if p[j] == "y") + 1.7) / (pos + 2)
                false[j] = (sum((1 - post[p]) * n for p, n in seen if p[j] == "y") + 0.1) / (neg + 2)
                hit[j] = min(0.999, max(hit[j], false[j] + 1e-3, 0.02))
                false[j] = min(0.9, max(false[j], 1e-3))
            if abs(prior - old) < 1e-9:
                break
        out |= {(subject, p): x for p, x in post.items()}
    return out


def assign(letters: DataFrame, codes: DataFrame, subjects: DataFrame, at_least: float = 0.5, most: int = 2) -> DataFrame:
    """(item_id_telma, subject, posterior): one or two subjects for each letter with an abstract or a text.

    A subject needs the yes of a lexicon or a code; the addressee alone, or how common it is, doesn't do.
    Letters without either (NULL, empty, blank) get none; letters no function says anything on, and those without a
    probable subject, get 'other' (if it is a subject), or else their best subject. 'other' never stands beside another
    subject. Repeated letters count once; codes that are no subject, however written, say nothing.
    """
    spark = letters.sparkSession
    letters = letters.where("item_id_telma IS NOT NULL").select("item_id_telma", "analyse", "transcription", "regeste", "destinataire")
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    letters = letters.where(filled("analyse") | filled("transcription"))
    subjects = subjects.select("subject", "description") if "description" in subjects.columns else subjects.select("subject", F.lit("").alias("description"))
    known = sorted(r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect())  # the subject list: fixed and small
    word = F.regexp_replace(F.lower(F.trim("domain")), "[^a-z]+", "_")
    plain = codes.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("item_id_telma"), word.alias("code")).where(F.col("code").isin(known)).distinct()
    plain = checkpoint(plain)
    label = _labeller(spark, learn_lexicon(letters, plain, subjects))
    # labelled as they are read; repeated letters are dropped afterwards, so no text is shuffled
    texts = ("analyse", "transcription", "regeste", "destinataire")
    said = spread(letters.select("item_id_telma", *texts)).select("item_id_telma", F.xxhash64(*texts).alias("h"), filled("analyse").alias("has_a"), filled("transcription").alias("has_t"), filled("regeste").alias("has_r"), filled("destinataire").alias("has_d"), label(*texts).alias("s"))
    said = said.groupBy("item_id_telma").agg(F.min(F.struct("h", "has_a", "has_t", "has_r", "has_d", "s")).alias("r")).select("item_id_telma", "r.has_a", "r.has_t", "r.has_r", "r.has_d", "r.s.*")
    coded = plain.groupBy("item_id_telma").agg(F.collect_set("code").alias("code"))
    said = checkpoint(said.join(coded, "item_id_telma", "left"))
    # subjects whose coded letters go to the clergy more often than others do
    rates = {r["c"]: (r["n"], r["k"]) for r in said.where("has_d AND code IS NOT NULL").select(F.explode("code").alias("c"), "clergy").groupBy("c").agg(F.count("*").alias("n"), F.count_if("clergy").alias("k")).collect()}
    usual = sum(k for _, k in rates.values()) / max(1, sum(n for n, _ in rates.values()))
    to_clergy = [c for c, (n, k) in rates.items() if k / n > usual]
    vote = lambda has, yes: F.when(~has, "-").when(yes, "y").otherwise("n")
    has = lambda c: F.array_contains(c, F.col("subject"))
    # a section in which no subject is named at all says nothing
    said_any = lambda flag, c: F.col(flag) & (F.size(c) > 0)
    clerical = F.col("subject").isin(to_clergy) if to_clergy else F.lit(False)
    pattern = F.concat(vote(said_any("has_a", "abstract"), has("abstract")), vote(said_any("has_t", "body"), has("body")), vote(said_any("has_r", "register"), has("register")), vote(F.col("has_d"), F.col("clergy") == clerical), vote(F.col("code").isNotNull(), F.coalesce(has("code"), F.lit(False))))
    votes = said.withColumn("subject", F.explode(F.array(*[F.lit(s) for s in known]))).select("item_id_telma", "subject", pattern.alias("pattern")) if known else said.select("item_id_telma", F.lit("").alias("subject"), F.lit("").alias("pattern")).limit(0)
    counts = [(r["subject"], r["pattern"], r["n"]) for r in votes.groupBy("subject", "pattern").agg(F.count("*").alias("n")).collect()]  # at most 3^5 per subject
    post = learn(counts) if counts else {}
    table = spark.createDataFrame([(s, p, x) for (s, p), x in post.items()], "subject string, pattern string, posterior double")
    scored = votes.join(F.broadcast(table), ["subject", "pattern"])  # as many rows as patterns
    best = scored.groupBy("item_id_telma").agg(F.sort_array(F.collect_list(F.struct((-F.col("posterior")).alias("m"), (F.col("subject") == "other").alias("o"), F.col("subject").alias("s"), F.col("pattern").rlike("^(y|.y|..y|....y)").alias("told")))).alias("all"))  # one entry per subject
    likely = F.filter("all", lambda x: (x.m <= -at_least) & ~x.o & x.told)
    fallback = F.filter("all", lambda x: x.o)
    chosen = F.when(F.size(likely) > 0, F.slice(likely, 1, most)).when(F.size(fallback) > 0, fallback).otherwise(F.slice("all", 1, 1))
    return best.select("item_id_telma", F.explode(chosen).alias("c")).select("item_id_telma", F.col("c.s").alias("subject"), (-F.col("c.m")).alias("posterior"))
