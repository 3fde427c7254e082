"""Garbled text from a wrong character decoding.

Multibyte garbling (UTF-8 bytes shown through a one-byte table): the characters are mapped back to the bytes of a
table and a byte-structure automaton (lead byte, then its number of continuation bytes; written as a regular
expression over the table's characters) finds the maximal well-formed spans, which alone are decoded. This is
repeated, for text that was garbled twice.

One-byte garbling (one table's bytes shown through another one): a word counts as garbled if its shape is impossible
(a capital or a sign inside lower-case letters, two scripts in one word) and turns into plain letters under another
pair of tables, or if its remapped form is far more frequent in the corpus than the word itself.

Characters lost for good (U+FFFD, control characters of the C1 block) mark a text as garbled but not restorable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import checkpoint, spread

#: Tables that UTF-8 bytes were shown through, in order of preference.
VIEWS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "cp1254", "cp866")
#: (table shown, table meant) for one-byte garbling.
PAIRS = (("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("mac_roman", "cp850"), ("cp850", "mac_roman"))
EVERYDAY = frozenset("àâäçèéêëìîïòôöùûüßęœæ’—–„“”»«")
SIGNS = "‡‰¸ˆﬂﬁ³²¹÷¯˘‚„…±¶§´`°ºª¥£¢¬¤¦½¼¾«»∂∑∏π∫Ω√≈∆◊∞≤≥◊µ"


@lru_cache(maxsize=None)
def _table(name: str) -> dict[str, int]:
    """Character -> byte of a one-byte table; bytes the table leaves open are shown as the C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        out.setdefault(chr(b), b) if b < 0xA0 else None
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(maxsize=None)
def _automaton(name: str) -> re.Pattern:
    """Maximal runs of well-formed two-, three- and four-byte sequences, over the characters of a table."""
    t = _table(name)
    of = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in t.items() if lo <= b <= hi) + "]"
    cont = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{cont}|{of(0xE0, 0xEF)}{cont}{{2}}|{of(0xF0, 0xF4)}{cont}{{3}})+")


@lru_cache(maxsize=None)
def _ends(name: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters that can begin, and those that can continue, a sequence in a table."""
    t = _table(name)
    return frozenset(c for c, b in t.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in t.items() if b <= 0xBF)


def _kind(ch: str) -> str:
    """'ok' for what Latin text is written with, a script name for Greek and Cyrillic, 'no' for the rest."""
    c = ord(ch)
    if 0xA0 <= c <= 0x17F or 0x218 <= c <= 0x21B or c in (0x192, 0x2C6, 0x2C7, 0x2D8, 0x2D9, 0x2DA, 0x2DB, 0x2DC, 0x2DD) or 0x1E00 <= c <= 0x1EFF:
        return "ok"
    if 0x2010 <= c <= 0x206F or 0x20A0 <= c <= 0x20CF or 0x2100 <= c <= 0x214F or 0x2150 <= c <= 0x218F or 0x2190 <= c <= 0x2BFF or 0xFB00 <= c <= 0xFB06 or c in (0xFEFF, 0xFFFD):
        return "ok"
    if c >= 0x10000 and unicodedata.category(ch) not in ("Cn", "Co"):
        return "ok"
    if 0x370 <= c <= 0x3FF or 0x1F00 <= c <= 0x1FFF:
        return "greek"
    if 0x400 <= c <= 0x45F or 0x490 <= c <= 0x491:
        return "cyrillic"
    if 0x80 <= c <= 0x9F:
        return "control"
    return "no"


def _cyrillic(ch: str) -> bool:
    return "Ѐ" <= ch <= "ӿ"


def _accept(view: str, text: str, a: int, b: int, decoded: str, near: list[str]) -> bool:
    kinds = {_kind(c) for c in decoded}
    if "no" in kinds:
        return False
    if "control" in kinds and view not in ("cp1252", "cp1254"):
        return False
    if kinds & {"greek", "cyrillic"}:
        # one letter of another script can be chance; a word of it is not
        script = [k for k in map(_kind, "".join(near)) if k in ("greek", "cyrillic")]
        if len(script) < 3:
            return False
    if view in ("cp1251", "cp866"):
        around = text[max(0, a - 2) : a] + text[b : b + 2]
        if any(_cyrillic(c) for c in around) and not (kinds & {"cyrillic"}):
            left, right = text[a - 1 : a], text[b : b + 1]
            if (left and _cyrillic(left)) or (right and _cyrillic(right)):
                return False
    return True


def _spans(text: str, view: str) -> list[tuple[int, int, str]]:
    t = _table(view)
    found = []
    for m in _automaton(view).finditer(text):
        try:
            found.append((m.start(), m.end(), bytes(t[c] for c in m.group()).decode("utf-8")))
        except UnicodeDecodeError:  # overlong forms and surrogates
            continue
    near = [d for _, _, d in found]
    return [(a, b, d) for a, b, d in found if _accept(view, text, a, b, d, near)]


def decode_spans(text: str) -> tuple[str, int]:
    """The text with its garbled multibyte spans decoded, layer by layer until none is left, and the number of spans.

    A decoded span is shorter than what stood there, so the layers come to an end.
    """
    total = 0
    while not text.isascii():
        chars = set(text)
        able = [v for v in VIEWS if not chars.isdisjoint(_ends(v)[0]) and not chars.isdisjoint(_ends(v)[1])]
        by_view = {v: s for v in able if (s := _spans(text, v))}
        if not by_view:
            break
        # two tables may both read a text; the one that gives more everyday letters is the right one
        weight = {v: sum(b - a + 0.5 * sum(c in EVERYDAY for c in d) for a, b, d in s) for v, s in by_view.items()}
        taken: list[tuple[int, int, str]] = []
        for v in sorted(by_view, key=lambda v: (-weight[v], VIEWS.index(v))):
            taken += [s for s in by_view[v] if all(s[1] <= x[0] or s[0] >= x[1] for x in taken)]
        parts, at = [], 0
        for a, b, d in sorted(taken):
            parts += [text[at:a], d]
            at = b
        text = "".join([*parts, text[at:]])
        total += len(taken)
    return text, total


_C1 = re.compile("[\x80-\x84\x86-\x9f]")  # U+0085 is a line end
WORD = re.compile(r"[^\s.,;:!?()\[\]{}\"/'’\-–—]+")
_LATIN_LOWER = re.compile(r"[a-zß-öø-ÿœž]+\Z")


@lru_cache(maxsize=None)
def _remap(shown: str, meant: str) -> dict[int, str]:
    out = {}
    for ch, b in _table(shown).items():
        try:
            out[ord(ch)] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            out[ord(ch)] = "�"
    return out


def remapped(word: str) -> list[tuple[str, str]]:
    """(pair, word under it) for every pair that turns a word into letters of a Latin script, the first capital allowed."""
    out = []
    for shown, meant in PAIRS:
        new = word.translate(_remap(shown, meant))
        if new != word and _LATIN_LOWER.match(new.lower()) and (new.islower() or new[1:].islower() or not new[1:]):
            out.append((f"{shown}>{meant}", new))
    return out


_CAMEL = re.compile(r"[a-zß-öø-ÿ][À-ÖØ-ÞŠŽŒŸ](?![A-ZÀ-ÖØ-Þ])")
_SIGN_IN = re.compile(rf"[a-zà-ÿ][{re.escape(SIGNS)}]+[a-zà-ÿ]|[a-z][‡‰¸ˆ](?!\w)|(?<!\w)[¸‚‰³][a-z]{{2,}}")


def _mixed(word: str) -> bool:
    has = {"c" if _cyrillic(c) else "l" for c in word if c.isalpha()}
    return has == {"c", "l"}


def impossible(word: str) -> bool:
    """A word shape that no correct spelling has."""
    return bool(_CAMEL.search(word) or _SIGN_IN.search(word) or _mixed(word))


def _suspects(text: str) -> list[str]:
    """Words with a character outside ASCII; a word of one such character only between two words."""
    out = []
    for m in WORD.finditer(text):
        w = m.group()
        if w.isascii():
            continue
        if len(w) == 1:
            left, right = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
            if not (len(left) == 2 and left[0].isalpha() and left[1] == " " and len(right) == 2 and right[0] == " " and right[1].isalpha()):
                continue
        out.append(w)
    return out


_SCAN = "text string, spans int, lost boolean, words array<string>"


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = []
        for t in s:
            if t is None or t.isascii():
                rows.append((t, 0, False, []))
                continue
            fixed, n = decode_spans(t)
            lost = "�" in t or "�" in fixed or _C1.search(fixed) is not None
            rows.append((fixed, n, lost, _suspects(fixed)))
        yield pd.DataFrame(rows, columns=["text", "spans", "lost", "words"])


def _options(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([[{"pair": p, "new": n} for p, n in remapped(w)] for w in s])


def _odd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(impossible)


def _replace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, fixes in batches:
        out = []
        for t, fix in zip(texts, fixes, strict=True):
            if t is None or fix is None or not len(fix):
                out.append(t)
                continue
            table = {f["word"]: f["new"] for f in fix}
            out.append(WORD.sub(lambda m, table=table: table.get(m.group(), m.group()), t))
        yield pd.Series(out)


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", min_count: int = 5, ratio: float = 20.0, restore: bool = True) -> DataFrame:
    """(key, garbled, restorable, restored, n_spans, n_words) for every row of docs.

    NULL, empty and ASCII texts are never garbled and come back unchanged; texts of any length are processed whole;
    repeated keys keep their rows. restored equals the text where nothing was garbled; restorable is false where
    characters are lost. With restore = False the column restored is left out, and no text is shuffled or written.
    """
    scan = F.pandas_udf(_scan, _SCAN)
    options = F.pandas_udf(_options, "array<struct<pair:string,new:string>>")
    odd = F.pandas_udf(_odd, "boolean")
    replace = F.pandas_udf(_replace, "string")
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    strange = F.coalesce(F.col("t").rlike("[^\\x00-\\x7f]"), F.lit(False))
    plain, other = base.where(~strange), spread(base.where(strange))
    scanned = other.withColumn("s", scan("t")).select("k", F.xxhash64("t").alias("h"), "s.*")
    scanned = checkpoint(scanned if restore else scanned.drop("text"))
    counts = checkpoint(scanned.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    cand = counts.withColumn("odd", odd("word")).withColumn("o", F.explode(options("word"))).select("word", "n", "odd", "o.pair", "o.new")
    # the remapped word's own frequency: words with accents were counted, plain ones do not help
    known = counts.select(F.col("word").alias("new"), F.col("n").alias("n_new"))
    cand = cand.join(known, "new", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    sure = (F.col("n_new") >= min_count) & (F.col("n_new") >= ratio * F.col("n"))
    best = cand.where(F.col("odd") | sure).groupBy("word").agg(F.max_by(F.struct("new", "pair"), F.struct("n_new", "pair", "new")).alias("b")).select("word", "b.new")
    hit = scanned.select("k", "h", F.explode(F.array_distinct("words")).alias("word")).join(best, "word")
    fixes = hit.groupBy("k", "h").agg(F.sort_array(F.collect_set(F.struct("word", "new"))).alias("fix"))
    # a NULL key meets its fixes too
    fixes = fixes.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "fix")
    done = scanned.drop("words").join(fixes, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    n_words = F.when(F.col("fix").isNull(), 0).otherwise(F.size("fix")).cast("int")
    head = [F.col("k").alias(key), ((F.col("spans") > 0) | F.col("lost") | (n_words > 0)).alias("garbled"), (~F.col("lost")).alias("restorable")]
    tail = [F.col("spans").alias("n_spans"), n_words.alias("n_words")]
    rows = done.select(*head, *([replace("text", "fix").alias("restored")] if restore else []), *tail)
    clean = plain.select(F.col("k").alias(key), F.lit(False).alias("garbled"), F.lit(True).alias("restorable"), *([F.col("t").alias("restored")] if restore else []), F.lit(0).alias("n_spans"), F.lit(0).alias("n_words"))
    return rows.unionByName(clean)
