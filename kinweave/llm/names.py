"""Parts of names typed by people: given name, numeral, epithet, place and title, in several languages and in Latin."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from kinweave.llm.lookalike import consistent

#: Particles before a place.
PARTICLES = frozenset("de di von of da del della du".split())
#: Words for ranks, by their stem; also what Latin quotes put around a name.
TITLES = (
    ("king", "M", "roi rex regis regi regem rege konig king re"),
    ("king", "F", "reine regina regine reginam konigin queen"),
    ("duke", "M", "duc dux ducis duci ducem duce herzog duke duca"),
    ("duke", "F", "duchesse ducissa ducisse ducissam herzogin duchess duchessa"),
    ("viscount", "M", "vicomte vicecomes vicecomitis vicecomiti vicecomitem vicecomite vizegraf viscount visconte"),
    ("viscount", "F", "vicomtesse vicecomitissa vicecomitisse vicecomitissam vizegrafin vizegrefin viscountess viscontessa"),
    ("count", "M", "comte comes comitis comiti comitem comite graf count conte"),
    ("count", "F", "comtesse comitissa comitisse comitissam grafin grefin countess contessa"),
    ("lord", "M", "seigneur dominus domini domino dominum herr lord signore"),
    ("lord", "F", "dame domina domine dominam frau lady signora"),
)
TITLE_OF = {w: (rank, sex) for rank, sex, words in TITLES for w in words.split()}
#: Forms of address in Latin quotes, with the sex they show.
ADDRESS = {w: s for s, words in (("M", "dilectus dilecti dilecto dilectum filius filii filio filium carissimus carissimi carissimo carissimum vir viri viro virum"), ("F", "dilecta dilecte dilectam filia filie filiam carissima carissime carissimam mulier mulieris mulieri mulierem muliere"), ("", "nobilis nobili nobilem nobile in christo nomine et")) for w in words.split()}
NUMERAL = re.compile(r"^(i{1,3}|iv|v|vi{1,3}|ix|x|(\d+)(st|nd|rd|th)?)$")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
_ADJECTIVE = re.compile(r"^(.{3,}?)e?n{1,2}s{1,2}(is|em|i|e|es|ibus)$")
_COUNTRY = re.compile(r"^(.{4,}?)(iae|ie|iam|iei|ia|iæ)$")


_MARKS = re.compile("[\u0300-\u036f]+")


def fold_text(text: str) -> str:
    """Lower case, one spelling per letter: no accents, umlauted a as e, ligatures opened."""
    if text.isascii():
        return text.lower()
    text = consistent(text).lower().replace("ä", "e").replace("æ", "e").replace("œ", "e").replace("ß", "ss")
    return _MARKS.sub("", unicodedata.normalize("NFD", text))


#: For names and other short text that comes again and again.
fold = lru_cache(maxsize=20_000)(fold_text)


def sound(word: str) -> str:
    """A coarse spelling: letters that scribes exchange become one, doubled letters single."""
    for a, b in (("ph", "f"), ("th", "t"), ("ae", "e"), ("oe", "e"), ("y", "i"), ("k", "c"), ("j", "i"), ("v", "u"), ("w", "u"), ("h", ""), ("f", "p"), ("t", "d")):
        word = word.replace(a, b)
    word = re.sub(r"^gu(?=[aeio])", "u", word)
    return re.sub(r"(.)\1+", r"\1", word)


def place_stem(word: str) -> str:
    """What a place name and its Latin forms have in common: the word without its last rhyme."""
    m = _ADJECTIVE.match(word) or _COUNTRY.match(word)
    if m:
        return re.sub(r"(.)\1+", r"\1", m.group(1))
    if word.endswith("ey"):
        return re.sub(r"(.)\1+", r"\1", word[:-2])
    w = word[:-1] if word and word[-1] in "aeiou" else word
    w = re.sub(r"[aeiouy]+[^aeiouy]+$", "", w) or w
    return re.sub(r"(.)\1+", r"\1", w)


def given_stem(word: str) -> str:
    """A given name without its Latin case ending, in coarse spelling."""
    w = sound(word)
    for end in ("onis", "onem", "oni", "one", "edis", "edem", "edi", "ede"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            return w[: -len(end)]
    return re.sub(r"(ius|ium|iis|io|ii|us|um|em|am|is|es|ix|as|o|i|e|a)$", "", w) if len(w) > 3 else w[:-1] if len(w) == 3 and w[-1] in "aeiou" else w


def parse(text: str | None) -> dict | None:
    """given, initial, abbreviated, numeral, epithet, place, rank, sex of a name or of a Latin quote of one.

    None for NULL and for text without letters. The given name is the folded word; expanded letters in brackets are
    taken as written, an abbreviation keeps what there is.
    """
    if text is None:
        return None
    t = fold(text)
    if not any(c.isalpha() for c in t):
        return None
    whole = re.sub(r"(?<=[a-z])[\[(]([a-z]+)[\])]", r"\1", t)  # S[ibillam]
    m = re.match(r"^\s*([a-z'\- ]+?)\s*\(([^)]*)\)\s*$", whole)  # Place (Given)
    if m:
        whole = f"{m.group(2)} de {m.group(1)}"
    parts = [p.strip() for p in whole.split(",")]
    rank = sex = ""
    words: list[str] = []
    hint = ""
    places: list[str] = []
    numeral = 0
    named = [p for p in parts if re.search(r"\bnomine\b", p)]
    if named:  # domino Nocachafie, Caro. nomine: the name comes last
        parts = [*named, *(p for p in parts if p not in named)]
    for part in parts:
        ws = re.findall(r"[a-z0-9'\-]+\.?", part)
        k = 0
        while k < len(ws):
            w = ws[k]
            bare = w.rstrip(".")
            if bare in TITLE_OF and not w.endswith("."):
                r, s = TITLE_OF[bare]
                rank, hint = rank or r, hint or s
            elif bare in ADDRESS:
                sex = sex or ADDRESS[bare]
            elif bare in PARTICLES:
                if k + 1 < len(ws):
                    places.append(ws[k + 1].rstrip("."))
                    k += 1
            elif NUMERAL.match(bare) and words and len(bare) > 1:
                d = re.match(r"\d+", bare)
                numeral = numeral or (int(d.group()) if d else ROMAN.get(bare, 0))
            elif bare == "x" or not NUMERAL.match(bare) or not words:
                words.append(w)
            k += 1
    if len(parts) > 1 and parts[1].split()[-1:] and parts[1].split()[-1] in PARTICLES and words:
        places.append(words.pop(0).rstrip("."))  # Place, Given de
    if not places:
        # a Latin adjective or name of a country; failing that, a long word after the given name, misspelled perhaps
        adj = [w for w in words[1:] if len(w) > 7 and _ADJECTIVE.match(w)] or [w for w in words[1:] if len(w) > 6 and _COUNTRY.match(w)] or [w for w in words[1:] if len(w) > 7 and not w.endswith(".")]
        if not adj and len(words) == 1 and len(words[0]) > 8 and _ADJECTIVE.match(words[0]):
            adj = words[:1]
        if adj:
            places.append(adj[-1])
            words.remove(adj[-1])
    if not words and not places:
        return None
    given = words[0] if words else ""
    bare = given.rstrip(".")
    return {
        "given": bare,
        "stem": given_stem(bare),
        "initial": sound(bare)[:1] if bare else "",
        "short": given.endswith(".") or len(bare) <= 1,
        "numeral": numeral,
        "epithet": " ".join(w.rstrip(".") for w in words[1:]),
        "place": place_stem(places[-1]) if places else "",
        "rank": rank,
        "sex": sex or hint,
    }
