"""Visually identical text with different characters, brought to one consistent form.

Text is cut into units (runs between common spaces and line ends). Units of plain ASCII are consistent as they are.
Every other unit is mapped: compatibility forms to ordinary letters, look-alike letters of another script to the
script of their word, odd blanks to the common space. Units whose mapped values are equal under the accent-sensitive
Unicode collation form one class: the collation ignores invisible characters and takes a letter with a separate
accent for the composed one. The canonical member of a class is its member with the fewest odd characters, the
smallest by code point among those, and is joined back. The mapped unit in composed form is itself put into its
class, so every class has a consistent member.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.runtime import checkpoint, spread

#: Letters of other scripts that look like Latin ones.
CYRILLIC_TO_LATIN = dict(zip("АВСЕНІЈКМОРЅТХУӀаеіјорсѕхуԁԛԝһӏёїЁЇ", "ABCEHIJKMOPSTXYIaeijopcsxydqwhlëïËÏ", strict=True))
GREEK_TO_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιικνορυχγητωϲϳ", "ABEZHIKMNOPTYXaiikvopuxyntwcj", strict=True))
ARMENIAN_TO_LATIN = dict(zip("օոսհցյՕՏԼ", "onuhgjOSL", strict=True))
CHEROKEE_TO_LATIN = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴꭵ", "DRTAJEWMHYGZVSLCPKBi", strict=True))
LISU_TO_LATIN = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
COPTIC_TO_LATIN = dict(zip("ⲞⲟⲢⲣⲤⲥⲚⲘ", "OoPpCcNM", strict=True))
#: Letters for sounds that look like Latin ones.
PHONETIC_TO_LATIN = dict(zip("ɑɡɪᴄᴏᴜᴠᴡᴢꜱƄƅ", "agicouvwzsbb", strict=True))
LATIN_FROM = CYRILLIC_TO_LATIN | GREEK_TO_LATIN | ARMENIAN_TO_LATIN | CHEROKEE_TO_LATIN | LISU_TO_LATIN | COPTIC_TO_LATIN | PHONETIC_TO_LATIN | {"ı": "i"}
#: Ordinary letters in another type: what Unicode itself declares a font variant, full-width forms, ligatures, numerals.
_FONTS = "".join(chr(c) for c in range(0x2100, 0x2150) if unicodedata.decomposition(chr(c)).startswith("<font>"))
_COMPAT = re.compile(f"[！-～ﬀ-ﬆⅠ-ⅿ{_FONTS}\U0001d400-\U0001d7ff]+")
_BLANK = re.compile("[\t\u000b\u000c\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")  # line ends are none
_UNSEEN = re.compile("[\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0100-\U000e01ef]")
_HYPHEN = re.compile("[‐‑]")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u1f00-\u1fff\u13a0-\u13ff\uab70-\uabbf\ua4d0-\ua4ff\u2c80-\u2cff" + "".join(PHONETIC_TO_LATIN) + "]")
_APART = re.compile("[^̀-ͯ][̀-ͯ]+")
_UNIT = re.compile(r"[^ \n\r]+")


def _script(ch: str) -> str:
    c = ord(ch)
    if 0x370 <= c <= 0x3FF or 0x1F00 <= c <= 0x1FFF:
        return "G"
    if 0x400 <= c <= 0x52F:
        return "C"
    if 0x530 <= c <= 0x58F:
        return "A"
    if 0x13A0 <= c <= 0x13FF or 0xAB70 <= c <= 0xABBF:
        return "K"
    if 0xA4D0 <= c <= 0xA4FF:
        return "S"
    if 0x2C80 <= c <= 0x2CFF:
        return "P"
    if ch in PHONETIC_TO_LATIN:
        return "O"
    return "L" if c < 0x250 or 0x1E00 <= c <= 0x1EFF else "X"


def _ordinary(text: str) -> str:
    """Compatibility forms, blanks and hyphens; length may change."""
    text = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    return _HYPHEN.sub("-", _BLANK.sub(" ", text))


def _unseen(text: str) -> str:
    return _UNSEEN.sub("", text)


def _compose(text: str) -> str:
    """A letter and its separate accents in composed form, where there is one."""
    return _APART.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


def map_letters(text: str) -> str:
    """Look-alike letters turned into those of their word's script.

    A word of two scripts is a Latin word with look-alikes. A word that is wholly of look-alikes is one too, unless a
    word next to it is truly written in its script.
    """
    if not _FOREIGN.search(text):
        return text
    # the words are found with invisible characters and separate accents set aside
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ­͏​-‏⁠-⁤﻿])*", text)]
    kinds = []
    for a, b in words:
        letters = [c for c in text[a:b] if c.isalpha()]
        scripts = {_script(c) for c in letters}
        foreign = scripts - {"L", "X"}
        if not foreign:
            kinds.append("L")
        elif "L" in scripts:
            kinds.append("mixed")
        elif len(foreign) == 1 and all(c in LATIN_FROM for c in letters):
            kinds.append("maybe" + next(iter(foreign)))
        else:
            kinds.append(next(iter(foreign)) if len(foreign) == 1 else "X")
    out, at = [], 0
    for i, ((a, b), k) in enumerate(zip(words, kinds, strict=True)):
        if k == "mixed" or k.startswith("maybe"):
            near = {kinds[j] for j in (i - 1, i + 1) if 0 <= j < len(kinds)}
            if k != "mixed" and k[-1] in near:
                continue
            out += [text[at:a], "".join(LATIN_FROM.get(c, c) for c in text[a:b])]
            at = b
    return "".join([*out, text[at:]])


def consistent(text: str) -> str:
    """The consistent form of a whole text, without the help of classes: the exact check of the operator."""
    return _compose(map_letters(_unseen(_ordinary(text))))


def _units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """(pos, unit, mapped, plain) of every unit that isn't ASCII or holds an odd blank."""
    odd = re.compile("[^!-~]")
    for s in batches:
        rows = []
        for t in s:
            own = []
            if t is not None and odd.search(t):
                # letters are mapped in the whole text, where a word's neighbours are seen; the number of characters stays
                lettered = map_letters(t)
                for i, m in enumerate(_UNIT.finditer(t)):
                    u = m.group()
                    if odd.search(u):
                        mapped = _ordinary(lettered[m.start() : m.end()])
                        # a compatibility form next to a look-alike shows the mixture only once it is ordinary
                        mapped = map_letters(mapped) if mapped != lettered[m.start() : m.end()] else mapped
                        own.append({"pos": i, "unit": u, "mapped": mapped, "plain": _compose(_unseen(mapped))})
            rows.append(own)
        yield pd.Series(rows)


def _put_back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, fixes in batches:
        out = []
        for t, fix in zip(texts, fixes, strict=True):
            if t is None or fix is None or not len(fix):
                out.append(t)
                continue
            new, parts, at = {f["pos"]: f["canonical"] for f in fix}, [], 0
            for i, m in enumerate(_UNIT.finditer(t)):
                if i in new:
                    parts += [t[at : m.start()], new[i]]
                    at = m.end()
            out.append("".join([*parts, t[at:]]))
        yield pd.Series(out)


def canonical_units(units: DataFrame) -> DataFrame:
    """(unit, mapped, canonical) for distinct units (unit, mapped, plain), by classes of the Unicode collation.

    The classes are made in SQL: GROUP BY the mapped value COLLATE UNICODE, which is accent- and case-sensitive.
    """
    spark = units.sparkSession
    view = f"lookalike_units_{abs(hash(units)) % 10**9}"
    units.createOrReplaceTempView(view)
    members = spark.sql(f"""
        SELECT unit AS member, mapped, 1 AS given FROM {view}
        UNION ALL SELECT plain AS member, mapped, 0 AS given FROM {view}""")
    members.createOrReplaceTempView(view + "_m")
    odd = "length(member) - length(regexp_replace(member, '[\\\\p{Cf}\\\\p{Mn}\\\\p{Cc}\\\\p{Zs}&&[^ ]]', '')) + IF(member RLIKE '[\\\\x{FB00}-\\\\x{FB06}\\\\x{FF01}-\\\\x{FF5E}]', 1, 0) + IF(given = 1 AND member <> mapped, 1, 0)"
    classes = spark.sql(f"""
        SELECT mapped COLLATE UNICODE AS class, min(struct({odd} AS odd, member)).member AS canonical
        FROM {view}_m GROUP BY mapped COLLATE UNICODE""")
    classes.createOrReplaceTempView(view + "_c")
    return spark.sql(f"""
        SELECT u.unit, u.mapped, c.canonical FROM (SELECT DISTINCT unit, mapped FROM {view}) u
        JOIN {view}_c c ON u.mapped COLLATE UNICODE = c.class""")


def unify(values: DataFrame) -> DataFrame:
    """(field_name, record_key, changed, value, unified) for values (field_name, record_key, value).

    NULL and empty values come back as they are, a repeated record once, texts of any length whole.
    """
    units = F.pandas_udf(_units, "array<struct<pos:int,unit:string,mapped:string,plain:string>>")
    put_back = F.pandas_udf(_put_back, "string")
    base = values.select("field_name", "record_key", "value").distinct()
    odd = spread(base.where(F.col("value").rlike("[^\\x0a\\x0d\\x20-\\x7e]")))
    found = checkpoint(odd.withColumn("u", units("value")).select("field_name", "record_key", "value", F.explode("u").alias("u")).select("field_name", "record_key", F.xxhash64("value").alias("h"), "u.*"))
    known = checkpoint(canonical_units(found.select("unit", "mapped", "plain").distinct()))
    fixes = found.join(known, ["unit", "mapped"]).where("unit <> canonical").groupBy("field_name", "record_key", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "canonical"))).alias("fix"))
    joined = base.withColumn("h", F.xxhash64("value")).join(fixes, ["field_name", "record_key", "h"], "left")
    return joined.select("field_name", "record_key", F.col("fix").isNotNull().alias("changed"), "value", put_back("value", "fix").alias("unified"))


def found_records(values: DataFrame) -> DataFrame:
    """(field_name, record_key) of the values with a unit that isn't the canonical member of its class."""
    units = F.pandas_udf(_units, "array<struct<pos:int,unit:string,mapped:string,plain:string>>")
    odd = spread(values.where(F.col("value").rlike("[^\\x0a\\x0d\\x20-\\x7e]")))
    found = checkpoint(odd.withColumn("u", units("value")).select("field_name", "record_key", F.explode("u").alias("u")).select("field_name", "record_key", "u.unit", "u.mapped", "u.plain").distinct())
    known = canonical_units(found.select("unit", "mapped", "plain").distinct()).where("unit <> canonical").select("unit", "mapped")
    return found.join(known, ["unit", "mapped"], "left_semi").select("field_name", "record_key").distinct()
