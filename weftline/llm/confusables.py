"""Visually identical text with different characters: skeletons, odd characters, a plain form.

The skeleton of a text is made as confusable detection is usually defined: decompose, replace each
character by the prototype of its look-alikes, decompose again. Texts that look alike have equal
skeletons, whatever characters they are made of; originals are grouped by skeleton. The look-alike table
is the whole public one of the Unicode consortium, as the ICU library that Spark comes with has it, and
a few more letters; every character goes through it, ASCII ones too (0 and O, 1 and l and I, rn and m).

Rows that differ from the ordinary text of their skeleton are proposed as cases, and an exact check
from Unicode properties and the name's own script leaves out styles that are allowed.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.fragment import fragment_join
from weftline.session import cut

# Letters and the Latin letter they look like, after decomposition.
LATIN_LOOKALIKES = {
    "a": "аɑαᴀ", "b": "ЬƄᏏ", "c": "сϲᴄ", "d": "ԁᏧɗ", "e": "еҽєᴇ", "f": "ƒ", "g": "ɡցɢ", "h": "һհᏂ", "i": "іıɩɪι", "j": "јϳ",
    "k": "κкᴋ", "l": "ӏǀ", "m": "мᴍ", "n": "ոпɴ", "o": "оοօᴏσ", "p": "рρᴘ", "q": "ԛզ", "r": "гᴦʀ", "s": "ѕꜱ", "t": "тτᴛ", "u": "υսᴜʋ", "v": "νѵᴠ",
    "w": "ԝɯᴡա", "x": "хχ", "y": "уγʏү", "z": "ᴢʐ",
    "A": "АΑᎪᗅ", "B": "ВΒᏴᗷ", "C": "СϹᏟ", "D": "Ꭰᗞ", "E": "ЕΕᎬ", "F": "Ϝᖴ", "G": "ԌᏀ", "H": "НΗᎻᕼ", "I": "ІΙӀᏆ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "ᏞᒪԼ",
    "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "ᎡᏒᖇ", "S": "ЅᏚՏ", "T": "ТΤᎢ", "U": "Սᑌ", "V": "ѴᏙᐯ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮᎩ", "Z": "ΖᏃ",
}
# Kana and the ideographs or kana of the other kind they look like.
KANA_LOOKALIKES = {"ロ": "口囗", "カ": "力", "ニ": "二", "ト": "卜", "タ": "夕", "エ": "工", "オ": "才", "ハ": "八", "ー": "一", "チ": "千", "ミ": "三", "ヘ": "へ", "リ": "り", "ナ": "十", "ノ": "丿", "メ": "乄", "イ": "亻", "ム": "厶"}
# Latin letters of languages written in Latin letters that don't decompose.
LATIN_OWN = set("ßẞæÆœŒøØđĐłŁþÞðÐħĦŋŊĸŧŦ")

PROTOTYPE = {x: p for table in (LATIN_LOOKALIKES, KANA_LOOKALIKES) for p, xs in table.items() for x in xs}
_LATIN_TO_CYRILLIC = {p: x for p, xs in LATIN_LOOKALIKES.items() for x in xs if "CYRILLIC" in unicodedata.name(x, "")}


@functools.lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    """Script of a letter by its Unicode name; '' for what is no letter."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(unicodedata.normalize("NFKC", ch)[:1] or ch, "")
    first = name.split(" ", 1)[0]
    if first in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "CJK", "HALFWIDTH"):
        return "KANA" if first != "CJK" else "CJK"
    return first


def own_script(text: str) -> str:
    """The script that most letters have, judged after compatibility decomposition."""
    n = Counter(s for s in map(script, unicodedata.normalize("NFKC", text)) if s)
    if not n:
        return ""
    if n["KANA"]:
        n["KANA"] += n["CJK"]
        n["CJK"] = 0
    sure = Counter(script(c) for c in set(text) if script(c) in ("LATIN", "CYRILLIC") and c not in PROTOTYPE and c not in _LATIN_TO_CYRILLIC)
    return max(n, key=lambda s: (n[s] if len(sure) != 1 or s not in ("LATIN", "CYRILLIC") else (s in sure) * (n["LATIN"] + n["CYRILLIC"]), s == "LATIN", s))


def invisible(ch: str) -> bool:
    """Format and control characters, fillers, variation selectors: nothing is seen of them."""
    o = ord(ch)
    return unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\v\f" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or 0xE0000 <= o <= 0xE0FFF


def odd_space(ch: str) -> bool:
    return ch != " " and (ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp"))


@functools.lru_cache(maxsize=100_000)
def styled(ch: str) -> bool:
    """Width, styled and compatibility forms of letters, digits and signs; ligatures."""
    if ch.isascii():
        return False
    flat = unicodedata.normalize("NFKC", ch)
    if flat == ch:
        return False
    if 0xFF00 <= ord(ch) <= 0xFFEF:
        return True
    return unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "So"


def odd_characters(text: str | None) -> bool:
    """Whether a text holds a character that isn't the ordinary one for what it shows."""
    if not text or text.isascii() and not any(c < " " or c == "\x7f" for c in text):
        return False
    if unicodedata.normalize("NFC", text) != text or any(unicodedata.category(c) in ("Mn", "Me") for c in text if script(c) in ("", "LATIN", "CYRILLIC", "GREEK")):
        return True
    own = own_script(text)
    kana = all(script(c) != "CJK" or c in PROTOTYPE for c in text)
    for c in text:
        if invisible(c) or odd_space(c) or styled(c):
            return True
        s = script(c)
        if not s or c.isascii() and own == "LATIN":
            continue
        if own == "KANA":
            if c in PROTOTYPE and PROTOTYPE[c] in KANA_LOOKALIKES and kana and (s == "CJK" or _amid_katakana(text, c)):
                return True
            if s not in ("KANA", "CJK") and any(x in PROTOTYPE.values() or x in PROTOTYPE for x in c) and not c.isascii():
                return True
        elif s != own:
            return True
        elif own == "LATIN" and not _ordinary_latin(c):
            return True
    return False


def _amid_katakana(text: str, c: str) -> bool:
    """A hiragana look-alike stands in a run of katakana."""
    i = text.index(c)
    near = [x for x in (text[i - 1 : i], text[i + 1 : i + 2]) if x and script(x)]
    return bool(near) and all(unicodedata.name(x, "").startswith("KATAKANA") for x in near)


@functools.lru_cache(maxsize=100_000)
def _ordinary_latin(c: str) -> bool:
    return unicodedata.normalize("NFD", c)[0].isascii() or c in LATIN_OWN


def plain_form(text: str | None, known: LookAlikes | None = None) -> str | None:
    """The consistent form: own script, plain spaces, composed accents, nothing invisible.

    White space is squeezed and trimmed; apostrophes and dashes get their ASCII form.
    """
    if text is None:
        return None
    t = "".join(" " if odd_space(c) else c for c in text if not invisible(c))
    own = own_script(t)
    if own == "LATIN":
        t = "".join(PROTOTYPE.get(c, c) if script(c) not in ("", "LATIN", "KANA", "CJK") else c for c in t)
    if known is not None and own in ("LATIN", "CYRILLIC", "GREEK"):
        strange = lambda c: script(c) not in ("", own) or own == "LATIN" and script(c) == own and not styled(c) and not _ordinary_latin(c)
        t = "".join(known.in_script(c, own) if not c.isascii() and c not in PROTOTYPE and c not in _LATIN_TO_CYRILLIC and strange(c) else c for c in t)
    t = unicodedata.normalize("NFKC", t)
    if own == "LATIN":
        t = "".join(_to_latin(c) for c in t)
    elif own == "CYRILLIC":
        t = "".join(_LATIN_TO_CYRILLIC.get(c, c) for c in t)
    elif own == "KANA" and all(script(c) != "CJK" or c in PROTOTYPE for c in t):
        t = "".join(PROTOTYPE[c] if PROTOTYPE.get(c) in KANA_LOOKALIKES and (script(c) == "CJK" or _amid_katakana(t, c)) else c for c in t)
    t = t.translate(_PUNCTUATION)
    return " ".join(unicodedata.normalize("NFC", t).split())


# Apostrophe and dash styles.
_PUNCTUATION = {ord(c): "'" for c in "‘’‛ʼ´`"} | {ord(c): "-" for c in "‐‑‒–—−"}


@dataclass(frozen=True)
class LookAlikes:
    """Prototype of every character that has another one, and the characters of each prototype."""

    prototype: dict[str, str]
    members: dict[str, str]

    def in_script(self, c: str, own: str) -> str:
        """The ordinary letter of script ``own`` that ``c`` looks like, in the same case if there is one; else ``c``."""
        like = [x for x in self.members.get(self.prototype.get(c, c), "") if script(x) == own and (own != "LATIN" or _ordinary_latin(x)) and not styled(x)]
        return min(like, key=lambda x: (x.isupper() != c.isupper(), not x.isascii(), x), default=c)


def look_alikes(spark: SparkSession) -> LookAlikes:
    """The whole table: one call of the driver's ICU for all of Unicode's characters, so its size is fixed."""
    every = [chr(o) for o in range(0x20, 0x110000) if unicodedata.category(chr(o)) not in ("Cn", "Cs", "Co", "Cc", "Zl", "Zp")]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(every)).split("\n")
    if len(skeletons) != len(every):
        raise RuntimeError("the look-alike table can't be read")
    table = {c: p for c, p in zip(every, skeletons) if p != unicodedata.normalize("NFD", c) and not invisible(c) and not unicodedata.combining(c)}
    table |= {c: table.get(p, p) for c, p in PROTOTYPE.items()}
    members: dict[str, list[str]] = {}
    for c, p in table.items():
        members.setdefault(p, [p] if len(p) == 1 else []).append(c)
    return LookAlikes(table, {p: "".join(cs) for p, cs in members.items()})


def _to_latin(c: str) -> str:
    if c.isascii() or _ordinary_latin(c):
        return c
    base = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", PROTOTYPE.get(base[0], base[0]) + base[1:])


def skeleton(text: str | None, prototype: dict[str, str] = PROTOTYPE) -> str | None:
    """Equal for texts that look alike: decomposed, prototypes, decomposed again, case kept."""
    if text is None:
        return None
    t = "".join(" " if odd_space(c) else c for c in text if not invisible(c))
    t = t.translate(_PUNCTUATION)
    for form in ("NFC", "NFD", "NFKD"):  # some look-alikes would decompose to other letters than they show
        t = "".join(prototype.get(c, c) for c in unicodedata.normalize(form, t))
    return " ".join(unicodedata.normalize("NFD", t.translate(_PUNCTUATION)).split())


def _ascii_skeleton(text: Column, prototype: dict[str, str]) -> Column:
    """Skeleton of a text in printable ASCII, on the JVM."""
    made = {c: skeleton(f"x{c}x", prototype)[1:-1] for c in map(chr, range(0x21, 0x7F))}
    if any(not p.isascii() for p in made.values()):
        # Signs whose prototype isn't ASCII: all are replaced one by one, none is made by another's replacement.
        out = text
        for c in [c for c, p in made.items() if not p.isascii()]:
            out = F.replace(out, F.lit(c), F.lit(made[c]))
        text = out
    one = {c: p for c, p in made.items() if p != c and len(p) == 1 and p.isascii()}
    more = {c: p for c, p in made.items() if len(p) > 1 and p.isascii()}
    out = F.translate(text, "".join(one), "".join(one.values()))
    for c, p in more.items():  # their prototypes hold no character that has a prototype itself
        out = F.replace(out, F.lit(c), F.lit(p))
    return out


def annotate(df: DataFrame, text: str) -> DataFrame:
    """Add is_odd, plain, plain_odd and skeleton to every row; columns of these names are replaced.

    A null text is not odd and has null forms, an empty one empty forms. Texts in printable ASCII
    without blanks at an end or in a run don't leave the JVM: they are their own plain form.
    ``plain_odd`` says whether even the plain form has a character that isn't ordinary.
    """
    added = ("is_odd", "plain", "plain_odd", "skeleton")
    if text in added:
        raise ValueError(f"{text} would be replaced")
    df = df.drop(*added, "__forms")
    simple = F.col(text).rlike(r"^[!-_a-~]+( [!-_a-~]+)*$")
    known = look_alikes(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(known)  # as large as the table of Unicode

    @F.pandas_udf("is_odd boolean, plain string, plain_odd boolean, skeleton string")
    def forms(s: pd.Series) -> pd.DataFrame:
        cache: dict = {}
        for t in s:
            if t is not None and t not in cache:
                plain = plain_form(t, held.value)
                cache[t] = (odd_characters(t), plain, odd_characters(plain), skeleton(t, held.value.prototype))
        return pd.DataFrame([cache.get(t, (False, None, False, None)) for t in s], columns=list(added))

    plain = df.where(simple | F.col(text).isNull()).select("*", F.lit(False).alias("is_odd"), F.col(text).alias("plain"), F.lit(False).alias("plain_odd"), _ascii_skeleton(F.col(text), known.prototype).alias("skeleton"))
    rest = df.where(~simple).withColumn("__forms", forms(text)).select("*", *(f"__forms.{c}" for c in added)).drop("__forms")
    return plain.unionByName(rest)


def look_alike_groups(df: DataFrame, text: str) -> DataFrame:
    """(skeleton, n_rows, n_forms, plain): originals of equal skeleton, counted in two levels.

    ``plain`` is the ordinary text of the group: the plain form most rows have, the smallest of equally
    many, null if none is free of odd characters. Null texts give no row.
    """
    by_form = annotate(_forms(df, text), "form")
    by_plain = by_form.groupBy("skeleton", "plain", "plain_odd").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
    ordinary = F.min_by("plain", F.when(~F.col("plain_odd"), F.struct(-F.col("n"), F.col("plain"))))
    return by_plain.groupBy("skeleton").agg(F.sum("n").alias("n_rows"), F.sum("forms").alias("n_forms"), ordinary.alias("plain"))


def _forms(df: DataFrame, text: str) -> DataFrame:
    """Each distinct text with its number of rows: a frequent one is a single row from here on."""
    return df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("form")).agg(F.count("*").alias("n"))


def look_alike_rows(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text isn't the ordinary one for what it shows.

    Distinct texts are grouped by skeleton; those that differ from the ordinary text of their group
    (or have none) are proposed, and those with a character that isn't ordinary remain. Their rows are
    found by a join that cuts frequent texts in shards. Null texts are no cases.
    """
    by_form = cut(annotate(_forms(df, text), "form"))
    by_plain = by_form.groupBy("skeleton", "plain", "plain_odd").agg(F.sum("n").alias("n"))
    ordinary = by_plain.where(~F.col("plain_odd")).groupBy("skeleton").agg(F.min_by("plain", F.struct(-F.col("n"), F.col("plain"))).alias("ordinary"))
    other = by_form.join(ordinary, "skeleton", "left").where(~F.col("form").eqNullSafe(F.col("ordinary")))
    cases = other.where("is_odd").select(F.col("form").alias(text))
    # Plain ASCII is never a case, so its rows, among them the frequent names, stay where they are.
    rows = df.where(F.col(text).isNotNull() & ~F.col(text).rlike(r"^[!-_a-~]+( [!-_a-~]+)*$"))
    return fragment_join(rows, cases, text, "left_semi").select(*df.columns)
