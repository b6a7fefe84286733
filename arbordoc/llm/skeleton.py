"""Look-alike skeletons: one comparison key for all spellings a reader cannot tell apart.

The key of a text is built in three steps: decompose, replace every character by the prototype of its
look-alike class, decompose again.  Two texts look the same exactly if their keys are equal.

What a prototype is:

* full-width, half-width, font, positional and no-break variants, ligatures and other compatibility
  letters become the plain characters that Unicode's own decomposition names;
* super- and subscripts, fractions, circled and squared characters keep their look and stay themselves;
* letters and signs drawn like another one become that one, by the public table of Unicode confusables that
  Spark's own jars hold; characters of ASCII stay themselves, and so do marks, digits and pictures;
* every blank of the separator class becomes U+0020, every hyphen U+002D;
* invisible characters vanish, except where they change the picture: joiners between emoji and
  between letters of joining scripts, variation selectors behind symbols with two presentations.

Letter case, accents and spelling are untouched.
"""

from __future__ import annotations

import atexit
import glob
import importlib
import os
import re
import shutil
import struct
import tempfile
import unicodedata
import zipfile
from functools import lru_cache

#: A module with the table, for machines that have no jars: see :func:`ship`.
_SHIPPED = "arbordoc_lookalikes"
# Letters that the public table parts from, or takes for, another letter than the one they are drawn like.
_CORRECTED = {"\u04cf": "l", "\u0237": "j", "\u0575": "j", "\u051a": "Q", "\u053c": "L"}
#: Kinds of characters that may be drawn like another one; marks, digits, pictures and signs of currency keep their look.
_DRAWN_ALIKE = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Pd", "Po", "Ps", "Pe", "Pc", "Sm")


#: Scripts of syllables and ideographs, whose characters are told apart by the words they stand in.
_OWN_DRAWING = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "KANGXI", "HALFWIDTH", "IDEOGRAPHIC", "YI ", "VERTICAL")


def read_confusables(jar: str) -> dict[str, str]:
    """The confusables of Unicode as ICU packs them: each character's prototype.

    The entry is a header, then sorted keys (the code point, and in the top byte the prototype's length
    less one), their values (the prototype itself, or where it begins in a table of UTF-16), and that table.
    """
    with zipfile.ZipFile(jar) as held:
        raw = held.read(next(n for n in held.namelist() if n.endswith("/confusables.cfu")))
    body = raw[struct.unpack(">H", raw[:2])[0] :]
    keys_at, keys, values_at, values, table_at, table = struct.unpack(">6I", body[12:36])
    codes = struct.unpack(f">{keys}I", body[keys_at : keys_at + 4 * keys])
    places = struct.unpack(f">{values}H", body[values_at : values_at + 2 * values])
    text = body[table_at : table_at + 2 * table]
    return {chr(k & 0x1FFFFF): chr(v) if k >> 24 == 0 else text[2 * v : 2 * (v + (k >> 24) + 1)].decode("utf-16-be") for k, v in zip(codes, places)}


def lookalikes_from(confusables: dict[str, str]) -> dict[str, str]:
    """Characters outside ASCII by the one they are drawn like.

    Only single letters (with their marks) and signs count, so that spellings stay apart; the table's
    classes that hold several characters of ASCII are parted again, by the case of the letter.
    """
    out = {}
    for ch, like in confusables.items():
        kind = unicodedata.category(ch)
        bases = [c for c in unicodedata.normalize("NFD", like) if not unicodedata.combining(c)]
        if ch < "\x80" or kind not in _DRAWN_ALIKE or len(bases) != 1 and like != "rn" or unicodedata.name(ch, "").startswith(_OWN_DRAWING):
            continue
        if like == "l":
            like = "I" if kind in ("Lu", "Nl") else "l"
        out[ch] = "m" if like == "rn" else like
    return out | _CORRECTED


@lru_cache(maxsize=1)
def lookalikes() -> dict[str, str]:
    """The table of this machine: from ICU's data among Spark's jars, or as it was shipped."""
    try:
        return importlib.import_module(_SHIPPED).TABLE
    except ImportError:
        pass
    import pyspark

    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    jars = sorted(j for h in homes if h for j in glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))
    if not jars:
        raise FileNotFoundError("Spark's jars with the look-alike table (icu4j) are not here: call ship() on the driver")
    return lookalikes_from(read_confusables(jars[-1]))


def ship(spark) -> None:
    """Gives Python workers the driver's table, so that all have the same; once per application."""
    context = spark.sparkContext
    if getattr(context, "_arbordoc_lookalikes", False):
        return
    aside = tempfile.mkdtemp(prefix="arbordoc-")
    atexit.register(shutil.rmtree, aside, ignore_errors=True)
    path = os.path.join(aside, _SHIPPED + ".py")
    with open(path, "w", encoding="utf-8") as file:
        file.write(f"TABLE = {lookalikes()!r}\n")
    context.addPyFile(path)
    context._arbordoc_lookalikes = True


# Hyphens and dashes drawn as a short horizontal stroke, by the plain hyphen.
HYPHENS = "\u2010\u2011\u2012\u2013\u2212\u02d7\ufe58\ufe63\uff0d\u2043"
# Single quotation marks drawn as an apostrophe.
APOSTROPHES = "\u2019\u02bc\uff07"

#: Kinds of Unicode compatibility decomposition whose result looks the same as the source.
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>"}
_JOINING = ("ARABIC", "SYRIAC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "MONGOLIAN", "KHMER", "MYANMAR")
_JOINERS = "\u200c\u200d"
_INVISIBLE_MARKS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


@lru_cache(maxsize=1 << 16)
def prototype(ch: str) -> str:
    """The look-alike class of one character, independent of its neighbours."""
    if ch < "\x80":
        return ch
    if ch in HYPHENS:
        return "-"
    if ch in APOSTROPHES:
        return "'"
    category = unicodedata.category(ch)
    if category == "Zs":
        return " "
    if category == "Cf" or ch in _INVISIBLE_MARKS:
        return ""
    parts = unicodedata.decomposition(ch).split()
    if parts:
        if parts[0][0] != "<":
            return "".join(prototype(c) for c in unicodedata.normalize("NFD", ch))
        if parts[0] == "<compat>" and ch in lookalikes():
            return lookalikes()[ch]
        if parts[0] in _SAME_LOOK or parts[0] == "<compat>" and (category[0] == "L" or category == "Nl" or ch in "‥…"):
            return "".join(prototype(chr(int(p, 16))) for p in parts[1:])
        return ch
    return lookalikes().get(ch, ch)


@lru_cache(maxsize=1 << 14)
def _pictograph(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk") or ch in "\ufe0f\u20e3"


@lru_cache(maxsize=1 << 14)
def _joins(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith(_JOINING)


def _meaningful(text: str, i: int) -> bool:
    """Whether the invisible character at i changes the picture."""
    ch = text[i]
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if ch == "\u200d" and before and after and _pictograph(before) and _pictograph(after):
        return True
    if ch in _JOINERS and before and after and _joins(before) and _joins(after):
        return True
    if "\U000e0020" <= ch <= "\U000e007f":
        return True
    return ch in "\ufe0e\ufe0f" and bool(before) and before < "\U0001f300"


def _units(text: str):
    """(source index, prototype) of every character that shows."""
    for i, ch in enumerate(text):
        if ch < "\x80":
            yield i, ch
        elif "\ufe00" <= ch <= "\ufe0f" or ch in _JOINERS or "\U000e0000" <= ch <= "\U000e007f":
            if _meaningful(text, i):
                yield i, ch
        else:
            p = prototype(ch)
            if p:
                yield i, p


class _Prototypes(dict):
    """Code points to prototypes, filled as they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = p = prototype(chr(code))
        return p


_PROTOTYPES = _Prototypes({code: chr(code) for code in range(128)})
#: Invisible characters that may change the picture.
_CONTEXTUAL = re.compile("[\u200c\u200d\ufe00-\ufe0f\U000e0000-\U000e007f]")


def skeleton(text: str) -> str:
    """The comparison key; ordinary blanks at both ends do not count."""
    if text.isascii():
        return text.strip(" ")
    plain = unicodedata.normalize("NFD", text)
    out = "".join(p for _, p in _units(plain)) if _CONTEXTUAL.search(plain) else plain.translate(_PROTOTYPES)
    return unicodedata.normalize("NFD", out).strip(" ")


def unify(text: str) -> tuple[str, str | None]:
    """The consistent form of a text, and its position map (``pos delta`` pairs) back to the text.

    The form is the composed (NFC) skeleton without the outer blanks.  Both sides of the map count
    UTF-16 units: source position = position - delta of the last pair at or before it; None if the
    positions are one to one.  A character of the form points at the first source character it came from.
    """
    if text.isascii():
        lead = len(text) - len(text.lstrip(" "))
        return text.strip(" "), (f"0 {-lead}" if lead and text.strip(" ") else None)
    clusters: list[tuple[str, int]] = []  # (shown characters, UTF-16 position of their first source character)
    at, start = 0, 0
    while start < len(text):
        end = start + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        while end < len(text) and "\u1160" <= text[end] <= "\u11ff" and unicodedata.category(text[end]) == "Lo":
            end += 1  # conjoining vowels and finals of a Hangul syllable
        piece = text[start:end]
        plain = unicodedata.normalize("NFD", piece)
        left = text[start - 1 : start]
        shown = "".join(p for i, p in _units(left + plain + text[end : end + 1]) if len(left) <= i < len(left) + len(plain))
        if shown:
            if clusters and unicodedata.combining(shown[0]):  # a mark parted from its base by something invisible
                clusters[-1] = (clusters[-1][0] + shown, clusters[-1][1])
            else:
                clusters.append((shown, at))
        at += len(piece) + sum(c > "\uffff" for c in piece)
        start = end
    while clusters and clusters[0][0] == " ":
        clusters.pop(0)
    while clusters and clusters[-1][0] == " ":
        clusters.pop()
    out, pairs, pos, delta = [], [], 0, 0
    for shown, source in clusters:
        form = unicodedata.normalize("NFC", shown)
        for k, c in enumerate(form):
            if k == 0 and pos - source != delta:
                delta = pos - source
                pairs.append(f"{pos} {delta}")
            elif k and pos - source != delta:  # later characters of a ligature keep pointing at it
                delta = pos - source
                pairs.append(f"{pos} {delta}")
            out.append(c)
            pos += 1 + (c > "\uffff")
    return "".join(out), (" ".join(pairs) or None)
