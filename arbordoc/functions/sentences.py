"""Sentence boundaries by the default rules of Unicode text segmentation, on general categories.

Character classes come from the standard library's Unicode data: letters by case, digits, the terminators
and closers of the common scripts.  Locale tailorings (lists of abbreviations) are not part of the rules.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Terminators that may stand inside an abbreviation, other terminators, and signs that go on.
_ATERM = ".․﹒．"
_STERM = "!?։؟۔܀܁܂߹।॥၊။።፧፨᙮។៕᠃᠉‼‽⁇⁈⁉。｡！？⸮꓿"
_CONTINUE = ",-:՝،؍߸᠂᠈–—、︐︑︓︱︲﹐﹑﹕﹘﹣，－：､"


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    if c == "\r":
        return "CR"
    if c == "\n":
        return "LF"
    if c in "\x85  ":
        return "Sep"
    if c in _ATERM:
        return "ATerm"
    if c in _STERM:
        return "STerm"
    if c in _CONTINUE:
        return "SContinue"
    category = unicodedata.category(c)
    if category in ("Mn", "Me", "Mc") or c == "‍" or c == "‌":
        return "Extend"
    if category == "Cf":
        return "Format"
    if category == "Zs" or c in "\t\x0b\x0c":
        return "Sp"
    if category == "Nd":
        return "Numeric"
    if category in ("Ps", "Pe", "Pi", "Pf") or c in "\"'":
        return "Close"
    if category == "Ll" or c in "ªº":
        return "Lower"
    if category in ("Lu", "Lt"):
        return "Upper"
    if category[0] == "L" or category == "Nl":
        return "OLetter"
    return "Other"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in characters; together they are the text."""
    n = len(text)
    if not n:
        return []
    kinds = [_kind(c) for c in text]
    # marks and format characters belong to what they follow
    solid: list[int] = []
    for i, k in enumerate(kinds):
        if k not in ("Extend", "Format") or not solid or kinds[solid[-1]] in ("CR", "LF", "Sep"):
            solid.append(i)
    seq = [kinds[i] if kinds[i] not in ("Extend", "Format") else "Other" for i in solid]
    breaks = []
    m = len(seq)
    for j in range(1, m):
        before = seq[j - 1]
        if before in ("Sep", "LF") or before == "CR" and seq[j] != "LF":
            breaks.append(solid[j])
            continue
        if before == "CR":
            continue
        # terminator, closers, blanks, at most one separator right before j
        p = j - 1
        spaces = 0
        while p >= 0 and seq[p] == "Sp":
            p -= 1
            spaces += 1
        closers = 0
        while p >= 0 and seq[p] == "Close":
            p -= 1
            closers += 1
        if p < 0 or seq[p] not in ("ATerm", "STerm"):
            continue
        here = seq[j]
        if here in ("Sep", "CR", "LF") or here == "Sp" or here == "Close" and not spaces:
            continue
        if here in ("SContinue", "STerm", "ATerm"):
            continue
        if seq[p] == "ATerm":
            if not spaces and not closers and here == "Numeric":
                continue
            if not spaces and not closers and here == "Upper" and p > 0 and seq[p - 1] in ("Upper", "Lower"):
                continue
            q = j
            while q < m and seq[q] not in ("OLetter", "Upper", "Lower", "Sep", "CR", "LF", "ATerm", "STerm"):
                q += 1
            if q < m and seq[q] == "Lower":
                continue
        breaks.append(solid[j])
    edges = [0, *breaks, n]
    return list(zip(edges, edges[1:]))


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text)]
