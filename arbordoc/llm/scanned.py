"""Problem 4: text of scanned pages as continuous paragraphs.

Headers and footers are found by fuzzy repetition of the lines at page edges within a tree, page numbers
by their sequence; words parted at line ends are joined by what the corpus's vocabulary says, and words
with wrongly recognised characters are those that a confusion, one that the corpus shows again and again
or one generally known, turns into a far commoner word.

Pages are looked at in windows of ``WINDOW`` pages with ``HALO`` pages of context on both sides, so that
no tree, however long, has to be held by one task.  The vocabulary is a table like any other: words reach
their counts by joins of pre-aggregated, distinct words, never by a broadcast of the corpus's words.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..cluster import cut

WINDOW = 64
HALO = 6
#: Fuzzy equality of two edge lines.
ALIKE = 0.8
#: How much commoner the right word must be than the misread one.
RATIO = 4

#: A substitution is learnt if so many doubtful words show it, and this share of them, which bounds how many there can be.
LEARNT_WORDS, LEARNT_SHARE = 5, 1e-3
# What is read, and what may have stood there, besides what a corpus shows itself.
CONFUSIONS = [
    ("€", "e"), ("c", "e"), ("i", "r"), ("â", "a"), ("cl", "d"), ("!", "t"), ("l", "i"), ("ii", "n"), ("0", "o"), ("1", "l"),
    ("5", "s"), ("ii", "u"), ("(", "c"), ("rn", "m"), ("b", "h"), ("y", "v"), ("8", "b"), ("m", "in"), ("q", "g"), ("ſ", "f"),
    ("vv", "w"), ("m", "rn"), ("h", "li"), ("1", "i"), ("o", "c"), ("e", "c"), ("h", "b"), ("u", "ii"), ("d", "cl"), ("t", "f"),
    ("f", "t"), ("6", "b"), ("9", "g"), ("$", "s"), ("@", "a"), ("|", "l"), ("|", "i"), ("n", "u"), ("u", "n"), ("li", "h"),
    ("ê", "e"), ("î", "i"), ("ô", "o"), ("û", "u"), ("ri", "n"), ("m", "ni"), ("in", "m"), ("v", "y"), ("w", "vv"), ("g", "q"),
]
# The hyphens and their misreadings at line ends.
MARKS = "-­¬=‐‑"
_SUSPENDED = {"and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "o", "e", "en", "of"}
_ROMAN = re.compile(r"(?=[ivxlcdm1])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})")
_DIGITS = str.maketrans({"l": "1", "i": "1", "|": "1", "o": "0", "s": "5", "b": "8", "z": "2", "!": "1"})


def _number(token: str) -> int | None:
    """The value of a page number as a scan may give it, roman ones too."""
    t = token.strip("[](){}.,:;-–—|·• ").casefold()
    if not t or len(t) > 9:
        return None
    if any(c.isdigit() for c in t):
        t = t.translate(_DIGITS)
        return int(t) if t.isascii() and t.isdigit() else None
    if _ROMAN.fullmatch(t):
        value, high = 0, 0
        for c in reversed(t):
            v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
            value, high = (value - v, high) if v < high else (value + v, v)
        return value
    return None


def _edge(line: str) -> tuple[str, int | None]:
    """(letters of a line at a page edge, in lower case and without its page number; the page number)."""
    s = " ".join(line.split())
    m = re.fullmatch(r"\W*(?:page|seite|página|pagina|p\.?|s\.?)\s+(\S+)(?:\s*(?:of|von|de|sur|/)\s*\S+)?\W*", s, re.I)
    if m and _number(m[1]) is not None:
        return "", _number(m[1])
    if _number(s) is not None:
        return "", _number(s)
    words = s.split(" ")
    number = None
    if len(words) > 1:
        bare = len(words[-1].strip("[]()-|.")) > 0
        if bare and _number(words[-1]) is not None and (words[-2] in (".", "|", "·", "-", "–", "•", "/") or "  " in line.strip() or re.fullmatch(r"[\[(]?\d+[\])]?", words[-1])) and not words[-1].endswith("."):
            number, words = _number(words[-1]), words[:-1]
        elif _number(words[0]) is not None and (words[0][0] in "[(" or words[1] in (".", "|", "·", "-", "–", "•", "/") or "  " in line.strip()):
            number, words = _number(words[0]), words[1:]
    return re.sub(r"[\W_]+", " ", " ".join(words).casefold()).strip(), number


@lru_cache(maxsize=1 << 12)
def _letters(text: str) -> Counter:
    return Counter(text)


def _ratio(a: str, b: str, least: float) -> bool:
    """Whether two lines match in at least that share of their letters; those they have in common at all are a bound."""
    other = _letters(b)
    if 2 * sum(min(n, other[c]) for c, n in _letters(a).items()) < least * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


@lru_cache(maxsize=1 << 15)
def _alike(a: str, b: str) -> bool:
    """Whether two edge lines are the same but for misread or cut-off letters."""
    if a == b:
        return bool(a)
    short, long = sorted((a, b), key=len)
    if not short:
        return False
    if len(short) >= 8 and long.startswith(short[:-1]):
        return True
    words = set(short.split())
    if len(words) > 1 and not any(len(w) > 2 for w in words.intersection(long.split())):
        return False
    if 2 * len(short) >= ALIKE * (len(a) + len(b)) and _ratio(a, b, ALIKE):
        return True
    return 8 <= len(short) < len(long) and _ratio(short, long[: len(short)], 0.85)


class _Edges:
    """The distinct keys of edge lines and the pages on which they, or keys alike, stand."""

    def __init__(self, keys: list[list[str]], indexes: list[int], recurring):
        self.pages: dict[str, tuple[int, int]] = {k: (a, z) for k, a, z in recurring}
        for index, on_page in zip(indexes, keys):
            for k in on_page:
                a, z = self.pages.get(k, (index, index))
                self.pages[k] = (min(a, index), max(z, index))
        self.words: dict[str, list[str]] = {}
        self.openings: dict[str, list[str]] = {}
        self.single: list[str] = []
        for k in self.pages:
            words = set(k.split())
            for w in words:
                self.words.setdefault(w, []).append(k)
            self.openings.setdefault(k[:7], []).append(k)
            if len(words) == 1:
                self.single.append(k)
        self.spans: dict[str, tuple[int, int]] = {}

    def span(self, key: str) -> tuple[int, int]:
        """(first, last) page on which a key alike stands; beyond each other if none does."""
        if key not in self.spans:
            words = key.split()
            # only keys with a word in common, the same beginning, or of a single word can be alike
            near = self.pages if len(words) == 1 else {k for w in words if len(w) > 2 for k in self.words.get(w, ())}.union(self.openings.get(key[:7], ()), self.single)
            alike = [self.pages[k] for k in near if _alike(key, k)]
            self.spans[key] = (min((a for a, _ in alike), default=1 << 40), max((z for _, z in alike), default=-(1 << 40)))
        return self.spans[key]

    def before(self, key: str, index: int) -> bool:
        return self.span(key)[0] < index

    def later(self, key: str, index: int) -> bool:
        return self.span(key)[1] > index

    def elsewhere(self, key: str, index: int) -> bool:
        return self.before(key, index) or self.later(key, index)


def _edge_lines(text: str) -> tuple[list[str], list[int], dict[int, tuple[str, int | None]]]:
    """(lines of a page, the numbers of those that are not blank, what the first two and last two of these say)."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    return lines, full, {i: _edge(lines[i]) for i in dict.fromkeys(full[:2] + full[-2:])}


def classify_pages(pages: list[tuple[int, str]], recurring=(), in_order=()) -> list[list[str]]:
    """For each page (index, text), ascending, the kind of every line: 'blank', 'furniture', 'title' or 'text'.

    Of a tree too long to be here whole, ``recurring`` has the edge keys that stand on several of its pages
    (key, first page, last page), and ``in_order`` by how much its printed numbers run ahead of page indexes.
    """
    kinds, edges = [], [_edge_lines(text) for _, text in pages]
    for lines, full, _ in edges:
        told = set(full)
        kinds.append(["text" if i in told else "blank" for i in range(len(lines))])

    # numbers that follow the order of pages
    shifts: dict[int, int] = {}
    for (index, _), (_, _, found) in zip(pages, edges):
        for shift in {n - index for _, n in found.values() if n is not None}:
            shifts[shift] = shifts.get(shift, 0) + 1
    in_order = {s for s, n in shifts.items() if n > 1}.union(in_order)

    def ends(p: int) -> bool:
        """Whether the text before page p is at the end of a sentence, furniture at that page's foot aside."""
        if p == 0:
            return True
        lines, full, _ = edges[p - 1]
        body = [i for i in full if kinds[p - 1][i] == "text"]
        return not body or lines[body[-1]].rstrip()[-1:] in ".!?\"”’)"

    keys = _Edges([[k for k, _ in found.values() if len(k) > 2] for _, _, found in edges], [index for index, _ in pages], recurring)
    for p, ((index, _), (lines, full, found)) in enumerate(zip(pages, edges)):
        kind = kinds[p]
        longest = max((len(x) for x in lines), default=0)

        def numbered(i: int) -> bool:
            n = found[i][1]
            return n is not None and (n - index in in_order or not in_order or found[i][0] == "")

        # foot first: the text's end decides on the next page's head
        for step, i in enumerate(reversed(full[-2:])):
            if step and kind[full[-1]] != "furniture" or len(full) < 3 and not numbered(i):
                break
            key = found[i][0]
            line = lines[i].strip()
            if numbered(i) and (key == "" or len(line) < 0.9 * longest and (keys.elsewhere(key, index) or re.search(r"[|·•]\s*\S+$|\s\.\s\S+$", line))):
                kind[i] = "furniture"
            elif key and len(line) < 0.9 * longest and line[-1:] not in ".!?,;" and keys.elsewhere(key, index):
                kind[i] = "furniture"
        for step, i in enumerate(full[:2]):
            if kind[i] == "furniture":
                continue
            key = found[i][0]
            line = lines[i].strip()
            rest = [j for j in full if j > i and kind[j] == "text"]
            opens = bool(rest) and (lines[rest[0]].strip()[:1].isupper() or not lines[rest[0]].strip()[:1].isalpha()) and ends(p)
            upper = line.upper() == line and any(c.isalpha() for c in line)
            sentence = line[-1:] in ".!?,;:-­¬=" and found[i][1] is None or len(line) > 0.92 * longest and not upper
            if step == 0:
                chapter = re.fullmatch(r"\W*(?:chapter|kapitel|chapitre|capítulo|part|book)\s+\S+\W*", line, re.I) is not None
                if chapter:
                    kind[i] = "title"
                    if len(full) > 1 and lines[full[1]].strip().upper() == lines[full[1]].strip() or i + 2 < len(lines) and not lines[i + 2].strip() and lines[i + 1].strip():
                        kind[full[1]] = "title"
                    break
                if key == "" and found[i][1] is not None:
                    kind[i] = "furniture"
                    continue
                if not key or len(key) < 3:
                    break
                before = keys.before(key, index)
                later = keys.later(key, index)
                if found[i][1] is not None and numbered(i) and len(line) < 0.95 * longest:
                    kind[i] = "furniture"
                elif index == 0 and p == 0 and not sentence and line[:1].isupper():
                    kind[i] = "title"
                elif sentence and not before and not later:
                    break
                elif before and not (sentence and not _repeats(key, p, edges, recurring)):
                    kind[i] = "furniture"
                elif opens and (upper or not before and not sentence and line[:1].isupper() and len(line) < 0.8 * longest):
                    # a line over text that it opens, and that did not stand there before: a title, also if it runs on as a header
                    kind[i] = "title"
                elif not sentence and (later or (upper or line[:1].isupper()) and len(line) < 0.8 * longest):
                    kind[i] = "furniture"
                if kind[i] not in ("furniture", "title"):
                    break
            elif kind[full[0]] == "furniture":
                if key == "" and found[i][1] is not None and numbered(i):
                    kind[i] = "furniture"
                elif upper and not sentence and opens and len(key) > 2 and i + 1 < len(lines) and not lines[i + 1].strip():
                    kind[i] = "title"
    return kinds


def _repeats(key: str, p: int, edges, recurring) -> bool:
    """Whether the very line, case and page number aside, is at the same place of another page, or recurs in the tree."""
    here = (found[full[0]][0] for q, (_, full, found) in enumerate(edges) if q != p and full)
    return any(_alike(k, key) for k in here) or any(_alike(k, key) for k, _, _ in recurring)


@lru_cache(maxsize=1 << 16)
def _raw(token: str) -> str:
    """A token without outer punctuation; '!' and '(' stay, as they may be misread letters."""
    return token.strip(".,;:?\"'“”‘’«»[]{}…").rstrip(")").lower()


def base_form(raw: str) -> str:
    return raw.strip("!(.,;:?\"'”’)")


# What is known of a window of pages: its lines as arrays side by side, each with the word parted at its end (left,
# right, marked); the word parted before its first line of text (coming); its words with the lines they are in.
_WINDOW = (
    "sdt_id bigint, window int, page array<int>, line array<int>, kind array<string>, text array<string>, left array<string>, right array<string>, "
    "marked array<boolean>, opens array<boolean>, coming struct<left:string,right:string,marked:boolean>, raw array<string>, count array<int>, places array<array<int>>"
)


def read_window(pages: list[tuple[int, str]], owned, recurring=(), in_order=()) -> tuple[list[list], dict[str, list[int]], tuple]:
    """(lines, words, coming) of the owned ones among some pages (index, text), ascending.

    A line is [page, line, kind, text, left, right, marked, opens]; ``words`` has for each word as it was
    read the numbers of the lines it stands in, once per time; ``coming`` is the pair (left, right, marked)
    at the end of the text before the first line.  A word parted by a hyphen is in neither line; of line
    ends without a hyphen the two words beside are pairs as well.
    """
    kinds = classify_pages(pages, recurring, in_order)
    places = [(index, no, k, line) for (index, text), kind in zip(pages, kinds) for no, (line, k) in enumerate(zip(text.split("\n"), kind))]
    flow = [x for x in places if x[2] in ("text", "title")]
    after = dict(zip(((x[0], x[1]) for x in flow), [*flow[1:], None]))
    lines: list[list] = []
    words: dict[str, list[int]] = {}
    none = (None, None, None)
    pair, first = none, None  # the pair at the end of the line before; the one before the first line
    before = blank = None  # the line of text or title before; the place behind the last blank line
    for index, no, kind, line in places:
        mine = owned(index)
        if mine and first is None:
            first = pair
        if kind == "blank":
            blank = (index, no + 1)
        if kind != "text":
            if kind == "title":
                pair, before = none, (index, kind)
            if mine:
                lines.append([index, no, kind, line, *none, None])
            continue
        tokens = line.split()
        opens = line[:1] == " " or before is not None and (before[1] == "title" or blank == (index, no) and before[0] == index)
        start = 1 if pair[2] else 0  # the first word belongs to the line before
        pair, following = none, after[index, no]
        if following and following[2] == "text" and tokens and following[3].split():
            last, begins = tokens[-1], following[3].split()[0]
            marked = len(last) > 1 and last[-1] in MARKS and (last[-2].isalnum() or last[-2] in "€!(ſ")
            if marked or (last[-1].isalpha() and begins[:1].islower() and len(tokens) > start):
                pair = (_raw(last.rstrip(MARKS) if marked else last), _raw(begins), marked)
        before = (index, kind)
        if mine:
            for t in tokens[start : len(tokens) - (1 if pair[2] else 0)]:
                if w := _raw(t):
                    words.setdefault(w, []).append(len(lines))
            lines.append([index, no, kind, line, *pair, opens])
    return lines, words, first or none


def _pages_of(held: list[dict]) -> list[tuple[int, str]]:
    """Pages in order, one text of each."""
    one: dict[int, str] = {}
    for p in held:
        index, text = p["page_index"], p["text"]
        one[index] = min(one.get(index, text), text)
    return sorted(one.items())


def _gathered(pages: DataFrame) -> DataFrame:
    """(sdt_id, window, pages): the pages (page_index, text) of each window, with HALO pages of context."""
    inside = F.pmod("page_index", F.lit(WINDOW))
    home = F.floor(F.col("page_index") / WINDOW).cast("int")
    windows = F.array_compact(F.array(home, F.when((inside < HALO) & (home != 0), home - 1), F.when(inside >= WINDOW - HALO, home + 1)))
    rows = pages.select("sdt_id", F.struct("page_index", "text").alias("p"), F.explode(windows).alias("window"))
    return rows.groupBy("sdt_id", "window").agg(F.collect_set("p").alias("pages"))


def _tree_edges(windows: DataFrame) -> DataFrame:
    """(sdt_id, window, recurring, in_order) for each of the windows: what stands at the page edges of the whole tree.

    A key is sent on only if it stands on several pages, a shift of the numbers only if several pages have it.
    """

    def told(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for index, text in _pages_of(r["pages"]):
                    if index // WINDOW == r["window"]:
                        found = _edge_lines(text)[2].values()
                        rows += [(r["sdt_id"], index, k, None) for k, _ in found if len(k) > 2]
                        rows += [(r["sdt_id"], index, None, n - index) for n in {n for _, n in found if n is not None}]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.string(), pa.int32()))], ["sdt_id", "page", "key", "shift"])

    seen = windows.mapInArrow(told, "sdt_id bigint, page int, key string, shift int")
    several = seen.groupBy("sdt_id", "key", "shift").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last")
    keys = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "first", "last")))
    trees = several.groupBy("sdt_id").agg(keys.alias("recurring"), F.collect_list("shift").alias("in_order"))
    return windows.select("sdt_id", "window").join(trees, "sdt_id")


def page_windows(pages: DataFrame) -> DataFrame:
    """The lines of the pages (sdt_id, page_index, text), classified, one row per window of a tree.

    Of pages with one (sdt_id, page_index) one text counts; NULL keys and texts have no lines.  A tree of
    several windows tells each of them what recurs at its page edges.
    """
    whole = pages.where("text IS NOT NULL AND sdt_id IS NOT NULL AND page_index IS NOT NULL")
    windows = _gathered(whole)
    long = whole.where(~F.col("page_index").between(0, WINDOW - 1)).select("sdt_id").distinct()
    if long.isEmpty():
        windows = windows.select("*", F.lit(None).cast("array<struct<key:string,first:int,last:int>>").alias("recurring"), F.lit(None).cast("array<int>").alias("in_order"))
    else:
        windows = windows.join(cut(_tree_edges(_gathered(whole.join(long, "sdt_id", "left_semi")))), ["sdt_id", "window"], "left")

    def read(batches):
        kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.bool_()]
        coming = pa.struct([("left", pa.string()), ("right", pa.string()), ("marked", pa.bool_())])
        types = [pa.int64(), pa.int32(), *(pa.list_(t) for t in kinds), coming, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
        names = [f.split()[0] for f in _WINDOW.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                recurring = [tuple(k.values()) for k in r["recurring"] or ()]
                lines, words, pair = read_window(_pages_of(r["pages"]), lambda index, w=r["window"]: index // WINDOW == w, recurring, r["in_order"] or ())
                columns = map(list, zip(*lines)) if lines else [[]] * len(kinds)
                rows.append((r["sdt_id"], r["window"], *columns, dict(zip(("left", "right", "marked"), pair)), list(words), [len(x) for x in words.values()], [list(dict.fromkeys(x)) for x in words.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return windows.mapInArrow(read, _WINDOW)


_CANDIDATE = T.ArrayType(T.StructType().add("word", T.StringType()).add("at", T.IntegerType()))


def candidates(raw: str, confusions: list[tuple[str, str]] = CONFUSIONS) -> list[tuple[str, int]]:
    """(what may have stood there, where the first misread character is) of a word as it was read."""
    out: dict[str, int] = {}
    for form in dict.fromkeys((raw, base_form(raw))):
        for read, right in confusions:
            first = form.find(read)
            if first < 0:
                continue
            out.setdefault(base_form(form.replace(read, right)), first)
            at = first
            while at >= 0:
                out.setdefault(base_form(form[:at] + right + form[at + len(read) :]), at)
                at = form.find(read, at + 1)
    out.pop(base_form(raw), None)
    return [(w, at) for w, at in out.items() if len(w) > 1]


def _candidates_of(confusions: list[tuple[str, str]]):
    @F.pandas_udf(_CANDIDATE)
    def told(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: [{"word": w, "at": at} for w, at in candidates(r, confusions)] if any(c.isalpha() for c in r) and len(r) > 1 else [])

    return told.asNondeterministic()  # else a filter inferred for the explode has it run twice


def _frames(word):
    """ARRAY<STRUCT<frame, part>>: a word with one or two characters taken out, at every place: what is left, and what was taken."""
    at = lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word) - k + 1, F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.substring(word, F.lit(1), i - 1), F.substring(word, i + k, F.length(word))).alias("frame"), F.substring(word, i, F.lit(k)).alias("part")),
    )
    return F.concat(at(1), at(2))


def learnt_confusions(doubtful: DataFrame, stats: DataFrame) -> list[tuple[str, str]]:
    """(what is read, what stood there): the substitutions that turn doubtful words (raw, own) into words RATIO times as common.

    Words are aligned by what is left when one or two characters are taken out; a substitution counts for
    each doubtful word that shows it, and is learnt from LEARNT_WORDS and LEARNT_SHARE of them on.
    """
    forms = doubtful.select("raw", "own", F.explode(F.array_distinct(F.array("raw", _base(F.col("raw"))))).alias("form")).where(F.length("form") >= 4)
    read = forms.select("raw", "own", F.explode(_frames(F.col("form"))).alias("f")).select("raw", "own", "f.frame", F.col("f.part").alias("read"))
    common = stats.where((F.col("total") >= RATIO) & (F.length("word") >= 4)).select("total", F.explode(_frames(F.col("word"))).alias("f")).select("total", "f.frame", F.col("f.part").alias("right"))
    ends = lambda c: (F.substring(c, 1, 1), F.substring(c, -1, 1))
    apart = (ends("read")[0] != ends("right")[0]) & (ends("read")[1] != ends("right")[1])
    shown = read.join(common, "frame").where(apart & (F.col("total") >= RATIO * F.greatest("own", F.lit(1))))
    counted = shown.groupBy("read", "right").agg(F.countDistinct("raw").alias("n"))
    least = max(LEARNT_WORDS, LEARNT_SHARE * doubtful.count())
    return sorted((r["read"], r["right"]) for r in counted.where(F.col("n") >= least).collect())


def _base(raw):
    return F.regexp_replace(raw, "^[!(.,;:?\"'”’)]+|[!(.,;:?\"'”’)]+$", "")


def _count_words(batches):
    """(raw, count) of the words of texts, counted where the texts are."""
    counts: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            counts.update(map(_raw, text.split()))
        if len(counts) > 200_000:
            yield pd.DataFrame(counts.items(), columns=["raw", "count"])
            counts.clear()
    yield pd.DataFrame(counts.items(), columns=["raw", "count"])


def misread_words(suspects: DataFrame, stats: DataFrame) -> DataFrame:
    """(raw, at, fix): the words of ``suspects`` (raw) in which a character was recognised wrongly, and the likely word or NULL.

    ``stats`` has (word, clean, total).  A word that stands in text that was never scanned is right.  Any
    other is misread if a confusion, known or learnt from these very words, turns it into a word at least
    RATIO times as common, or if it has a character inside that words do not have.
    """
    distinct = suspects.select("raw").distinct()
    own = distinct.withColumn("word", _base(F.col("raw"))).join(stats, "word", "left")
    doubtful = cut(own.where("coalesce(clean, 0) = 0").select("raw", F.coalesce("total", F.lit(0)).alias("own")))
    told = list(dict.fromkeys([*CONFUSIONS, *learnt_confusions(doubtful, stats)]))
    tried = doubtful.withColumn("c", F.explode(_candidates_of(told)("raw"))).select("raw", "own", F.col("c.word").alias("word"), F.col("c.at").alias("at"))
    best = tried.join(stats, "word").groupBy("raw").agg(F.first("own").alias("own"), F.max_by(F.struct("at", "total", "clean", "word"), F.struct("total", "word")).alias("best"))
    by_word = best.where((F.col("best.total") >= RATIO * F.greatest("own", F.lit(1))) | (F.col("best.clean") > 0) & (F.col("best.total") >= 2 * F.col("own"))).select(
        "raw", F.col("best.at").alias("at"), F.col("best.word").alias("fix")
    )
    odd = F.regexp_instr("raw", F.lit("(?<=\\p{L})[€!(ſ|$@0-9](?=\\p{L})")) - 1
    by_look = doubtful.select("raw", odd.alias("at"), F.lit(None).cast("string").alias("fix")).where("at >= 0")
    return by_word.unionByName(by_look).groupBy("raw").agg(F.coalesce(F.min(F.when(F.col("fix").isNotNull(), F.col("at"))), F.min("at")).alias("at"), F.max("fix").alias("fix"))


def repair_windows(pages: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The windows of :func:`page_windows` with ``read``, the misread words (raw, fix, places) in them, and ``parted``, what is decided of pairs at line ends.

    ``vocabulary`` (text) is text that was never scanned; its words are taken as right.  Words and pairs are
    decided once each; windows meet the decisions by their distinct words and pairs, so that no common
    word is more than one row per window.
    """
    held = cut(page_windows(pages))
    said = held.select(F.explode(F.arrays_zip("raw", "count")).alias("w")).select("w.*")
    counted = said.select(_base(F.col("raw")).alias("word"), F.col("count").cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("clean"))
    if vocabulary is not None:
        words = vocabulary.where("text IS NOT NULL").select("text").mapInPandas(_count_words, "raw string, count bigint")
        counted = counted.unionByName(words.select(_base(F.col("raw")).alias("word"), F.col("count").alias("total"), F.col("count").alias("clean")))
    stats = cut(counted.where("word <> ''").groupBy("word").agg(F.sum("total").alias("total"), F.sum("clean").alias("clean")))

    # pairs at line ends, each distinct one once
    ends = F.arrays_zip(F.col("left").alias("left"), F.col("right").alias("right"), F.col("marked").alias("marked"))
    here = held.select("sdt_id", "window", F.explode(F.array_union(ends, F.array("coming"))).alias("p")).where("p.left IS NOT NULL").select("sdt_id", "window", "p.*")
    joined = F.concat("left", "right")
    pairs = here.select("left", "right", "marked").distinct().withColumn("joined", joined).withColumn("word", _base(joined))
    # without a hyphen, only pairs whose joined word is known come into question
    likely = pairs.join(stats.select("word", F.col("total").alias("joined_n")), "word", "left").where("marked OR joined_n > 2").drop("word")
    likely = cut(likely.withColumn("joined_n", F.coalesce("joined_n", F.lit(0))))
    shapes = {"hyphened": F.concat("left", F.lit("-"), "right"), "left": F.col("left"), "right": F.col("right")}
    forms = likely.withColumn("f", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), _base(v).alias("word")) for k, v in shapes.items())))).withColumn("word", F.col("f.word"))
    counts = forms.join(stats, "word", "left").groupBy("left", "right", "marked", "joined", "joined_n")
    known = counts.agg(
        *(F.max(F.when(F.col("f.what") == k, F.coalesce("total", F.lit(0)))).alias(k + "_n") for k in shapes),
        *(F.max(F.when(F.col("f.what") == k, F.coalesce("clean", F.lit(0)))).alias(k + "_clean") for k in ("left", "right")),
    )
    read = cut(misread_words(likely.where("marked").select(F.col("joined").alias("raw")).unionByName(said.select("raw")), stats))
    unreal = lambda side: (F.col(side + "_clean") == 0) & (5 * F.col(side + "_n") < F.col("joined_n"))
    marked = (
        F.when((F.col("joined_n") > 0) & (F.col("joined_n") >= F.col("hyphened_n")), True)
        .when(F.col("hyphened_n") > 0, False)
        .when(F.col("right").isin(sorted(_SUSPENDED)), False)
        .when(F.col("joined_at").isNotNull(), True)
        .when((F.col("left_n") > 3) & (F.col("right_n") > 3), False)
        .otherwise(True)
    )
    judged = (
        known.join(read.select(F.col("raw").alias("joined"), F.col("at").alias("joined_at"), F.col("fix").alias("joined_fix")), "joined", "left")
        .withColumn("parted", F.when(F.col("marked"), marked).otherwise(unreal("left") | unreal("right")))
        .where("marked OR parted")
        .select("left", "right", "marked", "parted", "joined", "joined_fix", F.when(F.col("parted"), F.col("joined_at")).alias("joined_at"))
    )

    # back to the windows
    halves = F.array_except(F.concat("left", "right", F.array("coming.left", "coming.right")), "raw")
    own = F.concat(F.arrays_zip("raw", "places"), F.transform(halves, lambda w: F.struct(w.alias("raw"), F.array().cast("array<int>").alias("places"))))
    own = held.select("sdt_id", "window", F.explode(own).alias("w")).select("sdt_id", "window", "w.*")
    wrong = own.join(read.select("raw", "fix"), "raw").select("sdt_id", "window", F.struct("raw", "fix", "places").alias("read"), F.lit(None).alias("pair"))
    decided = here.join(judged, ["left", "right", "marked"]).select(
        "sdt_id", "window", F.lit(None).alias("read"), F.struct("left", "right", "marked", "parted", "joined", "joined_fix", "joined_at").alias("pair")
    )
    told = wrong.unionByName(decided).groupBy("sdt_id", "window").agg(F.collect_list("read").alias("read"), F.collect_list("pair").alias("parted"))
    return held.drop("raw", "count", "places").join(told, ["sdt_id", "window"], "left")


def line_verdicts(row: dict) -> tuple[list[bool], list[list[tuple[str, str | None]]]]:
    """(broken, misread words with their fixes) of each line of a window of :func:`repair_windows`."""
    n = len(row["page"])
    broken, fixes = [False] * n, [{} for _ in range(n)]
    read = {r["raw"]: r["fix"] for r in row["read"] or ()}
    pairs = {(p["left"], p["right"], p["marked"]): p for p in row["parted"] or ()}
    ends = [pairs.get(k) for k in zip(row["left"], row["right"], row["marked"])] if pairs else [None] * n
    starts, coming = [None] * n, pairs.get(tuple(row["coming"].values()))
    for i, kind in enumerate(row["kind"] if pairs else ()):
        if kind == "text":
            starts[i], coming = coming, ends[i]
        elif kind == "title":
            coming = None
    for r in row["read"] or ():
        raw = r["raw"]
        for i in r["places"]:
            # halves of a word parted without a hyphen are no words
            half = ends[i] and not ends[i]["marked"] and ends[i]["left"] == raw or starts[i] and not starts[i]["marked"] and starts[i]["right"] == raw
            if not half:
                fixes[i][raw] = r["fix"]
    for i, (end, start) in enumerate(zip(ends, starts)):
        broken[i] = bool(end) and end["parted"]
        for pair, side in ((end, "left"), (start, "right")):
            if not pair:
                continue
            if pair["marked"] and not pair["parted"] and pair[side] in read:
                fixes[i][pair[side]] = read[pair[side]]
            if pair["joined_at"] is not None and (pair["joined_at"] < len(pair["left"])) == (side == "left"):
                fixes[i][pair["joined"]] = pair["joined_fix"]
    return broken, [list(f.items()) for f in fixes]


def _scanned(page_info: DataFrame) -> tuple[DataFrame, DataFrame]:
    scanned = page_info.where("text_source = 'ocr'").select("sdt_id", "page_index", "text")
    digital = page_info.where("coalesce(text_source, '') <> 'ocr' AND text IS NOT NULL").select("text")
    return scanned, digital


@F.pandas_udf(T.StringType())
def _assemble(lines: pd.Series, fixes: pd.Series) -> pd.Series:
    def one(parts, repairs) -> str:
        fix = {r["raw"]: r["fix"] for r in repairs if r["fix"]}
        out = ""
        glue = ""
        for p in parts:
            text = " ".join(p["text"].split())
            out += glue + text
            if p["broken"]:
                out, glue = out.rstrip(MARKS), ""
            elif out[-1:] == "-":
                glue = "" if out[-2:-1].isalnum() and not text.endswith(" -") and p["tight"] else " "
            else:
                glue = " "
        words = []
        for w in out.split(" "):
            raw = _raw(w)
            right = fix.get(raw)
            if right:
                lead = w[: len(w) - len(w.lstrip("\"'“‘«[{"))]
                body = w[len(lead) :]
                tail = body[len(raw) :] if raw.endswith("!") and right.endswith("t") else body[len(base_form(raw)) + (len(raw) - len(raw.lstrip("("))) :]
                words.append(lead + (right[:1].upper() + right[1:] if body[:1].isupper() else right) + tail)
            else:
                words.append(w)
        return " ".join(words)

    return pd.Series([one(a, b) for a, b in zip(lines, fixes)])


_BODY = (
    "sdt_id bigint, window int, page_index int, line_no int, kind string, text string, broken boolean, tight boolean, opens boolean, fixes array<struct<raw:string,fix:string>>"
)


def paragraphs(page_info: DataFrame) -> DataFrame:
    """(sdt_id, page_index, line_no, text): the paragraphs of scanned trees, by the place of their first line.

    Furniture is left out, parted words are joined, misread words repaired where the right one is known.
    A paragraph begins at an indented line, after a blank line on the same page, or after a title; it runs
    on over page ends.  Titles stand alone.  Paragraph starts are carried forward within windows of pages
    first and between windows by one row per window, so no tree is put in order by one task.
    """
    suspended = _SUSPENDED

    def lines(batches):
        fix = pa.struct([("raw", pa.string()), ("fix", pa.string())])
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(fix)]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                broken, fixes = line_verdicts(r)
                for i, kind in enumerate(r["kind"]):
                    if kind in ("text", "title"):
                        told = [{"raw": a, "fix": b} for a, b in fixes[i]]
                        rows.append((r["sdt_id"], r["window"], r["page"][i], r["line"][i], kind, r["text"][i], broken[i], r["right"][i] not in suspended, r["opens"][i], told))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], [f.split()[0] for f in _BODY.split(", ")])

    body = cut(repair_windows(*_scanned(page_info)).mapInArrow(lines, _BODY))
    starts = F.when((F.col("kind") == "title") | F.col("opens"), F.struct("page_index", "line_no"))
    order = Window.partitionBy("sdt_id", "window").orderBy("page_index", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    local = body.withColumn("start", F.last(starts, ignorenulls=True).over(order))
    carried = (
        body.groupBy("sdt_id", "window")
        .agg(F.max(starts).alias("last"))
        .withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("sdt_id").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)))
        .select("sdt_id", "window", "carried")
    )
    first = F.struct(F.lit(-1).alias("page_index"), F.lit(-1).alias("line_no"))
    whole = (
        local.join(carried, ["sdt_id", "window"])
        .withColumn("start", F.coalesce("start", "carried", first))
        .groupBy("sdt_id", "start")
        .agg(
            F.array_sort(F.collect_list(F.struct("page_index", "line_no", "text", "broken", "tight"))).alias("parts"),
            F.flatten(F.collect_list("fixes")).alias("fixes"),
        )
    )
    place = F.element_at("parts", 1)
    return whole.select("sdt_id", place.page_index.alias("page_index"), place.line_no.alias("line_no"), _assemble("parts", "fixes").alias("text"))


def scan_findings(page_info: DataFrame) -> DataFrame:
    """(sdt_id, page_index, line_no, kind) of the scanned pages: 'furniture', 'broken' and 'misread', one row per line and kind."""

    def findings(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                broken, fixes = line_verdicts(r)
                for i, (page, line, kind) in enumerate(zip(r["page"], r["line"], r["kind"])):
                    told = ["furniture"] if kind == "furniture" else [x for x, yes in (("broken", broken[i]), ("misread", fixes[i])) if yes and kind == "text"]
                    rows += [(r["sdt_id"], page, line, x) for x in told]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["sdt_id", "page_index", "line_no", "kind"])

    return repair_windows(*_scanned(page_info)).drop("text", "opens").mapInArrow(findings, "sdt_id bigint, page_index int, line_no int, kind string")
