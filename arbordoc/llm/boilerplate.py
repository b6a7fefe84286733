"""Problem 3: the main body of web pages, without what surrounds it.

A page's blocks are written out as markup and read by the standard library's streaming HTML parser, whose
events give every line's text-to-tag ratio.  The ratio is weighted by what the words say: text that recurs
over the corpus as page furniture does not count, text whose words speak for articles counts more.  The
weighted ratios are smoothed along the page by a Gaussian and split in two clusters; the lines of the upper
one are the content regions, and these are the main body.  Only their edges are mended: a part of an article
(heading, caption, note, formula, ...) beside main body belongs to it even if it is too short for a region.

What recurs as furniture is learnt from the blocks' own flow class, noisy as it is: stretches and labels
counted over all trees, and a word model fitted on a bounded sample.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .skeleton import ship, skeleton

#: Blocks per window of a tree, and blocks of context on both sides.
WINDOW = 512
HALO = 16
#: Steps of the smoothed ratio per unit; ratios are logarithms, so that a tree has at most some hundred levels.
LEVELS = 64
#: The share of pages on which a stretch, or a label that links follow, must stand to be known, besides ``least``.
UNIT_SHARE = 1e-4
#: Log-odds of a word that the model has not seen.
UNKNOWN = -1.0
#: The share of pages on which a label of link lists must stand to be furniture by itself.
LABEL_SHARE = 0.003
#: The share of a stretch's blocks labelled furniture above which it counts as such.
FURNITURE_RATE = 0.2
#: The share of a label's places with links behind it above which links follow it.
HEAD_RATE = 0.4
#: Standard deviation of the smoothing, in lines.
SIGMA = 0.6
#: How much more text counts whose words speak for the main body.
VOUCHED = 20.0
#: How much more a line of furniture counts among its neighbours than other lines.
SURE = 30.0

_SEPARATOR = re.compile(r"\s+[•|»›·>/]\s+|\s{2,}|\n")
_SEPARATED = re.compile(r"[•|»›·>/\n]|\s\s")
_CLAUSE = re.compile(r"\s(?:(?<=[.!?;]\s)|[–—-]\s)")  # between parts, which hold single blanks only
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBERED = re.compile(r"^\s*\d+\s*[.)]\s*")
_SENTENCE = re.compile(r"[.!?。！？](?:[\"'”’»)]|\s|$)")
#: Block types that stand in articles however short they are.
_PARTS = ("heading", "caption", "note", "table", "math", "preformatted", "blockquote", "list")
# The element each block type stands for.
_ELEMENT = {
    "heading": "h2", "list": "ul", "listitem": "li", "table": "table", "blockquote": "blockquote",
    "preformatted": "pre", "caption": "figcaption", "image": "img", "math": "math", "note": "aside",
}


def unit_key(text: str) -> str:
    """A stretch of text for counting: lower case, numbers as '#', outer punctuation aside."""
    return _DIGITS.sub("#", " ".join(text.split())).casefold().strip(" .:;,→»›•|·-–—!?")


@lru_cache(maxsize=256)
def _parts_of(text: str) -> tuple[str, ...]:
    """Items and labels that separators part."""
    return tuple(p for p in _SEPARATOR.split(text) if p and p.strip()) if _SEPARATED.search(text) else (text,) if text.strip() else ()


def stretches(text: str) -> list[str]:
    """The parts of a block's text that may recur by themselves: list items, linked labels, clauses."""
    return [c for part in _parts_of(text) for c in _CLAUSE.split(part) if c and c.strip()]


def markup(block_type: str | None, text: str) -> str:
    """A block as HTML: items, cells and separated labels as elements of their own, short labels as links."""
    element = _ELEMENT.get(block_type or "", "p")
    lines = [x for x in text.split("\n") if x.strip()]
    if element == "table":
        return "<table><tr>" + "".join(f"<td>{escape(x)}</td>" for x in lines) + "</tr></table>"
    if element in ("pre", "math", "img"):
        return f"<{element}>{escape(text)}</{element}>"

    def inline(line: str) -> str:
        parts = _parts_of(line)
        if len(parts) > 1:
            return "".join(f"<a>{escape(p)}</a>" for p in parts)
        return escape(line) if _SENTENCE.search(_NUMBERED.sub("", line)) or element != "ul" else f"<a>{escape(line)}</a>"

    if element == "ul":
        return "<ul>" + "".join(f"<li>{inline(x)}</li>" for x in lines) + "</ul>"
    return f"<{element}>" + "<br>".join(inline(x) for x in lines) + f"</{element}>"


class _Ratio(HTMLParser):
    """Counts of one line's parser events."""

    def reset(self):
        super().reset()
        self.tags = self.links = self.chars = self.linked = 0
        self._open = 0

    def updatepos(self, i, j):
        return j  # lines and columns are not asked for

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.links += 1
            self._open += 1

    def handle_endtag(self, tag):
        if tag == "a" and self._open:
            self._open -= 1

    def handle_data(self, data):
        n = len(data.strip())
        self.chars += n
        if self._open:
            self.linked += n


def parse_line(block_type: str | None, text: str) -> tuple[int, int, int, int]:
    """(tags, links, characters, linked characters) of a block, by parser events."""
    _PARSER.reset()
    _PARSER.feed(markup(block_type, text))
    _PARSER.close()
    return _PARSER.tags, _PARSER.links, _PARSER.chars, _PARSER.linked


_PARSER = _Ratio(convert_charrefs=True)


# ---- the word model

#: First characters of features that are no words.
_MARKS = ("=", "~", ">", "#")


def _weak_label(flow: str | None, block_type: str | None) -> bool:
    """Whether the flow class speaks for furniture; auxiliary captions and notes are part of articles too."""
    return flow == "excluded" or flow == "auxiliary" and block_type not in ("caption", "note")


def _linked_titles(block_type: str | None, text: str) -> bool:
    """Whether a text is nothing but short labels without sentences, each a link."""
    if block_type in ("table", "preformatted", "math", "heading"):
        return False
    parts = [_NUMBERED.sub("", p) for p in _parts_of(text)]
    return (block_type == "list" or len(parts) > 1) and not any(_SENTENCE.search(p) for p in parts)


def _features(block_type: str | None, text: str) -> set[str]:
    """What the model counts of a block: '~' labels of link lists, '=' stretches and words of all others."""
    if block_type in ("table", "math", "preformatted", "image"):
        return set()
    mark = "~" if _linked_titles(block_type, text) else "="
    out = {mark + k for k in map(unit_key, stretches(text)) if len(k) > 1}
    if mark == "=":
        out.update(_WORD.findall(text.casefold()))
        if "©" in text:
            out.add("©")
    return out


def page_features(blocks: list[tuple[str | None, str | None, str | None]], words: bool = True) -> list[tuple[str, int]]:
    """(feature, label) of a page's blocks (flow class, type, text) in order.

    Words, '=' stretches and '~' labels are labelled by the block's flow class; '>' and a short block's text
    by whether links follow it; '#' counts pages.  Without ``words`` single words are left out.
    """
    out = [("#", 0)]
    for i, (flow, kind, text) in enumerate(blocks):
        if not text:
            continue
        label = int(_weak_label(flow, kind))
        out += [(f, label) for f in _features(kind, text) if words or f[0] in _MARKS]
        if len(text) < 60 and kind in ("heading", "paragraph") and i + 1 < len(blocks):
            _, after, then = blocks[i + 1]
            out.append((">" + unit_key(text), int(bool(then) and _linked_titles(after, then))))
    return out


class Model:
    """Log-odds of words, and of whole stretches, to stand in page furniture; labels that links follow."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        """From (feature, blocks, labelled blocks)."""
        self.words: dict[str, float] = {}
        self.units: dict[str, float] = {}
        self.labels: set[str] = set()
        self.heads: dict[str, bool] = {}
        pages = next((n for f, n, _ in counts if f == "#"), 0)
        for feature, n, k in counts:
            rate = (k + 0.1) / (n + 1)
            if feature[0] == ">":
                self.heads[feature[1:]] = rate > HEAD_RATE
                continue
            odds = (math.log(rate / (1 - rate)) if rate < 1 else 4.0) - math.log(FURNITURE_RATE / (1 - FURNITURE_RATE))
            if feature[0] == "=":
                self.units[feature[1:]] = odds
            elif feature[0] == "~":
                if odds > 0 and n >= LABEL_SHARE * pages:
                    self.labels.add(feature[1:])
            elif feature[0] != "#":
                self.words[feature] = odds

    def unit(self, key: str, linked: bool = False) -> bool:
        """Whether a stretch is furniture: by its label, and in link lists, where titles of articles stand too, by its frequency."""
        return key in self.labels if linked else self.units.get(key, -9.0) > 0

    def leads(self, text: str) -> bool:
        """Whether links follow a label; a label that was never seen may."""
        return self.heads.get(unit_key(text), True)

    def read(self, text: str, linked: bool = False) -> tuple[float, float]:
        """(share of the text's characters in furniture stretches, mean log-odds of its words; no words in link lists)."""
        boiler = total = 0
        for s in stretches(text):
            n = len(s.strip())
            total += n
            if self.unit(unit_key(s), linked):
                boiler += n
        get = self.words.get
        odds = [] if linked else [get(w, UNKNOWN) for w in _WORD.findall(text.casefold())]
        return (boiler / total if total else 0.0), (sum(odds) / len(odds) if odds else 0.0)

    def vouches(self, text: str) -> bool:
        """Whether a text's words are known, most of them, and speak for the main body more than an unknown word does."""
        odds = list(map(self.words.get, _WORD.findall(text.casefold())))
        known = [o for o in odds if o is not None]
        return 2 * len(known) > len(odds) and sum(known) / len(known) < UNKNOWN


def _pages(blocks: DataFrame) -> DataFrame:
    return blocks.where("processor_type = 'snapshot' AND sdt_id IS NOT NULL AND block_index IS NOT NULL")


def windows_of(pages: DataFrame, *columns: str, halo: int = 0) -> DataFrame:
    """(sdt_id, window, block_index, *columns): one row per window of a tree, its blocks as arrays in order.

    A window has at most WINDOW blocks and ``halo`` of the next windows on either side.  Repeated rows are
    one; of unlike rows of one block all are there, side by side, in the order of their columns.
    """
    inside, home = F.pmod("block_index", F.lit(WINDOW)), F.floor(F.col("block_index") / WINDOW).cast("int")
    windows = F.array_compact(F.array(home, F.when((inside < halo) & (home != 0), home - 1), F.when(inside >= WINDOW - halo, home + 1)))
    rows = pages.select("sdt_id", F.struct("block_index", *columns).alias("b"), F.explode(windows).alias("window"))
    gathered = rows.groupBy("sdt_id", "window").agg(F.array_sort(F.collect_set("b")).alias("b"))
    return gathered.select("sdt_id", "window", "b.block_index", *(F.col(f"b.{c}").alias(c) for c in columns))


def fit(blocks: DataFrame, sample_blocks: int = 300_000, least: int = 2) -> Model:
    """The word model: words from a bounded sample; stretches, labels, what follows labels and pages from all blocks.

    ``sample_blocks`` bounds the expected number of blocks whose words are counted (windows of trees are
    chosen by a hash), and with them the number of words.  ``least`` is the number of blocks that a feature
    must stand in; a stretch, or a label that links follow, must also stand in UNIT_SHARE of the pages, a label
    of link lists in LABEL_SHARE, which bounds how many of them there can be: the stretches of a page over
    that share.  What the model takes for an unseen one anyway stays behind.  Windows are counted where they
    are, so only distinct features are shuffled.
    """
    ship(blocks.sparkSession)
    rows = blocks.count()
    part = min(1.0, sample_blocks / max(rows, 1))
    chosen = F.pmod(F.xxhash64("sdt_id", "window"), F.lit(1_000_003)) < F.lit(int(part * 1_000_003) + 1)
    told = windows_of(blocks, "block_type", "text", "flow_class").withColumn("chosen", chosen)

    def count(batches):
        n: dict[str, list[int]] = {}
        for pdf in batches:
            for index, kinds, texts, flows, words in zip(pdf["block_index"], pdf["block_type"], pdf["text"], pdf["flow_class"], pdf["chosen"]):
                page = [(f, k, skeleton(t) if t else t) for _, f, k, t in _one_each(index, flows, kinds, texts)]
                for feature, flag in page_features(page, bool(words)):
                    c = n.setdefault(feature, [0, 0])
                    c[0] += 1
                    c[1] += flag
            if len(n) > 200_000:
                yield pd.DataFrame([(f, *c) for f, c in n.items()], columns=["feature", "n", "k"])
                n = {}
        yield pd.DataFrame([(f, *c) for f, c in n.items()], columns=["feature", "n", "k"])

    rate = (F.col("k") + 0.1) / (F.col("n") + 1)
    mark = F.substring("feature", 1, 1)
    counted = told.mapInPandas(count, "feature string, n bigint, k bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counted = cut(counted.where(F.col("n") >= least))
    pages = counted.where("feature = '#'").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    matters = (
        F.when(mark == ">", (rate <= HEAD_RATE) & (F.col("n") >= UNIT_SHARE * pages))
        .when(mark == "=", (rate > FURNITURE_RATE) & (F.col("n") >= UNIT_SHARE * pages))
        .when(mark == "~", (rate > FURNITURE_RATE) & (F.col("n") >= LABEL_SHARE * pages))
        .otherwise(True)
    )
    return Model([(r["feature"], r["n"], r["k"]) for r in counted.where(matters).collect()])


def _one_each(index, *columns):
    """The rows of a window's arrays, one per block index: the last of unlike ones."""
    return list({r[0]: r for r in zip(index, *columns)}.values())


# ---- one page


def _smooth(values: np.ndarray, weights: np.ndarray | None = None, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means along a page, each value with its weight."""
    radius = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = np.ones(len(values)) if weights is None else weights
    padded = [np.concatenate((np.repeat(x[:1], radius), x, np.repeat(x[-1:], radius))) for x in (values * weights, weights)]
    return np.convolve(padded[0], kernel, "valid") / np.convolve(padded[1], kernel, "valid")


def _levels(values: np.ndarray) -> np.ndarray:
    """Values in whole steps, so that the counts of a tree's windows add up to those of the tree."""
    return np.rint(values * LEVELS).astype(int)


def _border(levels: np.ndarray, counts: np.ndarray) -> float:
    """The border of two clusters of levels on a line (2-means from the extremes), in units of the ratio.

    One line without text, as there is none beyond a page's ends, is always among them.
    """
    levels, counts = np.append(levels, 0), np.append(counts, 1)
    low, high = float(levels.min()), float(levels.max())
    for _ in range(50):
        lower = levels <= (low + high) / 2
        if lower.all() or not lower.any():
            break
        means = tuple(float(np.average(levels[m], weights=counts[m])) for m in (lower, ~lower))
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2 / LEVELS


def _threshold(values: np.ndarray) -> float:
    """The border of two clusters of a whole page's values."""
    return _border(*np.unique(_levels(values), return_counts=True))


class _Page:
    """A page's blocks (type, text) in order, with their weighted text-to-tag ratios, raw and smoothed.

    The model enters as a weight of a block's text: 0 for what it takes for furniture, VOUCHED for words
    that speak for the main body, 1 for what it does not know.  Where ratios are smoothed, what it takes for
    furniture counts SURE times as much as other lines, so that text around it does not lift it.
    """

    def __init__(self, blocks: list[tuple[str | None, str | None]], model: Model):
        n = len(blocks)
        self.blocks, self.model = blocks, model
        self.own = np.zeros(n, dtype=bool)  # evidence for furniture of the block itself
        self.titles = np.zeros(n, dtype=bool)  # nothing but short labels without sentences
        self.blank = np.zeros(n, dtype=bool)
        self.ratio = np.zeros(n)
        self.texts = [skeleton(t) if t else "" for _, t in blocks]
        plain, none = np.zeros(n), np.zeros(n, dtype=bool)
        for i, ((kind, _), text) in enumerate(zip(blocks, self.texts)):
            if not text.strip():
                self.blank[i] = True
                continue
            tags, links, chars, _ = parse_line(kind, text)
            linked = self.titles[i] = _linked_titles(kind, text)
            share, odds = model.read(text, linked) if kind not in ("table", "math", "preformatted") else (0.0, -2.0)
            sure = 0.5 if share == 0 and kind in ("heading", "caption", "note") else 0.0
            crumbs = share > 0 and links >= 2 and kind != "list"
            self.own[i] = share >= 0.5 or odds > sure or crumbs or text.startswith("©") and share + odds > -1
            plain[i] = chars * (1 - share) / max(tags, 1)
        weight = np.ones(n)
        for i, (kind, _) in enumerate(blocks):
            if self.blank[i]:
                continue
            if self.own[i]:
                weight[i], none[i] = 0, True
            elif self.titles[i]:
                # links in a paragraph are a menu; a list of them is one if numbered, or under a furniture label
                article = kind == "list" and not _NUMBERED.match(self.texts[i]) and not self.under_furniture(i)
                weight[i], none[i] = VOUCHED if article else 0, not article
            elif model.vouches(self.texts[i]):
                weight[i] = VOUCHED
        self.ratio = np.log1p(plain * weight)
        self.smooth = _smooth(self.ratio, np.where(none, SURE, np.where(self.blank, 0.5, 1.0))) if n else self.ratio

    def border(self) -> float:
        return _threshold(self.smooth)

    def under_furniture(self, i: int) -> bool:
        """Whether the label that a list of links stands under is furniture; a stray short text may come between."""
        blocks, texts = self.blocks, self.texts
        for j in range(i - 1, max(i - 4, -1), -1):
            if self.own[j]:
                return blocks[j][0] in ("heading", "paragraph") and len(texts[j]) < 60 and self.model.leads(texts[j])
            if not (self.blank[j] or blocks[j][0] == "paragraph" and len(texts[j]) < 60 and not _SENTENCE.search(texts[j]) or self.titles[j]):
                return False
        return False

    def judge(self, border: float) -> tuple[np.ndarray, np.ndarray]:
        """(main body, content) of each block, if the page has any content at all: the regions, mended at their edges."""
        n, blank = len(self.blocks), self.blank
        region = ((self.smooth > border) | (self.ratio > border)) & ~blank
        body = region.copy()
        # a part of an article that no word tells of follows its neighbours: a heading the text under it, a caption,
        # note or the like the text on either side
        told = np.flatnonzero(~blank)
        for at in range(len(told) - 1, -1, -1):
            i = told[at]
            kind = self.blocks[i][0]
            if body[i] or self.own[i] or self.titles[i] or kind not in _PARTS:
                continue
            after = at + 1 < len(told) and body[told[at + 1]]
            body[i] = after or kind != "heading" and at > 0 and body[told[at - 1]]
        # blank blocks are main body if the text before or behind them is
        sides = np.zeros(n, dtype=bool)
        for order in (range(n), range(n - 1, -1, -1)):
            before = False
            for i in order:
                if blank[i]:
                    sides[i] |= before
                else:
                    before = bool(body[i])
        return body | sides, region & ~self.titles


def classify_page(blocks: list[tuple[str | None, str | None]], model: Model) -> list[bool]:
    """For each block (type, text) of a page in order, whether it is main body.

    Blank blocks (images among them) are main body if a neighbour is.  A page without a content region has
    no main body: what is left there are link lists and their labels.
    """
    if not blocks:
        return []
    page = _Page(blocks, model)
    if page.blank.all():
        return [True] * len(blocks)
    body, content = page.judge(page.border())
    return body.tolist() if content.any() else [False] * len(blocks)


def _borders(windows: DataFrame, model: Model) -> DataFrame:
    """(sdt_id, window, border): of trees of several windows, the border of the whole tree, once for each of its windows.

    Windows give their smoothed ratios as counted levels; a tree has a bounded number of levels.
    """

    @F.pandas_udf("array<int>")
    def levels(window: pd.Series, index: pd.Series, kinds: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for w, i, k, t in zip(window, index, kinds, texts):
            rows = _one_each(i, k, t)
            page = _Page([r[1:] for r in rows], model)
            out.append([int(x) for x, r in zip(_levels(page.smooth), rows) if r[0] // WINDOW == w])
        return pd.Series(out)

    @F.pandas_udf("double")
    def border(levels: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([_border(np.asarray(a), np.asarray(c)) for a, c in zip(levels, counts)], dtype="float64")

    seen = windows.select("sdt_id", "window", F.explode(levels("window", "block_index", "block_type", "text")).alias("level"))
    per = seen.groupBy("sdt_id", "level").agg(F.count("*").alias("n"))
    told = per.groupBy("sdt_id").agg(F.collect_list(F.struct("level", "n")).alias("l")).select("sdt_id", border("l.level", "l.n").alias("border"))
    return windows.select("sdt_id", "window").join(told, "sdt_id")


def main_body(blocks: DataFrame, model: Model | None = None) -> DataFrame:
    """(sdt_id, block_index, main_body) of every block of web pages (snapshot trees), one row per block.

    ``blocks`` needs sdt_id, block_index, processor_type, block_type, text and flow_class.  Of several rows
    of one block one counts; rows with a NULL key are left out.  Long trees are read in windows of blocks
    with context, so no tree has to fit in one task; what is decided by the whole page, the border of the
    regions and whether there is a content region at all, is gathered from all windows of a tree first.
    """
    ship(blocks.sparkSession)
    pages = _pages(blocks)
    model = model or fit(pages)
    windows = windows_of(pages, "block_type", "text", halo=HALO)
    long = pages.where(~F.col("block_index").between(0, WINDOW - 1)).select("sdt_id").distinct()
    several = not long.isEmpty()
    if several:
        borders = cut(_borders(windows_of(pages.join(long, "sdt_id", "left_semi"), "block_type", "text", halo=HALO), model))
        windows = windows.join(borders, ["sdt_id", "window"], "left")
    else:
        windows = windows.withColumn("border", F.lit(None).cast("double"))

    @F.pandas_udf("keep array<boolean>, at array<int>, content boolean, blank boolean")
    def judge(window: pd.Series, border: pd.Series, index: pd.Series, kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for w, b, i, k, t in zip(window, border, index, kinds, texts):
            rows = _one_each(i, k, t)
            page = _Page([r[1:] for r in rows], model)
            home = [n for n, r in enumerate(rows) if r[0] // WINDOW == w]
            body, content = page.judge(page.border() if math.isnan(b) else b)
            out.append((body[home].tolist(), [rows[n][0] for n in home], bool(content[home].any()), bool(page.blank[home].all())))
        return pd.DataFrame(out, columns=["keep", "at", "content", "blank"])

    judge = judge.asNondeterministic()  # else a filter inferred for the explode has every page judged twice
    told = windows.select("sdt_id", "window", judge("window", "border", "block_index", "block_type", "text").alias("t")).select("sdt_id", "window", "t.*")
    if several:
        told = cut(told)
        trees = told.groupBy("sdt_id").agg(F.max("content").alias("content"), F.min("blank").alias("blank"))
        told = told.drop("content", "blank").join(trees, "sdt_id")
    each = told.select("sdt_id", "content", "blank", F.explode(F.arrays_zip("at", "keep")).alias("e"))
    return each.select("sdt_id", F.col("e.at").alias("block_index"), (F.col("blank") | F.col("content") & F.col("e.keep")).alias("main_body"))
