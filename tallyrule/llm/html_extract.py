"""Main text of web pages by wrappers: union-free regular expressions inferred from aligned token streams of each host's pages.

A page is reduced to its skeleton: open and close tags of the elements that lay it out, and # for what flows between them. All different
pages of a host count: its base is the skeleton nearest to all others, and each skeleton is aligned with it. Places that some page lacks and
runs that the base lacks are optional groups, repeats are groups too, and each # is a slot or, where all pages that have it have the
same text, a part of the template. The element that holds the slots' text is the wrapper's root. Each page is then
aligned with its host's wrapper, and its main text is what lies between the tags that meet the root's. Pages of hosts with too few pages
to infer from, and pages that the wrapper does not fit, are read by element names and class words alone.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import materialize, tidy

# HTML's element names by role.
RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|select|title"
SKIPPED = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "audio", "video"}
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class names, ids and roles that mark what is no main text.
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside complementary contentinfo search comment comments "
    "reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert popup modal overlay widget toolbar pagination pager skip hidden".split()
)
ROOT_WORDS = set("article content entry post story main".split())
#: Words that may stand beside those in one class name or id without changing what it marks.
NEUTRAL = set("area bar block body bottom box btn center col column container content cookie foot form group head header icon inner item items left link links list main mobile page panel placeholder post posts primary right row secondary section site slot story article entry text top unit wrap wrapper".split())
#: Elements that lay a page out; all others flow.
LAYOUT = set("article aside body div fieldset footer form h1 h2 h3 h4 h5 h6 header html li main nav ol section table tbody td th tr ul".split())
#: Kinds of elements that hold the main text, best first; marked ones are blocks with a root word and no aside word.
ROOTS = ("article", "main", "marked")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>", re.S)
_RAW = re.compile(rf"<({RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
#: Different pages from which on a text that all of them share counts as fixed, and a host has a wrapper.
LEAST_PAGES = 4
#: Share of the slots' text that a wrapper's root holds at least.
MASS = 0.6
#: Share of what pages meet on average, each symbol counted by the pages that have it, that a page must meet to be read by the wrapper.
FIT = 0.8


def clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


@functools.lru_cache(100_000)
def marks(attrs: str) -> tuple[bool, bool, bool, str]:
    """(marks an aside, marks a root, hidden, class names and id without digits) of a tag's attributes.

    A class name, id or role marks an aside if one of its words does and all others are such words too, neutral or numbers: comments,
    post-comments and ad-slot-3 do, comment-on-law and related-work do not.
    """
    aside = root = hidden = False
    names = []
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name in ("class", "id", "role"):
            for x in value.split():
                parts = [p for p in re.split(r"[^a-z]+", x) if p]
                aside |= bool(ASIDE_WORDS & set(parts)) and all(p in ASIDE_WORDS or p in NEUTRAL for p in parts)
                root |= bool(ROOT_WORDS & set(parts))
                names.append("-".join(parts))
    return aside, root, hidden, ".".join(sorted(set(names)))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is '<', '>' or 't'; comments, scripts and the like are left out."""
    page = _RAW.sub(" ", _COMMENT.sub(" ", page))
    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            yield "t", page[at : m.start()], ""
        yield (">" if m[1] else "<"), m[2].lower(), m[3]
        at = m.end()
    if at < len(page):
        yield "t", page[at:], ""


def skeleton(toks: list[tuple[str, str, str]]) -> tuple[list[str], list[int], list[str]]:
    """(symbols, for each the number of its first token, for each # its text) of a page's tokens.

    Symbols are <name.classes and >name for elements of LAYOUT, and # for a run of all else that has some text. Texts of links are left
    out of a run's text, as they are no main text by themselves.
    """
    symbols, at, texts = [], [], []
    held, some, first, links = [], False, 0, 0

    def close() -> None:
        nonlocal some
        if some:
            symbols.append("#")
            at.append(first)
            texts.append(clean("".join(held)))
        held.clear()
        some = False

    for i, (kind, name, attrs) in enumerate(toks):
        if kind == "t":
            if not name.isspace():
                if not some:
                    some, first = True, i
                if not links:
                    held.append(name)
        elif name in LAYOUT:
            close()
            symbols.append(f"<{name}" + (f".{x}" if kind == "<" and (x := marks(attrs)[3]) else "") if kind == "<" else f">{name}")
            at.append(i)
            texts.append("")
        elif name == "a":
            links = max(0, links + (1 if kind == "<" else -1))
        else:
            held.append(" ")
    close()
    return symbols, at, texts


def fold_repeats(symbols: list[str], longest: int = 16) -> list[tuple[str, int, int]]:
    """(symbol, first, end) after adjacent repeats of a group of symbols have become one group marked with +, shortest groups first."""
    seq = [(x, i, i + 1) for i, x in enumerate(symbols)]
    for size in range(1, longest + 1):
        names = [x[0] for x in seq]
        new, i = [], 0
        while i < len(seq):
            k = 1
            group = names[i : i + size] if i + 2 * size <= len(seq) and names[i] == names[i + size] else []
            if group and names[i + size : i + 2 * size] == group and _balanced(group):
                while names[i + k * size : i + (k + 1) * size] == group:
                    k += 1
            if k > 1:
                new.append((f"({' '.join(group)})+", seq[i][1], seq[i + k * size - 1][2]))
                i += k * size
            else:
                new.append(seq[i])
                i += 1
        seq = new
    return seq


def _balanced(group: list[str]) -> bool:
    """Whether a group opens and closes the same elements, so that none stays open over its end."""
    stack = []
    for x in group:
        if x[0] == "<":
            stack.append(x[1:].split(".")[0])
        elif x[0] == ">" and (not stack or stack.pop() != x[1:]):
            return False
    return not stack


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal symbols, in order."""
    return [(x + k, y + k) for x, y, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(n)]


def shape(toks: list[tuple[str, str, str]]) -> tuple[list[str], list[str]]:
    """(symbols, for each its text) of a page's tokens after repeats are folded."""
    plain, _, own = skeleton(toks)
    folded = fold_repeats(plain)
    return [x[0] for x in folded], [" ".join(filter(None, own[a:b])) for _, a, b in folded]


def base_of(kinds: Counter) -> tuple[str, ...]:
    """Of skeletons, counted by different pages, the one nearest to all pages; () if all are empty.

    Distance is the number of symbols, with repetition, that only one of two has. Its sum over n pages is a constant less the sum of
    2 * (pages that have the symbol that often) - n over a skeleton's symbols. Among equals the greatest digest wins.
    """
    have: Counter = Counter()
    for symbols, n in kinds.items():
        for x, k in Counter(symbols).items():
            for i in range(k):
                have[x, i] += n
    total = kinds.total()
    score = {s: sum(2 * have[x, i] - total for x, k in Counter(s).items() for i in range(k)) for s in kinds if s}
    return max(score, key=lambda s: (score[s], digest("\n".join(s))), default=())


class Meeting:
    """A skeleton aligned with a base: the places that meet, the gaps of the base (each before a place, the last at the end) in which
    all others lie, and which places are outside asides.
    """

    def __init__(self, base: list[str], symbols: list[str], aligner: Callable = align) -> None:
        pairs = aligner(base, symbols)
        self.base = np.array([x for x, _ in pairs], np.int64)
        self.own = np.array([y for _, y in pairs], np.int64)
        self.free = np.setdiff1d(np.arange(len(symbols)), self.own)
        after = np.append(self.base, len(base))
        self.gap = after[np.searchsorted(self.own, self.free)]
        self.main = ~_asides(symbols, _spans(symbols))


class Tally:
    """Sums over pages that meet a base: for each place the pages that have it, the length of their texts outside asides, and the least
    and greatest hash of the texts; for each gap the length of the texts in it. Sums of parts add up, whatever the parts are.
    """

    def __init__(self, size: int) -> None:
        self.pages, self.mass, self.gaps = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size + 1, np.int64)
        self.least, self.most = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)

    def add(self, met: Meeting, sizes: np.ndarray, hashes: np.ndarray) -> None:
        sizes = sizes * met.main
        self.pages[met.base] += 1
        self.mass[met.base] += sizes[met.own]
        self.least[met.base] = np.minimum(self.least[met.base], hashes[met.own])
        self.most[met.base] = np.maximum(self.most[met.base], hashes[met.own])
        np.add.at(self.gaps, met.gap, sizes[met.free])

    def parts(self) -> list[np.ndarray]:
        return [self.pages, self.mass, self.gaps, self.least, self.most]

    def join(self, parts: list[np.ndarray]) -> None:
        pages, mass, gaps, least, most = parts
        self.pages += pages
        self.mass += mass
        self.gaps += gaps
        self.least, self.most = np.minimum(self.least, least), np.maximum(self.most, most)

    def slots(self) -> np.ndarray:
        """Whether a place is no template: its text differs, or too few pages have it."""
        return (self.least != self.most) | (self.pages < LEAST_PAGES)

    def spec(self, base: list[str], n: int) -> dict:
        """The wrapper of n pages: its symbols, the pages that have each, n, and the places of the root's tags, which over half of the pages have."""
        root = _root(base, np.where(self.slots(), self.mass, 0), self.gaps)
        return {"symbols": list(base), "pages": self.pages.tolist(), "n": n, "root": root if root and 2 * self.pages[list(root)].min() > n else None}


def measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and 64-bit hashes of texts."""
    hashes = (int.from_bytes(digest(t)[:8], "big", signed=True) if t else 0 for t in texts)
    return np.fromiter(map(len, texts), np.int64, len(texts)), np.fromiter(hashes, np.int64, len(texts))


def infer(pages: list[str], aligner: Callable = align) -> dict:
    """The wrapper of all pages of one host (Tally.spec), and the expression as text.

    Skeletons are aligned with the base (base_of). A place that some page lacks, and each run of symbols that the base lacks, is
    optional (adjacent places are one group in the text form), repeats are groups with +. A # with one text in all pages that have it,
    LEAST_PAGES at least, is template, else a slot ($ in the text form). Pages with the same tokens count once; below LEAST_PAGES
    different ones there is no root. wrappers() does the same to the pages of all hosts.
    """
    parsed = list({digest(repr(t)): t for t in (list(tokens(p)) for p in pages)}.values())
    if len(parsed) < LEAST_PAGES:
        return {"symbols": [], "pages": [], "n": len(parsed), "root": None, "wrapper": ""}
    shapes = [shape(t) for t in parsed]
    base = list(base_of(Counter(tuple(s) for s, _ in shapes)))
    tally, runs = Tally(len(base)), [set() for _ in range(len(base) + 1)]
    for symbols, texts in shapes:
        met = Meeting(base, symbols, aligner)
        tally.add(met, *measures(texts))
        for g in set(met.gap.tolist()):
            runs[g].add(" ".join("$" if symbols[y] == "#" else symbols[y] for y in met.free[met.gap == g]))
    optional, slots = tally.pages < len(parsed), tally.slots()
    text, part = [], []
    for i in range(len(base) + 1):
        if part and (i == len(base) or runs[i] or optional[i] != optional[i - 1]):
            text.append(f"[{' '.join(part)}]?" if optional[i - 1] else " ".join(part))
            part = []
        text += [f"[{r}]?" for r in sorted(runs[i])]
        if i < len(base):
            part.append("$" if base[i] == "#" and slots[i] else base[i])
    return tally.spec(base, len(parsed)) | {"wrapper": " ".join(text)}


def _spans(symbols: list[str]) -> list[tuple[int, int]]:
    """Places of the open and close tags of elements, in the order of the latter."""
    spans, stack, opened = [], [], Counter()
    for i, x in enumerate(symbols):
        if x[0] == "<":
            name = x[1:].split(".")[0]
            stack.append((name, i))
            opened[name] += 1
        elif x[0] == ">" and opened[x[1:]]:
            name = ""
            while name != x[1:]:
                name, k = stack.pop()
                opened[name] -= 1
            spans.append((k, i))
    return spans


def _asides(symbols: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
    """Which symbols are of or in elements that are no main text."""
    skipped = np.zeros(len(symbols), bool)
    for a, b in spans:
        name, _, classes = symbols[a][1:].partition(".")
        if name in SKIPPED or marks(f'class="{classes.replace(".", " ")}"')[0] and name not in ("html", "body"):
            skipped[a : b + 1] = True
    return skipped


def _root(symbols: list[str], mass: np.ndarray, gaps: np.ndarray) -> tuple[int, int] | None:
    """Places of the tags of the innermost element with at least MASS of the slots' and gaps' text outside asides; None if there is none.

    An article, or else a main element, with that much is taken as it is, so headings beside its longest part belong to it.
    """
    spans = _spans(symbols)
    skipped = _asides(symbols, spans)
    own = np.cumsum(np.where(skipped, 0, mass) + gaps[:-1])  # up to each place, with the gap before it
    total = int(own[-1] + gaps[-1]) if len(own) else 0
    good = [(b - a, a, b) for a, b in spans if not skipped[a] and total and own[b] - own[a] >= MASS * total and symbols[a].split(".")[0] not in ("<html", "<body")]
    for name in ("<article", "<main"):
        named = [(a, b) for a, b in spans if symbols[a].split(".")[0] == name and not skipped[a]]
        outer = [(a, b) for a, b in named if not any(c < a and b < d for c, d in named)]
        if len(outer) > 1:
            return None  # all of them are main text: for the rules
        if outer and any(x[1:] == outer[0] for x in good):
            return outer[0]
    boxes = [x for x in good if symbols[x[1]].split(".")[0] in ("<div", "<section", "<td", "<table", "<ul", "<ol", "<form")]
    return min(boxes)[1:] if boxes else None


class Wrapper:
    """A host's wrapper, ready to be met by pages; alignments are kept by the shape of the page."""

    def __init__(self, spec: dict, most: int = 500) -> None:
        self.symbols, self.root = spec["symbols"], spec["root"]
        self.pages = spec["pages"]
        self.least = FIT * sum(k * k for k in self.pages)
        self.n = spec["n"]
        self.met: dict[tuple[str, ...], tuple[int, int] | None] = {}
        self.most = most

    def region(self, toks: list[tuple[str, str, str]]) -> tuple[int, int] | None:
        """Numbers of the page's tokens that open and close the root; None if the page's skeleton does not fit."""
        if self.root is None:
            return None
        plain, at, _ = skeleton(toks)
        folded = fold_repeats(plain)
        names = tuple(x[0] for x in folded)
        if names not in self.met:
            if len(self.met) >= self.most:
                self.met.clear()
            pairs = dict(align(self.symbols, list(names)))
            a, b = (pairs.get(k) for k in self.root)
            fits = self.n * sum(self.pages[k] for k in pairs) >= self.least
            self.met[names] = (a, b) if a is not None and b is not None and fits else None
        found = self.met[names]
        return None if found is None else (at[folded[found[0]][1]], at[folded[found[1]][1]])


def main_blocks(page: str | None, wrapper: Wrapper | None = None) -> tuple[list[str], str]:
    """(blocks of the main text, what its root is): 'wrapper' if the host's fits and its region has text, else the first kind of ROOTS
    of which an element opens (not if all are skipped or inside skipped ones), else the whole body ('').
    """
    toks = list(tokens(page or ""))
    if wrapper is not None and (region := wrapper.region(toks)) is not None:
        blocks, _ = scan(toks, "", region)
        if blocks:
            return blocks, "wrapper"
    here = {n for k, n, _ in toks if k == "<"}
    for r in ROOTS:
        if r == "marked" or r in here:
            blocks, opened = scan(toks, r)
            if opened:
                return blocks, r
    return scan(toks, "")[0], ""


def extract(page: str | None, wrapper: dict | None = None) -> str:
    """The main text of one page, by a wrapper of infer() if given."""
    return "\n\n".join(main_blocks(page, Wrapper(wrapper) if wrapper else None)[0])


def without(blocks: list[str], fixed: frozenset, key=lambda b: b) -> list[str]:
    """The blocks that are not fixed; all of them if the fixed ones make up over half of the text, as in copies of one article."""
    left = [b for b in blocks if key(b) not in fixed]
    return left if 2 * sum(map(len, left)) >= sum(map(len, blocks)) else blocks


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan(toks: list[tuple[str, str, str]], root: str, region: tuple[int, int] | None = None) -> tuple[list[str], bool]:
    """(blocks inside elements of the kind root, or of all the page if it is '', and whether any such element opened).

    A region is read from the token after its first to the one before its last instead, as the inside of a root.
    """
    opened = False
    blocks: list[str] = []
    text: list[str] = []
    skip: list[str] = []  # open elements since a skipped one, all of its name
    inside: list[str] = []  # open elements of the root's name since the root

    def close() -> None:
        block = clean("".join(text))
        text.clear()
        if block:
            blocks.append(block)

    for kind, name, attrs in toks[region[0] + 1 : region[1]] if region else toks:
        if kind == "t":
            if not skip and (inside or not root):
                text.append(name)
            continue
        if skip:
            if name == skip[0]:
                if kind == "<" and name not in VOID:
                    skip.append(name)
                elif kind == ">":
                    skip.pop()
            continue
        if name in BLOCKS:
            close()
        elif name == "br":
            text.append(" ")
        if kind == ">":
            if inside and name == inside[0]:
                inside.pop()
            continue
        if name in VOID:
            continue
        aside, marked, hidden, _ = marks(attrs)
        is_root = root and (name == root or root == "marked" and name in BLOCKS and marked) and not aside
        if name in SKIPPED or name == "header" and not inside and not region or hidden or aside and name not in ("html", "body"):
            close()
            skip.append(name)
        elif inside and name == inside[0] or not inside and is_root:
            inside.append(name)
            opened = True
    close()
    return blocks, opened


def shared_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_host, _fixed): digests of the blocks that all pages of a host without a root element have, from LEAST_PAGES different ones on.

    Each task sends one row a host (or a few, to bound its memory): the digests that all its pages share, and the first LEAST_PAGES
    digests of different pages, which suffice to tell whether there are as many. Pages without any text do not count.
    """
    schema = "_host string, _pages array<binary>, _fixed array<binary>"

    def both(have, page, fixed):
        return (set(sorted(have[0] | page)[:LEAST_PAGES]), have[1] & fixed) if have else (page, fixed)

    def send(held):
        rows = [{"_host": h, "_pages": sorted(n), "_fixed": sorted(f)} for h, (n, f) in held.items()]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("_host", pa.string()), ("_pages", pa.list_(pa.binary())), ("_fixed", pa.list_(pa.binary()))]))

    def run(batches, most=200_000):
        held, size = {}, 0
        for b in batches:
            for host, page in zip(b.column("_host").to_pylist(), b.column("_html"), strict=True):
                blocks, root = main_blocks(page.as_py())
                if root or not blocks:
                    continue
                size -= len(held[host][1]) if host in held else 0
                held[host] = both(held.get(host), {digest("\n\n".join(blocks))}, set(map(digest, blocks)))
                size += len(held[host][1])
                if size > most:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        have = None
        for n, f in zip(group["_pages"], group["_fixed"], strict=True):
            have = both(have, set(n), set(f))
        return pd.DataFrame({"_host": group["_host"][:1], "_fixed": [sorted(have[1]) if len(have[0]) >= LEAST_PAGES else []]})

    rows = pages.where(F.col(html_col).isNotNull()).select(_host(url_col).alias("_host"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(tidy(run), schema).groupBy("_host").applyInPandas(join, "_host string, _fixed array<binary>").where("size(_fixed) > 0")


def _host(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def shapes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_host, _page, _shape, _symbols, _sizes, _hashes) of all different pages: digests of the tokens and of the skeleton, its symbols one
    a line, and for each symbol the length and hash of its text.
    """
    schema = "_host string, _page binary, _shape binary, _symbols string, _sizes array<long>, _hashes array<long>"
    arrow = pa.schema([("_host", pa.string()), ("_page", pa.binary()), ("_shape", pa.binary()), ("_symbols", pa.string()), ("_sizes", pa.list_(pa.int64())), ("_hashes", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            out = []
            for page in b.column("_html"):
                toks = list(tokens(page.as_py()))
                symbols, texts = shape(toks)
                lines = "\n".join(symbols)
                out.append((digest(repr(toks)), digest(lines), lines, *measures(texts)))
            yield pa.RecordBatch.from_arrays([b.column("_host"), *(pa.array([x[i] for x in out], arrow.field(i + 1).type) for i in range(5))], schema=arrow)

    rows = pages.where(F.col(html_col).isNotNull()).select(_host(url_col).alias("_host"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(tidy(run), schema).dropDuplicates(["_host", "_page"])


def bases(different: DataFrame, hint: Callable) -> DataFrame:
    """(_host, _base, _n): the skeleton nearest to all different pages of a host (base_of), and their number, LEAST_PAGES at least."""
    kinds = materialize(different.groupBy("_host", "_shape").agg(F.count("*").alias("_pages"), F.first("_symbols").alias("_base")), "kinds")
    hosts = kinds.groupBy("_host").agg(F.sum("_pages").alias("_n")).where(F.col("_n") >= LEAST_PAGES)
    each = kinds.where("_base <> ''").select("_host", "_shape", "_pages", F.explode(F.split("_base", "\n")).alias("_symbol"))
    each = each.groupBy("_host", "_shape", "_pages", "_symbol").agg(F.count("*").alias("_times"))
    each = each.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    have = materialize(each.groupBy("_host", "_symbol", "_k").agg(F.sum("_pages").alias("_have")), "counts")
    score = each.join(hint(have, F.length("_host") + F.length("_symbol") + 16), ["_host", "_symbol", "_k"]).groupBy("_host", "_shape").agg(F.sum("_have").alias("_sum"), F.count("*").alias("_long"))
    score = score.join(hint(hosts, F.length("_host") + 8), "_host").withColumn("_score", F.expr("2 * _sum - _n * _long"))
    best = score.groupBy("_host", "_n").agg(F.max(F.struct("_score", "_shape")).alias("_best")).select("_host", "_n", F.col("_best._shape").alias("_shape"))
    return best.join(kinds, ["_host", "_shape"]).select("_host", "_base", "_n")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", hint: Callable = lambda df, size: df) -> DataFrame:
    """(_host, _wrapper) of each host from all its different pages, as infer() does it.

    Each task aligns a host's skeletons with the host's base and sends one row of sums a host (or a few, to bound its memory); no two pages
    need to meet. Hosts with fewer than LEAST_PAGES different pages, or without a root, have no row. hint(table, bytes a row) marks
    tables to broadcast.
    """
    different = materialize(shapes(pages, url_col, html_col), "shapes")
    base = materialize(bases(different, hint), "bases")
    names = ["_pages", "_mass", "_gaps", "_least", "_most"]
    schema = "_host string, _base string, _n long, " + ", ".join(f"{x} array<long>" for x in names)
    arrow = pa.schema([("_host", pa.string()), ("_base", pa.string()), ("_n", pa.int64()), *((x, pa.list_(pa.int64())) for x in names)])

    def send(held):
        rows = [{"_host": h, "_base": base, "_n": n} | dict(zip(names, t.parts(), strict=True)) for h, (base, n, t) in held.items()]
        return pa.RecordBatch.from_pylist(rows, arrow)

    def run(batches, most=500_000):
        held, size, known, room = {}, 0, {}, 0
        for b in batches:
            for host, kind, symbols, base, n, sizes, hashes in zip(*(b.column(x).to_pylist() for x in ("_host", "_shape", "_symbols", "_base", "_n")), b.column("_sizes"), b.column("_hashes"), strict=True):
                if (host, kind) not in known:
                    if room > most:
                        known, room = {}, 0
                    known[host, kind] = Meeting(base.split("\n"), symbols.split("\n") if symbols else [])
                    room += symbols.count("\n") + 100
                if host not in held:
                    places = base.count("\n") + 1
                    held[host] = base, n, Tally(places)
                    size += places
                held[host][2].add(known[host, kind], sizes.values.to_numpy(), hashes.values.to_numpy())
                if size > most:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        base = group["_base"].iloc[0].split("\n")
        tally = Tally(len(base))
        for parts in zip(*(group[x] for x in names), strict=True):
            tally.join(parts)
        spec = tally.spec(base, int(group["_n"].iloc[0]))
        return pd.DataFrame({"_host": group["_host"][:1], "_wrapper": [json.dumps(spec) if spec["root"] else None]})

    rows = different.join(hint(base, F.length("_base") + F.length("_host") + 8), "_host").select("_host", "_shape", "_symbols", "_base", "_n", "_sizes", "_hashes")
    return rows.mapInArrow(tidy(run), schema).groupBy("_host").applyInPandas(join, "_host string, _wrapper string").where("_wrapper IS NOT NULL")


def extract_text(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page.

    Wrappers are inferred from all pages of each host (wrappers) and applied to them. Texts inside a root are all kept;
    from pages without any root the texts go that all such pages of the host share (shared_texts). Tables by host are broadcast if they
    have at most most_broadcast bytes, as summed first, else joined by host. A null url belongs to the host ''; null html has the
    text ''; repeated rows and ids are extracted each; an empty table gives an empty result; other columns are not read.
    """
    kind = dict(pages.dtypes)[key_col]
    fixed = materialize(shared_texts(pages, url_col, html_col), "shared")
    hint = lambda df, size: F.broadcast(df) if (df.agg(F.sum(size).alias("n")).first().n or 0) <= most_broadcast else df
    found = materialize(wrappers(pages, url_col, html_col, hint), "wrappers")
    rows = pages.select(F.col(key_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).alias("_html"), _host(url_col).alias("_host"))
    rows = rows.join(hint(fixed, F.size("_fixed") * 16 + F.length("_host")), "_host", "left").join(hint(found, F.length("_wrapper") + F.length("_host")), "_host", "left")

    def run(batches):
        known: dict[str, Wrapper] = {}
        for b in batches:
            out = []
            for page, fixed, spec in zip(b.column("_html"), b.column("_fixed"), b.column("_wrapper").to_pylist(), strict=True):
                if spec is not None and spec not in known:
                    if len(known) >= 200:
                        known.clear()
                    known[spec] = Wrapper(json.loads(spec))
                blocks, root = main_blocks(page.as_py(), known.get(spec))
                if not root and fixed.is_valid:
                    blocks = without(blocks, frozenset(fixed.as_py()), digest)
                out.append("\n\n".join(blocks))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("_id", "_url", "_html", "_fixed", "_wrapper").mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
