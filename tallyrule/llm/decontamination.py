"""Benchmark decontamination: rare word pairs as seeds find passages, Smith-Waterman alignment of words scores them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import MULT, chunks, mix, tidy
from tallyrule.llm.near_dedup import batches_of_texts, word_hashes

#: White space and ASCII punctuation part words here, so changed punctuation costs nothing.
_GAPS = np.zeros(256, bool)
_GAPS[[*range(0x21), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Scripts written without spaces (Thai to Tibetan, Myanmar, Khmer, kana, ideographs): each character is a word.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def spaced(text: str | None) -> str:
    """The text with spaces around each character of an unspaced script."""
    text = text or ""
    return text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)


@dataclass
class Items:
    """A block of test items: ids, word hashes with offsets, the words as places in their sorted vocabulary, and the sorted seeds with
    their items and places.
    """

    ids: list
    at: np.ndarray
    words: np.ndarray
    vocabulary: np.ndarray
    codes: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # for each word of the vocabulary (and any other) the last region that has it; -1 between texts
    short: dict  # for each number of words under least_words: sorted hashes of the items with so many, and their numbers


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word with the next, and of each word with the one after that; equal words give equal hashes in both."""
    first = words * np.uint64(MULT)
    return mix(first[:-1] + words[1:]), mix(first[:-2] + words[2:])


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(words) - k + 1)
    out = words[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(MULT) + words[i : i + n]
    return mix(out)


def least_seeds(size: int, threshold: float) -> int:
    """How many words of an item an alignment of at least threshold matches along with one of the next two, one or two words on in the text.

    With m matches and costs p, 2m - p is at least 2 * threshold * size. Of the m - 1 steps between matches all others skip two
    words or more on one side and cost at least 2, so there are at least threshold * size - 1 such steps.
    """
    return max(1, math.ceil(threshold * size - 1 - 1e-9))


def index(items: list[tuple], least_words: int, threshold: float = 0.5) -> Items:
    """The seeds of items with at least least_words words: both pairs of each item's rarest places. Shorter items are kept whole.

    All but least_seeds - 1 of an item's places are taken, so every alignment of at least threshold meets one of them; which places
    count as rare (over the block) decides the time taken, never the result.
    """
    doc, words = word_hashes([spaced(t) for _, t in items], _GAPS)
    cuts = np.searchsorted(doc, np.arange(len(items) + 1))
    own = [pairs(words[i:j]) if j - i >= max(2, least_words) else (words[:0], words[:0]) for i, j in zip(cuts, cuts[1:], strict=False)]
    uniq, count = np.unique(np.concatenate([np.unique(np.concatenate(g)) for g in own] or [np.zeros(0, np.uint64)]), return_counts=True)
    seeds, item, place = [], [], []
    for i, (near, far) in enumerate(own):
        if not len(near):
            continue
        often = count[np.searchsorted(uniq, near)]
        often[: len(far)] += count[np.searchsorted(uniq, far)]
        rare = np.sort(np.argsort(often, kind="stable")[: len(near) + 1 - least_seeds(len(near) + 1, threshold)])
        wide = rare[rare < len(far)]
        seeds += [near[rare], far[wide]]
        item.append(np.full(len(rare) + len(wide), i))
        place += [rare, wide]
    seeds, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, item, place))
    order = np.argsort(seeds, kind="stable")
    short = {}
    for k in range(1, max(2, least_words)):
        which = np.flatnonzero(np.diff(cuts) == k)
        if len(which):
            whole = np.concatenate([runs(words[cuts[i] : cuts[i + 1]], k) for i in which])
            by = np.argsort(whole, kind="stable")
            short[k] = whole[by], which[by]
    vocabulary, codes = np.unique(words, return_inverse=True)
    return Items([i for i, _ in items], cuts, words, vocabulary, codes, seeds[order].astype(np.uint64), item[order], place[order], np.full(len(vocabulary) + 1, -1), short)


def align(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """(best local alignment score, end in text). Rows run over the item; gaps along a row come from a running maximum."""
    steps = -gap * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.maximum(row + gap, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, match, mismatch))
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def exact(x: Items, words: np.ndarray) -> list[tuple[int, float, int, int]]:
    """The short items that a text holds whole, as in matches(); the end is that of the first copy."""
    out = []
    for k, (whole, which) in x.short.items():
        g = runs(words, k)
        lo = np.searchsorted(whole, g, "left")
        at = np.flatnonzero(whole[np.minimum(lo, len(whole) - 1)] == g)
        h, first = np.unique(g[at], return_index=True)
        for a, b, end in zip(np.searchsorted(whole, h, "left"), np.searchsorted(whole, h, "right"), at[first] + k, strict=True):
            out += [(int(i), 1.0, k - 1, int(end)) for i in which[a:b]]
    return out


def matches(x: Items, words: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item number, score, seeds, end word) of the items found in one text; score is the alignment's share of a perfect one.

    Every region with a seed is aligned unless it has too few of the item's words or pairs for the threshold. Short items
    match where they occur whole.
    """
    whole = exact(x, words) if x.short else []
    if len(words) < 2 or not len(x.seeds):
        return sorted(whole)
    near, far = pairs(words)
    g = np.concatenate((near, far))
    lo = np.searchsorted(x.seeds, g, "left")
    at = np.flatnonzero(x.seeds[np.minimum(lo, len(x.seeds) - 1)] == g)
    if not len(at):
        return sorted(whole)
    lo = lo[at]
    n = np.searchsorted(x.seeds, g[at], "right") - lo
    hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = np.repeat(np.where(at < len(near), at, at - len(near)), n)
    item, shift = x.item[hit], pos - x.place[hit]
    order = np.lexsort((shift, item))
    item, shift = item[order], shift[order]
    length = np.diff(x.at)[item]
    # seeds of one item whose diagonals lie close together are one region
    cut = np.concatenate(([True], (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > length[1:] // 4 + 8)))
    starts = np.flatnonzero(cut)
    codes = np.searchsorted(x.vocabulary, words)
    codes[x.vocabulary[np.minimum(codes, len(x.vocabulary) - 1)] != words] = len(x.vocabulary)
    seen = x.seen
    found: dict[int, tuple[float, int, int]] = {}
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(item)], strict=True):
        i, size = int(item[s]), int(length[s])
        reach = math.ceil(2 * (1 - threshold) * size)  # words that an alignment can leave out or add
        a, b = max(0, int(shift[s]) - reach), int(shift[e - 1]) + size + reach
        seen[codes[a:b]] = s
        if np.count_nonzero(seen[x.codes[x.at[i] : x.at[i + 1]]] == s) < threshold * size:
            continue
        own, text = x.words[x.at[i] : x.at[i + 1]], words[a:b]
        first, second = pairs(own)
        here = np.isin(np.concatenate((first, second)), np.concatenate((near[a : b - 1], far[a : max(a, b - 2)])))
        seeds = int((here[: len(first)] | np.append(here[len(first) :], False)).sum())
        if seeds < least_seeds(size, threshold):
            continue
        score, end = align(own, text)
        score /= 2 * size
        if score >= threshold and score > found.get(i, (0.0,))[0]:
            found[i] = (score, seeds, a + end)
    seen[codes] = -1
    return sorted(whole + [(i, *v) for i, v in found.items()])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, least_words: int, most_words: int, threshold: float) -> Iterator[Items]:
    """The test items in blocks of at most most_words words (or one longer item): the bound of what each task is sent."""
    held, words = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = spaced(row[1]).count(" ") + 1
        if held and words + n > most_words:
            yield index(held, least_words, threshold)
            held, words = [], 0
        held.append((row[0], row[1]))
        words += n
    if held:
        yield index(held, least_words, threshold)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, least_words: int = 5, most_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, end_word): each whole text's test items that align with at least threshold of a full copy.

    n_seeds is the number of the item's words that occur near the passage with one of the two words after them.
    Test items are the query set; it meets all rows block by block, a block being at most most_words words. A passage found
    in any number of texts costs each only its own alignment, and nothing is shuffled. Items under least_words words
    match where their words occur whole and in order; null or wordless items and null texts match nothing, and an item with a null id is
    reported with it. Characters of scripts without
    spaces are words. An empty side gives no rows. Repeated rows or ids are reported for each row.
    """
    kinds = dict(df.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, n_seeds long, end_word long"
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, least_words, most_words, threshold):

        def run(batches, items=items):
            for (ids,), texts in batches_of_texts(batches, ("_id",)):
                doc, words = word_hashes([spaced(t) for t in texts], _GAPS)
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                at, found = [], []
                for k in range(len(texts)):
                    own = matches(items, words[cuts[k] : cuts[k + 1]], threshold)
                    at += [k] * len(own)
                    found += own
                item_ids = pa.array([items.ids[f[0]] for f in found], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kinds[1]))
                if found:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), item_ids, pa.array([f[1] for f in found]), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], ["doc_id", "item_id", "score", "n_seeds", "end_word"])

        part = rows.mapInArrow(tidy(run), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, least_words: int = 5, most_words: int = 2_000_000) -> DataFrame:
    """The rows, with all their columns, whose text matches no test item; decided in place, so nothing is shuffled or joined.

    Null and empty texts match nothing and stay, as do all rows if there is no test item; null or wordless items match nothing. Repeated
    rows and ids are judged each; an empty table gives an empty result. All columns pass through whatever their names.
    """
    out = df
    for items in _blocks(benchmark, item_col, item_text_col, least_words, most_words, threshold):

        def run(batches, items=items):
            for b in batches:
                for i, j in _cut(b, text_col):
                    part = b.slice(i, j - i)
                    doc, words = word_hashes([spaced(t) for t in part.column(text_col).to_pylist()], _GAPS)
                    cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                    yield part.filter(pa.array([not matches(items, words[a:c], threshold) for a, c in zip(cuts, cuts[1:], strict=False)], pa.bool_()))

        out = out.mapInArrow(tidy(run), df.schema)
    return out


def _cut(batch: pa.RecordBatch, text_col: str, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    yield from chunks(np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(text_col)], np.int64), limit)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
