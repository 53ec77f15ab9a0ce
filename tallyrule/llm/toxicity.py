"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import materialize, tidy

# Letters of other scripts that look like Latin ones, and digits and signs that stand in for letters.
HOMOGLYPHS = dict(zip("авсԁеһіјкӏморԛѕтυѵԝхуαεικνορτυχɑıⅼ", "abcdehijklmopqstuvwxyaeiknoptuxail", strict=True))
HOMOGLYPHS |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {"​": "", "‌": "", "‍": "", "­": "", "⁠": ""}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_FOLD = str.maketrans(HOMOGLYPHS)
_SUB = str.maketrans(SUBSTITUTES)
_DIGITS = re.compile(r"[0134578@$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
STEM = 4


def fold(text: str | None) -> str:
    """Lower case, look-alike letters as Latin, and digits or signs that stand right before a letter as the letters they mimic."""
    if not text:
        return ""
    out = text.lower()
    if not out.isascii():
        out = out.translate(_FOLD)
    return _DIGITS.sub(lambda m: m[0].translate(_SUB), out)


@dataclass(frozen=True)
class Lexicon:
    """Patterns with weights (a trailing * matches any word that begins so), exception phrases, and the fit of the score."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    intercept: float
    slopes: tuple[float, float]


class Matcher:
    """Sums of the lexicon's weights over a folded text; each word counts once a place, by its longest pattern."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.auto = lexicon, ahocorasick.Automaton()
        for pattern, w in lexicon.weights.items():
            word = pattern.rstrip("*")
            old = self.auto.get(word, None)
            self.auto.add_word(word, (len(word), w if pattern.endswith("*") else old and old[1], old[2] if pattern.endswith("*") and old else None if pattern.endswith("*") else w))
        if len(self.auto):
            self.auto.make_automaton()

    def __call__(self, folded: str) -> float:
        if not len(self.auto):
            return 0.0
        best: dict[int, float] = {}
        for end, (n, as_stem, as_word) in self.auto.iter(folded):
            start = end - n + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end + 1 == len(folded) or not folded[end + 1].isalpha()
            w = as_word if whole and as_word is not None else as_stem
            if w is not None:
                best[start] = w
        if best and self.lexicon.exceptions:
            best = {at: w for at, w in best.items() if not any(x in self.lexicon.exceptions for x in phrases(folded, at))}
        return sum(best.values())

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of the total weight, log of the weight per 100 words), each plus 1 inside."""
        folded = fold(text)
        total = self(folded)
        if not total:
            return 0.0, 0.0
        return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.lexicon.intercept + self.lexicon.slopes[0] * a + self.lexicon.slopes[1] * b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def phrases(folded: str, at: int) -> list[str]:
    """The word at a place with the word before it, and with the word after it, however far those are."""
    here = _WORD.match(folded, at)
    if here is None:
        return []
    after = _WORD.search(folded, here.end())
    end = at
    while end and not _letter(folded[end - 1]):
        end -= 1
    start = end
    while start and _letter(folded[start - 1]):
        start -= 1
    return [" ".join(x) for x in ((folded[start:end], here[0]), (here[0], after[0] if after else "")) if all(x)]


def _letter(c: str) -> bool:
    return _WORD.match(c) is not None


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_terms: int = 100_000) -> Lexicon:
    """Learn lexicon, exceptions and score from a bounded sample of labelled rows.

    The sample is the max_rows labelled ids with the smallest hash; that many rows (16 bytes each) are broadcast, so the
    corpus is not shuffled. Terms are words, and stems of 4 to 7 letters, seen in at least 5 toxic texts, with log-odds of at
    least 2.5; a pattern whose stem is already there is left out. At most max_terms come to the driver, the weightiest first; that bounds
    the model as max_rows bounds the sample, and the sample reaches it only if its texts are mostly of words found in toxic ones.
    Exceptions are pairs of a lexicon word and its neighbour that are seen in at least 3 texts, under a tenth of them toxic.
    The score is a logistic fit on the two length-aware features. Null labels and ids teach nothing, an id labelled or standing
    twice teaches twice, ties in the hash go by id; without labels of both kinds the lexicon is empty and all scores are low.
    """
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = materialize(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("_text", "_y"), "labelled")

    def terms(batches) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column("_text"), b.column("_y").to_pylist(), strict=True):
                words = {w for w in _WORD.findall(fold(text.as_py())) if len(w) >= 3}
                own = words | {f"{w[:k]}*" for w in words for k in range(STEM, min(len(w), 7) + 1)} | {""}
                seen[y > 0].update(own)
        keys = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["term", "toxic", "clean"])

    counts = rows.mapInArrow(tidy(terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = rows.agg(F.sum((F.col("_y") > 0).cast("int")).alias("t"), F.count("*").alias("n")).first()
    t, c = totals["t"] or 0, totals["n"] - (totals["t"] or 0)
    if not t or not c:
        return Lexicon({}, frozenset(), -4.0, (0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (t + 1.0)) - F.log((F.col("clean") + 0.5) / (c + 1.0))
    top = counts.where("toxic >= 5 AND term <> ''").withColumn("w", odds).where("w >= 2.5").orderBy(F.desc(F.col("w") * F.log1p("toxic")), "term").limit(max_terms).collect()
    weights: dict[str, float] = {}
    seen: dict[str, int] = {}
    for x in sorted(top, key=lambda x: (-x.toxic, -len(x.term.rstrip("*")), x.term)):  # of stems with the same support, the longest
        word = x.term.rstrip("*")
        wider = max((n for k, n in seen.items() if k.startswith(word)), default=0)
        if any(f"{word[:k]}*" in weights for k in range(STEM, len(word) + 1)) or x.toxic <= 1.02 * wider:
            continue
        weights[x.term], seen[word] = float(x.w), x.toxic
    plain = Matcher(Lexicon(weights, frozenset(), 0.0, (0.0, 0.0)))

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ys = [], []
            for text, y in zip(b.column("_text"), b.column("_y").to_pylist(), strict=True):
                folded = fold(text.as_py())
                found = {p for end, (n, _, _) in (plain.auto.iter(folded) if len(plain.auto) else ()) for p in phrases(folded, end - n + 1) if end - n + 1 == 0 or not folded[end - n].isalpha()}
                keys += found
                ys += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ys, pa.int32())], ["pair", "y"])

    harmless = rows.mapInArrow(tidy(pairs), "pair string, y int").groupBy("pair").agg(F.count("*").alias("n"), F.avg("y").alias("y")).where("n >= 3 AND y < 0.1").orderBy(F.desc("n"), "pair").limit(max_terms)
    bare = Lexicon(weights, frozenset(x.pair for x in harmless.collect()), 0.0, (0.0, 0.0))

    def points(batches) -> Iterator[pa.RecordBatch]:
        match, seen = Matcher(bare), Counter()
        for b in batches:
            for text, y in zip(b.column("_text"), b.column("_y").to_pylist(), strict=True):
                seen[(*(round(x * 8) for x in match.features(text.as_py())), int(y > 0))] += 1
        cols = list(zip(*seen, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in cols), pa.array(list(seen.values()), pa.int64())], ["a", "b", "y", "n"])

    grid = rows.mapInArrow(tidy(points), "a int, b int, y int, n long").groupBy("a", "b", "y").agg(F.sum("n").alias("n")).toPandas()  # at most some hundred cells
    x = np.column_stack([np.ones(len(grid)), grid["a"] / 8, grid["b"] / 8])
    y, n, beta = grid["y"].to_numpy(float), grid["n"].to_numpy(float), np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (n * (y - p)) - 0.5 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return Lexicon(weights, bare.exceptions, float(beta[0]), (float(beta[1]), float(beta[2])))


def predict(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; a null text scores as an empty one.

    Rows are judged alone, so repeated and null ids do no harm; an empty table gives an empty result; only id and text are read.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon)
        for b in batches:
            scores = np.array([match.score(text.as_py()) for text in b.column("_text")], float)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id's text mod 3 is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return predict(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
