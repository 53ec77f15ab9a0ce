"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import tidy

#: Symbol classes: 0 what is no letter, 1-26 the letters a to z, 27-63 all other letters by a hash of the code point.
CLASSES = 64
NGRAM = 3


def letter_classes() -> np.ndarray:
    """The symbol class of every code point (of lower-cased text)."""
    points = np.arange(0x110000, dtype=np.uint64)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    other = 27 + ((points * np.uint64(2654435761)) % np.uint64(1 << 32) >> np.uint64(12)) % np.uint64(CLASSES - 27)
    out = np.where(letters, other, 0).astype(np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def ngram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bipolar vectors of n-grams: each letter's random vector permuted once a place from the end, then bound by products."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dim))
    out = np.ones((len(codes), dim), np.int8)
    for place in range(NGRAM):
        out *= np.roll(letters, NGRAM - 1 - place, axis=1)[(codes // CLASSES ** (NGRAM - 1 - place)) % CLASSES]
    return out


class Grams:
    """N-gram counts of texts, over codes in base CLASSES."""

    def __init__(self) -> None:
        self.classes = letter_classes()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(codes, counts); None if the text has no letter. Runs of non-letters count as one; the text stands between two of them."""
        if not text:
            return None
        c = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = c > 0
        if not letter.any():
            return None
        c = np.concatenate(([0], c[letter | np.concatenate(([False], letter[:-1]))], [0])).astype(np.int32)
        codes = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        return np.unique(codes, return_counts=True)


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: names, and for each a unit vector."""

    langs: tuple[str, ...]
    prototypes: np.ndarray
    dim: int
    seed: int


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = 1024, seed: int = 11, most_langs: int = 2000) -> Profiles:
    """Bundle the n-gram vectors of each language's texts into a prototype.

    The counts cover every labelled row. Each task sums its own counts first; what reaches the driver is one count for each
    language and n-gram code, at most most_langs * CLASSES**3 and in practice some thousands a language; over most_langs languages raise
    an error instead of leaving some out. A text's counts are scaled to unit length, so long texts do not outweigh short ones. Rows
    with a null language or without letters teach nothing, repeated rows teach each time, and an empty table gives no language.
    """

    def count(batches):
        grams, sums = Grams(), {}
        for b in batches:
            for text, lang in zip(b.column("_text"), b.column("_lang").to_pylist(), strict=True):
                if (found := grams(text.as_py())) is not None:
                    total = sums.setdefault(lang, np.zeros(CLASSES**NGRAM))
                    total[found[0]] += found[1] / np.sqrt((found[1].astype(float) ** 2).sum())
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "code", "n"])

    rows = df.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    counts = rows.mapInArrow(tidy(count), "lang string, code int, n double").groupBy("lang", "code").agg(F.sum(F.round("n", 9)).alias("n"))
    table = counts.toArrow().to_pandas().sort_values(["lang", "code"])
    langs = tuple(sorted(table["lang"].unique()))
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    protos = np.zeros((len(langs), dim))
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        for at in range(0, len(own), 8192):
            part = own.iloc[at : at + 8192]
            protos[i] += part["n"].to_numpy() @ ngram_vectors(part["code"].to_numpy(), dim, seed)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    return Profiles(langs, protos.astype(np.float32), dim, seed)


class Identifier:
    """Compares texts with the prototypes; n-gram vectors are made when first met and kept up to a bound."""

    def __init__(self, profiles: Profiles, sharpness: float) -> None:
        self.profiles, self.sharpness, self.grams = profiles, sharpness, Grams()
        self.place, self.made = np.full(CLASSES**NGRAM, -1, np.int32), 0
        self.vectors, self.dots = np.empty((1024, profiles.dim), np.int8), np.empty((1024, max(1, len(profiles.langs))), np.float32)

    def learn_codes(self, codes: np.ndarray, most: int = 40_000) -> None:
        new = codes[self.place[codes] < 0]
        if not len(new):
            return
        if self.made + len(new) > most:
            self.place[:] = -1
            self.made, new = 0, codes
        while self.made + len(new) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            self.dots = np.concatenate([self.dots, np.empty_like(self.dots)])
        at = slice(self.made, self.made + len(new))
        self.place[new] = np.arange(at.start, at.stop)
        self.vectors[at] = ngram_vectors(new, self.profiles.dim, self.profiles.seed)
        self.dots[at] = self.vectors[at].astype(np.float32) @ self.profiles.prototypes.T
        self.made = at.stop

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, cosine with its prototype)."""
        found = self.grams(text) if self.profiles.langs else None
        if found is None:
            return "und", 0.0, 0.0
        codes, n = found
        self.learn_codes(codes)
        at, n = self.place[codes], n.astype(np.float32)
        bundle = np.zeros(self.profiles.dim, np.float32)
        for k in range(0, len(at), 2048):
            bundle += n[k : k + 2048] @ self.vectors[at[k : k + 2048]].astype(np.float32)
        cosine = (n @ self.dots[at]) / max(float(np.linalg.norm(bundle)), 1e-9)
        best = int(np.argmax(cosine))
        return self.profiles.langs[best], float(1 / np.exp(self.sharpness * (cosine - cosine[best])).sum()), float(cosine[best])


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 20.0) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text: the prototype with the largest cosine.

    score is the softmax of sharpness * cosine at the winner, 0 for `und`: a null text, one without letters, or no learned
    language. Ties go to the first language in order. One narrow pass; only id and text are read.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches) -> Iterator[pa.RecordBatch]:
        identify = Identifier(profiles, sharpness)
        for b in batches:
            found = [identify(text.as_py()) for text in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, profiles: Profiles, text_col: str = "text", least_sigmas: float = 3.0) -> DataFrame:
    """The rows, with all their columns, whose text is in a language of the profiles; decided in place.

    Vectors that have nothing to do with each other have cosines around 0 with a standard deviation of 1 / sqrt(dim). A text goes if
    its best cosine is under least_sigmas of those, so that it resembles no language more than noise does, or if it is null, empty
    or without letters. Repeated rows and ids are judged each; an empty table, or profiles without a language, give an empty
    result. All columns pass through whatever their names.
    """
    least = least_sigmas / np.sqrt(profiles.dim)

    def run(batches) -> Iterator[pa.RecordBatch]:
        identify = Identifier(profiles, 1.0)
        for b in batches:
            found = [identify(text.as_py()) for text in b.column(text_col)]
            yield b.filter(pa.array([lang != "und" and cosine >= least for lang, _, cosine in found], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id's text mod 4 is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out()))
    return predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
