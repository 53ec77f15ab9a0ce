"""Exact deduplication by Grace hashing: open-addressing tables over complete contents, overflow spilled and recursed."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import fresh, materialize, tidy

SPACES = r"[\x20\x09-\x0D]+"
FANOUT_BITS = 4
#: One entry: 64-bit hash, digest, content, smallest id (or None), rows.
Entry = tuple[int, bytes, str, "int | None", int]


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def least(a, b):
    """The smaller id; None only where both are."""
    return b if a is None else a if b is None else min(a, b)


class Table:
    """An open-addressing table (linear probing, load at most 1/2) keyed by hash and complete content."""

    def __init__(self) -> None:
        self.slots, self.entries, self.bytes = np.full(64, -1, np.int64), [], 0

    def find(self, h: int, content: str) -> tuple[int, int]:
        """(slot, entry number or -1)."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := int(self.slots[at])) >= 0:
            e = self.entries[k]
            if e[0] == h and e[2] == content:
                return at, k
            at = (at + 1) & mask
        return at, -1

    def merge(self, k: int, e: Entry) -> None:
        old = self.entries[k]
        self.entries[k] = (*old[:3], least(old[3], e[3]), old[4] + e[4])

    def insert(self, slot: int, e: Entry) -> None:
        self.slots[slot] = len(self.entries)
        self.entries.append(e)
        self.bytes += 2 * len(e[2]) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            for k, old in enumerate(self.entries):
                self.slots[self.find(old[0], old[2])[0]] = k


def grace(rows: Iterable[Entry], budget: int, level: int = 0) -> Iterator[Entry]:
    """Distinct contents with their smallest id and rows, in memory bounded by the budget (and one content).

    Contents that find no room in the table go to one of 16 spill files by the next four bits of a remixed hash, and each file
    is treated the same way. A table takes at least one content, so the recursion ends even if all hashes are equal.
    The files are private to the running task: a task that is run again makes its own.
    """
    table, files = Table(), {}
    for e in rows:
        slot, k = table.find(e[0], e[2])
        if k >= 0:
            table.merge(k, e)
        elif not table.entries or table.bytes < budget:
            table.insert(slot, e)
        else:
            part = ((e[0] * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03) >> (20 + FANOUT_BITS * (level % 8))) & ((1 << FANOUT_BITS) - 1)
            if part not in files:
                files[part] = tempfile.TemporaryFile()
            pickle.dump(e, files[part], pickle.HIGHEST_PROTOCOL)
    yield from table.entries
    del table
    for part in sorted(files):
        with files[part] as f:
            f.seek(0)
            yield from grace(_read(f), budget, level + 1)


def _read(f) -> Iterator[Entry]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[Entry]:
    for b in batches:
        ids, n = b.column("_id"), b.column("_n").to_pylist()
        for i, digest in enumerate(b.column("_sha").to_pylist()):
            # the table hashes the content by the first 8 bytes of its digest; equality is decided on the content
            yield int.from_bytes(digest[:8], "big"), digest, b.column("_text")[i].as_py(), ids[i].as_py(), n[i]


def _batches(entries: Iterable[Entry], schema: pa.Schema, text: bool, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for e in entries:
        held.append(e)
        size += len(e[2]) + 64 if text else 64
        if size > limit:
            yield _batch(held, schema, text)
            held, size = [], 0
    if held:
        yield _batch(held, schema, text)


def _batch(held: list[Entry], schema: pa.Schema, text: bool) -> pa.RecordBatch:
    cols = [[e[1] for e in held], [e[3] for e in held], [e[4] for e in held]] + ([[e[2] for e in held]] if text else [])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def classes(rows: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """Of rows (_id, _text, _sha): one row per distinct content (_sha, _keep, _size).

    Each scan task first combines copies in a table that it empties whenever it is full, so a content that makes up a third of all
    rows reaches the exchange at most a few times a task. Two contents with one SHA-256 would be two rows here; that
    is reported as an error instead of a wrong result.
    """
    id_type = pa.from_numpy_dtype(np.int64) if dict(rows.dtypes)["_id"] in ("bigint", "int", "smallint", "tinyint") else pa.string()
    kind = "long" if id_type == pa.int64() else "string"
    rows = rows.select(F.col("_id").cast(kind), "_text", "_sha", F.lit(1).cast("long").alias("_n"))
    wide = pa.schema([("_sha", pa.binary()), ("_id", id_type), ("_n", pa.int64()), ("_text", pa.string())])
    slim = pa.schema([("_sha", pa.binary()), ("_keep", id_type), ("_size", pa.int64())])

    def combine(batches):
        def flushed():
            table = Table()
            for e in _entries(batches):
                slot, k = table.find(e[0], e[2])
                if k >= 0:
                    table.merge(k, e)
                    continue
                table.insert(slot, e)
                if table.bytes > budget // 2:
                    yield from table.entries
                    table = Table()
            yield from table.entries

        yield from _batches(flushed(), wide, True)

    def finish(batches):
        yield from _batches(grace(_entries(batches), budget), slim, False)

    local = rows.mapInArrow(tidy(combine), f"_sha binary, _id {kind}, _n long, _text string")
    return local.repartition(F.col("_sha")).mapInArrow(tidy(finish), f"_sha binary, _keep {kind}, _size long")


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's class of equal normalised texts: (doc_id, keep_id, group_size, kept, text_sha256).

    A null text counts as empty. A null id is kept only in a class without other ids (keep_id null then). Repeated rows with
    one id and text are one class and share `kept`. An empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2(F.encode("_text", "UTF-8"), 256)))
    found = classes(rows)
    # a digest that stands for two contents would show up twice
    found = found.groupBy("_sha").agg(F.first("_keep").alias("_keep"), F.first("_size").alias("_size"), F.count("*").alias("_contents"))
    found = found.withColumn("_size", F.when(F.col("_contents") > 1, F.raise_error(F.lit("two contents share a SHA-256"))).otherwise(F.col("_size")))
    # a table of its own: both sides of the join are then plain exchanges, and a digest with very many rows is split among tasks
    found = materialize(found.drop("_contents"), "classes")
    out = rows.select("_id", "_sha").join(found, "_sha")
    return out.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each class of equal texts, those with the smallest id.

    Ids are matched null-safe together with the text's digest, so rows that share an id but not a text are judged apart.
    """
    row_id, row_sha, kept_id, kept_sha = fresh(df, "_row_id", "_row_sha", "_kept_id", "_kept_sha")
    marked = annotate(df, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    digest = F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)
    named = df.withColumns({row_id: F.col(id_col), row_sha: digest})
    return named.join(marked, (F.col(row_sha) == F.col(kept_sha)) & F.col(row_id).eqNullSafe(F.col(kept_id)), "left_semi").drop(row_id, row_sha)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of `documents`: who stays, and how many there are."""
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
