"""Shared pieces of the corpus operators: checkpoint tables, chunking of Arrow batches, byte hashing, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have: the given ones, with underscores added as needed."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


#: An odd multiplier for polynomial byte hashes, and its inverse mod 2**64.
MULT = 0x9E3779B97F4A7C55 | 1
INV = pow(MULT, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it; in local mode else one of our own.

    Elsewhere an unset folder is an error: executors would write to disks that the others cannot read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tallyrule-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table in the shared folder: what reads it, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyrule/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; a lost executor then costs a re-read, not a re-run."""
    return save(df, name)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run, for mapInArrow, but what it leaves behind is freed when it ends, as Spark uses its Python workers again.

    The functions of a task come with their modules, which hang together in cycles and hold arrays; without a collection at the
    end of each task a worker keeps those of many.
    """

    def task(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return task


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a uint64 array."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept, and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base & MASK, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, mult: int = MULT) -> np.ndarray:
    """Cumulative polynomial sums c, so that (c[j]-c[i]) * mult**-i is the hash of bytes i..j-1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(mult, len(data)), out=out[1:])
    return out


def chunks(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths add up to at most limit, or one longer row alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to n-1 that each hangs together with, for edges u-v: roots are hooked to lesser ones, then paths are cut short."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        live = a != b
        if not live.any():
            return root
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _whole(schema: pa.Schema):
    """Components of all edges of one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema)
        if not len(table):
            return
        ends = pa.chunked_array(table["u"].chunks + table["v"].chunks)
        nodes = pc.unique(ends)
        nodes = nodes.take(pc.array_sort_indices(nodes))
        code = pc.index_in(ends, nodes).to_numpy()
        least = roots(code[: len(table)], code[len(table) :], len(nodes))
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([nodes.slice(i, 100_000), nodes.take(pa.array(least[i : i + 100_000]))], ["node", "component"])

    return tidy(run)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, most_local: int = 400_000) -> DataFrame:
    """Connected components of edges over orderable keys: rows (node, component), component the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014); each round is a table in the shared folder, and the one before
    is deleted. Once there are at most most_local edges, as counted, one task finishes them (some 40 MB of 128-bit keys),
    which spares rounds of many small files and changes no result. Nodes without an edge do not appear. Null keys are no edges.
    Nothing is collected but a count and a checksum a round. Raises if the rounds do not settle.
    """
    spark = edges.sparkSession
    e, path = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct(), "edges")
    last = None
    for _ in range(rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now.n <= most_local:
            kind = dict(e.dtypes)["u"]
            arrow = pa.schema([(c, _arrow_type(kind)) for c in "uv"])
            return materialize(e.coalesce(1).mapInArrow(_whole(arrow), f"node {kind}, component {kind}"), "components")
        if last == (now.n, now.s):
            break
        last = (now.n, now.s)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old = path
        e, path = save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(spark, old)
    else:
        raise RuntimeError("components did not settle")
    ends = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _arrow_type(kind: str) -> pa.DataType:
    return {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
