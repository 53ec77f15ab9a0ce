"""Sharding by a hierarchical weighted hash tree (region, rack, shard), in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


#: Buckets of slot numbers: three hexadecimal digits of a hash.
SLOT_BUCKETS = 16**3


@dataclass(frozen=True)
class Leaf:
    """One shard and its place: region name, rack name, shard number, weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n: int, initial: int | None = None, racks: int = 2, per_rack: int = 2) -> tuple[Leaf, ...]:
    """n equal shards, of which the first `initial` (all by default) stand rack by rack in regions of racks * per_rack shards.

    Every later shard is a region of its own. With the same `initial`, one more shard therefore takes rows only into itself: at
    the top of the tree the draws of all other regions stay as they were, and below it nothing changes.
    """
    first = min(n, n if initial is None else initial)
    region = lambda i: f"g{i // (racks * per_rack)}"
    old = tuple(Leaf(region(i), f"{region(i)}k{i // per_rack}", i) for i in range(first))
    return (*old, *(Leaf(f"s{i:06d}", f"s{i:06d}k", i) for i in range(first, n)))


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u)/w for u in (0, 1) from 52 bits of md5(key:node); the least draw wins, in proportion to weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(4503599627370496.0)) / F.lit(float(weight))


def _choose(key: Column, options: dict[str, tuple[float, Column]]) -> Column:
    """The option with the least weighted draw; a single option needs none."""
    items = sorted(options.items())
    if len(items) == 1:
        return items[0][1][1]
    best = F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, (w, _)) in enumerate(items)]))["i"]
    out = items[-1][1][1]
    for i, (_, (_, value)) in reversed(list(enumerate(items[:-1]))):
        out = F.when(best == i, value).otherwise(out)
    return out


def shard_of(key: Column, leaves: tuple[Leaf, ...]) -> Column:
    """Descend region, rack and shard, at each level by weighted draws among the children (a subtree weighs the sum of its leaves).

    A change of a subtree's weight moves keys only into or out of that subtree. A shard put in a region of its own
    therefore takes keys only into itself. A null key has the text 'null'.
    """
    tree: dict[str, dict[str, list[Leaf]]] = {}
    for x in leaves:
        if x.weight > 0:
            tree.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    if not tree:
        raise ValueError("a topology needs one shard with a weight above 0")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    weigh = lambda xs: sum(x.weight for x in xs)
    regions = {}
    for region, racks in tree.items():
        inner = {rack: (weigh(xs), _choose(key, {f"s{x.shard:06d}": (x.weight, F.lit(x.shard)) for x in xs})) for rack, xs in racks.items()}
        regions[region] = (sum(w for w, _ in inner.values()), _choose(key, inner))
    return _choose(key, regions)


def assign(df: DataFrame, leaves: tuple[Leaf, ...], id_col: str = "doc_id", text_col: str = "text", grown: tuple[Leaf, ...] | None = None) -> DataFrame:
    """Shards, and gapless slots from 0 within each shard, of every row.

    Law `key`: the id and the topology alone decide a row's shard. Slots number a shard's rows by (hash bucket of the id,
    id, size, checksum): rows are numbered within SLOT_BUCKETS buckets a shard, then offset by the counts of the buckets
    before, so no task holds a shard. The offsets are at most SLOT_BUCKETS * shards rows, which bounds the broadcast.
    Rows with equal ids share a shard; a null id counts as the text 'null'; a null text has size 1 and checksum 0; an
    empty table gives an empty result. Only id and text are read, so other columns cannot clash.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), leaves).cast("int"))
    rows = rows.withColumn("grown_shard", (shard_of(F.col("doc_id"), grown) if grown else F.lit(None)).cast("int"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":slot"))
    rows = rows.withColumn("_bucket", F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")) - 1
    out = rows.withColumn("_at", within).join(F.broadcast(offsets), ["shard", "_bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot"), "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7, and where each goes with a ninth shard."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), topology(8), grown=topology(9, 8))


def _choice_sql(options: dict[str, tuple[float, str]]) -> str:
    """_choose() as SQL; draws are repeated by name, which the database computes once."""
    items = sorted(options.items())
    if len(items) == 1:
        return items[0][1][1]
    draw = lambda n, w: f"(-ln((('0x' || substr(md5(doc_id || ':{n}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / {w!r}::DOUBLE)"
    least = "least(" + ", ".join(draw(n, w) for n, (w, _) in items) + ")"
    return "CASE " + " ".join(f"WHEN {draw(n, w)} = {least} THEN {v}" for n, (w, v) in items) + " END"


def shard_sql(leaves: tuple[Leaf, ...]) -> str:
    tree: dict[str, dict[str, list[Leaf]]] = {}
    for x in leaves:
        tree.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    racks = {g: {k: (sum(x.weight for x in xs), _choice_sql({f"s{x.shard:06d}": (x.weight, str(x.shard)) for x in xs})) for k, xs in inner.items()} for g, inner in tree.items()}
    return _choice_sql({g: (sum(w for w, _ in inner.values()), _choice_sql(inner)) for g, inner in racks.items()})


OP5_SQL = f"""
WITH steps AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32 FROM b, crc),
s AS (SELECT *, ({shard_sql(topology(8))})::INT AS shard, ({shard_sql(topology(9, 8))})::INT AS grown_shard, substr(md5(doc_id || ':slot'), 1, 3) AS bucket FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM s
"""
