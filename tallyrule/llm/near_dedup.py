"""MinHash near-duplicates by an LSH forest, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import INV, MULT, chunks, components, fresh, materialize, mix, powers, prefix_hash, tidy

TREES = 32
#: Signature values a tree sorts by. Neighbours in its order are candidates from FLOOR equal leading values on; a row that has no such
#: neighbour climbs to its deepest agreement, down to SHALLOW values.
DEPTH, FLOOR, SHALLOW = 6, 5, 4
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[str | None], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of every word, A-Z lower-cased; words are runs of bytes that are not in `space`.

    Texts are taken together, as one buffer with a space after each.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    edge = np.diff(space[data].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = prefix_hash(data)
    words = mix((total[ends] - total[starts]) * powers(INV, int(starts[-1]) + 1)[starts])
    return np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right"), words


def shingle_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, 64-bit hash) of every shingle of width words; a shorter text is one shingle of all its words."""
    doc, words = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    out = words.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            out[:-k] = out[:-k] * np.uint64(MULT) + words[k:]
        whole = np.arange(len(words)) + width - 1
        keep = (whole < len(words)) & (doc[np.minimum(whole, len(words) - 1)] == doc) if len(words) else np.zeros(0, bool)
        short_docs = np.flatnonzero((n > 0) & (n < width))
        first = np.searchsorted(doc, short_docs)
        short = np.zeros(len(short_docs), np.uint64)
        for k in range(width - 1):
            more = n[short_docs] > k
            short[more] = short[more] * np.uint64(MULT) + words[first[more] + k]
        # a short text's only shingle is told apart from a whole one with the same start
        short = mix(short ^ (n[short_docs].astype(np.uint64) << np.uint64(56)) ^ np.uint64(0x5851F42D4C957F2D)) if len(short) else short
        return np.concatenate([doc[keep], short_docs]), np.concatenate([mix(out[keep]), short])


def sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingle hashes of each text, one after the other."""
    doc, h = shingle_hashes(texts, width)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[fresh], h[fresh]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), h


def batches_of_texts(batches, columns: tuple[str, ...], limit: int = CHUNK) -> Iterator[tuple[list[pa.Array], list[str | None]]]:
    """Slices of Arrow batches of at most limit bytes of text (or one longer row)."""
    for b in batches:
        text = b.column("_text")
        lengths = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]) if text.type == pa.string() and len(text) else np.array([len(t.as_py() or "") for t in text], np.int64)
        for i, j in chunks(lengths, limit):
            part = b.slice(i, j - i)
            yield [part.column(c) for c in columns], part.column("_text").to_pylist()


def _sketcher(width: int, seed: int = 5):
    rng = np.random.default_rng(seed)
    mult = (rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)

    def run(batches):
        for (ids,), texts in batches_of_texts(batches, ("_id",)):
            at, h = sets(texts, width)
            n = np.diff(at)
            some = np.flatnonzero(n)
            starts = at[:-1][some]
            with np.errstate(over="ignore"):
                low, high = (h ^ (h >> np.uint64(32))).astype(np.uint32), (h >> np.uint64(29)).astype(np.uint32) | np.uint32(1)
                sig = np.zeros((len(texts), TREES * DEPTH), ">u2")
                if len(some):
                    buf = np.empty_like(low)
                    for k in range(TREES * DEPTH):
                        np.multiply(low ^ add[k], mult[k], out=buf)
                        buf ^= buf >> np.uint32(15)
                        buf *= high
                        sig[some, k] = np.minimum.reduceat(buf, starts) & np.uint32(0xFFFF)
                a, c = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
                if len(some):
                    a[some] = np.add.reduceat(h, starts)
                    c[some] = np.add.reduceat(mix(h * np.uint64(MULT)), starts)
            fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.nbytes // len(x)), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            node = np.stack([a, c], axis=1).astype(">u8")
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), fixed(node), fixed(sig)], ["_id", "n", "node", "sig"])

    return run


def _agreement(key: np.ndarray) -> np.ndarray:
    """How many leading values each sorted key shares with the key before it: -1 for the first and across trees."""
    if not len(key):
        return np.zeros(0, np.int64)
    tree, values = key[:, 0], key[:, 1:].reshape(len(key), DEPTH, 2)
    same = (values[1:] == values[:-1]).all(axis=2)
    depth = np.where(same.all(axis=1), DEPTH, np.argmin(same, axis=1))
    return np.concatenate(([-1], np.where(tree[1:] == tree[:-1], depth, -1)))


def _linked(depth: np.ndarray) -> np.ndarray:
    """Whether each row is linked with the row before it, from the agreements of a whole run (see forest_links)."""
    after = np.append(depth[1:], -1)
    best = np.maximum(depth, after)  # of each row
    before = np.concatenate(([-1], best[:-1]))
    # FLOOR holds for all; above it a pair is linked if it is the best that either of its two rows has
    return (depth >= FLOOR) | (depth >= SHALLOW) & ((depth == best) | (depth == before))


def _rows(flat: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in flat], pa.binary())


def _neighbours(batches):
    """Of a task's sorted rows (key, node): the links, as (a, b), and its first and last row, as (a, key, part, turn).

    What goes from batch to batch are three rows: a link is decided by the agreements on its two sides.
    """
    flat = lambda b, c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), -1)
    names = ["a", "b", "key", "part", "turn"]
    part = TaskContext.get().partitionId()
    key = node = None

    def links(at: np.ndarray):
        none = pa.nulls(len(at), pa.int32())
        return pa.RecordBatch.from_arrays([_rows(node[at - 1]), _rows(node[at]), pa.nulls(len(at), pa.binary()), none, none], names)

    def end(k: int, turn: int):
        return pa.RecordBatch.from_arrays([_rows(node[k : k + 1]), pa.nulls(1, pa.binary()), _rows(key[k : k + 1]), pa.array([part], pa.int32()), pa.array([turn], pa.int32())], names)

    todo = 1  # the first row whose link to the row before it is open
    for b in batches:
        if not len(b):
            continue
        if key is None:
            key, node = flat(b, "key"), flat(b, "node")
            yield end(0, 0)
        else:
            key, node = np.concatenate([key, flat(b, "key")]), np.concatenate([node, flat(b, "node")])
        on = np.flatnonzero(_linked(_agreement(key))[:-1])
        yield links(on[on >= todo])
        key, node = key[-3:].copy(), node[-3:].copy()
        todo = max(1, len(key) - 1)
    if key is not None:
        on = np.flatnonzero(_linked(_agreement(key)))
        yield links(on[on >= todo])
        yield end(len(key) - 1, 1)


def _seams(batches):
    """Links between the last row of a task and the first of the next one with rows, from the ends of all tasks in order."""
    last = None
    for b in batches:
        found = []
        for node, key, turn in zip(*(b.column(c).to_pylist() for c in ("a", "key", "turn")), strict=True):
            if turn == 0 and last is not None:
                depth = _agreement(np.frombuffer(last[1] + key, np.uint8).reshape(2, -1))[1]
                if depth >= SHALLOW and last[0] != node:
                    found.append((last[0], node))
            last = node, key
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])


def forest_links(nodes: DataFrame) -> DataFrame:
    """Candidate links (a, b) of nodes (node, sig) from the sorted orders of all trees.

    Each row goes to the neighbours with which it shares its longest prefix, so the depth follows the region: where rows agree on
    FLOOR values and more all of them hang together in one chain, and where they do not, a row climbs to its deepest agreement if
    that has SHALLOW values. The orders are cut by sampled splitters of whole keys, so a region of any size is spread over tasks;
    two rows a task are kept to link it with the next.
    """
    step = 2 * DEPTH
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring(F.col("sig"), t * step + 1, F.lit(step))))
    trees = nodes.select("node", F.explode(keys).alias("key")).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = materialize(trees.mapInArrow(tidy(_neighbours), "a binary, b binary, key binary, part int, turn int"), "links")
    ends = found.where("part IS NOT NULL").select("a", "key", "part", "turn").coalesce(1).sortWithinPartitions("part", "turn")
    return found.where("part IS NULL").select("a", "b").union(ends.mapInArrow(tidy(_seams), "a binary, b binary"))


def _link(group: list[tuple[bytes, np.ndarray]], similarity: tuple[int, int]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the exact links (100 * intersection >= 80 * union, as a fraction) among a group's sets.

    Counts intersections through an inverted index, one set against all, and stops once all sets hang together. Sets outside the
    largest cluster are taken in turn, so no link between clusters is missed; no list of pairs is made.
    """
    m = len(group)
    if m < 2:
        return []
    num, den = similarity
    names, arrays = [g[0] for g in group], [g[1] for g in group]
    size = np.array([len(x) for x in arrays])
    tokens = np.concatenate(arrays)
    owner = np.repeat(np.arange(m), size)
    uniq, code = np.unique(tokens, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, at = owner[order], np.searchsorted(code[order], np.arange(len(uniq) + 1))
    first = np.concatenate(([0], np.cumsum(size)))
    cluster, count, forest, done = np.arange(m), np.ones(m, np.int64), [], np.zeros(m, bool)
    clusters = m
    turn = int(np.argmax(np.bincount(posting[np.isin(code[order], np.flatnonzero(np.diff(at) > m // 2))], minlength=m)))  # a set with the common shingles
    while clusters > 1:
        done[turn] = True
        own = code[first[turn] : first[turn + 1]]
        hits = np.concatenate([posting[at[c] : at[c + 1]] for c in own.tolist()]) if len(own) else np.zeros(0, np.int64)
        both = np.bincount(hits, minlength=m)
        linked = np.flatnonzero(den * both >= num * (size + size[turn] - both))
        for j in linked[cluster[linked] != cluster[turn]].tolist():
            if cluster[j] != cluster[turn]:
                forest.append((names[turn], names[j]))
                old, new = cluster[j], cluster[turn]
                count[new] += count[old]
                cluster[cluster == old] = new
                clusters -= 1
        largest = int(np.argmax(np.bincount(cluster, minlength=m)))
        left = np.flatnonzero(~done & (cluster != largest))
        if not len(left):
            break
        turn = int(left[0])
    return forest


def _confirmer(similarity: tuple[int, int]):
    def run(batches):
        held, group = [], None

        def flush():
            found = _link(held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

        for b in batches:
            names, comps, data = b.column("node").to_pylist(), b.column("block").to_pylist(), b.column("set")
            for i, comp in enumerate(comps):
                if comp != group and held:
                    yield flush()
                    held = []
                group = comp
                held.append((names[i], np.frombuffer(data[i].as_buffer(), np.uint64).copy()))
        if held:
            yield flush()

    return run


def _setter(width: int):
    def run(batches):
        for (node, comp, m), texts in batches_of_texts(batches, ("node", "component", "m")):
            at, h = sets(texts, width)
            names = [_name(h[i:j]) for i, j in zip(at, at[1:], strict=False)]
            own = np.array([x == y for x, y in zip(names, node.to_pylist(), strict=True)], bool)  # not so where ids repeat
            data = pa.array([h[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([node, comp, m, data], ["node", "component", "m", "set"]).filter(pa.array(own))

    return run


def _name(h: np.ndarray) -> bytes:
    """128 bits that name a set: two sums of its hashes, one remixed."""
    with np.errstate(over="ignore"):
        return np.array([h.sum(dtype=np.uint64), mix(h * np.uint64(MULT)).sum(dtype=np.uint64)], ">u8").tobytes()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100), block: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: components of the links with Jaccard similarity of at least num/den.

    1. Each text's shingle set is sketched by TREES * DEPTH min-hashes; equal sets become one node (128 bits of its hashes).
    2. LSH forest (forest_links): in each tree's sorted order, neighbours with FLOOR equal leading values are candidates, and rows
       without any climb to fewer. At similarity 0.8 a pair shares 5 of 5 values with probability 0.33 in each of 32 trees: at most 3
       in a million such pairs are not met.
    3. Candidates hang together in regions. Each node's full set is sent to its region once, and the links are confirmed there
       without making lists of pairs. A region of over `block` shingles is cut into blocks, and each two blocks meet in a task.
    4. Components of the confirmed links, by rounds over tables in the shared folder.
    Texts without words have no shingles and stay alone. Null texts count as empty. Null ids never represent a component unless it has
    no other id. Repeated rows are one node and share `kept`. Empty tables give an empty result. Only id and text are read.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(df.dtypes)[id_col]
    sketch = materialize(rows.mapInArrow(tidy(_sketcher(width)), f"_id {kind}, n long, node binary, sig binary"), "sketch")
    nodes = sketch.where("n > 0").groupBy("node").agg(F.min("_id").alias("_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    regions = components(forest_links(nodes))
    # sizes and least ids are tables of their own: both sides of their joins are then plain exchanges, and a large component is split
    sizes = materialize(nodes.select("node", "n").join(regions, "node").groupBy("component").agg(F.sum("n").alias("m")), "sizes")
    regions = regions.join(sizes, "component")

    member = nodes.join(regions, "node").select(F.col("_id").alias("_mid"), "node", "component", "m")
    picked = rows.join(member, F.col("_id").eqNullSafe(F.col("_mid"))).select("_text", "node", "component", "m")
    full = picked.mapInArrow(tidy(_setter(width)), "node binary, component binary, m long, set binary")
    parts = F.ceil(F.col("m") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    blocks = F.when(F.col("m") <= block, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.concat_ws(",", F.least(k, mine), F.greatest(k, mine))))
    spread = full.select("node", "set", "component", F.explode(blocks).alias("pair")).select(F.concat_ws("/", F.hex("component"), "pair").alias("block"), "node", "set")
    links = spread.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_confirmer(similarity)), "a binary, b binary")
    found = components(links)

    best = materialize(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "_id"), "best")
    least = materialize(best.groupBy("component").agg(F.min("_id").alias("component_id")), "least")
    labelled = materialize(best.join(least, "component").select("node", "component_id"), "labelled")
    alone = sketch.where("n = 0").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"))
    out = sketch.where("n > 0").select("_id", "n", "node").join(labelled, "node").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.union(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows, with all their columns, that stay: one id of each component, and every text without words. Rows that share an id go together."""
    row_id, kept_id = fresh(df, "_row_id", "_kept_id")
    kept = near_duplicates(df, id_col, text_col, width, similarity).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return df.withColumn(row_id, F.col(id_col)).join(kept, F.col(row_id).eqNullSafe(F.col(kept_id)), "left_semi").drop(row_id)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN []::VARCHAR[] WHEN len(x) = 1 THEN x ELSE list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id
"""
