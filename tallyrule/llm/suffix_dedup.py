"""Repeated byte strings: sparse suffixes, range-partitioned by sampled splitters, sorted in buckets and compared.

Which suffixes are enough. Every window of `length` bytes picks an anchor: the leftmost place with the least hash of SEED bytes. Equal windows
pick the same place, so two equal windows show as two anchors with equal surroundings, and one suffix for each anchor (one byte in
about 85) stands for all the windows that picked it. Anchors' surroundings that are equal throughout settle all their windows at once.
The rest, whose SEED bytes occur elsewhere in other surroundings, are compared byte by byte in sorted buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import INV, materialize, mix, powers, prefix_hash, tidy
from tallyrule.llm.near_dedup import batches_of_texts

SEED = 32
#: Surroundings compared at once. Leads with more are cut into pieces, whose results are compared across their boundaries.
PIECE = 1024
#: Distances a cell of windows spans when pieces are compared with each other, round by round; single windows need no further one.
CELLS = (25, 5, 1)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, place, SEED-byte hash) of each anchor in documents laid end to end; ends are their ends.

    Windows that would cross a document's end do not exist. Anchors are in order of place within a document.
    """
    none = np.zeros(0, np.int64)
    span = length - SEED + 1  # places a window can pick
    n = len(data) - SEED + 1
    if n < span:
        return none, none, none, np.zeros(0, np.uint64)
    total = prefix_hash(data)
    h = mix((total[SEED:] - total[:-SEED]) * powers(INV, n))
    del total
    at = np.arange(n, dtype=np.uint64)
    key = (h & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | (at & np.uint64((1 << 24) - 1))  # ties go to the left; a buffer is under 2**24 bytes
    # sliding minimum over span places: prefix and suffix minima of blocks
    pad = -n % span
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - span + 1
    low = np.minimum(after[:windows], before[span - 1 : span - 1 + windows])
    place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(windows)
    doc_end = np.repeat(ends, np.diff(ends, prepend=0))[:windows]
    ok = start + length <= doc_end
    start, place = start[ok], place[ok]
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
    first, last = start[cut], start[np.concatenate((cut[1:], [len(start)])) - 1]
    return first, last, place[cut], h[place[cut]]


def _buffers(batches, columns: tuple[str, ...], limit: int) -> Iterator[tuple[list[pa.Array], list[bytes], np.ndarray, np.ndarray]]:
    for cols, texts in batches_of_texts(batches, columns, limit):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        yield cols, raw, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])


def _pieces(raw: list[bytes], data: np.ndarray, ends: np.ndarray, length: int, most: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """anchors() with the document number; a document over `most` bytes is taken in overlapping stretches that share no window."""
    if len(data) <= most:
        first, last, place, h = anchors(data, ends, length)
        yield np.searchsorted(ends, first, side="right"), first, last, place, h
        return
    for k, r in enumerate(raw):
        base, own = int(ends[k]) - len(r), np.frombuffer(r, np.uint8)
        for at in range(0, max(1, len(r) - length + 1), most - length + 1):
            part = own[at : at + most]
            first, last, place, h = anchors(part, np.array([len(part)]), length)
            yield np.full(len(first), k), first + base + at, last + base + at, place + base + at, h


def place(at):
    """(first window, windows after it, anchor's distance from it) as packed in one number."""
    return at >> 16, at >> 8 & 255, at & 255


def _anchor_rows(length: int):
    def run(batches):
        for (uid,), raw, data, ends in _buffers(batches, ("_uid",), 1 << 20):
            whole = data.tobytes()
            for doc, first, last, spot, h in _pieces(raw, data, ends, length):
                base = ends[doc] - np.array([len(r) for r in raw], np.int64)[doc] if len(doc) else doc
                around = np.frombuffer(b"".join([hashlib.blake2b(whole[a : b + length] + bytes((p - a,)), digest_size=16).digest() for a, b, p in zip(first.tolist(), last.tolist(), spot.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                where = (first - base) << 16 | (last - first) << 8 | (spot - first)
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(doc)), pa.array(where), pa.array(h.view(np.int64)), pa.array(around[:, 0]), pa.array(around[:, 1])], ["uid", "at", "seed", "c1", "c2"])

    return run


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows of big-endian 64-bit words sorted, and the words each row shares with the row before it.

    Multikey quicksort with eight bytes as one key: each pass sorts only the runs still tied, by their next key.
    """
    m, depth = words.shape
    order = np.arange(m)
    common = np.zeros(m, np.int64)
    run = np.zeros(m, np.int64)  # the tied run each place belongs to
    live = np.arange(m)
    for d in range(depth):
        if not len(live):
            break
        keys = words[order[live], d]
        s = np.lexsort((keys, run[live]))
        order[live] = order[live][s]
        keys, r = keys[s], run[live]
        same = np.zeros(len(live), bool)
        same[1:] = (r[1:] == r[:-1]) & (keys[1:] == keys[:-1])
        common[live[same]] = d + 1
        run[live] = live[np.maximum.accumulate(np.where(same, 0, np.arange(len(live))))]
        tied = same.copy()
        tied[:-1] |= same[1:]
        live = live[tied]
    return order, common


def _as_words(rows: list[bytes], size: int) -> np.ndarray:
    """Byte strings, cut or filled with zeros to size, as rows of big-endian words."""
    size8 = -(-size // 8) * 8
    return np.frombuffer(b"".join([r[:size].ljust(size8, b"\0") for r in rows]), ">u8").reshape(len(rows), -1).astype(np.uint64)


def _agree(words: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes shared with the row before) of rows of bytes, in the order of a multikey quicksort."""
    order, common = multikey_quicksort(words)
    lcp = common * 8
    rows = texts[order]
    for i in range(8):  # the first differing word, byte by byte
        at = np.minimum(common * 8 + i, size - 1)
        more = (lcp == common * 8 + i) & (common * 8 + i < size)
        more[1:] &= rows[np.arange(1, len(order)), at[1:]] == rows[np.arange(len(order) - 1), at[1:]]
        lcp[more] += 1
    lcp[0] = 0
    return order, np.minimum(lcp, size)


def compare(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each surrounding and distance: whether the window's bytes also occur in another one, and whether it is the first of a class that does.

    left: the bytes before the anchor, nearest first; right: from the anchor on. low, high: how far before the anchor windows start.
    Surroundings are sorted once by what follows and once by what precedes; at each distance o, windows are equal if they lie
    in one run of the first order that agrees on length - o bytes and in one run of the second that agrees on o bytes.
    """
    m, reach = len(left), length - SEED
    r_words, l_words = _as_words(right, length), _as_words(left, reach)
    r_bytes, l_bytes = (np.frombuffer(w.astype(">u8").tobytes(), np.uint8).reshape(m, -1) for w in (r_words, l_words))
    g = group.reshape(-1, 1)
    r_order, r_lcp = _agree(np.concatenate([g, r_words], axis=1), np.concatenate([group.astype(">u8").view(np.uint8).reshape(m, 8), r_bytes], axis=1), length + 8)
    l_order, l_lcp = _agree(np.concatenate([g, l_words], axis=1), np.concatenate([group.astype(">u8").view(np.uint8).reshape(m, 8), l_bytes], axis=1), reach + 8)
    r_run, l_run = np.empty(m, np.int64), np.empty(m, np.int64)
    out, first = np.zeros((m, reach + 1), bool), np.zeros((m, reach + 1), bool)
    for o in range(int(low.min()), int(high.max()) + 1):
        on = (low <= o) & (o <= high)
        if on.sum() < 2:
            out[on, o] = first[on, o] = many[on]
            continue
        r_run[r_order] = np.cumsum(r_lcp < length - o + 8)
        l_run[l_order] = np.cumsum(l_lcp < o + 8)
        at = np.flatnonzero(on)
        key = r_run[at] * (m + 1) + l_run[at]
        _, head, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        out[at, o] = (count[back] > 1) | many[at]
        first[at[head], o] = out[at[head], o]
    return out, first


def stretches(mask: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of the runs of a mask, cut at each multiple of step."""
    column = np.arange(mask.shape[1])
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[:, 1:], after[:, :-1] = mask[:, :-1], mask[:, 1:]
    row, start = np.nonzero(mask & (~before | (column % step == 0)))
    return row, start, np.nonzero(mask & (~after | (column % step == step - 1)))[1]


#: What _compare_rows gives: bits of a surrounding's windows, or (lead is not null) windows to compare with those of other pieces.
COMPARED = pa.schema(
    [("seed", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bits", pa.binary()), ("lead", pa.binary()), ("bytes", pa.binary()), ("o", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("many", pa.bool_())]
)


def _compare_rows(length: int, step: int, most: int = PIECE):
    """Sorted buckets of suffixes, one run of equal leading tokens (or several short ones, or a piece of a long one) at a time.

    Of a lead in pieces these go on, to be compared across the pieces' boundaries: windows without an equal one in their piece, and one
    of each class of equal windows. Their new leads are longer: all that the windows of one cell of `step` distances have in common.
    """

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.unique(np.array([r[0].hex() for r in rows], "S"), return_inverse=True)[1].astype(np.uint64)
        low, high, many = (np.array([r[k] for r in rows]) for k in (7, 8, 9))
        out, first = compare(ids, [r[5][: r[6]][::-1] for r in rows], [r[5][r[6] :] for r in rows], low, high, many.astype(bool), length)
        hit = np.flatnonzero(out.any(axis=1)).tolist()
        found = [[rows[i][k] for i in hit] for k in (2, 3, 4)] + [[np.packbits(out[i]).tobytes() for i in hit]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*found, *[[None] * len(hit)] * 6], COMPARED.types, strict=True)], schema=COMPARED)
        cut = np.array([r[10] for r in rows], bool)
        if not step or not cut.any():
            return
        distance = np.arange(length - SEED + 1)
        alone = (low[:, None] <= distance) & (distance <= high[:, None]) & ~out & cut[:, None]
        for mask, known in ((alone, False), (first & cut[:, None], True)):
            for i, a, b in zip(*(x.tolist() for x in stretches(mask, step)), strict=True):
                held.append(_onward(rows[i], a, b, known, length, step))
                if len(held) >= 4096:
                    yield onward()
        if held:
            yield onward()

    held: list[tuple] = []

    def onward() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, COMPARED.types, strict=True)], schema=COMPARED)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lead", "piece", "seed", "c1", "c2", "bytes", "o", "low", "high", "many", "cut")), strict=True):
                if len(rows) >= most and row[:2] != rows[-1][:2]:
                    yield from flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from flush(rows)

    return run


def _onward(row: tuple, low: int, high: int, known: bool, length: int, step: int) -> tuple:
    """A row for the windows that start low to high before the anchor, with the lead of their cell and no other bytes."""
    _, _, seed, c1, c2, data, o = row[:7]
    near = low - low % step
    far = min(near + step - 1, length - SEED)
    lead = bytes((near,)) + data[o : o + length - far] + data[o - near : o][::-1]
    return seed, c1, c2, None, lead, data[o - high : o + length - low], high, low, high, known


def _fetch(length: int):
    """From texts with the places of surroundings to compare: the bytes of each."""

    def run(batches):
        for b in batches:
            wants = b.column("wants").to_pylist()
            out: list[tuple] = []
            for i, text in enumerate(b.column("_text")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for x in wants[i]:
                    a, w, o = place(x["at"])
                    out.append((x["seed"], x["c1"], x["c2"], raw[a : a + w + length], o, w, x["many"], x["pieces"]))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["seed", "c1", "c2", "bytes", "o", "w", "many", "pieces"])

    return run


def removed(texts: list[bytes], owner: np.ndarray, at: np.ndarray, bits: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(removed bytes of all texts, each followed by a place of its own; where each text starts), for packed spans `at` of the texts `owner`.

    Without bits all windows of a span go, else those whose bits are set.
    """
    start = np.cumsum([0] + [len(t) + 1 for t in texts])
    mark = np.zeros(start[-1] + 1, np.int32)
    first, windows, far = place(at)
    first = first + start[owner]
    whole = bits.is_null().to_numpy(zero_copy_only=False)
    np.add.at(mark, first[whole], 1)
    np.add.at(mark, (first + windows)[whole] + length, -1)
    some = np.flatnonzero(~whole)
    if len(some):
        packed = np.frombuffer(b"".join(bits.drop_null().to_pylist()), np.uint8).reshape(len(some), -1)
        row, o = np.nonzero(np.unpackbits(packed, axis=1)[:, : length - SEED + 1])
        begin = (first + far)[some][row] - o
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + length, -1)
    return np.cumsum(mark, dtype=np.int32)[:-1] > 0, start


def _remove(length: int, texts: bool, limit: int = 1 << 22):
    def run(batches):
        for (ids, spans), raw, _, _ in _buffers(batches, ("_id", "spans"), limit):
            flat, count = spans.flatten(), np.asarray(pc.fill_null(pc.list_value_length(spans), 0))
            gone, start = removed(raw, np.repeat(np.arange(len(raw)), count), np.asarray(flat.field("at")), flat.field("bits"), length)
            starts = np.diff(gone.astype(np.int8), prepend=0) == 1
            n_bytes, n_removed, n_spans, digest, kept_text = [], [], [], [], []
            for r, i in zip(raw, start.tolist(), strict=False):
                cut = gone[i : i + len(r)]
                n_bytes.append(len(r))
                n_removed.append(int(np.count_nonzero(cut)))
                n_spans.append(int(np.count_nonzero(starts[i : i + len(r)])))
                rest = np.frombuffer(r, np.uint8)[~cut].tobytes() if n_removed[-1] else r
                digest.append(hashlib.sha256(rest).hexdigest())
                kept_text.append(rest.decode("utf-8", "replace") if texts else None)
            cols = [ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            cols += [pa.array(kept_text, pa.string())] if texts else []
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(cols)])

    return run


def _compared(buckets: DataFrame, length: int, piece: int) -> DataFrame:
    """(seed, c1, c2, bits) of surroundings in buckets by lead; `pieces` says into how many pieces their lead is cut.

    Each round sorts and compares within pieces, then across: what goes on is grouped by longer leads, and cut again where these are still
    frequent. The last round's leads are whole windows, of which each piece of the round before sends one.
    """
    fixed = "seed long, c1 long, c2 long, bits binary, lead binary, bytes binary, o int, low int, high int, many boolean"
    parts = []
    for step in (*CELLS, 0):
        cut = buckets.withColumn("piece", F.pmod(F.xxhash64("seed", "c1", "c2"), F.col("pieces")).cast("int")).withColumn("cut", F.col("pieces") > 1)
        cut = cut.repartitionByRange("lead", "piece").sortWithinPartitions("lead", "piece")
        cut = cut.select("lead", "piece", "seed", "c1", "c2", "bytes", "o", "low", "high", "many", "cut")
        done = materialize(cut.mapInArrow(tidy(_compare_rows(length, step, piece)), fixed), "compared")
        parts.append(done.where("lead IS NULL").select("seed", "c1", "c2", "bits"))
        rest = done.where("lead IS NOT NULL").drop("bits")
        if not step or rest.isEmpty():
            break
        pieces = F.lit(1)
        if step > 1:  # leads that are still frequent: at most a row in `piece`, so Spark may find them few enough to broadcast
            often = rest.groupBy(F.xxhash64("lead").alias("h")).agg(F.ceil(F.count("*") / piece).cast("int").alias("often")).where("often > 1")
            rest = rest.join(often, F.xxhash64("lead") == F.col("h"), "left")
            pieces = F.coalesce("often", pieces)
        buckets = rest.withColumn("pieces", pieces)
    return reduce(DataFrame.union, parts)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, texts: bool = True, piece: int = PIECE) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts anywhere else, in the same or another text.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256[, kept_text: the remaining bytes, with
    replacement characters where a cut parts a character]. Null texts are empty. Rows are told apart by id and text together; fully
    repeated rows repeat each other, so their texts of at least `length` bytes are removed. Empty tables give an empty result.

    1. Anchors of every text, with the hash of SEED bytes and a 128-bit hash of the surroundings (all windows of the anchor).
    2. By SEED hash (partial aggregation): seeds that occur once are done. Where all surroundings of a seed are equal, all their
       windows repeat. Only anchors of other repeated seeds go on, one for each different surroundings.
    3. Their bytes are fetched, range-partitioned by leading tokens (sampled splitters between different values), sorted in each bucket
       by multikey quicksort, and compared. Windows starting up to half of `length` before the anchor share at least half of it after
       the anchor, the others share half of it before; so each goes to the bucket of that half, and a frequent short string is split by
       its longer surroundings. A lead of a seed with more than `piece` anchors is cut into pieces, which splitters may part; windows
       without an equal in their piece, and one of each class of equal ones, are compared across the pieces by longer leads.
    4. Results return to the documents as spans.
    """
    if not SEED < length < 256:
        raise ValueError("length must be over SEED and under 256")
    kind = dict(df.dtypes)[id_col]
    key = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.length(F.coalesce(F.col(text_col), F.lit(""))), F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))), 256), 1, 24))  # 96 bits
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(key, F.lit(b"")).alias("_uid"))
    found = materialize(rows.select("_uid", "_text").mapInArrow(tidy(_anchor_rows(length)), "uid binary, at long, seed long, c1 long, c2 long"), "anchors")

    seeds = found.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("c1", "c2")).alias("lo"), F.max(F.struct("c1", "c2")).alias("hi")).where("n > 1")
    # a table of its own: both sides of the join are then plain exchanges, and a seed with very many anchors is split among tasks
    # a seed's anchors bound the rows of each of its leads, so they say into how many pieces a lead must be cut
    seeds = materialize(seeds.select("seed", (F.col("lo") != F.col("hi")).alias("mixed"), F.ceil(F.col("n") / piece).cast("int").alias("pieces")), "seeds")
    hits = materialize(found.join(seeds, "seed"), "hits")
    one = hits.where("mixed").groupBy("seed", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("one"), F.max("pieces").alias("pieces"))
    wants = one.select(F.col("one.uid").alias("uid"), F.struct("seed", "c1", "c2", F.col("one.at").alias("at"), (F.col("n") > 1).alias("many"), "pieces").alias("want"))
    wants = wants.groupBy("uid").agg(F.collect_list("want").alias("wants"))
    # the same columns by the same key as in the last join below, so the texts are exchanged once for both
    bytes_ = rows.join(wants, F.col("_uid") == F.col("uid")).select("_id", "_text", "wants").mapInArrow(tidy(_fetch(length)), "seed long, c1 long, c2 long, bytes binary, o int, w int, many boolean, pieces int")
    half = length // 2
    after = F.expr(f"substring(bytes, o + 1, {half})")
    before = F.reverse(F.hex(F.expr(f"substring(bytes, greatest(1, o - {half} + 1), least(o, {half}))")))
    low, high = F.col("o") - F.col("w"), F.col("o")
    near = F.struct(F.concat(F.lit(b"a"), after).alias("lead"), F.greatest(low, F.lit(0)).alias("low"), F.least(high, F.lit(half)).alias("high"))
    far = F.struct(F.concat(F.lit(b"b"), F.encode(before, "UTF-8"), F.expr(f"substring(bytes, o + 1, {SEED})")).alias("lead"), F.greatest(low, F.lit(half + 1)).alias("low"), high.alias("high"))
    both = bytes_.select("seed", "c1", "c2", "bytes", "o", "many", "pieces", F.explode(F.filter(F.array(near, far), lambda x: x["low"] <= x["high"])).alias("x"))
    bits = _compared(both.select("seed", "c1", "c2", "bytes", "o", "many", "pieces", "x.*"), length, piece)

    settled = hits.where("NOT mixed").select("uid", "at", F.lit(None).cast("binary").alias("bits"))
    compared = hits.where("mixed").join(bits, ["seed", "c1", "c2"]).select("uid", "at", "bits")
    spans = settled.union(compared).groupBy("uid").agg(F.collect_list(F.struct("at", "bits")).alias("spans"))
    final = rows.join(spans, F.col("_uid") == F.col("uid"), "left").select("_id", "_text", "spans")
    return final.mapInArrow(tidy(_remove(length, texts)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else ""))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 200-byte repeats cover."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, coalesce(max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= i, false) AS joined FROM r),
t AS (SELECT doc_id, i, sum(CAST(NOT joined AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM t GROUP BY 1, 2),
o AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT d.doc_id, coalesce(max(b), 0), max(n) FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY 1),
k AS (SELECT o.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS kept, sum(y - x) AS left_over FROM o JOIN d ON o.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, (n - left_over)::BIGINT AS n_removed, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON d.doc_id = k.doc_id
"""
