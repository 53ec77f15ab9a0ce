"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrule.llm import bpe, common, decontamination, exact_dedup, html_extract, language_id, near_dedup, registry, secrets, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, _text string, _id long, n int, uid binary, kept boolean"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "x", 7, 3, b"u", True) for i, t in rows], SCHEMA)


def words(n, seed=1, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "   "), (4, "a"), (5, "a"), (6, "Hello wörld"), (7, "Hello  wörld"), (8, words(30_000)), (9, words(200, 5)), (9, words(200, 5)), (10, words(200, 5) + " tail"), (None, words(50, 6)), (11, "ÀÉÎ ñ 中文 😀")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- exact copies -------------------------------------------------------------------------------------------------------


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_classes(spark):
    got = exact_dedup.annotate(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    groups = collections.defaultdict(list)
    for i, t in EDGE:
        groups[norm(t)].append(i)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == (min(ids) if ids else None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_dedup_keeps_columns(spark):
    df = frame(spark, EDGE)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 4, 6, 8, 9, 9, 10, 11]


def test_grace_spills_and_recurses():
    r = random.Random(2)
    rows = [(int.from_bytes(hashlib.sha256(str(k).encode()).digest()[:8], "big"), b"d%d" % k, f"content {k} " * 50, i, 1) for i, k in enumerate(r.randrange(300) for _ in range(3000))]
    got = {e[2]: (e[3], e[4]) for e in exact_dedup.grace(rows, budget=20_000)}
    want = collections.defaultdict(lambda: [10**9, 0])
    for _, _, t, i, n in rows:
        want[t] = [min(want[t][0], i), want[t][1] + n]
    assert got == {t: tuple(v) for t, v in want.items()}


def test_grace_ends_on_equal_hashes():
    rows = [(5, b"x", f"different {i}" * 20, i, 1) for i in range(60)]
    assert len(list(exact_dedup.grace(rows, budget=500))) == 60


# ---- repeats ------------------------------------------------------------------------------------------------------------


def repeats(docs, size=200):
    seen = collections.Counter()
    for _, t in docs:
        raw = (t or "").encode()
        seen.update(raw[i : i + size] for i in range(len(raw) - size + 1))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        mark = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if seen[raw[k : k + size]] > 1:
                mark[k : k + size] = True
        runs = int((np.diff(mark.astype(int), prepend=0) == 1).sum())
        out.append((i, len(raw), int(mark.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~mark].tobytes()).hexdigest()))
    return sorted(out, key=str)


def suffix_docs():
    r = random.Random(4)
    shared = [words(60, s, 5000) for s in range(4)]
    docs = [(i, " ".join(r.choice(shared)[r.randrange(60) :][: r.randrange(150, 330)] if r.random() < 0.5 else words(30, r.random(), 5000) for _ in range(6))) for i in range(60)]
    one = "z" * 199
    return docs + [(100, "ab" * 700), (101, "é" * 300), (102, one), (103, one), (104, one + "q" + one), (105, "x" + one + "y"), (106, one + "y"), (107, None), (108, ""), (109, words(900, 9)), (109, words(900, 9)), (None, words(70, 10))]


@pytest.mark.parametrize("piece", [suffix_dedup.PIECE, 8, 2])
def test_repeats_match_brute_force(spark, piece):
    docs = suffix_docs()
    got = suffix_dedup.remove_repeats(frame(spark, docs), texts=False, piece=piece)
    assert sorted(map(tuple, got.collect()), key=str) == repeats(docs)


@pytest.mark.parametrize("piece", [40, 6])
def test_frequent_leads_are_compared_across_pieces(spark, piece):
    """Passages over and under 200 bytes, in contexts of their own or shared by two documents far apart."""
    r = random.Random(12)
    over, under = words(45, 21, 5000)[:260], words(45, 22, 5000)[:185]
    docs = []
    for i in range(240):
        before, after = words(9, f"b{i % 170}", 5000), words(9, f"a{i if r.random() < 0.6 else i % 170}", 5000)
        docs.append((i, f"{before} {r.choice([over, over, under])} {after}"))
    got = suffix_dedup.remove_repeats(frame(spark, docs), texts=False, piece=piece)
    assert sorted(map(tuple, got.collect()), key=str) == repeats(docs)


def test_stretches():
    mask = np.random.default_rng(5).random((40, 60)) < 0.6
    for step in (1, 5, 25):
        got = [(i, j) for i, a, b in zip(*suffix_dedup.stretches(mask, step), strict=True) for j in range(a, b + 1)]
        assert got == list(zip(*np.nonzero(mask), strict=True))
        assert all(a // step == b // step for _, a, b in zip(*suffix_dedup.stretches(mask, step), strict=True))


def test_repeats_texts(spark):
    a = words(100, 3)
    got = by_id(suffix_dedup.remove_repeats(frame(spark, [(1, f"one {a}"), (2, f"two {a}")])))
    assert got[1]["kept_text"] == "one" and got[2]["kept_text"] == "two"  # the space before the passage repeats as well


def test_long_documents_are_cut_into_stretches():
    data = np.frombuffer(words(4000, 8).encode(), np.uint8)
    whole = list(suffix_dedup._pieces([data.tobytes()], data, np.array([len(data)]), 200))
    parts = list(suffix_dedup._pieces([data.tobytes()], data, np.array([len(data)]), 200, most=1000))
    covered = lambda xs: sorted(w for _, a, b, _, _ in xs for i, j in zip(a, b) for w in range(i, j + 1))  # noqa: B905
    assert covered(whole) == covered(parts) == list(range(len(data) - 199))


def test_multikey_quicksort():
    r = np.random.default_rng(0)
    x = r.integers(0, 3, (500, 6)).astype(np.uint64)
    order, common = suffix_dedup.multikey_quicksort(x)
    rows = [tuple(v) for v in x[order].tolist()]
    assert rows == sorted(rows)
    same = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
    assert common.tolist()[1:] == [same(a, b) for a, b in zip(rows, rows[1:], strict=False)]


# ---- BPE ----------------------------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    r = random.Random(3)
    alphabet = "aAbB'sSt  \n\t\x1c\x85\xa0éÉßςΣİ0١½_-<|>中文한😀ſǅ́‍\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(400)] + ["<|endoftext|> a<|startoftext|>", "don't we'll", words(2000), "x" * 3000]
    docs = list(enumerate(texts)) + EDGE[:3]
    for row in bpe.encode(frame(spark, docs), bpe.default_tokenizer()).collect():
        want = t.encode(next(x for i, x in docs if i == row["doc_id"] and (x or "") is not None and hashlib.sha256(" ".join(map(str, t.encode(x or "", add_special_tokens=False).ids)).encode()).hexdigest() == row["ids_sha256"]) or "", add_special_tokens=False)
        assert row["ids"] == want.ids and row["n_tokens"] == len(want.ids)
        assert row["decoded"] == t.decode(want.ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(row["decoded"].encode()).hexdigest()


def test_merges_equal_library():
    import json

    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    tok, spec = Tokenizer.from_file(path), json.loads(open(path, encoding="utf-8").read())
    r, symbols = random.Random(7), bpe.byte_symbols()
    words_ = [bytes(r.choice(b"abcdeinorst") for _ in range(r.randrange(1, 90))) for _ in range(500)]
    words_ += [bytes(r.randrange(256) for _ in range(r.randrange(1, 60))) for _ in range(300)] + [b"a" * n for n in range(1, 70)] + [b"ab" * 4000, b""]
    want = [[t.id for t in tok.model.tokenize("".join(symbols[b] for b in w))] for w in words_]
    for short in (0, 48, 10_000):
        some = len(words_) if short < 10_000 else -2  # a word of 8,000 bytes by arrays takes as many rounds
        assert bpe.Merges(spec["model"]["vocab"], spec["model"]["merges"], symbols, short)(words_[:some]) == want[:some]


def test_codec_caches_are_bounded(tmp_path):
    path = bpe.default_tokenizer()
    lexicon = bpe.compile_lexicon(path, str(tmp_path))
    small, large = bpe.Codec(path, lexicon, cache=50, longest=8), bpe.Codec(path, lexicon)
    texts = [words(60, i, 3000) + " " + "unspaced" * i for i in range(40)]
    for i in range(0, 40, 4):
        assert list(small.both(texts[i : i + 4])) == list(large.both(texts[i : i + 4]))
        assert max(map(len, (small.known, small.parts))) < 50 + 4 * 62
    assert all(len(x) <= 8 for x in [*small.known, *small.parts])


def test_workers_collect_garbage_after_encoding(spark):
    df = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert bpe.encode(df, bpe.default_tokenizer()).count() == 8 and bpe.encode(df, bpe.default_tokenizer()).limit(1).count() == 1

    def enabled(batches):
        import gc

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * len(b))], ["on"])

    assert all(x["on"] for x in df.mapInArrow(enabled, "on boolean").collect())


def test_long_unspaced_text(spark):
    from tokenizers import Tokenizer

    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(400_000))
    got = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), bpe.default_tokenizer()).first()
    assert got["ids"] == Tokenizer.from_file(bpe.default_tokenizer()).encode(text, add_special_tokens=False).ids


def test_automaton_numbers_its_words(tmp_path):
    r = random.Random(1)
    table = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 7))): i for i in range(300)}
    bpe.Automaton.write(table, str(tmp_path / "a.bin"))
    a = bpe.Automaton(str(tmp_path / "a.bin"))
    assert all(a(w) == i for w, i in table.items())
    assert a(b"") == a(b"abcabcabc") == a(b"zz") == -1
    assert len(a.final) < sum(map(len, table))  # suffixes are shared


# ---- languages ----------------------------------------------------------------------------------------------------------


def test_language(spark):
    r = random.Random(2)
    vocab = {"aa": ["tahu", "mika", "lote"], "bb": ["strch", "brzk", "vlkn"]}
    rows = [(i, " ".join(r.choice(vocab[g]) for _ in range(20)), g) for i in range(40) for g in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(rows + [(90, "123 !!", "aa"), (91, None, "bb"), (92, "mika lote", None), (93, "", "aa")], "doc_id long, text string, lang string")
    p = language_id.learn(df)
    assert p.langs == ("aa", "bb")
    got = by_id(language_id.predict(df, p))
    assert all(got[i]["lang_pred"] == g and got[i]["score"] > 0.5 for i, _, g in rows)
    assert [got[i]["lang_pred"] for i in (90, 91, 92, 93)] == ["und", "und", "aa", "und"]
    assert language_id.keep_identified(df, p).count() == 41
    odd = spark.createDataFrame([(1, "βγδ ζηθ κλμ " * 30), (2, "tahu mika lote"), (2, "tahu mika lote"), (None, "strch vlkn brzk"), (3, None), (4, "..."), (5, "")], "doc_id long, text string")
    assert sorted(str(x["doc_id"]) for x in language_id.keep_identified(odd, p).collect()) == ["2", "2", "None"]  # what resembles no language goes
    assert language_id.keep_identified(odd.where("false"), p).count() == 0
    none = language_id.learn(df.where("false"))
    assert {x["lang_pred"] for x in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.predict(frame(spark, EDGE), p).count() == len(EDGE)


def test_language_equals_brute_force(spark):
    r = random.Random(3)
    vocab = {"aa": ["tahu", "mika", "lote", "été"], "bb": ["strch", "brzk", "vlkn", "été"], "cc": ["oma", "ila", "uru", "lote"]}
    rows = [(i, " ".join(r.choice(vocab[g]) for _ in range(r.randrange(1, 15))) + "! 7", g) for i in range(45) for g in ["abc"[i % 3] * 2]]
    df = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string, lang string")
    dim, seed = 256, 11
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (language_id.CLASSES, dim))
    classes = language_id.letter_classes()

    def bundle(text):
        symbols = [0]
        for c in text.lower():
            k = int(classes[ord(c)])
            if k or symbols[-1]:
                symbols.append(k)
        symbols += [0]
        grams = collections.Counter(zip(symbols, symbols[1:], symbols[2:], strict=False))
        return grams, sum(n * np.roll(letters[a], 2).astype(float) * np.roll(letters[b], 1) * letters[c] for (a, b, c), n in grams.items())

    protos = collections.defaultdict(lambda: np.zeros(dim))
    for _, text, lang in [*rows, *rows[:5]]:
        grams, vector = bundle(text)
        protos[lang] += vector / sum(n * n for n in grams.values()) ** 0.5
    names = sorted(protos)
    got = {x["doc_id"]: x for x in language_id.predict(df, language_id.learn(df, dim=dim, seed=seed)).collect()}
    for i, text, _ in rows:
        v = bundle(text)[1]
        cosine = np.array([v @ protos[g] / np.linalg.norm(v) / np.linalg.norm(protos[g]) for g in names])
        odds = np.exp(20 * (cosine - cosine.max()))
        assert got[i]["lang_pred"] == names[int(cosine.argmax())] and abs(got[i]["score"] - 1 / odds.sum()) < 1e-3


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.98


# ---- shards -------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    docs = [(i, words(i % 7, i)) for i in range(2000)] + EDGE
    eight = sharding.topology(8)
    rows = sharding.assign(frame(spark, docs), eight, grown=sharding.topology(9, 8)).collect()
    assert len(rows) == len(docs)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert 100 < sum(r["grown_shard"] == 8 for r in rows) < 350
    sizes = collections.Counter(r["shard"] for r in rows)
    assert min(sizes.values()) > 190 and max(sizes.values()) < 320
    texts = collections.defaultdict(set)
    for i, t in docs:
        texts[i].add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    assert all((r["size"], r["text_crc32"]) in texts[r["doc_id"]] for r in rows)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(1500)
    steps = [(sharding.topology(n, n0), sharding.topology(n + 1, n0), n) for n in range(1, 17) for n0 in ({n} if n != 9 else {8, 9})]
    cols = [F.struct(sharding.shard_of(F.col("id"), old).alias("a"), sharding.shard_of(F.col("id"), new).alias("b")).alias(f"c{k}") for k, (old, new, _) in enumerate(steps)]
    rows = df.select(*cols).collect()
    for k, (_, _, n) in enumerate(steps):
        moved = [x[k]["b"] for x in rows if x[k]["a"] != x[k]["b"]]
        assert set(moved) == {n} and 0.5 * 1500 / (n + 1) < len(moved) < 1.7 * 1500 / (n + 1)


def test_weights_confine_movement(spark):
    df = frame(spark, [(i, "") for i in range(3000)])
    before = sharding.topology(8)
    heavier = tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in before)
    rows = sharding.assign(df, before, grown=heavier).collect()
    moved = [(r["shard"], r["grown_shard"]) for r in rows if r["shard"] != r["grown_shard"]]
    region = lambda s: before[s].region
    assert moved and all(region(b) == region(5) for _, b in moved)
    with pytest.raises(ValueError, match="weight"):
        sharding.assign(df, (sharding.Leaf("a", "b", 0, 0.0),))


# ---- near copies --------------------------------------------------------------------------------------------------------


def tokens(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def near(docs, width):
    sets, parent = {}, {}
    for k, (i, t) in enumerate(docs):
        w = tokens(t)
        sets[k] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        parent[k] = k

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in sets:
        groups[root(k)].append(docs[k][0])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((docs[k][0], len(sets[k]), docs[k][0] if not sets[k] else least(groups[root(k)])) for k in sets), key=str)


def near_docs():
    r, docs = random.Random(6), []
    for g in range(6):
        base = words(120, g, 3000).split()
        for _ in range(12):
            w = base[:]
            for _ in range(r.randrange(8)):
                w[r.randrange(len(w))] = f"edit{r.randrange(9999)}"
            docs.append((len(docs) * 3 % 101, " ".join(w)))
    return docs + [(200, "one"), (201, "ONE"), (202, "one two"), (203, "two one"), *[(300 + i, t) for i, (_, t) in enumerate(EDGE[:11])], (None, words(40, 77))]


@pytest.mark.parametrize(("width", "block"), [(2, 1 << 20), (5, 1 << 20), (2, 500)])
def test_near_duplicates(spark, width, block):
    docs = near_docs()
    got = near_dedup.near_duplicates(frame(spark, docs), width=width, block=block).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near(docs, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_keeps_columns(spark):
    docs = [(1, words(80, 1)), (2, words(80, 1) + " more"), (3, words(80, 2)), (4, None)]
    df = frame(spark, docs)
    out = near_dedup.near_dedup(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_forest_links_do_not_depend_on_batches_or_tasks(spark):
    r = np.random.default_rng(4)
    sig = r.integers(0, 2, (300, near_dedup.TREES * near_dedup.DEPTH)).astype(">u2")
    rows = [(i.to_bytes(16, "big"), s.tobytes()) for i, s in enumerate(sig)]
    want = set()
    for t in range(near_dedup.TREES):
        order = sorted((s[12 * t : 12 * t + 12], n) for n, s in rows)
        shared = [-1] + [next((k for k in range(6) if x[0][2 * k : 2 * k + 2] != y[0][2 * k : 2 * k + 2]), 6) for x, y in zip(order, order[1:], strict=False)] + [-1]
        for i in range(1, len(order)):
            if shared[i] >= 5 or shared[i] == 4 and (max(shared[i - 1], shared[i + 1]) <= 4 or max(shared[i - 1], shared[i]) == 4 or max(shared[i], shared[i + 1]) == 4):
                want.add((order[i - 1][1], order[i][1]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        one = near_dedup.forest_links(spark.createDataFrame(rows, "node binary, sig binary").coalesce(1))
        got = {(bytes(x["a"]), bytes(x["b"])) for x in one.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got >= want and len(got - want) <= 32  # the seams of tasks may link a pair at depth four more


@pytest.mark.parametrize("most_local", [0, 1000])
def test_components_do_not_depend_on_where_they_end(spark, most_local):
    r = random.Random(9)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(300)]
    parent = list(range(400))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in pairs:
        parent[max(root(x), root(y))] = min(root(x), root(y))
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), most_local=most_local).collect()}
    assert got == {k: root(k) for x, y in pairs if x != y for k in (x, y)}


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(900, 901)], "a long, b long"))
    got = {r["node"]: r["component"] for r in common.components(edges, most_local=50).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}


# ---- secrets ------------------------------------------------------------------------------------------------------------


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return found


def test_base_spans(spark, tmp_path):
    r = random.Random(1)
    parts = ["token", "SECRET ", "api_key", "passwd", "=", ":", " ", '"', "'", "9f", "abcdef", "AKIA", "ABCD1234EFGH5678", "é", "😀", "\n", "==", "x" * 5, "0123456789abcdef" * 2, "ſecret"]
    docs = [(100 + i, "".join(r.choice(parts) for _ in range(r.randrange(14)))) for i in range(600)] + [x for x in EDGE if x[0] not in (None, 9)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(secrets.op7_secret_scan(spark, str(tmp_path)))
    for i, t in docs:
        want = base_spans(t)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3))
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(want)).encode()).hexdigest()
        assert all(f"{k}:{a}:{e}" in got[i]["spans"].split(",") for a, _, e, k in want)


NAMES = "user account get set data service manager controller factory default config request response handler message queue parse file path image index value create update delete select string buffer stream network server client session cache record table column version release build test module package import export process thread engine render widget window button layout color background border position".split()


def ordinary_token(r, kind):
    """A CamelCase name, a path or a name with underscores, with a number at its end."""
    while True:
        some = r.sample(NAMES, r.randrange(3, 8))
        out = {"camel": "".join(w.capitalize() for w in some), "path": "/".join(some) + "/v", "snake": "_".join(some) + "_"}[kind] + str(r.randrange(1, 300))
        if 20 <= len(out) <= 64:
            return out


def random_token(r, alphabet):
    while True:
        out = "".join(r.choice(alphabet) for _ in range(r.randrange(20, 65)))
        if re.search("[0-9]", out) and re.search("[A-Za-z]", out):
            return out


def sum_of_tests(t):
    """The battery in plain Python."""
    c = t.replace("-", "+").replace("_", "/")
    kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t) else "base32" if re.fullmatch("[A-Z2-7]+", t) else "base64"
    alphabet, c = secrets.ALPHABETS[kind], c.lower() if kind == "hex" else c
    n, k, v = len(c), len(alphabet), [alphabet.index(x) for x in c]
    chi = sum((m - n / k) ** 2 / (n / k) for m in [c.count(x) for x in alphabet])
    group = lambda x: "U" if x.isupper() else "L" if x.islower() else "D" if x.isdigit() else "S"
    share = collections.Counter(map(group, alphabet))
    change = 1 - sum((m / k) ** 2 for m in share.values())
    runs = sum(group(x) != group(y) for x, y in zip(c, c[1:], strict=False))
    m = sum(v) / n
    serial = sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / max(sum((x - m) ** 2 for x in v), 1e-9)
    z = ((chi - (k - 1)) / (2 * (k - 1) * (n - 1) / n) ** 0.5, (runs - (n - 1) * change) / ((n - 1) * change * (1 - change)) ** 0.5, (serial + 1 / n) * n**0.5)
    return secrets.ENCODINGS.index(kind), z[0] - z[1] + max(z[2], 0)


def test_random_tokens_are_found_and_names_are_not(spark):
    r = random.Random(5)
    keys = [random_token(r, secrets.ALPHABETS[k]) for k in ("base64", "base32", "hex") for _ in range(100)]
    keys = [k.upper() if re.fullmatch("[0-9a-f]+", k) else k for k in keys]  # small hex keys are base spans
    plain = [ordinary_token(r, ("camel", "path", "snake")[i % 3]) for i in range(600)]
    letters = [re.sub("[0-9]", "", ordinary_token(r, ("camel", "path", "snake")[i % 3])) for i in range(300)]
    tokens_ = [*keys, *plain, *letters]
    got = secrets.scan(frame(spark, [(i, f"see {t} there") for i, t in enumerate(tokens_)] + EDGE[:3])).collect()
    found = {r["doc_id"] for r in got if r["random"] and r["doc_id"] < len(tokens_)}
    assert sum(i < 300 for i in found) >= 270
    assert sum(i >= 300 for i in found) <= 0.05 * len(found)
    # against plain Python: the sums, the null, the p-values and the rejected
    import statistics

    tests = [(i, t, *sum_of_tests(t)) for i, t in enumerate(tokens_) if len(t) >= 20]
    sums = spark.createDataFrame([(i, t) for i, t, _, _ in tests], "i long, t string").select("i", secrets.battery(F.col("t")).alias("x")).collect()
    assert all(x["x"]["kind"] == k and abs(x["x"]["stat"] - s) < 1e-6 for x, (_, _, k, s) in zip(sorted(sums, key=lambda x: x["i"]), tests, strict=True))
    band = lambda t: sum(len(t) >= b for b in secrets.BANDS) - 1
    want = set()
    pv = {}
    for i, t, k, s in tests:
        own = [y for _, u, j, y in tests if j == k and band(u) == band(t) and not re.search("[0-9]", u)]
        mean, sd = secrets.PRIOR[band(t)]
        n = len(own) + secrets.PRIOR_TOKENS
        mu = (sum(own) + secrets.PRIOR_TOKENS * mean) / n
        var = (sum(y * y for y in own) + secrets.PRIOR_TOKENS * (mean**2 + sd**2)) / n - mu**2
        if re.search("[0-9]", t) and re.search("[A-Za-z]", t):
            pv[i] = statistics.NormalDist(mu, max(var, 0.25) ** 0.5).cdf(s)
    for b in range(3):
        own = sorted((p, i) for i, p in pv.items() if band(tokens_[i]) == b)
        last = max((k for k, (p, _) in enumerate(own) if p <= 0.05 * (k + 1) / len(own)), default=-1)
        want |= {i for _, i in own[: last + 1]}
    assert len(want ^ found) <= 0.01 * len(want)  # p-values count in hundredths of their logarithm there


# ---- benchmark items ----------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    items = spark.createDataFrame([(1, words(40, 21, 5000), "e"), (2, words(30, 22, 5000), "e"), (3, None, "e"), (4, "too short", "e"), (5, "", "e")], "item_id long, text string, _text string")
    w = words(40, 21, 5000).split()
    edited = [x if k % 6 else "changed" for k, x in enumerate(w)]
    docs = [(10, f"intro {words(300, 31)} {' '.join(w)} end"), (11, words(100, 32) + " " + " ".join(edited)), (12, words(500, 33)), (13, " ".join(w[:8])), (14, ", ".join(x.upper() for x in w)), *EDGE]
    got = decontamination.contaminated(frame(spark, docs), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(10, 1), (11, 1), (14, 1)]
    assert next(r for r in got if r["doc_id"] == 10)["score"] == 1.0
    df = frame(spark, docs)
    kept = decontamination.decontaminate(df, items, most_words=10)
    assert kept.columns == df.columns and kept.count() == len(docs) - 3
    assert decontamination.contaminated(df, items.where("false")).count() == 0 and decontamination.contaminated(df.where("false"), items).count() == 0


def test_op8_equals_aligning_all_pairs(spark, tmp_path):
    r = random.Random(31)
    items = [(100 + i, words(r.randrange(16, 60), 3000 + i, 4000)) for i in range(24)] + [(900, None), (901, "")]
    docs, planted = [], 0
    for k in range(60):
        text = words(r.randrange(30, 200), 4000 + k, 4000).split()
        if k % 2:
            _, item = items[k % 24]
            edited = [w for w in item.split() for w in ([w] if r.random() > 0.1 + 0.2 * (k % 4 == 3) else r.choice([[], ["new"], [w, "more"]]))]
            text[20:20] = edited
            planted += 1
        docs.append((k, " ".join(text)))
    docs += [(500, None), (501, "")]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.op8_decontamination(spark, str(tmp_path)).collect()}
    hashed = lambda t: near_dedup.word_hashes([decontamination.spaced(t)], decontamination._GAPS)[1]
    want = {}
    for d, t in docs:
        for i, u in items:
            if t and u and (score := decontamination.align(hashed(u), hashed(t))[0] / (2 * len(hashed(u)))) >= 0.5:
                want[d, i] = score
    assert got == want
    found = [(k, items[k % 24][0]) in got for k in range(1, 60, 2)]
    assert planted == 30 and all(found[::2]) and sum(found[1::2]) >= 14  # of those edited at every third word one scores 0.489


def test_templated_and_edited_items_are_found(spark):
    stem = "which of the following numbers is the value of this expression given as"
    rows = [(i, f"{stem} x{i}") for i in range(300)] + [(900, words(11, 71, 5000))]
    items = spark.createDataFrame(rows, "item_id long, text string")
    third = " ".join("other" if k % 3 == 2 else x for k, x in enumerate(rows[-1][1].split()))
    docs = [(1, f"{words(60, 72)} {rows[7][1]} {words(60, 73)}"), (2, f"{words(60, 74)} {third} {words(60, 75)}"), (3, words(200, 76))]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(frame(spark, docs), items).collect()}
    assert got[1, 7] == 1.0 and round(got[2, 900], 2) == 0.59 and not any(d == 3 for d, _ in got)
    assert [r["doc_id"] for r in decontamination.decontaminate(frame(spark, docs), items).collect()] == [3]


def test_seeds_miss_no_alignment():
    r, scores = random.Random(12), []
    items = [(i, words(r.randrange(5, 40), 100 + i, 60)) for i in range(40)]
    x = decontamination.index(items, 5)
    for k in range(300):
        out = words(40, 900 + k, 60).split()
        for w in r.choice(items)[1].split():
            u, rate = r.random(), 0.05 * (k % 10)
            out += [] if u < rate / 3 else ["new"] if u < rate * 2 / 3 else [w, "more"] if u < rate or k % 10 == 9 else [w]
        text = near_dedup.word_hashes([" ".join(out + words(40, 5900 + k, 60).split())], decontamination._GAPS)[1]
        own = [x.words[a:b] for a, b in zip(x.at, x.at[1:], strict=False)]
        want = {i: decontamination.align(w, text)[0] / (2 * len(w)) for i, w in enumerate(own)}
        scores += want.values()
        assert {f[0]: f[1] for f in decontamination.matches(x, text, 0.5)} == {i: s for i, s in want.items() if s >= 0.5}
    assert sum(0.5 <= s < 0.7 for s in scores) > 50


def test_short_and_unspaced_items_are_found(spark):
    item = "下列哪一个数是这个表达式的值"
    items = spark.createDataFrame([(1, "What is entropy?"), (2, item), (3, "what is"), (4, "..."), (5, "何か")], "item_id long, text string")
    docs = [(10, f"{words(30, 91)} what is, Entropy: {words(30, 92)}"), (11, f"前文在此。{item}。后文"), (12, f"前文{item[:9]}算{item[10:]}后文"), (13, "what entropy is 何も"), (14, "entropy"), (15, "これは何か"), (16, None)]
    got = sorted((r["doc_id"], r["item_id"], r["score"] == 1.0, r["end_word"]) for r in decontamination.contaminated(frame(spark, docs), items).collect())
    assert [g[:3] for g in got] == [(10, 1, True), (10, 3, True), (11, 2, True), (12, 2, False), (15, 5, True)] and got[0][3] == 33
    assert [r["doc_id"] for r in decontamination.decontaminate(frame(spark, docs), items).collect()] == [13, 14, 16]


def test_alignment_equals_plain_recurrence():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = r.integers(0, 5, 12), r.integers(0, 5, 20)
        h = np.zeros((13, 21), int)
        for i in range(1, 13):
            for j in range(1, 21):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == h.max()


# ---- toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = words(40, i).split()
        if bad:
            text.insert(r.randrange(40), r.choice(["dimwit", "nitwit"]))
        elif i % 30 == 1:
            text[5:5] = ["garden", "dimwit"]  # always harmless in this phrase
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    lex = toxicity.learn(frame(spark, docs + EDGE), lab)
    new = [(1000, "what a D1mw!t you are here now"), (1001, "nice words only"), (1002, "a nіtwit with a foreign letter"), (1003, None), (1004, ""), (1005, "my garden dimwit statue")]
    got = by_id(toxicity.predict(frame(spark, new), lex))
    assert got[1000]["score"] > 0.5 > got[1001]["score"] and got[1002]["score"] > 0.5
    assert got[1003]["predicted"] == got[1004]["predicted"] == got[1005]["predicted"] == 0
    assert toxicity.predict(frame(spark, EDGE), toxicity.learn(frame(spark, docs), lab.where("false"))).count() == len(EDGE)


def test_matcher_equals_brute_force():
    r = random.Random(17)
    lexicon = toxicity.Lexicon({"dim*": 2.0, "dimwit": 5.0, "nit": 1.0, "nitwit*": 3.0, "oaf": 4.0}, frozenset(["garden dimwit", "oaf statue"]), 0.0, (0.0, 0.0))
    vocab = ["dim", "dimwit", "dimwits", "dimmer", "nit", "nits", "nitwit", "nitwits", "oaf", "loaf", "garden", "statue", "x" * 90, "1", "--" * 50]

    def plain(text):
        places = [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", text)]
        total = 0.0
        for k, (_, w) in enumerate(places):
            fits = [(len(p.rstrip("*")), p[-1] != "*", v) for p, v in lexicon.weights.items() if w == p or p[-1] == "*" and w.startswith(p[:-1])]
            near = {f"{places[k - 1][1]} {w}"} if k else set()
            near |= {f"{w} {places[k + 1][1]}"} if k + 1 < len(places) else set()
            total += max(fits)[2] if fits and not near & lexicon.exceptions else 0
        return total

    match = toxicity.Matcher(lexicon)
    for _ in range(400):
        text = r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(r.randrange(0, 25)))
        assert match(text) == plain(text)
    assert match.score(" ".join(vocab) * 3000) > 0  # a long text


def test_op9_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    got = toxicity.op9_toxicity(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").select("predicted", "toxic").collect()
    hits = sum(x["predicted"] == x["toxic"] == 1 for x in got)
    assert hits >= 0.9 * sum(x["predicted"] for x in got) and hits >= 0.8 * sum(x["toxic"] for x in got)


def test_folding():
    assert toxicity.fold("1D10T сlоwn $cum m0r0n 50 a1 b") == "idiot clown scum moron 50 a1 b"


# ---- pages --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a}</style><script>var x="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text</p><form><input name=q><button>Go</button></form><p>Second &lt;tag&gt;<br>line&nbsp;end<p>Third<div class="comments"><p>I agree</p></div></article><footer>&copy;</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "http://a.example/1", PAGE, "x"), (2, "http://a.example/2", "<p>No article</p><nav>menu</nav>plain", "x"), (3, None, None, "x"), (4, "", "", "x"), (5, "nonsense", "<article><p>open <nav>x", "x"), (1, "http://a.example/1", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _html string")
    got = {r["page_id"]: r for r in html_extract.extract_text(pages).collect()}
    assert got[1]["text"] == "Head & line\n\nFirst bold text\n\nSecond <tag> line end\n\nThird"
    assert got[2]["text"] == "No article\n\nplain" and got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "open"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract_text(pages.where("false")).count() == 0


def test_rules_take_roots_that_open():
    assert html_extract.extract('<div id="main-menu">Menu</div><div class="post-comments">I agree</div><span class="entry">Tag</span><div><p>Text</p></div>') == "Tag\n\nText"
    assert html_extract.extract('<p>x</p><div class="entry">One</div>') == "One" and html_extract.extract("<p>x</p><main>Three</main>") == "Three"
    assert html_extract.extract("<nav><article>x</article></nav><main>Five</main>") == "Five"


def test_class_names_are_judged_whole():
    page = '<article><p>one</p><div class="related-work">two</div><section id="comment-on-law">three</section><div class="post-comments">no</div><div id="ad-slot-3">no</div><p class="cookie-notice">no</p><div class="noticed advertise">four</div></article>'
    assert html_extract.extract(page) == "one\n\ntwo\n\nthree\n\nfour"


def unmarked(i, notice=False):
    """A page without any telling element or class: menu, story, adverts and foot in plain elements, all but the foot different each time."""
    menu = "".join(f"<li><a href='/{k}'>{words(1, 50 * i + k)}</a></li>" for k in range(3 + i % 3))
    body = "".join(f"<p>{words(20, 1000 * i + k)} <b>bold</b></p>" for k in range(2 + i % 4))
    return f"<html><body><div><ul>{menu}</ul></div>{'<section>New here</section>' if notice else ''}<div><div>{words(4, 7 * i)} offer</div></div><div><h1>Title {i}</h1>{body}<table><tr><td>cell {i}</td></tr></table></div><div>All rights reserved, the publisher of this site</div></body></html>", f"Title {i}\n\n" + "\n\n".join(f"{words(20, 1000 * i + k)} bold" for k in range(2 + i % 4)) + f"\n\ncell {i}"


def lcs(a, b):
    """The plainest aligner: longest common subsequence by its recurrence."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_wrappers_decide_where_the_main_text_is():
    pages = [unmarked(i, notice=i % 3 == 0) for i in range(20)]
    spec = html_extract.infer([p for p, _ in pages[:8]])
    assert "[<section $ >section]?" in spec["wrapper"] and ")+" in spec["wrapper"] and "$" in spec["wrapper"]
    plain = html_extract.infer([p for p, _ in pages[:8]], lcs)
    for page, want in pages:
        assert html_extract.extract(page, spec) == html_extract.extract(page, plain) == want
        assert html_extract.extract(page) != want  # without the wrapper menus, offers and the foot come along
    assert html_extract.extract("<main>Another template</main><div>foot</div>", spec) == "Another template"
    assert html_extract.infer([p for p, _ in pages[:3]])["root"] is None and html_extract.infer([pages[0][0]] * 9)["root"] is None and html_extract.infer([])["root"] is None
    two = [f"<body><article><p>first {words(9, i)}</p></article><div>{i}</div><article><p>second {words(9, -i)}</p></article></body>" for i in range(6)]
    assert html_extract.infer(two)["root"] is None and "second" in html_extract.extract(two[2], html_extract.infer(two))
    long = unmarked(3)[0].replace("<h1>", "<p>" + "word " * 200_000 + "</p>" + "<ul><li>x</li></ul><p>y</p>" * 5000 + "<h1>")
    assert len(html_extract.extract(long, spec)) > 1_000_000 and "offer" not in html_extract.extract(long, spec)


def test_wrappers_in_spark(spark, tmp_path):
    pages = [(i, "http://plain.example/x", *unmarked(i, i % 3 == 0)) for i in range(30)] + [(100 + i, "http://few.example/", f"<article>{i}</article>", str(i)) for i in range(2)]
    frame_ = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h, _ in pages], "page_id long, url string, html string, _host string, _wrapper string")
    frame_.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = html_extract.op10_html_extract(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted((i, t, len(t)) for i, _, _, t in pages)
    joined = html_extract.extract_text(spark.read.parquet(str(tmp_path / "pages.parquet")), most_broadcast=-1).collect()
    assert sorted(joined) == sorted(got)


def notice(i):
    return f"<html><body><div>Not found {i}</div><div>{words(3, i)}</div></body></html>"


def test_wrappers_come_from_all_pages(spark):
    hashed = lambda pages: sorted((r["h"], r["html"]) for r in spark.createDataFrame([(p,) for p in pages], "html string").select("html", F.xxhash64("html").alias("h")).collect())
    stories = [unmarked(i) for i in range(30)]
    least = hashed(p for p, _ in stories)[0][0]
    odd = [p for h, p in hashed(notice(i) for i in range(3000)) if h < least][:9]
    assert len(odd) == 9  # any eight pages of least hashes are notices, but most pages are stories
    rows = [(i, "http://mixed.example/", p) for i, (p, _) in enumerate(stories)] + [(100 + i, "http://mixed.example/", p) for i, p in enumerate(odd)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(30)] == [t for _, t in stories]
    assert [got[100 + i] for i in range(9)] == [html_extract.extract(p) for p in odd]  # of another template: nothing of theirs is lost


def test_wrappers_of_all_hosts_equal_those_of_one(spark):
    r = random.Random(5)
    hosts = {f"h{k}.example": [unmarked(100 * k + i, r.random() < 0.1 * k)[0] for i in range(5 * k)] + [notice(i) for i in range(k)] for k in range(1, 7)}
    hosts["same.example"], hosts["void.example"] = [unmarked(1)[0]] * 9, ["", " ", "<p></p>", "<b></b>", "<i></i>"]
    rows = [(f"http://{h}/", p) for h, pages in hosts.items() for p in [*pages, pages[0], None]]
    want = {h: spec for h, pages in hosts.items() if (spec := html_extract.infer(pages))["root"]}
    assert sorted(want) == [f"h{k}.example" for k in range(1, 7)] and want["h6.example"]["n"] == 36
    for n in (1, 9):
        table = spark.createDataFrame(rows, "url string, html string").repartition(n)
        got = {x["_host"]: json.loads(x["_wrapper"]) for x in html_extract.wrappers(table).collect()}
        assert got == {h: {"symbols": x["symbols"], "pages": x["pages"], "n": x["n"], "root": list(x["root"])} for h, x in want.items()}


def test_base_is_nearest_to_all_pages():
    r = random.Random(6)
    for _ in range(200):
        pages = [tuple(r.choice("abcde") for _ in range(r.randrange(0, 7))) for _ in range(12)]
        far = {s: sum(sum(abs(s.count(x) - t.count(x)) for x in "abcde") for t in pages) for s in pages if s}
        assert far[html_extract.base_of(collections.Counter(pages))] == min(far.values())
    assert html_extract.base_of(collections.Counter([()])) == ()


def test_few_odd_pages_do_not_turn_the_template_into_slots():
    foot = words(60, 4)
    pages = [(p.replace("All rights reserved", foot), t) for p, t in map(unmarked, range(40))]
    spec = html_extract.infer([p for p, _ in pages] + [notice(1)])
    assert all(html_extract.extract(p, spec) == t for p, t in pages) and html_extract.extract(notice(1), spec) == html_extract.extract(notice(1))


def test_shared_texts_go_only_where_no_root_is(spark):
    long, note = words(40, 81), "Free to copy under the licence"
    rows = [(i, "http://copies.example/", f"<div>{note}</div><article><h1>Title {i}</h1><p>{long}</p><p>{note}</p></article>") for i in range(12)]
    rows += [(100 + i, "http://plain.example/", f"<div>Footer</div><p>{words(9, i)}</p>" + ("<p>often</p>" if i else "")) for i in range(40)]
    rows += [(200 + i, "http://same.example/", f"<p>Head {i}</p><p>{long}</p>") for i in range(6)] + [(300 + i, "http://few.example/", f"<p>Footer</p><p>{i}{long}</p>") for i in range(3)]
    rows += [(400 + i, "http://long.example/", "<p>a</p><br>" * 2000 * (i == 0) + f"<p>{i}{long}</p><div>Footer</div>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(got[i] == f"Title {i}\n\n{long}\n\n{note}" for i in range(12))
    assert got[100] == words(9, 0) and all(got[100 + i] == words(9, i) + "\n\noften" for i in range(1, 40))
    assert all(got[200 + i] == f"Head {i}\n\n{long}" for i in range(6)) and all(got[300 + i] == f"Footer\n\n{i}{long}" for i in range(3))
    assert all(got[400 + i] == f"{i}{long}" for i in range(1, 5)) and got[400].endswith(f"0{long}")


# ---- queries against their SQL -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    found = con.execute(registry.SQL[name])
    cols = [c[0] for c in found.description]
    want = sorted(str(dict(sorted(zip(cols, row, strict=True)))) for row in found.fetchall())
    got = registry.QUERIES[name](spark, data).collect()
    assert sorted(str(dict(sorted(x.asDict().items()))) for x in got) == want


def test_op3_equals_library(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    got = by_id(bpe.op3_bpe(spark, data))
    for x in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = tok.encode(x["text"] or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[x["doc_id"]]) == (x["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(decoded))


# ---- empty tables -------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert bpe.encode(none, bpe.default_tokenizer()).count() == 0
    assert sharding.assign(none, sharding.topology(8)).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.near_dedup(none).count() == 0
    assert secrets.scan(none).count() == 0
