"""The pipeline's stages against plain code on a small table, and edge cases."""

import hashlib
import random

from test_corpus_operators import near, norm, words
from tokenizers import Tokenizer

import corpus_pipeline
from tallyrule.llm import bpe


def docs():
    r = random.Random(3)
    base = [words(60, s, 2000) for s in range(8)]
    rows = [(i, b) for i, b in enumerate(base)] + [(20, base[0]), (21, base[1].replace(" ", "  ", 3)), (22, base[2] + " extra"), (23, "12345 ..."), (24, None), (25, "")]
    item = words(30, 99, 5000)
    rows += [(30, f"{words(20, 50)} {item} {words(20, 51)}")]
    r.shuffle(rows)
    return rows, item


def test_pipeline(spark, tmp_path):
    rows, item = docs()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for i, t in left:
        first[norm(t)] = min(i, first.get(norm(t), i))
    left = [(i, t) for i, t in left if first[norm(t)] == i]
    keep = {i for i, _, c in near(left, 5) if i == c}
    left = [(i, t) for i, t in left if i in keep and item not in t]
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    want = sorted((i, hashlib.sha256(" ".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in left)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in got.collect()) == want


def test_stages_keep_columns_and_take_empty_tables(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table.where("false"), data)
        assert out.columns == table.columns and out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
