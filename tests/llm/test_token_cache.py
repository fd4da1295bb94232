import random

import public_tokenizers
import pytest

from plumbline.llm import token_cache as tc


def messy(n, seed=2):
    rnd = random.Random(seed)
    bits = ["it's", "We'LL", "don't'", "''s", "!!'S", "12345", "ñandú", "İI", "straße", "Σας", "é", "ﬁ", "漢字", "🔥🔥", "<|endoftext|>", "<|EndOfText|>", "<|startof", "text|>", "\x1c", " ", "\xa0", "—", "’s", "ǅ", "\t\n", "a_b", "@#'re", "Ⅷ", "²", "ª", "ͅ"]
    return ["".join(rnd.choice(bits) + rnd.choice(["", " ", "  ", "\n"]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(name):
    path = public_tokenizers.path(name)
    batch = messy(400) + ["", " ", "x" * 5000]
    fast, whole = tc.TokenCounter(path), tc.TokenCounter(path, pieces=False)
    assert whole.split is None and fast.counts(batch) == whole.encode(batch) == fast.counts(batch)


def test_cache_is_read_and_grows_by_distinct_misses_only(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    rows = [(1, "Hello  world"), (2, "hello world"), (3, None), (4, ""), (5, "Hello world"), (5, "Hello world"), (None, "tail " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as content", "1 as n_tokens")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tc.count_tokens(docs, path, cache).collect()), key=str)
    want = tc.TokenCounter(path, pieces=False).encode([t or "" for _, t in rows])
    assert got == sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(rows, want)), key=str)
    assert spark.read.parquet(cache).count() == 4  # "Hello world" in two cases, empty, tail
    # what the cache holds is used, not counted again
    tc.open_cache(spark, cache)
    marked = [(tc_row.content, tc_row.tokenizer, 777) for tc_row in spark.read.parquet(cache).collect()]
    other = f"file://{tmp_path}/other"
    spark.createDataFrame(marked, tc.CACHE_SCHEMA).write.parquet(other)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9, "new one")], "doc_id long, text string"))
    again = {r.doc_id: r.n_tokens for r in tc.count_tokens(more, path, other).collect()}
    assert again[1] == again[3] == 777 and again[9] == 2
    assert spark.read.parquet(other).count() == len(marked) + 1
    # another tokenizer shares the cache without mixing
    sp = public_tokenizers.path("piece_bpe_32k.model")
    mixed = {r.doc_id: r.n_tokens for r in tc.count_tokens(docs.where("doc_id < 3"), sp, other).collect()}
    assert mixed == dict(zip([1, 2], tc.TokenCounter(sp).encode(["Hello  world", "hello world"])))
    assert tc.count_tokens(docs.limit(0), path, f"file://{tmp_path}/none").count() == 0
