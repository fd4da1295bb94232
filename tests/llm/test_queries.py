"""The registered queries over whole tables, with columns as their contracts name them."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_ann import exact
from test_decontaminate import plain as plain_hits
from test_pii import plain_base
from test_shard_tree import plain as plain_shard
from test_simhash import plain_components, plain_fingerprint

from plumbline.llm import pii, queries, sentence_pieces, shard_tree, token_cache

FIRST_COLUMNS = {
    "op1_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op2_cross_polytope_nearest": ["query_id", "rank", "vec_id", "score"],
    "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4_pii_anchors": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_n_best_pieces": ["doc_id", "n_pieces", "score"],
    "op6_toxicity_nb_linear": ["doc_id", "held_out", "score", "predicted"],
    "op7_hash_tree_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_language_crf": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_masked_lm": ["doc_id", "n_tokens", "pll"],
}


@pytest.mark.parametrize("name", FIRST_COLUMNS)
def test_query(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert out.columns[: len(FIRST_COLUMNS[name])] == FIRST_COLUMNS[name]
    rows = spark.read.parquet(f"{sf}/documents.parquet").count()
    if name == "op2_cross_polytope_nearest":
        asked = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
        assert out.count() == asked * 20 and dict(out.dtypes)["rank"] == "int"
    else:
        assert out.count() == rows
    if name == "op7_hash_tree_shards":
        assert out.where("shard NOT BETWEEN 0 AND 39 OR (grown_shard <> shard AND grown_shard <> 40)").count() == 0


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def of(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_fingerprints_and_components(spark, sf, texts):
    rows = of(spark, sf, "op1_simhash_near_dedup")
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == plain_components(list(prints), list(prints.values()))


def test_neighbours(spark, sf):
    want = exact([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], 20)
    got = {}
    for r in sorted(of(spark, sf, "op2_cross_polytope_nearest"), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_token_counts(spark, sf, texts):
    count = token_cache.TokenCounter(public_tokenizers.path("word_bpe_49k.json"), pieces=False).encode
    want = dict(zip(texts, count(list(texts.values()))))
    for r in of(spark, sf, "op3_token_counts"):
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(texts[r.doc_id].encode()), want[r.doc_id] > 2048)


def test_personal_data(spark, sf, texts):
    for r in of(spark, sf, "op4_pii_anchors"):
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)


def test_pieces(spark, sf, texts):
    lattice = sentence_pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    for r in of(spark, sf, "op5_n_best_pieces"):
        assert r.round_trip and r.n_alternatives <= 3 and (r.margin is None or r.margin >= 0)
        if len(texts[r.doc_id]) < 2_000:
            score, ids, _ = lattice.encode(texts[r.doc_id])
            assert r.n_pieces == len(ids) and np.isclose(r.score, score)


def test_held_out_predictions(spark, sf, texts):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in of(spark, sf, "op6_toxicity_nb_linear"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert set(toxic.values()) <= {0, 1, None}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = of(spark, sf, "op8_language_crf")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.9
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id])) for r in rows)


def test_shards(spark, sf, texts):
    tree = shard_tree.build_tree(queries.N_SHARDS)
    grown, rows = shard_tree.add_shard(tree), of(spark, sf, "op7_hash_tree_shards")
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (plain_shard(str(r.doc_id), tree), plain_shard(str(r.doc_id), grown))
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_benchmark_hits(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = {i: t for i, t in texts.items() if len(t) < 3_000}
    want = {x[0]: x for x in plain_hits(list(short.items()), items)}
    assert any(x[5] for x in want.values())
    for r in of(spark, sf, "op9_decontaminate"):
        if r.doc_id in want:
            assert tuple(r) == want[r.doc_id]


def test_masked_scores(spark, sf, texts):
    rows = of(spark, sf, "op10_masked_lm")
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.lower().split()) for i, t in texts.items()}
    assert all((r.pll < 0) == (r.n_tokens > 0) for r in rows)
