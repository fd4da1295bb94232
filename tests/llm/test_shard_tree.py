import math
import zlib
from collections import Counter

import xxhash

from plumbline.llm import shard_tree as st


def plain(key, node):
    while node.children:
        if len(node.children) > 1:
            u = [((xxhash.xxh64_intdigest(c.name.encode(), xxhash.xxh64_intdigest(key.encode(), 42)) >> 12) + 0.5) / 2**52 for c in node.children]
            node = node.children[min(range(len(u)), key=lambda i: -math.log(u[i]) / node.children[i].weight)]
        else:
            node = node.children[0]
    return node.shard


def test_assignment_equals_plain_and_slots_are_gapless(spark):
    rows = [(i, f"tëxt {i}" if i % 7 else None) for i in range(3000)] + [(5, "again"), (5, "again"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as shard", "1 as slot")
    tree = st.build_tree(40)
    grown = st.add_shard(tree)
    got = st.with_slots(st.assign(docs, tree, grown), bucket_rows=20).collect()
    assert len(got) == len(rows)
    for r in got:
        key = str(r.doc_id) if r.doc_id is not None else "null"
        assert (r.shard, r.grown_shard) == (plain(key, tree), plain(key, grown))
        assert r.grown_shard in (r.shard, 40)
    text = {i: (t or "").encode() for i, t in rows if i not in (5, None)}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got if r.doc_id in text)
    for s, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert st.with_slots(st.assign(docs.limit(0), tree, grown)).count() == 0


def test_weights_and_confined_movement():
    tree, keys = st.build_tree(40), [str(i) for i in range(20_000)]
    assert tree.shards == list(range(40)) and len(tree.children) == 5
    before = {k: plain(k, tree) for k in keys}
    counts = Counter(before.values())
    assert max(counts.values()) < 1.3 * 500 and min(counts.values()) > 0.7 * 500
    after = {k: plain(k, st.add_shard(tree)) for k in keys}
    assert {after[k] for k in keys if after[k] != before[k]} == {40}
    # doubling one shard's weight moves documents only into, or within, the subtrees that hold it
    heavier = st.build_tree(40, weights=[2.0 if s == 13 else 1.0 for s in range(40)])
    moved = {k: (before[k], plain(k, heavier)) for k in keys if plain(k, heavier) != before[k]}
    region = next(set(r.shards) for r in tree.children if 13 in r.shards)
    assert moved and all(b in region for _, b in moved.values())
    assert st.build_tree(3).shards == [0, 1, 2] and st.build_tree(1).weight == 1


def test_many_equal_rows(spark):
    docs = spark.createDataFrame([(1, "same")] * 500 + [(k, "x") for k in range(50)], "doc_id long, text string")
    rows = st.with_slots(st.assign(docs, st.build_tree(3)), bucket_rows=30).collect()
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert len(rows) == 550 and sum(r.doc_id == 1 for r in rows) == 501
