import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash, verified


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    near = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    return plain_roots(ids, near)


def plain_roots(ids, edges):
    """Smallest id reachable over edges between places of ``ids``."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_fingerprint_matches_plain():
    for t in [None, "", " \t\n", "one", "A b  C", "a b c d", "Ä b\x0bc d e É f", "x y " * 400, "ab\x1cc d e f g h"]:
        assert simhash.fingerprint(t)[0] & (2**64 - 1) == plain_fingerprint(t)


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for g in range(60):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 4) for _ in range(rnd.randint(30, 250))]
        for _ in range(rnd.randint(1, 6)):
            words = list(base)
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = "zz" + str(rnd.randrange(99))
            rows.append((n * 7 % 1009, " ".join(words), "x"))
            n += 1
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("other"))
    want_print = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = plain_components(list(want_print), list(want_print.values()))
    for cell_rows in (20_000, 8):
        got = simhash.near_duplicates(docs, cell_rows=cell_rows).collect()
        assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want_print
        assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want) - 20


def test_anchors_meet_for_all_links():
    rng = np.random.default_rng(5)
    import pandas as pd

    a = rng.integers(-(2**63), 2**63 - 1, 400)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit)).astype(np.int64)
    both = pd.concat(list(simhash._to_anchors(simhash.Scheme())(iter([pd.DataFrame({"f0": np.concatenate([a, b])})]))))
    homes = both[both.home].groupby("f0")["anchor"].apply(set)
    members = both.groupby("f0")["anchor"].apply(set)
    assert (both[both.home].groupby("f0").size() >= 3).all()
    for x, y in zip(a, b):
        assert homes[x] & members[y] and homes[y] & members[x]


def test_long_chain_empty_table_and_repeated_rows(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(70)] + [(200, 201)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 71)}, 201: 200}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(4, "same words here again ok"), (4, "same words here again ok"), (None, "same words here again ok")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(twice).collect()] == [4, 4, 4]


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_groups_around_pivots_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIVOT_ROWS", 4)
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 3)
    prints = []
    for k in range(240):
        x = int(base[k % 3])
        for bit in rng.choice(12, rng.integers(0, 5), replace=False):
            x ^= 1 << int(bit)
        prints.append(x)
    prints = sorted(set(prints))
    want = plain_components(prints, [p & (2**64 - 1) for p in prints])
    for cell_rows in (20_000, 30):
        forest = simhash.link_forest(spark.createDataFrame([(p,) for p in prints], "f0 long"), cell_rows=cell_rows)
        roots = {r.node: r.root for r in simhash.components(forest.selectExpr("u0 a", "v0 b")).collect()}
        assert {p: roots.get(p, p) for p in prints} == want


def edited_pairs(groups, seed=8):
    """(doc_id, text) rows: a text and an edited one for each group, and their five-word similarities by the second's id."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows, similar = [], {}
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([60, 120, 400]))]
        rows.append((10 * g, " ".join(base)))
        edited = list(base)
        for _ in range(max(1, len(base) // rnd.choice([25, 30, 35, 40, 50, 60, 80, 120]))):
            edited[rnd.randrange(len(edited))] = word()
        rows.append((10 * g + 1, " ".join(edited)))
        similar[10 * g + 1] = jaccard(rows[-2][1], rows[-1][1])
    return rows, similar


def test_keep_first_catches_similar_texts_and_no_others(spark):
    rows, similar = edited_pairs(1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as first", "'x' as root")
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert {r[0] for r in rows if r[0] % 10 == 0} <= kept
    assert {i for i, s in similar.items() if s < 0.8} <= kept and sum(0.7 <= s < 0.8 for s in similar.values()) > 100
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        band = [i for i, s in similar.items() if low <= s < high]
        assert len(band) > 60 and np.mean([i not in kept for i in band]) >= 0.9, low


def plain_links(rows, similarity=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    return [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


@pytest.mark.parametrize("group_rows", [256, 7])
def test_links_within_groups_connect_what_exact_links_do(spark, monkeypatch, group_rows):
    """Chains, stars and strangers in one group, as small groups and as blocks of a large one."""
    monkeypatch.setattr(verified, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(verified, "PIVOTS", 3)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(5):
        text = [word() for _ in range(80)]
        for _ in range(14):  # each a small step from one of those before: links chain
            rows.append((len(rows), " ".join(text)))
            text = rnd.choice([r[1] for r in rows[-4:]]).split()[:80]
            for _ in range(rnd.choice([1, 2, 5])):
                text[rnd.randrange(80)] = word()
    rows += [(1000 + k, "") for k in range(3)] + [(2000 + k, word()) for k in range(3)]
    ids = list(dict(rows))
    want = plain_roots(ids, [(ids.index(a), ids.index(b)) for a, b in plain_links(rows)])
    members = spark.createDataFrame([(1, i, t) for i, t in rows] + [(2, 5000, "alone")], "root long, digest long, text string")
    found = {r.digest: r["class"] for r in verified.classes(members, 0.8, 5).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == want and 5000 not in found
    assert len(set(want.values())) < len(want) - 20


def test_filter_rules_out_only_what_is_not_there(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("digest"))
    look = verified.may_hold(verified.digest_filter(rows, "digest"))
    assert rows.where(look(F.col("digest"))).count() == 5000
    assert spark.range(5000, 15000).select(F.xxhash64("id").alias("digest")).where(look(F.col("digest"))).count() < 50
    none = verified.may_hold(verified.digest_filter(rows.limit(0), "digest"))
    assert rows.where(none(F.col("digest"))).count() == 0


def test_keep_first_of_odd_rows(spark):
    rows = [(3, "one two three four five six", "a"), (2, "one two three four five six", "b"), (2, "one two three four five six", "b"), (None, "one two three four five six", "c"), (2, "an other text with id two again", "d")]
    rows += [(None, "without an id at all here now", "e"), (None, "without an id at all here now", "f"), (7, None, "g"), (8, "", "h"), (9, " ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string").selectExpr("*", "1 as _row", "2 as n", "3 as digest")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str(x) for x in [(2, rows[0][1]), (2, rows[4][1]), (None, rows[5][1]), (7, None)])
    assert simhash.keep_first(docs.limit(0)).count() == 0
