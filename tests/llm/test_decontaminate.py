import hashlib
import random
import re

import numpy as np

from plumbline.llm import decontaminate as d


def plain(docs, items):
    low = lambda t: re.findall(d.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(i, low(t)[k : k + 10]) for i, t in items for k in range(max(1, len(low(t)) - 9)) if low(t)]
    out = []
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice(["Ä", "bé", "c3", "d-e", "F", "g.h"]) for _ in range(n))
    items = [(k, say(rnd.randint(11, 25))) for k in range(12)] + [(20, "Short ITEM, here"), (21, None), (22, "..."), (3, "dup item id has more words in it than ten of them"), (10, say(10))]
    docs = [(k, say(rnd.randint(0, 60)) + " " + (items[k % 12][1] if k % 3 == 0 else "") + say(5)) for k in range(40)]
    docs += [(90, None), (91, ""), (92, "xx short item HERE yy"), (92, "xx short item HERE yy"), (93, items[4][1].lower() + " x " + items[4][1].upper()), (94, items[5][1] * 50)]
    return docs, items


def test_scan_equals_brute_force_in_one_or_more_parts(spark):
    docs, items = cases()
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as n_hit")
    windows = d.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    for parts in (d.SET_WINDOWS, 7):
        got = d.scan(left, windows, set_windows=parts).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(docs, items)


def test_removal(spark):
    docs, items = cases()
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as source")
    windows = d.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    clean = [x[0] for x in plain(docs, items) if not x[5]]
    kept = d.decontaminate(left, windows)
    assert kept.columns == left.columns and sorted(r.doc_id for r in kept.collect()) == sorted(clean)
    spared = d.decontaminate(left, windows, most_hit=1.0)
    assert spared.count() == len(docs) and not [r for r in d.scan(spared, windows).collect() if r.contaminated]
    assert d.cut_words("a b, c d", np.array([False, True, True, False])) == "a  d"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in d.scan(docs, d.item_windows(none)).collect()] == [(1, 2, 0, 0)]
    assert d.scan(docs.limit(0), d.item_windows(none)).count() == 0


def test_null_item_ids_and_parts(spark):
    items = spark.createDataFrame([(None, "red fox runs"), (None, "blue sky"), (4, "red fox runs")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a red fox runs"), (2, "Blue Sky!"), (3, "none"), (None, None)], "doc_id long, text string").selectExpr("*", "'t' as digest", "1 as row")
    for parts in (100, 1):
        got = {r.doc_id: r for r in d.scan(docs, d.item_windows(items), set_windows=parts).collect()}
        assert (got[1].n_items, got[2].n_items, got[3].n_items, got[None].n_hit) == (2, 1, 0, 0)
        assert got[1].items_sha256 == hashlib.sha256(b",4").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
        for most, want in ((0.0, {3: "none", None: None}), (0.8, {1: "a ", 3: "none", None: None})):
            kept = d.decontaminate(docs, d.item_windows(items), most_hit=most, set_windows=parts)
            assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == want


def test_long_items_take_linear_time(spark):
    """An item of tens of thousands of words gives all its windows at once."""
    items = spark.createDataFrame([(1, " ".join(f"w{k % 40_009}" for k in range(120_000)))], "item_id long, text string")
    assert d.item_windows(items).count() == 40_009
