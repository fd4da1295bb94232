"""Density clusters, languages, interval joins and rules' literals against plain versions."""

import datetime as dt
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import patterns as P
from plumbline.functions import text as T
from plumbline.operators import density as DN
from plumbline.operators import intervals as I
from plumbline.operators import languages as LA

START = dt.datetime(2024, 3, 1)


def plain_density(x, m):
    """Smallest id of each row's density cluster, -1 for noise: all distances, Kruskal's rule, excess of mass."""
    n = len(x)
    dist = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), DN.DIGITS)
    core = np.sort(dist, axis=1)[:, m - 1]
    edges = sorted((max(dist[a, b], core[a], core[b]), a, b) for a in range(n) for b in range(a + 1, n))
    comp, node, at = list(range(n)), [None] * n, {}
    nodes = {}  # node: [w, up, points, mass]
    for k, (w, a, b) in enumerate(edges):
        ca, cb = comp[a], comp[b]
        if ca == cb:
            continue
        own = [i for i in range(n) if comp[i] in (ca, cb)]
        big = {node[i] for i in own} - {None}
        made = k if len(big) == 2 or not big and len(own) >= m else next(iter(big), None)
        if made == k:
            nodes[k] = [w, None, [], 0.0]
            for c in big:
                nodes[c][1] = k
        for i in own:
            if made is not None:
                if node[i] is None:
                    nodes[made][2].append(i)
                    nodes[made][3] += 1 / max(w, 1e-12)
                node[i] = made
            comp[i] = min(ca, cb)
    kids = {c: [d for d in nodes if nodes[d][1] == c] for c in nodes}

    def members(c):
        return nodes[c][2] + [i for d in kids[c] for i in members(d)]

    def best(c):
        w, up, own, mass = nodes[c]
        start = 0.0 if up is None else 1 / max(nodes[up][0], 1e-12)
        mass = mass - len(own) * start + (len(members(c)) - len(own)) * (1 / max(w, 1e-12) - start)
        below = [best(d) for d in kids[c]]
        parts = sum(b[0] for b in below)
        if up is None or below and parts > mass:
            return parts, [x for b in below for x in b[1]]
        return mass, [c]

    out = [-1] * n
    for c in nodes:
        if nodes[c][1] is None:
            for taken in best(c)[1]:
                for i in members(taken):
                    out[i] = min(members(taken))
    return dict(enumerate(out))


def blobs(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in (((0, 0, 0), 0.3, 40), ((3, 0, 0), 0.2, 25), ((0, 4, 0), 0.5, 45), ((5, 5, 5), 2, 20))])
    x = np.concatenate([x, x[:4], np.zeros((6, 3))])  # copies
    rng.shuffle(x)
    return x


@pytest.mark.parametrize("task_edges, block_rows", [(200_000, None), (130, 50)])
def test_density_clusters_equal_plain(spark, monkeypatch, task_edges, block_rows):
    """In one task and one block, and in rounds of contraction over several blocks."""
    monkeypatch.setattr(DN, "TASK_EDGES", task_edges)
    x = blobs(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = plain_density(x, 6)
    got = {r.id: r.cluster for r in DN.density_clusters(df, 6, block_rows=block_rows).collect()}
    assert got == want and len(set(want.values())) > 3


def test_few_pairs_of_vectors_are_subtracted(monkeypatch):
    """Of each row about as many as it has neighbours, ties and copies included, with the result of all pairs."""
    rng, compared, plain = np.random.default_rng(2), [], DN.distances
    monkeypatch.setattr(DN, "distances", lambda x, y, i, j: compared.append(len(i)) or plain(x, y, i, j))
    monkeypatch.setattr(DN, "PAIRS_AT_ONCE", 100)
    found = {}

    def against(rows, queries, compare, *more):
        found["compare"] = compare
        raise StopIteration

    monkeypatch.setattr(DN, "against", against)
    with pytest.raises(StopIteration):
        DN.neighbours(None, 5)
    for x, bad in ((rng.normal(size=(3000, 8)), False), (rng.integers(0, 4, (800, 3)).astype(float), False), (rng.normal(size=(600, 4)) * 1e4, True)):
        if bad:
            x[7, 1], x[8, 2] = np.nan, np.inf
        ids = rng.permutation(len(x))
        own = pd.DataFrame({"id": ids})
        compared.clear()
        got = found["compare"](own.iloc[:60].reset_index(drop=True), x[:60], own, x)
        for q in range(60):
            d = np.round(np.sqrt(((x - x[q]) ** 2).sum(axis=1)), DN.DIGITS)
            want = sorted((a, b) for a, b in zip(d.tolist(), ids.tolist()) if b != ids[q] and np.isfinite(a))[:5]
            assert [(n["d"], n["id"]) for n in got["near"][q]] == want
        if len(x) == 3000:
            assert sum(compared) < 60 * 60


def test_density_clusters_of_few_rows_and_rows_without_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(20)] + [(99, None)], "vec_id long, embedding array<double>")
    assert {r.cluster for r in DN.density_clusters(df, 15).collect()} == {-1}
    assert DN.density_clusters(df.limit(0)).count() == 0
    got = {r.id: r.cluster for r in DN.density_clusters(df, 5).collect()}
    assert got[99] == -1 and len(got) == 21 and {got[0], got[1], got[2]} == {0, 1, 2}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("length(text) >= 20")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    profile = LA.profiles(docs.where(~held))
    assert profile.groupBy("lang").count().agg(F.max("count")).first()[0] <= LA.GRAMS
    rows = docs.where(held).select("lang", LA.language(F.col("text"), profile).alias("guess")).collect()
    for lang in {r.lang for r in rows}:
        assert np.mean([r.guess == lang for r in rows if r.lang == lang]) > 0.97, lang
    odd = spark.createDataFrame([("short",), (None,), ("12345 67890 12345 67890",), ("это отзыв об игре на русском языке",)], "text string")
    assert [r[0] for r in odd.select(LA.language(F.col("text"), profile)).collect()] == [None, None, None, "ru"]
    none = LA.profiles(docs.limit(0))
    assert docs.limit(3).select(LA.language(F.col("text"), none).alias("g")).where("g IS NOT NULL").count() == 0


def test_interval_joins_equal_plain(spark):
    rnd = random.Random(2)
    points = [(k, START + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20)) if k % 19 else None, "ab"[k % 2]) for k in range(400)]
    spans = [(s, START + dt.timedelta(hours=a), START + dt.timedelta(hours=a + n), "ab"[s % 2]) for s, (a, n) in enumerate((rnd.randrange(480), rnd.choice([0, 1, 5, 24, 100])) for _ in range(25))]
    p = spark.createDataFrame(points, "id long, at timestamp_ntz, kind string")
    s = spark.createDataFrame(spans, "span long, start timestamp_ntz, end timestamp_ntz, kind string")
    for seconds in (3600, 86_400, 10_000_000):
        want = {(i, j) for i, t, k in points for j, a, b, l in spans if t and a <= t < b and k == l}
        met = I.within(p, s, "at", on=("kind",), seconds=seconds)
        assert sorted((r.id, r.span) for r in met.collect()) == sorted(want)
        inside = {i for i, t, _ in points if t and any(a <= t < b for _, a, b, _ in spans)}
        flagged = I.covered(p, s, "at", "hit", seconds=seconds).collect()
        assert len(flagged) == len(points) and {r.id for r in flagged if r.hit} == inside
    plan = I.covered(p, s, "at", "hit").unionByName(I.covered(p, s.limit(0), "at", "hit"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def matches_of(rule, rnd, most=3):
    """A text that a rule matches, made from the rule's own parse."""
    from re import _parser

    blanks = [" ", "\t", "\r", "\n", " ", " ", "\x0b"]

    def make(parts):
        out = []
        for op, arg in parts:
            op = str(op)
            if op == "LITERAL":
                out.append(chr(arg))
            elif op == "IN":
                kinds = [x for x in arg if str(x[0]) != "NEGATE"]
                kind, value = rnd.choice(kinds)
                out.append(chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else rnd.choice(blanks) if "SPACE" in str(value) else "w")
            elif op == "BRANCH":
                out.append(make(rnd.choice(arg[1])))
            elif op == "SUBPATTERN":
                out.append(make(arg[3]))
            elif op == "MAX_REPEAT":
                low, high, inner = arg
                out.append("".join(make(inner) for _ in range(rnd.randint(low, min(int(high), low + most)))))
        return "".join(out)

    return make(_parser.parse(rule))


def test_literals_lie_in_every_match(spark):
    """What the check for literals rules out has no match: generated matches, in other cases and with letters that only match regardless of case."""
    rnd = random.Random(5)
    swap = {"s": "ſ", "k": "K", "i": "İ"}
    rows = []
    for name, rule in (P.PROMO | P.SELF_PROMO | P.MODEL_NOTES | P.SELF_LEGIT).items():
        fold = name in P.MODEL_NOTES or name in P.SELF_LEGIT
        for k in range(60):
            text = matches_of(rule, rnd)
            if fold and k % 3 == 1:
                text = text.upper()
            if fold and k % 3 == 2:
                text = "".join(swap.get(c, c) if rnd.random() < 0.3 else c for c in text)
            rows.append((name, f"well, {text} then"))
    rows += [("greets_model", "dear AI rate me"), ("greets_model", "hello,\rai here")]
    df = spark.createDataFrame(rows, "name string, text string")
    matched = {}
    for name, rule in (P.PROMO | P.SELF_PROMO | P.MODEL_NOTES | P.SELF_LEGIT).items():
        fold = name in P.MODEL_NOTES or name in P.SELF_LEGIT
        own = df.where(F.col("name") == name).select("text", T.has(F.col("text"), rule, fold).alias("whole"), T.holds(F.col("text"), name, rule, fold).alias("checked")).collect()
        assert all(r.whole == r.checked for r in own), (name, [r.text for r in own if r.whole != r.checked][:3])
        matched[name] = sum(r.whole for r in own)
    assert all(n > 20 for n in matched.values()), matched
    assert spark.createDataFrame([("dear AI rate me",), ("hello,\rai",)], "text string").where(T.model_note(F.col("text"))).count() == 2
