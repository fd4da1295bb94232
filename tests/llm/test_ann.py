import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann


def exact(rows, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = (x * v).sum(axis=1)
            keep = [j for j in ann.best(s, ids, len(ids)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in keep]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "'s' as score")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_fast_transform_is_orthonormal():
    x = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x, atol=1e-5)


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [None, *[1.0] * 31]), (2080, [float("inf")] * 32)]
    want = exact(rows, 20)
    for bucket_rows in (ann.BUCKET_ROWS, 10):
        got = run(spark, rows, bucket_rows=bucket_rows)
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
        assert np.mean(hits) >= 0.9
        for q in want:
            score = {i: s for i, s in exact(rows, len(rows))[q]} if q in (0, 200) else dict(want[q])
            assert all(score.get(i, s) == s for i, s in got[q])
        assert got[200] == want[200]  # the smallest ids of the equal vectors


def test_few_candidates_uneven_norms_and_empty(spark):
    rng = np.random.default_rng(2)
    few = [(20 * i, (rng.normal(size=6) * (i + 1)).tolist()) for i in range(7)]
    got, want = run(spark, few), exact(few, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    many = [(i, (rng.normal(size=24) * rng.uniform(0.2, 3)).tolist()) for i in range(1200)]
    got, want = run(spark, many), exact(many, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert run(spark, [(20, None)]) == {} and run(spark, []) == {}


def test_double_precision_and_wide_ranges(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(0, (base * 1e39).tolist())] + [(i, ((base + 1e-9 * i * np.sign(base)) * 1e39).tolist()) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == list(range(39, 19, -1))  # alike in single precision, and beyond its range


def test_recall_on_the_drivers_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = exact(rows, 20), run(spark, rows)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_queries_dealt_over_copies_of_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    plain = run(spark, rows)
    monkeypatch.setattr(ann, "BUCKET_QUERIES", 1)
    assert run(spark, rows) == plain


def test_as_many_axes_are_probed_at_any_size(spark, monkeypatch):
    search, seen = ann._search, set()
    monkeypatch.setattr(ann, "_search", lambda *a: seen.add((a[4], a[7])) or search(*a))
    rng = np.random.default_rng(6)
    for n in (60, 3000):
        run(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 32)))])
    assert {probes for tables, probes in seen if tables == ann.TABLES} == {ann.PROBES}
