"""What the search for near duplicates sends between tasks, and how exact it is."""

import json

import numpy as np

from plumbline import registry
from plumbline.operators import duplicates as D


def plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_sketch_is_sent_once_a_cell_and_not_once_a_band(spark):
    words = ["".join(chr(97 + (k * 7 + j * j) % 26) for j in range(6)) for k in range(40)]
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice(words, 30))) for k in range(200)] + [(900, "kurz"), (901, "")]
    drawn = D.cut(D.sketches(spark.createDataFrame(rows, "rep long, norm string")))
    assert max(len(bytes(np.array(r.signature, np.int8).tobytes())) for r in drawn.collect()) == 128
    for cell_rows in (50_000, 60):
        found = D.likely_pairs(drawn, cell_rows=cell_rows)
        assert "explode(bands" not in plans(found) and "Join" not in plans(found).split("MapInPandas")[0]
        pairs = [tuple(sorted(r)) for r in found.collect()]
        assert len(pairs) == len(set(pairs))


def test_no_pair_that_shares_a_band_is_lost_to_ranges_or_cells(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):  # lengths on both sides of the ranges' borders
        base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 90 + 9 * k))
        rows += [base, base[: int(0.74 * len(base))], base + "x" * 3, base[:-4]]
    reps = spark.createDataFrame(list(enumerate(rows)), "rep long, norm string")
    sets = [set(D.mixed_shingles(t).tolist()) for t in rows]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(rows)) for a in range(b)}
    want = {p: v for p, v in want.items() if v >= 0.7}
    for cell_rows in (50_000, 30):
        got = {(r.a, r.b): r.score for r in D.near_pairs(reps, cell_rows=cell_rows).collect()}
        assert got == want and len(want) > 150


def test_scores_do_not_depend_on_31_bits():
    hashes = D.mixed_shingles("".join(chr(0x4E00 + k * 31 % 20000) for k in range(150_000)))
    assert len(D.shingles_of("".join(chr(0x4E00 + k * 31 % 20000) for k in range(150_000)))) <= len(hashes) == 20_000


def test_texts_are_neither_grouped_nor_joined_by_themselves(spark, sf, monkeypatch):
    seen, landed = [], D.landed
    monkeypatch.setattr(D, "landed", lambda df, name: seen.append((name, df.columns)) or landed(df, name))
    out = registry.QUERIES["duplicate_components"](spark, sf)
    assert not any(c in ("norm", "text") for _, columns in seen for c in columns)
    joins = [line for line in plans(out).splitlines() if "Join" in line]
    assert joins and not any("norm#" in line or "text#" in line for line in joins), json.dumps(joins)


def test_exported_texts_travel_deflated_and_once(spark, sf, tmp_path, monkeypatch):
    from plumbline.functions import text as T
    from plumbline.sources import sinks

    rows = spark.createDataFrame([(k, None if k == 4 else f"mail me at a{k}@b.com " * 40) for k in range(25)], "id long, text string")
    frame, kinds = type(rows), []
    moved = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: kinds.append(dict(self.dtypes)) or moved(self, *a))
    for name, given in (("raw", rows), ("given", rows.select("id", T.deflated(T.public_scrub(rows.text)).alias("scrubbed")))):
        for decided in (None, rows.select("id", (rows.id % 3).alias("code"))):
            path = f"file://{tmp_path}/{name}{decided is None}"
            sinks.bundle(given, path, 10, decided)
            got = {r.id: r.text for r in spark.read.json(path).collect()}
            assert got == {k: None if k == 4 else "mail me at [email] " * 40 for k in range(25)}
    registry.QUERIES["exported_chunks"](spark, sf)
    assert len(kinds) >= 5 and not any(k == "string" and c in ("text", "scrubbed") for kind in kinds for c, k in kind.items())
