import os

import public_tokenizers
from test_decontaminate import plain as plain_hits
from test_simhash import plain_links, plain_roots

import corpus_pipeline as cp
from plumbline.llm import pii, sentence_pieces
from plumbline.llm.common import table


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    benchmark = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, "", None, "s", 0)], docs.schema)
    docs = docs.union(extra)
    before, results = docs, []
    for name, stage in cp.STAGES:
        path = os.path.join(tmp_path, name)
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        results.append(([r for r in before.collect()], [r for r in after.collect()]))
        if name != cp.STAGES[-1][0]:
            assert after.columns == docs.columns
        before = after
    ids = lambda rows: {r.doc_id for r in rows}
    (a, b), (_, c), (_, d), (_, e), (_, f) = results
    assert ids(a) - ids(b) == {9001, 9002, 9003}  # clean documents stay
    # near-dedup against brute force: five-word shingles of all pairs compared exactly
    text = {r.doc_id: r.text for r in b}
    same = plain_links(list(text.items()))
    roots = dict(zip(text, range(len(text))))
    roots = plain_roots(list(text), [(roots[x], roots[y]) for x, y in same])
    gone = ids(b) - ids(c)
    assert same and gone <= {i for i, root in roots.items() if root < i}
    assert len(c) == len(ids(c)) and len(gone) >= 0.9 * sum(root < i for i, root in roots.items())
    dirty = {x[0] for x in plain_hits([(r.doc_id, r.text) for r in c], benchmark) if x[5]}
    assert ids(d) == ids(c) - dirty
    text = {r.doc_id: r.text for r in d}
    assert {r.doc_id: r.text for r in e} == {i: pii.redact_text(t, pii.find_spans(t)) for i, t in text.items()}
    assert all(r.n_chars == len(r.text) for r in e)
    lattice = sentence_pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    assert ids(f) == ids(e) and all(lattice.decode(r.pieces) == r.text for r in f)
    assert spark.read.parquet(path).count() == len(f)


def test_rows_without_ids_and_repeated_rows(spark):
    text = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").where("n_chars > 500").orderBy("doc_id").limit(12).collect()}
    rows = [(i, t, "en") for i, t in text.items()]
    rows += [rows[0], (None, rows[1][1], "en"), (None, " ".join(f"word{k % 7} and the other{k % 11}" for k in range(90)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = cp.near_dedup(spark, docs, "").collect()
    assert rows[-1][1] in [r.text for r in kept if r.doc_id is None] and len([r for r in kept if r.doc_id == rows[0][0]]) == 1
    assert cp.near_dedup(spark, docs.limit(0), "").count() == cp.language_id(spark, docs.limit(0), "").count() == 0


def test_clashing_names_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    odd = table(spark, sf, "documents").limit(40).selectExpr("doc_id", "text", "lang", "1 as first", "'x' as digest", "2 as shard", "3 as fp", "'k' as row", "4 as _row", "5 as Pieces", "6 as N", "7 as Mixed", "8 as _Digest", "9 as _KEY", "'c' as Class")
    for name, stage in cp.STAGES:
        out = stage(spark, odd, sf)
        last = name == cp.STAGES[-1][0]  # which replaces columns named as its own, in any case
        names = [c for c in odd.columns if c != "Pieces"] if last else odd.columns
        assert out.columns[: len(names)] == names and 0 < out.count() <= 40, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
