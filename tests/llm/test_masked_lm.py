from collections import Counter

import numpy as np

from plumbline.llm import masked_lm as lm
from plumbline.llm.common import crc_mod, table


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(lm.FREQUENT + 30)]
    v = lm.Vocabulary(words, list(range(len(words), 0, -1)), 50)
    weights = [w.astype(float) + rng.normal(size=w.shape) * 0.05 for w in v.first_weights()]
    return rng, v, weights


def test_gradient_and_probabilities():
    rng, v, weights = small_model()
    n = len(v.row)
    assert v.edge == n and (np.bincount(v.row[v.row >= 0]) == 1).all() and v.blocks * v.size >= 30
    ids = rng.integers(0, n, 200).astype(np.int32)
    around = lm.contexts(ids, v.edge)
    assert around[0].tolist() == [v.edge, v.edge, ids[1], ids[2]] and around[-1].tolist() == [ids[-3], ids[-2], v.edge, v.edge]
    every = np.stack([lm.log_probabilities(v, weights, around, np.full(200, k)) for k in range(n)], axis=1)
    assert np.allclose(np.exp(every).sum(axis=1), 1)
    loss = lambda w: -lm.log_probabilities(v, w, around, ids).mean()
    trainer = lm.Trainer(v, weights)
    trainer.seen = [np.ones_like(w) * 1e30 for w in weights]  # the step is then the gradient, scaled
    trainer.step(around, ids)
    places = [(0, (int(ids[3]), 2)), (1, (5, 7)), (2, (3,)), (3, (4, int(v.output[ids[0]]))), (3, (lm.HIDDEN, int(v.output[ids[1]]))), (4, (7, 3)), (4, (11, lm.INNER))]
    for k, place in places:
        up, down = [[w.copy() for w in weights] for _ in range(2)]
        up[k][place] += 1e-4
        down[k][place] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        trained = lm.Trainer(v, weights)
        trained.seen = [np.ones_like(w) for w in weights]
        trained.step(around, ids)
        step = (weights[k][place] - trained.weights[k][place]) / lm.RATE
        assert np.isclose(step * np.sqrt(1 + slope * slope), slope, rtol=1e-3, atol=1e-7), (k, place)


def test_scores_prefer_natural_text_and_equal_plain(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = lm.fit(docs.repartition(3))
    other_layout = lm.fit(docs.repartition(11))
    v = model[0].vocabulary
    assert v.ids == other_layout[0].vocabulary.ids and len(v.ids) > 400
    assert all(np.allclose(a, b, rtol=1e-4, atol=1e-5) for a, b in zip(model[1], other_layout[1]))
    pick = lambda lang: [r.text for r in docs.where(f"lang = '{lang}' AND n_chars BETWEEN 800 AND 3000").orderBy("doc_id").limit(60).collect()]
    sample, other = pick("en"), pick("de")
    # the same words score lower among words of another language
    mixed = [" ".join(w for pair in zip(a.split(), b.split()) for w in pair) for a, b in zip(sample, other)]
    apart = [(" ".join(a.split()[:n]), " ".join(b.split()[:n])) for a, b in zip(sample, other) for n in [min(len(a.split()), len(b.split()))]]
    both = [lm.score_texts([*x, m], *model)[1] for x, m in zip(apart, mixed)]
    assert np.mean([s[0] + s[1] > s[2] for s in both]) > 0.95
    read = lm.Reader(model[0])
    for t in ("one", "the of and", "wörter 🔥 the the", sample[0]):
        i, spelled = read(t)
        padded = [v.edge] * 2 + i.tolist() + [v.edge] * 2
        w, total = model[1], spelled
        for k in range(len(i)):
            x = np.concatenate([w[0][padded[k + d]] for d in (0, 1, 3, 4)]).astype(float)
            h = np.r_[np.tanh(x @ w[1] + w[2]), 1]
            z = h @ w[3]
            total += z[v.output[i[k]]] - z.max() - np.log(np.exp(z - z.max()).sum())
            if v.row[i[k]] >= 0:
                b = v.row[i[k]] // v.size
                z = h[lm.HIDDEN - lm.INNER :] @ w[4][b * v.size : (b + 1) * v.size].T
                total += z[v.row[i[k]] % v.size] - z.max() - np.log(np.exp(z - z.max()).sum())
        assert np.isclose(lm.score_texts([t], *model)[1][0], total, rtol=1e-4)


def test_held_out_text_is_likelier_than_by_word_counts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    counts, weights = lm.fit(docs.where(crc_mod("doc_id", 5) != 0))
    held = [r.text or "" for r in docs.where(crc_mod("doc_id", 5) == 0).collect()]
    n, with_context = lm.score_texts(held, counts, weights)
    still = counts.vocabulary.first_weights()
    still[0][:] = 0
    by_counts = lm.score_texts(held, counts, still)[1]
    assert with_context.sum() / n.sum() > by_counts.sum() / n.sum() + 0.2


def test_packing():
    for ids in ([], [1, 65_535], [3, 65_536, 1], [1 << 20]):
        assert lm.unpacked(lm.packed(np.array(ids, np.int32))).tolist() == ids


def test_copies_train_once_and_all_rows_are_scored(spark):
    docs = spark.createDataFrame([(k, ("a b c d", "e f", "")[k % 3]) for k in range(90)], "doc_id long, text string").repartition(7)
    counts = lm.count_words(docs)
    rows = lm.encoded(docs, counts)
    trained = rows.where("NOT spare").dropDuplicates(["shard", "digest"]).collect()
    assert sorted(len(lm.unpacked(r.ids)) for r in trained) == [2, 4] and rows.count() == 90
    once = lm.encoded(docs.dropDuplicates(["text"]), counts)
    assert all(np.allclose(a, b) for a, b in zip(lm.train(rows, counts), lm.train(once, counts)))
    got = {r.doc_id: (r.n_tokens, r.pll) for r in lm.fit_and_score(docs).collect()}
    want = {r.doc_id: (r.n_tokens, r.pll) for r in lm.score(docs, lm.fit(docs)).collect()}
    assert sorted(got) == sorted(want) == list(range(90))
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], rtol=1e-4) for k in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "tail " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pll")
    model = lm.fit(docs)
    got = lm.score(docs, model).collect()
    assert [r.n_tokens for r in sorted(got, key=str)] == [0, 0, 2, 2, 20_000]
    assert all(r.pll == 0 and r.pll_per_token is None for r in got if r.n_tokens == 0) and all(r.pll < 0 for r in got if r.n_tokens)
    none = docs.limit(0)
    assert lm.score(none, lm.fit(none)).count() == 0 == lm.fit_and_score(none).count()
    both = lm.fit_and_score(docs)
    assert both.columns == ["doc_id", "n_tokens", "pll", "pll_per_token"] and sorted(r.n_tokens for r in both.collect()) == [0, 0, 2, 2, 20_000]


def test_every_position_is_masked_once():
    for sizes in ((1, 0, 3, 2), (1, 7, 5000, 0, 2, 300, 2500, 9)):
        place = iter(range(sum(sizes)))
        docs = [np.array([next(place) for _ in range(n)], np.int32) for n in sizes]
        found = [(x, y) for r in range(lm.ROUNDS) for x, y in lm.masked_batches(iter(docs), r, lm.ROUNDS, 99_999)]
        assert all(0 < len(y) <= 1.5 * lm.BATCH for _, y in found)
        ids = np.concatenate([y for _, y in found])
        assert sorted(ids.tolist()) == list(range(sum(sizes)))
        around = dict(zip(ids.tolist(), np.concatenate([x for x, _ in found]).tolist()))
        assert all(around[k] == c for d in docs if len(d) for k, c in zip(d.tolist(), lm.contexts(d, 99_999).tolist()))


def test_most_frequent_words(spark):
    rows = [("a", 5000), ("b", 3000), ("c", 40), ("d", 7), ("e", 7), ("f", 7), ("g", 1)]
    counted = spark.createDataFrame(rows, "word string, n long")
    for size, want in ((99, "abcdefg"), (6, "abcdef"), (5, "abc"), (3, "abc"), (2, "ab"), (1, "a"), (0, "")):
        assert "".join(w for w, _ in lm.most_frequent(counted, size)) == want
    assert lm.most_frequent(counted.limit(0), 5) == []


def test_logits_are_cut_only_where_they_could_be_too_large(monkeypatch):
    rng, v, weights = small_model()
    ids = rng.integers(0, len(v.row), 300).astype(np.int32)
    around = lm.contexts(ids, v.edge)
    assert lm._exceed(weights)[0] is False
    plain, whole = lm._exceed, []
    for clip in (plain(weights), (True, True)):
        monkeypatch.setattr(lm, "_exceed", lambda w, clip=clip: clip)
        trainer = lm.Trainer(v, weights)
        for _ in range(3):
            trainer.step(around, ids)
        whole.append([*trainer.weights, lm.log_probabilities(v, trainer.weights, around, ids)])
    assert all(np.array_equal(a, b) for a, b in zip(*whole))
    monkeypatch.setattr(lm, "_exceed", plain)
    weights[3][2, 5], weights[4][3, 1] = 900, 900
    assert plain(weights) == (True, True)
    trainer = lm.Trainer(v, weights)
    trainer.step(around, ids)
    assert all(np.isfinite(w).all() for w in trainer.weights) and np.isfinite(lm.log_probabilities(v, weights, around, ids)).all()


def test_words_are_met_once_a_slice_and_ids_stay_exact(spark):
    big = (1 << 53) + 1
    rows = [(big, "Straße two two \x85 qqq\u2003qqq"), (None, "two qqq"), (big + 2, None), (big + 4, "two qqq"), (big + 6, " \n"), (big + 8, "ΣΑΣ \x00 " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words = Counter(w for _, t in rows for w in (t or "").lower().split())
    parts = lm.split_texts(docs).collect()
    assert len(parts) == 1 and dict(zip(parts[0].words.split(" "), parts[0].n)) == words
    counts = lm.count_words(docs)
    assert counts.tokens == sum(words.values()) and set(counts.vocabulary.ids) == set(words)
    few = lm.Counts(lm.Vocabulary(["two"], [4], 9), counts.spelling, counts.tokens)
    read = lm.Reader(few)
    got = {r.doc_id: r for r in lm.encoded(docs, few).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        ids, spelled = read(t or "")
        assert lm.unpacked(got[i].ids).tolist() == ids.tolist() and np.isclose(got[i].spelled, spelled)
    model = lm.fit(docs)
    for scored in (lm.fit_and_score(docs), lm.score(docs, model)):
        assert {r.doc_id: r.n_tokens for r in scored.collect()} == {i: len((t or "").split()) for i, t in rows}
