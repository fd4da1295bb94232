import random

import public_tokenizers

from plumbline.llm import common
from plumbline.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every_path(lattice, text):
    """All segmentations of " " + text, best first: (score, ids)."""
    full = " " + text

    def walk(at):
        if at == len(full):
            yield 0.0, ()
            return
        for end in range(at + 1, min(len(full), at + lattice.longest) + 1):
            i = lattice.ids.get(full[at:end])
            if i is not None:
                for s, ids in walk(end):
                    yield s + lattice.scores[i], (i, *ids)
            elif end == at + 1:
                for s, ids in walk(end):
                    yield s + lattice.unknown, (*[lattice.bytes[b] for b in full[at:end].encode()], *ids)

    return sorted(walk(0), key=lambda x: -x[0])


def test_n_best_equals_all_paths():
    lattice, rnd = sp.Lattice(PATH), random.Random(4)
    cases = ["a", "the cat", "  x", "ñu\n", "🔥 é", "to be", "aaaa", " ", "x ▁y", "▁"]
    cases += ["".join(rnd.choice("the an\nß🔥") for _ in range(rnd.randint(1, 11))) for _ in range(60)]
    for text in cases:
        paths = every_path(lattice, text)
        for n in (1, 2, 4, 9):
            score, ids, others = lattice.encode(text, n)
            got = [(score, tuple(ids.tolist())), *[(o["score"], tuple(sp.apply_edits(ids.tolist(), o["edits"]))) for o in others]]
            assert [s for s, _ in got] == [s for s, _ in paths[:n]], text
            assert len(set(got)) == len(got) and set(got) <= set(paths)
            assert all(lattice.decode(x) == text for _, x in got)


def test_library_decodes_our_pieces_and_long_units_work():
    import sentencepiece

    lattice, model = sp.Lattice(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ["Hello world", "  two  blanks ", "a\nb\tc", "🔥é", "x" * 20_000]:
        score, ids, _ = lattice.encode(text)
        assert model.decode(ids.tolist()) == text == lattice.decode(ids)
        assert score >= sum(lattice.scores[i] if i > 258 or i < 3 else lattice.unknown for i in model.encode(text))


def test_columns(spark):
    rows = [(1, "Das ist ein Test", "k"), (2, None, "k"), (3, "", "k"), (4, "wörter " * 5000, "k"), (1, "Das ist ein Test", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    out = sp.encode(docs, PATH).withColumn("back", sp.decode(PATH)("pieces")).collect()
    assert len(out) == 5 and all(r.back == (r.text or "") for r in out)
    assert all((len(r.pieces) == 0) == (not r.text) and len(r.piece_alternatives) == (3 if r.text else 0) for r in out)
    assert sp.encode(docs.limit(0), PATH).count() == 0


def test_long_units_without_blanks_take_bounded_memory():
    import base64
    import tracemalloc

    lattice, rnd = sp.Lattice(PATH), random.Random(9)
    cjk = "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(20_000))
    for text in (cjk, base64.b64encode(rnd.randbytes(20_000)).decode()):
        tracemalloc.start()
        score, ids, others = lattice.encode(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert lattice.decode(ids.tolist()) == text and peak < 60e6
        assert all(o["score"] <= score for o in others) and [o["score"] for o in others] == sorted((o["score"] for o in others), reverse=True)


def test_learned_scores(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",), (None,), ("the dog",)] * 5, "text string")
    scores = sp.learned_scores(docs, PATH)
    lattice = sp.Lattice(PATH, scores)
    assert abs(sum(2.718281828459045**s for s in scores.values()) - 1) < 1e-6
    assert scores[lattice.ids[" the"]] == max(scores.values())
    row = sp.encode(docs.limit(1), PATH, scores=scores).first()
    assert lattice.decode(row.pieces) == "the cat sat on the mat" and len(row.pieces) == 6
    assert len(set(sp.learned_scores(docs.limit(0), PATH).values())) == 1


def test_batches_are_cut_without_copies_and_workers_give_memory_back(spark, monkeypatch):
    batch = sp.pa.RecordBatch.from_pydict({"text": ["a" * 30, None, "b" * 200, "", "c"] * 40, "k": list(range(200))})
    cut = list(sp.parts(batch, 0, 100))
    assert [k for part in cut for k in part.column(1).to_pylist()] == list(range(200))
    assert all(part.num_rows == 1 or sum(len(t or "") + 1 for t in part.column(0).to_pylist()) <= 100 for part in cut)
    assert {part.column(0).buffers()[2].address for part in cut} == {batch.column(0).buffers()[2].address}
    assert list(sp.parts(batch.slice(0, 0), 0)) == []
    given = []
    monkeypatch.setattr("plumbline.llm.common.trim", lambda: given.append(1))
    assert list(common.trimmed(lambda x: x)(iter([1, 2]))) == [1, 2] and given == [1]
