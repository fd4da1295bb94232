"""Token files against the library, and their coding against itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces that the pattern treats in its own ways, and texts that must go to the library whole.
ODD = ["it's", "don't'", "''s", "!!'S", " 12345", "ñandú", "İI", "straße", "é", "ﬁ", "漢字", "🔥🔥", "<|endoftext|>", "<|endof", "\x1c", " ", "\xa0", "—", "ª", "²", "\t\n", "a_b", "\r\n\n  x", "ͅ"]


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def library():
    return token_files.Encoder(PATH, pieces=False).library


def test_pieces_give_the_library_s_ids(library):
    draw = random.Random(3)
    batch = ["".join(draw.choice(ODD) + draw.choice(["", " ", "  "]) for _ in range(draw.randint(0, 40))) for _ in range(500)] + ["", " ", "x" * 5000, "".join(token_files.PLAIN)]
    fast = token_files.Encoder(PATH)
    assert fast.split
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode(batch)] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_parts_of_a_batch_are_looked_up_once(library):
    draw = random.Random(5)
    words = ["it's", "12345", "ñandú", "!!'S", "a_b", "word,", "end.\nNew", "\n", "\x85", "a\t", "\xa0b", "\n\n x", "a\n \n b", ""]
    batch = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) for _ in range(3000)] + [" ", "  ", "a ", "a  ", "   a", "\x85 a", "漢字"]
    fast = token_files.Encoder(PATH)
    looked, split = [], fast.split
    fast.split = lambda text: looked.append(text) or split(text)
    want = [library.encode(t, add_special_tokens=False).ids for t in batch]
    assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode(batch)] == want
    assert [np.frombuffer(y, "<u4").tolist() for x in batch for y in fast.encode([x])] == want
    looked.clear()
    assert len(fast.encode(["a common word, " * 50 + "a common word"] * 200)) == 200
    assert sum(map(len, looked)) < 2000  # of 152,600 characters, those of texts' first parts and of distinct ones


@pytest.mark.parametrize("bits", [1, 2])
def test_coding_is_undone(bits):
    draw = np.random.default_rng(1)
    top = 16 if bits == 1 else 32
    for n in (0, 1, 3, 4, 7, 8, 9, 1000):
        ranks = (2 ** draw.uniform(0, top, n) - 1).astype(np.uint32)
        ranks[: n // 10] = 2**top - 1
        control, data = token_files.code(ranks, bits)
        assert len(control) == -(-n * bits // 8) and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
        assert (token_files.decode(control, data, n, bits) == ranks).all()


def written(spark, tmp_path, docs, **more):
    path = f"file://{tmp_path}/files"
    token_files.write(docs, PATH, path, f"file://{tmp_path}/ids", 2, **more)
    return path


def test_files_hold_documents_in_order(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 2)
    rows = [(k * 7 % 101, f"text {k} " * (k % 9)) for k in range(101)] + [(200, None), (-5, ""), (None, "no id"), (None, None), (300, "long " * 20_000)]
    rows += [(50, "copy of one row")] * 40 + [(50, "another text of that id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("Place", "packed", "counts", "IDS", "crc")}).repartition(7)
    path = written(spark, tmp_path, docs, part_ids=300)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=str) == sorted(((i, ids_of(library, t)) for i, t in rows), key=str)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    names = [r.doc_id for r in got]
    assert names[:2] == [None, None] and names[2:] == sorted(names[2:])
    assert sorted(map(tuple, token_files.scan(spark, path).collect()), key=str) == sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str)
    counts = np.bincount([x for _, t in rows for x in ids_of(library, t)])
    ranked = token_files.ids_of(spark, path)
    assert ranked.tolist() == sorted(np.flatnonzero(counts).tolist(), key=lambda x: (-counts[x], x))


def test_table_without_rows(spark, tmp_path):
    path = written(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string"))
    assert token_files.scan(spark, path).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_query(spark, sf, library):
    folder = f"/root/testdata/sf{sf}"
    want, at = [], 0
    for r in sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = ids_of(library, r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = queries.op11_token_files(spark, folder)
    assert dict(found.dtypes) == {c: "bigint" for c in ("doc_id", "start", "n_tokens", "ids_crc32")}
    assert sorted(map(tuple, found.collect())) == want
