"""Token ids as binary files: frequency-ranked, byte-aligned, of variable length.

An id is written as its rank by falling corpus frequency (ties: smaller id), in
as few whole bytes as the rank needs, little-endian. How many bytes each takes
stands apart, in control bytes: one bit an id where all ranks fit two bytes,
else two bits. Readers look a control byte up in a table of lengths, so that
numpy decodes a block without a loop over ids.

A dataset is a folder: ``ids`` (Parquet: rank, id) and ``files``, whose names
ascend with doc_id. A file is a row of blocks, each followed by a line feed:

    magic "PTK1", control bits u8, documents u32, ids u64, data bytes u64,
    doc ids i64 each, a byte each that is 1 where the id is not null,
    lengths u64 each, control bytes, data bytes

A block holds whole documents and ends at the first that fills it.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

MAGIC = b"PTK1"
HEAD = struct.Struct("<4sBIQQ")
#: Ids of a block, and blocks of a file; a longer document is a block alone.
BLOCK_IDS, FILE_BLOCKS = 1 << 20, 8
#: Ids of a partition that is written, about.
PART_IDS = 1 << 24
#: Pieces whose ids a Python worker remembers, and characters that are encoded at a time, and given to the library at a time.
MEMO_PIECES, SLICE_CHARS, LIBRARY_CHARS = 400_000, 4_000_000, 1_000_000
#: Characters on which Python's and the tokenizer's Unicode tables agree in any version: Latin letters, common punctuation.
PLAIN = [chr(c) for c in (*range(0, 0x1C), *range(0x20, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028), 0x20AC)]


# ---------------------------------------------------------------- encoding


class _Memo(dict):
    """Ids of a piece as bytes; new ones are asked from the library."""

    def __init__(self, ask):
        super().__init__()
        self.ask = ask

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.ask(piece)
        return found


class Encoder:
    """Ids of texts as a tokenizers file gives them, without added special tokens, as little-endian u32 bytes.

    A byte-level BPE splits texts by one pattern and encodes each piece by
    itself. Texts of plain characters are split here, and a piece goes to the
    library's model once; any other text goes to the library whole, and so does
    all with ``pieces=False`` or another kind of file.

    A blank begins a piece unless other white space stands on both sides of it,
    so plain texts are cut at blanks, and of the parts of several texts each is
    split into pieces and looked up once.
    """

    def __init__(self, path: str, pieces: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids = self.library.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.library.to_str())
        before = spec.get("pre_tokenizer") or {}
        known = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.split = None
        if pieces and known and spec["model"]["type"] == "BPE" and not spec.get("normalizer"):
            kinds = {k: "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == k) for k in "LN"}
            letters, numbers = kinds["L"], kinds["N"]
            self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+").findall
            self.plain = re.compile("[" + "".join(map(re.escape, PLAIN)) + "]*").fullmatch
            self.marks = [x["content"] for x in spec["added_tokens"]]
            # A byte's character in the vocabulary: itself where it prints, else the next from 256 on.
            prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [b for b in range(256) if b not in prints]
            shown, tokenize = {b: chr(256 + k) for k, b in enumerate(others)} | {b: chr(b) for b in prints}, self.library.model.tokenize
            blank = shown[32]

            def ask(piece: str) -> bytes:
                named = piece.replace(" ", blank) if piece.isascii() and piece.isprintable() else "".join([shown[b] for b in piece.encode()])
                return array.array("I", [t.id for t in tokenize(named)]).tobytes()

            self.memo = _Memo(ask)

    def shrink(self) -> None:
        """Forgets pieces of more than two ids, which are rarely seen again; all where that leaves over half."""
        short = {p: x for p, x in self.memo.items() if len(x) <= 8}
        self.memo.clear()
        if len(short) <= MEMO_PIECES // 2:
            self.memo.update(short)

    def of_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of plain characters."""
        if not texts:
            return []
        whole = self.memo.__getitem__
        listed = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends, coded = listed.offsets.to_numpy(), listed.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = np.array([not x or x[0].isspace() or x[-1].isspace() for x in parts])
        pieces = self.split("".join([" " + x for x, o in zip(parts, odd.tolist()) if not o]))
        found = [*map(whole, pieces)]
        ids = np.frombuffer(b"".join(found), "<u4")
        # A part's ids are those of its pieces: of one that begins with a blank and of all up to the next.
        first = np.flatnonzero([x[0] == " " for x in pieces])
        until = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        until = until[np.r_[first[1:] - 1, len(found) - 1]] if len(first) else until
        size, start = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        size[~odd], start[~odd] = np.diff(until, prepend=0), np.r_[0, until][:-1]
        # A text's first part has no blank before it and is split by itself.
        heads = codes[ends[:-1]]
        sizes = size[codes]
        sizes[ends[:-1]] = 0
        after = np.cumsum(sizes)
        every = ids[np.repeat(start[codes] - after + sizes, sizes) + np.arange(after[-1])]
        at = np.r_[0, after[ends[1:] - 1]].tolist()
        loose = np.logical_or.reduceat(odd[codes] & ~np.isin(np.arange(len(codes)), ends[:-1]), ends[:-1]).tolist()
        out = []
        for k, (text, head) in enumerate(zip(texts, heads.tolist())):
            by_itself = loose[k] or parts[head][-1:].isspace()
            split = self.split(text if by_itself else parts[head])
            out.append(b"".join(map(whole, split)) + (b"" if by_itself else every[at[k] : at[k + 1]].tobytes()))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, whole = [], []
        for k, text in enumerate(texts):
            (plain if self.split and self.plain(text) and not any(m in text for m in self.marks) else whole).append(k)
        for k, found in zip(plain, self.of_plain([texts[k] for k in plain])):
            out[k] = found
        if self.split and len(self.memo) > MEMO_PIECES:
            self.shrink()
        sizes = np.cumsum([len(texts[k]) for k in whole], dtype=np.int64)
        for some in np.split(np.array(whole, np.int64), np.flatnonzero(np.diff(sizes // LIBRARY_CHARS)) + 1):
            found = self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)
            for k, e in zip(some, found):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, kept from task to task with the pieces that it remembers."""
    return Encoder(path)


# ---------------------------------------------------------------- blocks


def _lengths(bits: int) -> np.ndarray:
    """Of each control byte: the lengths that it names."""
    each = 8 // bits
    return (np.arange(256)[:, None] >> (bits * np.arange(each)) & (1 << bits) - 1).astype(np.int64) + 1


LENGTHS = {1: _lengths(1), 2: _lengths(2)}


def code(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks >= 1 << 8).astype(np.int64) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    each = 8 // bits
    marks = np.zeros(-(-len(ranks) // each) * each, np.uint8)
    marks[: len(ranks)] = size - 1
    control = np.bitwise_or.reduce(marks.reshape(-1, each) << (bits * np.arange(each)).astype(np.uint8), axis=1).astype(np.uint8)
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[at] = ranks & 255
    for k in range(1, 1 << bits):
        some = size > k
        data[at[some] + k] = ranks[some] >> (8 * k) & 255
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes, by table lookup."""
    size = LENGTHS[bits][np.frombuffer(control, np.uint8)].ravel()[:n]
    at, held = np.cumsum(size) - size, np.frombuffer(data, np.uint8)
    out = held[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 1 << bits):
        some = size > k
        if some.any():
            out[some] |= held[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray, bits: int) -> bytes:
    """One block of documents with their ids."""
    joined = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    control, data = code(rank_of[joined], bits)
    return b"".join(
        (
            HEAD.pack(MAGIC, bits, len(ids), len(joined), len(data)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            bytes(x is not None for x in doc_ids),
            np.array([len(x) for x in ids], "<u8").tobytes(),
            control,
            data,
        )
    )


def blocks(content: bytes, ids: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Of each block of a file: doc ids, lengths, and all its ids; ``ids`` has the id of each rank."""
    at = 0
    while at < len(content):
        magic, bits, docs, n, size = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEAD.size
        names = np.frombuffer(content, "<i8", docs, at)
        known = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        lengths = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        marks = -(-n * bits // 8)
        ranks = decode(content[at : at + marks], content[at + marks : at + marks + size], n, bits)
        at += marks + size + 1  # and the line feed
        yield [int(x) if k else None for x, k in zip(names, known)], lengths, ids[ranks]


# ---------------------------------------------------------------- datasets


def _stage(docs: DataFrame, tokenizer: str, end_id: int | None, path: str) -> None:
    """Writes a row for each document with its packed ids, and one for each task with its counts of ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encoder, press = encoder_of(tokenizer), zstandard.ZstdCompressor(level=1)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        counts, place = np.zeros(max(encoder.ids, (end_id or 0) + 1), np.int64), TaskContext.get().partitionId() << 33
        kind = "<u2" if len(counts) <= 1 << 16 else "<u4"
        schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("packed", pa.binary()), ("counts", pa.binary())])

        def rows(names: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal place
            found = [x + end for x in encoder.encode(texts)]
            ids = np.frombuffer(b"".join(found), "<u4")
            counts[:] += np.bincount(ids, minlength=len(counts))
            packed = [press.compress(np.frombuffer(x, "<u4").astype(kind).tobytes()) for x in found]
            columns = [names, range(place, place + len(names)), [len(x) // 4 for x in found], [zlib.crc32(x) for x in found], packed, [None] * len(names)]
            place += len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            names, texts, held, chars = batch.column(0).to_pylist(), batch.column(1), [], 0
            first = 0
            for k in range(batch.num_rows):
                held.append(texts[k].as_py() or "")
                chars += len(held[-1]) + 1
                if chars > SLICE_CHARS or k == batch.num_rows - 1:
                    yield rows(names[first : k + 1], held)
                    first, held, chars = k + 1, [], 0
        some = np.flatnonzero(counts)
        blob = np.stack([some, counts[some]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([*(pa.array([None], f.type) for f in list(schema)[:5]), pa.array([blob], pa.binary())], schema=schema)

    docs.mapInArrow(run, "doc_id long, place long, n_tokens long, crc long, packed binary, counts binary").write.option("compression", "none").parquet(path)


def _ranked(staged: DataFrame) -> DataFrame:
    """rank, id and n of the ids that occur, the most frequent first; at most as many rows as the tokenizer has ids."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids, n = np.frombuffer(blob, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    counted = staged.where("counts is not null").select("counts").mapInArrow(pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counted.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id", "n")


def write(docs: DataFrame, tokenizer: str, path: str, scratch: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", part_ids: int = PART_IDS) -> None:
    """Writes the token ids of ``docs`` as a dataset at ``path``, in ascending id order.

    Each text is encoded once, into a table at ``scratch`` that also holds each
    task's counts of ids; the counts give the ranks, and the packed ids are
    dealt by ranges of id, content and place, so neither a repeated id nor many
    copies of a row meet in one task. Ids are integers; null ids come first,
    equal ids are ordered by length, digest and place. A null text is empty:
    it has ``end_id`` alone, or nothing. A text of any length is held whole by
    one task. An empty table gives files without a block. Other columns are ignored.
    """
    spark = docs.sparkSession
    _stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, end_id, scratch)
    staged = spark.read.parquet(scratch)
    _ranked(staged).select("rank", "id").coalesce(1).write.parquet(f"{path}/ids")
    ids = ids_of(spark, path)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    bits = 1 if len(ids) <= 1 << 16 else 2
    packed = np.dtype("<u2" if max(Encoder(tokenizer, pieces=False).ids, (end_id or 0) + 1) <= 1 << 16 else "<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block(names, held, rank_of, bits)], pa.binary())], names=["block"])

        for batch in batches:
            for name, blob in zip(batch.column("doc_id").to_pylist(), batch.column("packed")):
                names.append(name)
                held.append(np.frombuffer(unpress.decompress(blob.as_py()), packed))
                total += len(held[-1])
                if total >= BLOCK_IDS:
                    yield full()
                    names, held, total = [], [], 0
        if names:
            yield full()

    rows = staged.where("counts is null").select("doc_id", "n_tokens", "crc", "place", "packed")
    parts = max(1, -(-int(rows.agg(F.sum("n_tokens")).first()[0] or 0) // part_ids))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "n_tokens", "crc", "place")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "packed")
    # The text sink writes a string's bytes as they are, and a line feed.
    placed.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/files")


def ids_of(spark: SparkSession, path: str) -> np.ndarray:
    """The id of each rank of a dataset."""
    return np.array([r.id for r in spark.read.parquet(f"{path}/ids").orderBy("rank").collect()], np.int64)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a dataset, from its files: doc_id, start (ids of all before it), n_tokens, ids_crc32, ids (little-endian u32 bytes).

    A file is read whole by one task; starts come from the sums of the files
    before, in three levels, so no task sees all files of a large dataset.
    """
    found = _decoded(spark, path, with_ids=True)
    return found.join(_before(found), ["part", "chunk"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """As ``read`` without the ids: files are decoded once, and what is kept of a document is cut off."""
    found = cut(_decoded(spark, path, with_ids=False))
    return found.join(_before(found), ["part", "chunk"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    ids = ids_of(spark, path).astype("<u4")
    fields = [("part", pa.int64()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                # The sink names files by partition and by number within it.
                part, chunk = map(int, re.search(r"part-(\d+)-[^/]*?c(\d+)\.txt$", batch.column("path")[k].as_py()).groups())
                at = 0
                for names, lengths, all_ids in blocks(batch.column("content")[k].as_py(), ids):
                    ends = np.cumsum(lengths)
                    each = [all_ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                    columns = [[part] * len(names), [chunk] * len(names), names, at + ends - lengths, lengths, [zlib.crc32(x) for x in each], each]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                    at += len(all_ids)

    files = spark.read.format("binaryFile").load(f"{path}/files").select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{n} {'binary' if t == pa.binary() else 'long'}" for n, t in zip(schema.names, schema.types)))


def _before(found: DataFrame) -> DataFrame:
    """Of each file: the ids in all files before it."""

    def ahead(*keys: str):
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    files = found.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).withColumn("many", F.floor(F.col("part") / 1000))
    groups = parts.groupBy("many").agg(F.sum("n").alias("n")).select("many", ahead("many").alias("first"))
    starts = parts.select("part", "many", ahead("many", "part").alias("second")).join(groups, "many")
    third = files.select("part", "chunk", ahead("part", "chunk").alias("third"))
    return third.join(starts, "part").select("part", "chunk", (F.col("first") + F.col("second") + F.col("third")).alias("before"))
