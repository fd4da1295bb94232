"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from the ``SIDE`` tokens on
both sides; a document's score is the sum of those conditional log-probabilities.

A token is a white-space separated, lower-cased word. The vocabulary holds the
corpus's most frequent words, about as many as the square root of its tokens, so
it grows with the corpus. The output is hierarchical: the most frequent words are
classes of their own, the others stand in blocks of words with like endings, and
the network predicts first the class or block, then the word within its block.
The vocabulary is open: any other word belongs to a class by the hash of its
ending and is spelled, character by character, by bigram counts:
``log P(word | context) = log P(class | context) + log P(spelling | class)``.

All documents take part in counting and in training. Distinct texts are dealt
into shards by a digest and stand in its order there, whatever the layout of the
input. Each shard trains the network on its texts from the common weights; the
shards' weights are averaged, weighted by their tokens, once a round. The rounds
share the positions out, so that every position is masked and predicted once.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from plumbline.llm.common import cut, trimmed

#: Words that are classes of their own, classes of endings, and the most words with a place in the model (others are spelled).
FREQUENT, ENDINGS, MOST_WORDS = 64, 30, 1 << 17
#: Words of the vocabulary a square root of the tokens.
WORDS_A_ROOT = 2
#: Tokens on each side; numbers of a word, of the hidden layer, and of that layer's end from which a word within its block is predicted.
SIDE, WIDTH, HIDDEN, INNER = 2, 16, 32, 8
ROUNDS, RATE, BATCH, SEED = 2, 0.15, 16_384, 3
#: Rows of a batch whose outputs are held at once, so that they stay near the processor; and the largest logit.
AT_ONCE, MOST_LOGIT = 1024, 60.0
#: Tokens of a training shard, about.
SHARD_TOKENS = 1 << 22
#: Distinct texts that a task remembers while it reads, so as to pass on copies once.
SEEN_TEXTS = 1 << 20
TOKENS_AT_ONCE = 32_768
#: Bytes of text whose words are numbered together, about.
SLICE_CHARS = 8_000_000
#: Rows of spelling counts: a hashed previous character by a hashed next one, per ending class.
CHARS = 128
PART = 4096


def ending_class(ending: str) -> int:
    return zlib.crc32(ending.encode("utf-8", "surrogatepass")) % ENDINGS


class Endings(dict):
    """Classes of word endings, made when first seen."""

    def __missing__(self, ending: str) -> int:
        k = self[ending] = ending_class(ending)
        return k


def spelled_cells(words: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (ending class, previous, next character) of the words' spellings, edges included, and the word of each cell.

    Characters are numbered 1 to 127 (hashed beyond ASCII), a word's edge is 0.
    """
    joined = "\0" + "\0".join(words) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.zeros(len(codes), bool)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    edge[np.r_[0, np.cumsum(lengths + 1)]] = True
    numbers = np.where(edge, 0, 1 + codes % (CHARS - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    return (classes[owner].astype(np.int64) * CHARS + numbers[:-1]) * CHARS + numbers[1:], owner


class Vocabulary:
    """Places of the words in the network's input and output.

    Ids: words by falling count, then the classes of endings, then the text's
    edge. Outputs: the first ``FREQUENT`` words, the blocks, the endings.
    """

    def __init__(self, words: list[str], counts: list[int], spelled: int = 1):
        self.ids = {w: k for k, w in enumerate(words)}
        n = len(words)
        self.own = min(FREQUENT, n)
        tail = sorted(range(self.own, n), key=lambda k: words[k][::-1])
        self.blocks = math.isqrt(len(tail))
        self.size = -(-len(tail) // self.blocks) if self.blocks else 0
        self.edge, self.outputs = n + ENDINGS, self.own + self.blocks + ENDINGS
        #: Output of each id, and its place among the rows of all blocks (-1: none).
        self.output = np.r_[np.arange(self.own), np.zeros(n - self.own, int), self.own + self.blocks + np.arange(ENDINGS)].astype(np.int32)
        self.row = np.full(n + ENDINGS, -1, np.int64)
        for place, k in enumerate(tail):
            self.output[k], self.row[k] = self.own + place // self.size, place
        seen = np.r_[np.array(counts, float), np.full(ENDINGS, max(spelled, 1) / ENDINGS)]
        self.output_counts = np.bincount(self.output, seen, self.outputs)
        self.row_counts = np.zeros(self.blocks * self.size)
        self.row_counts[self.row[self.row >= 0]] = seen[self.row >= 0]

    @property
    def shapes(self) -> tuple[tuple[int, ...], ...]:
        """Words, inputs to hidden, hidden's bias, hidden and 1 to outputs, end of hidden and 1 to places."""
        return ((self.edge + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN + 1, self.outputs), (self.blocks * self.size, INNER + 1))

    def first_weights(self) -> list[np.ndarray]:
        """Random inputs; outputs begin at the words' shares, so places that hold no word have no probability."""
        rng, shapes = np.random.default_rng(SEED), self.shapes
        outputs, places = rng.normal(size=shapes[3]) * 0.1, rng.normal(size=shapes[4]) * 0.1
        outputs[-1] = np.log(self.output_counts + 1)
        places[:, -1] = np.where(self.row_counts > 0, np.log(np.maximum(self.row_counts, 1)), -1e4)
        for part in (outputs[-1], places[:, -1]):  # within the largest logit
            part -= max(0.0, part.max(initial=0.0) - MOST_LOGIT / 2)
        weights = [rng.normal(size=shapes[0]) * 0.3, rng.normal(size=shapes[1]) / np.sqrt(shapes[1][0]), np.zeros(shapes[2]), outputs, places]
        return [w.astype(np.float32) for w in weights]


@dataclass
class Counts:
    """The vocabulary, log-probabilities of spellings, and the corpus's tokens."""

    vocabulary: Vocabulary
    spelling: np.ndarray
    tokens: int


class Reader:
    """Texts to ids and to the log-probability of the spellings of words without an id of their own."""

    def __init__(self, counts: Counts):
        self.known, self.endings, self.table = counts.vocabulary.ids, Endings(), counts.spelling.ravel()
        self.words = len(self.known)

    def __call__(self, text: str) -> tuple[np.ndarray, float]:
        ids, logs = self.words_of(text.lower().split())
        return ids, float(logs.sum())

    def words_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and the log-probability of each one's spelling (0 for a word of the vocabulary)."""
        ids, logs = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words)), np.zeros(len(words))
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            spelled = [words[i] for i in rare.tolist()]
            classes = np.array([self.endings[w[-2:]] for w in spelled], np.int32)
            ids[rare] = self.words + classes
            cells, owner = spelled_cells(spelled, classes)
            logs[rare] = np.bincount(owner, self.table[cells], len(rare))
        return ids, logs


def contexts(ids: np.ndarray, edge: int, first: int = 0, step: int = 1) -> np.ndarray:
    """(n, 2 * SIDE) ids around each ``step``-th position from ``first`` on, the edge beyond the text."""
    padded = np.full(len(ids) + 2 * SIDE, edge, np.int32)
    padded[SIDE : SIDE + len(ids)] = ids
    out = np.empty((len(range(first, len(ids), step)), 2 * SIDE), np.int32)
    for k in range(2 * SIDE):
        out[:, k] = padded[k + (k >= SIDE) + first : k + (k >= SIDE) + len(ids) : step]
    return out


def hidden_of(weights: list[np.ndarray], around: np.ndarray, seen: np.ndarray | None = None, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What is seen around each position, and the hidden layer with a last column of ones; into ``seen`` and ``hidden`` if given."""
    kind = weights[0].dtype
    seen = np.empty((len(around), 2 * SIDE * WIDTH), kind) if seen is None else seen
    hidden = np.empty((len(around), HIDDEN + 1), kind) if hidden is None else hidden
    np.take(weights[0], around.ravel(), axis=0, out=seen.reshape(-1, WIDTH), mode="clip")
    inner = seen @ weights[1]
    inner += weights[2]
    hidden[:, :HIDDEN] = np.tanh(inner, out=inner)
    hidden[:, HIDDEN] = 1
    return seen, hidden


@dataclass
class Inside:
    """Positions whose word stands in a block, block by block, their rows, and (from, to, block) of the blocks among them, about ``AT_ONCE`` positions together."""

    at: np.ndarray
    rows: np.ndarray
    groups: list[list[tuple[int, int, int]]]


def _inside(vocabulary: Vocabulary, rows: np.ndarray) -> Inside:
    at = np.flatnonzero(rows >= 0)
    block = rows[at] // max(1, vocabulary.size)
    order = np.argsort(block.astype(np.uint16) if vocabulary.blocks < 1 << 16 else block, kind="stable")
    at, block = at[order], block[order]
    groups, edges = [], np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]).tolist() if len(block) else []
    for a, b in zip(edges, edges[1:]):
        if not groups or b - groups[-1][0][0] > AT_ONCE:
            groups.append([])
        groups[-1].append((a, b, int(block[a])))
    return Inside(at, rows[at], groups)


def _errors(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Makes of rows of exp, at each row's ``own``, what differs from a sure guess of it; returns the rows' sums."""
    total = x @ np.ones(x.shape[1], x.dtype)
    x.ravel()[np.arange(0, x.size, x.shape[1]) + own] -= total
    return total


def _exceed(weights: list[np.ndarray]) -> tuple[bool, bool]:
    """Whether a logit of the outputs, or of the places in blocks, could be over the largest: no hidden unit is beyond one."""
    outputs, places = weights[3], weights[4]
    high = (outputs[-1] + np.abs(outputs[:-1]).sum(axis=0)).max(initial=0.0), (places[:, -1] + np.abs(places[:, :-1]) @ np.ones(INNER, places.dtype)).max(initial=0.0)
    return bool(high[0] > MOST_LOGIT), bool(high[1] > MOST_LOGIT)


def _exp(x: np.ndarray, clip: bool) -> np.ndarray:
    return np.exp(np.minimum(x, MOST_LOGIT, out=x) if clip else x, out=x)


def _log_share(x: np.ndarray, own: np.ndarray, clip: bool) -> np.ndarray:
    """Logarithm of each row's share of exp(x) at ``own``; uses up ``x``."""
    mine = np.minimum(x[np.arange(len(own)), own], MOST_LOGIT)
    return mine - np.log(_exp(x, clip) @ np.ones(x.shape[1], x.dtype))


def log_probabilities(vocabulary: Vocabulary, weights: list[np.ndarray], around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log P(class | context), and of the word within its block, of each position."""
    n, kind = len(ids), weights[3].dtype
    logs, ends, clip = np.empty(n), np.empty((n, INNER + 1), kind), _exceed(weights)
    for at in range(0, n, AT_ONCE):
        part = slice(at, at + AT_ONCE)
        hidden = hidden_of(weights, around[part])[1]
        ends[part] = hidden[:, HIDDEN - INNER :]
        logs[part] = _log_share(hidden @ weights[3], vocabulary.output[ids[part]], clip[0])
    inside, size = _inside(vocabulary, vocabulary.row[ids]), vocabulary.size
    own, more = ends[inside.at], np.empty(len(inside.at))
    for group in inside.groups:
        first, last = group[0][0], group[-1][1]
        q = np.empty((last - first, size), kind)
        for a, b, k in group:
            np.matmul(own[a:b], weights[4][k * size : (k + 1) * size].T, out=q[a - first : b - first])
        more[first:last] = _log_share(q, inside.rows[first:last] % size, clip[1])
    logs[inside.at] += more
    return logs


class Trainer:
    """Adagrad on masked positions; of words and blocks only what a batch touches moves."""

    def __init__(self, vocabulary: Vocabulary, weights: list[np.ndarray]):
        self.vocabulary, self.weights = vocabulary, [w.copy() for w in weights]
        self.seen = [np.full_like(w, 1e-3) for w in weights]
        self.rooms: dict[str, np.ndarray] = {}

    def _move(self, k: int, gradient: np.ndarray, rows=slice(None)) -> None:
        square = self.seen[k][rows] + gradient * gradient
        self.seen[k][rows] = square
        gradient *= RATE
        gradient /= np.sqrt(square, out=square)
        self.weights[k][rows] -= gradient

    def _room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """Space that is used again from batch to batch."""
        held = self.rooms.get(name)
        if held is None or held.size < rows * columns:
            held = self.rooms[name] = np.empty(rows * columns, self.weights[3].dtype)
        return held[: rows * columns].reshape(rows, columns)

    def step(self, around: np.ndarray, ids: np.ndarray) -> None:
        w, n, v = self.weights, len(ids), self.vocabulary
        clip, outs = _exceed(w), v.output[ids]
        seen, hidden, words = self._room("seen", n, 2 * SIDE * WIDTH), self._room("hidden", n, HIDDEN + 1), self._room("words", n, 2 * SIDE * WIDTH)
        parts = [slice(at, min(n, at + AT_ONCE)) for at in range(0, n, AT_ONCE)]
        for part in parts:
            hidden_of(w, around[part], seen[part], hidden[part])
        # The error of each logit is (share of exp - 1 if it is the word's own) / n; what multiplies a row waits for the narrow products.
        inside, into = _inside(v, v.row[ids]), self._room("into", n, INNER + 1)
        into[:] = 0
        into[inside.at] = self._step_in_blocks(inside, hidden[inside.at, HIDDEN - INNER :], n, clip[1])
        back_to = np.ascontiguousarray(w[3][:HIDDEN].T)
        outputs, first, bias = np.zeros_like(w[3].T), np.zeros_like(w[1].T), np.zeros_like(w[2])
        for part in parts:
            h, o = hidden[part], outs[part]
            x = _exp(np.matmul(h, w[3], out=self._room("logits", len(o), w[3].shape[1])), clip[0])
            share = (1 / (n * _errors(x, o)))[:, None]
            outputs += x.T @ (h * share)
            back = x @ back_to
            back *= share
            back[:, HIDDEN - INNER :] += into[part, :INNER]
            back *= 1 - h[:, :HIDDEN] ** 2
            first += back.T @ seen[part]
            bias += back.sum(axis=0)
            np.matmul(back, w[1].T, out=words[part])
        # Two numbers of a word move at once, as the parts of a complex one.
        flat, moves = around.ravel(), np.zeros((WIDTH // 2, v.edge + 1), np.result_type(words.dtype, np.complex64))
        each = words.view(moves.dtype).reshape(-1, WIDTH // 2)
        for k in range(WIDTH // 2):
            np.add.at(moves[k], flat, each[:, k])
        some = np.flatnonzero(np.bincount(flat, minlength=v.edge + 1))
        for k, g in ((1, first.T), (2, bias), (3, outputs.T)):
            self._move(k, g)
        self._move(0, np.ascontiguousarray(moves[:, some].T).view(words.dtype), some)

    def _step_in_blocks(self, inside: Inside, own: np.ndarray, n: int, clip: bool) -> np.ndarray:
        """Moves the places in blocks; what the errors there mean for each position's end of the hidden layer, ``own``."""
        size, places = self.vocabulary.size, self.weights[4]
        moves, back = np.zeros_like(places), np.empty_like(own)
        for group in inside.groups:
            first, last = group[0][0], group[-1][1]
            q = self._room("places", last - first, size)
            for a, b, k in group:
                np.matmul(own[a:b], places[k * size : (k + 1) * size].T, out=q[a - first : b - first])
            share = (1 / (n * _errors(_exp(q, clip), inside.rows[first:last] % size)))[:, None]
            shared = own[first:last] * share
            for a, b, k in group:
                errors, block = q[a - first : b - first], slice(k * size, (k + 1) * size)
                np.matmul(errors, places[block], out=back[a:b])
                np.matmul(errors.T, shared[a - first : b - first], out=moves[block])
            back[first:last] *= share
        self._move(4, moves)
        return back


def most_frequent(counted: DataFrame, size: int) -> list[tuple[str, int]]:
    """The most frequent of (word, n), at most ``size``, by falling count; words of like counts are all in or all out.

    Only a histogram of counts (exact to 1,023, then by 1,024th parts of a
    doubling) and the words above its threshold reach the driver.
    """
    bucket = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2(F.col("n")) * 1024)).cast("long")
    held, least = 0, None
    for r in sorted(counted.groupBy(bucket.alias("b")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r.b):
        held += r.m
        if held > size:
            break
        least = r.b
    if least is None:
        return []
    return sorted([(r.word, r.n) for r in counted.where(bucket >= least).collect()], key=lambda x: (-x[1], x[0]))


def split_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows' texts as numbers of words, cut off; a row is a slice of about ``SLICE_CHARS`` bytes.

    It has the slice's different words, joined by blanks, with their counts, and of
    each text the id, digest and tokens; ``ids`` holds all texts' places among the
    words. So counting and encoding meet a word once a slice, not at each token.
    """
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", ArrayType(kind))]).add("digest", ArrayType(LongType())).add("length", ArrayType(IntegerType())).add("ids", "binary").add("words", "string").add("n", ArrayType(IntegerType()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for at, upto in _slices(column):
                place, found, digests, lengths = defaultdict(count().__next__), [], [], []
                for t in column.slice(at, upto - at).to_pylist():
                    words = (t or "").lower().split()
                    found.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                    lengths.append(len(words))
                    digests.append(xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63))
                numbers = np.concatenate(found)
                row = [[digests], [lengths], [packed(numbers)], [" ".join(place)], [np.bincount(numbers, minlength=len(place)).astype(np.int32)]]
                one = pa.ListArray.from_arrays(pa.array([0, upto - at], pa.int32()), ids.slice(at, upto - at))
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.string(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([one, *(pa.array(x, k) for x, k in zip(row, kinds))], names=schema.names)

    return cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(split), schema))


def _slices(column: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of about ``most`` bytes together, a longer one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, upto
        at, before = upto, int(ends[upto - 1])


def count_words(docs: DataFrame) -> Counts:
    """The vocabulary and spelling counts over all rows (text)."""
    return counted_words(split_texts(docs.select(F.lit(0).alias("doc_id"), "text")))


def counted_words(parts: DataFrame) -> Counts:
    """The vocabulary and spelling counts of texts that are split."""
    pairs = parts.where("words <> ''").select(F.inline(F.arrays_zip(F.split("words", " ").alias("word"), F.col("n").alias("n"))))
    counted = cut(pairs.groupBy("word").agg(F.sum("n").alias("n")))
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    size = max(FREQUENT, min(WORDS_A_ROOT * math.isqrt(tokens), MOST_WORDS))
    top = most_frequent(counted, size)
    known = {w for w, _ in top}

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, endings = np.zeros(ENDINGS * CHARS * CHARS), Endings()
        for batch in batches:
            rare = batch[[w not in known for w in batch["word"]]]
            if len(rare):
                words = rare["word"].tolist()
                cells, owner = spelled_cells(words, np.array([endings[w[-2:]] for w in words]))
                sums += np.bincount(cells, rare["n"].to_numpy(float)[owner], len(sums))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"cell": at, "n": sums[at].astype(np.int64)})

    cells = counted.mapInPandas(spell, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(ENDINGS * CHARS * CHARS)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = table.reshape(ENDINGS, CHARS, CHARS) + 0.01
    vocabulary = Vocabulary([w for w, _ in top], [n for _, n in top], tokens - sum(n for _, n in top))
    return Counts(vocabulary, np.log(table / table.sum(axis=2, keepdims=True)), tokens)


def encoded(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dealt`` of the rows' texts."""
    return dealt(split_texts(docs, id_col, text_col), counts)


def dealt(parts: DataFrame, counts: Counts) -> DataFrame:
    """(shard, spare, digest, ids, spelled, doc_id) of every row of ``split_texts``, by shard and in the digest's order, cut off.

    ``spelled`` is the log-probability of the spellings. A text goes to the
    shard of its digest once a task; its copies (again after ``SEEN_TEXTS``
    others) and texts without words are spare: they are spread over all shards
    and not trained on, so a text with very many copies is no hot key.
    """
    shards = max(1, counts.tokens // SHARD_TOKENS)
    shared = parts.sparkSession.sparkContext.broadcast(counts)
    schema = StructType().add("shard", "integer").add("spare", "boolean").add("digest", "long").add("ids", "binary").add("spelled", "double").add(StructField("doc_id", parts.schema["doc_id"].dataType.elementType))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen, spares = Reader(shared.value), set(), 0
        for batch in batches:
            for k in range(batch.num_rows):
                digests, lengths = batch.column("digest")[k].values.to_numpy(), batch.column("length")[k].values.to_numpy()
                known, logs = read.words_of(batch.column("words")[k].as_py().split())
                places = unpacked(batch.column("ids")[k].as_py())
                ids, ends = known[places], np.cumsum(lengths).tolist()
                spelled = np.bincount(np.repeat(np.arange(len(lengths)), lengths), logs[places], len(lengths))
                to, spare, data = [], [], []
                for digest, n, end in zip(digests.tolist(), lengths.tolist(), ends):
                    is_spare = digest in seen or not n
                    if len(seen) >= SEEN_TEXTS:
                        seen.clear()
                    seen.add(digest)
                    spares += is_spare
                    to.append((digest + (1 << 63) + (spares if is_spare else 0)) % shards)
                    spare.append(is_spare)
                    data.append(packed(ids[end - n : end]))
                columns = [pa.array(to, pa.int32()), pa.array(spare), pa.array(digests), pa.array(data, pa.binary()), pa.array(spelled, pa.float64()), batch.column("doc_id")[k].values]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    tasks = min(shards, max(4096, shards // 64))
    return cut(parts.mapInArrow(trimmed(deal), schema).repartition(tasks, "shard").sortWithinPartitions("shard", "spare", "digest"))


def packed(ids: np.ndarray) -> bytes:
    """Two bytes an id, or four behind one marking byte."""
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"4" + ids.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = len(data) % 2
    return np.frombuffer(data, "<u4" if wide else "<u2", offset=wide).astype(np.int32)


def batch_size(tokens: int) -> int:
    """Positions of a batch: small corpora get small ones, so that they have steps enough."""
    return max(256, min(BATCH, tokens // 1024))


def masked_batches(documents: Iterator[np.ndarray], r: int, rounds: int, edge: int, size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, ids) of the positions that round ``r`` of ``rounds`` masks, about ``size`` at once: every ``rounds``-th of a text."""
    held_x, held_y, held = [], [], 0
    for ids in documents:
        first = (r - len(ids)) % rounds
        if first < len(ids):
            held_x.append(contexts(ids, edge, first, rounds))
            held_y.append(ids[first::rounds])
            held += len(held_y[-1])
        if held >= size:
            x, y = np.concatenate(held_x), np.concatenate(held_y)
            parts = max(1, round(held / size))
            yield from zip(np.array_split(x, parts), np.array_split(y, parts))
            held_x, held_y, held = [], [], 0
    if held:
        yield np.concatenate(held_x), np.concatenate(held_y)


def train(rows: DataFrame, counts: Counts, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights after ``rounds`` of training on all shards of ``encoded`` rows and averaging."""
    context, vocabulary, size = rows.sparkSession.sparkContext, counts.vocabulary, batch_size(counts.tokens)
    weights = vocabulary.first_weights()
    for r in range(rounds):
        shared = context.broadcast((vocabulary, weights))

        def learn(batches: Iterator[pd.DataFrame], r: int = r, shared=shared) -> Iterator[pd.DataFrame]:
            vocabulary, start = shared.value
            total, tokens, last = None, 0, None

            def shards() -> Iterator[tuple[int, np.ndarray]]:
                nonlocal last
                for batch in batches:
                    for shard, spare, digest, data in zip(batch["shard"], batch["spare"], batch["digest"], batch["ids"]):
                        if not spare and (shard, digest) != last:  # copies stand together
                            last = shard, digest
                            yield shard, unpacked(data)

            stream = shards()
            ahead = next(stream, None)
            while ahead:
                shard, n = ahead[0], 0

                def documents() -> Iterator[np.ndarray]:
                    nonlocal ahead, n
                    while ahead and ahead[0] == shard:
                        n += len(ahead[1])
                        yield ahead[1]
                        ahead = next(stream, None)

                trainer = Trainer(vocabulary, start)
                for x, y in masked_batches(documents(), r, rounds, vocabulary.edge, size):
                    trainer.step(x, y)
                moved = np.concatenate([w.ravel() for w in trainer.weights]).astype(float) * n
                total, tokens = moved if total is None else total + moved, tokens + n
            if tokens:
                mean = (total / tokens).astype(np.float32)
                for part, at in enumerate(range(0, len(mean), PART)):
                    yield pd.DataFrame({"part": [part], "w": [mean[at : at + PART]], "n": [float(tokens)]})

        def average(group: pd.DataFrame) -> pd.DataFrame:  # a row a task
            return pd.DataFrame({"part": group["part"].iloc[:1], "w": [np.average(np.stack(group["w"]), axis=0, weights=group["n"]).astype(np.float32)]})

        moved = rows.select("shard", "spare", "digest", "ids").mapInPandas(learn, "part int, w array<float>, n double").groupBy("part").applyInPandas(average, "part int, w array<float>").toArrow()
        if moved.num_rows:
            parts = sorted(zip(moved["part"].to_pylist(), range(moved.num_rows)))
            flat = np.concatenate([moved["w"][k].values.to_numpy() for _, k in parts])
            ends = np.cumsum([int(np.prod(s)) for s in vocabulary.shapes])
            weights = [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), vocabulary.shapes)]
    return weights


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Counts, list[np.ndarray]]:
    """Counts and network learned from all rows of ``docs``; an empty table gives a network without words."""
    rows = docs.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = split_texts(rows)
    counts = counted_words(parts)
    return counts, train(dealt(parts, counts), counts)


def _summed(found: list[tuple[np.ndarray, float]], vocabulary: Vocabulary, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed log-probabilities of texts given as ids and the log-probability of their spellings."""
    lengths = np.array([len(f[0]) for f in found], np.int64)
    sums = np.array([f[1] for f in found])
    at = 0
    while at < len(found):  # texts together up to a bound, a longer one in slices
        upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), TOKENS_AT_ONCE, "right")))
        ids = np.concatenate([f[0] for f in found[at:upto]])
        around = np.concatenate([contexts(f[0], vocabulary.edge) for f in found[at:upto]])
        logs = [log_probabilities(vocabulary, weights, around[k : k + TOKENS_AT_ONCE], ids[k : k + TOKENS_AT_ONCE]) for k in range(0, len(ids), TOKENS_AT_ONCE)]
        owner = np.repeat(np.arange(upto - at), lengths[at:upto])
        sums[at:upto] += np.bincount(owner, np.concatenate([*logs, np.zeros(0)]), upto - at)
        at = upto
    return lengths, sums


def score_texts(batch: list[str], counts: Counts, weights: list[np.ndarray], read: Reader | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed conditional log-probabilities of each text."""
    read = read or Reader(counts)
    return _summed([read(t) for t in batch], counts.vocabulary, weights)


def _scored(rows: DataFrame, id_col: str) -> DataFrame:
    per_token = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    return rows.withColumn("pll_per_token", per_token).withColumnRenamed("doc_id", id_col)


def _schema(docs: DataFrame, id_col: str) -> StructType:
    return StructType([StructField("doc_id", docs.schema[id_col].dataType)]).add("n_tokens", "long").add("pll", "double")


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of ``docs`` with a model learned from them; their texts are split into words once, for training and scoring."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = split_texts(rows)
    counts = counted_words(parts)
    every = dealt(parts, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts.vocabulary, train(every, counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        for batch in batches:
            ids, spelled = batch.column("ids").to_pylist(), batch.column("spelled").to_pylist()
            new = [k == 0 or ids[k] != ids[k - 1] or spelled[k] != spelled[k - 1] for k in range(len(ids))]  # copies stand together
            n, sums = _summed([(unpacked(ids[k]), spelled[k]) for k in np.flatnonzero(new)], vocabulary, weights)
            of = np.cumsum(new) - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n[of]), pa.array(sums[of])], names=["doc_id", "n_tokens", "pll"])

    return _scored(every.select("doc_id", "ids", "spelled").mapInArrow(run, _schema(docs, id_col)), id_col)


def score(docs: DataFrame, model: tuple[Counts, list[np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens``, ``pll`` (natural log) and ``pll_per_token`` (null without tokens).

    A null or empty text has no tokens and ``pll`` 0. Repeated rows give
    repeated results, an empty table none; very long texts are taken in slices.
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 20 numbers a word, MOST_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = shared.value
        read = Reader(counts)
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for at, upto in _slices(column, 1_000_000):
                n, sums = score_texts([t or "" for t in column.slice(at, upto - at).to_pylist()], counts, weights, read)
                yield pa.RecordBatch.from_arrays([ids.slice(at, upto - at), pa.array(n), pa.array(sums)], names=["doc_id", "n_tokens", "pll"])

    return _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _schema(docs, id_col)), id_col)
