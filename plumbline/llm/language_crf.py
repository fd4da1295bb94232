"""Language identification by a linear-chain conditional random field over words.

Each word of a text carries a language label. A word's emission comes from hashed
affix and n-gram features and from lexicon features; learned transitions tie
neighbours, so code-switched text gets labels word by word. Forward-backward
gives each word's label probabilities; a document's language is the one with the
largest share of them, and that share is its score.

Lexicon counts cover all training rows and all languages. The weights are learned
in numpy on a bounded sample (``SAMPLE_DOCS`` rows a language, drawn by hash among
texts of any length; of a longer one, ``SAMPLE_CHARS`` characters from a place
drawn by hash), whose texts are cut into segments and spliced, so that switches
are seen. More languages get fewer buckets each, so a model's size is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.llm.common import slices, texts, trim, trimmed

#: Rows a language, rows in all (but eight a language at least), and characters of each, from which weights are learned.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_CHARS = 300, 4_000, 6_000
FEATURES, LEXICON = 1 << 16, 1 << 17
#: Numbers in each of a model's two tables of buckets by languages; more languages halve the buckets until they fit.
TABLE_SIZE = 1 << 23
#: Languages up to which long texts are cut into chunks that advance together; beyond, whole texts of like length do.
CHUNKED_LANGUAGES = 16
SEQUENCE, STEPS, L2 = 200, 60, 1e-4
CHUNK = 32
WORDS_AT_ONCE = 200_000
MEMO_WORDS, WORDS_A_BLOCK = 200_000, 20_000
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+").findall
_LETTERS = regex.compile(r"\p{L}+").findall


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (numerals such as fractions and Roman number signs are none)."""
    words = _WORDS(text.lower())
    return words if "".join(words).isalpha() else [w for x in words for w in _LETTERS(x)]


def table_sizes(languages: int) -> tuple[int, int]:
    """Buckets of the features' and of the lexicon's table, powers of two."""
    room = 1 << max(4, (TABLE_SIZE // max(1, languages)).bit_length() - 1)
    return min(FEATURES, room), min(LEXICON, room)


def _mixed(parts: list[np.ndarray], tag: int) -> np.ndarray:
    """32-bit hashes of rows of code points, by kind of feature."""
    out = np.full(len(parts[0]), (tag * 0x9E3779B1) & 0xFFFFFFFF, np.uint32)
    for p in parts:
        out = (out ^ p) * np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(15)
    return out


class Words:
    """Words as code points end to end, each with an edge on both sides, for hashing them all at once."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.zeros(0, np.uint32)
        self.first = np.cumsum(self.lengths + 2) - (self.lengths + 2)

    def buckets(self, size: int) -> np.ndarray:
        """The lexicon's bucket of each word."""
        place = (np.arange(len(self.codes)) - np.repeat(self.first, self.lengths + 2)).astype(np.uint32)
        mixed = _mixed([self.codes, place], 1)
        sums = np.add.reduceat(mixed, self.first, dtype=np.uint32) if len(self.first) else np.zeros(0, np.uint32)
        return (_mixed([sums], 2) & np.uint32(size - 1)).astype(np.int64)

    def features(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(words in rising order, buckets) of each kind of feature.

        The kinds are bigrams and trigrams of the word with its edges, repeats
        included, and its prefixes and suffixes of one to three letters.
        """
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths + 2)
        out = []
        for n in (2, 3):
            inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            out.append((owner[inside], _mixed([self.codes[inside + k] for k in range(n)], n)))
        for n in (1, 2, 3):
            own = np.flatnonzero(self.lengths >= n)
            for tag, at in ((10 + n, self.first[own] + 1), (20 + n, self.first[own] + 1 + self.lengths[own] - n)):
                out.append((own, _mixed([self.codes[at + k] for k in range(n)], tag)))
        return [(own, (h & np.uint32(size - 1)).astype(np.int64)) for own, h in out]


@dataclass
class Model:
    """Languages, weights of features and lexicon, transitions, and the lexicon's log-odds; see ``table_sizes`` for its size."""

    langs: list[str]
    weights: np.ndarray
    mixing: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        found = Words(words)
        out = self.lexicon[found.buckets(len(self.lexicon))] @ self.mixing
        for own, buckets in found.features(len(self.weights)):
            if len(own) == len(words):
                out += self.weights[buckets]
            elif len(own):
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[first]] += np.add.reduceat(self.weights[buckets], first, axis=0)
        return out


def forward_backward(emit: np.ndarray, trans: np.ndarray, chunk: int = CHUNK, lengths: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities (n, K) of the words of one or more sequences laid end to end.

    ``emit`` and ``trans`` are log-scores; every sequence starts from all labels
    alike. Sequences are cut into chunks; the chunks' transfer matrices carry
    the messages over long texts, and all chunks advance together. Exact.
    """
    n, k = emit.shape
    lengths = np.array([n]) if lengths is None else lengths
    if not n:
        return np.zeros((0, k))
    a = np.exp(trans - trans.max())
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    chunk = chunk if k <= CHUNKED_LANGUAGES else int(lengths.max())  # transfer matrices pay for few labels only
    per = -(-lengths // chunk)
    first = np.cumsum(per) - per
    total = int(per.sum())
    seq = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = first[seq] + within // chunk, within % chunk
    grid, real = np.ones((total, chunk, k)), np.zeros((total, chunk), bool)
    grid[row, col], real[row, col] = e, True
    messages = int(per.max()) > 1
    moved = np.tile(np.eye(k), (total if messages else 0, 1, 1))
    for t in range(chunk if messages else 0):
        step = (moved.reshape(-1, k) @ a).reshape(total, k, k) * grid[:, t, None, :]
        moved = np.where(real[:, t, None, None], step, moved)
    if messages:
        moved /= moved.max(axis=(1, 2), keepdims=True)
    alpha, beta = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)
    for j in range(1, int(per.max())):  # messages from chunk to chunk, for all sequences that are long enough
        at = first[per > j] + j
        alpha[at] = _unit(np.einsum("ci,cij->cj", alpha[at - 1], moved[at - 1]))
        back = (first + per - 1)[per > j] - j
        beta[back] = _unit(np.einsum("cij,cj->ci", moved[back + 1], beta[back + 1]))
    ahead = np.empty((total, chunk, k))
    for t in range(chunk):
        alpha = np.where(real[:, t, None], _unit((alpha @ a) * grid[:, t]), alpha)
        ahead[:, t] = alpha
    for t in range(chunk - 1, -1, -1):
        ahead[:, t] *= beta
        beta = np.where(real[:, t, None], _unit((beta * grid[:, t]) @ a.T), beta)
    return _unit(ahead[row, col])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def _pairs(emit: np.ndarray, trans: np.ndarray, marginals: np.ndarray) -> np.ndarray:
    """Expected transition counts of sequences (S, T, K) from their marginals' messages."""
    s, t, k = emit.shape
    a, e = np.exp(trans - trans.max()), np.exp(emit - emit.max(axis=2, keepdims=True))
    alpha, beta = np.empty((s, t, k)), np.empty((s, t, k))
    now = np.full((s, k), 1.0 / k)
    for i in range(t):
        now = alpha[:, i] = _unit((now @ a) * e[:, i])
    now = beta[:, t - 1] = np.full((s, k), 1.0 / k)
    for i in range(t - 1, 0, -1):
        now = beta[:, i - 1] = _unit((now * e[:, i]) @ a.T)
    marginals[:] = _unit(alpha * beta)
    out = np.zeros((k, k))
    start = np.full((s, k), 1.0 / k)
    for i in range(t):
        both = (start if i == 0 else alpha[:, i - 1])[:, :, None] * a * (e[:, i] * beta[:, i])[:, None, :]
        out += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        if i == 0:
            out *= 0  # the step from the uniform start is not a transition between words
    return out


def learn(sample: list[tuple[str, str]], langs: list[str], lexicon: np.ndarray, seed: int = 5) -> Model:
    """Weights by Adam on the conditional log-likelihood of spliced label sequences; all zero where the sample has no word."""
    rng, k = np.random.default_rng(seed), len(langs)
    buckets_of_features = table_sizes(k)[0]
    params = [np.zeros((buckets_of_features, k)), np.zeros((k, k)), np.zeros((k, k))]
    vocabulary: dict[str, int] = {}
    segments = []
    for text, lang in sample:
        words = words_of(text)
        ids, at = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)), 0
        while at < len(ids):
            size = int(rng.integers(8, 60))
            segments.append((ids[at : at + size], langs.index(lang)))
            at += size
    if not segments:
        return Model(langs, params[0], params[1], params[2], lexicon)
    order = rng.permutation(len(segments))
    words = np.concatenate([segments[i][0] for i in order])
    y = np.concatenate([np.full(len(segments[i][0]), segments[i][1]) for i in order])
    span = min(SEQUENCE, len(words))
    if len(words) % span:  # the last sequence is filled up from the start
        words, y = np.resize(words, -(-len(words) // span) * span), np.resize(y, -(-len(y) // span) * span)
    found = Words(list(vocabulary))
    parts, buckets = found.features(buckets_of_features), found.buckets(len(lexicon))
    owner, flat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    flat, starts = flat[order], np.searchsorted(owner[order], np.arange(len(vocabulary)))
    sizes = np.diff(np.r_[starts, len(flat)])
    lex = lexicon[buckets]
    rows = (len(words) // span, span)
    gold, pairs = np.eye(k)[y], np.zeros((k, k))
    np.add.at(pairs, (y.reshape(rows)[:, :-1].ravel(), y.reshape(rows)[:, 1:].ravel()), 1)
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    marginals = np.empty((*rows, k))
    for step in range(1, STEPS + 1):
        per_word = lex @ params[1]
        for j in range(k):  # one language at a time, so that temporary arrays stay small
            per_word[:, j] += np.add.reduceat(params[0][:, j][flat], starts)
        expected = _pairs(per_word[words].reshape(*rows, k), params[2], marginals)
        miss = marginals.reshape(-1, k) - gold
        by_word = np.stack([np.bincount(words, miss[:, j], len(vocabulary)) for j in range(k)], axis=1) / len(words)
        grads = [np.stack([np.bincount(flat, np.repeat(by_word[:, j], sizes), buckets_of_features) for j in range(k)], axis=1), lex.T @ by_word, (expected - pairs) / len(words)]
        for p, g, m, s in zip(params, grads, means, squares):
            g += L2 * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(langs, params[0], params[1], params[2], lexicon)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of all languages in ``train``; None if no row has a text and a language.

    Repeated rows count as often as they occur. A language whose texts have no
    word is learned, but hardly ever predicted.
    """
    rows = train.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows_of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(_row_key()).alias("n")).collect()}
    langs = sorted(rows_of)
    if not langs:
        return None
    size = table_sizes(len(langs))[1]
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), size))
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                for part in slices(group, "text"):
                    seen = Counter(w for t in texts(part["text"]) for w in words_of(t))
                    sums[number[lang]] += np.bincount(Words(list(seen)).buckets(size), np.fromiter(seen.values(), float, len(seen)), size)
        for k in range(len(langs)):
            at = np.flatnonzero(sums[k])
            if len(at):
                yield pd.DataFrame({"bucket": at, "lang": k, "n": sums[k][at].astype(np.int64)})

    counted = rows.select("text", "lang").mapInPandas(trimmed(count), "bucket long, lang int, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((size, len(langs)))
    counts[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    share = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * size))
    lexicon = np.clip(share - share.mean(axis=1, keepdims=True), -4, 4) * (counts.sum(axis=1, keepdims=True) > 1)
    return learn(_sample(rows, rows_of), langs, lexicon)


def _row_key() -> Column:
    return F.xxhash64(F.coalesce("id", F.lit("")), "text")


def _sample(rows: DataFrame, rows_of: dict[str, int]) -> list[tuple[str, str]]:
    """At most ``SAMPLE_DOCS`` (text, language) a language, of ``SAMPLE_CHARS`` characters each.

    Rows are drawn by a hash of id and text; null ids are ids like any other and
    equal rows are one; ``rows_of`` has about how many distinct rows a language
    has. A threshold on the hash leaves about twice the sample
    before anything is sorted, so no task gets all rows of a language.
    """
    spark, key, most = rows.sparkSession, _row_key(), max(8, min(SAMPLE_DOCS, SAMPLE_ALL // len(rows_of)))
    share = spark.createDataFrame([(k, min(1.0, 2.0 * (most + 50) / max(n, 1))) for k, n in rows_of.items()], "lang string, share double")
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    part = F.substring("text", F.pmod(key, spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    drawn = rows.withColumn("key", key).join(F.broadcast(share), "lang").where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    distinct = drawn.select("lang", "key", part.alias("text")).dropDuplicates(["lang", "key"])
    first = Window.partitionBy("lang").orderBy("key")
    kept = distinct.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("text", "lang").collect()
    return [(r.text, r.lang) for r in sorted(kept, key=lambda r: (r.lang, r.text))]


class Labeller:
    """Word labels with a model; remembers the emissions of words."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table, self.used = model, {}, np.zeros((1024, len(model.langs))), 0

    def emissions(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        at = np.fromiter(map(rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            if len(rows) + len(new) > MEMO_WORDS and rows:
                rows.clear()
                self.used = 0
                return self.emissions(words)
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k in range(0, len(new), WORDS_A_BLOCK):
                block = new[k : k + WORDS_A_BLOCK]
                self.table[self.used + k : self.used + k + len(block)] = self.model.emissions(block)
            rows.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
            at[missing] = [rows[words[i]] for i in missing.tolist()]
        return self.table[at]

    def shares(self, batch: list[list[str]]) -> np.ndarray:
        """(documents, K): mean label probabilities over each document's words; zeros without words."""
        out, lengths = np.zeros((len(batch), len(self.model.langs))), np.array([len(w) for w in batch], np.int64)
        some = np.flatnonzero(lengths)
        many = len(self.model.langs) > CHUNKED_LANGUAGES
        if many:  # texts of like length advance together
            some = some[np.argsort(lengths[some], kind="stable")]
        at = 0
        while at < len(some):
            upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[some[at:]]), WORDS_AT_ONCE, "right")))
            if many:
                upto = min(upto, int(np.searchsorted(lengths[some], 2 * lengths[some[at]], "right")))
            part, n = some[at:upto], lengths[some[at:upto]]
            marginals = forward_backward(self.emissions([w for i in part for w in batch[i]]), self.model.transitions, lengths=n)
            out[part] = np.add.reduceat(marginals, np.cumsum(n) - n, axis=0) / n[:, None]
            at = upto
        return out

    def labels(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a text with its likeliest language and that probability."""
        words = words_of(text)
        marginals = forward_backward(self.emissions(words), self.model.transitions)
        return [(w, self.model.langs[int(m.argmax())], float(m.max())) for w, m in zip(words, marginals)]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``lang_pred`` and ``score``.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text without a model. Ties go to the language first in order. Repeated rows
    give repeated results, an empty table gives none; other columns are ignored.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType)]).add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * TABLE_SIZE numbers, but for the transitions

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            if labeller is None:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": UNDETERMINED, "score": 0.0})
                continue
            for part in slices(batch, "text"):
                split = [words_of(t) for t in texts(part["text"])]
                shares = labeller.shares(split)
                names = np.array([*labeller.model.langs, UNDETERMINED], dtype=object)
                won = np.where([bool(w) for w in split], shares.argmax(axis=1), len(names) - 1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": names[won], "score": np.minimum(shares.max(axis=1), 1.0)})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(label, schema).withColumnRenamed("doc_id", id_col)


def keep_determined(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text one language holds the share ``least`` of the words; undetermined texts go.

    All columns stay, each row is judged on its own, and no text is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            for part in slices(batch, text_col):
                if labeller is not None and len(part):
                    shares = labeller.shares([words_of(t) for t in texts(part[text_col])]).max(axis=1)
                    yield part[(shares > 0) & (shares >= least)]
        del labeller
        trim()

    return docs.mapInPandas(keep, docs.schema)
