"""SentencePiece encoding and decoding with exact N-best segmentation.

A text's segmentations are the paths of its piece lattice; a path's score is the
sum of its pieces' scores. A forward Viterbi pass gives, for every position, the
best score of any path to it. Those scores are exact heuristics for a backward
A-star search from the end, which returns paths best first.

In the models at hand only pieces of blanks hold a blank behind their first
character. So the lattice of a text falls apart before each run of blanks, into
units that are segmented on their own, many at a time in numpy, and remembered by each worker. The best N
paths of a text differ from its best path in at most N - 1 units, and only in
those with the N - 1 smallest costs of a second choice: only these are searched.

Characters without a piece become the pieces of their UTF-8 bytes, as one arc
that scores ``UNKNOWN_PENALTY`` below the lowest piece. A blank goes before the
text, as in the library; decoding takes it away. Decoding is exact for any text.

A path's score is the sum of what the model file gives its pieces. In a unigram
model these are log-probabilities. In a BPE model they are merge ranks, so the
best sum is not the library's sequence of merges and often has more pieces:
``learned_scores`` gives log-probabilities from a corpus's own counts instead.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import slices, texts, trim, trimmed

N_BEST = 4
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers, and those whose N best paths it remembers.
MEMO_UNITS, MEMO_BEST = 200_000, 20_000
#: Characters of the documents that are segmented together; longer units go one by one.
CHARS_AT_ONCE, LONG_UNIT = 400_000, 48
#: Units in one block of the vectorised search.
BLOCK_UNITS = 8_192
_BASE, _BITS = np.uint64(0x9E3779B97F4A7C15), 20
ALTERNATIVES = "array<struct<score: double, edits: array<struct<at: int, n: int, ids: array<int>>>>>"
OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
_UNITS = re.compile(" +[^ ]*").findall


class Lattice:
    """The pieces of a model and the search over their lattice."""

    def __init__(self, path: str, scores: dict[int, float] | None = None):
        """The model at ``path``; ``scores`` by piece id replace the file's."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.surface: list[bytes] = []
        self.bytes = [0] * 256
        lowest = 0.0
        for i in range(model.get_piece_size()):
            piece, score, surface = model.id_to_piece(i), float(model.get_score(i) if scores is None else scores[i]), b""
            if model.is_byte(i):
                surface = bytes([int(piece[3:5], 16)])
                self.bytes[surface[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                shown = piece.replace("▁", " ")
                if " " in shown.lstrip(" "):
                    raise ValueError(f"piece {piece!r} holds a blank behind other characters")
                surface = shown.encode()
                self.ids[shown] = i
                lowest = min(lowest, score) if score > -1e8 else lowest
            self.scores.append(score)
            self.surface.append(surface)
        self.unknown = lowest - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.score_of = np.array(self.scores)
        self.memo_best: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):  # per length: sorted hashes, their ids, and a bitmap that rules most others out
            own = [(k, i) for k, i in self.ids.items() if len(k) == n]
            hashes = self._hash(np.frombuffer("".join(k for k, _ in own).encode("utf-32-le"), np.uint32).reshape(-1, n).T) if own else np.zeros(0, np.uint64)
            order, bitmap = np.argsort(hashes), np.zeros(1 << _BITS, bool)
            bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((hashes[order], np.array([i for _, i in own], np.int32)[order], bitmap))
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.used, self.flat_used = 0, 0
        self.unit_score, self.unit_second = np.zeros(1024), np.zeros(1024)
        self.unit_at, self.unit_n, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    @staticmethod
    def _hash(columns) -> np.ndarray:
        out = np.uint64(0)
        for c in columns:
            out = (out + c.astype(np.uint64) + np.uint64(1)) * _BASE
        return out

    def arcs(self, unit: str, end: int) -> list[tuple[int, int, float]]:
        """(start, piece id or -1 for bytes, score) of the arcs that end at ``end``."""
        out, ids, scores = [], self.ids, self.scores
        for start in range(max(0, end - self.longest), end):
            i = ids.get(unit[start:end])
            if i is not None:
                out.append((start, i, scores[i]))
            elif start == end - 1:
                out.append((start, -1, self.unknown))
        return out

    def forward(self, unit: str) -> array:
        """Best score of any path to each position; eight bytes a character, as arcs are looked up again when needed."""
        best = array("d", [0.0])
        for end in range(1, len(unit) + 1):
            best.append(max([best[s] + x for s, _, x in self.arcs(unit, end)]))
        return best

    def _ids(self, unit: str, start: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.bytes[b] for b in unit[start].encode("utf-8", "surrogatepass")]

    def viterbi(self, unit: str) -> tuple[float, list[int], float]:
        """Score and ids of the best path, and what the second best costs (infinite: there is none)."""
        best = self.forward(unit)
        at, path, second = len(unit), [], float("inf")
        while at:
            into = self.arcs(unit, at)
            totals = [best[s] + x for s, _, x in into]
            k = totals.index(best[at])
            if len(totals) > 1:
                second = min(second, best[at] - max(totals[:k] + totals[k + 1 :]))
            start, piece, _ = into[k]
            path.append((start, piece))
            at = start
        return best[-1], [i for s, p in reversed(path) for i in self._ids(unit, s, p)], second

    def _viterbi_many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """``viterbi`` of many short units at once; units in order of falling length. Paths hold -1 - c for an unknown character c."""
        lengths = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        first, top, n = np.cumsum(lengths) - lengths, int(lengths[0]), len(units)
        left = np.repeat(lengths, lengths) - (np.arange(len(codes)) - np.repeat(first, lengths))  # characters to the unit's end
        pieces = np.full((min(self.longest, top), len(codes)), -1, np.int32)
        hashed = np.zeros(len(codes), np.uint64)
        for k in range(len(pieces)):
            at = np.flatnonzero(left > k)
            hashed[at] = (hashed[at] + codes[at + k] + np.uint64(1)) * _BASE
            keys, ids, bitmap = self.tables[k]
            at = at[bitmap[(hashed[at] >> np.uint64(64 - _BITS)).astype(np.int64)]]
            if len(keys):
                place = np.minimum(np.searchsorted(keys, hashed[at]), len(keys) - 1)
                same = keys[place] == hashed[at]
                pieces[k, at[same]] = ids[place[same]]
        worth = np.where(pieces >= 0, self.score_of[pieces], -np.inf)
        worth[0] = np.where(pieces[0] >= 0, worth[0], self.unknown)
        best, second = np.full((top + 1, n), -np.inf), np.full((top + 1, n), -np.inf)
        step = np.zeros((top + 1, n), np.int32)
        best[0] = 0
        for end in range(1, top + 1):
            m = int(np.searchsorted(-lengths, -end, "right"))  # units this long come first
            b, s, z = best[end, :m], second[end, :m], step[end, :m]
            for k in range(min(end, len(pieces))):
                total = best[end - k - 1, :m] + worth[k, first[:m] + end - k - 1]
                more = total > b
                np.maximum(s, np.minimum(total, b), out=s)
                np.copyto(b, total, where=more)
                z[more] = k + 1
        at, unit, cost, found = lengths.copy(), np.arange(n), np.full(n, np.inf), []
        while len(unit):
            k = step[at[unit], unit]
            with np.errstate(invalid="ignore"):
                cost[unit] = np.minimum(cost[unit], best[at[unit], unit] - second[at[unit], unit])
            at[unit] -= k
            where = first[unit] + at[unit]
            piece = pieces[k - 1, where]
            found.append((unit, np.where(piece >= 0, piece, -1 - codes[where].astype(np.int64))))
            unit = unit[at[unit] > 0]
        paths = np.full((len(found), n), np.iinfo(np.int64).min)
        for row, (own, piece) in enumerate(reversed(found)):
            paths[row, own] = piece
        return best[lengths, np.arange(n)], cost, paths, lengths

    def remember(self, units: list[str]) -> np.ndarray:
        """Rows of the units in memory; those that are new are segmented first."""
        memo = self.memo
        new = {u for u in units if u not in memo}
        if new:
            if len(memo) + len(new) > MEMO_UNITS:
                self.forget()
                memo, new = self.memo, set(units)
            short = sorted([u for u in new if len(u) <= LONG_UNIT], key=len, reverse=True)
            for k in range(0, len(short), BLOCK_UNITS):
                self._remember_block(short[k : k + BLOCK_UNITS])
            for u in [u for u in new if len(u) > LONG_UNIT]:
                score, ids, cost = self.viterbi(u)
                self._append([u], [score], [cost], np.array([len(ids)]), ids)
        return np.fromiter(map(memo.__getitem__, units), np.int64, len(units))

    def _remember_block(self, short: list[str]) -> None:
        scores, costs, paths, _ = self._viterbi_many(short)
        flat, missing = paths.T, np.iinfo(np.int64).min
        there = flat != missing
        counts, ids = there.sum(axis=1), flat[there]
        odd = ids < 0
        if odd.any():  # unknown characters become the pieces of their bytes
            raw = {c: [self.bytes[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in np.unique(ids[odd]).tolist()}
            owner, wide = np.repeat(np.arange(len(short)), counts), np.ones(len(ids), np.int64)
            wide[odd] = [len(raw[c]) for c in ids[odd].tolist()]
            counts = np.bincount(owner, wide, len(short)).astype(np.int64)
            into = np.repeat(odd, wide)
            spread = np.repeat(ids, wide)
            spread[into] = [i for c in ids[odd].tolist() for i in raw[c]]
            ids = spread
        self._append(short, scores, costs, counts, ids)

    def _append(self, units, scores, costs, counts, ids) -> None:
        upto, flat_upto = self.used + len(units), self.flat_used + len(ids)
        for name, need in (("unit_score", upto), ("unit_second", upto), ("unit_at", upto), ("unit_n", upto), ("flat", flat_upto)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        rows = slice(self.used, upto)
        self.unit_score[rows], self.unit_second[rows], self.unit_n[rows] = scores, costs, counts
        self.unit_at[rows] = self.flat_used + np.cumsum(counts) - counts
        self.flat[self.flat_used : flat_upto] = ids
        self.memo.update(zip(units, range(self.used, upto)))
        self.used, self.flat_used = upto, flat_upto

    def n_best(self, unit: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The ``n`` best paths by backward A-star, best first; of equal scores the one nearest to the start is followed first.

        The forward scores are exact, so every open entry stands for a path of
        just its score, and no two for the same one: the ``n`` best entries are
        all that need be kept open, however long the unit is.
        """
        key = (unit, n)
        if key not in self.memo_best:
            best = self.forward(unit)
            open_, order, out = [(-best[-1], len(unit), 0, 0.0, None)], 0, []
            while open_ and len(out) < n:
                minus, at, _, behind, after = open_.pop(0)
                if at == 0:
                    ids = []
                    while after:
                        ids += self._ids(unit, *after[0])
                        after = after[1]
                    out.append((-minus, ids))
                    continue
                for start, piece, score in self.arcs(unit, at):
                    order += 1
                    total = behind + score
                    bisect.insort(open_, (-(best[start] + total), start, order, total, ((start, piece), after)))
                del open_[n - len(out) :]
            if len(self.memo_best) >= MEMO_BEST:
                self.memo_best.clear()
            self.memo_best[key] = out
        return self.memo_best[key]

    def encode(self, text: str, n: int = N_BEST) -> tuple[float, np.ndarray, list[dict]]:
        return self.encode_many([text], n)[0]

    def encode_many(self, batch: list[str], n: int = N_BEST) -> list[tuple[float, np.ndarray, list[dict]]]:
        """Of each text: score and ids of the best path; the next ``n - 1`` paths as edits of it."""
        split = [_UNITS(" " + t) if t else [] for t in batch]
        rows = self.remember([u for units in split for u in units])
        sizes = self.unit_n[rows]
        ends = np.cumsum(sizes)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.unit_at[rows] - (ends - sizes), sizes)]
        out, u, i = [], 0, 0
        for units in split:
            own, length = rows[u : u + len(units)], sizes[u : u + len(units)]
            total = int(length.sum())
            score = float(self.unit_score[own].sum())
            out.append((score, flat[i : i + total], self._others(units, own, length, score, n)))
            u, i = u + len(units), i + total
        return out

    def _others(self, units: list[str], own: np.ndarray, length: np.ndarray, score: float, n: int) -> list[dict]:
        seconds = self.unit_second[own]
        open_ = np.argsort(seconds, kind="stable")[: n - 1] if len(seconds) <= 4 * n else np.sort(np.argpartition(seconds, n - 1)[: n - 1])
        chosen = [int(k) for k in open_ if np.isfinite(seconds[k])]
        if n < 2 or not chosen:
            return []
        choices = [self._choices(units[k], own[k], n) for k in chosen]
        starts = np.cumsum(length) - length
        ranked: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for choice in choices:
            ranked = sorted([(cost + more[0], (*pick, p)) for cost, pick in ranked for p, more in enumerate(choice)])[:n]
        others = []
        for cost, pick in ranked[1:]:
            edits = [{"at": int(starts[chosen[i]]), "n": int(length[chosen[i]]), "ids": choices[i][p][1]} for i, p in enumerate(pick) if p]
            others.append({"score": score - cost, "edits": sorted(edits, key=lambda e: e["at"])})
        return others

    def _choices(self, unit: str, row: int, n: int) -> list[tuple[float, list[int]]]:
        """(cost, ids) of a unit's paths, its Viterbi path first."""
        at = self.unit_at[row]
        first, top = self.flat[at : at + self.unit_n[row]].tolist(), float(self.unit_score[row])
        rest = [(top - s, ids) for s, ids in self.n_best(unit, n) if ids != first]
        return [(0.0, first), *rest[: n - 1]]

    def decode(self, ids) -> str:
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The full ids of an alternative."""
    out, at = [], 0
    for e in edits:
        out += [*ids[at : e["at"]], *e["ids"]]
        at = e["at"] + e["n"]
    return [*out, *ids[at:]]


def learned_scores(docs: DataFrame, model: str, text_col: str = "text") -> dict[int, float]:
    """Log-probability of each piece id: how often the library's segmentation of all texts uses it, with one more for each.

    Counts are summed within a task before they are passed on; an empty table
    makes all pieces alike.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        sums = np.zeros(processor.get_piece_size(), np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for ids in processor.encode(texts(batch["text"]), num_threads=1):
                sums += np.bincount(np.array(ids, np.int64), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"id": at, "n": sums[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size())
    counts[rows["id"].to_numpy()] += rows["n"].to_numpy()
    return dict(enumerate(np.log(counts / counts.sum()).tolist()))


def parts(batch: pa.RecordBatch, place: int, chars: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``chars`` characters of text each, a longer text alone; nothing is copied."""
    at, held = 0, 0
    for k, n in enumerate(pc.utf8_length(batch.column(place)).fill_null(0).to_pylist()):
        if held and held + n + 1 > chars:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n + 1
    if held:
        yield batch.slice(at)


def encode(docs: DataFrame, model: str, n_best: int = N_BEST, text_col: str = "text", verify: bool = False, scores: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with ``pieces`` (ids of the best path), ``piece_score`` and ``piece_alternatives``.

    Alternatives are the next best paths, best first, as edits of ``pieces``.
    Columns of ``docs`` that have these names, in any case, are replaced; all rows stay. A null
    or empty text has no pieces, score 0 and no alternatives; an empty table
    stays empty. ``scores`` by piece id replace the model file's. With ``verify``,
    ``piece_round_trip`` says whether decoding the pieces gives the text back.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("pieces", "piece_score", "piece_alternatives", "piece_round_trip")]
    docs = docs.select(*kept)
    made = StructType.fromDDL(f"pieces array<int>, piece_score double, piece_alternatives {ALTERNATIVES}" + ", piece_round_trip boolean" * verify)

    place, names = docs.columns.index(text_col), [*docs.columns, *made.names]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model, scores)  # freed with the task: workers are used again by other stages
        for batch in batches:
            for part in parts(batch, place):
                own = [t or "" for t in part.column(place).to_pylist()]
                rows = lattice.encode_many(own, n_best)
                ends = np.cumsum([0, *(len(r[1]) for r in rows)])
                pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(r[1] for r in rows)]), pa.int32()))
                columns = [pieces, pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], OTHERS)]
                columns += [pa.array([lattice.decode(r[1].tolist()) == t for r, t in zip(rows, own)], pa.bool_())] * verify
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names)

    return docs.mapInArrow(trimmed(segment), StructType([*docs.schema.fields, *made.fields]))


def decode(model: str):
    """A column function: text of an array of piece ids (null: empty)."""

    @F.pandas_udf("string")
    def join(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(model)
        for column in columns:
            yield pd.Series([lattice.decode(x) if x is not None else "" for x in column], dtype="object")

    return join

