"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most ``max_bits`` bits. The
64 bits are cut into three blocks, so a linked pair differs by at most
``max_bits // 3`` in one block at least. Each block has a covering code as its
set of anchors: the perfect Hamming [15, 11] code on its first 15 bits beside
the trivial code on the others, covering radius 1. A fingerprint is replicated
to every anchor within covering radius plus block threshold of its block, and is
at home with the anchor that its block decodes to. Of a linked pair, the home
anchor of one lies within that distance of the other: comparing, per anchor, its
homes with its members finds every link. Equal fingerprints are collapsed
before, and each task returns a spanning forest of its links, never all pairs.

Texts are alike from a Jaccard similarity of their shingles on (``keep_first``).
Candidates are groups of wide fingerprints: 256 bits, whose differing share
estimates the similarity, with a margin; within a group the exact similarity
decides (``verified``). There every fingerprint goes to all anchors within covering radius plus half of
the block threshold: the point half way between two blocks lies that near to
both, and so does its anchor. Six blocks with a threshold of two bits find 0.9
and more of the pairs at similarity 0.8, nearly all above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, give_back, runs, texts, trim, trimmed
from plumbline.llm.verified import classes, digest_filter, may_hold, shingle_hashes
from plumbline.operators.duplicates import components

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = ((0, 22), (22, 21), (43, 21))
CODE_BITS, RADIUS = 15, 1
#: Members of an anchor beyond which it is cut into cells of about this many rows.
CELL_ROWS = 20_000
PAIRS_AT_ONCE = 2_000_000
#: Members of an anchor from which groups around pivots are linked first, and how many pivots.
PIVOT_ROWS, PIVOTS = 256, 8
#: Words of a wide fingerprint whose blocks have anchors.
ANCHORED = 2
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints of ``width`` 64-bit words and which of them link.

    The blocks of the first ``anchored`` words have anchors; ``slack`` is a
    block's threshold. With ``halved`` both of a pair come half way.
    """

    shingle_words: int = SHINGLE_WORDS
    max_bits: int = MAX_BITS
    width: int = 1
    anchored: int = 1
    slack: int = MAX_BITS // len(BLOCKS)
    halved: bool = False

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.width)]


def alike(similarity: float = 0.8, shingle_words: int = 5, width: int = 4, margin: float = 2.5) -> Scheme:
    """Fingerprints whose links are candidates for this Jaccard similarity: the bits that such texts differ by, and ``margin`` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * width
    return Scheme(shingle_words, int(bits * p + margin * math.sqrt(bits * p * (1 - p))), width, ANCHORED, 2, True)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, width: int = 1) -> tuple[int, ...]:
    """SimHash of a text as ``width`` signed 64-bit numbers; 0 without words (null included).

    The first number counts the bits of the shingles' XXH64, others those of hashes mixed from it.
    """
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return (0,) * width
    ones = np.zeros((width, 64), np.int64)
    for k in range(width):
        values = hashes
        if k:
            values = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            values = (values ^ (values >> np.uint64(30))) * _MIX[0]
            values = (values ^ (values >> np.uint64(27))) * _MIX[1]
            values ^= values >> np.uint64(31)
        octets = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
        for at in range(0, len(octets), 65_536):
            ones[k] += np.unpackbits(octets[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.int64).ravel().tolist())


def fingerprints(docs: DataFrame, scheme: Scheme = Scheme(), text_col: str = "text") -> DataFrame:
    """``docs`` with the fingerprint's words as columns f0, f1, ... in place of the text."""
    names = scheme.columns

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def of(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            yield pd.DataFrame([fingerprint(x, scheme.shingle_words, scheme.width) for x in texts(column)], columns=names, dtype="int64")
        trim()

    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, of(F.col(text_col)).alias("print")).select(*others, "print.*")


def _syndromes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for bit in range(CODE_BITS):
        out ^= ((values >> bit) & 1) * (bit + 1)
    return out


def _offsets(width: int, reach: int) -> list[np.ndarray]:
    """By syndrome of a block value: what to flip to reach each anchor within ``reach``."""
    errors = np.array([sum(1 << b for b in c) for w in range(reach + 1) for c in combinations(range(width), w)], np.int64)
    syndromes = _syndromes(errors)
    return [errors[syndromes == s] for s in range(CODE_BITS + 1)]


def _to_anchors(scheme: Scheme):
    reach = RADIUS + (-(-scheme.slack // 2) if scheme.halved else scheme.slack)
    offsets = [_offsets(width, reach) for _, width in BLOCKS]
    homes = [0, *(1 << b for b in range(CODE_BITS))]  # the flip that decodes each syndrome

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = batch[scheme.columns].to_numpy(np.int64)
            for word in range(scheme.anchored):
                own = np.ascontiguousarray(prints[:, word]).view(np.uint64)
                for block, (shift, width) in enumerate(BLOCKS):
                    values = ((own >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    syndromes = _syndromes(values)
                    for s in range(CODE_BITS + 1):
                        mine = syndromes == s
                        if mine.any():
                            flips = offsets[block][s]
                            anchors = (values[mine][:, None] ^ flips) | ((word * len(BLOCKS) + block) << 32)
                            out = pd.DataFrame(np.repeat(prints[mine], len(flips), axis=0), columns=scheme.columns)
                            out.insert(0, "anchor", anchors.ravel())
                            yield out.assign(home=scheme.halved or np.tile(flips == homes[s], int(mine.sum())))

    return replicate


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of a graph: each node that isn't the smallest of its component, and that smallest."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = inverse[: len(a)], inverse[len(a) :], np.arange(len(ids))
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (nearer := label[label]).tolist() != label.tolist():
            label = nearer
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int16)


def _around_pivots(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows in which groups stand together, and where each row's group begins and ends.

    A group is a pivot, which stands first, and rows that link to it; other rows
    are alone. A large group of near copies is thus linked in linear time.
    """
    n = len(prints)
    label, free = np.arange(n), np.ones(n, bool)
    for _ in range(PIVOTS):
        left = np.flatnonzero(free)
        if not len(left):
            break
        pivot = left[0]
        near = left[sum(_bits(prints[left, k], prints[pivot, k]) for k in range(prints.shape[1])) <= max_bits]
        label[near], free[near] = pivot, False
    order = np.argsort(label, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
    size = np.diff(np.r_[first, n])
    return order, np.repeat(first, size), np.repeat(first + size, size)


def _near(prints: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places (i, j) for each i of ``left`` with j from ``low`` to ``high``, as spanning stars of what is held at once."""
    some = high > low
    left, low, count = left[some], low[some], (high - low)[some]
    bounds, at = np.cumsum(count), 0
    while at < len(left):
        upto = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = count[at:upto]
        i = np.repeat(left[at:upto], n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:upto], n)
        total = np.zeros(len(i), np.int16)
        for k in range(prints.shape[1]):
            total += _bits(prints[i, k], prints[j, k])
            if k:  # the rest of the words only where the first do not rule a link out
                kept = total <= max_bits
                i, j, total = i[kept], j[kept], total[kept]
        kept = total <= max_bits
        if kept.any():
            yield forest(i[kept], j[kept])
        at = upto


def _compare(scheme: Scheme):
    width = scheme.width

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, ["anchor", "cell"]):
            prints, home = run[scheme.columns].to_numpy(np.int64).view(np.uint64), run["home"].to_numpy(bool)
            keys = run[["anchor", "cell"]].to_numpy()
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            size = np.diff(np.r_[first, len(prints)])
            start, end = np.repeat(first, size), np.repeat(first + size, size)
            low, high = np.arange(len(prints)), np.arange(1, len(prints) + 1)
            for g in np.flatnonzero(size > PIVOT_ROWS):
                part = slice(first[g], first[g] + size[g])
                order, lo, hi = _around_pivots(prints[part], scheme.max_bits)
                prints[part], home[part] = prints[part][order], home[part][order]
                low[part], high[part] = first[g] + lo, first[g] + hi
            every = np.repeat(np.logical_and.reduceat(home, first), size)  # where all are at home, one order of a pair will do
            ahead, back = np.flatnonzero(home), np.flatnonzero(home & ~every)
            found = [(np.flatnonzero(low < np.arange(len(low))), low[low < np.arange(len(low))])]
            found += _near(prints, ahead, high[ahead], end[ahead], scheme.max_bits)
            found += _near(prints, back, start[back], low[back], scheme.max_bits)
            i, j = (np.concatenate(x) for x in zip(*found))
            if len(i):
                ends = np.concatenate([prints[i], prints[j]])
                if width == 1:
                    names, place = np.unique(ends[:, 0], return_inverse=True)
                    names = names[:, None]
                else:
                    whole, place = np.unique(np.ascontiguousarray(ends).view(f"V{8 * width}").ravel(), return_inverse=True)
                    names = whole.view(np.uint64).reshape(-1, width)
                u, v = forest(place[: len(i)], place[len(i) :])
                out = np.concatenate([names[u], names[v]], axis=1).view(np.int64)
                yield pd.DataFrame(out, columns=[f"{x}{k}" for x in "uv" for k in range(width)])

    return links


def link_forest(prints: DataFrame, scheme: Scheme = Scheme(), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (u0, ..., v0, ...) between distinct fingerprints that connect what is linked.

    Every edge joins two members of one component. An anchor with more than
    ``cell_rows`` members is cut into a grid of cells, homes by members.
    """
    names, width = scheme.columns, scheme.width
    anchors = prints.mapInPandas(trimmed(_to_anchors(scheme)), ", ".join(["anchor long", *(f"{n} long" for n in names), "home boolean"]))
    hot = anchors.groupBy("anchor").count().where(F.col("count") > cell_rows).select("anchor", F.ceil(F.col("count") / cell_rows).cast("int").alias("cuts"))
    hot = cut(hot)
    if hot.isEmpty():
        celled = anchors.withColumn("cell", F.lit(0).cast("long"))
    else:
        cuts = F.coalesce("cuts", F.lit(1))
        row, column = F.pmod(F.xxhash64(*names), cuts), F.pmod(F.xxhash64(*names, F.lit(1)), cuts)
        every = F.sequence(F.lit(0), cuts - 1)
        joined = anchors.join(hot, "anchor", "left")
        # A home lies in all cells of its row as the one compared, a member in all cells of its column.
        as_home = joined.where("home").select("anchor", *names, F.lit(True).alias("home"), F.explode(F.transform(every, lambda c: row * cuts + c)).alias("cell"))
        as_member = joined.select("anchor", *names, F.lit(False).alias("home"), F.explode(F.transform(every, lambda r: r * cuts + column)).alias("cell"))
        celled = as_home.unionByName(as_member)
    celled = celled.select("anchor", F.col("cell").cast("long"), *names, "home").repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return celled.mapInPandas(trimmed(_compare(scheme)), ", ".join(f"{x}{k} long" for x in "uv" for k in range(width))).distinct()


def classes_of(prints: DataFrame, scheme: Scheme, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(f0, ..., component_id, root): the component of each distinct fingerprint of ``prints`` (doc_id, f0, ...).

    Nodes are ordered by their smallest id, nulls last, so a component's root
    holds its smallest id and no component is gathered to find it.
    """
    names = scheme.columns
    classes = cut(prints.groupBy(*names).agg(F.min("doc_id").alias("first_id")))
    node = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), *names)
    edges = cut(link_forest(classes.select(*names), scheme, cell_rows))
    for x, y in (("u", "a"), ("v", "b")):
        ends = classes.select(*[F.col(n).alias(f"{x}{k}") for k, n in enumerate(names)], node.alias(y))
        edges = edges.join(ends, [f"{x}{k}" for k in range(scheme.width)])
    roots = components(edges.select("a", "b"))
    joined = classes.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return cut(joined.select(*names, F.col("root.id").alias("component_id"), "root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links, the row's own
    included. A null or empty text has fingerprint zero and is linked like any
    other. Repeated rows stay; a null id never becomes a component's id unless
    the component has no other. An empty table gives no rows. Other columns of
    ``docs`` are ignored.
    """
    scheme = Scheme(max_bits=max_bits, slack=max_bits // len(BLOCKS))
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scheme))
    found = classes_of(prints, scheme, cell_rows).select("f0", "component_id")
    # Both sides are bare shuffles, so a fingerprint with very many rows is split.
    return prints.join(found, "f0").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Of each group of texts alike one row of ``docs``: that with the smallest id, of equal ids the one with the smallest hash of its text.

    Rows link where the Jaccard similarity of their sets of word shingles is
    ``similarity`` or more; groups are connected. Wide fingerprints find the
    candidates, the sets decide. A row without an id is kept only where no row of
    its group has one. Null, empty and wordless texts are one group. Equal rows
    are one. All columns stay, whatever their names; an empty table stays empty;
    a text of any length is held whole by a task.

    Texts are shuffled only of rows that a filter of fixed size does not rule out:
    those in groups of more than one row.
    """
    scheme = alike(similarity, shingle_words)
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest")), scheme))
    rows = prints.groupBy("doc_id", "digest", *scheme.columns).agg(F.count("*").alias("n"))  # repeats are counted before they meet
    named = cut(rows.join(classes_of(prints, scheme, cell_rows), scheme.columns).select("doc_id", "digest", "n", F.xxhash64("root").alias("root")))
    sizes = cut(named.groupBy("root").agg((F.sum("n") > 1).alias("several"), (F.min("digest") < F.max("digest")).alias("mixed")))
    named = cut(named.join(sizes, "root"))
    several, mixed = named.where("several"), cut(named.where("mixed").select("root", "digest").distinct())

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    in_mixed = digest_filter(mixed, "digest")
    to_verify = docs.select(digest.alias("digest"), F.col(text_col).alias("text")).where(may_hold(in_mixed)(F.col("digest")))
    distinct = to_verify.groupBy("digest").agg(F.first("text").alias("text"))  # copies meet within each task
    give_back(docs.sparkSession)
    roots = cut(classes(distinct.join(mixed, "digest"), similarity, shingle_words))
    give_back(docs.sparkSession)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest", "n"))
    first = several.join(roots, "digest", "left").groupBy(F.coalesce("class", "digest").alias("class")).agg(best.alias("best"))

    # Only of rows that may be the kept ones of a group the whole row is shuffled, and the exact keys decide.
    key = ["_none", "_id", "_digest"]
    keys = lambda c, d: [c.isNull().alias(key[0]), F.coalesce(c.cast("string"), F.lit("")).alias(key[1]), d.alias(key[2])]
    kept = cut(first.select(*keys(F.col("best.id"), F.col("best.digest")), (F.col("best.n") > 1).alias("_again")).withColumn("_key", F.xxhash64(*key)))
    in_mixed.unpersist()
    in_group, may_stay = may_hold(digest_filter(several, "digest")), may_hold(digest_filter(kept, "_key"))
    lone = named.where(~F.col("several") & in_group(F.col("digest"))).select(*keys(F.col("doc_id"), F.col("digest")), F.lit(False).alias("_again"))
    marked = docs.select(row, *keys(F.col(id_col), digest)).withColumn("_group", in_group(F.col("_digest")))
    alone = marked.where("NOT _group").select("_row")
    lone = cut(lone.withColumn("_key", F.xxhash64(*key)))
    if not lone.isEmpty():  # rows that the filter of groups takes for members
        kept = cut(kept.unionByName(lone))
        may_stay = may_hold(digest_filter(kept, "_key"))
    joined = marked.where("_group").where(may_stay(F.xxhash64(*key))).join(kept.drop("_key"), key)
    whole = lambda df: df.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    if kept.where("_again").isEmpty():
        return whole(joined.select("_row").unionByName(alone))
    return whole(joined.where("NOT _again").select("_row").unionByName(alone).unionByName(joined.where("_again").dropDuplicates(key).select("_row")))
