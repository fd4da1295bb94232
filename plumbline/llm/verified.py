"""Exact similarity within groups of candidates, without pairs.

Candidates come as groups: rows (root, digest, text) in which any two texts may
be alike. Links are pairs of texts whose sets of word shingles have a Jaccard
similarity of at least the threshold; what is returned connects exactly the texts
that links connect, with fewer edges than texts for each task's share.

A small group is one task's: an inverted index of its shingles, searched from text
to text until all that is reachable has been reached. A large group is first
compared with a few pivots. What links to the same pivots is one class already;
only blocks of different classes, and what no pivot reached, are then compared,
a pair of blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, runs, texts, trimmed
from plumbline.operators.duplicates import components

#: Texts and characters of a group, or of a block of a large group, that one task holds.
GROUP_ROWS, GROUP_CHARS = 256, 4_000_000
#: Pivots of a large group.
PIVOTS = 8
#: Bits of a filter of digests: 2 MB, whatever the number of digests.
FILTER_BITS = 1 << 24


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text in order, repeats included; fewer words are one shingle, none give none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :])], np.uint64)


def linked(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (i, j), each of similarity ``similarity`` or more, that connect all such pairs; with ``side`` only pairs of different sides count.

    ``sets`` are distinct values each. Two empty sets are alike.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    values, token = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders, first = owner[order], np.searchsorted(token[order], np.arange(len(values) + 1))
    starts = np.cumsum(size) - size
    new, out = np.ones(n, bool), []
    for seed in range(n):
        if not new[seed]:
            continue
        new[seed], queue = False, [seed]
        while queue and new.any():
            p = queue.pop()
            own = token[starts[p] : starts[p] + size[p]]
            lo, count = first[own], first[own + 1] - first[own]
            at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(holders[at], minlength=n)
            alike = (both >= similarity * (size[p] + size - both) - 1e-9) & new
            if side is not None:
                alike &= side != side[p]
            near = np.flatnonzero(alike).tolist()
            new[near] = False
            queue += near
            out += [(p, q) for q in near]
    return out


def _sets(column: pd.Series, words: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t, words)) for t in texts(column)]


def digest_filter(rows: DataFrame, column: str) -> Broadcast:
    """A Bloom filter of a column of longs, of a fixed size: what it rules out is not there."""
    bits = rows.select(F.explode(F.array(*[F.pmod(F.xxhash64(column, F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2)])).alias("bit"))
    found = bits.groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.array(*[F.lit(1 << k) for k in range(8)])[F.pmod("bit", F.lit(8)).cast("int")]).alias("byte")).toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[found["at"].to_numpy()] = found["byte"].to_numpy().astype(np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def may_hold(shared: Broadcast):
    """A column function: whether the filter may hold a long."""

    @F.pandas_udf("boolean")
    def look(first: pd.Series, second: pd.Series) -> pd.Series:
        bits, a, b = shared.value, first.to_numpy(), second.to_numpy()
        return pd.Series((bits[a >> 3] >> (a & 7) & bits[b >> 3] >> (b & 7) & 1).astype(bool))

    return lambda column: look(*[F.pmod(F.xxhash64(column, F.lit(k)), F.lit(FILTER_BITS)) for k in (1, 2)])


def classes(members: DataFrame, similarity: float, words: int) -> DataFrame:
    """(digest, class) of ``members`` (root, digest, text; root and digest longs, a digest once a root) that are linked: the smallest digest that links lead to."""
    members = cut(members)
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    parts = F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("chars") / GROUP_CHARS)).cast("int")
    sizes = cut(sizes.where("n > 1").select("root", parts.alias("parts")))
    rows = members.join(sizes, "root")

    def whole(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, ["root"]):
            out = []
            for _, group in run.groupby("root", sort=False):
                digests, of = group["digest"].to_numpy(), {}
                for i, j in linked(_sets(group["text"], words), similarity):  # each text is reached once, from one before it
                    of.setdefault(i, [i]).append(j)
                    of[j] = of[i]
                for own in {id(x): x for x in of.values()}.values():
                    least = int(digests[own].min())
                    out += [(int(d), least) for d in digests[own]]
            yield pd.DataFrame(out, columns=["digest", "class"])

    # Not by the join's own key: such a repartition is planned away, and what adaptive execution then does to the join would part a group.
    small = rows.where("parts = 1").select("root", "digest", "text").repartition(F.xxhash64("root", F.lit("group"))).sortWithinPartitions("root")
    found = small.mapInPandas(trimmed(whole), "digest long, class long")
    if sizes.where("parts > 1").isEmpty():
        return found
    roots = components(_large(rows.where("parts > 1"), similarity, words))
    named = roots.select(F.col("node").alias("digest"), F.col("root").alias("class"))
    return found.unionByName(named).unionByName(named.select(F.col("class").alias("digest"), "class").distinct())


def _large(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """Edges (a, b) of large groups that connect what is linked: rows (root, digest, text, parts)."""
    pivots = rows.groupBy("root").agg(F.min_by(F.struct("digest", "text"), F.xxhash64("digest")).alias("p0"), *[F.min_by(F.struct("digest", "text"), F.xxhash64("digest", F.lit(k))).alias(f"p{k}") for k in range(1, PIVOTS)])
    pivots = cut(pivots.select("root", F.array(*[f"p{k}" for k in range(PIVOTS)]).alias("pivots")))

    def against(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, known = None, {}
        for batch in batches:
            out = []
            for r, digest, text, own in zip(batch["root"], batch["digest"], texts(batch["text"]), batch["pivots"]):
                if r != root:
                    root, known = r, {p["digest"]: np.unique(shingle_hashes(p["text"], words)) for p in own}
                mine = np.unique(shingle_hashes(text, words))
                for other, theirs in known.items():
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if other != digest and both >= similarity * (len(mine) + len(theirs) - both) - 1e-9:
                        out.append((int(digest), int(other)))
            yield pd.DataFrame(out, columns=["a", "b"])

    to_pivots = cut(rows.join(pivots, "root").mapInPandas(trimmed(against), "a long, b long"))
    classes = components(to_pivots).withColumnRenamed("node", "digest").withColumnRenamed("root", "class")
    heads = classes.select(F.col("class").alias("digest"), "class").distinct()
    classed = cut(rows.join(classes.unionByName(heads), "digest", "left").select("root", "digest", "text", "parts", "class"))
    # Blocks of one class, and blocks of rows without one; a block is named by its class and a number.
    numbered = classed.select("root", "digest", "text", "class", F.pmod(F.xxhash64("digest", F.lit(0)), F.col("parts")).alias("number"))
    blocks = cut(numbered.groupBy("root", "class", "number").agg(F.count("*").alias("n")).select("root", F.struct(F.col("class").isNull().alias("open"), F.coalesce("class", F.lit(0)).alias("class"), "number").alias("block")))
    one, two = blocks.select("root", F.col("block").alias("x")), blocks.select("root", F.col("block").alias("y"))
    cells = one.join(two, "root").where((F.col("x") < F.col("y")) & ((F.col("x.class") != F.col("y.class")) | (F.col("x.open") != F.col("y.open")) | F.col("x.open")) | (F.col("x") == F.col("y")) & F.col("x.open"))
    cells = cut(cells.select("root", "x", "y", F.xxhash64("root", "x", "y").alias("cell")))
    placed = cells.select("root", F.col("x").alias("block"), "cell", F.lit(0).alias("side")).unionByName(cells.where("x <> y").select("root", F.col("y").alias("block"), "cell", F.lit(1).alias("side")))
    own = numbered.select("root", F.struct(F.col("class").isNull().alias("open"), F.coalesce("class", F.lit(0)).alias("class"), "number").alias("block"), "digest", "text")

    def across(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, ["cell"]):
            out = []
            for _, group in run.groupby("cell", sort=False):
                digests, side = group["digest"].to_numpy(), group["side"].to_numpy()
                found = linked(_sets(group["text"], words), similarity, side if side.any() else None)
                out += [(int(digests[i]), int(digests[j])) for i, j in found]
            yield pd.DataFrame(out, columns=["a", "b"])

    dealt = own.join(placed, ["root", "block"]).select("cell", "side", "digest", "text").repartition(F.xxhash64("cell", F.lit("group"))).sortWithinPartitions("cell")
    return to_pivots.unionByName(dealt.mapInPandas(trimmed(across), "a long, b long"))
