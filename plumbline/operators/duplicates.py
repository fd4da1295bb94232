"""Exact and near duplicates of short texts: MinHash bands propose, exact Jaccard decides."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import Features
from plumbline.functions.text import deflated, normalised
from plumbline.plans.tables import cut, landed

MERSENNE = (1 << 31) - 1
#: Minima of a sketch for each of the features' permutations; each is kept as four bits.
FINE = 2
#: Rows of a range of sizes beyond which it is cut into cells of about this many.
CELL_ROWS = 50_000
#: Pairs that a task compares at once.
AT_ONCE = 250_000
#: Hashes of shingle sets that a task keeps for the next pairs (32 MB).
HELD = 4_000_000
#: Slots of the filter of fixed size (1 MB) for texts that have a promising partner.
SLOTS = 1 << 23


def exact_groups(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(norm, rep, copies): the first id of each normalised text and its number of rows."""
    return df.groupBy(normalised(F.col(text_col)).alias("norm")).agg(F.min(id_col).alias("rep"), F.count("*").alias("copies"))


def mixed_shingles(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the character k-shingles; a shorter text is one shingle."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = max(1, min(k, len(codes)))
    mixed = np.full(max(1, len(codes) - width + 1), width, np.uint64)
    for j in range(min(width, len(codes))):
        mixed = (mixed ^ codes[j : j + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def shingles_of(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct 31-bit hashes of the character k-shingles."""
    return np.unique(mixed_shingles(text, k) & np.uint64(MERSENNE)).astype(np.int64)


@lru_cache
def affine(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` affine permutations of 32-bit numbers, odd factors."""
    rng = np.random.default_rng(1)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def sketch(hashes: np.ndarray, features: Features) -> np.ndarray:
    """MinHash signature of a set of hashes: minima over affine permutations."""
    a, b = affine(FINE * features.permutations)
    h, low = np.asarray(hashes).astype(np.uint32), np.full(len(a), (1 << 32) - 1, np.uint32)
    room = np.empty((min(256, len(h)), len(a)), np.uint32)  # a block stays in the processor's cache
    for at in range(0, len(h), 256):
        some = h[at : at + 256, None]
        block = room[: len(some)]
        np.multiply(some, a, out=block)
        np.add(block, b, out=block)
        np.minimum(low, block.min(axis=0), out=low)
    return low


def packed(signature: np.ndarray) -> np.ndarray:
    """Four bits of each minimum's hash, two to a byte."""
    four = ((signature * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return (four[0::2] | four[1::2] << 4).view(np.int8)


def sketches(reps: DataFrame, features: Features = Features()) -> DataFrame:
    """(rep, key, size, signature) of each row (columns rep, norm): the text's digest, its number of shingles, its packed minima."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: dict[bytes, tuple[int, np.ndarray]] = {}
            keys = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in batch["norm"]]
            for key, text in zip(keys, batch["norm"]):
                if key not in made:
                    own = mixed_shingles(text, features.shingle)
                    made[key] = len(own), packed(sketch(own & np.uint64(MERSENNE), features))
            yield pd.DataFrame({"rep": batch["rep"], "key": keys, "size": [made[x][0] for x in keys], "signature": [made[x][1] for x in keys]})

    return reps.select("rep", "norm").mapInPandas(make, "rep long, key binary, size int, signature array<tinyint>")


def least_equal(features: Features) -> float:
    """Equal minima that a pair of the wanted similarity has at least.

    Four bits are equal for equal minima and for one in sixteen others; of that
    share the number may fall short by five standard deviations: of ten million
    such pairs, fewer than five are missed.
    """
    n, p = FINE * features.permutations, features.near_jaccard + (1 - features.near_jaccard) / 16
    return n * p - 5 * (n * p * (1 - p)) ** 0.5


def promising(features: Features) -> Column:
    """Whether two sketches (size and signature x, y) may belong to sets of the wanted similarity."""
    same = lambda a, b: F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(15)) == 0, 1).otherwise(0) + F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(240)) == 0, 1).otherwise(0)
    equal = F.aggregate(F.zip_with(F.col("signature_x").cast("array<int>"), F.col("signature_y").cast("array<int>"), same), F.lit(0), lambda s, x: s + x)
    return (F.least("size_x", "size_y") >= features.near_jaccard * F.greatest("size_x", "size_y")) & (equal >= least_equal(features))


def met(size: np.ndarray, signature: np.ndarray, side: np.ndarray, guest: np.ndarray, features: Features) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the promising pairs of a cell that share a band, each once, x not larger than y, some at a time.

    In a cell of two sides pairs are across them; guests don't meet each other.
    """
    order = np.argsort(size, kind="stable")
    size, side, guest = size[order].astype(np.int64), side[order], guest[order]
    raw = np.ascontiguousarray(signature[order]).view(np.uint8)
    four = np.empty((len(raw), 2 * raw.shape[1]), np.uint8)
    four[:, 0::2], four[:, 1::2] = raw & 15, raw >> 4
    words, n = raw.view(np.uint64), four.shape[1]
    bands = np.zeros((len(raw), features.bands), np.int64)
    for r in range(features.rows):
        bands = bands << 4 | four[:, r : features.bands * features.rows : features.rows]
    both, least, ones = len(np.unique(side)) > 1, least_equal(features), np.uint64(0x1111111111111111)
    most = np.floor(size / features.near_jaccard * (1 + 1e-9)).astype(np.int64)
    for k in range(features.bands):
        line = np.lexsort((size, bands[:, k]))
        at = bands[line, k] << 32
        partners = np.searchsorted(at | size[line], at | most[line], "right") - np.arange(len(line)) - 1
        ends = np.cumsum(partners)
        start = 0
        while start < len(line):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            some = partners[start:stop]
            first = np.repeat(np.arange(start, stop), some)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(some) - some, some)
            x, y, start = line[first], line[second], stop
            keep = ~(guest[x] & guest[y])
            if both:
                keep &= side[x] != side[y]
            x, y = x[keep], y[keep]
            apart = words[x] ^ words[y]
            apart |= apart >> np.uint64(1)
            apart |= apart >> np.uint64(2)
            near = n - np.bitwise_count(apart & ones).sum(axis=1, dtype=np.int64) >= least
            x, y = x[near], y[near]
            new = (bands[x, :k] != bands[y, :k]).all(axis=1)
            if new.any():
                yield order[x[new]], order[y[new]]


def likely_pairs(drawn: DataFrame, features: Features = Features(), cell_rows: int = CELL_ROWS) -> DataFrame:
    """(x, y) of promising pairs of sketches (rep, size, signature) that share a band, each once.

    Sets of the wanted similarity have sizes of one range, or the smaller's lies
    at the border to the larger's range, where it is a guest. A range is cut into
    cells by digests, each pair of parts a cell; a sketch is sent to the cells of
    its part, and bands are met within a cell. So what travels is a row of some
    160 bytes a cell, not one a band nor one a pair of a band.
    """
    spark, base = drawn.sparkSession, float(np.log(max(2.0, 1 / features.near_jaccard)))
    of = lambda size: F.floor(F.log(size) / base).cast("int")
    own, next_ = of(F.col("size") * (1 - 1e-9)), of(F.col("size") / features.near_jaccard * (1 + 1e-9))
    placed = drawn.select("rep", "size", "signature", F.explode(F.sequence(own, next_)).alias("range"), own.alias("own"))
    counts = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row a doubling of size
    cuts = {k: -(-n // cell_rows) for k, n in counts.items()}
    table = spark.createDataFrame(list(cuts.items()) or [(0, 1)], "range int, cuts int")
    salted = placed.join(F.broadcast(table), "range").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    dealt = salted.select("rep", "size", "signature", (F.col("own") < F.col("range")).alias("guest"), "range", "salt", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    cells = dealt.select("rep", "size", "signature", "guest", (F.col("salt") > F.col("other")).cast("int").alias("side"), "range", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2_000, sum(c * (c + 1) // 2 for c in cuts.values())))

    def pairs(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = pd.concat(held, ignore_index=True)
        rep, across = cell["rep"].to_numpy(), cell["i"].iloc[0] != cell["j"].iloc[0]
        side = cell["side"].to_numpy()
        if len(cell) > 1 and not (across and side.min() == side.max()):
            for x, y in met(cell["size"].to_numpy(), np.stack(cell["signature"].to_list()), side, cell["guest"].to_numpy(), features):
                yield pd.DataFrame({"x": rep[x], "y": rep[y]})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = [], None
        for batch in batches:
            for key, part in batch.groupby(["range", "i", "j"], sort=False):
                if held and key != at:
                    yield from pairs(held)
                    held = []
                at = key
                held.append(part)
        if held:
            yield from pairs(held)

    keys = ("range", "i", "j")
    return cells.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(task, "x long, y long")


def sought(rows: DataFrame, likely: DataFrame) -> DataFrame:
    """``rows`` (rep) without most of those that are in no pair (x, y): those whose slot nothing takes."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(SLOTS))
    part = F.expr(f"bitmap_bucket_number(pmod(xxhash64(rep), {SLOTS}))")
    marks = likely.select(F.explode(F.array("x", "y")).alias("rep")).select(part.alias("part"), F.bitmap_bit_position(slot).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("part", part).join(F.broadcast(marks), "part").where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def jaccard(a: Column, b: Column, k: int) -> Column:
    """Exact similarity of two deflated texts' shingle sets, which are made again for the pair."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        sets: dict[bytes, np.ndarray] = {}
        room, out = HELD, []

        def made(z: bytes) -> np.ndarray:
            nonlocal room
            if z not in sets:
                own = mixed_shingles(zlib.decompress(z).decode("utf-8", "surrogatepass"), k)
                if room < len(own):
                    sets.clear()
                    room = HELD
                sets[z], room = own, room - len(own)
            return sets[z]

        for s, t in zip(x, y):
            one, other = made(s), made(t)
            line = np.concatenate((one, other))
            line.sort(kind="stable")  # merges two runs
            both = int((line[1:] == line[:-1]).sum())
            out.append(both / (len(line) - both))
        return pd.Series(out, dtype=float)

    return of(a, b)


def scored(likely: DataFrame, texts: DataFrame, features: Features = Features()) -> DataFrame:
    """(a, b, score) of the pairs (x, y) whose texts (rep, norm; a row may occur again) have the wanted similarity, a < b; with a pair the smaller text travels."""
    held = landed(texts.select("rep", deflated("norm").alias("z")).groupBy("rep").agg(F.any_value("z").alias("z")), "texts")
    side = lambda n: held.select(F.col("rep").alias(n), F.col("z").alias(f"z{n}"))
    both = likely.join(side("x"), "x").join(side("y"), "y")
    out = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), jaccard(F.col("zx"), F.col("zy"), features.shingle).alias("score"))
    return out.where(F.col("score") >= features.near_jaccard)


def near_pairs(reps: DataFrame, features: Features = Features(), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Verified pairs (a, b, score) of representatives (rep, norm), a < b; texts travel only where they have a promising partner."""
    likely = cut(likely_pairs(landed(sketches(reps, features).drop("key"), "sketches"), features, cell_rows))
    return scored(likely, sought(reps.select("rep", "norm"), likely), features)


def distinct_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", features: Features = Features()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, key) of each row, (key, rep, copies) of each distinct normalised text, and the verified pairs (a, b, score) of these; a key is a text's digest."""
    raw = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    rows = landed(sketches(raw.select("rep", normalised(F.col("text")).alias("norm")), features), "sketches")
    distinct = landed(rows.groupBy("key").agg(F.min("rep").alias("rep"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("signature").alias("signature")), "distinct")
    likely = cut(likely_pairs(distinct, features))
    pairs = scored(likely, sought(raw, likely).select("rep", normalised(F.col("text")).alias("norm")), features)
    return rows.select(F.col("rep").alias("id"), "key"), distinct.select("key", "rep", "copies"), pairs


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) but the roots: smallest reachable node, by alternating star rounds.

    Nodes may be of any type that has an order. The minima are cut off before
    they are joined, so that both sides of the joins are bare shuffles and the
    rows of a node with very many neighbours can be split. Each step is a table
    of its own, of a file a 50,000 edges and eight at least: the constraints that
    a checkpoint keeps multiply from round to round.
    """
    step = lambda df, n: landed(df.coalesce(max(8, -(-n // 50_000))), "components")
    edges, before = landed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.union(edges.select("v", "u"))
        least = step(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), state[0])
        large = step(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), state[0])
        least = step(large.groupBy("u").agg(F.min("v").alias("m")), state[0])
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = step(small.union(least.select("u", "m")).distinct(), state[0])


def duplicate_groups(df: DataFrame, id_col: str = "id", text_col: str = "text", features: Features = Features()) -> DataFrame:
    """(id, exact_group_id, dup_group_id, dup_of, dup_score) of each row; -1: no group."""
    named, exact, pairs = distinct_pairs(df, id_col, text_col, features)
    edges = cut(pairs)
    roots = components(edges.select("a", "b")).withColumnRenamed("node", "rep")
    best = edges.select(F.col("a").alias("rep"), "score").union(edges.select("b", "score")).groupBy("rep").agg(F.max("score").alias("best"))
    joined = exact.join(roots, "rep", "left").join(best, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = joined.groupBy("root").agg(F.sum("copies").alias("members"))
    reps_out = joined.join(sizes, "root").select(
        "key",
        F.when(F.col("copies") > 1, F.col("rep")).otherwise(-1).alias("exact_group_id"),
        F.when(F.col("members") > 1, F.col("root")).otherwise(-1).alias("dup_group_id"),
        F.when(F.col("copies") > 1, 1.0).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 4)).alias("dup_score"),
    )
    return named.join(reps_out, "key").select("id", "exact_group_id", "dup_group_id", F.col("dup_group_id").alias("dup_of"), "dup_score")


def lsh_parameters(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows) with the least area of false positives below and false negatives above the threshold."""
    grid = np.linspace(0, 1, 2001)
    below, above, width = grid <= threshold, grid >= threshold, grid[1]
    best = None
    for rows in range(1, permutations + 1):
        for n in range(1, permutations // rows + 1):
            p = 1 - (1 - grid**rows) ** n
            cost = 0.5 * (p[below].sum() + (1 - p[above]).sum()) * width
            if best is None or cost < best[0] - 1e-12:
                best = (cost, n, rows)
    return best[1:]

