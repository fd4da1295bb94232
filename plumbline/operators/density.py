"""Hierarchical density clusters of a corpus's vectors.

Core distances come from an exact neighbour join. The minimum spanning tree of
the mutual-reachability graph grows in Borůvka rounds: each component takes its
least edge to another one from the neighbour lists, and only rows whose list
cannot hold it are searched for against all rows. The tree is contracted from
its leaves on, rounds of merges that no other edge can precede, until few enough
edges are left for one task; what happened becomes rows: which points left which
cluster at which distance, and which clusters merged. Clusters are chosen by
excess of mass. Edges are ordered by (distance, smaller id, larger id), so every
step has one outcome, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.blocks import against
from plumbline.operators.duplicates import components
from plumbline.plans.tables import cut, landed

#: Edges of the tree, or components of a round, that one task takes.
TASK_EDGES = 200_000
DIGITS = 8
#: Pairs that are looked at exactly at once, but for those of one row; and numbers that are subtracted at once.
PAIRS_AT_ONCE, NUMBERS_AT_ONCE = 1 << 17, 1 << 20


def distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances, rounded, of the rows ``i`` of ``x`` and ``j`` of ``y``, pair by pair, from differences."""
    out, step = np.empty(len(i)), max(1, NUMBERS_AT_ONCE // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        out[part] = ((x[i[part]] - y[j[part]]) ** 2).sum(axis=1)
    return np.round(np.sqrt(out), DIGITS)


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one product, and by how much those of a row of ``x`` may be off; infinite where a vector isn't finite."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    no_x, no_y = ~np.isfinite(xx), ~np.isfinite(yy)
    if no_x.any() or no_y.any():
        x, y, xx, yy = np.where(no_x[:, None], 0, x), np.where(no_y[:, None], 0, y), np.where(no_x, 0, xx), np.where(no_y, 0, yy)
    left = np.concatenate([-2 * x, xx[:, None], np.ones((len(x), 1))], axis=1)
    square = left @ np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], axis=1).T
    square[no_x], square[:, no_y] = np.inf, np.inf
    return square, 1e-12 * (xx + yy.max(initial=0.0)) + 1e-15


def within(square: np.ndarray, off: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of consecutive rows from, to: the pairs (i, j) whose rounded distance may be at most the one of the row's bound, all that are finite where that isn't."""
    bound = np.maximum(bound, 0)
    top = np.minimum(bound + 3 * (off + np.sqrt(bound + off) * 10.0**-DIGITS), np.finfo(float).max)
    near = square <= top[:, None]
    groups = np.cumsum(near.sum(axis=1)) // PAIRS_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
    for a, b in zip(edges, edges[1:]):
        i, j = np.nonzero(near[a:b])
        yield a, b, i + a, j


def at_most(square: np.ndarray, k: int) -> np.ndarray:
    """A number of each row that at least ``k`` of its entries don't exceed (infinite where it has fewer): the k-th least of minima of parts."""
    n = square.shape[1]
    parts = max(k, min(n // 16, 16 * k))
    if n < 2 * parts:
        return np.partition(square, k - 1, axis=1)[:, k - 1] if n >= k else np.full(len(square), np.inf)
    width = n // parts
    least = square[:, : parts * width].reshape(len(square), width, parts).min(axis=1)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def neighbours(points: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """(id, near): the ``k`` nearest other rows of each row of (id, v) as (d, id), nearest first, ties by id."""

    def compare(queries: pd.DataFrame, y: np.ndarray, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        ids, mine = own["id"].to_numpy(), queries["id"].to_numpy()
        square, off = squares(y, x)
        # The row itself may be among those of the bound, so one more is asked for.
        bound = at_most(square, min(k + 1, len(ids)))
        near = []
        for first, last, i, j in within(square, off, bound):
            other = mine[i] != ids[j]
            i, j = i[other], j[other]
            dist = distances(y, x, i, j)
            order = np.lexsort((ids[j], dist, i))
            i, j, dist = i[order], ids[j[order]], dist[order]
            starts = np.searchsorted(i, np.arange(first, last + 1))
            near += [[{"d": d, "id": n} for d, n in zip(dist[a : min(b, a + k)].tolist(), j[a : min(b, a + k)].tolist())] for a, b in zip(starts, starts[1:])]
        return pd.DataFrame({"id": queries["id"], "near": near})

    found = against(points, points, compare, "id long, near array<struct<d:double,id:bigint>>", block_rows)
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _order(*prefix: str) -> Column:
    return F.struct("w", "a", "b", *prefix)


def roots_of(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (a, b) that aren't the smallest of their component."""
    if edges.count() > TASK_EDGES:
        return components(edges)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for a, b in zip(rows["a"].tolist(), rows["b"].tolist()):
            x, y = sorted((find(a), find(b)))
            root[y] = x
        yield pd.DataFrame([(x, find(x)) for x in root if find(x) != x], columns=["node", "root"]).astype("int64")

    return edges.select("a", "b").coalesce(1).mapInPandas(join, "node long, root long")


def spanning_tree(points: DataFrame, min_samples: int, block_rows: int | None = None) -> DataFrame:
    """(w, a, b): the minimum spanning tree of the mutual-reachability graph of (id, v); a row counts as its own first neighbour."""
    k = 2 * min_samples
    near = cut(neighbours(points, k, block_rows))
    others = min_samples - 1
    core = F.coalesce(F.try_element_at("near", F.lit(others))["d"], F.try_element_at("near", F.lit(-1))["d"], F.lit(0.0)) if others else F.lit(0.0)
    # No row that isn't listed is nearer than this.
    bound = F.when(F.size("near") >= k, F.greatest(core, F.element_at("near", -1)["d"])).otherwise(F.lit(float("inf")))
    cored = cut(near.select("id", core.alias("core"), bound.alias("bound"), "near"))
    listed = cored.select(F.col("id").alias("p"), "core", F.explode("near").alias("n")).select("p", "core", F.col("n.id").alias("q"), F.col("n.d").alias("d"))
    other = cored.select(F.col("id").alias("q"), F.col("core").alias("other"))
    listed = cut(listed.join(other, "q").select(F.greatest("core", "other", "d").alias("w"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    rows = points.join(cored.select("id", "core", "bound"), "id")
    parts, tree = points.select("id", F.col("id").alias("c")), None

    def search(queries: pd.DataFrame, y: np.ndarray, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        ids, mine, core = own["id"].to_numpy(), queries["id"].to_numpy(), own["core"].to_numpy()
        square, off = squares(y, x)
        np.maximum(square, (core * core)[None, :], out=square)
        np.maximum(square, (queries["core"].to_numpy() ** 2)[:, None], out=square)
        square[queries["c"].to_numpy()[:, None] == own["c"].to_numpy()[None, :]] = np.inf
        out = []
        for _, _, i, j in within(square, off, square.min(axis=1)):
            reach = np.maximum(distances(y, x, i, j), np.maximum(queries["core"].to_numpy()[i], core[j]))
            low, high = np.minimum(mine[i], ids[j]), np.maximum(mine[i], ids[j])
            order = np.lexsort((high, low, reach, i))
            least = order[np.diff(i[order], prepend=-1) > 0]
            out.append(pd.DataFrame({"c": queries["c"].to_numpy()[i[least]], "w": reach[least], "a": low[least], "b": high[least]}))
        return pd.concat(out, ignore_index=True)

    while True:
        ends = listed.join(parts.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(parts.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca <> cb")
        listed = landed(ends.select("w", "a", "b", "ca", "cb"), "density")
        sides = listed.select(F.col("ca").alias("c"), "w", "a", "b").union(listed.select("cb", "w", "a", "b"))
        listed = listed.select("w", "a", "b")
        best = sides.groupBy("c").agg(F.min(_order()).alias("e"))
        placed = rows.join(parts, "id").join(best.select("c", F.col("e.w").alias("least")), "c", "left")
        unsure = cut(placed.where("least IS NULL OR bound <= least").select("id", "v", "core", "c"))
        if parts.select("c").distinct().limit(2).count() < 2:
            break
        if not unsure.isEmpty():
            more = against(placed.select("id", "v", "core", "c"), unsure, search, "c long, w double, a long, b long", block_rows)
            best = best.select("c", "e.*").union(more).groupBy("c").agg(F.min(_order()).alias("e"))
        best = cut(best.select("e.*").distinct())
        if best.isEmpty():
            break
        tree = best if tree is None else tree.union(best)
        met = best.join(parts.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(parts.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        joined = roots_of(met.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        parts = landed(parts.join(joined.withColumnRenamed("node", "c"), "c", "left").select("id", F.coalesce("root", "c").alias("c")), "density")
    return cut(tree) if tree is not None else points.sparkSession.createDataFrame([], "w double, a long, b long")


EVENT = "kind string, x long, w double, y long"


def kruskal(edges: list[tuple], sizes: dict[int, int], nodes: dict[int, int], min_size: int) -> Iterator[tuple]:
    """Events of the edges (w, a, b, eid, u, v) in order, between components u, v with sizes and cluster nodes.

    ("drop", component, w, node): a small component's points leave or found the
    node; ("merge", node, w, node): a node ends in another one; ("make", node, w, node).
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    inside: dict[int, list[int]] = {c: [c] for c in sizes if c not in nodes}
    for w, _, _, eid, u, v in sorted(edges):
        u, v = find(u), find(v)
        big = [x for x in (u, v) if x in nodes]
        small = [x for x in (u, v) if x not in nodes]
        if len(big) == 2:
            yield from (("merge", nodes.pop(x), w, eid) for x in big)
            yield "make", eid, w, eid
            node = eid
        elif big:
            node = nodes.pop(big[0])
        elif sizes[u] + sizes[v] >= min_size:
            node = eid
            yield "make", eid, w, eid
        else:
            node, small = None, []
            inside[u] += inside.pop(v)
        for x in small:
            yield from (("drop", c, w, node) for c in inside.pop(x))
        root[v] = u
        sizes[u] += sizes.pop(v)
        if node is not None:
            nodes[u] = node


def hierarchy(tree: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(point, w, node): the distance from which on a point is in a cluster, and in which; and the nodes' events (kind, x, w, y).

    Components of under ``min_size`` points are small. Rounds contract, all at
    once, (i) edges that are the least of both their ends, and (ii) the edges by
    which small components join a big one, as far as no other edge of that comes
    before. What is left of ``TASK_EDGES`` edges or fewer is one task's.
    """
    edges = cut(tree.select("w", "a", "b", F.monotonically_increasing_id().alias("eid"), F.col("a").alias("u"), F.col("b").alias("v")))
    ids = cut(tree.select(F.col("a").alias("id")).union(tree.select("b")).distinct())
    points = ids.select(F.col("id").alias("point"), F.col("id").alias("c"))
    comps = ids.select(F.col("id").alias("c"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("node"))
    found, events = [], []
    while edges.count() > TASK_EDGES:
        order = F.struct("w", "a", "b")
        of = lambda x: comps.select(F.col("c").alias(x), F.col("size").alias(f"s{x}"), F.col("node").alias(f"n{x}"))
        known = edges.join(of("u"), "u").join(of("v"), "v")
        sides = known.select(F.col("u").alias("c"), order.alias("o"), "eid").union(known.select("v", order, "eid"))
        least = sides.groupBy("c").agg(F.min("o").alias("o"))
        known = known.join(least.select(F.col("c").alias("u"), F.col("o").alias("ou")), "u").join(least.select(F.col("c").alias("v"), F.col("o").alias("ov")), "v")
        known = known.withColumns({"own": order, "bu": F.col("nu").isNotNull(), "bv": F.col("nv").isNotNull()})
        # An edge by which its small end joins the big one, next after what stands before it.
        known = known.withColumn("joins", (F.col("bu") & ~F.col("bv") & (F.col("ov") == F.col("own"))) | (F.col("bv") & ~F.col("bu") & (F.col("ou") == F.col("own"))))
        known = landed(known, "density")
        stops = known.where("NOT joins")
        stops = stops.where("bu").select(F.col("u").alias("c"), "own").union(stops.where("bv").select("v", "own")).groupBy("c").agg(F.min("own").alias("stop"))
        joins = known.where("joins").withColumn("c", F.when(F.col("bu"), F.col("u")).otherwise(F.col("v"))).join(stops, "c", "left").where("stop IS NULL OR own < stop")
        joins = joins.select("eid", "w", "c", F.when(F.col("bu"), F.col("v")).otherwise(F.col("u")).alias("x"), F.coalesce("nu", "nv").alias("node"), F.lit("join").alias("kind"))
        pairs = known.where("ou = own AND ov = own AND bu = bv")
        made = F.when(F.col("bu"), "both").when(F.col("su") + F.col("sv") >= min_size, "birth").otherwise("small")
        pairs = pairs.select("eid", "w", F.least("u", "v").alias("c"), F.greatest("u", "v").alias("x"), "u", "v", "nu", "nv", made.alias("kind"))
        done = landed(joins.withColumns({"u": F.lit(None).cast("long"), "v": F.lit(None).cast("long"), "nu": F.lit(None).cast("long"), "nv": F.lit(None).cast("long")}).unionByName(pairs.withColumn("node", F.col("eid"))), "density")
        drops = done.where("kind = 'join'").select(F.col("x").alias("c"), "w", "node").union(done.where("kind = 'birth'").select(F.explode(F.array("u", "v")), "w", "eid"))
        merges = done.where("kind = 'both'").select(F.lit("merge").alias("kind"), F.explode(F.array("nu", "nv")).alias("x"), "w", F.col("eid").alias("y"))
        makes = done.where("kind IN ('both', 'birth')").select(F.lit("make").alias("kind"), F.col("eid").alias("x"), "w", F.col("eid").alias("y"))
        events.append(landed(merges.union(makes), "density"))
        found.append(landed(points.join(drops, "c").select("point", "w", "node"), "density"))
        points = points.join(drops.select("c"), "c", "left_anti")
        new = done.select(F.col("x").alias("old"), F.col("c").alias("into"))
        place = lambda df, x: df.join(new.withColumnRenamed("old", x), x, "left").withColumn(x, F.coalesce("into", x)).drop("into")
        points = landed(place(points, "c"), "density")
        grown = done.select("c", F.when(F.col("kind") != "small", F.col("node")).alias("made"))
        sizes = place(comps, "c").groupBy("c").agg(F.sum("size").alias("size"), F.max(F.when(F.col("node").isNotNull(), F.col("node"))).alias("node"))
        comps = landed(sizes.join(grown.groupBy("c").agg(F.max("made").alias("made")), "c", "left").select("c", "size", F.coalesce("made", "node").alias("node")), "density")
        edges = landed(place(place(edges.join(done.select("eid"), "eid", "left_anti"), "u"), "v").select("w", "a", "b", "eid", "u", "v"), "density")

    rows = edges.select(F.lit(0).alias("what"), "w", "a", "b", "eid", "u", "v").union(comps.select(F.lit(1), F.lit(0.0), "size", F.coalesce("node", F.lit(-1)), F.lit(0), "c", F.lit(0)))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        own, alive = rows[rows["what"] == 0], rows[rows["what"] == 1]
        links = [tuple(r) for r in own[["w", "a", "b", "eid", "u", "v"]].itertuples(index=False)]
        nodes = {c: n for c, n in zip(alive["u"].tolist(), alive["b"].tolist()) if n >= 0}
        yield pd.DataFrame(list(kruskal(links, dict(zip(alive["u"].tolist(), alive["a"].tolist())), nodes, min_size)), columns=["kind", "x", "w", "y"])

    last = cut(rows.coalesce(1).mapInPandas(rest, EVENT))
    events.append(last.where("kind <> 'drop'"))
    found.append(points.join(last.where("kind = 'drop'").select(F.col("x").alias("c"), "w", F.col("y").alias("node")), "c").select("point", "w", "node"))
    return reduce(DataFrame.union, found), reduce(DataFrame.union, events)


def chosen(nodes: dict[int, dict]) -> dict[int, int]:
    """Of each cluster node the chosen node that it lies in, -1 without one: excess of mass, the root never chosen.

    A node has ``w`` (where it begins, from below), ``up`` (the node that it ends
    in, or None), ``n`` and ``mass``: its own points and the sum of their densities.
    """
    below: dict[int, list[int]] = {x: [] for x in nodes}
    for x, node in nodes.items():
        if node["up"] is not None:
            below[node["up"]].append(x)
    order, todo = [], [x for x, node in nodes.items() if node["up"] is None]
    roots = set(todo)
    while todo:
        order.append(x := todo.pop())
        todo += below[x]
    density = lambda w: 1 / max(w, 1e-12)
    points, kept, taken = {}, {}, set()
    for x in reversed(order):
        node = nodes[x]
        inner = sum(points[y] for y in below[x])
        points[x] = inner + node["n"]
        start = 0.0 if x in roots else density(nodes[node["up"]]["w"])
        mass = node["mass"] - node["n"] * start + inner * (density(node["w"]) - start)
        parts = sum(kept[y] for y in below[x])
        if x in roots or below[x] and parts > mass:
            kept[x] = parts
        else:
            kept[x] = mass
            taken.add(x)
    out: dict[int, int] = {}
    for x in order:
        up = nodes[x]["up"]
        out[x] = out[up] if up is not None and out[up] >= 0 else x if x in taken else -1
    return out


def density_clusters(df: DataFrame, min_size: int = 15, min_samples: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """(id, cluster) of each row: the smallest id of its density cluster, -1 for noise.

    Rows without a vector, and all rows of tables of under twice ``min_size``,
    are noise. Ids must be unique. ``min_samples`` (as ``min_size`` if not given)
    is the rank of the neighbour, the row itself included, whose distance is a
    row's core distance. One task gets the cluster nodes: each has at least
    ``min_size`` points. The neighbour join is quadratic by nature.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    points = cut(rows.where("v IS NOT NULL"))
    if points.count() < 2 * min_size:
        return rows.select("id", F.lit(-1).cast("long").alias("cluster"))
    found, events = hierarchy(spanning_tree(points, min_samples or min_size, block_rows), min_size)
    found = cut(found)
    own = found.groupBy("node").agg(F.count("*").alias("n"), F.sum(1 / F.greatest("w", F.lit(1e-12))).alias("mass"))
    made = events.where("kind = 'make'").select(F.col("x").alias("node"), "w")
    ends = events.where("kind = 'merge'").select(F.col("x").alias("node"), F.col("y").alias("up"))
    nodes = made.join(own, "node", "left").join(ends, "node", "left").select("node", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("up", F.lit(-1)).alias("up"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).to_dict("records")
        table = {r["node"]: r | {"up": r["up"] if r["up"] >= 0 else None} for r in rows}
        yield pd.DataFrame(list(chosen(table).items()), columns=["node", "within"]).astype("int64")

    within = nodes.coalesce(1).mapInPandas(choose, "node long, within long").where("within >= 0")
    clustered = cut(found.join(within, "node").select("point", "within"))
    names = clustered.groupBy("within").agg(F.min("point").alias("cluster"))
    named = clustered.join(names, "within").select(F.col("point").alias("id"), "cluster")
    return rows.select("id").join(named, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
