"""Graphs over the levels of a categorical predictor: frames for large graphs, numpy for splits within a fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.lineage import durable

Edges = list[tuple[int, int]]  #: pairs, or triples with weights
MEMO = 20_000  #: splits that a chain keeps


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among ``vertices`` (v)."""
    for end in ("src", "dst"):
        edges = edges.join(vertices.select(F.col("v").alias(end)), end, "left_semi")
    return edges.select("src", "dst")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable. Rounds of taking the smallest label around and of jumping to
    that label's own label; lineage is cut in each by a checkpoint."""
    both = symmetric(edges).persist()
    now = vertices.select("v", F.col("v").alias("c"))
    while True:
        near = both.join(now, both["dst"] == now["v"]).groupBy("src").agg(F.min("c").alias("m"))
        low = now.join(near, now["v"] == near["src"], "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = now.select(F.col("v").alias("n"), F.col("c").alias("cc"))
        new = durable(low.join(jump, "n", "left").select("v", "c", F.least("n", F.coalesce("cc", "n")).alias("d")))
        moved = not new.where("c <> d").isEmpty()
        now = new.select("v", F.col("d").alias("c"))
        if not moved:
            both.unpersist()
            return now.select("v", F.col("c").alias("component"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(v, distance): hops from the nearest of ``sources`` (v), for vertices that are reached."""
    both, found, step = symmetric(edges), sources.select("v").distinct().withColumn("distance", F.lit(0)), 0
    front = found
    while not front.isEmpty():
        step += 1
        reached = both.join(front, both["src"] == front["v"]).select(F.col("dst").alias("v")).distinct()
        front = durable(reached.join(found, "v", "left_anti").withColumn("distance", F.lit(step)))
        found = durable(found.union(front))
    return found


def adjacency(edges: DataFrame, vertices: list[int]) -> DataFrame:
    """The wide matrix of weights (src, dst, weight): a row per vertex and a column for each of ``vertices``."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    every = edges.sparkSession.createDataFrame([(v,) for v in vertices], "vertex int")
    wide = both.groupBy(F.col("src").alias("vertex")).pivot("dst", vertices).agg(F.max("weight"))
    return every.join(wide, "vertex", "left").na.fill(0.0)


def all_distances(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, distance) of every pair of vertices (v) over edges (src, dst, weight): the least sum of weights,
    or the square of the number of vertices where there is no path. Paths grow by an edge a round until none gets
    shorter; the result has a row per pair, so it is meant for the levels of a predictor."""
    both = durable(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    now = durable(vertices.select(F.col("v").alias("s"), F.col("v").alias("t"), F.lit(0.0).alias("d")))
    front = now
    while not front.isEmpty():
        longer = front.join(both, front["t"] == both["src"]).select("s", F.col("dst").alias("t"), (F.col("d") + F.col("weight")).alias("new")).groupBy("s", "t").agg(F.min("new").alias("new"))
        front = durable(longer.join(now, ["s", "t"], "left").where("d IS NULL OR new < d").select("s", "t", F.col("new").alias("d")))
        now = durable(now.join(front.select("s", "t"), ["s", "t"], "left_anti").union(front))
    far = vertices.agg((F.count("*") * F.count("*")).cast("double").alias("far"))
    pairs = vertices.select(F.col("v").alias("s")).crossJoin(vertices.select(F.col("v").alias("t")))
    return pairs.join(now, ["s", "t"], "left").crossJoin(F.broadcast(far)).select(F.col("s").alias("src"), F.col("t").alias("dst"), F.coalesce("d", "far").alias("distance"))


def minimum_tree(vertices, edges: Edges, weights) -> Edges:
    """A spanning forest of least weight; of equal edges the earlier one."""
    group, out = {v: v for v in vertices}, []

    def root(v: int) -> int:
        while group[v] != v:
            group[v] = group[group[v]]
            v = group[v]
        return v

    for k in sorted(range(len(edges)), key=lambda k: (weights[k], k)):
        a, b = root(edges[k][0]), root(edges[k][1])
        if a != b:
            group[a] = b
            out.append(edges[k])
    return out


def components_of(vertices, edges: Edges) -> list[list[int]]:
    """Components in order of their smallest vertex."""
    near: dict[int, list[int]] = {v: [] for v in vertices}
    for a, b in edges:
        if a in near and b in near:
            near[a].append(b)
            near[b].append(a)
    out, seen = [], set()
    for v in sorted(near):
        if v not in seen:
            group, todo = [], [v]
            seen.add(v)
            while todo:
                group.append(u := todo.pop())
                fresh = [w for w in near[u] if w not in seen]
                seen.update(fresh)
                todo += fresh
            out.append(sorted(set(group)))
    return out


def spanning_tree(vertices, edges: Edges, rng: np.random.Generator, weights: np.ndarray | None = None) -> Edges:
    """A spanning tree of a connected graph by loop-erased random walks from each vertex to the tree: a uniform one
    or, with ``weights``, one of probability proportional to the product of its edges' weights."""
    near: dict[int, list[int]] = {v: [] for v in vertices}
    heavy: dict[int, list[float]] = {v: [] for v in vertices}
    for (a, b), w in zip(edges, [1.0] * len(edges) if weights is None else weights, strict=True):
        near[a].append(b)
        near[b].append(a)
        heavy[a].append(w)
        heavy[b].append(w)
    upto = {} if weights is None else {v: np.cumsum(w) for v, w in heavy.items()}

    def step(u: int) -> int:
        if weights is None:
            return near[u][int(rng.random() * len(near[u]))]
        return near[u][int(np.searchsorted(upto[u], rng.random() * upto[u][-1], "right"))]

    order = sorted(near)
    after: dict[int, int] = {}
    inside = {order[int(rng.integers(len(order)))]}
    for v in order:
        u = v
        while u not in inside:
            after[u] = step(u)
            u = after[u]
        u = v
        while u not in inside:
            inside.add(u)
            u = after[u]
    return [(v, u) for v, u in after.items() if v in inside][: len(order) - 1]


def without_edge(vertices, tree: Edges, k: int) -> tuple[list[int], list[int]]:
    """Sides of a tree without its k-th edge; the side with the smallest vertex is left."""
    a, b = components_of(vertices, tree[:k] + tree[k + 1 :])
    return a, b


def smaller_sides(vertices, tree: Edges) -> np.ndarray:
    """For each edge of a tree the size of the smaller side, from subtree sizes in one walk."""
    near: dict[int, list[tuple[int, int]]] = {v: [] for v in vertices}
    for k, (a, b) in enumerate(tree):
        near[a].append((b, k))
        near[b].append((a, k))
    root = min(near)
    order, up = [root], {root: (root, -1)}
    for v in order:
        for w, k in near[v]:
            if w not in up:
                up[w] = (v, k)
                order.append(w)
    size, out = dict.fromkeys(near, 1), np.zeros(len(tree))
    for v in reversed(order[1:]):
        parent, k = up[v]
        size[parent] += size[v]
        out[k] = min(size[v], len(near) - size[v])
    return out


def fiedler(vertices, edges: Edges, weights: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Sides by the sign of the eigenvector of the second smallest eigenvalue of the Laplacian."""
    order = sorted(vertices)
    at = {v: i for i, v in enumerate(order)}
    laplacian = np.zeros((len(order), len(order)))
    for (a, b), w in zip(edges, np.ones(len(edges)) if weights is None else weights, strict=True):
        i, j = at[a], at[b]
        laplacian[i, j] -= w
        laplacian[j, i] -= w
        laplacian[i, i] += w
        laplacian[j, j] += w
    vector = np.linalg.eigh(laplacian)[1][:, 1]
    # The sign is arbitrary: the first entry that is not 0 is negative, so the smallest vertex tends to be left.
    first = np.flatnonzero(np.abs(vector) > 1e-12)
    left = (vector if not len(first) or vector[first[0]] < 0 else -vector) < -1e-12
    return [v for v, s in zip(order, left, strict=True) if s], [v for v, s in zip(order, left, strict=True) if not s]


def coin_split(items: list, rng: np.random.Generator) -> tuple[list, list]:
    """A fair coin per item until both sides have one."""
    while True:
        heads = rng.random(len(items)) < 0.5
        if 0 < heads.sum() < len(items):
            return [x for x, h in zip(items, heads, strict=True) if h], [x for x, h in zip(items, heads, strict=True) if not h]


def graph_split(vertices, edges: Edges, cut_type: int, rng: np.random.Generator, memo: dict | None = None) -> tuple[list[int], list[int]]:
    """Two sides of a set of two or more vertices: whole components by coins, or a connected graph by
    1 Fiedler, 2 Fiedler with random weights, or a uniform spanning tree cut at 3 a uniform edge, 4 the most
    even edge, 5 an edge by evenness, 6 its Fiedler vector, 7 that with random weights; 0 picks 1 to 7. ``memo`` keeps components and
    Fiedler splits, which depend on the set alone, MEMO of them at most."""
    memo = {} if memo is None else memo
    if len(memo) > MEMO:
        memo.clear()
    key = (id(edges), frozenset(vertices))
    if cut_type == 1 and key in memo:
        return memo[key]
    inside = set(vertices)
    kept = [e for e in edges if e[0] in inside and e[1] in inside]
    edges, heavy = [(e[0], e[1]) for e in kept], np.array([e[2] if len(e) > 2 else 1.0 for e in kept])
    groups = components_of(vertices, edges)
    if len(groups) > 1:
        left, right = coin_split(groups, rng)
        return sorted(sum(left, [])), sorted(sum(right, []))
    kind = cut_type or int(rng.integers(1, 8))
    if kind == 1:
        if key not in memo:
            memo[key] = fiedler(vertices, edges, heavy)
        return memo[key]
    if kind == 2:
        return fiedler(vertices, edges, rng.random(len(edges)))
    tree = spanning_tree(vertices, edges, rng, None if (heavy == heavy[0]).all() else heavy)
    if kind in (6, 7):
        return fiedler(vertices, tree, rng.random(len(tree)) if kind == 7 else None)
    if kind == 3:
        k = int(rng.integers(len(tree)))
    else:
        side = smaller_sides(vertices, tree)
        k = int(side.argmax()) if kind == 4 else int(rng.choice(len(tree), p=side / side.sum()))
    return without_edge(vertices, tree, k)
