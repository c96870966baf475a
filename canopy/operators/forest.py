"""Stored forests: trees, routing, scoring and what is read off them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forests with at most this many nodes are compiled to CASE expressions; larger ones are scored in Arrow batches.
COMPILED_NODES = 600
#: Forests with more nodes are not broadcast: some 50 bytes a node.
BROADCAST_NODES = 10_000_000


@dataclass(frozen=True)
class Node:
    is_cat: bool
    var: int
    cut: float = 0.0
    left: frozenset = frozenset()
    right: frozenset = frozenset()
    k: int = 0


@dataclass
class Tree:
    """Rules and leaf values by node id: the root is 1, the children of n are 2n and 2n + 1."""

    rules: dict[int, Node] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=lambda: {1: 0.0})

    def route(self, cont: np.ndarray | None, cat: np.ndarray | None, n: int) -> np.ndarray:
        """The leaf of each row; 0 where a value is NaN or a level on neither side."""
        at = np.ones(n, np.int64)
        for nid in sorted(self.rules):
            rule, here = self.rules[nid], np.flatnonzero(at == nid)
            if rule.is_cat:
                x = cat[here, rule.var]
                left, right = np.isin(x, list(rule.left)), np.isin(x, list(rule.right))
            else:
                x = cont[here, rule.var]
                left, right = x < rule.cut, x >= rule.cut
            at[here] = np.where(left & ~right, 2 * nid, np.where(right & ~left, 2 * nid + 1, 0))
        return at

    def evaluate(self, cont, cat, n: int) -> np.ndarray:
        at, out = self.route(cont, cat, n), np.full(n, np.nan)
        for nid, mu in self.leaves.items():
            out[at == nid] = mu
        return out

    def interval(self, nid: int, var: int, low: float = -1.0, high: float = 1.0) -> tuple[float, float]:
        """The tightest cuts of ancestors on a continuous variable."""
        while nid > 1:
            parent = self.rules[nid // 2]
            if not parent.is_cat and parent.var == var:
                low, high = (low, min(high, parent.cut)) if nid % 2 == 0 else (max(low, parent.cut), high)
            nid //= 2
        return low, high

    def levels(self, nid: int, var: int, universe) -> list[int]:
        """The side of the nearest ancestor on a categorical variable, or all of its levels."""
        while nid > 1:
            parent = self.rules[nid // 2]
            if parent.is_cat and parent.var == var:
                return sorted(parent.left if nid % 2 == 0 else parent.right)
            nid //= 2
        return sorted(universe)

    def prunable(self) -> list[int]:
        """Rules with two leaves below them."""
        return [n for n in self.rules if 2 * n not in self.rules and 2 * n + 1 not in self.rules]

    def copy(self) -> Tree:
        return Tree(dict(self.rules), dict(self.leaves))

    def reset(self) -> None:
        """Back to one leaf of value 0."""
        self.rules, self.leaves = {}, {1: 0.0}

    def __str__(self) -> str:
        def line(nid: int) -> list[str]:
            pad = "  " * (nid.bit_length() - 1)
            if nid in self.leaves:
                return [f"{pad}{nid}: {self.leaves[nid]:g}"]
            r = self.rules[nid]
            said = f"x_cat[{r.var}] in {sorted(r.left)} or {sorted(r.right)}" if r.is_cat else f"x_cont[{r.var}] < {r.cut:g}"
            return [f"{pad}{nid}: {said}", *line(2 * nid), *line(2 * nid + 1)]

        return "\n".join(line(1))


class FlatForest:
    """Trees as flat arrays, evaluated level by level for all trees and many rows at once. Node 0 is where rows go
    that a rule cannot place, and has no value."""

    CELLS = 1 << 20  #: trees x rows in work at once

    def __init__(self, trees: list[Tree]):
        kind, var, cut, child, offset, width, mu, sides, roots = [0], [0], [0.0], [0], [0], [0], [np.nan], [], []
        for t in trees:
            place = {}
            for nid in sorted([*t.rules, *t.leaves], key=lambda n: (n.bit_length(), n)):
                place[nid] = len(kind)
                rule = t.rules.get(nid)
                kind.append(0 if rule is None else 1 + rule.is_cat)
                var.append(0 if rule is None else rule.var)
                cut.append(0.0 if rule is None else rule.cut)
                child.append(0)
                offset.append(len(sides))
                k = 0 if rule is None or not rule.is_cat else max([rule.k, *(v + 1 for v in rule.left | rule.right)])
                width.append(k)
                mu.append(t.leaves.get(nid, np.nan))
                sides += [(1 if v in rule.left else 0) + (2 if v in rule.right else 0) for v in range(k)]
            for nid in t.rules:
                child[place[nid]] = place[2 * nid]  # siblings stand side by side
            roots.append(place[1])
        self.kind, self.var, self.cut, self.child = np.array(kind, np.int8), np.array(var), np.array(cut), np.array(child)
        self.offset, self.width, self.mu, self.sides, self.roots = np.array(offset), np.array(width), np.array(mu), np.array([*sides, 0], np.int8), np.array(roots, np.int64)

    def leaves(self, cont: np.ndarray | None, cat: np.ndarray | None, n: int) -> np.ndarray:
        """The place of each row's leaf in each tree: trees x rows."""
        at = np.repeat(self.roots, n)
        row = np.tile(np.arange(n), len(self.roots))
        todo = np.flatnonzero(self.kind[at])
        while len(todo):
            node, i = at[todo], row[todo]
            go = np.zeros(len(todo), np.int8)  # 1 left, 2 right, otherwise nowhere
            axis = self.kind[node] == 1
            if axis.any():
                x, c = cont[i[axis], self.var[node[axis]]], self.cut[node[axis]]
                go[axis] = (x < c) + 2 * (x >= c)
            if not axis.all():
                node_, x = node[~axis], cat[i[~axis], self.var[node[~axis]]]
                known = (x >= 0) & (x < self.width[node_])
                go[~axis] = np.where(known, self.sides[np.where(known, self.offset[node_] + x, -1)], 0)
            at[todo] = np.where((go == 1) | (go == 2), self.child[node] + go - 1, 0)
            todo = todo[self.kind[at[todo]] > 0]
        return at.reshape(len(self.roots), n)

    def total(self, cont: np.ndarray | None, cat: np.ndarray | None, n: int) -> np.ndarray:
        """The sum over trees for each row, NaN where a tree cannot place it."""
        step, out = max(1, self.CELLS // max(1, len(self.roots))), np.zeros(n)
        for a in range(0, n, step):
            b = min(a + step, n)
            out[a:b] = self.mu[self.leaves(None if cont is None else cont[a:b], None if cat is None else cat[a:b], b - a)].sum(0)
        return out


def leaf_column(tree: Tree, cont: list[str], cat: list[str], nid: int = 1, value=lambda nid: F.lit(nid).cast("long")) -> Column:
    """The leaf of a row as a CASE expression; null where a value is missing or a level on neither side."""
    rule = tree.rules.get(nid)
    if rule is None:
        return value(nid)
    left, right = (leaf_column(tree, cont, cat, c, value) for c in (2 * nid, 2 * nid + 1))
    if rule.is_cat:
        x = F.col(cat[rule.var])
        return F.when(x.isin(sorted(rule.left - rule.right)), left).when(x.isin(sorted(rule.right - rule.left)), right)
    x = F.col(cont[rule.var])
    return F.when(~F.isnan(x) & (x < rule.cut), left).when(~F.isnan(x) & (x >= rule.cut), right)


def value_column(tree: Tree, cont: list[str], cat: list[str]) -> Column:
    return leaf_column(tree, cont, cat, value=lambda nid: F.lit(float(tree.leaves[nid])))


def used(forest: list[Tree]) -> tuple[set[int], set[int]]:
    """Continuous and categorical predictors that occur in a rule: all that a scan has to read."""
    rules = [r for t in forest for r in t.rules.values()]
    return {r.var for r in rules if not r.is_cat}, {r.var for r in rules if r.is_cat}


def score(rows: DataFrame, forest: list[Tree], cont: list[str], cat: list[str], out: str = "score", shift: float = 0.0, scale: float = 1.0, strategy: str = "auto") -> DataFrame:
    """Adds shift + scale * (sum over trees); null if any tree cannot place the row."""
    size = sum(len(t.rules) + len(t.leaves) for t in forest)
    if strategy == "case" or strategy == "auto" and size <= COMPILED_NODES:
        total = F.lit(0.0)
        for t in forest:
            total = total + value_column(t, cont, cat)
        return rows.withColumn(out, F.lit(shift) + F.lit(scale) * total)
    if size > BROADCAST_NODES:
        raise ValueError(f"{size} nodes; score such a forest by joins with its node table, score_by_joins")
    shared, keep = rows.sparkSession.sparkContext.broadcast(FlatForest(forest)), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cont], 1) if cont else None
            z = np.stack([b.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in cat], 1) if cat else None
            total = shared.value.total(x, z, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shift + scale * total, from_pandas=True)], [*keep, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{out}` double")


def leaves_of(rows: DataFrame, forest: list[Tree], cont: list[str], cat: list[str], *keep: str) -> DataFrame:
    """One row per input row and tree: keys, tree, nid."""
    trees = F.explode(F.array(*(F.struct(F.lit(i).alias("tree"), leaf_column(t, cont, cat).alias("nid")) for i, t in enumerate(forest))))
    return rows.select(*keep, trees.alias("t")).select(*keep, "t.*")


def sufficient(routed: DataFrame, residual: str, tau: float, sigma: float, mu0: float = 0.0) -> DataFrame:
    """Per leaf: rows, sum of residuals, posterior precision and mean, and log integrated likelihood."""
    p = 1 / tau**2 + F.col("n") / sigma**2
    theta = mu0 / tau**2 + F.col("sum_r") / sigma**2
    sums = routed.groupBy("tree", "nid").agg(F.count("*").alias("n"), F.sum(residual).alias("sum_r"))
    return sums.select("tree", "nid", "n", "sum_r", p.alias("precision"), (theta / p).alias("mean"), (-0.5 * F.log(p) + 0.5 * theta * theta / p).alias("lil"))


def with_empty_leaves(stats: DataFrame, forest: list[Tree]) -> DataFrame:
    """Leaves that no row reaches get n = 0."""
    every = stats.sparkSession.createDataFrame([(i, n) for i, t in enumerate(forest) for n in t.leaves], "tree int, nid long")
    return F.broadcast(every).join(stats, ["tree", "nid"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def leaf_sizes(stats: DataFrame) -> DataFrame:
    """Per tree: leaves, singletons, empty leaves, largest and smallest leaf."""
    return stats.groupBy("tree").agg(
        F.count("*").alias("num_leafs"), F.count_if(F.col("n") == 1).alias("num_singletons"), F.count_if(F.col("n") == 0).alias("num_empty"),
        F.max("n").alias("max_leaf_size"), F.min("n").alias("min_leaf_size"),
    )


def cocluster(routed: DataFrame, key: str, n_trees: int) -> DataFrame:
    """Share of trees in which two rows meet in a leaf, for rows i < j that ever do. Meant for a set of
    rows that is small by its use, such as network vertices: its result is one row per pair."""
    a = routed.select("tree", "nid", F.col(key).alias("i"))
    b = routed.select("tree", "nid", F.col(key).alias("j"))
    return a.join(b, ["tree", "nid"]).where("i < j").groupBy("i", "j").agg((F.count("*") / n_trees).alias("share"))


def variable_counts(nodes: DataFrame, *keys: str) -> DataFrame:
    return nodes.where("NOT is_leaf").groupBy(*keys, "is_cat", "var").agg(F.count("*").alias("n_rules"))


def tree_shapes(nodes: DataFrame, *keys: str) -> DataFrame:
    depth = F.length(F.bin("nid")) - 1
    return nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("is_leaf")).alias("n_leaves"), F.max(depth).alias("depth"))


def node_types(nodes: DataFrame, *keys: str) -> DataFrame:
    """Adds kind: root (with rules), stump, leaf, prunable (two leaves below) or inner."""
    below = nodes.where("nid > 1").groupBy(*keys, F.shiftright("nid", 1).alias("nid")).agg(F.count_if(F.col("is_leaf")).alias("_ends"))
    kind = F.when(F.col("is_leaf"), F.when(F.col("nid") == 1, "stump").otherwise("leaf")).when(F.col("nid") == 1, "root").when(F.col("_ends") == 2, "prunable").otherwise("inner")
    return nodes.join(below, [*keys, "nid"], "left").withColumn("kind", kind).drop("_ends")


def conditions(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, nid, up, is_cat, var, cut, goes_left, levels): for every node the rules above it, ``up`` steps away,
    and the side of each that leads to the node."""
    depth = F.length(F.bin("nid")) - 1
    above = nodes.where("nid > 1").select(*keys, "nid", F.explode(F.sequence(F.lit(1), depth)).alias("up"))
    above = above.withColumn("_at", F.expr("shiftright(nid, up)")).withColumn("goes_left", F.expr("shiftright(nid, up - 1) % 2 = 0"))
    rules = nodes.where("NOT is_leaf").select(*keys, F.col("nid").alias("_at"), "is_cat", "var", "cut", "lvals", "rvals")
    side = F.when(F.col("goes_left"), F.col("lvals")).otherwise(F.col("rvals"))
    return above.join(rules, [*keys, "_at"]).select(*keys, "nid", "up", "is_cat", "var", "cut", "goes_left", side.alias("levels"))


def available_intervals(nodes: DataFrame, *keys: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """(keys, nid, var, low, high): the tightest cuts above a node on each continuous variable that occurs there."""
    cuts = conditions(nodes, *keys).where("NOT is_cat")
    ends = cuts.groupBy(*keys, "nid", "var").agg(F.max(F.when(~F.col("goes_left"), F.col("cut"))).alias("low"), F.min(F.when(F.col("goes_left"), F.col("cut"))).alias("high"))
    return ends.select(*keys, "nid", "var", F.greatest(F.coalesce("low", F.lit(low)), F.lit(low)).alias("low"), F.least(F.coalesce("high", F.lit(high)), F.lit(high)).alias("high"))


def available_levels(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, nid, var, levels): the side of the nearest rule above a node on each categorical variable."""
    sides = conditions(nodes, *keys).where("is_cat")
    return sides.groupBy(*keys, "nid", "var").agg(F.min_by("levels", "up").alias("levels"))


def leaf_boxes(nodes: DataFrame, *keys: str) -> DataFrame:
    """(keys, nid, mu, box): every leaf with all conditions that its rows meet."""
    rules = conditions(nodes, *keys).groupBy(*keys, "nid").agg(F.sort_array(F.collect_list(F.struct("up", "is_cat", "var", "cut", "goes_left", "levels"))).alias("box"))
    empty = F.array().cast("array<struct<up:int,is_cat:boolean,var:int,cut:double,goes_left:boolean,levels:array<int>>>")
    return nodes.where("is_leaf").select(*keys, "nid", "mu").join(rules, [*keys, "nid"], "left").withColumn("box", F.coalesce("box", empty))


def _numbers(cont: list[str], cat: list[str]) -> tuple[Column, Column]:
    return F.array(*(F.col(c).cast("double") for c in cont)).cast("array<double>"), F.array(*(F.col(c).cast("int") for c in cat)).cast("array<int>")


def _checked(nodes: DataFrame) -> DataFrame:
    """Node tables of at most BROADCAST_NODES rows are broadcast; larger ones are left to the planner."""
    return F.broadcast(nodes) if nodes.limit(BROADCAST_NODES // 10 + 1).count() <= BROADCAST_NODES // 10 else nodes


def rows_in_boxes(rows: DataFrame, boxes: DataFrame, cont: list[str], cat: list[str]) -> DataFrame:
    """Rows joined to the leaves whose boxes hold them, one a tree: a range join, meant to explain single trees."""
    x, z = _numbers(cont, cat)
    inside = lambda c: F.when(c["is_cat"], F.array_contains(c["levels"], F.get("_z", c["var"]))).otherwise(~F.isnan(F.get("_x", c["var"])) & ((F.get("_x", c["var"]) < c["cut"]) == c["goes_left"]))
    met = rows.withColumn("_x", x).withColumn("_z", z).join(_checked(boxes), F.forall("box", lambda c: F.coalesce(inside(c), F.lit(False))))
    return met.drop("_x", "_z", "box")


def route_by_joins(rows: DataFrame, nodes: DataFrame, cont: list[str], cat: list[str], *keep: str, keys: tuple[str, ...] = ("tree",)) -> DataFrame:
    """(keep, keys, nid, mu): the leaf of every row in every tree, null where a rule cannot place it. Rows move
    down a level with each equi-join on tree and node, so the forest may be a table of any size."""
    x, z = _numbers(cont, cat)
    deepest = nodes.agg(F.max(F.length(F.bin("nid")) - 1)).first()[0] or 0
    table = _checked(nodes.select(*keys, "nid", "is_leaf", "is_cat", "var", "cut", "lvals", "rvals", "mu"))
    now = rows.select(*keep, x.alias("_x"), z.alias("_z")).crossJoin(_checked(nodes.where("nid = 1").select(*keys))).withColumn("nid", F.lit(1).cast("long"))
    left = F.when(F.col("is_cat"), F.array_contains("lvals", F.get("_z", F.col("var")))).otherwise(F.get("_x", F.col("var")) < F.col("cut"))
    right = F.when(F.col("is_cat"), F.array_contains("rvals", F.get("_z", F.col("var")))).otherwise(F.get("_x", F.col("var")) >= F.col("cut"))
    known = F.col("is_cat") | ~F.isnan(F.get("_x", F.col("var")))
    step = F.when(F.col("is_leaf"), F.col("nid")).when(known & left & ~right, 2 * F.col("nid")).when(known & right & ~left, 2 * F.col("nid") + 1)
    for _ in range(deepest):
        now = now.join(table, [*keys, "nid"], "left").select(*keep, "_x", "_z", *keys, step.alias("nid"))
    return now.join(table.select(*keys, "nid", "mu"), [*keys, "nid"], "left").select(*keep, *keys, "nid", "mu")


def score_by_joins(rows: DataFrame, nodes: DataFrame, cont: list[str], cat: list[str], *key: str, keys: tuple[str, ...] = ("tree",)) -> DataFrame:
    """(key, score): the sum over trees of every row, told from others by ``key``; null if any tree cannot place it."""
    routed = route_by_joins(rows, nodes, cont, cat, *key, keys=keys)
    return routed.groupBy(*key).agg(F.when(F.count("mu") == F.count("*"), F.sum("mu")).alias("score"))


def tree_fits(rows: DataFrame, forest: list[Tree], cont: list[str], cat: list[str], *keep: str) -> DataFrame:
    """One row per input row and tree: keys, tree, leaf and its value."""
    each = F.array(*(F.struct(F.lit(i).alias("tree"), leaf_column(t, cont, cat).alias("nid"), value_column(t, cont, cat).alias("mu")) for i, t in enumerate(forest)))
    return rows.select(*keep, F.explode(each).alias("t")).select(*keep, "t.*")


def kernel_diagonal(routed: DataFrame, key: str, n_trees: int, compat: bool = False) -> DataFrame:
    """(i, share): how often a row meets itself: always, or with ``compat`` only in leaves of two rows or more."""
    sizes = routed.where("nid IS NOT NULL").groupBy("tree", "nid").agg(F.count("*").alias("_n"))
    met = routed.join(sizes, ["tree", "nid"])
    kept = F.count_if(F.col("_n") > 1) if compat else F.count("*")
    return met.groupBy(F.col(key).alias("i")).agg((kept / n_trees).alias("share"))


def grow_log_ratio(stats: DataFrame, tau: float, sigma: float, depth: int, leaves: int, prunable_after: int, mu0: float = 0.0, alpha: float = 0.95, beta: float = 2.0) -> DataFrame:
    """Adds log_ratio, the log of the acceptance ratio of splitting a leaf of ``depth`` into two parts of nl and nr
    rows with sums sl and sr; that of the inverse prune is its negative."""
    p = [alpha * (1 + d) ** -beta for d in (depth, depth + 1)]

    def lil(n: Column, s: Column) -> Column:
        theta, precision = mu0 / tau**2 + s / sigma**2, 1 / tau**2 + n / sigma**2
        return -0.5 * F.log(precision) + 0.5 * theta * theta / precision

    moves = math.log(0.5 / prunable_after) - math.log((1.0 if depth == 0 else 0.5) / leaves)
    prior = math.log(p[0]) + 2 * math.log(1 - p[1]) - math.log(1 - p[0])
    gain = lil(F.col("nl"), F.col("sl")) + lil(F.col("nr"), F.col("sr")) - lil(F.col("nl") + F.col("nr"), F.col("sl") + F.col("sr"))
    return stats.withColumn("log_ratio", gain + F.lit(moves + prior - math.log(tau) - 0.5 * (mu0 / tau) ** 2))
