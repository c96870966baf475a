"""The sum-of-trees sampler in numpy, for one chain inside one task, and fits that run chains side by side."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from statistics import NormalDist
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.forest import FlatForest, Node, Tree
from canopy.operators.graph import Edges, coin_split, graph_split
from canopy.operators.lineage import durable
from canopy.operators.summary import normal_cdf
from canopy.sources.forest_text import read_tree, write_tree

#: Fixed values of the noise prior: degrees of freedom, and a tenth of the chi-squared quantile scaled by them.
NU, LAMBDA = 3.0, 0.19479145805172773
#: Bytes of forest text that are broadcast at once; larger fits are applied in several passes over the rows.
FOREST_BYTES = 1 << 28
#: As many truncated normals are drawn one by one, and of many at most as many at once.
SINGLE_DRAWS, BLOCK = 1 << 12, 1 << 20
#: Boxes times trees of a fit by passes, some 16 bytes each on the driver.
BOXES = 1 << 24
#: Rows by distinct predictors from which on a fit by passes sums rows of equal predictors once, before its passes.
REPEATED = 4.0
#: Sweeps after which a fit by passes has the driver's JVM drop the plans and shuffle files of those before.
COLLECT_EVERY = 10
log = logging.getLogger(__name__)


@dataclass
class Design:
    """What a split may use: cutpoints of each continuous predictor (None: uniform on [-1, 1]), the number
    of levels of each categorical one, and the network on its levels if it has one."""

    cutpoints: list[np.ndarray | None] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    edges: dict[int, Edges] = field(default_factory=dict)
    cut_type: int = 1
    memo: dict = field(default_factory=dict, repr=False)  #: splits of vertex sets that chance has no part in

    def __post_init__(self):
        if not self.cutpoints and not self.levels:
            raise ValueError("no predictors")
        if any(c is not None and len(c) < 2 for c in self.cutpoints):
            raise ValueError("a list of cutpoints needs two or more")
        if not 0 <= self.cut_type <= 7:
            raise ValueError("cut_type is 0 to 7")
        for var, edges in self.edges.items():
            if var >= len(self.levels) or self.levels[var] < 2:
                raise ValueError("a network needs a categorical predictor of two levels or more")
            if any(not 0 <= v < self.levels[var] for e in edges for v in e[:2]):
                raise ValueError("a network has edges to levels that its predictor lacks")


@dataclass
class Prior:
    trees: int = 200
    alpha: float = 0.95
    beta: float = 2.0
    tau: float = 0.1
    mu0: float = 0.0
    sparse: bool = False

    def grow(self, depth: int) -> float:
        return self.alpha * (1 + depth) ** -self.beta


def draw_rule(tree: Tree, nid: int, design: Design, theta: np.ndarray | None, rng: np.random.Generator) -> Node:
    """A rule from the prior; ``theta`` has the weights of the predictors, None if they are equal."""
    p = len(design.cutpoints)
    total = p + len(design.levels)
    v = int(rng.random() * total) if theta is None else min(int(np.searchsorted(np.cumsum(theta), rng.random())), total - 1)
    if v >= p:
        var, k = v - p, design.levels[v - p]
        free = tree.levels(nid, var, range(k))
        free = free if len(free) > 1 else list(range(k))
        if len(free) < 2:
            return Node(True, var, 0.0, frozenset(free), frozenset(), k)
        network = design.edges.get(var)
        left, right = graph_split(free, network, design.cut_type, rng, design.memo) if network else coin_split(free, rng)
        return Node(True, var, 0.0, frozenset(left), frozenset(right), k)
    cuts = design.cutpoints[v]
    if cuts is None:
        low, high = tree.interval(nid, v)
        low, high = (low, high) if low < high else (-1.0, 1.0)
        return Node(False, v, low + (high - low) * rng.random())
    low, high = tree.interval(nid, v, float(cuts.min()), float(cuts.max()))
    between = cuts[(cuts > low) & (cuts < high)]
    between = between if len(between) else cuts
    return Node(False, v, float(between[int(rng.random() * len(between))]))


def draw_tree(design: Design, prior: Prior, rng: np.random.Generator) -> Tree:
    """A tree from the prior, level by level."""
    tree, front = Tree(), [1]
    for depth in range(100):
        grown = [n for n in front if rng.random() < prior.grow(depth)]
        for n in grown:
            tree.rules[n] = draw_rule(tree, n, design, None, rng)
            del tree.leaves[n]
            tree.leaves |= {2 * n: 0.0, 2 * n + 1: 0.0}
        front = [c for n in grown for c in (2 * n, 2 * n + 1)]
    tree.leaves = {n: float(rng.normal(prior.mu0, prior.tau)) for n in sorted(tree.leaves)}
    return tree


def normal_above(low: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Standard normals given that each exceeds its bound: by plain rejection where that is likely, else from a
    shifted exponential, whose rejections stay few however far out the bound is."""
    out, todo = np.empty(len(low)), np.arange(len(low))
    while len(todo):
        a = low[todo]
        rate = (a + np.sqrt(a * a + 4)) / 2
        far = a > 0.45
        z = np.where(far, a + rng.exponential(size=len(a)) / rate, rng.standard_normal(len(a)))
        good = np.where(far, rng.random(len(a)) <= np.exp(-0.5 * (z - rate) ** 2), z > a)
        out[todo[good]] = z[good]
        todo = todo[~good]
    return out


def normal_sum(low: float, n: int, rng: np.random.Generator) -> float:
    """The sum of n standard normals given that each exceeds ``low``, without drawing each of many. Their density over
    bins of one width is a flat part, up to its smallest value in the bin, and a thin rest. How many fall into each is
    multinomial; places in flat parts are uniform, so their sum comes from binomials of the bits of uniforms; those in
    the rest and beyond the bins are drawn one by one, by rejection. The sum has the distribution of n single draws."""
    if n <= SINGLE_DRAWS or low > 30:
        return sum(float(normal_above(np.full(min(BLOCK, n - a), low), rng).sum()) for a in range(0, n, BLOCK))
    scale = 1 / max(1.0, low)
    h = scale / 2 ** min(max(n.bit_length() // 2 - 2, 8), 14)  # about as many bins as draws from the rest
    edges = low + h * np.arange(math.ceil((max(low, 0.0) + 8 * scale - low) / h) + 1)
    f = lambda x: np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
    ends = f(edges)
    least, most = np.minimum(ends[:-1], ends[1:]), np.maximum(ends[:-1], ends[1:])
    most[(edges[:-1] < 0) & (edges[1:] > 0)] = f(0.0)
    above = 0.5 * np.frompyfunc(math.erfc, 1, 1)(edges / 2**0.5).astype(float)
    share = np.concatenate([h * least, np.maximum(above[:-1] - above[1:] - h * least, 0.0), above[-1:]])
    counts = rng.multinomial(n, share / share.sum())
    bins = len(edges) - 1
    flat, rest, beyond = counts[:bins], counts[bins:-1], int(counts[-1])
    total = float(flat @ edges[:-1]) + h * float(rng.binomial(int(flat.sum()), 0.5, 53) @ 0.5 ** np.arange(1, 54))
    todo = np.repeat(np.arange(bins), rest)
    while len(todo):
        x = edges[todo] + h * rng.random(len(todo))
        good = rng.random(len(todo)) * (most - least)[todo] <= f(x) - least[todo]
        total += float(x[good].sum())
        todo = todo[~good]
    return total + float(normal_above(np.full(beyond, edges[-1]), rng).sum())


class Chain:
    """State of one chain: trees, the place of every row's leaf in every tree, and the residual of the whole fit.
    A row may be a cell of ``weight`` rows with mean y, and ``within`` the squares around the means of all cells.
    A tree's leaves have places from 0 on, by which their node ids, values and counts stand in arrays."""

    def __init__(self, cont: np.ndarray | None, cat: np.ndarray | None, y: np.ndarray, design: Design, prior: Prior, probit: bool, seed: int, weight: np.ndarray | None = None, within: float = 0.0):
        if cont is not None and np.isnan(cont).any():
            raise ValueError("continuous predictors hold missing values")
        for v, cuts in enumerate(design.cutpoints):
            if cuts is None and len(y) and (np.abs(cont[:, v]) > 1).any():
                log.warning("continuous predictor %d leaves [-1, 1], where its cuts fall; see encode.rescale", v)
        for v, k in enumerate(design.levels):
            if len(y) and not ((cat[:, v] >= 0) & (cat[:, v] < k)).all():
                raise ValueError(f"categorical predictor {v} has levels outside 0 to {k - 1}")
        n, m = len(y), prior.trees
        self.weight, self.within, self.total = None if weight is None else weight.astype(float), within, float(n if weight is None else weight.sum())
        self.cont = None if cont is None else [np.ascontiguousarray(c) for c in cont.T]
        self.cat = None if cat is None else [np.ascontiguousarray(c) for c in cat.T]
        self.y, self.design, self.prior, self.probit = y, design, prior, probit
        self.rng = np.random.default_rng(seed)
        self.p = len(design.cutpoints) + len(design.levels)
        self.theta, self.u, self.counts = np.full(self.p, 1 / self.p), 1 / (1 + self.p), np.zeros(self.p, int)
        self.rules: list[Tree] = [Tree() for _ in range(m)]
        self.at = np.zeros((m, n), np.intp)
        self.nids: list[list[int]] = [[1] for _ in range(m)]
        self.mu, self.size = [np.zeros(1) for _ in range(m)], [np.full(1, self.total) for _ in range(m)]
        self.fit, self.sigma = np.zeros(n), 1.0
        self.accepted = 0
        self.tried, self.refused = np.zeros(2, int), np.zeros(2, int)  # grow proposals on axes and on levels
        self.target = y.astype(float)

    @property
    def trees(self) -> list[Tree]:
        return [Tree(t.rules, dict(zip(n, v.tolist(), strict=True))) for t, n, v in zip(self.rules, self.nids, self.mu, strict=True)]

    def latent(self) -> None:
        """Draws a unit-variance normal on the side of 0 that each response names; for a cell, the mean of those of
        its rows, which is all that trees and leaves depend on."""
        if self.weight is not None:
            for i, (n, share, fit) in enumerate(zip(self.weight.tolist(), self.y.tolist(), self.fit.tolist(), strict=True)):
                ones = round(n * share)
                self.target[i] = fit + (normal_sum(-fit, ones, self.rng) - normal_sum(fit, int(n) - ones, self.rng)) / n
            return
        side = np.where(self.y > 0, 1.0, -1.0)
        self.target = self.fit + side * normal_above(-side * self.fit, self.rng)

    def lil(self, n: float, s: float) -> float:
        precision = 1 / self.prior.tau**2 + n / self.sigma**2
        theta = self.prior.mu0 / self.prior.tau**2 + s / self.sigma**2
        return -0.5 * math.log(precision) + 0.5 * theta * theta / precision

    def take(self, cont: np.ndarray | None, cat: np.ndarray | None, y: np.ndarray, weight: np.ndarray, within: float) -> None:
        """Sets the cells that stand for the same rows in the next sweep; no rule in use or proposed may part a cell."""
        n = len(y)
        for v, k in enumerate(self.design.levels):
            if not ((cat[:, v] >= 0) & (cat[:, v] < k)).all():
                raise ValueError(f"categorical predictor {v} has levels outside 0 to {k - 1}")
        self.cont = None if cont is None else [np.ascontiguousarray(c) for c in cont.T]
        self.cat = None if cat is None else [np.ascontiguousarray(c) for c in cat.T]
        self.y, self.target, self.weight, self.within = y, y.astype(float), weight.astype(float), within
        self.at, self.fit = np.empty((len(self.rules), n), np.intp), np.zeros(n)
        for m, (tree, nids, mu) in enumerate(zip(self.rules, self.nids, self.mu, strict=True)):
            order = np.argsort(nids)
            self.at[m] = order[np.searchsorted(np.array(nids), tree.route(cont, cat, n), sorter=order)]
            self.fit += mu[self.at[m]]

    def propose(self, m: int) -> tuple[int, Node | None]:
        """To grow tree m: the place of a leaf and its rule. To prune it: the node whose leaves go, and None."""
        tree, nids, rng = self.rules[m], self.nids[m], self.rng
        if len(nids) == 1 or rng.random() < 0.5:
            place = int(rng.random() * len(nids))
            return place, draw_rule(tree, nids[place], self.design, self.theta if self.prior.sparse else None, rng)
        ends = tree.prunable()
        return ends[int(rng.random() * len(ends))], None

    def move(self, m: int, r: np.ndarray, sums: np.ndarray, proposed: tuple[int, Node | None] | None = None) -> np.ndarray | None:
        """Grows or prunes tree m as proposed, or refuses to. r is the residual of the whole fit and sums the leaves' sums of
        residuals without tree m. If the tree changes, r is that without tree m and the new sums are returned."""
        tree, at, nids, size, mu = self.rules[m], self.at[m], self.nids[m], self.size[m], self.mu[m]
        rng, prior = self.rng, self.prior
        fixed = -math.log(prior.tau) - 0.5 * (prior.mu0 / prior.tau) ** 2
        stump = len(nids) == 1
        place, rule = proposed or self.propose(m)
        if rule is not None:
            nid = nids[place]
            here = slice(None) if stump else np.flatnonzero(at == place)
            x = (self.cat if rule.is_cat else self.cont)[rule.var][here]
            if rule.is_cat:
                goes = np.zeros(rule.k, bool)
                goes[list(rule.right)] = True
                right = goes[x]
            else:
                right = x >= rule.cut
            own, w = r[here], None if self.weight is None else self.weight[here]
            nr = float(np.count_nonzero(right)) if w is None else float(w @ right)
            sr = (float(own @ right) if w is None else float((own * w) @ right)) + nr * mu[place]
            n, s = size[place], sums[place]
            depth, ends = nid.bit_length() - 1, tree.prunable()
            after = 1 if stump else len(ends) if nid // 2 in ends else len(ends) + 1
            log_ratio = math.log(0.5) - math.log(after) - (math.log(1.0 if stump else 0.5) - math.log(len(nids)))
            log_ratio += math.log(prior.grow(depth)) + 2 * math.log(1 - prior.grow(depth + 1)) - math.log(1 - prior.grow(depth))
            log_ratio += self.lil(n - nr, s - sr) + self.lil(nr, sr) - self.lil(n, s) + fixed
            self.tried[int(rule.is_cat)] += 1
            if -rng.exponential() > min(0.0, log_ratio):
                self.refused[int(rule.is_cat)] += 1
                return None
            r += mu[at]
            tree.rules[nid] = rule
            nids[place] = 2 * nid
            nids.append(2 * nid + 1)
            at[right if stump else here[right]] = len(nids) - 1
            size[place] -= nr
            self.size[m] = np.append(size, nr)
            sums[place] -= sr
            self.counts[rule.var + (len(self.design.cutpoints) if rule.is_cat else 0)] += 1
            self.accepted += 1
            return np.append(sums, sr)
        nid, ends = place, tree.prunable()
        a, b = nids.index(2 * nid), nids.index(2 * nid + 1)
        depth, leaves = nid.bit_length() - 1, len(nids)
        log_ratio = math.log(1.0 if nid == 1 else 0.5) - math.log(leaves - 1) - (math.log(0.5) - math.log(len(ends)))
        log_ratio += math.log(1 - prior.grow(depth)) - math.log(prior.grow(depth)) - 2 * math.log(1 - prior.grow(depth + 1))
        log_ratio += self.lil(size[a] + size[b], sums[a] + sums[b]) - self.lil(size[a], sums[a]) - self.lil(size[b], sums[b]) - fixed
        if -rng.exponential() > min(0.0, log_ratio):
            return None
        r += mu[at]
        rule = tree.rules.pop(nid)
        low, high, last = min(a, b), max(a, b), leaves - 1
        at[at == high] = low
        nids[low] = nid
        size[low] += size[high]
        sums[low] += sums[high]
        if high != last:  # the last leaf takes the free place
            at[at == last] = high
            nids[high], size[high], sums[high] = nids[last], size[last], sums[last]
        nids.pop()
        self.size[m] = size[:-1]
        self.counts[rule.var + (len(self.design.cutpoints) if rule.is_cat else 0)] -= 1
        self.accepted += 1
        return sums[:-1]

    def step(self, proposed: list[tuple[int, Node | None]] | None = None) -> None:
        """One sweep over the trees, the noise and, if asked for, the weights of the predictors. A proposal depends on
        its own tree alone, so those of a sweep may be drawn before it."""
        rng, prior = self.rng, self.prior
        self.accepted, self.tried[:], self.refused[:] = 0, 0, 0
        if self.probit:
            self.latent()
        r = self.target - self.fit
        for m in range(prior.trees):
            at, old = self.at[m], self.mu[m]
            sums = np.bincount(at, r if self.weight is None else self.weight * r, len(old)) + self.size[m] * old
            changed = self.move(m, r, sums, proposed and proposed[m])
            precision = 1 / prior.tau**2 + self.size[m] / self.sigma**2
            mu = (prior.mu0 / prior.tau**2 + (sums if changed is None else changed) / self.sigma**2) / precision
            mu += rng.standard_normal(len(mu)) / np.sqrt(precision)
            if changed is None:
                r += (old - mu)[at]
            else:
                r -= mu[at]
            self.mu[m] = mu
        self.fit = self.target - r
        if not self.probit:
            squares = float(r @ r) if self.weight is None else float(self.weight @ (r * r))
            self.sigma = math.sqrt((LAMBDA * NU + squares + self.within) / rng.chisquare(NU + self.total))
        if prior.sparse:
            self.weights()

    def weights(self) -> None:
        """Dirichlet weights of the predictors given their use, and their concentration by an independence step."""
        rng, p = self.rng, self.p
        shape = self.u / (1 - self.u)
        # Logs of gammas, as those of unused predictors may be too small to be told from 0.
        g = np.log(rng.gamma(shape + self.counts + 1)) + np.log(rng.random(p)) / (shape + self.counts)
        logs = g - g.max() - math.log(float(np.exp(g - g.max()).sum()))
        self.theta = np.exp(logs)
        new = float(np.clip(rng.beta(0.5, 1.0), 1e-6, 1 - 1e-6))
        density = lambda u: math.lgamma(p * u / (1 - u)) - p * math.lgamma(u / (1 - u)) + (u / (1 - u)) * float(logs.sum())
        if -rng.exponential() <= density(new) - density(self.u):
            self.u = new


def run_chain(pdf: pd.DataFrame, y: str, cont: list[str], cat: list[str], design: Design, prior: Prior, probit: bool, draws: int, burn: int, thin: int, seed: int, weight: np.ndarray | None = None, within: float = 0.0, print_every: int = 0) -> Iterator[tuple[int | None, Chain]]:
    """Yields (draw, chain) on every sweep; draw is None on those not kept."""
    chain = Chain(
        pdf[cont].to_numpy(float) if cont else None, pdf[cat].to_numpy(int) if cat else None, pdf[y].to_numpy(float), design, prior, probit, seed, weight, within
    )
    sweeps = 1 + burn + (draws - 1) * thin
    for sweep in range(sweeps):
        chain.step()
        if print_every and (sweep + 1) % print_every == 0:
            log.info("sweep %d of %d, %s", sweep + 1, sweeps, "warm-up" if sweep < burn else "sampling")
        yield (sweep - burn) // thin if sweep >= burn and (sweep - burn) % thin == 0 else None, chain


TRACE = {"sweep": "int", "draw": "int", "sigma": "double", "accepted": "int", "theta": "array<double>", "counts": "array<long>", "axis_tried": "int", "level_tried": "int", "axis_refused": "int", "level_refused": "int"}
FITS = {"draw": "int", "tree": "int", "text": "string", "y_mean": "double", "y_sd": "double", "sigma": "double", "counts": "array<long>"}


def _schema(frame: DataFrame, keys: tuple[str, ...], trace: bool) -> str:
    return ", ".join([*(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} {t}" for c, t in (TRACE if trace else FITS).items())])


def _seed(seed: int, key: tuple[Any, ...]) -> int:
    return seed + int(pd.util.hash_array(np.array(["|".join(map(str, key))], object))[0] % (1 << 31))


def _report(key: tuple[Any, ...], sweep: int, draw: int | None, c: Chain, mean: float, sd: float, trace: bool) -> list[tuple]:
    """The rows that a sweep adds to a trace or to the stored draws."""
    if trace:
        return [(*key, sweep, draw, c.sigma * sd, c.accepted, c.theta.tolist(), c.counts.tolist(), *c.tried.tolist(), *c.refused.tolist())]
    return [] if draw is None else [(*key, draw, m, write_tree(t), mean, sd, c.sigma * sd, c.counts.tolist()) for m, t in enumerate(c.trees)]


def fit_chains(frame: DataFrame, y: str, cont: list[str], cat: list[str], design: Design, keys: tuple[str, ...] = ("chain",), probit: bool = False, trees: int = 200, draws: int = 1000, burn: int = 1000, thin: int = 1, sparse: bool = False, seed: int = 1, cells: bool = False, trace: bool = False, print_every: int = 0) -> DataFrame:
    """Fits one chain per group of ``keys``; groups run side by side, and each has to fit in a task.

    Returns (keys, draw, tree, text, y_mean, y_sd, sigma, counts): the forests as text, to be applied by
    ``predict_draws`` and ``predict_probit``. With ``trace`` it returns a row for every sweep of the same chains
    instead: (keys, sweep, draw, sigma, accepted, theta, counts) and the proposals to grow on axes and on levels
    and how many of each were refused, draw null on sweeps not kept. Responses are standardised within a group
    unless ``probit``. With ``cells`` a row is a cell of equal predictors, (n, sum_y, sum_yy, low, high) of
    ``encode.cells``, and the fit is that of all their rows, binary ones included. Rows are put in order first, so that a seed fixes
    the result. ``print_every`` sweeps a line goes to the task's log."""
    if cells and any(c is None for c in design.cutpoints):
        raise ValueError("cells stand for rows in fits on discrete cutpoints only")

    schema = _schema(frame, keys, trace)

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, within = None, 0.0
        pdf = pd.concat(list(batches)).sort_values([*cont, *cat, *(["n", "sum_y", "sum_yy"] if cells else [y])], kind="stable", ignore_index=True)
        if cells:
            pdf = pdf[pdf["n"] > 0]
            weight, total, squares = (pdf[c].to_numpy(float) for c in ("n", "sum_y", "sum_yy"))
            pdf = pdf.assign(**{y: total / weight})
        v = pdf[y].to_numpy(float)
        # Squares of values from 0 to 1 are smaller, unless they are 0 or 1.
        binary = (pdf["low"].min() >= 0 and pdf["high"].max() <= 1 and (total == squares).all()) if cells else np.isin(v, (0, 1)).all()
        if probit and not binary:
            raise ValueError("a binary response holds 0 and 1 alone")
        if probit:
            mean, sd = 0.0, 1.0
        elif cells:
            mean = float(total.sum() / weight.sum())
            inner = max(0.0, float((squares - weight * v * v).sum()))
            sd = math.sqrt((inner + float(weight @ (v - mean) ** 2)) / (weight.sum() - 1))
            within = inner / sd**2
        else:
            mean, sd = float(v.mean()), float(v.std(ddof=1))
        pdf = pdf.assign(**{y: (v - mean) / sd})
        std = pdf[y].to_numpy()
        prior = Prior(trees=trees, sparse=sparse)
        if probit:
            prior.tau, prior.mu0 = trees**-0.5, NormalDist().inv_cdf(min(max(float(np.average(v, weights=weight)), 1e-6), 1 - 1e-6)) / trees
        else:
            spread = (float(pdf["high"].max()) - float(pdf["low"].min())) / sd if cells else float(std.max() - std.min())
            prior.tau = spread / (4 * trees**0.5)
        # Draws leave the task one by one, so that none waits for the last.
        for sweep, (draw, c) in enumerate(run_chain(pdf, y, cont, cat, design, prior, probit, draws, burn, thin, _seed(seed, key), weight, within, print_every)):
            if rows := _report(key, sweep, draw, c, mean, sd, trace):
                out = pd.DataFrame(rows, columns=[*keys, *(TRACE if trace else FITS)])
                yield out.astype({"draw": "Int32"}) if trace else out

    return frame.groupBy(*keys).applyInPandas(run, schema)


def fit_passes(frame: DataFrame, y: str, cont: list[str], cat: list[str], design: Design, keys: tuple[str, ...] = ("chain",), probit: bool = False, trees: int = 200, draws: int = 1000, burn: int = 1000, thin: int = 1, sparse: bool = False, seed: int = 1, trace: bool = False) -> DataFrame:
    """The result of ``fit_chains`` for chains whose rows no task holds; it runs at once, and is for few trees.

    The trees are on the driver and the rows stay where they are. A sweep's proposals are drawn before it; the cuts in
    use and proposed, and the levels, part the rows into boxes that no rule divides, so the boxes' counts and sums, one
    aggregate over all rows, are all that the sweep depends on. If predictors repeat, rows of equal ones are summed once
    before and the passes go over these sums. Boxes times trees are at most BOXES, else it is refused.
    Chains are the same as those of single rows but for the order of random numbers and the rounding of sums."""
    schema, prior, value = _schema(frame, keys, trace), Prior(trees=trees, sparse=sparse), F.col(y).cast("double")
    missing = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in (y, *cont, *cat)]
    # Bins have -0.0 below 0.0, rules do not.
    rows = frame.select(*keys, *(F.col(c).cast("int").alias(f"_z{i}") for i, c in enumerate(cat)), *((F.col(c).cast("double") + F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cont)), value.alias("_y"), F.lit(1).cast("long").alias("_k"))
    own_cell = [c for c in rows.columns if c not in ("_y", "_k")]
    wide = [F.count_if(F.abs(F.col(c)) > 1).alias(f"_w{i}") for i, c in enumerate(cont)]
    first = frame.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.count_if(m).alias(f"_m{i}") for i, m in enumerate(missing)), F.count_if(~value.isin(0.0, 1.0)).alias("_other"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.approx_count_distinct(F.xxhash64(*keys, *cont, *cat)).alias("_cells"), *wide)
    chains: dict[tuple, tuple[Chain, float, float]] = {}
    read = first.collect()  # a row per chain
    for r in read:
        if any(r[f"_m{i}"] for i in range(len(missing))):
            raise ValueError("the response or predictors hold missing values")
        if probit and r["_other"]:
            raise ValueError("a binary response holds 0 and 1 alone")
        for v, cuts in enumerate(design.cutpoints):
            if cuts is None and r[f"_w{v}"]:
                log.warning("continuous predictor %d leaves [-1, 1], where its cuts fall; see encode.rescale", v)
        key, n, (mean, sd) = tuple(r[k] for k in keys), float(r["_n"]), (0.0, 1.0) if probit else (r["_mean"], r["_sd"])
        own = replace(prior)
        if probit:
            own.tau, own.mu0 = trees**-0.5, NormalDist().inv_cdf(min(max(r["_mean"], 1e-6), 1 - 1e-6)) / trees
        else:
            own.tau = (r["_high"] - r["_low"]) / sd / (4 * trees**0.5)
        c = Chain(np.zeros((0, len(cont))), np.zeros((0, len(cat)), int), np.zeros(0), design, own, probit, _seed(seed, key), np.zeros(0))
        c.total, c.size = n, [np.full(1, n) for _ in range(trees)]
        chains[key] = c, mean, sd
    if sum(r["_n"] for r in read) > REPEATED * sum(r["_cells"] for r in read):
        rows = durable(rows.groupBy(*own_cell).agg(F.sum("_y").alias("_y"), F.sum("_k").alias("_k")))
    out: list[tuple] = []
    for sweep in range(1 + burn + (draws - 1) * thin):
        proposed = {key: [c.propose(m) for m in range(trees)] for key, (c, _, _) in chains.items()}
        rules = [r for key, (c, _, _) in chains.items() for r in (*(r for t in c.rules for r in t.rules.values()), *(r for _, r in proposed[key] if r is not None))]
        boxes = _boxes(rows, keys, len(cat), [sorted({r.cut + 0.0 for r in rules if not r.is_cat and r.var == v}) for v in range(len(cont))], max(1, BOXES // trees), len(chains) * math.prod(design.levels))
        for key, some in boxes.groupby(list(keys), sort=False):
            c, mean, sd = chains[tuple(key)]
            weight = some["_n"].to_numpy(float)
            m = (some["_s"].to_numpy() / weight - mean) / sd
            within = 0.0 if probit else max(0.0, c.total - 1 - float(weight @ (m * m)))  # squares of standardised responses add to n - 1
            c.take(some[[f"_x{i}" for i in range(len(cont))]].to_numpy(float), some[[f"_z{i}" for i in range(len(cat))]].to_numpy(int), m, weight, within)
            c.step(proposed[tuple(key)])
            out += _report(key, sweep, (sweep - burn) // thin if sweep >= burn and (sweep - burn) % thin == 0 else None, c, mean, sd, trace)
        if (sweep + 1) % COLLECT_EVERY == 0:
            frame.sparkSession.sparkContext._jvm.System.gc()
    return frame.sparkSession.createDataFrame(out, schema)


def _boxes(rows: DataFrame, keys: tuple[str, ...], n_cat: int, cuts: list[list[float]], most: int, groups: int) -> pd.DataFrame:
    """(keys, levels, x, _n, _s): counts and sums of the rows of each box between ``cuts``, with a point of the box."""
    used = [v for v, c in enumerate(cuts) if c]
    if used:
        rows = Bucketizer(inputCols=[f"_x{v}" for v in used], outputCols=[f"_b{v}" for v in used], splitsArray=[[-math.inf, *cuts[v], math.inf] for v in used]).transform(rows)
    codes: list[list[int]] = [[]]  # predictors whose bins are one number, which a double holds exactly
    for v in used:
        if math.prod(len(cuts[w]) + 1 for w in (*codes[-1], v)) > 1 << 52:
            codes.append([])
        codes[-1].append(v)
    places = []
    for i, vs in enumerate(codes):
        code = F.lit(0.0)
        for v in vs:
            code = code * float(len(cuts[v]) + 1) + F.col(f"_b{v}")
        places.append(code.cast("long").alias(f"_c{i}"))
    names = [*keys, *(f"_z{i}" for i in range(n_cat)), *(f"_c{i}" for i in range(len(codes)))]
    summed = rows.select(*names[: len(keys) + n_cat], *places, "_y", "_k").groupBy(*names).agg(F.sum("_k").alias("_n"), F.sum("_y").alias("_s"))
    sure = groups * math.prod(len(c) + 1 for c in cuts) <= most
    got = (summed if sure else summed.limit(most + 1)).toArrow().to_pandas().sort_values(names, ignore_index=True)
    if len(got) > most:
        raise ValueError(f"the rules part the rows into more than {most} boxes; a fit by passes is for fewer trees or predictors")
    for i, vs in enumerate(codes):
        code = got[f"_c{i}"].to_numpy()
        for v in reversed(vs):
            code, at = np.divmod(code, len(cuts[v]) + 1)
            got[f"_x{v}"] = np.array([np.nextafter(cuts[v][0], -np.inf), *cuts[v]])[at]
    return got.assign(**{f"_x{v}": 0.0 for v, c in enumerate(cuts) if not c})


def predict_draws(fits: DataFrame, rows: DataFrame, row_id: str, cont: list[str], cat: list[str], keys: tuple[str, ...] = ("chain",), mean_only: bool = False, probit: bool = False, own: bool = False) -> DataFrame:
    """(row_id, keys, draw, value): every stored draw of ``fit_chains`` applied to every row, on the scale of the
    response or, if ``probit``, as probabilities. With ``mean_only`` one row per (row_id, keys) with the mean over
    draws, which is all that leaves a task; if ``own``, rows hold the keys as well and take the fit of their own group
    alone. Forests are broadcast FOREST_BYTES of text at a time; what is more
    takes further passes over the rows, each over some of the draws."""
    size = fits.groupBy(*keys, "draw").agg(F.sum(F.length("text")).alias("bytes")).orderBy(*keys, "draw").collect()  # a row per kept draw
    passes: list[list[tuple]] = [[]]
    for r in size:
        if passes[-1] and sum(b for _, b in passes[-1]) + r["bytes"] > FOREST_BYTES:
            passes.append([])
        passes[-1].append(((*(r[k] for k in keys), r["draw"]), r["bytes"]))
    names, n_draws = [*keys, "draw"], {}
    for r in size:
        n_draws[tuple(r[k] for k in keys)] = n_draws.get(tuple(r[k] for k in keys), 0) + 1
    types = [f"`{row_id}` {rows.schema[row_id].dataType.simpleString()}", *(f"`{k}` {fits.schema[k].dataType.simpleString()}" for k in keys)]
    schema = f"{', '.join(types)}, value double" if mean_only else f"{', '.join(types)}, draw int, value double"

    def applied(some: DataFrame) -> DataFrame:
        forests: dict[tuple, tuple] = {}
        for f in some.select(*names, "tree", "text", "y_mean", "y_sd").collect():
            forests.setdefault(tuple(f[k] for k in names), (f["y_mean"], f["y_sd"], []))[2].append((f["tree"], f["text"]))
        stored = rows.sparkSession.sparkContext.broadcast(forests)

        def apply(pdf: pd.DataFrame, read: list[tuple]) -> Iterator[pd.DataFrame]:
            x, z, n = pdf[cont].to_numpy(float) if cont else None, pdf[cat].fillna(-1).to_numpy(int) if cat else None, len(pdf)
            means: dict[tuple, np.ndarray] = {}
            for k, mean, sd, forest in read:
                value = mean + sd * forest.total(x, z, n)
                if probit:
                    value = 0.5 * np.frompyfunc(math.erfc, 1, 1)(-value / 2**0.5).astype(float)
                if mean_only:
                    means[k[:-1]] = means.get(k[:-1], 0.0) + value / n_draws[k[:-1]]
                else:
                    yield pd.DataFrame({row_id: pdf[row_id], **{c: [v] * n for c, v in zip(names, k, strict=True)}, "value": value})
            for k, value in means.items():
                yield pd.DataFrame({row_id: pdf[row_id], **{c: [v] * n for c, v in zip(keys, k, strict=True)}, "value": value})

        def run(batches):
            every = [(k, mean, sd, FlatForest([read_tree(t) for _, t in sorted(texts)])) for k, (mean, sd, texts) in sorted(stored.value.items())]
            for whole in batches:
                if not own:
                    yield from apply(whole, every)
                    continue
                for group, pdf in whole.groupby(list(keys), sort=False):
                    yield from apply(pdf, [r for r in every if r[0][:-1] == tuple(group)])

        return rows.select(*dict.fromkeys([row_id, *(keys if own else ()), *cont, *cat])).mapInPandas(run, schema)

    out = None
    for chosen in passes:
        some = fits
        if len(passes) > 1:
            picked = rows.sparkSession.createDataFrame([k for k, _ in chosen], fits.select(*names).schema)
            some = fits.join(F.broadcast(picked), names, "left_semi")
        out = applied(some) if out is None else out.unionByName(applied(some))
    if mean_only and len(passes) > 1:
        out = out.groupBy(row_id, *keys).agg(F.sum("value").alias("value"))
    return out


def predict_probit(fits: DataFrame, rows: DataFrame, row_id: str, cont: list[str], cat: list[str], keys: tuple[str, ...] = ("chain",)) -> DataFrame:
    """(row_id, keys, draw, value): the probability of a 1 by every stored draw of a probit fit. Its mean
    over draws, and that of ``predict_draws``, comes from ``summary.summarize``."""
    return predict_draws(fits, rows, row_id, cont, cat, keys).withColumn("value", normal_cdf(F.col("value")))


def predict_column(fits: DataFrame, keys: tuple, cont: list[str], cat: list[str], probit: bool = False):
    """A pandas UDF of the predictors, continuous ones first, that gives the posterior mean of the fit of one group
    of ``fits``; to be used as a column or registered for SQL. The forests of the group are at most FOREST_BYTES."""
    got = fits.select("draw", "tree", "text", "y_mean", "y_sd").collect() if fits.agg(F.sum(F.length("text"))).first()[0] <= FOREST_BYTES else None
    if got is None:
        raise ValueError(f"the fit of {keys} has more than {FOREST_BYTES} bytes; predict_draws takes it in several passes")
    draws: dict[int, list] = {}
    for f in sorted(got, key=lambda f: (f["draw"], f["tree"])):
        draws.setdefault(f["draw"], []).append(f["text"])
    shift, scale = (got[0]["y_mean"], got[0]["y_sd"]) if got else (0.0, 1.0)
    stored, n_cont = fits.sparkSession.sparkContext.broadcast(list(draws.values())), len(cont)

    @F.pandas_udf("double")
    def predict(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        read = [FlatForest([read_tree(t) for t in texts]) for texts in stored.value]
        for columns in parts:
            n = len(columns[0])
            x = np.stack([c.to_numpy(float) for c in columns[:n_cont]], 1) if n_cont else None
            z = np.stack([c.fillna(-1).to_numpy(int) for c in columns[n_cont:]], 1) if len(columns) > n_cont else None
            values = [shift + scale * f.total(x, z, n) for f in read]
            if probit:
                values = [0.5 * np.frompyfunc(math.erfc, 1, 1)(-v / 2**0.5).astype(float) for v in values]
            yield pd.Series(sum(values) / len(values))

    return predict


def sample_prior(spark, design: Design, trees: int, tau: float | None = None, seed: int = 1) -> DataFrame:
    """(tree, text) of trees from the prior, each drawn from its own seed."""
    prior = Prior(trees=trees, tau=tau or trees**-0.5)

    def run(batches):
        for b in batches:
            yield b.rename(columns={"id": "tree"}).assign(text=[write_tree(draw_tree(design, prior, np.random.default_rng((seed, int(i))))) for i in b["id"]])

    return spark.range(trees).mapInPandas(run, "tree long, text string")
