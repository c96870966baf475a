"""Approximate nearest neighbours by learned partitions.

A tree of parts is learned from above. For a part that holds more than ROWS_PER_PART vectors, the neighbour graph
of a bounded sample of it (SAMPLE vectors) is built exactly and cut into at most FAN balanced parts: median
splits, then sweeps that move nodes to the part of most of their neighbours while there is room. A small
classifier learns the shares of a vector's neighbours over these parts. It sends every vector of the part into
its most probable one, and a query into its most probable ones by the product of the probabilities on the way.
So parts keep their size while they grow in number, and all parts of a level are learned side by side.

Every query searches the same number of parts: the smallest one at which a sample of at most ASKED queries finds
RECALL of its true neighbours, which are found by comparing that sample with every row. Vectors without clusters
need a large share of the parts for that, whatever the index; see the README for figures. A query's most
probable part comes first; the others return only what reaches the score that it has given.

Equal vectors are one class under its smallest TOP + 1 ids: ties go to smaller ids, so no further id of a class
can be among TOP results. Scores are sums of products in the order of the components.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths have no inner product, and each length has an index of its own;
repeated ids are a row, and a query, for each of their vectors; ties go to the smaller id; queries that find fewer than TOP
rows search every part; further columns are left out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.shared import durable, enough, table, unit

TOP = 20
SAMPLE = 4096  #: bound of the vectors that one part's split is learned from
ROWS_PER_PART = 4000  #: parts with more vectors are split
FAN = 64  #: most parts of one split
BLOCK = 4096  #: most vectors, and most queries, of a task's unit of work
ASKED = 200  #: bound of the queries that the number of parts to search is measured on
RECALL = 0.95  #: what they have to find


def valid(embedding: str = "embedding") -> Column:
    e = F.col(embedding)
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & sound & F.exists(e, lambda x: x != 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k]


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    """A part of each node: median splits along main directions, then moves that cut fewer edges."""
    label = np.zeros(len(x), np.int64)
    todo, made = [(np.arange(len(x)), parts)], 0
    while todo:
        at, n = todo.pop()
        if n == 1:
            label[at] = made
            made += 1
            continue
        c = x[at] - x[at].mean(0)
        order = at[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]
        cut = len(at) * (n // 2) // n
        todo += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    room = int(1.3 * len(x) / parts) + 1
    held = np.bincount(label, minlength=parts)
    around: list[list[int]] = [list(g) for g in graph]
    for i, g in enumerate(graph):
        for j in g:
            around[j].append(i)
    for _ in range(sweeps):
        for i in range(len(x)):
            votes = np.bincount(label[around[i]], minlength=parts)
            votes[(held >= room) & (np.arange(parts) != label[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[label[i]]:
                held[label[i]] -= 1
                held[best] += 1
                label[i] = best
    return label


@dataclass
class Router:
    """A classifier of one hidden layer over the parts of a split."""

    w: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        z = np.maximum(x @ a + b, 0) @ c + d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def pack(self) -> tuple[bytes, list[int]]:
        return b"".join(k.astype("<f8").tobytes() for k in self.w), [*self.w[0].shape, self.w[2].shape[1]]

    @staticmethod
    def unpack(data: bytes, shape: list[int]) -> Router:
        size, hidden, parts = map(int, shape)
        shapes, flat, out, at = [(size, hidden), (hidden,), (hidden, parts), (parts,)], np.frombuffer(data, "<f8"), [], 0
        for s in shapes:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return Router(out)


def train(x: np.ndarray, share: np.ndarray, hidden: int = 128, epochs: int = 40) -> Router:
    rng = np.random.default_rng(5)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, share.shape[1])), np.zeros(share.shape[1])]
    m, v, t = [0 * k for k in w], [0 * k for k in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in (order[i : i + 128] for i in range(0, len(x), 128)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            g = (Router(w).probabilities(x[at]) - share[at]) / len(at)
            gh = g @ w[2].T * (h > 0)
            t += 1
            for k, grad in enumerate((x[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(w)


def learn(x: np.ndarray, parts: int) -> Router:
    """The router of a split into ``parts``, from a sample in a fixed order. Lengths do not sway it."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbour_graph(x, 16)
    label = balanced_parts(x, graph, parts)
    share = np.zeros((len(x), parts))
    for k in range(graph.shape[1]):
        np.add.at(share, (np.arange(len(x)), label[graph[:, k]]), 1 / graph.shape[1])
    return train(x, share)


def splits(placed: DataFrame, counts: DataFrame, per_part: int) -> DataFrame:
    """(node, data, shape): a router for every node of ``counts`` (node, n), learned from a sample of its vectors."""
    near = placed.select("node", "embedding", unit(F.col("h1"), F.col("h2")).alias("u"), "h1", "h2").join(counts, "node").where(F.col("u") < enough(SAMPLE, F.col("n")))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("u", "h1", "h2"))).where(F.col("k") <= SAMPLE)

    def run(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("k")
        parts = int(max(1, min(FAN, 1 + int(1.6 * int(some["n"].iloc[0]) / per_part), len(some) // 16)))  # parts are uneven; few are split again
        if parts < 2:
            return pd.DataFrame({"node": [], "data": [], "shape": []})
        data, shape = learn(np.stack(some["embedding"].to_numpy()), parts).pack()
        return pd.DataFrame({"node": [key[0]], "data": [data], "shape": [shape]})

    return near.groupBy("node").applyInPandas(run, "node string, data binary, shape array<int>")


def routed(rows: DataFrame, routers: DataFrame, best: bool) -> DataFrame:
    """Rows (h1, h2, node, logp, embedding) of nodes with a router go to its parts: the most probable one if
    ``best``, otherwise a row for each. Rows of a node are dealt into blocks, each with a copy of the router."""
    size = rows.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = rows.join(size.join(routers.select("node"), "node", "left_semi"), "node")
    near = near.withColumn("block", F.pmod(F.col("h2"), F.col("blocks")).cast("int")).drop("blocks")
    copies = routers.join(size, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key: tuple, some: pd.DataFrame, router: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(router):
            return some.iloc[:0][["h1", "h2", "node", "logp"]]
        x = np.stack(some["embedding"].to_numpy())
        p = Router.unpack(router["data"].iloc[0], router["shape"].iloc[0]).probabilities(x / np.linalg.norm(x, axis=1, keepdims=True))
        i, part = (np.arange(len(x)), p.argmax(1)) if best else (a.ravel() for a in np.indices(p.shape))
        return pd.DataFrame({"h1": some["h1"].to_numpy()[i], "h2": some["h2"].to_numpy()[i], "node": [f"{key[0]}.{k}" for k in part], "logp": some["logp"].to_numpy()[i] + np.log(np.maximum(p[i, part], 1e-300))})

    return near.groupBy("node", "block").cogroup(copies.groupBy("node", "block")).applyInPandas(run, "h1 long, h2 long, node string, logp double")


def nearest(ask: np.ndarray, x: np.ndarray, top: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and the places and scores of its ``top`` nearest rows and their ties, of those
    that reach its floor."""
    for low in range(0, len(ask), 512):
        s = ask[low : low + 512] @ x.T
        k = min(top, len(x))
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        for i in range(len(s)):
            # The matrix product decides with a margin for its rounding; what is kept is summed in order.
            at = np.flatnonzero(s[i] >= max(least[i], floor[low + i]) - 1e-9 * (1 + abs(least[i])))
            exact = np.add.accumulate(x[at] * ask[low + i], axis=1)[:, -1]
            keep = exact >= floor[low + i]
            yield low + i, at[keep], exact[keep]


def best_of(found: DataFrame, top: int) -> DataFrame:
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= top).drop("_n")


def searched(asked: DataFrame, base: DataFrame, counts: DataFrame, top: int) -> DataFrame:
    """(h1, h2, vec_id, score): the best ``top`` rows of every part for every query sent to it, of those that
    reach its floor. ``asked`` is (h1, h2, node, floor, embedding), ``base`` (node, h2, ids, embedding). Both
    sides of a part are dealt into blocks of BLOCK rows."""
    size = counts.join(asked.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q")), "node").withColumn("b", F.ceil(F.col("n") / BLOCK).cast("int")).select("node", "q", "b")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = asked.join(size, "node").withColumn("qb", F.pmod("h1", F.col("q")).cast("int")).withColumn("bb", every("b")).drop("q", "b")
    c = base.join(size, "node").withColumn("bb", F.pmod("h2", F.col("b")).cast("int")).withColumn("qb", every("q")).drop("q", "b", "h2")

    def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            x, ids, h1, h2 = np.stack(c["embedding"].to_numpy()), list(c["ids"]), q["h1"].tolist(), q["h2"].tolist()
            for i, at, score in nearest(np.stack(q["embedding"].to_numpy()), x, top, q["floor"].to_numpy()):
                some = sorted((-s, int(v)) for j, s in zip(at.tolist(), score.tolist(), strict=True) for v in ids[j])
                out += [(h1[i], h2[i], v, -s) for s, v in some[:top]]
        return pd.DataFrame(out, columns=["h1", "h2", "vec_id", "score"]).astype({"h1": "int64", "h2": "int64", "vec_id": "int64", "score": "float64"})

    return q.groupBy("node", "qb", "bb").cogroup(c.groupBy("node", "qb", "bb")).applyInPandas(run, "h1 long, h2 long, vec_id long, score double")


def true_ranks(asked: DataFrame, placed: DataFrame, ranked: Callable[[DataFrame], DataFrame], top: int) -> DataFrame:
    """(rank, n): how many of the true neighbours of a sample of queries lie in the part of that rank. The sample,
    ASKED vectors at most, is broadcast and every row is compared with it."""
    some = asked.where(unit(F.col("h1"), F.lit(1)) < enough(ASKED, asked.count())).orderBy(unit(F.col("h1"), F.lit(1)), "h1", "h2").limit(ASKED)
    some = durable(some)
    rows = sorted((r["h1"], r["h2"], r["embedding"]) for r in some.select("h1", "h2", "embedding").collect())
    sent = asked.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[int]] = {}
        for i, r in enumerate(sent.value):
            by.setdefault(len(r[2]), []).append(i)
        held: list[list[tuple]] = [[] for _ in sent.value]
        for batch in batches:
            x, node = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for size, who in by.items():
                at = [j for j, e in enumerate(x) if len(e) == size]
                if not at:
                    continue
                own = np.array([x[j] for j in at])
                for i, places, score in nearest(np.array([sent.value[k][2] for k in who]), own, top + 1, np.full(len(who), -np.inf)):
                    k = who[i]
                    held[k] = sorted(held[k] + [(-s, batch.column(0)[at[p]].as_py(), node[at[p]]) for p, s in zip(places.tolist(), score.tolist(), strict=True)])[: top + 1]
        out = [(sent.value[k][0], sent.value[k][1], h2, node, -s) for k, rows in enumerate(held) for s, h2, node in rows]
        names, kinds = ["h1", "h2", "other", "node", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], names)

    found = placed.select("h2", "node", "embedding").mapInArrow(run, "h1 long, h2 long, other long, node string, score double").where("other <> h2")
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "other"))).where(F.col("k") <= top)
    return found.select("h1", "h2", "node").join(ranked(some), ["h1", "h2", "node"]).groupBy("rank").agg(F.count("*").alias("n"))


@dataclass
class Index:
    """A learned tree of parts over all rows of a table."""

    placed: DataFrame  #: h1, h2, ids, asked, embedding and node, the part of a vector
    counts: DataFrame  #: node, n
    levels: list[DataFrame]  #: routers by level
    rows: DataFrame  #: vec_id, h1, h2
    probes: int = 1  #: parts that a query searches
    recall: float = 1.0  #: of the sample of queries at that number
    parts: int = 1

    def ranked(self, asked: DataFrame, most: int | None) -> DataFrame:
        """(h1, h2, node, rank, embedding): the ``most`` most probable parts of each query, or all."""
        front, done = asked.select("h1", "h2", F.size("embedding").cast("string").alias("node"), F.lit(0.0).alias("logp")), []
        vectors = asked.select("h1", "h2", "embedding")
        order = Window.partitionBy("h1", "h2").orderBy(F.desc("logp"), "node")
        for routers in self.levels:
            done.append(front.join(routers.select("node"), "node", "left_anti").select("h1", "h2", "node", "logp"))
            front = routed(front.join(vectors, ["h1", "h2"]), routers, best=False)
            if most:
                front = front.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
            front = durable(front)
        for d in done:
            front = front.unionByName(d)
        # Parts that hold no row are not searched and take no rank.
        out = front.join(self.counts.select("node"), "node", "left_semi").withColumn("rank", F.row_number().over(order))
        return (out.where(F.col("rank") <= most) if most else out).select("h1", "h2", "node", "rank").join(vectors, ["h1", "h2"])


def build(vectors: DataFrame, query: Callable[[Column], Column], top: int = TOP, per_part: int = ROWS_PER_PART, recall: float = RECALL) -> Index:
    """Learns the parts from samples, puts every row into one, and measures how many a query has to search."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    rows = rows.where(valid() & F.col("vec_id").isNotNull()).select("vec_id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2"), "embedding")
    # The smallest ids of each class of equal vectors, first within salts and then over them; ids move alone.
    ids = rows.select("h1", "h2", "vec_id")
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = ids.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id"))).where(F.col("_n") <= top + 1)
    few = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = rows.groupBy("h1", "h2").agg(F.any_value("embedding").alias("embedding"), F.bool_or(query(F.col("vec_id"))).alias("asked"))
    base = durable(one.join(few, ["h1", "h2"]))

    placed = base.select("h1", "h2", F.size("embedding").cast("string").alias("node"), F.lit(0.0).alias("logp"))
    counts, levels = durable(placed.groupBy("node").agg(F.count("*").alias("n"))), []
    vectors = base.select("h1", "h2", "embedding")
    while not (large := counts.where(F.col("n") > per_part)).isEmpty():
        routers = durable(splits(placed.join(vectors, ["h1", "h2"]), large, per_part))
        if routers.isEmpty():
            break
        moved = routed(placed.join(vectors, ["h1", "h2"]), routers, best=True)
        before, placed = counts, durable(moved.unionByName(placed.join(routers.select("node"), "node", "left_anti").select("h1", "h2", "node", "logp")))
        counts = durable(placed.groupBy("node").agg(F.count("*").alias("n")))
        levels.append(routers)
        if counts.agg(F.max("n")).first()[0] > 0.9 * before.agg(F.max("n")).first()[0]:
            break  # vectors that no split tells apart stay together and are searched in blocks
    placed = durable(base.join(placed.drop("logp"), ["h1", "h2"]))
    index = Index(placed, counts, levels, rows.select("vec_id", "h1", "h2"), parts=counts.count())
    if levels:
        asked = placed.where("asked").select("h1", "h2", "embedding")
        ranks = sorted((r["rank"], r["n"]) for r in true_ranks(asked, placed, lambda some: index.ranked(some, None), top).collect())  # a row per part at most
        total, got = sum(n for _, n in ranks), 0
        for rank, n in ranks:
            got += n
            index.probes, index.recall = rank, got / total
            if got >= recall * total:
                break
    return index


def search(vectors: DataFrame, query: Callable[[Column], Column], top: int = TOP, per_part: int = ROWS_PER_PART, recall: float = RECALL, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest rows of every row that meets ``query``."""
    index = index or build(vectors, query, top, per_part, recall)
    placed, counts = index.placed, index.counts
    asked = placed.where("asked").select("h1", "h2", "embedding")
    base = placed.select("node", "h2", "ids", "embedding")
    sent = durable(index.ranked(asked, index.probes))
    first = durable(best_of(searched(sent.where("rank = 1").withColumn("floor", F.lit(float("-inf"))), base, counts, top + 1), top + 1))
    floor = first.groupBy("h1", "h2").agg(F.when(F.count("*") > top, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    got = first
    if index.probes > 1:
        rest = sent.where("rank > 1").join(floor, ["h1", "h2"])
        got = durable(best_of(first.unionByName(searched(rest, base, counts, top + 1)), top + 1))
    if index.levels:
        # Queries with too few rows search every part of their length; there are none unless parts are nearly empty.
        full = got.groupBy("h1", "h2").count().where(F.col("count") > top).select("h1", "h2")
        short = durable(asked.join(full, ["h1", "h2"], "left_anti"))
        if not short.isEmpty():
            everywhere = index.ranked(short, None).withColumn("floor", F.lit(float("-inf")))
            got = got.join(short.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(best_of(searched(everywhere, base, counts, top + 1), top + 1))
    queries = index.rows.where(query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    pairs = queries.join(got, ["h1", "h2"]).where("vec_id <> query_id")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id")))
    return pairs.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)


#: Every query against every row. The operator gives the same rows while a table has one part, that is up to
#: ROWS_PER_PART vectors; of larger tables it finds the measured share.
OP6_SQL = f"""
WITH e AS (SELECT DISTINCT vec_id::BIGINT AS vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, q.v AS own, c.vec_id, list_reduce([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)], lambda a, b: a + b) AS score
  FROM e q JOIN e c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {TOP}"""
