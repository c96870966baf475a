"""Text form of stored trees, one node a line: ``nid m mu``, ``nid r 0 cut var`` or ``nid r 1 var K lhex rhex``.

Level sets are hexadecimal bitmaps of K // 4 + 1 digits; a digit's highest bit is its lowest level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.forest import Node, Tree


def levels_to_hex(levels, k: int) -> str:
    return "".join(f"{sum(8 >> (v % 4) for v in levels if v // 4 == digit):x}" for digit in range(k // 4 + 1))


def hex_to_levels(text: str, k: int) -> list[int]:
    if len(text) != k // 4 + 1:
        raise ValueError(f"{text!r} should have {k // 4 + 1} digits for {k} levels")
    return [4 * d + j for d, c in enumerate(text) for j in range(4) if int(c, 16) & 8 >> j]


def hex_levels(text: Column) -> Column:
    """The ascending levels of a bitmap column, in built-in functions."""
    digits = F.transform(F.sequence(F.lit(1), F.length(text)), lambda d: F.lpad(F.conv(F.substr(text, d, F.lit(1)), 16, 2), 4, "0"))
    all_bits = F.array_join(digits, "")
    at = F.sequence(F.lit(0), F.length(all_bits) - 1)
    return F.filter(at, lambda i: F.substr(all_bits, i + 1, F.lit(1)) == "1")


def levels_hex(levels: Column, k: Column) -> Column:
    """The bitmap column of an array of levels below k, in built-in functions."""
    digit = lambda d: F.aggregate(levels, F.lit(0), lambda a, v: a + F.when(F.floor(v / 4) == d, F.element_at(F.array(*map(F.lit, (8, 4, 2, 1))), (F.pmod(v, F.lit(4)) + 1).cast("int"))).otherwise(0))
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.floor(k / 4).cast("int")), lambda d: F.conv(digit(d).cast("string"), 10, 16)), ""))


def read_tree(text: str) -> Tree:
    rules, leaves = {}, {}
    for line in filter(None, map(str.strip, text.splitlines())):
        t = line.split()
        nid = int(t[0])
        if t[1] == "m":
            leaves[nid] = float(t[2])
        elif t[2] == "0":
            rules[nid] = Node(False, int(t[4]), float(t[3]))
        else:
            k = int(t[4])
            rules[nid] = Node(True, int(t[3]), 0.0, frozenset(hex_to_levels(t[5], k)), frozenset(hex_to_levels(t[6], k)), k)
    for nid in rules:
        if nid > 1 and nid // 2 not in rules:
            raise ValueError(f"node {nid} has no parent")
    ends = {c for n in rules for c in (2 * n, 2 * n + 1) if c not in rules} if rules else {1}
    if missing := sorted(ends - leaves.keys()):
        raise ValueError(f"leaves without a line: {missing}")
    return Tree(rules, {n: leaves[n] for n in ends})


def write_tree(tree: Tree) -> str:
    out: list[str] = []

    def visit(nid: int) -> None:
        rule = tree.rules.get(nid)
        if rule is None:
            out.append(f"{nid} m {tree.leaves[nid]!r}")
            return
        if rule.is_cat:
            out.append(f"{nid} r 1 {rule.var} {rule.k} {levels_to_hex(rule.left, rule.k)} {levels_to_hex(rule.right, rule.k)}")
        else:
            out.append(f"{nid} r 0 {rule.cut!r} {rule.var}")
        visit(2 * nid)
        visit(2 * nid + 1)

    visit(1)
    return "\n".join(out)


def parse_forest(texts: DataFrame, text: str = "text") -> DataFrame:
    """Node rows (keys, nid, is_leaf, mu, is_cat, var, cut, lvals, rvals, k) of tree texts, in built-in functions."""
    keys = [c for c in texts.columns if c != text]
    lines = texts.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("_line")).withColumn("_t", F.split(F.trim("_line"), r"\s+")).where(F.size("_t") >= 3)
    t = lambda i: F.get("_t", F.lit(i))
    leaf, cat = t(1) == "m", t(2) == "1"
    return lines.select(
        *keys, t(0).cast("long").alias("nid"), leaf.alias("is_leaf"), F.when(leaf, t(2).cast("double")).alias("mu"), F.when(~leaf, cat).alias("is_cat"),
        F.when(~leaf, F.when(cat, t(3)).otherwise(t(4))).cast("int").alias("var"), F.when(~leaf & ~cat, t(3).cast("double")).alias("cut"),
        F.when(~leaf & cat, hex_levels(t(5))).alias("lvals"), F.when(~leaf & cat, hex_levels(t(6))).alias("rvals"),
        F.when(~leaf & cat, t(4)).cast("int").alias("k"),
    )


def forest_text(nodes: DataFrame, *keys: str) -> DataFrame:
    """One text per tree from rows with ``nid`` and ``line``, parents before children, left before right."""
    path = F.rpad(F.bin(F.col("nid")), 64, " ")
    return nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(path.alias("p"), "line"))).alias("l")).select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """Adds ``line``, the text of a node; ``k`` has the number of levels of categorical rules."""
    cat = F.concat_ws(" ", F.col("nid").cast("string"), F.lit("r 1"), F.col("var").cast("string"), F.col("k").cast("string"), levels_hex(F.col("lvals"), F.col("k")), levels_hex(F.col("rvals"), F.col("k")))
    axis = F.concat_ws(" ", F.col("nid").cast("string"), F.lit("r 0"), F.col("cut").cast("string"), F.col("var").cast("string"))
    leaf = F.concat_ws(" ", F.col("nid").cast("string"), F.lit("m"), F.col("mu").cast("string"))
    return nodes.withColumn("line", F.when(F.col("is_leaf"), leaf).when(F.col("is_cat"), cat).otherwise(axis))


def register(spark: SparkSession, name: str = "forest_nodes") -> None:
    """Registers a table function of a tree's text: SELECT * FROM texts, LATERAL forest_nodes(text)."""

    @F.udtf(returnType="nid bigint, is_leaf boolean, mu double, is_cat boolean, var int, cut double, lvals array<int>, rvals array<int>")
    class Nodes:
        def eval(self, text: str):
            tree = read_tree(text)
            for nid in sorted([*tree.rules, *tree.leaves]):
                r = tree.rules.get(nid)
                if r is None:
                    yield nid, True, tree.leaves[nid], None, None, None, None, None
                else:
                    yield nid, False, None, r.is_cat, r.var, None if r.is_cat else r.cut, sorted(r.left) if r.is_cat else None, sorted(r.right) if r.is_cat else None

    spark.udtf.register(name, Nodes)
