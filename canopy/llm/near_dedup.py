"""MinHash near-duplicates: bands of universal-hash minima, verified, and connected components.

Texts with equal shingle sets form one class with a number of its own. Classes are banded by minima of
universal hashes. Each is first verified against the smallest member of a band bucket; components of those
links leave few buckets that still hold several components. Their members meet across components by an exact
prefix join over shingles, rarest first, and are verified by signature and on full sets. Pairs inside one
component need no comparison, so no link between components is lost and no bucket emits all of its pairs.
Components come from alternating large-star and small-star steps.

Only texts of classes that share a bucket move: a bitmap of at most MOST_BITS bits of their keys, which is
broadcast, lets nearly all other texts stay where they are, and joins on the keys settle the rest.

Defined results: null texts and texts without words have empty sets, are linked with nothing and kept;
texts with fewer words than a shingle are one shingle; rows that share a doc_id are one node, whatever their
texts; in ``components`` a null doc_id is linked with nothing; repeated rows are one class; very long texts are
hashed in slices; no rows give no rows; further columns are left out of ``components``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.shared import ASCII_LOWER, as_bytes, byte_rows, durable, erase, mix, quoted, small_batches, table, tidy, windows, word_hashes, written

BANDS = 36
PIVOTS = 1  #: rounds of comparing the members of a bucket with a random one of them
MOST_BITS = 1 << 29  #: of the bitmap of keys: 64 MB, however many keys there are
MARGIN = 6.0  #: standard errors by which a signature may fall below the threshold


def shingles(text: str | np.ndarray | None, n: int) -> np.ndarray:
    """Distinct hashed shingles, ascending, of a text given as itself or as its bytes."""
    words = word_hashes(ASCII_LOWER[text if isinstance(text, np.ndarray) else as_bytes(text)])
    if not len(words):
        return words
    return np.unique(windows(words, min(n, len(words))) + np.uint64(min(n, len(words))))


def minima(found: np.ndarray, n_hashes: int) -> np.ndarray:
    """The minimum of each universal hash over a set of shingles."""
    rng = np.random.default_rng(11)
    a = rng.integers(0, 1 << 32, n_hashes, np.uint32)[:, None] | np.uint32(1)
    b = rng.integers(0, 1 << 32, n_hashes, np.uint32)[:, None]
    x, out = (found >> np.uint64(32)).astype(np.uint32), np.full(n_hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (a * x[at : at + 1024] + b).min(1), out=out)
    return out


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart by document and text."""
    return F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), F.col(text))


def sketches(docs: DataFrame, n: int, rows: int) -> DataFrame:
    """doc_id, key, n_shingles, a fingerprint of the set, one byte of each minimum, and a key for each band."""
    names, kinds = ["doc_id", "key", "n_shingles", "fp", "sig", "bands"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, rows + 1, dtype=np.uint64)
        for batch in batches:
            size, print_, sig, bands = [], [], [], []
            for raw in byte_rows(batch.column(2)):
                s = shingles(raw, n)
                size.append(len(s))
                if not len(s):
                    for x in (print_, sig, bands):
                        x.append(None)
                    continue
                m = minima(s, BANDS * rows)
                keys = mix((m.reshape(BANDS, rows).astype(np.uint64) * power).sum(1, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64)))
                print_.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append((m & 0xFF).astype(np.uint8).tobytes())
                bands.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip((size, print_, sig, bands), kinds[2:], strict=True))], names)

    return small_batches(docs).select("doc_id", text_key().alias("key"), "text").mapInArrow(run, "doc_id long, key long, n_shingles long, fp binary, sig binary, bands array<long>")


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key``, a hash, is among ``keys`` (key), and a few others: all rows that meet a bitmap with
    16 bits or more for each of the keys, or of MOST_BITS. The bitmap is broadcast and rows stay where they are."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
    # Buckets count from 1 and hold 32768 bits, lowest bit first.
    bucket = lambda c: F.bitmap_bucket_number(F.pmod(c, F.lit(bits)))
    bit = lambda c: F.bitmap_bit_position(F.pmod(c, F.lit(bits)))
    bitmap = keys.groupBy(bucket(F.col("key")).alias("_bucket")).agg(F.bitmap_construct_agg(bit(F.col("key"))).alias("_bits"))
    at = bit(F.col(key))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bitmap), bucket(F.col(key)) == F.col("_bucket"))
    return met.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop("_bucket", "_bits")


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int, percent: int, hashes: int) -> DataFrame:
    """Pairs (a, b) whose signatures come near and whose full sets reach the similarity."""
    share = percent / 100
    least = share - MARGIN * (share * (1 - share) / hashes) ** 0.5
    columns, schema = ["a", "b", "key_a", "key_b"], "a long, b long, key_a long, key_b long"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
                keep = pa.array((x == y).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:4]], columns)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            keep = []
            for key, p, q in zip(batch.column(2).to_pylist(), byte_rows(batch.column(3)), byte_rows(batch.column(4)), strict=True):
                # Pairs come in order of key_a, whose set serves all of its pairs.
                if key != last:
                    last, x = key, shingles(p, n)
                y = shingles(q, n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    side = lambda k: reps.select(F.col("id").alias(k), F.col("key").alias(f"key_{k}"), F.col("sig").alias(f"sig_{k}"))
    close = durable(pairs.join(side("a"), "a").join(side("b"), "b").select(*columns, "sig_a", "sig_b").mapInArrow(near, schema))
    # Texts move, not their sets: as long random numbers, sets take several times the room.
    text = lambda k: among(texts, "key", close.select(F.col(f"key_{k}").alias("key")).distinct()).select(F.col("key").alias(f"key_{k}"), F.col("text").alias(f"t_{k}"))
    return durable(close.join(text("b"), "key_b").join(text("a"), "key_a").select("a", "b", "key_a", "t_a", "t_b").mapInArrow(exact, "a long, b long"))


def prefix_pairs(texts: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (id, key, c) of different c that can reach the similarity, by an exact prefix join:
    shingles stand rarest first, and a pair has to share one of the first shingles of its smaller and of
    its larger set, at places that leave enough of both. What many texts share stands last and joins nothing."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                s = shingles(raw, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), key, np.int64)), pa.array(s.view(np.int64))], ["key", "s"])

    flat = among(texts, "key", nodes.select("key")).select("key", "text").mapInArrow(exploded, "key long, s long")
    often = flat.groupBy("s").agg(F.count("*").alias("df"))
    sets = flat.join(often, "s").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o")).join(nodes, "key").withColumn("n", F.size("o"))
    first = lambda share: (F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)) + 1).cast("int")
    heads = sets.select("id", "c", "n", first(2 * percent / (100 + percent)).alias("short"), F.posexplode(F.transform(F.slice("o", 1, first(percent / 100)), lambda x: x["s"])).alias("i", "s"))
    # A shingle of one component joins nothing. Of any other, members of its commonest component meet the rest
    # alone, so a large component is not compared with itself.
    each = heads.groupBy("s", "c").agg(F.count("*").alias("k"))
    spread = each.groupBy("s").agg(F.max(F.struct("k", "c"))["c"].alias("common"), F.count("*").alias("k")).where("k > 1").select("s", "common")
    heads = durable(heads.join(spread, "s"))
    x = heads.select(*(F.col(c).alias(f"{c}x") for c in ("id", "c", "n", "i", "short")), "s")
    y = heads.where("c <> common").select(*(F.col(c).alias(f"{c}y") for c in ("id", "c", "n", "i", "short")), "s")
    # Either may be the larger set; the smaller one has to share a shingle of its shorter prefix.
    larger = "nx > ny OR nx = ny AND idx > idy"
    smaller_first = f"CASE WHEN {larger} THEN iy < shorty ELSE ix < shortx END"
    enough = f"least(nx - ix, ny - iy) * {100 + percent} >= {percent} * (nx + ny)"
    met = x.join(y, "s").where(f"cx <> cy AND 100 * least(nx, ny) >= {percent} * greatest(nx, ny) AND {smaller_first} AND {enough}")
    return met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def connect(links: DataFrame) -> DataFrame:
    """Maps each linked node to the smallest node it reaches: (id, component)."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while True:
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # The least neighbour of u is one of v, so that the pairs (u, m) come with those of v.
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = durable(small.distinct())
        tidy(edges.sparkSession)
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = after


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) with further links (a, b)."""
    return found if links.isEmpty() else connect(found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(links))


def linked(docs: DataFrame, n: int, percent: int, rows: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_shingles, id) of ``docs`` (doc_id, text), id being the number of a class of equal sets
    and null for empty ones; and (id, component) of the classes, component being one of its classes' ids. If
    ``by_id``, classes that share a doc_id are one component, and rows of a null doc_id link nothing."""
    spark = docs.sparkSession
    made, made_at = written(sketches(docs, n, rows))
    classes = made.where("fp IS NOT NULL" + " AND doc_id IS NOT NULL" * by_id).groupBy("fp").agg(F.min("key").alias("key"), F.min("doc_id").alias("low"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    reps = durable(classes.withColumn("id", F.monotonically_increasing_id()))
    of = durable(made.select("doc_id", "key", "n_shingles", "fp").join(reps.select("fp", "id"), "fp", "left").drop("fp"))
    erase(spark, made_at)
    shared = of.where("doc_id IS NOT NULL AND id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z")
    same = of.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b")).where("a <> b").distinct()
    same = durable(same if by_id else same.limit(0))

    banded = reps.select("id", "low", F.explode("bands").alias("band"))
    shared_bands = banded.join(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band")
    # The original of a family shares more and larger buckets than its copies do with each other.
    members, members_at = written(shared_bands.withColumn("share", F.sum("size").over(Window.partitionBy("id"))).drop("size"))
    own = docs.select(text_key().alias("key"), "text")
    texts, texts_at = written(among(own, "key", reps.join(members.select("id").distinct(), "id", "left_semi").select("key")).dropDuplicates(["key"]))
    check = lambda pairs: verified(pairs, reps, texts, n, percent, BANDS * rows)
    middle = lambda m: m.groupBy("band").agg(F.max(F.struct("share", (-F.col("id")).alias("last"), *(["c"] if "c" in m.columns else []))).alias("p"))
    lead = members.groupBy("band").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "id")).alias("lead"))
    star = members.select("band", "id").join(lead, "band").where("id <> lead.id").groupBy("id").agg(F.min("lead")["id"].alias("a"))
    found = connect(same.union(check(star.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")))))
    for _ in range(PIVOTS):
        # Every bucket compares what its pivot's component lacks with the pivot, which is the most central of those
        # outside the component of the most central of all: one pair per member at most.
        known, known_at = written(members.join(found, "id", "left").select("band", "id", "share", F.coalesce("component", "id").alias("c")))
        outside = known.join(middle(known).select("band", F.col("p.c").alias("first")), "band").where("c <> first").drop("first")
        pivot = middle(outside).select("band", (-F.col("p.last")).alias("pivot"), F.col("p.c").alias("pc"))
        met = known.join(pivot, "band").where("c <> pc").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        found = extended(found, check(met))
        erase(spark, known_at)

    known = members.join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    split = known.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("band")
    nodes = durable(known.join(split, "band").select("id", "c").distinct().join(reps.select("id", "key"), "id"))
    erase(spark, members_at)
    found = extended(found, check(prefix_pairs(texts, nodes, n, percent)))
    erase(spark, texts_at)
    return of, reps.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def components(docs: DataFrame, n: int = 5, percent: int = 80, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reached, of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of, found = linked(docs, n, percent, rows, True)
    named = of.where("doc_id IS NOT NULL AND id IS NOT NULL").join(found, "id")
    low = named.groupBy("id", "component").agg(F.min("doc_id").alias("low"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    label = low.join(least, "component").select("id", "component_id")
    # Rows of a null doc_id are told from others by it; a document without words is alone unless it has other rows.
    alone = of.where("doc_id IS NOT NULL AND id IS NULL").join(named.groupBy("doc_id").agg(F.min("component").alias("component")).join(least, "component").select("doc_id", "component_id"), "doc_id", "left")
    out = of.where("doc_id IS NOT NULL AND id IS NOT NULL").join(label, "id").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(alone.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    return out.unionByName(of.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85, 7)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT id, doc_id, len(w) AS k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT id, doc_id, k, i, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM e),
g AS (SELECT DISTINCT id, doc_id, s FROM x WHERE i <= greatest(k - 2, 1)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
met AS (SELECT a.id AS x, b.id AS y, any_value(a.doc_id) AS a, any_value(b.doc_id) AS b, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.id < b.id AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.id, b.id),
near AS (SELECT DISTINCT a, b FROM met JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept FROM d LEFT JOIN n USING (id) LEFT JOIN low ON low.doc_id = d.doc_id
"""


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, nulls last, and then of the smallest hash of
    its columns. Repeated rows are one document. Rows without words stay, repeated ones once."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of, found = linked(named, 5, 80, 5, False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("key")
    stay = of.join(found, "id").groupBy("component").agg(first).select("key").union(of.where("id IS NULL").select("key").distinct())
    columns = [F.col(quoted(c)) for c in docs.columns]
    one = docs.groupBy(F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text")).alias("key")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return one.join(stay, "key", "left_semi").select("row.*")
