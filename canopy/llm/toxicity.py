"""Toxicity by FTRL-proximal logistic regression.

Features are hashed word unigrams (whole, and cut to stems, so that inflected forms share a feature),
bigrams and skip-grams (one word left out) of the whole lower-cased text, each counted once. Per-coordinate
rates and L1 sparsity leave few weights, which are broadcast: at most 2**BITS of them.
The model is fitted on a sample of at most SAMPLE labelled documents, those of the smallest hashes of doc_id.

Defined results: null and empty texts score by the bias alone; of several labels of a document the
largest counts, null labels do not; of several texts of a labelled document the one of the smallest hash is
learned from; without labels every score is that of a bias of -1, 0.2689; very long texts are read whole;
repeated rows and ties get equal scores; further columns pass, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.shared import BASE, as_bytes, column_bytes, crc_part, enough, fresh, mix, quoted, small_batches, spans_hash, table, unit, word_spans

BITS = 21
STEMS = (4, 5, 6)  #: bytes of a word's start that stand for its inflected forms
SAMPLE = 12_000  #: bound of the training sample
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 1.0, 10
NO_LABELS = (np.zeros(0, np.int32), np.zeros(0, np.float32), -1.0)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features, ascending; the bias is not among them."""
    raw = as_bytes((text or "").lower())
    starts, ends = word_spans(raw, letters=True)
    if not len(starts):
        return np.zeros(0, np.int32)
    w, b = spans_hash(raw, starts, ends), np.uint64(BASE)
    grams = [w, w[:-1] * b + w[1:], (w[:-2] * b + w[2:]) * b]
    for n in STEMS:
        long = ends - starts > n
        grams.append(spans_hash(raw, starts[long], starts[long] + n) + np.uint64(n))
    return np.unique(mix(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int32)


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the bias."""
    size = 1 << BITS
    z, n, zb, nb = np.zeros(size), np.zeros(size), 0.0, 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, y = rows[k]
            w, bias = weights(z[at], n[at]), -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias, nb + g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32), float(-zb / ((BETA + nb**0.5) / ALPHA))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on documents (doc_id, text) with a label (doc_id, toxic)."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    some = unit(F.col("doc_id")) < enough(sample, marks.count())
    # At most ``sample`` ids, broadcast: texts that are not learned from stay where they are.
    ids = marks.where(some).orderBy(unit(F.col("doc_id")), "doc_id").limit(sample)
    marked = docs.where(some).select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["doc_id", "x", "y"])

    got = marked.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x binary, y int").toArrow().combine_chunks()
    if not got.num_rows:
        return NO_LABELS
    raw, at = column_bytes(got["x"].chunk(0))
    y, order = got["y"].to_numpy(), np.argsort(got["doc_id"].to_numpy(), kind="stable").tolist()
    return train([(raw[at[k] : at[k + 1]].view(np.int32), int(y[k] > 0)) for k in order])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns named in ``keep`` and the score of every whole text; a column named ``out`` gives way to it."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, values, bias = shared.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = values
        for some in texts:
            s = np.array([w[features(t.as_py())].sum(dtype=np.float64) for t in some], float)
            yield pa.array(1 / (1 + np.exp(-np.clip(s + bias, -30, 30))), pa.float64())

    return small_batches(docs).select(*(F.col(quoted(c)) for c in keep if c.lower() != out.lower()), run(F.col(quoted(text))).alias(out))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(crc_part(5) != 0), table(spark, sf_dir, "labels").where(crc_part(5) != 0))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_part(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half, with all of their columns. Null and empty texts score by the bias,
    repeated rows go or stay together, no rows give no rows."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    out = fresh(docs.columns, "toxic_score")
    return score(docs, model, out=out).where(F.col(out) < 0.5).drop(out)
