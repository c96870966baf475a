"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed byte n-grams of whole texts: one-versus-rest machines choose
the language family, then one-versus-one machines of that family's languages vote. The machines are
fitted on a sample of at most PER_LANG labelled documents of each language, and MOST of all (those of the
smallest hashes of doc_id and text, repeated rows once); predictions cover every text and see nothing but the text.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no labelled rows
every text is ``und``; very long texts are read whole; repeated rows get equal predictions; ties go to the
earlier family and language; further columns pass, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.shared import SLICE, as_bytes, crc_part, enough, mix, quoted, small_batches, table, unit

BITS = 12
PER_LANG = 400  #: bound of the training sample, for each language
MOST = 20_000  #: bound of the whole training sample, 16 KB each; more languages get fewer rows each
GAP = 1e-3  #: largest duality gap of a fitted machine, as a share of its objective
#: Families of common languages; another language is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "nl", "no", "sv"], "romance": ["ca", "es", "fr", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "pl", "ru", "sk", "sr", "uk"], "uralic": ["et", "fi", "hu"], "turkic": ["az", "kk", "tr"],
}


def features(text: str) -> np.ndarray:
    """Square roots of hashed counts of byte n-grams of 1 to 4 bytes, with unit length."""
    whole, out = as_bytes(text.lower()), np.zeros(1 << BITS)
    for low in range(0, len(whole), SLICE):
        # A slice holds the n-grams that start in it.
        raw = whole[low : low + SLICE + 3].astype(np.uint64)
        gram, starts = raw, min(SLICE, len(whole) - low)
        for n in range(1, 5):
            if n > 1:
                gram = gram[:-1] * np.uint64(257) + raw[n - 1 :]
            if not len(gram):
                break
            out += np.bincount((mix(gram[:starts] * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def weights(y: np.ndarray) -> np.ndarray:
    """Both sides of a machine weigh the same."""
    return np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)


def gap(w: np.ndarray, x: np.ndarray, y: np.ndarray, cost: float) -> tuple[float, float]:
    """The objective and its distance from the dual objective at the point that w gives."""
    c = cost * weights(y)
    slack = np.maximum(0, 1 - y * (x @ w))
    primal = 0.5 * w @ w + (c * slack * slack).sum()
    alpha = 2 * c * slack
    u = x.T @ (alpha * y)
    return float(primal), float(primal - (alpha.sum() - 0.5 * u @ u - (alpha * alpha / (4 * c)).sum()))


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.ones((len(x), 1), x.dtype)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, most: int = 3000) -> np.ndarray:
    """Squared-hinge linear machine by accelerated gradient with restarts, until the duality gap is GAP of the
    objective; y is -1 or 1; the last weight is the bias, which is penalised like the others."""
    x, c = with_bias(x.astype(np.float64)), cost * weights(y)
    top, largest = np.ones(x.shape[1]), 0.0
    for _ in range(30):
        # Power iteration; a tenth more bounds the largest eigenvalue of the curvature.
        top = x.T @ (c * (x @ top))
        largest = float(np.linalg.norm(top))
        top /= max(largest, 1e-300)
    rate = 1.0 / (1.0 + 2.2 * largest)
    w = v = np.zeros(x.shape[1])
    t = 0
    for step in range(most):
        slope = v - 2 * x.T @ (c * y * np.maximum(0, 1 - y * (x @ v)))
        new = v - rate * slope
        t = 0 if slope @ (new - w) > 0 else t + 1
        v, w = new + t / (t + 3) * (new - w), new
        if step % 20 == 19:
            primal, apart = gap(w, x, y, cost)
            if apart <= GAP * primal:
                break
    return w.astype(np.float32)


@dataclass
class Model:
    """Families and their languages; weights of one machine per family, and per pair of languages."""

    families: list[list[str]]
    family_w: np.ndarray
    pair_w: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = with_bias(x)
        margin = np.clip(x @ self.family_w.T, -8, 8)
        odds = 1 / (1 + np.exp(-4 * margin))
        choice = margin.argmax(1)
        score = odds[np.arange(len(x)), choice] if len(self.families) > 1 else np.ones(len(x))
        lang = np.array([self.families[c][0] for c in choice], object)
        for k, langs in enumerate(self.families):
            at = np.flatnonzero(choice == k)
            if len(langs) < 2 or not len(at):
                continue
            votes, sums = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                m = x[at] @ self.pair_w[langs[i], langs[j]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
            best = (votes + np.tanh(sums) / 4).argmax(1)
            lang[at] = np.array(langs, object)[best]
            score[at] *= 1 / (1 + np.exp(-4 * np.clip(sums[np.arange(len(at)), best] / (len(langs) - 1), -8, 8)))
        return list(lang), score.astype(float)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG, most: int = MOST) -> Model | None:
    """Fits on labelled rows with a text; the sample holds at most ``per_lang`` rows of each language."""
    own = unit(F.col(quoted(key)), F.col(quoted(text)))
    rows = docs.where(F.col(quoted(lang)).isNotNull() & F.col(quoted(text)).isNotNull()).select(F.col(quoted(lang)).alias("lang"), F.col(quoted(text)).alias("text"), own.alias("h"))
    # Repeated rows have one hash and count once; a tenth less makes up for the error of the estimate.
    counts = rows.groupBy("lang").agg((0.9 * F.approx_count_distinct("h", 0.02)).alias("n"))
    each = max(1, min(per_lang, most // max(1, counts.count())))
    cut = counts.select("lang", enough(each, F.col("n")).alias("cut"))
    # The few rows that are learned from meet by language; no other row moves.
    near = rows.join(F.broadcast(cut.orderBy(F.desc("cut"), "lang").limit(most)), "lang").where("h < cut").dropDuplicates(["lang", "h"])
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["lang", "x"])

    sample = near.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow().to_pydict()
    if not sample["lang"]:
        return None
    order = sorted(range(len(sample["lang"])), key=lambda i: (sample["lang"][i], sample["x"][i]))
    y = np.array([sample["lang"][i] for i in order], object)
    x = np.frombuffer(b"".join(sample["x"][i] for i in order), np.float32).reshape(len(y), -1)
    known = sorted(set(y))
    family = {v: next((f for f, vs in FAMILIES.items() if v in vs), v) for v in known}
    families = [[v for v in known if family[v] == f] for f in sorted(set(family.values()))]
    sign = lambda some: np.where(np.isin(y, some), 1.0, -1.0)
    family_w = np.stack([svm(x, sign(f)) if len(families) > 1 else np.zeros(x.shape[1] + 1, np.float32) for f in families])
    pair_w = {}
    for f in families:
        for a, b in combinations(f, 2):
            m = (y == a) | (y == b)
            pair_w[a, b] = svm(x[m], np.where(y[m] == a, 1.0, -1.0))
    return Model(families, family_w, pair_w)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, out: str = "language") -> DataFrame:
    """The columns named in ``keep`` and a struct ``out`` of lang_pred and score; a column of that name gives way
    to it. The model's size is set by BITS and the languages."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            lang, score = ["und"] * len(batch), [0.0] * len(batch)
            for low in range(0, len(batch) if m else 0, 256):
                texts = batch[low : low + 256].to_pylist()
                at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                if at:
                    for i, a, b in zip(at, *m.predict(np.stack([features(texts[i]) for i in at])), strict=True):
                        lang[low + i], score[low + i] = a, float(b)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return small_batches(docs).select(*(F.col(quoted(c)) for c in keep if c.lower() != out.lower()), run(F.col(quoted(text))).alias(out))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_part(3) != 1))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", (crc_part(3) == 1).alias("held_out"), "language.*")
