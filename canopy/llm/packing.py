"""Best-fit packing by sum of squares.

Documents are encoded whole; only longer ones are cut, into full sequences. Each piece is placed where
the sum over residual gaps of the squared counts of open bins becomes smallest: into a bin with some
gap that fits, or a new bin; of equal choices the tightest gap wins. Pieces are dealt by a hash into
shards of about SHARD pieces, packed independently and longest first, so no task grows with the corpus
and a shard leaves only a handful of bins unfilled.

Defined results: null text is empty and gives one piece, the closing id alone; repeated rows give
pieces each; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.shared import column_bytes, durable, small_batches, table
from canopy.llm.token_ids import word_encoder, word_path

LIMIT, CLOSING = 4096, 1
SHARD = 20_000  #: mean pieces of a shard
AT_ONCE = 1 << 20  #: bytes of texts that are encoded together
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Pieces of at most ``limit`` ids of every document, each with the checksum of its ids."""
    path = path or word_path()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = word_encoder(path), np.uint32(CLOSING).astype("<u4").tobytes()
        for batch in batches:
            keys, (raw, at) = batch.column(0).to_pylist(), column_bytes(batch.column(1))
            lo = 0
            while lo < len(keys):
                # Texts of about AT_ONCE bytes are encoded together, or one longer text alone.
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + AT_ONCE, "right")) - 1)
                ids, first = encoder.texts(raw, at[lo : hi + 1])
                data, first, rows = memoryview(ids.astype("<u4", copy=False)).cast("B"), first.tolist(), []
                for k in range(lo, hi):
                    a, size = first[k - lo], first[k - lo + 1] - first[k - lo] + 1
                    for n, start in enumerate(range(0, size, limit)):
                        end = min(start + limit, size)
                        crc = zlib.crc32(data[4 * (a + start) : 4 * (a + min(end, size - 1))])
                        rows.append((keys[k], n, start, end - start, zlib.crc32(closing, crc) if end == size else crc))
                lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def place(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, for pieces in the order given."""
    count = np.zeros(limit + 1, np.int64)  # open bins by gap; a gap of 0 is closed and counts nothing
    open_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        # Squares change by -2n+1 at the gap that is left and by 2n+1 at the gap that is reached.
        there = count[s:limit]
        change = np.where(there > 0, 2 * (count[: limit - s] - there) + 2, 4 * len(lengths) + 4)
        if s < limit:
            if there[0] > 0:
                change[0] = 1 - 2 * there[0]
            best = int(change.argmin())
        if s < limit and change[best] <= 2 * count[limit - s] + 1 and there[best] > 0:
            gap = s + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = limit, made, made + 1
        bins[k], offsets[k] = b, limit - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces, each shard numbering its own sequences."""
    found = durable(found)
    shards = max(1, -(-found.count() // SHARD))
    schema = f"{PIECE}, sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = place(rows["length"].to_numpy(), limit)
        return rows.drop(columns="_shard").assign(sequence_id=bins + (int(key[0]) << 40), offset=offsets)

    dealt = found.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences; a document taken twice is packed twice."""
    return pack(pieces(docs))
