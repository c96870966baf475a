"""Helpers shared by the operators: byte-level word hashing in numpy and durable cuts of lineage."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: The white space that ends a word: space, and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
SLICE = 1 << 16  #: bytes of a text that are hashed at once, so that no table grows with a text
TEXT_BATCH = 2000  #: most texts that a worker is sent at once
LONG = 512  #: spans of more bytes are hashed one by one, by blake2b
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_IS_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
#: A-Z to a-z; every other byte stays.
ASCII_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _powers(base: int) -> np.ndarray:
    p = np.full(SLICE + LONG, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS, _INVERSES = _powers(BASE), _powers(INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on all of its input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span of bytes, equal for equal bytes wherever they stand. Spans ascend."""
    out = np.zeros(len(starts), np.uint64)
    short = np.flatnonzero(ends - starts <= LONG)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    s, e, at = starts[short], ends[short], 0
    while at < len(s):
        low = int(s[at])
        to = int(np.searchsorted(s, low + SLICE))
        high = int(e[to - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * _POWERS[: high - low], out=total[1:])
        a, b = s[at:to] - low, e[at:to] - low
        out[short[at:to]] = mix((total[b] - total[a]) * _INVERSES[a] + (b - a).astype(np.uint64))
        at = to
    return out


def word_spans(raw: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text given as bytes: runs without white space or, with
    ``letters``, runs of ASCII letters, digits and everything outside ASCII."""
    return runs(_IS_WORD[raw] if letters else ~_IS_SPACE[raw])


def word_hashes(raw: np.ndarray, letters: bool = False) -> np.ndarray:
    return spans_hash(raw, *word_spans(raw, letters))


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without a copy, and the offsets of its rows; a null row is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of every row of a string column in turn."""
    raw, at = column_bytes(column)
    for k in range(len(column)):
        yield raw[at[k] : at[k + 1]]


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Cuts lineage by a Parquet table in the same folder, for many narrow rows, which a checkpoint stores at
    several times their size. Whoever knows that nothing reads the table again passes its path to ``erase``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tidy(spark: SparkSession) -> None:
    """Asks for a collection of the driver's garbage: then Spark deletes the shuffle files that nothing reads again,
    which in a loop would stay until the driver runs short of memory."""
    spark._jvm.System.gc()


def erase(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, and shuffle files with it."""
    tidy(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the session was given by
    setCheckpointDir. Without either only a session of one machine gets a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*)?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="canopy-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def unit(*columns: Column) -> Column:
    """A hash of columns as a number from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def enough(bound: int, n: int | Column):
    """The share of n rows whose hashes all but surely hold ``bound`` rows or more, and not many more. It is a
    share of the hashes' whole range and so stays above 0 for any n."""
    most = bound + 10 * bound**0.5 + 10
    return most / max(n, 1) if isinstance(n, int) else most / n


def crc_part(n: int, key: str = "doc_id") -> Column:
    """crc32 of a key as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def fresh(taken: list[str], name: str) -> str:
    """A column name that clashes with none of ``taken``, whatever their case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the session to TEXT_BATCH rows, for texts take kilobytes each where the usual
    bound of 10,000 rows has numbers in mind."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_BATCH:
        df.sparkSession.conf.set(key, str(TEXT_BATCH))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
