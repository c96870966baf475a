"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, measure which share of a text's characters lies
inside n-grams that occur twice or more and inside repeated lines. Words are runs without ASCII white
space. Equality is equality of 64-bit hashes.

Defined results: a null or empty text has no words and fails; repeated rows are judged each alone, so ties
do not arise; whole texts are read, whatever their length, in some 30 bytes of memory for each of theirs;
further columns pass through, whatever their names, and never enter Python; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.shared import as_bytes, byte_rows, fresh, quoted, small_batches, spans_hash, table, windows, word_spans

SYMBOLS = b"#*$%&|<>"
#: Largest share of word characters inside repeated n-grams, by n-gram length, for a kept text.
COVERAGE = {5: 0.32, 7: 0.30, 10: 0.22}
#: Largest share of word characters inside lines equal to an earlier line.
LINE_COVERAGE = 0.30
#: Largest number of symbols for each word, of words without a lower-case letter, and of words with "!!".
SYMBOLS_PER_WORD, SHOUTED = 0.3, 0.6
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, shouted_share double, " + ", ".join(f"cover_{n} double" for n in COVERAGE)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def later(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that equal an earlier one."""
    mark = np.ones(len(keys), bool)
    mark[np.unique(keys, return_index=True)[1]] = False
    return mark


def covered(words: np.ndarray, n: int) -> np.ndarray:
    """Marks the words inside windows of n words found twice or more."""
    step = np.zeros(len(words) + 1, np.int64)
    if len(words) >= n:
        at = np.flatnonzero(repeated(windows(words, n)))
        np.add.at(step, at, 1)
        np.add.at(step, at + n, -1)
    return np.cumsum(step)[:-1] > 0


def per_span(mark: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each span are marked. Spans ascend and do not meet."""
    if not len(starts):
        return np.zeros(0, np.int64)
    padded = np.append(mark, False).view(np.uint8)
    return np.add.reduceat(padded, np.stack((starts, ends), 1).ravel(), dtype=np.int64)[::2]


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def measure(text: str | np.ndarray | None) -> tuple:
    """The measures of one whole text, given as itself or as its bytes, in the order of MEASURES."""
    raw = text if isinstance(text, np.ndarray) else as_bytes(text)
    starts, ends = word_spans(raw)
    n, symbols = len(starts), int(_SYMBOL[raw].sum())
    if not n:
        return (0, 0, symbols, 0, 0, 0.0, 0.0, *[0.0] * len(COVERAGE))
    size = per_span((raw & 0xC0) != 0x80, starts, ends)  # code points
    total = int(size.sum())
    words = spans_hash(raw, starts, ends)

    lines_at = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    lines_to = np.concatenate((lines_at[1:] - 1, [len(raw)]))
    first = np.searchsorted(starts, lines_at)
    after = np.searchsorted(starts, lines_to)
    real = after > first
    dup = later(spans_hash(raw, lines_at[real], lines_to[real]))
    before = np.concatenate(([0], np.cumsum(size)))
    in_dup = (before[after[real]] - before[first[real]])[dup].sum()

    lower = per_span((raw >= 97) & (raw <= 122), starts, ends)
    upper = per_span((raw >= 65) & (raw <= 90), starts, ends)
    loud = (lower == 0) & (upper >= 2)
    return (
        n, total, symbols, int(dup.sum()), int(covered(words, 3).sum()),
        float(in_dup / total), float(loud.sum() / n), *(float(size[covered(words, k)].sum() / total) for k in COVERAGE),
    )


def base_failed(m: str = "") -> Column:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col(f"{m}n_words") < 50) | (100 * F.col(f"{m}n_repeat_words") > 50 * F.col(f"{m}n_words"))


def verdict(m: str = "") -> Column:
    """False for a text that fails the base rules or has too much repetition, symbols or shouting."""
    fails = base_failed(m) | (F.col(f"{m}dup_line_share") > LINE_COVERAGE) | (F.col(f"{m}n_symbols") > SYMBOLS_PER_WORD * F.col(f"{m}n_words")) | (F.col(f"{m}shouted_share") > SHOUTED)
    for n, most in COVERAGE.items():
        fails = fails | (F.col(f"{m}cover_{n}") > most)
    return ~fails


def measured(text: Column) -> Column:
    """A struct of the measures of a text column. Only the text goes to Python and only the measures come back."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.float64() for x in MEASURES.split(", ")]

    @F.arrow_udf(f"struct<{MEASURES.replace(' long', ':bigint').replace(' double', ':double')}>")
    def run(texts: pa.Array) -> pa.Array:
        columns = list(zip(*map(measure, byte_rows(texts)), strict=True)) or [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run(text)


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "measures") -> DataFrame:
    """The columns named in ``keep`` (all by default) and a struct ``out`` of the measures; a column of that name
    gives way to it."""
    keep = docs.columns if keep is None else keep
    return small_batches(docs).select(*(F.col(quoted(c)) for c in keep if c.lower() != out.lower()), measured(F.col(quoted(text))).alias(out))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measures(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "measures.*")
    return m.withColumn("base_failed", base_failed()).withColumn("kept", verdict())


def sql() -> str:
    """Every window and line of every text, compared as itself."""
    word, shares = r"[^\x20\x09-\x0D]+", ", ".join(f"coalesce(max(chars) FILTER (WHERE n = {n}), 0) / any_value(nullif(word_chars, 0)) AS cover_{n}" for n in COVERAGE)
    covers = ", ".join(f"coalesce(cover_{n}, 0.0)::DOUBLE AS cover_{n}" for n in COVERAGE)
    sizes = (3, *COVERAGE)
    grams = ", ".join(f"string_agg(word, ' ') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g{n}" for n in sizes)
    each = " UNION ALL ".join(f"SELECT id, {n} AS n, i, g{n} AS gram FROM x WHERE rest >= {n}" for n in sizes)
    limits = " OR ".join(f"cover_{n} > {most}" for n, most in COVERAGE.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
e AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT id, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (WHERE NOT regexp_matches(word, '[a-z]') AND length(regexp_replace(word, '[^A-Z]', '', 'g')) >= 2) AS loud FROM e GROUP BY id),
x AS (SELECT id, i, count(*) OVER (PARTITION BY id) - i + 1 AS rest, {grams} FROM e),
g AS ({each}),
r AS (SELECT id, n, i FROM (SELECT id, n, i, count(*) OVER (PARTITION BY id, n, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT DISTINCT id, n, i + k AS i FROM r, range(0, 10) AS x(k) WHERE k < n),
v AS (SELECT id, n, count(*) AS words, sum(length(word)) AS chars FROM c JOIN e USING (id, i) GROUP BY id, n),
l AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
o AS (SELECT id, line, row_number() OVER (PARTITION BY id, line ORDER BY k) AS again FROM l WHERE regexp_matches(line, '{word}')),
u AS (SELECT id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_chars FROM o WHERE again > 1 GROUP BY id),
a AS (SELECT d.id, any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, coalesce(any_value(word_chars), 0) AS word_chars, any_value(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(any_value(n_dup_lines), 0) AS n_dup_lines, coalesce(max(words) FILTER (WHERE n = 3), 0) AS n_repeat_words, coalesce(any_value(dup_chars) / any_value(nullif(word_chars, 0)), 0.0)::DOUBLE AS dup_line_share,
  coalesce(any_value(loud) / nullif(any_value(len(w)), 0), 0.0)::DOUBLE AS shouted_share, {shares}
  FROM d LEFT JOIN s USING (id) LEFT JOIN v USING (id) LEFT JOIN u USING (id) GROUP BY d.id),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_share, shouted_share, {covers}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT (base_failed OR dup_line_share > {LINE_COVERAGE} OR n_symbols > {SYMBOLS_PER_WORD}::DOUBLE * n_words OR shouted_share > {SHOUTED} OR {limits}) AS kept FROM m"""


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with all of their columns. Null and empty texts go, repeated rows go or stay
    together, no rows give no rows."""
    out = fresh(docs.columns, "measures")
    return measures(docs, out=out).where(verdict(f"{out}.")).drop(out)
