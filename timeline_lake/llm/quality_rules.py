"""Quality rules, then a likelihood ratio between trusted texts and the raw corpus.

Both sides are multinomials over hashed n-grams (four bytes each) with one bucket table of fixed size. The raw side counts
every n-gram of every text; the trusted side those of texts whose base figures leave no doubt (enough words, hardly a
symbol, few repeats, no repeated line). A text is kept if the mean log ratio of its n-grams reaches the threshold: which
documents stay is the same in every run and does not depend on the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given
from timeline_lake.llm.text_figures import base_failed, base_figures

BUCKET_BITS = 16
NGRAM_BYTES = 4
# Trusted and ordinary texts lie around 0, some clean short ones a little below.
THRESHOLD = -0.4
SMOOTHING = 0.5
_SLICE = 1 << 22


def buckets(data: bytes, bits: int = BUCKET_BITS):
    """Bucket numbers of all n-grams of a text, in parts of bounded size."""
    for at in range(0, max(0, len(data) - NGRAM_BYTES + 1), _SLICE):
        b = np.frombuffer(data, np.uint8, min(_SLICE + NGRAM_BYTES - 1, len(data) - at), at).astype(np.uint32)
        gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        yield (gram ^ gram >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def trusted(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> bool:
    return n_words >= 50 and 200 * n_symbols <= word_chars and 5 * n_repeat_words <= n_words and n_dup_lines == 0


def _texts(batches):
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = text.as_py() or ""
            yield doc_id, whole, whole.encode("utf-8")


def count_ngrams(docs: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """bucket, n_raw, n_trusted over all texts; each task adds up its own first."""

    def count(batches):
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for _, text, data in _texts(batches):
            take = trusted(*base_figures(text, data))
            for part in buckets(data, bits):
                # Short texts touch few buckets: adding at those is cheaper than a pass over the table.
                if len(part) < 1 << bits:
                    at, n = np.unique(part, return_counts=True)
                    raw[at] += n
                    if take:
                        good[at] += n
                else:
                    n = np.bincount(part, minlength=1 << bits)
                    raw += n
                    if take:
                        good += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "n_raw", "n_trusted"])

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = asked.mapInArrow(count, "bucket int, n_raw long, n_trusted long")
    return counts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_trusted").alias("n_trusted"))


def log_ratios(docs: DataFrame, bits: int = BUCKET_BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(trusted share / raw share) of every bucket. The table holds 2^bits entries, however large the corpus is.

    Smoothing draws the trusted shares towards the raw ones, so a bucket that was hardly seen says nothing.
    """
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    for row in count_ngrams(docs, bits).collect():  # at most 2^bits rows
        raw[row["bucket"]], good[row["bucket"]] = row["n_raw"], row["n_trusted"]
    if not good.sum():
        return np.zeros(1 << bits, np.float32)
    share = good.sum() / raw.sum()
    expected = raw * share
    return np.log((good + smoothing) / (expected + smoothing)).astype(np.float32)


def _verdict(text: str, data: bytes, table: np.ndarray, bits: int) -> tuple[tuple, float]:
    """(base figures, mean log ratio); the ratio of a text that fails the base rules is minus infinity."""
    figures = base_figures(text, data)
    if base_failed(figures[0], figures[4]):
        return figures, -np.inf
    total = sum(float(table[part].sum(dtype=np.float64)) for part in buckets(data, bits))
    return figures, total / max(1, len(data) - NGRAM_BYTES + 1)


def judge(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base figures, base_failed, log_ratio, kept.

    A null text counts as empty. A text that fails the base rules, as every one of under 50 words does, has a null ratio and
    is not kept. Without a trusted text every ratio is 0. Equal rows are judged alike; a null doc_id makes no difference.
    """
    table = log_ratios(docs, bits)

    def rows(batches):
        for batch in batches:
            out = []
            for doc_id, text, data in _texts([batch]):
                figures, ratio = _verdict(text, data, table, bits)
                failed = ratio == -np.inf
                out.append((doc_id, *figures, failed, None if failed else ratio, ratio >= threshold))
            columns = list(zip(*out)) or [[]] * 9
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _COLUMNS)

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(rows, ", ".join(f"{c} {k}" for c, k in zip(_COLUMNS, ["long"] * 6 + ["boolean", "double", "boolean"])))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; counts come from these ``docs``. Nothing is shuffled."""
    table = log_ratios(docs, bits)
    at = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            good = []
            for text in batch.column(at):
                whole = text.as_py() or ""
                good.append(_verdict(whole, whole.encode("utf-8"), table, bits)[1] >= threshold)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(given(spark, folder, "documents"))
