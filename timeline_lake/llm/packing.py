"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

The method fills a sequence greedily, largest first, and then replaces its smallest document by two unpacked ones that
fit the gap so widened more tightly. Which documents go together depends on their lengths alone, and there are at most
``capacity`` lengths. So the plan is worked out once on the table of counts per length (its size is bounded by the
capacity, not by the data), each step of it repeated for as many sequences as the counts allow; every document then finds
its place from its length and its rank among the documents of that length. No task sees more than a block of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given
from timeline_lake.llm.tokens import BYTE_BPE_JSON, tokenizer_cache, vocabulary
from timeline_lake.operators.blocks import row_numbers
from timeline_lake.session import cut_lineage

CAPACITY = 1024
END_ID = 2
ROWS_PER_BLOCK = 1 << 10


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise every whole text (null: empty), append ``end_id`` and cut what is longer than ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32. All pieces of a document but the first have ``capacity`` tokens.
    """
    def cut(batches):
        encoder = tokenizer_cache(path)
        for batch in batches:
            at = 0
            for ids, sizes in encoder.chunks(batch.column(1), end_id):
                # The first piece of a document takes what full ones leave, or one of them.
                pieces_of = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces_of)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
                head = (sizes - 1) % capacity + 1
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[row])
                flat = memoryview(ids.astype("<u4").tobytes())
                ends = (4 * np.cumsum(length)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sizes)).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array([zlib.crc32(flat[a:b]) for a, b in zip([0, *ends], ends)], pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                at += len(sizes)

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Which lengths share a sequence, and how often: [(number of sequences, lengths in order), …].

    Works on counts per length. Each step uses up at least one length of those it takes or leaves fewer than it needs, so
    there are only a few times ``capacity`` steps, however many documents there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece must have 1 to capacity tokens")
    lengths = sorted(left)
    steps: list[tuple[int, list[int]]] = []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            lengths.pop(bisect_right(lengths, n) - 1)

    def give_back(n: int) -> None:
        if not left[n]:
            insort(lengths, n)
        left[n] += 1

    while lengths:
        chosen, gap = [], capacity
        while (at := bisect_right(lengths, gap)) and gap:
            chosen.append(lengths[at - 1])
            gap -= chosen[-1]
            take(chosen[-1])
        if gap and len(chosen) > 1 and (pair := _two(lengths, left, chosen[-1], gap + chosen[-1])):
            give_back(chosen.pop())
            for n in pair:
                take(n)
            chosen.extend(pair)
        need = {n: chosen.count(n) for n in chosen}
        again = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            if again:
                left[n] -= again * k
                if not left[n]:
                    lengths.pop(bisect_right(lengths, n) - 1)
        steps.append((1 + again, chosen))
    return steps


def _two(lengths: list[int], left: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths whose sum is the largest one above ``smallest`` and not above ``room``."""
    best, found = smallest, None
    i, j = 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room:
            j -= 1
            continue
        if total > best and (i < j or left[lengths[i]] > 1):
            best, found = total, (lengths[j], lengths[i])
        i += 1
    return found


def places(steps: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """The plan as ranges of ranks: the documents of ``length`` with ranks from ``rank`` on fill, ``times`` per sequence,
    sequences from ``sequence`` on at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n_sequences, lengths in steps:
        offset = 0
        for n in dict.fromkeys(lengths):
            times = lengths.count(n)
            rows.append((n, used.get(n, 0), times, sequence, offset))
            used[n] = used.get(n, 0) + n_sequences * times
            offset += n * times
        sequence += n_sequences
    return pd.DataFrame(rows, columns=["length", "rank", "times", "sequence", "offset"]).astype("int64")


def pack(found: DataFrame, capacity: int = CAPACITY, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, …). Rows with a null doc_id are packed too.

    Equal rows get places of their own. An empty table stays empty.
    """
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity)).sort_values(["length", "rank"])
    step = (max(counts.values(), default=0) + rows_per_block) * 2
    keys = (table["length"] * step + table["rank"]).to_numpy()
    first, times, sequence, offset = (table[c].to_numpy() for c in ("rank", "times", "sequence", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * step + rank.to_numpy(), side="right") - 1
        nth = rank.to_numpy() - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + nth // times[at], "offset": offset[at] + nth % times[at] * length.to_numpy()})

    # Ranks among equal lengths: a frequent length is cut into blocks of about `rows_per_block` pieces.
    blocks = F.array(*[F.lit(1 + counts.get(n, 0) // rows_per_block) for n in range(1, capacity + 1)])
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(blocks, F.col("length").cast("int")))
    ranked = row_numbers(found, ["length"], ["doc_id", "piece"], block, "_rank")
    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*found.columns, "_place.sequence_id", "_place.offset")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = cut_lineage(pieces(given(spark, folder, "documents"), vocabulary(BYTE_BPE_JSON)))
    return pack(found)
