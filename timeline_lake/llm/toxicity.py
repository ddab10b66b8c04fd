"""Toxicity by the nearest labelled documents: exact cosine of weighted TF-IDF over a block-max inverted index.

1. A term is a word or the beginning of one. Every term of every whole text counts, under one of ``BUCKETS`` numbers that
   its hash names; none is chosen or left out by the labels.
2. One pass over all texts gives the document frequency of every number. A bounded sample of labelled documents is drawn by
   hash. The weight of a term is its TF-IDF weight; one that speaks for label 1 beyond chance weighs more (``relevance``).
3. The sample becomes an index. Its most frequent terms are dense rows, of which a query reads its own. All others have
   postings in blocks of examples with the largest weight of each block: a query bounds every block by its frequent terms'
   best score and those maxima, and reads only postings of blocks that can reach the ``NEIGHBOURS``-th best cosine. What
   is left is scored again in double precision, so the neighbours are the exact ones.
4. Neighbours vote with their cosines. Votes become probabilities by a monotone fit on the sample itself, each example
   voted on without itself. The neighbours are the evidence.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.labels import label_sample, remainder
from timeline_lake.llm.shared import given
from timeline_lake.session import cut_lineage

EXAMPLES = 2_000
BUCKETS = 1 << 18
NEIGHBOURS = 15
BLOCK = 64
FREQUENT = 2_048
# About the logarithm of the number of terms: chance associations stay below and leave a term its plain weight.
CHANCE_ASSOCIATION = 12.0
PREFIXES = (5,)
_WORD = re.compile(r"[^\W\d_]{2,}")
# Queries scored at once, and more than single precision can be off in a sum of ``FREQUENT`` products of unit vectors.
_TOGETHER = 128
_SLACK = 2e-4


def word_terms(word: str) -> list[str]:
    return [word, *[word[:k] + "~" for k in PREFIXES if len(word) >= k]]


def text_terms(text: str) -> Counter:
    """Terms of a whole text with their counts."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for term in word_terms(word):
            out[term] += n
    return out


class HashedTerms:
    """A number below ``size`` for every term there is."""

    def __init__(self, size: int = BUCKETS):
        self.size = size

    def __getitem__(self, term: str) -> int:
        return xxhash.xxh3_64_intdigest(term) % self.size


class TermCounts(dict):
    """Counts of all terms of a text by number. What stands between spaces is looked up once per worker (its terms' numbers as bytes)."""

    def __init__(self, vocabulary: dict[str, int] | HashedTerms, limit: int = 600_000):
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, token: str) -> bytes:
        number = self.vocabulary.__getitem__
        found = self[token] = array("i", [number(t) for w in _WORD.findall(token) for t in word_terms(w)]).tobytes()
        return found

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers in rising order, their counts)."""
        if len(self) > self.limit:
            self.clear()
        numbers = np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), np.int32)
        index, counts = np.unique(numbers, return_counts=True)
        return index, counts.astype(np.int32)

    def numbers(self, text: str) -> np.ndarray:
        """Numbers in rising order, without their counts."""
        if len(self) > self.limit:
            self.clear()
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(text.lower().split()))), np.int32))

    def count(self, text: str) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in self.vector(text))))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = hi - lo
    return np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _index_of(term: np.ndarray, counts: np.ndarray, start: np.ndarray, labels: np.ndarray, idf: np.ndarray, block: int, frequent: int) -> BlockMaxIndex:
    spans = list(zip(start[:-1], start[1:]))
    return BlockMaxIndex([(term[a:b], counts[a:b].astype(np.float64)) for a, b in spans], labels, idf, block, frequent)


class BlockMaxIndex:
    """Examples as unit vectors of TF-IDF weights, by term and block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray, block: int = BLOCK, frequent: int = FREQUENT):
        self.idf, self.labels, self.block = idf, labels, block
        # What the rest is made from: it alone is sent to the workers.
        self.given = (vectors, labels, idf, block, frequent)
        self.n = len(vectors)
        self.n_blocks = -(-self.n // block)
        sizes = np.array([len(i) for i, _ in vectors], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.term = np.concatenate([*(i for i, _ in vectors), np.empty(0, np.int64)]).astype(np.int32)
        self.weight = np.concatenate([*(self.unit(i, c) for i, c in vectors), np.empty(0)])
        row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        posted = np.bincount(self.term, minlength=len(idf))
        common = np.argsort(-posted, kind="stable")[:frequent]
        common = common[posted[common] * 64 > self.n]
        self.column = np.full(len(idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n_blocks * block), np.float32)
        at = self.column[self.term]
        self.dense[at[at >= 0], row[at >= 0]] = self.weight[at >= 0]
        rare = np.flatnonzero(at < 0)
        rare = rare[np.lexsort((row[rare], self.term[rare]))]
        self.row, self.posting = row[rare], self.weight[rare].astype(np.float32)
        # A cell is what one term has in one block.
        cell = self.term[rare].astype(np.int64) * (self.n_blocks or 1) + self.row // block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_start = np.append(first, len(rare))
        self.cell_block = self.row[first] // block
        self.cell_max = np.maximum.reduceat(self.posting, first) if len(first) else self.posting
        self.cell_first = np.searchsorted(self.term[rare][first], np.arange(len(idf) + 1))
        self.query = np.zeros(len(idf))

    def __reduce__(self):
        vectors, labels, idf, *rest = self.given
        counts = np.concatenate([*(c for _, c in vectors), np.empty(0, np.int32)])
        small = counts.astype(np.uint16)
        return _index_of, (self.term, small if (small == counts).all() else counts, self.start, labels, idf, *rest)

    def unit(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(counts)) * self.idf[index]
        return weight / (np.sqrt((weight * weight).sum()) or 1)

    def nearest(self, index: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` examples with the highest positive cosines; ties go to the lower row."""
        return self.nearest_of([(index, counts)], k, [without])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query."""
        units = [self.unit(i, c) for i, c in queries]
        places = [self.column[i] for i, _ in queries]
        asked = np.zeros((len(queries), len(self.dense)), np.float32)
        for q, (at, unit) in enumerate(zip(places, units)):
            asked[q, at[at >= 0]] = unit[at >= 0]
        scores = asked @ self.dense
        best = scores.reshape(len(queries), self.n_blocks, self.block).max(axis=2)
        return [
            self._nearest(i, u, at, s, b, k, w)
            for (i, _), u, at, s, b, w in zip(queries, units, places, scores, best, without or [-1] * len(queries))
        ]

    def _nearest(self, index: np.ndarray, unit: np.ndarray, at: np.ndarray, score: np.ndarray, best: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(index) or not self.n:
            return np.empty(0, np.int64), np.empty(0)
        if without >= 0:
            score[without] = -9
        rare = at < 0
        lo, hi = self.cell_first[index[rare]], self.cell_first[index[rare] + 1]
        cells, weights = _ranges(lo, hi), np.repeat(unit[rare], hi - lo)
        blocks = self.cell_block[cells]
        bound = best + np.bincount(blocks, weights * self.cell_max[cells], self.n_blocks)
        low = self._kth(score, k)
        open_ = (bound >= low - _SLACK)[blocks]
        cells, weights = cells[open_], weights[open_]
        lo, hi = self.cell_start[cells], self.cell_start[cells + 1]
        posted = _ranges(lo, hi)
        score = score + np.bincount(self.row[posted], np.repeat(weights, hi - lo) * self.posting[posted], len(score))
        rows = np.flatnonzero((score > 0) & (score >= self._kth(score, k) - _SLACK))
        # The few that are left, in double precision.
        query = self.query
        query[index] = unit
        spans = zip(self.start[rows].tolist(), self.start[rows + 1].tolist())
        cosines = np.array([query[self.term[lo:hi]] @ self.weight[lo:hi] for lo, hi in spans])
        query[index] = 0
        order = np.lexsort((rows, -cosines))[:k]
        return rows[order], cosines[order]

    def _kth(self, score: np.ndarray, k: int) -> float:
        return float(np.partition(score, len(score) - k)[len(score) - k]) if k < self.n else -1.0

    def vote(self, rows: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        """Share of label 1 among neighbours, weighted by cosine; one vote of weight ``0.1`` for the prior."""
        return (float((cosines * self.labels[rows]).sum()) + 0.1 * prior) / (float(cosines.sum()) + 0.1)


def monotone_fit(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: (votes, probabilities), both rising."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order], labels[order]):
        if pools and pools[-1][3] == v:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([float(y), 1.0, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1][0] += top[0]
            pools[-1][1] += top[1]
            pools[-1][3] = top[3]
    x = [p[i] for p in pools for i in (2, 3)]
    y = [p[0] / p[1] for p in pools for _ in (2, 3)]
    return np.array(x), np.array(y)


def _text(value) -> str:
    return value.as_py() or ""


def document_frequencies(docs: DataFrame, size: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(rows, rows with each term number) over every whole text."""

    def count(batches):
        counter, seen, n = TermCounts(HashedTerms(size)), np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen[counter.numbers(_text(text))] += 1
            n += batch.num_rows
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(seen[found], n), pa.int64())], ["term", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    term, n = counts["term"].to_numpy(), counts["n"].to_numpy()
    frequency = np.zeros(size, np.int64)
    frequency[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), frequency


def example_vectors(docs: DataFrame, sample: DataFrame, size: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(vectors of all terms, labels, ids) of the documents of ``sample`` (of bounded size), by id. Of several rows of one one is used."""

    def count(batches):
        counter = TermCounts(HashedTerms(size))
        for batch in batches:
            found = [counter.vector(_text(text)) for text in batch.column(2)]
            vectors = [pa.array([v[i].tobytes() for v in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *vectors], ["doc_id", "label", "terms", "counts"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = asked.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("label").cast("int"), "text")
    counted = texts.mapInArrow(count, "doc_id long, label int, terms binary, counts binary")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("label", "terms", "counts")).alias("v"))
    found = one.select("doc_id", "v.*").orderBy("doc_id").toArrow()  # at most the sample
    vectors = [tuple(np.frombuffer(v.as_py(), np.int32) for v in pair) for pair in zip(found["terms"], found["counts"])]
    return vectors, found["label"].to_numpy().astype(float), found["doc_id"].to_numpy()


def relevance(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int = BUCKETS) -> np.ndarray:
    """What a term's weight is multiplied with: 1, and more by how far its log-likelihood ratio for label 1 exceeds chance."""
    pos, neg = (np.bincount(np.concatenate([*(v[0] for v, y in zip(vectors, labels) if y == want), np.empty(0, np.int32)]).astype(np.int64), minlength=size) for want in (1, 0))
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return np.ones(size)
    n = np.maximum(pos + neg, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(pos * np.log(pos / (n * share))) + np.nan_to_num(neg * np.log(neg / (n * (1 - share))))
    return 1 + np.where(pos > n * share, np.maximum(0, ratio - CHANCE_ASSOCIATION), 0)


def nearest_labelled(docs: DataFrame, sample: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text): doc_id, score, neighbour_ids, cosines.

    ``sample`` (doc_id, label 0/1) must be of bounded size: it is broadcast and indexed. A null text counts as empty. A
    text without words, or without a term of any example, has no neighbours and gets the share of label 1 at the vote of
    the prior; with one label only every score is the share of label 1 (0 for an empty sample). Equal texts get equal
    scores, a null doc_id is scored like any other.
    """
    n, frequency = document_frequencies(docs)
    vectors, labels, ids = example_vectors(docs, sample)
    idf = (np.log((1 + n) / (1 + frequency)) + 1) * relevance(vectors, labels)
    prior = float(labels.mean()) if len(labels) else 0.0
    index = BlockMaxIndex(vectors, labels, idf)
    left_out = []
    for at in range(0, len(vectors), _TOGETHER):
        some = list(range(at, min(at + _TOGETHER, len(vectors))))
        left_out += [index.vote(*found, prior) for found in index.nearest_of([vectors[i] for i in some], neighbours, some)]
    x, y = monotone_fit(np.array(left_out), labels) if len(labels) else (np.array([0.0]), np.array([0.0]))
    # Kept by a worker from task to task.
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def score(batches):
        index, counter, known = shared.value, TermCounts(HashedTerms()), {}
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                if len(known) > 20_000:
                    known.clear()
                asked = [counter.vector(_text(text)) for text in part.column(1)]
                keys = [xxhash.xxh3_128_digest(i.tobytes() + c.tobytes()) for i, c in asked]
                new = {key: v for key, v in zip(keys, asked) if key not in known}
                for key, (rows, cosines) in zip(new, index.nearest_of(list(new.values()), neighbours) if new else []):
                    known[key] = (float(np.interp(index.vote(rows, cosines, prior), x, y)), ids[rows].tolist(), cosines.tolist())
                out = [known[key] for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([o[0] for o in out], pa.float64()),
                        pa.array([o[1] for o in out], pa.list_(pa.int64())),
                        pa.array([o[2] for o in out], pa.list_(pa.float64())),
                    ],
                    ["doc_id", "score", "neighbour_ids", "cosines"],
                )

    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return asked.mapInArrow(score, "doc_id long, score double, neighbour_ids array<long>, cosines array<double>")


def op6_toxicity_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    sample = cut_lineage(label_sample(given(spark, folder, "labels"), "toxic", 5, 0, EXAMPLES))
    scored = nearest_labelled(given(spark, folder, "documents"), sample)
    return scored.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "neighbour_ids",
        "cosines",
    )
