"""Quality by Bradley-Terry ranking.

Every text has a score w·x of its features x, and a text labelled 1 is preferred to one labelled 0 with probability
1 / (1 + exp(-(score difference))). The weights minimise the logistic loss on feature differences of such pairs, formed of
a bounded sample of labelled texts. Texts are then accepted from a quantile of the scores of all texts on: the one that
separates all labels that may be used best. It is read from counts per narrow range of scores.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.labels import clear_labels, label_sample, remainder
from timeline_lake.llm.shared import given
from timeline_lake.llm.text_figures import SYMBOLS, WHITE, duplicate_lines, repeated_words, word_codes
from timeline_lake.session import cut_lineage

EXAMPLES = 20_000
PAIRS_PER_TEXT = 8
MOST_PAIRS = 200_000
PENALTY = 1e-3
ACCEPTED = 0.7
# Scores are counted in ranges of a 1024th of their spread, up to 32 spreads to either side.
RANGES = 1024
FURTHEST = 1 << 15
_LETTER = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTERS_ONLY = re.compile(r"[^\W\d_]+[.,;:]?\Z")

FEATURES = (
    "length symbols upper marks letterless odd_words repeats same_next vocabulary duplicate_lines line_length word_length digits letters"
).split()


def features(text: str, data: bytes) -> list[float]:
    """Shares and logarithms, all between 0 and about 1, for any text; zeros for one without words."""
    words = data.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    codes = word_codes(words)
    whole = text.split()
    duplicates, lines = duplicate_lines(text)
    letters = max(1, len(_LETTER.findall(text)))
    sized = math.sqrt(n)
    return [
        min(1.0, math.log1p(n) / 12),
        math.sqrt(sum(map(text.count, SYMBOLS)) / chars),
        math.sqrt(len(_UPPER.findall(text)) / letters),
        math.sqrt(sum(map(text.count, "!?;:\"'()[]{}=+_^~`@\\/")) / chars),
        math.sqrt(sum(1 for w in whole if not _LETTER.search(w)) / n),
        math.sqrt(sum(1 for w in whole if not _LETTERS_ONLY.match(w)) / n),
        repeated_words(codes) / n,
        math.sqrt(float((codes[1:] == codes[:-1]).sum()) / n),
        min(1.0, (int(codes.max()) + 1) / (3 * sized)) if n > 9 else 1.0,
        duplicates / lines,
        min(1.0, math.log1p(n / lines) / 8),
        min(1.0, (len(text) - sum(map(text.count, WHITE))) / n / 20),
        math.sqrt(sum(map(text.count, "0123456789")) / chars),
        min(1.0, letters / chars),
    ]


def _of(text) -> list[float]:
    whole = text.as_py() or ""
    return features(whole, whole.encode("utf-8"))


def preference_weights(good: np.ndarray, bad: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights from preferences of each row of ``good`` over rows of ``bad``, by Newton steps on the logistic loss.

    Every row of either side stands in at least one pair; partners are drawn with a fixed seed.
    """
    draw = np.random.default_rng(seed)
    each = max(1, min(PAIRS_PER_TEXT, MOST_PAIRS // max(1, len(good) + len(bad))))
    left = np.concatenate([np.repeat(np.arange(len(good)), each), draw.integers(0, len(good), each * len(bad))])
    right = np.concatenate([draw.integers(0, len(bad), each * len(good)), np.repeat(np.arange(len(bad)), each)])
    x = good[left] - bad[right]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
        slope = -(x * p[:, None]).mean(axis=0) + PENALTY * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + PENALTY * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The quantile of the scores from which on most labels come out right; of several, the middle one."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    right = np.concatenate([[0], np.cumsum(1 - y)]) + np.concatenate([np.cumsum(y[::-1])[::-1], [0]])
    # A cut lies between two different scores.
    borders = np.concatenate([[True], s[1:] != s[:-1], [True]])
    best = np.flatnonzero(borders & (right == right[borders].max()))
    at = int(best[len(best) // 2])
    if at == 0:
        return float(s[0]) - 1
    if at == len(s):
        return float(s[-1]) + 1
    return float(s[at - 1] + s[at]) / 2


class Ranking:
    """What was learned: feature scaling, weights, and the cut and spread of the sample's own scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0)
        self.spread[self.spread < 1e-6] = 1.0
        z = self._scaled(x)
        self.weights = preference_weights(z[y == 1], z[y == 0])
        plain = z @ self.weights
        self.cut, self.range = score_cut(plain, y), max(float(plain.std()), 1e-6) / RANGES

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def plain_scores(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.weights


def fit(docs: DataFrame, sample: DataFrame) -> Ranking | None:
    """Learn from the documents of ``sample`` (doc_id, label), whose size must be bounded: only their features are gathered.

    Nothing can be learned if one of the labels is missing. Of several rows of one document one is used.
    """

    def rows(batches):
        for batch in batches:
            found = pa.array([_of(t) for t in batch.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "label", "features"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = asked.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("label").cast("int"), "text")
    found = texts.mapInArrow(rows, "doc_id long, label int, features array<double>")
    learned = found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("features").alias("features")).orderBy("doc_id").collect()
    y = np.array([r["label"] for r in learned], float)
    return Ranking(np.array([r["features"] for r in learned]), y) if len(set(y.tolist())) == 2 else None


def _plain_scores(docs: DataFrame, model: Ranking, name: str, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``docs`` and the plain score w·x of its column ``text`` as ``name``."""
    asked = docs.select(*kept) if "text" in kept else docs.select(*kept, "text")
    at = asked.columns.index("text")

    def rows(batches):
        for batch in batches:
            found = model.plain_scores(np.array([_of(t) for t in batch.column(at)])) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.float64())], [*kept, name])

    return asked.mapInArrow(rows, docs.select(*kept).schema.add(name, "double"))


def best_border(n: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> int:
    """The range from which on to accept, so that most labels come out right.

    The arrays count the texts, labels 1 and labels 0 of each range, in ascending order. Of several borders that are as
    good, the one whose quantile, the share of all texts below it, is nearest to the middle of theirs.
    """
    below = np.concatenate([[0], np.cumsum(n)])
    right = np.concatenate([[0], np.cumsum(zeros)]) + np.concatenate([np.cumsum(ones[::-1])[::-1], [0]])
    best = np.flatnonzero(right == right.max())
    middle = (below[best[0]] + below[best[-1]]) / 2
    return int(best[np.argmin(np.abs(below[best] - middle))])


def quantile_cut(scored: DataFrame, labels: DataFrame, model: Ranking, name: str) -> float:
    """The plain score at the quantile of all of ``scored`` (doc_id, ``name``) that separates ``labels`` (doc_id, label) best.

    Every text and every label of a text in ``scored`` counts. Counts are added up before they are shuffled; only those of at most
    ``2 * FURTHEST`` ranges reach the driver. If not both labels occur, nothing tells a border: the sample's own cut holds.
    """
    place = F.floor((F.col(name) - F.lit(model.cut)) / F.lit(model.range))
    range_ = F.least(F.greatest(place, F.lit(-FURTHEST)), F.lit(FURTHEST - 1)).cast("int").alias("_range")
    texts = scored.groupBy(range_).agg(F.count(F.lit(1)).alias("_n"))
    known = scored.select(F.col("doc_id").cast("long").alias("doc_id"), range_).join(labels, "doc_id")
    marks = known.groupBy("_range").agg(F.sum("label").alias("_ones"), F.sum(1 - F.col("label")).alias("_zeros"))
    counts = texts.join(marks, "_range", "left").na.fill(0, ["_ones", "_zeros"]).orderBy("_range").toPandas()
    n, ones, zeros = (counts[c].to_numpy(np.int64) for c in ("_n", "_ones", "_zeros"))
    if not ones.sum() or not zeros.sum():
        return model.cut
    ranges, border = counts["_range"].to_numpy(np.float64), best_border(n, ones, zeros)
    if border in (0, len(ranges)):
        return float("inf" if border else "-inf")
    return float(model.cut + model.range * (ranges[border - 1] + 1 + ranges[border]) / 2)


def _score(plain: Column, cut: float) -> Column:
    """Between 0 and 1; ``ACCEPTED`` at the cut."""
    away = F.least(F.greatest(plain - F.lit(cut), F.lit(-30.0)), F.lit(30.0))
    return 1 / (1 + F.exp(-away) * F.lit((1 - ACCEPTED) / ACCEPTED))


def _scored(docs: DataFrame, model: Ranking | None, labels: DataFrame | None, name: str, kept: list[str]) -> DataFrame:
    """``kept`` and the score as ``name``. Texts are scored once: that is written before the cut is sought."""
    if model is None:
        return docs.select(*kept, F.lit(ACCEPTED).alias(name))
    plain, cut = _plain_scores(docs, model, name, kept), model.cut
    if labels is not None:
        plain = cut_lineage(plain)
        cut = quantile_cut(plain.select("doc_id", name), labels, model, name)
    return plain.withColumn(name, _score(F.col(name), cut))


def rank(docs: DataFrame, model: Ranking | None, labels: DataFrame | None = None) -> DataFrame:
    """Score every row of ``docs``: doc_id, score, which is ``ACCEPTED`` or more for accepted ones.

    The cut is the quantile of all scores that separates ``labels`` (doc_id, label; one row a document) best; without labels,
    the sample's own. Without a model every score is ``ACCEPTED``. Empty and null texts are scored from zero features, equal
    rows alike, rows with a null doc_id like any other.
    """
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(asked, model, labels, "score", ["doc_id"])


def keep_accepted(docs: DataFrame, model: Ranking | None, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`rank` accepts, all columns as they are. The quantile is that of the scores of ``docs``."""
    name = "_plain"
    while name in docs.columns:
        name += "_"
    return _scored(docs, model, labels, name, docs.columns).filter(F.col(name) >= ACCEPTED).drop(name)


def fitted(spark: SparkSession, docs: DataFrame, folder: str) -> Ranking | None:
    sample = cut_lineage(label_sample(given(spark, folder, "labels"), "quality", 4, 2, EXAMPLES))
    return fit(docs, sample)


def usable_labels(spark: SparkSession, folder: str) -> DataFrame:
    """All labels that may be learned from: doc_id, label."""
    return clear_labels(given(spark, folder, "labels"), "quality", 4, 2)


def op3_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    docs = given(spark, folder, "documents")
    return rank(docs, fitted(spark, docs, folder), usable_labels(spark, folder)).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= ACCEPTED, 1).otherwise(0).alias("predicted"),
    )
