"""Repeated takes: utterances of a recording that say nearly the same as an earlier one.

Two utterances are alike when both have three words or more, their lengths differ by at most half, and their sets of
lower-cased words have a Jaccard similarity of 0.7 or more. An utterance, taken in order, marks the first later one like
it that no other has marked yet, and only that one.

A take repeated n times makes n² alike pairs but at most n marks, so pairs are not listed. No recording's marks depend on
another's. A recording of ``WALKED`` utterances or fewer, days of speech, is walked in order by one task, which finds the
next unmarked utterance with a shared telling word without passing the marked ones. A longer one is settled by rounds over
all tasks: each utterance looks along the utterances it shares a telling word with, nearest first and a little further
each round, only until its mark is settled; a mark contested by several goes to the earliest of them and the others look on.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeline_lake.functions.numbers import round_half_away
from timeline_lake.operators.blocks import BLOCK_ROWS, block_of, row_numbers
from timeline_lake.plans.transcripts import KEYS, utterances
from timeline_lake.session import cut_lineage

# Fixed values.
SIMILARITY = 0.7
LENGTH_RATIO = 0.5
LEAST_WORDS = 3
FIRST_REACH = 16
#: Utterances of a recording that one task walks.
WALKED = 200_000
MARK = "project_slug string, source_slug string, i bigint, j bigint, similarity double"
SHOWN_MARK = MARK + ", start double, end double, text string, _of_start double, _of_end double, _of_text string"


def _items(spoken: DataFrame, *more: str) -> DataFrame:
    """Utterances long enough to compare: keys, i (index of the first word), n_words, tokens, n_telling (how many of them are telling).

    Alike sets must share one of their first |S| - ceil(0.7 |S|) + 1 tokens in any fixed order; long words first makes
    those tokens rare ones.
    """
    words = F.array_distinct(F.transform("words", lambda w: F.lower(w)))
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda s: s["w"])
    # Tokens are read several times; in a list of one, which is taken apart, they are made once.
    items = _compared(spoken).select(*KEYS, F.col("first_index").alias("i"), "n_words", F.explode(F.array(ordered)).alias("tokens"), *more)
    size = F.size("tokens")
    # 0.7 |S| as a whole-number ceiling, free of rounding error.
    return items.withColumn("n_telling", (size - F.ceil(size * 7 / 10) + 1).cast("int"))


def _compared(spoken: DataFrame) -> DataFrame:
    return spoken.filter(F.col("n_words") >= LEAST_WORDS)


def _look_further(askers: DataFrame, lists: DataFrame, items: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """Alike pairs among the next ``reach`` entries of the askers' lists, and how far each asker has now seen.

    ``askers``: keys, i, seen. Returns (keys, i, j, similarity) and (keys, i, seen, upto); ``upto`` is null when all of an
    asker's lists are exhausted, else every alike utterance up to that index is known.
    """
    asked = askers.join(lists, [*KEYS, "i"])
    steps = F.sequence(F.col("seen") + 1, F.col("seen") + reach)
    wanted = asked.select(*KEYS, "i", "token", "seen", F.explode(steps).alias("_step"), "rank").withColumn("rank", F.col("rank") + F.col("_step"))
    there = lists.select(*KEYS, "token", "rank", F.col("i").alias("j"))
    met = cut_lineage(wanted.join(there, [*KEYS, "token", "rank"], "left"))
    last = F.col("_step") == F.col("seen") + reach
    seen = met.groupBy(*KEYS, "i").agg((F.max("seen") + reach).alias("seen"), F.min(F.when(last, F.col("j"))).alias("upto"))
    pairs = met.filter(F.col("j").isNotNull()).select(*KEYS, "i", "j").distinct()
    a = items.select(*KEYS, "i", F.col("tokens").alias("_a"), F.col("n_words").alias("_na"))
    b = items.select(*KEYS, F.col("i").alias("j"), F.col("tokens").alias("_b"), F.col("n_words").alias("_nb"))
    both = pairs.join(a, [*KEYS, "i"]).join(b, [*KEYS, "j"])
    share = F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))
    alike = both.filter(F.least("_na", "_nb") / F.greatest("_na", "_nb") >= LENGTH_RATIO).withColumn("similarity", share)
    return alike.filter(F.col("similarity") >= SIMILARITY).select(*KEYS, "i", "j", "similarity"), seen


def _in_order(recording: pd.DataFrame) -> pd.DataFrame:
    ordered = recording.sort_values("i")
    return ordered.assign(telling=[t[:n].tolist() for t, n in zip(ordered["tokens"], ordered["n_telling"])])


def _marks(
    spoken: DataFrame, exclusive: bool, reach: int = FIRST_REACH, rows: int = BLOCK_ROWS, walked: int = WALKED, short: bool = False,
    in_order: bool = False,
) -> DataFrame:
    """(keys, i, j, similarity): the utterance each one marks. ``exclusive``: an utterance can be marked only once.

    ``short``: no recording is known to have more than ``walked`` utterances, so ``spoken`` is read once only. ``in_order``: and they
    lie in order, recording by recording.
    """
    items = _items(spoken)

    def walk(recording: pd.DataFrame) -> pd.DataFrame:
        return _walked(_in_order(recording), exclusive)

    if short and in_order:
        return items.mapInArrow(lambda batches: _marked_in_order(batches, exclusive), MARK)
    if short:
        return items.groupBy(*KEYS).applyInPandas(walk, MARK)
    long = cut_lineage(_compared(spoken).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > walked).select(F.struct(*KEYS).alias("_key")))
    keyed = items.withColumn("_key", F.struct(*KEYS))
    few = keyed.join(long, "_key", "left_anti").drop("_key").groupBy(*KEYS).applyInPandas(walk, MARK)
    if long.isEmpty():
        return few
    return few.unionByName(_marks_in_rounds(cut_lineage(keyed.join(long, "_key", "left_semi").drop("_key")), exclusive, reach, rows))


class _Alive:
    """The utterances of one telling word in order; those that are marked are passed over, many at once."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.then: list[int] = []

    def append(self, row: int) -> None:
        self.rows.append(row)
        self.then.append(len(self.then))

    def at(self, place: int) -> int:
        """The first place at or after ``place`` that is not marked; the number of places if there is none."""
        then, end = self.then, place
        while end < len(then) and then[end] != end:
            end = then[end]
        while place < end:
            then[place], place = end, then[place]
        return end


def _walked(recording: pd.DataFrame, exclusive: bool) -> pd.DataFrame:
    """Marks of one recording, its utterances taken in order."""
    index = recording["i"].tolist()
    found = _walk([frozenset(t) for t in recording["tokens"]], recording["telling"].tolist(), recording["n_words"].tolist(), exclusive)
    marks = pd.DataFrame([(index[a], index[b], similarity) for a, b, similarity in found], columns=["i", "j", "similarity"])
    return marks.assign(project_slug=recording["project_slug"].iloc[0], source_slug=recording["source_slug"].iloc[0])[[c.split()[0] for c in MARK.split(", ")]]


def _walk(sets: list[frozenset], telling: list[list[str]], sizes: list[int], exclusive: bool) -> list[tuple[int, int, float]]:
    """(row, the row it marks, similarity) of the utterances of one recording, taken in order."""
    lists: dict[str, _Alive] = defaultdict(_Alive)
    places = []
    for row, words in enumerate(telling):
        places.append([(lists[w], len(lists[w].rows)) for w in words])
        for w in words:
            lists[w].append(row)
    out = []
    for row, mine in enumerate(places):
        nearest = [(listed.rows[p], n, p) for n, (listed, place) in enumerate(mine) if (p := listed.at(place + 1)) < len(listed.rows)]
        heapq.heapify(nearest)
        seen = -1
        while nearest:
            other, n, place = heapq.heappop(nearest)
            listed = mine[n][0]
            if (p := listed.at(place + 1)) < len(listed.rows):
                heapq.heappush(nearest, (listed.rows[p], n, p))
            if other == seen:
                continue
            seen = other
            a, b = sizes[row], sizes[other]
            if min(a, b) / max(a, b) < LENGTH_RATIO:
                continue
            shared = len(sets[row] & sets[other])
            similarity = shared / (len(sets[row]) + len(sets[other]) - shared)
            if similarity >= SIMILARITY:
                out.append((row, other, similarity))
                if exclusive:
                    for taken, at in places[other]:
                        taken.then[at] = at + 1
                break
    return out


def _openings(batch: pa.RecordBatch) -> np.ndarray:
    """Rows at which the next recording begins; the first is left out."""
    same = np.ones(max(batch.num_rows - 1, 0), bool)
    for key in KEYS:
        a, b = batch.column(key)[:-1], batch.column(key)[1:]
        alike = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.and_(a.is_null(), b.is_null()), pc.equal(a, b))
        same &= alike.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(~same) + 1


def _recordings(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Utterances that lie recording by recording, in batches of whole recordings, and the rows these begin at."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        # What is kept back ends with the recording that may go on, so it is looked at no further than its last row.
        joint = batch if not rest else pa.concat_batches([rest[-1].slice(rest[-1].num_rows - 1), batch])
        opens = _openings(joint)
        if len(opens) and batch.num_rows:
            cut = opens[-1] - (1 if rest else 0)
            whole = pa.concat_batches([*rest, batch.slice(0, cut)])
            yield whole, np.append(0, _openings(whole))
            rest = []
            batch = batch.slice(cut)
        if batch.num_rows:
            rest.append(batch)
    if rest:
        whole = pa.concat_batches(rest)
        yield whole, np.append(0, _openings(whole))


def _shared(batch: pa.RecordBatch, starts: np.ndarray) -> np.ndarray:
    """Rows with a telling word that another row of the recording has as well: no other can mark or be marked."""
    tokens = batch.column("tokens")
    size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    tells = place < batch.column("n_telling").to_numpy(zero_copy_only=False)[row]
    row = row[tells]
    words = tokens.flatten().filter(pa.array(tells)).dictionary_encode()
    recording = np.searchsorted(starts, row, side="right").astype(np.int64)
    named = recording * (len(words.dictionary) + 1) + words.indices.fill_null(len(words.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(named, kind="stable")
    again = named[order][1:] == named[order][:-1]
    return np.unique(row[order][np.append(again, False) | np.append(False, again)])


def _marked_in_order(batches: Iterable[pa.RecordBatch], exclusive: bool, shown: bool = False) -> Iterator[pa.RecordBatch]:
    """Marks of utterances that lie in order, recording by recording; with both utterances as they are if ``shown``."""
    for batch, starts in _recordings(batches):
        rows = _shared(batch, starts)
        some = pa.array(rows)
        tokens = batch.column("tokens").take(some).to_pylist()
        telling = [t[:n] for t, n in zip(tokens, batch.column("n_telling").take(some).to_pylist())]
        sizes = batch.column("n_words").take(some).to_pylist()
        of = np.searchsorted(starts, rows, side="right")
        bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(rows)]
        marks = [
            (since + a, since + b, similarity)
            for since, until in zip(bounds, bounds[1:])
            for a, b, similarity in _walk([frozenset(t) for t in tokens[since:until]], telling[since:until], sizes[since:until], exclusive)
        ]
        if not marks:
            continue
        one, other = (pa.array(rows[[m[k] for m in marks]]) for k in (0, 1))
        more = {f"{name}{c}": batch.column(c).take(at) for name, at in (("", other), ("_of_", one)) for c in ("start", "end", "text")} if shown else {}
        yield pa.RecordBatch.from_pydict(
            {**{k: batch.column(k).take(one) for k in KEYS}, "i": batch.column("i").take(one), "j": batch.column("i").take(other), "similarity": pa.array([m[2] for m in marks]), **more}
        )


def _marks_in_rounds(items: DataFrame, exclusive: bool, reach: int, rows: int) -> DataFrame:
    """``_marks`` of recordings too long for one task."""
    listed = items.select(*KEYS, "i", F.explode(F.slice("tokens", F.lit(1), F.col("n_telling"))).alias("token"))
    lists = cut_lineage(row_numbers(listed, [*KEYS, "token"], ["i"], block_of("i", rows), "rank"))
    key = [*KEYS, "i"]
    # lost: the last utterance lost to an earlier one; upto: alike utterances up to here are known (null: all are).
    state = items.select(*key, F.lit(-1).cast("long").alias("lost"), F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("upto"))
    edges = marked = None
    while True:
        if edges is None:
            chosen, free = None, state
        else:
            free = state.join(marked, key, "left_anti")
            known = free.join(edges, key).filter((F.col("j") > F.col("lost")) & (F.col("upto").isNull() | (F.col("j") <= F.col("upto"))))
            chosen = cut_lineage(known.groupBy(*key).agg(F.min("j").alias("j"), F.min_by("similarity", "j").alias("similarity")))
            free = free.join(chosen, key, "left_anti")
        seeking = cut_lineage(free.filter(F.col("upto").isNotNull()))
        found_none = chosen is None or chosen.isEmpty()
        if found_none and seeking.isEmpty():
            return marked
        if not found_none:
            claims = marked.unionByName(chosen)
            if exclusive:
                winners = claims.groupBy(*KEYS, "j").agg(F.min("i").alias("i"), F.min_by("similarity", "i").alias("similarity"))
                kept = cut_lineage(winners.select(*key, "j", "similarity"))
                losers = claims.join(kept, [*key, "j"], "left_anti").select(*key, F.col("j").alias("_lost"))
                state = state.join(losers, key, "left").withColumn("lost", F.coalesce("_lost", "lost")).drop("_lost")
                marked = kept
            else:
                marked = cut_lineage(claims)
        more, seen = _look_further(seeking.select(*key, "seen"), lists, items, reach)
        state = state.join(seen.select(*key, F.col("seen").alias("_seen"), F.col("upto").alias("_upto")), key, "left")
        state = cut_lineage(
            state.withColumn("upto", F.when(F.col("_seen").isNull(), F.col("upto")).otherwise(F.col("_upto")))
            .withColumn("seen", F.coalesce("_seen", "seen")).drop("_seen", "_upto")
        )
        if edges is None:
            edges = cut_lineage(more)
            marked = edges.filter(F.lit(False))
        else:
            # Pairs met again through another shared word are the same pair.
            edges = cut_lineage(edges.unionByName(more).dropDuplicates([*key, "j"]))
        reach *= 2


def _sure_to_be_short(longest: int | None, walked: int) -> bool:
    """Whether no recording of ``longest`` words or fewer has more than ``walked`` utterances that are compared."""
    return longest is not None and longest <= walked * LEAST_WORDS


def nearest_alike(
    words: DataFrame, rows: int = BLOCK_ROWS, reach: int = FIRST_REACH, walked: int = WALKED, longest: int | None = None
) -> DataFrame:
    """For every utterance the next one like it: keys, i, j (indexes of their first words), similarity.

    ``longest``: no recording has more words than that. If that is few enough, each is walked where its words lie.
    """
    spoken = utterances(words, rows, longest).select(*KEYS, "first_index", "n_words", "words")
    if _sure_to_be_short(longest, walked):
        return _marks(spoken, exclusive=False, short=True, in_order=longest <= rows)
    return _marks(cut_lineage(spoken), exclusive=False, rows=rows, reach=reach, walked=walked)


def retake_flags(
    words: DataFrame, rows: int = BLOCK_ROWS, reach: int = FIRST_REACH, walked: int = WALKED, longest: int | None = None
) -> DataFrame:
    """Utterances marked as retakes, with the one that marked them. ``longest`` as in :func:`nearest_alike`."""
    shown = [round_half_away("start", 1).alias("start"), round_half_away("end", 1).alias("end"), "text"]
    percent = F.floor(F.col("similarity") * 100).cast("long")
    reason = F.concat(F.lit("near-duplicate of earlier utterance ("), percent, F.lit("% match) — possible retake"))
    if _sure_to_be_short(longest, walked):
        # The walk returns the two utterances of each mark, so nothing is sent again to find them.
        items = _items(utterances(words, rows, longest), "start", "end", "text").filter(" and ".join(f"{k} is not null" for k in KEYS))
        if longest <= rows:
            found = items.mapInArrow(lambda batches: _marked_in_order(batches, exclusive=True, shown=True), SHOWN_MARK)
        else:
            found = items.groupBy(*KEYS).applyInPandas(_walk_shown, SHOWN_MARK)
        duplicate_of = F.struct(*[F.col(f"_of_{c}").alias(c) for c in ("start", "end", "text")])
        found = found.withColumns({c: round_half_away(c, 1) for c in ("start", "end", "_of_start", "_of_end")})
        return found.select(*KEYS, "i", "j", "text", "start", "end", reason.alias("reason"), duplicate_of.alias("duplicate_of"))
    spoken = cut_lineage(utterances(words, rows))
    marks = _marks(spoken, exclusive=True, rows=rows, reach=reach, walked=walked)
    later = spoken.select(*KEYS, F.col("first_index").alias("j"), *shown)
    earlier = spoken.select(*KEYS, F.col("first_index").alias("i"), F.struct(*shown).alias("duplicate_of"))
    return marks.join(later, [*KEYS, "j"]).join(earlier, [*KEYS, "i"]).select(
        *KEYS, "i", "j", "text", "start", "end", reason.alias("reason"), "duplicate_of"
    )


def _walk_shown(recording: pd.DataFrame) -> pd.DataFrame:
    """Marks of one recording with both utterances as they are."""
    marks = _walked(_in_order(recording), exclusive=True)
    said = recording.set_index("i")[["start", "end", "text"]]
    later, earlier = said.loc[marks["j"]], said.loc[marks["i"]].add_prefix("_of_")
    return pd.concat([marks.reset_index(drop=True), later.reset_index(drop=True), earlier.reset_index(drop=True)], axis=1)
