"""Words as a stream, grouped into utterances as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timeline_lake.streaming.runs import STATE_STORE

KEYS = ["project_slug", "source_slug"]
GAP_MICROS = 400_000  # fixed value: silence that ends an utterance
PART_WORDS = 256
PART = "project_slug string, source_slug string, first_index bigint, part bigint, n_words bigint, from_us bigint, until_us bigint, text string, finished boolean"
_WORD = "struct<start:bigint,until:bigint,word_index:bigint,word:string>"


class UtteranceKeeper(StatefulProcessor):
    """Gives out an utterance in parts of ``part_words`` words, the last one when a silence has ended it.

    State of a recording: the words that the watermark has not passed yet, and the words of the open utterance that have not
    been given out. That is what is said within the watermark's delay plus ``part_words`` words, however long somebody
    speaks without a pause.
    """

    def __init__(self, part_words: int = PART_WORDS):
        self.part_words = part_words

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"words array<{_WORD}>")
        self.open = handle.getValueState("open", "first_index bigint, part bigint, since bigint, until bigint, words array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [w for p in rows for w in zip(p["from_us"].tolist(), p["until_us"].tolist(), p["word_index"].tolist(), p["word"].tolist())]
        yield from self._settle(key, arrived, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _settle(self, key, arrived: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        """Take all words before the watermark in order; later ones may still be overtaken."""
        waiting = [tuple(w) for w in self.waiting.get()[0]] if self.waiting.exists() else []
        waiting = sorted(waiting + arrived, key=lambda w: (w[0], w[2]))
        open_ = list(self.open.get()) if self.open.exists() else None
        out: list[tuple] = []

        def give(finished: bool) -> None:
            first, part, since, until, words = open_
            out.append((*key, first, part, len(words), since, until, " ".join(words), finished))

        ready = sum(w[0] < passed for w in waiting)
        for start, until, index, word in waiting[:ready]:
            if open_ and start - open_[3] >= GAP_MICROS:
                give(True)
                open_ = None
            if not open_:
                open_ = [index, 0, start, until, [word]]
            else:
                if len(open_[4]) >= self.part_words:
                    give(False)
                    open_ = [open_[0], open_[1] + 1, start, until, []]
                open_[3], open_[4] = until, [*open_[4], word]
        if open_ and passed - open_[3] >= GAP_MICROS:
            # Whatever comes now starts after the watermark.
            give(True)
            open_ = None
        rest = waiting[ready:]
        self._keep(self.waiting, (rest,) if rest else None)
        self._keep(self.open, tuple(open_) if open_ else None)
        if rest or open_:
            # Once the watermark is past this, there is something to do.
            self.handle.registerTimer((rest[0][0] if rest else open_[3] + GAP_MICROS) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["project_slug", "source_slug", "first_index", "part", "n_words", "from_us", "until_us", "text", "finished"])

    @staticmethod
    def _keep(state, value) -> None:
        if value is None:
            state.clear()
        else:
            state.update(value)

    def close(self) -> None:
        pass


def utterance_parts(words: DataFrame, delay: str = "10 seconds", part_words: int = PART_WORDS) -> DataFrame:
    """`words` with event times ``spoken_from`` and ``spoken_until``; parts of utterances come out as the watermark passes them.

    Columns: keys, first_index (names the utterance), part (0, 1, …), n_words, from_us, until_us, text, finished (the last
    part). Words later than ``delay`` are dropped. Joined by (keys, first_index) in order of part this equals the batch form.
    """
    words.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = words.withWatermark("spoken_from", delay).select(
        *KEYS, "word_index", "word", "spoken_from", F.unix_micros("spoken_from").alias("from_us"), F.unix_micros("spoken_until").alias("until_us")
    )
    return timed.groupBy(*KEYS).transformWithStateInPandas(UtteranceKeeper(part_words), PART, "append", "eventTime")


def joined_parts(parts: DataFrame) -> DataFrame:
    """Whole utterances from the written parts of finished ones."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), " ")
    return (
        parts.groupBy(*KEYS, "first_index")
        .agg(F.sum("n_words").alias("n_words"), F.min("from_us").alias("from_us"), F.max_by("until_us", "part").alias("until_us"), text.alias("text"), F.max("finished").alias("_finished"))
        .filter("_finished").drop("_finished")
    )
