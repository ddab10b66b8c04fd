"""Metered requests as a stream, decided one after the other with the time used so far as state of the user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timeline_lake.plans import telemetry
from timeline_lake.streaming.runs import STATE_STORE

DECISION = "uid string, request_id bigint, accepted boolean, minutes double, reason string"


class QuotaKeeper(StatefulProcessor):
    """Accepts a user's requests in order of (ts, request_id) while the time accepted so far stays within the limit.

    The state of a user is one number, the milliseconds accepted; a batch costs what its own requests cost, whatever came
    before. With ``forget_after_ms`` a user who has asked nothing for so long starts anew, and the state does not grow with
    users who never come back; without it time is never given back, as in the batch form.
    """

    def __init__(self, limit_ms: int, forget_after_ms: int | None = None):
        self.limit_ms, self.forget_after_ms = limit_ms, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "ms bigint", self.forget_after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch's requests of one user as plain arrays: they have to be in order.
        parts = [(p["ts"].to_numpy(), p["request_id"].to_numpy(), p["ms"].to_numpy(), p["minutes"].to_numpy()) for p in rows]
        ts, ids, ms, minutes = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, ts))
        spent = self.spent.get()[0] if self.spent.exists() else 0
        left = self.limit_ms - spent
        accepted = np.zeros(len(order), bool)
        for at, cost in zip(order.tolist(), ms[order].tolist()):
            if cost <= left:
                left -= cost
                accepted[at] = True
        self.spent.update((self.limit_ms - left,))
        reason = np.where(accepted, None, "quota_exceeded")
        yield pd.DataFrame({"uid": key[0], "request_id": ids, "accepted": accepted, "minutes": minutes, "reason": reason})

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, limit: float = telemetry.FREE_MINUTES, forget_after_ms: int | None = None) -> DataFrame:
    """Decide each metered request of a stream (see :func:`telemetry.quota_decisions`, which it equals).

    ``requests``: uid, tier, request_id, ts, duration_seconds; micro-batches must be in time order. Requests that need no
    state, those of paying users and those without a usable duration, are decided on the way and never shuffled. Keyed
    state needs the RocksDB state store (``STATE_STORE``), and a checkpoint to go on from.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = telemetry.metered(requests)
    stateful = F.col("ms").isNotNull() & (F.col("tier") == "free")
    unusable = F.col("ms").isNull()
    simple = timed.filter(~stateful).select(
        "uid", "request_id", (~unusable).alias("accepted"), "minutes", F.when(unusable, F.lit("missing_duration")).alias("reason")
    )
    keeper = QuotaKeeper(round(limit * 60_000), forget_after_ms)
    kept = timed.filter(stateful).select("uid", "request_id", "ts", "ms", "minutes").groupBy("uid").transformWithStateInPandas(keeper, DECISION, "append", "processingTime" if forget_after_ms else "none")
    return simple.unionByName(kept)
