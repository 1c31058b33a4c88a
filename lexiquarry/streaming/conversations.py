"""Conversations as a stream: what a follow-up needs of the turns before it is kept as state.

The state of a conversation is its last few turns; it goes when the conversation has been idle for a while. Each user turn comes out
with the turns that were held before it, so what follows needs no look at the past, and :func:`followed_up` gives a micro-batch to
the same operator that works on tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiquarry.functions import lexicon as L
from lexiquarry.operators import dialog
from lexiquarry.sources import store

TURN = ["turn", "role", "text", "language", "at"]
RECENT = "array<struct<turn:long,role:string,text:string,language:string,at:long>>"
OUT = "conv_id long, turn long, question string, recent string"


def _steps(n: int, idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).astype(object).where(lambda x: x.notna(), None).sort_values("turn", kind="stable")  # a conversation's turns of one micro-batch
        out = []
        for turn in rows[TURN].to_dict("records"):
            turn |= {k: int(turn[k]) for k in ("turn", "at") if turn[k] is not None}
            if idle_ms is not None:
                held = [t for t in held if turn["at"] - t["at"] <= idle_ms]
            if turn["role"] == "user":
                out.append((key[0], turn["turn"], turn["text"], json.dumps(held, ensure_ascii=False)))
            held = sorted([*held, turn], key=lambda t: t["turn"])[-n:]
        state.update((json.dumps(held, ensure_ascii=False),))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(max(t["at"] for t in held) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "question", "recent"])

    return run


def recent_turns(turns: DataFrame, n: int = L.HISTORY, idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``conv_id, turn, question, recent`` for each user turn of the stream ``turns (conv_id, turn, role, text[, language, at])``.

    ``recent`` holds the last ``n`` turns before it, oldest first. With ``idle`` (as "30 minutes"), turns have a time ``at``: those that are
    longer ago than that no longer count, and the state of a conversation goes once the watermark, ``late`` behind the newest
    turn, is past that time. Turns of a micro-batch are taken in order; one that comes later than a turn after it takes its
    place among the held ones, and what came out stays. Turns without a number, or without the time that ``idle`` needs, are left out.
    """
    plain = {"language": F.lit(None).cast("string"), "at": F.lit(None).cast("timestamp")}
    rows = turns.withColumns({c: x for c, x in plain.items() if c not in turns.columns}).where(F.col("turn").isNotNull())
    ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    if idle:
        rows = rows.where(F.col("at").isNotNull()).withWatermark("at", late)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "language", *(["at"] if idle else []), F.unix_millis("at").alias("ms"))
    run = _steps(n, ms)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return run(key, (b.drop(columns="at", errors="ignore").rename(columns={"ms": "at"}) for b in batches), state)

    kind = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    found = rows.groupBy("conv_id").applyInPandasWithState(step, OUT, "turns string", "append", kind)
    return found.withColumn("recent", F.from_json("recent", RECENT))


def contextualized(found: DataFrame, jurisdiction: str, translate: dialog.Translate | None = None) -> DataFrame:
    """``conv_id, turn, query, clarify`` of rows of :func:`recent_turns`, which are a table here."""
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = found.withColumn("question_id", key)
    history = rows.select("question_id", F.explode("recent").alias("t")).select("question_id", "t.turn", "t.role", "t.text", "t.language")
    told = dialog.contextualized(rows.select("question_id", "question", F.lit(jurisdiction).alias("jurisdiction")), history, translate)
    return rows.select("question_id", "conv_id", "turn").join(told, "question_id").select("conv_id", "turn", "query", "clarify")


def followed_up(turns: DataFrame, target: str, checkpoint: str, jurisdiction: str, translate: dialog.Translate | None = None, n: int = L.HISTORY, idle: str | None = None) -> StreamingQuery:
    """Commits the contextualised user turns of each micro-batch to ``target``, each batch once: one that is run again is known by its number."""

    def sink(batch: DataFrame, number: int) -> None:
        known = store.manifests(batch.sparkSession, target)
        if known is None or known.where(F.col("signature") == str(number)).isEmpty():
            store.commit(contextualized(batch, jurisdiction, translate), target, str(number), mode="append")

    stream = recent_turns(turns, n, idle)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
