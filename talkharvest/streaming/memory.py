"""STR1 to STR8: messages as a stream: duplicate memory with expiry, month closing, late chunks, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import duplicates
from ..plans.cut import cut
from ..sources.tables import unique

WINDOW_US = 7 * 86_400_000_000


def queue(spark: SparkSession, path: str, schema) -> DataFrame:
    """STR1: a durable queue of Parquet files; read with ``trigger(availableNow=True)`` and a checkpoint."""
    return spark.readStream.schema(schema).parquet(path)


def mark_duplicates(messages: DataFrame, chained: bool = True, memory: str = "7 days") -> DataFrame:
    """STR2/STR4: message_id, duplicate. A fingerprint within 7 days of the last one (chained) or of the last original.

    State is one time per fingerprint and leaves by the event-time watermark, so memory follows the window, not history.
    Rows without fingerprint or time are never duplicates and must not be sent here.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["received_at", "message_id"], kind="stable")
        out = []
        for i, t in zip(rows.message_id, rows.received_at):
            us = int(pd.Timestamp(t).value // 1000)
            dup = last is not None and abs(us - last) <= WINDOW_US
            if chained or not dup:
                last = us
            out.append((i, dup))
        state.update((last,))
        # the timer may not lie before the watermark; without one yet it is 0
        state.setTimeoutTimestamp(max(last // 1000 + WINDOW_US // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["message_id", "duplicate"])

    timed = messages.withWatermark("received_at", memory)
    return timed.groupBy("fingerprint").applyInPandasWithState(step, "message_id string, duplicate boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def near_memory(stream: DataFrame, folder: str, checkpoint: str, days: int = 7) -> None:
    """STR3: message_id, duplicate of every message, decided by embedding against what came within the window before it.

    The memory is a Parquet folder by week that each batch of the stream extends; a batch reads only the weeks its window
    touches (all of them where a message has no time). A repeated batch overwrites its own files, so a restart changes nothing.
    stream: message_id, received_at, embedding.
    """
    span = F.lit(days * 86_400_000_000)

    def step(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        micros = F.unix_micros(F.col("received_at").cast("timestamp"))
        new = cut(unique(df, "message_id").select("message_id", F.lit(False).alias("old"), micros.alias("t"), F.lit(None).cast("string").alias("fp"), "embedding"))
        known = new.limit(0)
        try:
            past = spark.read.parquet(f"{folder}/memory").where(F.col("batch") != batch)
            r = new.agg(F.min("t"), F.max("t"), F.count_if(F.col("t").isNull())).first()
            if r[2] == 0 and r[0] is not None:
                weeks = [F.floor(F.lit(x) / span) for x in (r[0] - days * 86_400_000_000, r[1] + days * 86_400_000_000)]
                past = past.where(F.col("week").between(*weeks) | F.col("week").isNull())
            known = past.select("message_id", F.lit(True).alias("old"), "t", F.lit(None).cast("string").alias("fp"), "embedding")
        except AnalysisException:  # nothing is remembered yet
            pass
        near = duplicates.near(known.unionByName(new), days).withColumn("duplicate", F.lit(True))
        out = new.select("message_id").join(near, "message_id", "left").select("message_id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))
        out.write.mode("overwrite").parquet(f"{folder}/decisions/batch={batch}")
        kept = new.select("message_id", "t", "embedding", F.floor(F.col("t") / span).alias("week"))
        kept.write.mode("overwrite").partitionBy("week").parquet(f"{folder}/memory/batch={batch}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def close_months(chunks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """STR5/STR6: visit_month, side, chunk_ids of each closed month: once when the watermark has passed its end, and
    chunks that come after that as a side group of their own (they never join a closed one)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, ids = state.get if state.exists else (False, [])
        end = int((pd.Timestamp(key[0] + "-01", tz="UTC") + pd.offsets.MonthBegin(1)).value // 1_000_000)
        if state.hasTimedOut:
            if ids:
                yield pd.DataFrame([(key[0], "closed", sorted(ids))], columns=["visit_month", "side", "chunk_ids"])
            state.update((True, []))
            return
        new = [i for b in batches for i in b.chunk_id]
        if closed or state.getCurrentWatermarkMs() > end:
            yield pd.DataFrame([(key[0], "late", sorted(new))], columns=["visit_month", "side", "chunk_ids"])
            state.update((True, ids))
            return
        state.update((False, [*ids, *new]))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    timed = chunks.withWatermark("received_at", lateness)
    return timed.groupBy("visit_month").applyInPandasWithState(step, "visit_month string, side string, chunk_ids array<string>", "closed boolean, ids array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """STR7/STR9: process what is there, each batch into its own folder, so that a repeated batch overwrites itself."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_errors(rows: DataFrame, parsed: str) -> tuple[DataFrame, DataFrame]:
    """STR7: good rows, and the dead letters whose ``parsed`` column failed (is null)."""
    return rows.where(F.col(parsed).isNotNull()), rows.where(F.col(parsed).isNull())
