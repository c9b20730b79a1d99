"""Structured Streaming jobs over answer and event feeds.

Each job takes a streaming DataFrame. ``run_to_files`` drives one to completion over the files
present (availableNow); results go to files through the job's sink, never through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def json_feed(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def run_to_files(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available and read the result back.

    Append output goes to a parquet file sink. Complete output replaces a parquet folder per
    batch; update output adds one, with its batch number.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    elif mode == "complete":
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.foreachBatch(
            lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/run={n}")
        )
    query = writer.start()
    query.awaitTermination()
    reader = df.sparkSession.read
    return reader.schema(df.schema).parquet(out) if mode == "append" else reader.parquet(out)


def running_accuracy(answers: DataFrame) -> DataFrame:
    """Answered and correct counts per method (complete mode)."""
    return answers.groupBy("method").agg(
        F.count(F.lit(1)).alias("answered"), F.sum("correct").alias("correct"), F.round(F.avg("correct"), 6).alias("accuracy")
    )


def first_answers(answers: DataFrame, keys: list[str], horizon: str) -> DataFrame:
    """First write per key wins; later copies inside the horizon are dropped."""
    return answers.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


def rate(events: DataFrame, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Events per type and time window; windows are final once the watermark passes them."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def with_eta(windows: DataFrame, totals: DataFrame, seconds: int) -> DataFrame:
    """Finished windows of ``seconds`` with what is left of each type's total then, and the seconds it takes at this rate."""
    done = F.sum("n").over(Window.partitionBy("event_type").orderBy("start"))
    out = windows.join(totals, "event_type").withColumn("remaining", F.greatest(F.col("total") - done, F.lit(0)))
    return out.withColumn("eta", F.col("remaining") * seconds / F.col("n")).drop("total")


def work_sessions(events: DataFrame, delay: str, gap: str) -> DataFrame:
    """Runs of activity per worker, split at idle gaps."""
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


VOTE_OUT = "qid long, winner string, cast int, updated int"
VOTE_STATE = "letters array<string>, orders array<long>, updated int"
CLOSED_OUT = "qid long, winner string, cast int, latest long"
CLOSED_STATE = "letters array<string>, orders array<long>, latest long"


def _first_letters(votes: dict, pdf: pd.DataFrame) -> dict:
    """The votes with the first letter of each method that has none yet."""
    given = pdf[pdf["selected"].notna()].drop_duplicates("morder")
    return dict(zip(given["morder"].astype(int), given["selected"])) | votes


def _winner(votes: dict) -> str:
    """The letter of most methods; a tie goes to the latest method."""
    counts = pd.Series(votes).value_counts()
    tied = set(counts[counts == counts.max()].index)
    return votes[max(o for o, x in votes.items() if x in tied)]


def _vote(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    letters, orders, updated = state.get if state.exists else ([], [], 0)
    votes = dict(zip(orders, letters))
    for pdf in batches:
        votes = _first_letters(votes, pdf)
    updated += 1
    state.update((list(votes.values()), list(votes), updated))
    if len(votes) >= 2:
        yield pd.DataFrame({"qid": [key[0]], "winner": [_winner(votes)], "cast": [len(votes)], "updated": [updated]})


def incremental_votes(answers: DataFrame) -> DataFrame:
    """Vote per question, re-emitted as more methods answer (update mode). A tie goes to the latest method.

    State per question is one letter per method, so it is bounded by the number of methods; it is kept for
    good, so that an answer may come at any time. ``closing_votes`` lets go of questions that are done.
    """
    return answers.groupBy("qid").applyInPandasWithState(_vote, VOTE_OUT, VOTE_STATE, "update", GroupStateTimeout.NoTimeout)


def closing_votes(answers: DataFrame, delay: str, idle_ms: int) -> DataFrame:
    """One final vote per question, once it has been idle for ``idle_ms`` of event time (append mode).

    A question closes when the watermark (``delay`` behind the latest ``ts``) passes its latest answer by
    ``idle_ms``; its state is then removed, so only open questions hold any. ``winner`` is null where
    fewer than two methods gave a letter; ``latest`` is its latest answer in epoch milliseconds. Answers
    behind the watermark are dropped; one that comes after the close but ahead of the watermark opens
    the question anew.
    """

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        letters, orders, latest = state.get if state.exists else ([], [], None)
        votes = dict(zip(orders, letters))
        if state.hasTimedOut:
            state.remove()
            winner = _winner(votes) if len(votes) >= 2 else None
            yield pd.DataFrame({"qid": [key[0]], "winner": [winner], "cast": [len(votes)], "latest": [latest]})
            return
        for pdf in batches:
            votes = _first_letters(votes, pdf)
            latest = max(latest or 0, int(pdf["at"].max()))
        state.update((list(votes.values()), list(votes), latest))
        state.setTimeoutTimestamp(latest + idle_ms)

    timed = answers.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("qid").applyInPandasWithState(settle, CLOSED_OUT, CLOSED_STATE, "append", GroupStateTimeout.EventTimeTimeout)
