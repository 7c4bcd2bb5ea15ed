"""The record lifecycle as a stream: keyed state decides each event and emits its outcome.

State per record is its state, attempts, last error and the number of its events; rows of one micro-batch are taken in
event-time order, then by seq, which is unique. Nothing is dropped for lateness: a late event is judged against the state
it meets, and one that is not accepted is emitted as refused. State grows with the number of records and is kept by the
state store. On a log that arrives in order the outcomes are those of ``operators.control.fold``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from casebook.operators.control import step

OUTCOMES = "record string, seq bigint, event string, old_state string, state string, attempts int, error string, accepted boolean"


def lifecycle(events: DataFrame) -> DataFrame:
    """OUTCOMES of a stream (record string, at timestamp, seq bigint, event string)."""

    def run(key, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state, attempts, error = store.get if store.exists else (None, 0, None)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
        out = []
        for seq, event in zip(rows["seq"], rows["event"]):
            before = state
            state, attempts, error, accepted, _ = step(state, attempts, error, event)
            out.append((key[0], seq, event, before, state, attempts, error, accepted))
        store.update((state, attempts, error))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    return events.groupBy("record").applyInPandasWithState(run, OUTCOMES, "state string, attempts int, error string", "append", "NoTimeout")


def first_seen(captures: DataFrame) -> DataFrame:
    """(sha256, record, state) of a stream of captures (record, at, content): the first of a content waits, later ones are
    suspected. Of one micro-batch the earliest capture is first, then the least record."""

    def run(key, batches, store):
        rows = pd.concat(list(batches)).sort_values(["at", "record"], kind="stable")
        state = ["SUSPECTED_DUPLICATE" if store.exists or i else "PENDING_AI" for i in range(len(rows))]
        store.update((True,))
        yield pd.DataFrame({"sha256": key[0], "record": rows["record"], "state": state})

    hashed = captures.withColumn("sha256", F.sha2(F.coalesce(F.col("content"), F.lit("")).cast("binary"), 256)).select("sha256", "record", "at")
    return hashed.groupBy("sha256").applyInPandasWithState(run, "sha256 string, record string, state string", "seen boolean", "append", "NoTimeout")


def sync(batch: DataFrame, send) -> DataFrame:
    """Saved records of a micro-batch with the event that came of them: ``send`` takes a pandas frame and returns, for each
    row, true (the server accepted), false (it refused) or None (it was not reached). Sending comes before the event, so a
    repeated task sends again: the server tells records apart by id."""

    def run(frames):
        for pdf in frames:
            events = ["sync_waiting" if x is None else "synced" if x else "sync_failed" for x in send(pdf)]
            yield pd.DataFrame({"record": pdf["record"], "event": events})

    return batch.mapInPandas(run, "record string, event string")


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Run a stream to the end of what there is, appending to a Parquet table; files of a batch are committed once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return query
