"""The record lifecycle over its event log: states, queue, retries, sync; all derived, nothing updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: The legal transitions.
EDGES = {
    "CAPTURED": ["PENDING_AI", "SUSPECTED_DUPLICATE"],
    "PENDING_AI": ["AI_PROCESSED", "PROCESSING_FAILED"],
    "AI_PROCESSED": ["TO_REVIEW"],
    "TO_REVIEW": ["VALIDATED", "PENDING_AI", "MANUAL_REVIEW_REQUIRED"],
    "VALIDATED": ["PATIENT_LINKED"],
    "PATIENT_LINKED": ["SAVED"],
    "SAVED": ["SYNCED", "SYNC_FAILED"],
    "SYNCED": [],
    "PROCESSING_FAILED": ["PENDING_AI", "MANUAL_REVIEW_REQUIRED"],
    "SYNC_FAILED": ["SAVED", "MANUAL_REVIEW_REQUIRED"],
    "SUSPECTED_DUPLICATE": ["PENDING_AI", "MANUAL_REVIEW_REQUIRED"],
    "MANUAL_REVIEW_REQUIRED": ["TO_REVIEW", "PENDING_AI"],
}
MAX_ATTEMPTS = 3


def edge_dim(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, nexts in EDGES.items() for b in nexts], "old_state string, new_state string")


def transitions(log: DataFrame, record: str, state: str, *order: str) -> DataFrame:
    """The log with old_state, the record's state before each row."""
    return log.withColumn("old_state", F.lag(state).over(Window.partitionBy(record).orderBy(*order)))


def illegal(log: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of (old_state, new_state, ...) whose move is no edge."""
    return log.where("old_state IS NOT NULL").join(F.broadcast(edges), ["old_state", "new_state"], "left_anti")


def latest(log: DataFrame, record: str, state: str, *order: str) -> DataFrame:
    return log.groupBy(record).agg(F.max_by(state, F.struct(*order)).alias(state))


def duplicates(captures: DataFrame, content: str, order: str) -> DataFrame:
    """CAPTURED rows with their first state: the same content in any earlier row makes a suspected duplicate. The least
    order per digest is aggregated before the shuffle, so a hot content is one row per task."""
    hashed = captures.withColumn("sha256", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))
    first = hashed.groupBy("sha256").agg(F.min(order).alias("_first"))
    return hashed.join(first, "sha256").withColumn("state", F.when(F.col(order) == F.col("_first"), "PENDING_AI").otherwise("SUSPECTED_DUPLICATE")).drop("_first")


def counts_by_state(latest_states: DataFrame, state: str, dim: DataFrame) -> DataFrame:
    n = latest_states.groupBy(state).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(n, state, "left").select(state, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(o) for o in order)))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n")


def transition(state: str, new: str) -> str:
    """The new state, or ValueError; the caller's state is unchanged."""
    if new not in EDGES.get(state, []):
        raise ValueError(f"{state} -> {new} is not a legal transition")
    return new
