"""The record lifecycle as a fold over control events: attempts, retries, review, linking and sync by one table of moves.

An event names what happened (a photo was captured, the extractor failed, a reviewer confirmed). MOVES says from which
state an event is accepted, which states follow, what becomes of the attempts, and whether it leaves an error. An event
that MOVES does not list for the record's state is refused and changes nothing. The batch fold and the stream share it.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.operators.lifecycle import EDGES, MAX_ATTEMPTS
from casebook.operators.match import code_candidates, normal_code

KEEP, BUMP, RESET = 0, 1, -1
#: (event, state before): states that follow, attempts, error. No state before: the record does not exist yet.
MOVES = {
    ("captured", ""): (["CAPTURED", "PENDING_AI"], KEEP, False),
    ("captured_duplicate", ""): (["CAPTURED", "SUSPECTED_DUPLICATE"], KEEP, False),
    ("processed", "PENDING_AI"): (["AI_PROCESSED", "TO_REVIEW"], KEEP, False),
    ("processed_unknown", "PENDING_AI"): (["AI_PROCESSED", "TO_REVIEW", "MANUAL_REVIEW_REQUIRED"], KEEP, False),
    ("waiting", "PENDING_AI"): ([], KEEP, False),
    ("unreadable", "PENDING_AI"): (["PROCESSING_FAILED"], KEEP, True),
    ("failed", "PENDING_AI"): ([], BUMP, True),
    ("manual", "PROCESSING_FAILED"): (["MANUAL_REVIEW_REQUIRED"], KEEP, False),
    ("manual", "MANUAL_REVIEW_REQUIRED"): ([], KEEP, False),
    ("answered", "TO_REVIEW"): ([], KEEP, False),
    ("answered", "MANUAL_REVIEW_REQUIRED"): (["TO_REVIEW"], KEEP, False),
    ("validated", "TO_REVIEW"): (["VALIDATED"], KEEP, False),
    ("linked", "VALIDATED"): (["PATIENT_LINKED", "SAVED"], KEEP, False),
    ("synced", "SAVED"): (["SYNCED"], KEEP, False),
    ("sync_waiting", "SAVED"): ([], KEEP, False),
    ("sync_failed", "SAVED"): (["SYNC_FAILED"], KEEP, True),
    ("sync_again", "SYNC_FAILED"): (["SAVED"], KEEP, False),
} | {("retried", s): (["PENDING_AI"], RESET, False) for s, nexts in EDGES.items() if "PENDING_AI" in nexts}
GAVE_UP = "PROCESSING_FAILED"
STEP = "state string, attempts int, error string, accepted boolean, moves array<string>"


def step(state: str | None, attempts: int, error: str | None, event: str) -> tuple[str | None, int, str | None, bool, list[str]]:
    """State, attempts and last error after an event, whether it was accepted, and the states it went through. The last
    allowed attempt fails the record; any move without an error clears the last one."""
    found = MOVES.get((event, state or ""))
    if found is None:
        return state, attempts, error, False, []
    nexts, count, wrong = found
    attempts = 0 if count == RESET else attempts + (count == BUMP)
    if count == BUMP and attempts >= MAX_ATTEMPTS:
        nexts = [GAVE_UP]
    if nexts:
        error = event if wrong else None
    return (nexts[-1] if nexts else state), attempts, error, True, nexts


def _table() -> Column:
    """MOVES as a literal map."""
    row = lambda m: F.struct(F.array(*map(F.lit, m[0])).cast("array<string>").alias("nexts"), F.lit(m[1]).alias("count"), F.lit(m[2]).alias("wrong"))
    return F.create_map(*[x for (event, state), m in MOVES.items() for x in (F.lit(f"{event}>{state}"), row(m))])


def fold(events: DataFrame) -> DataFrame:
    """(record, seq, event, old_state, state, attempts, error, accepted, moves) of every event (record, seq, event), taken by
    seq. A record's events are gathered in one row; a record has a few dozen."""
    gathered = events.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("log"))
    moves = _table()
    none = F.lit(None).cast("string")

    def one(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        found = F.try_element_at(moves, F.concat(e["event"], F.lit(">"), F.coalesce(last["state"], F.lit(""))))
        ok = found.isNotNull()
        attempts = F.when(~ok, last["attempts"]).when(found["count"] == RESET, 0).when(found["count"] == BUMP, last["attempts"] + 1).otherwise(last["attempts"])
        given_up = ok & (found["count"] == BUMP) & (attempts >= MAX_ATTEMPTS)
        nexts = F.when(~ok, F.array().cast("array<string>")).when(given_up, F.array(F.lit(GAVE_UP))).otherwise(found["nexts"])
        moved = F.size(nexts) > 0
        new = F.struct(
            e["seq"].alias("seq"), e["event"].alias("event"), last["state"].alias("old_state"), F.when(moved, F.element_at(nexts, -1)).otherwise(last["state"]).alias("state"), attempts.cast("int").alias("attempts"),
            F.when(moved, F.when(found["wrong"], e["event"])).otherwise(last["error"]).alias("error"), ok.alias("accepted"), nexts.alias("moves"),
        )
        return F.concat(acc, F.array(new))

    zero = F.struct(F.lit(None).cast(dict(events.dtypes)["seq"]).alias("seq"), none.alias("event"), none.alias("old_state"), none.alias("state"), F.lit(0).alias("attempts"), none.alias("error"), F.lit(False).alias("accepted"), F.array().cast("array<string>").alias("moves"))
    rows = gathered.select("record", F.aggregate("log", F.array(zero), one).alias("all"))
    return rows.select("record", F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("e")).select("record", "e.*")


def history(folded: DataFrame) -> DataFrame:
    """(record, seq, nth, old_state, new_state): every single move, also those that one event makes in a row."""
    rows = folded.select("record", "seq", "old_state", F.posexplode("moves").alias("nth", "new_state"), "moves")
    before = F.when(F.col("nth") == 0, F.col("old_state")).otherwise(F.element_at("moves", F.greatest(F.col("nth"), F.lit(1))))
    return rows.select("record", "seq", "nth", before.alias("old_state"), "new_state")


def current(folded: DataFrame) -> DataFrame:
    """(record, state, attempts, error) of every record that exists."""
    last = folded.groupBy("record").agg(F.max_by(F.struct("state", "attempts", "error"), "seq").alias("l"))
    return last.select("record", "l.*").where("state IS NOT NULL")


#: What an extractor's errors mean, the mode that needs the network, and the roles that may see photos.
UNREADABLE, CLOUD = "unreadable_image", "cloud"
IMAGE_ROLES = ["midwife", "admin"]


def outcome(code: Column, mode: str, online: Column, page_type: Column, needs_network: bool | None = None) -> Column:
    """The event of a queued record's turn: waiting without a network that the mode needs; else by the extractor's error
    code (null: it succeeded) and page type. A cloud that fails is waited for; an unreadable photo is never tried again."""
    gate = needs_network if needs_network is not None else mode == CLOUD
    blocked = ~online if gate else F.lit(False)
    unknown = F.coalesce(page_type, F.lit("unknown")) == "unknown"
    wrong = F.when(code == UNREADABLE, "unreadable").otherwise("waiting" if mode == CLOUD else "failed")
    return F.when(blocked | (code == "connection"), "waiting").when(code.isNotNull(), wrong).when(unknown, "processed_unknown").otherwise("processed")


def queue(records: DataFrame, states: list[str]) -> DataFrame:
    """Records in some states, oldest first, then by arrival: one distributed sort."""
    return records.where(F.col("state").isin(states)).orderBy("captured_at", "seq")


def placed(rows: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """``rows`` with place, their number in the order of all rows. ``bucket`` is a coarser value of the first column, so a
    task numbers one bucket's rows; only counts of buckets are summed in one place."""
    dealt = rows.withColumn("_bucket", bucket)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, "_bucket").withColumn("place", F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def link_outcomes(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """(record, code, outcome, candidates) of link requests (record, state, code, create): linked to a known code, created, or
    refused: not_validated, no_code, or unknown_code with the known codes one edit away. Only a request's own wish creates.
    Codes are compared only for requests that end as unknown_code; known codes are shuffled, for a broadcast of them would
    grow with the patients. Requests that are decided without a code go by their record, so blank codes gather nowhere."""
    asked = requests.withColumn("code", normal_code(F.col("code")))
    known = patients.select("code").distinct().hint("merge")
    looked_up = (F.coalesce("code", F.lit("")) != "") & ~F.coalesce(F.col("state") != "VALIDATED", F.lit(False))
    wanted = asked.where(looked_up & ~F.coalesce("create", F.lit(False)))
    near = code_candidates(wanted.select("code").distinct().join(known, "code", "left_anti"), patients).where("distance > 0")
    listed = near.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda c: c["candidate"]).alias("candidates"))
    found = known.withColumn("_known", F.lit(True)).unionByName(listed, allowMissingColumns=True)
    dealt = asked.withColumn("_key", F.when(looked_up, F.col("code")).otherwise(F.concat(F.lit(" "), F.xxhash64("record"))))
    rows = dealt.join(found.withColumnRenamed("code", "_key").hint("merge"), "_key", "left")
    result = (
        F.when(F.col("state") != "VALIDATED", "not_validated").when(F.coalesce("code", F.lit("")) == "", F.when(F.col("create"), "created").otherwise("no_code"))
        .when(F.col("_known"), "linked").when(F.col("create"), "created").otherwise("unknown_code")
    )
    some = F.when(result == "unknown_code", F.coalesce("candidates", F.array().cast("array<string>")))
    return rows.select("record", "code", result.alias("outcome"), some.alias("candidates"))


def unused_codes(patients: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` codes M-1000 to M-9999 that no patient has, in an order that the seed draws."""
    every = patients.sparkSession.range(1000, 10000).select(F.concat(F.lit("M-"), "id").alias("code"))
    return every.join(patients.select("code"), "code", "left_anti").orderBy(F.xxhash64("code", F.lit(seed)), "code").limit(n)


def images_for(photos: DataFrame, role: str) -> DataFrame:
    """Photos for a role that may see them; PermissionError for others."""
    if role not in IMAGE_ROLES:
        raise PermissionError(f"{role} may not see photos")
    return photos


def active_backend(configured: str, available: bool) -> str:
    """The extractor that runs: the configured one, or saved outputs where the local one's packages are missing."""
    return "fixture" if configured == "local" and not available else configured


def storage_key(variable: str, path: str) -> bytes:
    """The key of data at rest: an environment variable, else a file that only its owner reads, made on first use."""
    if value := os.environ.get(variable):
        return value.encode()
    try:
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    except FileExistsError:
        with open(path, "rb") as f:
            return f.read()
    with os.fdopen(fd, "wb") as f:
        f.write(key := os.urandom(16).hex().encode())
    return key
