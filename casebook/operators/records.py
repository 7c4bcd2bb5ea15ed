"""Catalog expansion and the views of records and patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def expand_table(rows: DataFrame, cols: DataFrame, table: str) -> DataFrame:
    """(key, dtype, next_key): a form table's fields, row by column; a column's dtype overrides the row's. Both sides
    are a form's definition."""
    grid = rows.crossJoin(F.broadcast(cols))
    key = F.concat_ws(".", F.lit(table), "col", "row")
    nxt = F.lead("col").over(Window.partitionBy("row").orderBy("col_ord"))
    return grid.select(key.alias("key"), F.coalesce("col_dtype", "row_dtype").alias("dtype"), F.concat_ws(".", F.lit(table), nxt, "row").alias("next_key"), nxt.isNull().alias("is_last")).withColumn("next_key", F.when(~F.col("is_last"), F.col("next_key"))).drop("is_last")


def without_pii(fields: DataFrame) -> DataFrame:
    return fields.where("NOT pii").drop("pii")


def ui_shape(fields: DataFrame) -> DataFrame:
    """(page, key, label, value, conf, status) as the review screen shows them."""
    return fields.select("page", "key", F.coalesce("label", "key").alias("label"), F.coalesce("display", F.lit("—")).alias("value"), F.round("confidence", 2).alias("conf"), "status")


def patient_view(patients: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """(code, visits, last_visit) of every patient."""
    seen = links.join(records, "record_id").groupBy("code").agg(F.count("*").alias("visits"), F.max("captured_at").alias("last_visit"))
    return patients.join(seen, "code", "left").select("code", F.coalesce("visits", F.lit(0)).cast("bigint").alias("visits"), "last_visit")


def patient_pages(links: DataFrame, records: DataFrame) -> DataFrame:
    """(code, pages): the sorted distinct page types of each patient."""
    return links.join(records, "record_id").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("page_type")), ",").alias("pages"))


def new_rows(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not there yet (an insert under a primary key)."""
    return incoming.join(existing.select(key), key, "left_anti")


def merge_maps(old: str, new: str):
    """Fields of two maps, the new one's where both have a key."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), F.col(new))


def filled(fields: DataFrame) -> DataFrame:
    """Fields that hold something to show."""
    return fields.where(~F.coalesce("display", F.lit("")).isin("", "☐") & (F.col("status") != "NOT_PROVIDED"))


def record_number(fields: DataFrame, key: str = "record_number") -> DataFrame:
    """(page, record_number): its value where its status lets it be read."""
    readable = (F.col("key") == key) & F.col("status").isin("KNOWN", "NEEDS_REVIEW")
    return fields.groupBy("page").agg(F.max(F.when(readable, F.col("value"))).alias("record_number"))


def repeated_keys(catalog: DataFrame, *keys: str) -> DataFrame:
    """Keys that a catalog defines more than once."""
    return catalog.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: The parts of a field that a reviewer sees.
VIEWED = ["key", "label_en", "label_fr", "kind", "dtype", "value", "display", "status", "confidence", "issues", "question_en", "question_fr", "corrected"]
REVIEWED = ["NEEDS_REVIEW", "ILLEGIBLE"]


def field_view(fields: DataFrame) -> DataFrame:
    """Fields as a reviewer sees them; parts that a table lacks are null."""
    own = set(fields.columns)
    parts = [F.col(c) if c in own else F.lit(None).cast("array<string>" if c == "issues" else "boolean" if c == "corrected" else "string").alias(c) for c in VIEWED]
    return fields.select("page", "ord", *parts)


def with_catalog(fields: DataFrame, catalog: DataFrame) -> DataFrame:
    """Fields with their definition by (page_type, key); a field that no catalog knows keeps nulls. A catalog is a form's: a
    few hundred rows, which Spark broadcasts by their size."""
    return fields.join(catalog, ["page_type", "key"], "left")


def with_patient(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records with the code of the patient they are linked to, null where they are not; one link a record."""
    return records.join(links.select("record_id", F.col("code").alias("patient_code")), "record_id", "left")


def record_view(records: DataFrame, fields: DataFrame, links: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per record: its own columns, patient_code, extracted, needs_review (fields to ask about, the least confident
    first, then by place), filled (fields that hold something), summary (status to count), and, where a history (record_id,
    seq, old_state, new_state) is given, all fields and the history in order. A record's fields are a page's."""
    seen = field_view(fields)
    one = F.struct(*VIEWED)
    ask = F.when(F.col("status").isin(REVIEWED), F.struct(F.col("confidence").alias("by"), "ord", one.alias("f")))
    shown = ~F.coalesce("display", F.lit("")).isin("", "☐") & (F.col("status") != "NOT_PROVIDED")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["f"])
    counts = fields.groupBy("page", "status").agg(F.count("*").alias("n")).groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("summary"))
    pages = seen.groupBy("page").agg(
        listed(ask).alias("needs_review"), listed(F.when(shown, F.struct("ord", one.alias("f")))).alias("filled"),
        *([listed(F.struct("ord", one.alias("f"))).alias("fields")] if history is not None else []),
    )
    page = pages.join(counts, "page").withColumnRenamed("page", "record_id")
    out = with_patient(records, links).join(page, "record_id", "left").withColumn("extracted", F.col("summary").isNotNull())
    if history is not None:
        log = history.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("seq", "old_state", "new_state"))).alias("history"))
        out = out.join(log, "record_id", "left")
    return out


def exists(rows: DataFrame, condition: Column) -> bool:
    """Whether any row meets a condition: the first hit ends the scan."""
    return bool(rows.where(condition).limit(1).count())


def known_codes(patients: DataFrame) -> DataFrame:
    """All codes, the oldest patient first."""
    return patients.orderBy("created_at", "code").select("code")


def links_of(links: DataFrame) -> DataFrame:
    """(code, record_id, linked_at, place): each patient's links in order of linking."""
    return links.select("code", "record_id", "linked_at", F.row_number().over(Window.partitionBy("code").orderBy("linked_at", "record_id")).alias("place"))


def patient_records(patients: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """(code, visits, last_visit, records) of every patient; records are struct(captured_at, record_id, state, page_type) in
    order."""
    row = F.struct("captured_at", "record_id", "state", "page_type")
    seen = links.join(records, "record_id").groupBy("code").agg(F.count("*").alias("visits"), F.max("captured_at").alias("last_visit"), F.array_sort(F.collect_list(row)).alias("records"))
    return patients.join(seen, "code", "left").select("code", F.coalesce("visits", F.lit(0)).cast("bigint").alias("visits"), "last_visit", "records")


def search_patients(codes: DataFrame, patients: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """(code, candidate, distance, place, visits, last_visit, pages): known patients within one edit of each code asked
    for, with their visits and the distinct pages on file."""
    from casebook.operators.match import code_candidates

    found = code_candidates(codes, patients)
    wanted = found.select(F.col("candidate").alias("code")).distinct()
    own = links.join(wanted, "code", "left_semi").join(records, "record_id")
    seen = own.groupBy("code").agg(F.count("*").alias("visits"), F.max("captured_at").alias("last_visit"), F.array_join(F.array_sort(F.collect_set("page_type")), ",").alias("pages"))
    rows = found.join(seen.withColumnRenamed("code", "candidate"), "candidate", "left")
    return rows.select("code", "candidate", "distance", "place", F.coalesce("visits", F.lit(0)).cast("bigint").alias("visits"), "last_visit", F.coalesce("pages", F.lit("")).alias("pages"))


def learning_set(crops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(crops, summary) of marked crops (key, label box l_x0..l_y1, found box f_x0..f_y1, and drawn box d_x0..d_y1): offsets of
    the drawn box from its label in label heights, its overlap with the found one; and their means by key."""
    from casebook.operators.geometry import iou

    high = F.col("l_y1") - F.col("l_y0")
    rows = crops.select("key", *[((F.col(f"d_{c}") - F.col(f"l_{c}")) / high).alias(f"rel_{c}") for c in ("x0", "y0", "x1", "y1")], iou("f", "d").alias("iou"))
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("rel_x0", "rel_y0", "rel_x1", "rel_y1", "iou")]
    return rows, rows.groupBy("key").agg(F.count("*").alias("n"), *means)
