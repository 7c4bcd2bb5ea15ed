"""Plausibility rules over a page's scalars and its visits; each yields (page, key, issue, cap, ord) flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.functions.lexicon import VOCABULARIES
from casebook.plans.rules_union import flags_union

CAP = 0.6
LINKING_CAP = 0.79
FACILITIES = VOCABULARIES["facility"]
OUTSIDE = "date outside this pregnancy (last period → due date)"


def _flags(rows: DataFrame, keys: list[str], issue: str, order: int, cap: float = CAP) -> DataFrame:
    return rows.select("page", F.explode(F.array(*map(F.lit, keys))).alias("key")).select("page", "key", F.lit(issue).alias("issue"), F.lit(cap).alias("cap"), F.lit(order).alias("ord"))


def linking(fields: DataFrame) -> DataFrame:
    """A field that links records is always looked at."""
    return fields.where("linking").select("page", "key", F.lit("patient code: confirm before linking the visit").alias("issue"), F.lit(LINKING_CAP).alias("cap"), F.lit(1).alias("ord"))


def facility_type(pages: DataFrame) -> DataFrame:
    """(page, name_prefix, type, type_status): the name's prefix against the ticked type, which must be KNOWN."""
    return _flags(pages.where("type_status = 'KNOWN' AND name_prefix IS NOT NULL AND name_prefix <> type").where(F.col("name_prefix").isin(FACILITIES)), ["facility_name", "facility_type"], "facility name and ticked facility type disagree", 2)


def due_date(pages: DataFrame) -> DataFrame:
    return _flags(pages.where(F.abs(F.datediff("edd", "lmp") - 280) > 3), ["lmp_date", "expected_delivery_date"], "due date should be last period + 280 days", 3)


def post_term(pages: DataFrame) -> DataFrame:
    return _flags(pages.where(F.abs(F.datediff("post_term", "edd") - 7) > 2), ["expected_delivery_date", "term_exceeded_date"], "post-term date should be due date + 7 days", 4)


def parity(pages: DataFrame) -> DataFrame:
    return _flags(pages.where("parity > gravidity"), ["gravidity", "parity"], "parity cannot exceed gravidity", 8)


def living(pages: DataFrame) -> DataFrame:
    return _flags(pages.where("living > parity + 2"), ["parity", "living_children"], "more living children than deliveries", 9)


def term_weight(pages: DataFrame) -> DataFrame:
    return _flags(pages.where("ga_birth >= 37 AND weight < 1500"), ["birth_weight_g"], "very low weight for a term birth", 10)


def _visit_rows(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Visits (page, ord, seen, ga, appointment) with their page's dates and the last visit before that has one."""
    seen_before = F.last("seen", True).over(Window.partitionBy("page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.col("lmp"), F.date_sub("edd", 294))
    end = F.date_add(F.coalesce(F.col("edd"), F.date_add("lmp", 280)), 30)
    return visits.withColumn("before", seen_before).join(pages.select("page", "lmp", "edd"), "page", "left").withColumns({"start": start, "end": end})


def visit_checks(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, ord, seen) of each visit with: outside the pregnancy (start excluded, end included), weeks that do not fit the
    date, and a date before the last one seen."""
    joined = _visit_rows(visits, pages)
    return joined.select(
        "page", "ord", "seen",
        F.coalesce(~((F.col("seen") > F.col("start")) & (F.col("seen") <= F.col("end"))), F.lit(False)).alias("outside"),
        F.coalesce(F.abs(F.datediff("seen", "lmp") / 7 - F.col("ga")) > 2.5, F.lit(False)).alias("weeks_differ"),
        F.coalesce(F.col("seen") < F.col("before"), F.lit(False)).alias("goes_back"),
    )


def visit_flags(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Flags of visits (page, ord, visit, seen, ga, appointment): dates outside the pregnancy, weeks against dates, and order,
    by the key of the cell concerned. One pass over the visits."""
    joined = _visit_rows(visits, pages)
    out = lambda d: ~((F.col(d) > F.col("start")) & (F.col(d) <= F.col("end")))
    weeks = F.datediff("seen", "lmp") / 7
    flag = lambda hit, cell, issue, order: F.when(hit, F.struct(F.lit(cell).alias("cell"), (issue if isinstance(issue, Column) else F.lit(issue)).alias("issue"), F.lit(order).alias("ord")))
    found = F.array_compact(F.array(
        flag(out("appointment"), "appointment_date", OUTSIDE, 5), flag(out("seen"), "attended_date", OUTSIDE, 5),
        flag(F.abs(weeks - F.col("ga")) > 2.5, "gestational_age_weeks", F.format_string("does not match visit date (%.0f SA expected)", weeks), 6),
        flag(F.col("seen") < F.col("before"), "attended_date", "earlier than the previous visit", 7),
    ))
    rows = joined.select("page", "visit", F.explode(found).alias("f"))
    return rows.select("page", F.concat_ws(".", F.lit("visits"), "visit", "f.cell").alias("key"), "f.issue", F.lit(CAP).alias("cap"), "f.ord")


def all_flags(fields: DataFrame, pages: DataFrame, visits: DataFrame) -> DataFrame:
    """The flags of all ten rules."""
    page_rules = [facility_type, due_date, post_term, parity, living, term_weight]
    return flags_union([linking(fields), *(rule(pages) for rule in page_rules), visit_flags(visits, pages)])
