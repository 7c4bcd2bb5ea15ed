"""Cross-field rules as one union of flags, folded back once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def flags_union(flags: list[DataFrame]) -> DataFrame:
    """All rules' (page, key, issue, cap, ord) rows."""
    return reduce(DataFrame.unionByName, flags)


def apply_flags(fields: DataFrame, flags: DataFrame) -> DataFrame:
    """(page, key, status, confidence, issues, ...) after the flags: only KNOWN and NEEDS_REVIEW fields are touched;
    issues are appended in rule order; confidence is capped."""
    folded = flags.groupBy("page", "key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "issue"))), lambda s: s["issue"]).alias("_new"), F.min("cap").alias("_cap")
    )
    hit = F.col("_new").isNotNull() & F.col("status").isin("KNOWN", "NEEDS_REVIEW")
    return fields.join(folded, ["page", "key"], "left").withColumns({
        "issues": F.when(hit, F.concat("issues", "_new")).otherwise(F.col("issues")),
        "confidence": F.when(hit, F.least("confidence", "_cap")).otherwise(F.col("confidence")),
        "status": F.when(hit, F.lit("NEEDS_REVIEW")).otherwise(F.col("status")),
    }).drop("_new", "_cap")
