"""Evaluation of predictions against truth: one join, one pass of grouped metrics, calibration, priors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions.text import gap_matches, squash


def eval_rows(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth with its prediction by (page, key); a missing prediction is MISSING and all wrong."""
    return truth.join(predicted, ["page", "key"], "left").select(
        "page", "key", "kind", "page_type", "gt_status", F.coalesce("pred_status", F.lit("MISSING")).alias("pred_status"),
        F.coalesce(F.col("gt_status") == F.col("pred_status"), F.lit(False)).alias("status_ok"),
        F.coalesce((F.col("gt_value") == F.col("pred_value")) | (F.col("gt_value").isNull() & F.col("pred_value").isNull() & F.col("pred_status").isNotNull()), F.lit(False)).alias("value_ok"),
        F.coalesce("conf", F.lit(0.0)).alias("conf"),
    )


def metrics(rows: DataFrame) -> DataFrame:
    """The metric block overall, by kind and by page type, in one pass over grouping sets."""
    share = lambda hit, of: F.round(F.count_if(hit) / F.nullif(F.count_if(of), F.lit(0)), 4)
    written = F.col("gt_status") == "KNOWN"
    known = F.col("pred_status") == "KNOWN"
    wrong = known & ~(F.col("value_ok") & F.col("status_ok"))
    return rows.groupingSets([[], ["kind"], ["page_type"]], "kind", "page_type").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("fields"),
        share(F.col("value_ok") & F.col("status_ok"), F.lit(True)).alias("field_accuracy"),
        share(F.col("value_ok") & written, written).alias("value_accuracy"),
        share(F.col("status_ok"), F.lit(True)).alias("status_accuracy"),
        share(F.col("pred_status").isin("NEEDS_REVIEW", "ILLEGIBLE") & written, written).alias("review_rate"),
        share(wrong, known).alias("silent_rate"),
        F.count_if(wrong).alias("silent"),
    )


def calibration(rows: DataFrame) -> DataFrame:
    """(bin, n, accuracy) over written text and cell fields, ten bins of confidence."""
    bin_ = F.least(F.lit(9), F.floor(F.col("conf") * 10).cast("int"))
    return rows.where("gt_status = 'KNOWN' AND kind IN ('text', 'cell')").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("value_ok").cast("double")), 3).alias("accuracy"))


def number_priors(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def value_correct(g: dict[str, Column], p: dict[str, Column]) -> Column:
    """Whether a predicted value is the truth's. g: kind, dtype, status, raw, value, glyph_missing, parsed; p: value, n,
    display, raw. Boxes and choices by value; nothing written is right; a truth with missing glyphs by pattern; typed values
    by their parse, numbers within a millionth; all others by any of value, display and raw, squashed."""
    texts = [p[c] for c in ("value", "display", "raw")]
    none = F.lit(False)
    any_ = lambda hit: reduce(lambda a, b: a | b, [F.coalesce(hit(t), none) for t in texts])
    gp = g["parsed"]
    typed = F.when(gp["n"].isNotNull() | p["n"].isNotNull(), F.abs(gp["n"] - p["n"]) < 1e-6).otherwise(gp["value"] == p["value"])
    return (
        F.when(g["kind"].isin("check", "radio"), p["value"].eqNullSafe(g["value"]))
        .when((F.coalesce(g["raw"], F.lit("")) == "") | (g["status"] != "KNOWN"), True)
        .when(F.coalesce(g["glyph_missing"], none), any_(lambda t: gap_matches(g["raw"], t)))
        .when(gp["ok"] & p["value"].isNotNull() & ~g["dtype"].isin("str", "code"), F.coalesce(typed, none))
        .otherwise(any_(lambda t: squash(g["raw"]) == squash(t)))
    )


def status_correct(truth: Column, predicted: Column, glyph_missing: Column) -> Column:
    """Equal statuses; a dash whose glyph the image lacks may count as not provided."""
    return (truth == predicted) | (F.coalesce(glyph_missing, F.lit(False)) & (truth == "NOT_APPLICABLE") & (predicted == "NOT_PROVIDED"))


def real_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(photo, key, good, status) of transcribed fields. truth: photo, key, value, accept, alt, status, span, parsed (the
    PARSED of value); predicted: photo, key, value, n, display, raw, status.

    A span is met by review or by the word itself; a status alone by the status; a value by the field or the first of its
    alternative keys that matches, also in status where one is given."""
    none = F.lit(False)
    sq = lambda x: F.regexp_replace(squash(x), r"[()]", "")
    own = predicted.select("photo", "key", *(F.col(c).alias(f"own_{c}") for c in ("value", "display", "status")))
    keys = F.concat(F.array("key"), F.coalesce("alt", F.array().cast("array<string>")))
    got = predicted.select("photo", F.col("key").alias("k"), "value", F.col("n").alias("got_n"), "display", "raw", F.col("status").alias("got_status"))
    wanted = truth.withColumnsRenamed({"value": "want"}).select("*", F.posexplode(keys).alias("nth", "k")).join(got, ["photo", "k"], "left")
    texts = [F.col(c) for c in ("value", "display", "raw")]
    like = lambda want: reduce(lambda a, b: a | b, [F.coalesce(sq(want) == sq(t), none) for t in texts])
    gp = F.col("parsed")
    by_number = F.abs(gp["n"] - F.col("got_n")) < 1e-6
    by_value = F.when(gp["ok"] & gp["value"].isNotNull(), F.when(gp["n"].isNotNull() | F.col("got_n").isNotNull(), by_number).otherwise(sq(gp["value"]) == sq(F.col("value")))).otherwise(like(F.col("want")))
    accepted = F.exists("accept", lambda a: like(a))
    meets = F.coalesce(F.when(F.col("accept").isNotNull(), accepted).when(F.col("want").isNotNull(), by_value), none)
    meets = meets & F.col("got_status").isNotNull() & (F.col("status").isNull() | (F.col("status") == F.col("got_status")))
    first = wanted.where(meets).groupBy("photo", "key").agg(F.min_by("got_status", "nth").alias("met"))
    rows = truth.join(own, ["photo", "key"], "left").join(first, ["photo", "key"], "left")
    status, there = F.coalesce("own_status", F.lit("missing")), F.col("own_status")
    span_ok = there.isin("NEEDS_REVIEW", "ILLEGIBLE") | ((there == "KNOWN") & (sq(F.coalesce(F.nullif("own_value", F.lit("")), "own_display", F.lit(""))) == sq(F.col("span"))))
    good = F.when(F.col("span").isNotNull(), span_ok).when(F.col("met").isNotNull(), True).otherwise(F.col("status") == there)
    return rows.select("photo", "key", F.coalesce(good, none).alias("good"), F.when(F.col("span").isNull(), F.coalesce("met", status)).otherwise(status).alias("status"))


def text_truth(raw: Column) -> Column:
    """struct(status, raw, glyph_missing) of a transcribed text: nothing, a dash (also one whose glyph is missing), or
    something written."""
    from casebook.functions.text import DASHES, MISSING_GLYPH

    gap = F.contains(raw, F.lit(MISSING_GLYPH))
    none, dash = F.coalesce(raw, F.lit("")) == "", (F.replace(raw, F.lit(MISSING_GLYPH), F.lit("")).rlike(DASHES)) | F.replace(raw, F.lit(MISSING_GLYPH), F.lit("")).isin("")
    status = F.when(none, "NOT_PROVIDED").when(dash, "NOT_APPLICABLE").otherwise("KNOWN")
    return F.struct(status.alias("status"), F.when(status == "NOT_APPLICABLE", "—").when(~none, raw).alias("raw"), F.coalesce(gap, F.lit(False)).alias("glyph_missing"))


def truth_counts(rows: DataFrame) -> DataFrame:
    """(page_type, status, n) of a truth."""
    return rows.groupBy("page_type", "status").agg(F.count("*").alias("n"))


#: Patients of each split, and the order in which reports list kinds of field.
SPLITS = {"dev": (1, 7), "test": (8, 10), "all": (1, 10)}
REPORT_ORDER = ["text", "cell", "check", "radio"]


def in_split(patient: Column, split: str) -> Column:
    return patient.between(*SPLITS[split])


def reported(rows: DataFrame, column: str = "kind", order: list[str] = REPORT_ORDER) -> DataFrame:
    """``rows`` in the order of a report: by their place in ``order``, the others behind."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int")).orderBy("place", column)


def alternative_match(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(photo, key, hit): a truth is met where the value under its key, or the first of its alternative keys that is
    there, is its value or among those it accepts."""
    keys = F.concat(F.array("key"), F.coalesce("alt", F.array().cast("array<string>")))
    asked = truth.select("photo", "key", "value", "accept", F.posexplode(keys).alias("nth", "k"))
    got = asked.join(predicted.select("photo", F.col("key").alias("k"), F.col("value").alias("got")), ["photo", "k"], "left").where("got IS NOT NULL")
    first = got.groupBy("photo", "key").agg(F.min_by("got", "nth").alias("got"))
    hit = (F.col("got") == F.col("value")) | F.exists(F.coalesce("accept", F.array().cast("array<string>")), lambda a: a == F.col("got"))
    return truth.join(first, ["photo", "key"], "left").select("photo", "key", F.coalesce(hit, F.lit(False)).alias("hit"))


def choice_truth(options: DataFrame, *keys: str) -> DataFrame:
    """(keys, status, value): the truth of a choice from its options (option, ticked): none, one, or several to review."""
    ticked = F.array_sort(F.collect_list(F.when(F.col("ticked"), F.col("option"))))
    chosen = options.groupBy(*keys).agg(ticked.alias("_t"))
    status = F.when(F.size("_t") == 0, "NOT_PROVIDED").when(F.size("_t") == 1, "KNOWN").otherwise("NEEDS_REVIEW")
    return chosen.select(*keys, status.alias("status"), F.array_join(F.col("_t").cast("array<string>"), ",").alias("value"))


def photo_totals(rows: DataFrame) -> DataFrame:
    """(photo, fields, correct, silent, review) of real photos: a silent error is a known value that is wrong."""
    known, wrong = F.col("pred_status") == "KNOWN", ~F.col("value_ok")
    return rows.groupBy("photo").agg(
        F.count("*").alias("fields"), F.count_if(F.col("value_ok")).alias("correct"),
        F.count_if(known & wrong).alias("silent"), F.count_if(F.col("pred_status").isin("NEEDS_REVIEW", "ILLEGIBLE")).alias("review"),
    )


def page_accuracy(pages: DataFrame) -> DataFrame:
    """(pages, accuracy, seconds): the share of pages whose type was told, and the mean time of a page."""
    told = (F.col("expected") == F.col("got")).cast("double")
    return pages.agg(F.count("*").alias("pages"), F.round(F.avg(told), 4).alias("accuracy"), F.round(F.avg("seconds"), 2).alias("seconds"))
