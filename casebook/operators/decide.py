"""Status and confidence of a field from its reading: one CASE per kind, constants in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Thresholds of the decision algebra.
KNOWN_SCAN, KNOWN_PHOTO, SHARP_CUT, ILLEGIBLE = 0.80, 0.88, 900, 0.35
TICKED, TICK_BAND, REVIEW_BELOW = 0.07, 0.12, 0.65
BOOKLET_TICK, BOOKLET_BAND, BOOKLET_KNOWN = 0.12, 0.16, 0.75
FALLBACK_MOST, LEAST_FIT, PAGE_FLOOR = 0.75, -12.0, 0.2


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def known_threshold(sharpness: Column) -> Column:
    return F.when(sharpness >= SHARP_CUT, KNOWN_SCAN).otherwise(KNOWN_PHOTO)


def page_confidence(align: Column, quality_ok: Column) -> Column:
    return (0.7 + 0.3 * align) * F.when(quality_ok, 1.0).otherwise(0.9)


def _decision(status: str, confidence: Column, issues=None) -> Column:
    listed = F.array().cast("array<string>") if issues is None else F.array(F.lit(issues)) if isinstance(issues, str) else issues
    return F.struct(F.lit(status).alias("status"), clip(confidence).alias("confidence"), listed.alias("issues"))


def text_decision(r: dict[str, Column], compat: bool = False) -> Column:
    """struct(status, confidence, issues) of a text reading; r: ink, fraction, dash, text, ocr, page, threshold, dtype, and
    parsed, the PARSED of the text. A not-done mark is not applicable; with ``compat`` it goes on like a value, as the
    system studied has it."""
    p, ocr, page = r["parsed"], r["ocr"], r["page"]
    few = r["dtype"].isin("yesno", "posneg", "sex") & (p["snapped"] == 1.0)
    conf = F.when(few, (0.5 + 0.5 * ocr) * page).otherwise(ocr * page)
    conf = conf * F.when(p["snapped"] < 1, 0.6 + 0.4 * p["snapped"]).otherwise(1.0)
    is_dash = F.coalesce(r["dash"], F.lit(False)) | F.coalesce(p["marker"] == "dash", F.lit(False))
    out = F.when(~r["ink"], _decision("NOT_PROVIDED", F.when(r["fraction"] == 0, 0.97).otherwise(0.6) * page)).when(is_dash, _decision("NOT_APPLICABLE", 0.9 * page))
    if not compat:
        out = out.when(p["marker"] == "not_done", _decision("NOT_APPLICABLE", 0.9 * page))
    return (
        out.when(p["marker"] == "unknown", _decision("UNKNOWN", ocr * page))
        .when(r["text"].isNull() | (r["text"] == "") | (ocr < ILLEGIBLE), _decision("ILLEGIBLE", 0.3 * page, "handwriting could not be read"))
        .when(~p["ok"], _decision("NEEDS_REVIEW", 0.5 * ocr * page, p["issues"]))
        .when(F.size(p["issues"]) > 0, _decision("NEEDS_REVIEW", F.least(conf, F.lit(0.5)), p["issues"]))
        .when(conf < r["threshold"], _decision("NEEDS_REVIEW", conf, "low reading confidence"))
        .otherwise(_decision("KNOWN", conf))
    )


def fallback_reading(parsed: Column, decoded: Column, decoded_parsed: Column, fit: Column, confidence: Column, text: Column, score: Column) -> Column:
    """struct(text, score, issue): a free reading that does not parse cleanly gives way to the decoded plausible value where
    the ink fits it and it parses; that one is never sure."""
    poor = (text != "") & ~(parsed["ok"] & (F.size(parsed["issues"]) == 0))
    use = poor & decoded.isNotNull() & kept_opinion(fit) & decoded_parsed["ok"]
    return F.when(F.coalesce(use, F.lit(False)), F.struct(decoded.alias("text"), F.least(confidence, F.lit(FALLBACK_MOST)).alias("score"), F.lit("read as the closest plausible value: please confirm").alias("issue"))).otherwise(
        F.struct(text.alias("text"), score.alias("score"), F.lit(None).cast("string").alias("issue"))
    )


def kept_opinion(fit: Column, booklet: bool = False) -> Column:
    """Whether the ink fits a decoded value: from LEAST_FIT on; in booklets only above it."""
    return fit > LEAST_FIT if booklet else fit >= LEAST_FIT


def booklet_text_decision(r: dict[str, Column]) -> Column:
    """struct(status, confidence, issues, from_span) of a booklet's text field. r: kind; inked (null: no crop), fraction,
    dash; small, medium (raw readings, null: none), small_clean, medium_clean, line (the page's own reading, cleaned);
    span (a reading across rows, null: none), span_score; parsed, conf, agreement of the chosen reading (null parsed: none
    chosen); threshold."""
    from casebook.functions.text import separators_only

    yes = F.lit(True)
    line = F.coalesce(r["line"], F.lit(""))
    blank_line = separators_only(line)
    any_read = r["small"].isNotNull() | r["medium"].isNotNull()
    inked = F.coalesce(r["inked"], F.lit(False))
    only = (r["kind"] == "text") & blank_line & ((any_read & separators_only(r["small"]) & separators_only(r["medium"])) | (inked & separators_only(r["small_clean"]) & separators_only(r["medium_clean"])))
    spanned = r["span"].isNotNull()
    across = _decision("NEEDS_REVIEW", F.least(F.lit(0.6), r["span_score"]), "written across several rows: confirm it applies to this row").withField("from_span", yes)
    own = lambda *a: _decision(*a).withField("from_span", ~yes)
    p, conf = r["parsed"], r["conf"]
    why = F.when(r["agreement"] == 0, "the two OCR readings disagree").otherwise("low reading confidence")
    return (
        F.when(only, own("NOT_PROVIDED", F.lit(0.6)))
        .when(~inked & (line == "") & spanned, across).when(~inked & (line == ""), own("NOT_PROVIDED", F.when(r["inked"].isNotNull() & (r["fraction"] == 0), 0.9).otherwise(0.7)))
        .when(F.coalesce(r["dash"], F.lit(False)), own("NOT_APPLICABLE", F.lit(0.85)))
        .when(p.isNull() & spanned, across).when(p.isNull(), own("ILLEGIBLE", F.lit(0.25), "handwriting could not be read"))
        .when(p["marker"] == "dash", own("NOT_APPLICABLE", F.lit(0.85))).when(p["marker"] == "not_done", own("NOT_APPLICABLE", F.least(F.lit(0.9), conf))).when(p["marker"] == "unknown", own("UNKNOWN", conf))
        .when(~p["ok"], own("NEEDS_REVIEW", F.least(conf, F.lit(0.45)), F.when(F.size(p["issues"]) > 0, p["issues"]).otherwise(F.array(F.lit("could not interpret the handwriting")))))
        .when(F.size(p["issues"]) > 0, own("NEEDS_REVIEW", F.least(conf, F.lit(0.5)), p["issues"]))
        .when(conf < r["threshold"], own("NEEDS_REVIEW", conf, F.array(why))).otherwise(own("KNOWN", conf))
    )


def span_results(spans: DataFrame) -> DataFrame:
    """(page, key, status, confidence, text) of every row that a span (page, keys, text, score) crosses: always to review."""
    return spans.select("page", F.explode("keys").alias("key"), F.lit("NEEDS_REVIEW").alias("status"), F.least(F.lit(0.6), F.col("score")).alias("confidence"), "text")


def booklet_radio_decision(options: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, status, confidence, issue) of groups of options (keys, option, score; a null score: no box found)."""
    ticked, missing = F.col("score") >= BOOKLET_TICK, F.col("score").isNull()
    names = lambda hit: F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("option").cast("string")))), ", ")
    agg = options.groupBy(*keys).agg(F.count_if(ticked).alias("n"), F.count("score").alias("seen"), F.max_by("option", F.when(ticked, F.struct("score", "option"))).alias("best"), names(ticked).alias("names"), names(missing).alias("gone"))
    n, seen, gone = F.col("n"), F.col("seen"), F.col("gone") != ""
    lost = F.concat(F.lit("boxes not found: "), "gone")
    status = F.when((n > 1) | gone | (seen == 0), "NEEDS_REVIEW").when(n == 1, "KNOWN").otherwise("NOT_PROVIDED")
    conf = F.when(seen == 0, 0.3).when(n > 1, 0.5).when(n == 1, F.when(gone, 0.6).otherwise(0.9)).otherwise(F.when(gone, 0.5).otherwise(0.85))
    issue = F.when(seen == 0, "checkboxes not found on the photo").when(n > 1, F.concat(F.lit("several boxes ticked: "), "names")).when(gone, lost)
    return agg.select(*keys, F.when(n > 0, F.col("best")).alias("value"), status.alias("status"), conf.alias("confidence"), issue.alias("issue"))


#: Where each option of a circled line is printed, in heights of its print after the line's label.
CIRCLE_OFFSETS = {"A": 0.45, "B": 1.2, "O": 2.1, "AB": 3.5, "negative": 5.8, "positive": 9.3}
CIRCLE_REACH = 0.6


def ring_option(text: Column, offset: Column) -> Column:
    """The option inside a hand-drawn ring: a sign or letters as read, else the nearest printed option within reach."""
    from casebook.functions.text import fold

    t = F.replace(fold(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))
    sign = t.rlike(r"[+\-]|rh|sus")
    core = F.replace(F.regexp_replace(t, r"[^a-z0]", ""), F.lit("0"), F.lit("o"))
    letters = F.when(core.isin("a", "b", "o", "ab"), F.upper(core))
    places = F.array(*[F.struct(F.abs(F.lit(at) - offset).alias("far"), F.lit(name).alias("name")) for name, at in CIRCLE_OFFSETS.items()])
    near = F.array_min(places)
    by_place = F.when(near["far"] < CIRCLE_REACH, near["name"])
    read = F.when(sign, F.when(F.contains(t, F.lit("-")), "negative").when(F.contains(t, F.lit("+")), "positive")).otherwise(letters)
    return F.coalesce(read, by_place)


def circled_decision(rings: DataFrame, fields: DataFrame) -> DataFrame:
    """(page, key, value, status, confidence) of circled choices. rings: page, key, text, offset; fields: page, key,
    options. Always to review but where no ring was drawn."""
    hits = rings.withColumn("hit", ring_option(F.col("text"), F.col("offset"))).groupBy("page", "key").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    rows = fields.join(hits, ["page", "key"], "left").withColumn("chosen", F.array_sort(F.array_intersect("hits", "options")))
    n = F.size("chosen")
    status = F.when(F.col("hits").isNull(), "NOT_PROVIDED").otherwise("NEEDS_REVIEW")
    conf = F.when(F.col("hits").isNull() | (n == 0), 0.5).when(n > 1, 0.4).otherwise(0.75)
    return rows.select("page", "key", F.get("chosen", F.lit(0)).alias("value"), status.alias("status"), conf.alias("confidence"))


def check_decision(score: Column, page: Column) -> Column:
    """struct(value, status, confidence) of a box."""
    conf = clip(0.5 + F.abs(score - TICKED) / TICK_BAND) * page
    return F.struct((score >= TICKED).alias("value"), F.when(conf < REVIEW_BELOW, "NEEDS_REVIEW").otherwise("KNOWN").alias("status"), conf.alias("confidence"))


def booklet_check_decision(score: Column) -> Column:
    conf = clip(0.5 + F.abs(score - BOOKLET_TICK) / BOOKLET_BAND)
    return (
        F.when(score.isNull(), F.struct(F.lit(None).cast("boolean").alias("value"), F.lit("NEEDS_REVIEW").alias("status"), F.lit(0.3).alias("confidence")))
        .otherwise(F.struct((score >= BOOKLET_TICK).alias("value"), F.when(conf >= BOOKLET_KNOWN, "KNOWN").otherwise("NEEDS_REVIEW").alias("status"), conf.alias("confidence")))
    )


def radio_decision(options: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of options (keys, option, score, page): the ticked option and its status."""
    conf = clip(0.5 + F.abs(F.col("score") - TICKED) / TICK_BAND) * F.col("page")
    agg = options.withColumn("_c", conf).groupBy(*keys).agg(
        F.count_if(F.col("score") >= TICKED).alias("n"), F.max_by("option", F.struct("score", "option")).alias("best"), F.min("_c").alias("least")
    )
    return agg.select(
        *keys,
        F.when(F.col("n") > 0, F.col("best")).alias("value"),
        F.when(F.col("n") == 0, "NOT_PROVIDED").when((F.col("n") > 1) | (F.col("least") < REVIEW_BELOW), "NEEDS_REVIEW").otherwise("KNOWN").alias("status"),
        F.when(F.col("n") > 1, F.least("least", F.lit(0.5))).otherwise(F.col("least")).alias("confidence"),
    )


def review_queue(fields: DataFrame) -> DataFrame:
    """Rank of each field to review on its page: least confidence first, then catalog order, then key."""
    rank = F.row_number().over(Window.partitionBy("page").orderBy("confidence", "ord", "key"))
    return fields.where(F.col("status").isin("NEEDS_REVIEW", "ILLEGIBLE")).withColumn("rank", rank)


def status_summary(fields: DataFrame) -> DataFrame:
    return fields.groupBy("page", "status").agg(F.count("*").alias("n"))


def choose_reading(readings: DataFrame) -> DataFrame:
    """(crop, source, value, agreement, confidence): the best of several recognisers' readings of a crop.

    ``readings``: crop, source (unique in a crop), origin, text, value, marker, ok, issues, plausible, snapped, score.
    Readings of one origin come from the same recogniser output, so their agreement counts for nothing. Two readings agree
    by text, or where both parsed by an equal mark, or by value where neither has one. More agreement wins, then a clean parse, plausibility, an exact word, the score; the least
    source, then the greatest value, breaks ties. Readings without text take no part. A crop has as many rows as there are recognisers.
    """
    seen = readings.where("text <> ''")
    other = seen.select("crop", *(F.col(c).alias(f"_{c}") for c in ("origin", "text", "value", "marker", "ok", "score")))
    by_text = F.col("text") == F.col("_text")
    by_value = F.col("_ok") & (F.col("value") == F.col("_value"))
    meant = F.col("ok") & F.col("_ok") & F.col("marker").eqNullSafe(F.col("_marker")) & (F.col("marker").isNotNull() | (F.col("value") == F.col("_value")))
    agrees = (F.col("origin") != F.col("_origin")) & (by_text | F.coalesce(meant, F.lit(False)))
    own = ["crop", "source", "value", "marker", "ok", "issues", "plausible", "snapped", "score"]
    judged = seen.join(other, "crop").groupBy(*own).agg(
        F.count_if(F.coalesce(agrees, F.lit(False))).alias("agreement"),
        F.max(F.when(by_text | by_value, F.col("_score"))).alias("base"),
    )
    order = F.struct("agreement", (F.col("ok") & (F.col("issues") == 0)).alias("clean"), "plausible", "snapped", "score", (-F.col("source")).alias("first"), "value")
    best = judged.groupBy("crop").agg(F.max_by(F.struct(*judged.columns[1:]), order).alias("b")).select("crop", "b.*")
    conf = F.when(F.col("agreement") > 0, 0.55 + 0.45 * F.col("base")).otherwise(0.75 * F.col("score"))
    return best.select("crop", "source", "value", "agreement", (conf * F.when(F.col("snapped") < 1, 0.6 + 0.4 * F.col("snapped")).otherwise(1.0)).alias("confidence"))
