"""Matching: codes at one edit, lexicon snapping, label similarity, idf and page classification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.functions.lexicon import CUTOFF, similar
from casebook.plans.fuzzy_join import fuzzy_join

LABEL_LEAST, NEAR_LABEL, TITLE_LEAST = 4, 80.0, 85.0
#: Words of titles that tell two page types apart, and the suffixes of the types.
EARLY, LATE = ("precoce", "early"), ("tardif", "late")


def normal_code(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, r"\s+", ""))


def code_candidates(codes: DataFrame, known: DataFrame) -> DataFrame:
    """(code, candidate, distance, place): normalised codes (no white space, upper case) within one edit of known ones, the
    nearest first, then by candidate."""
    pairs = fuzzy_join(codes.select(normal_code(F.col("code")).alias("code")), known.select(normal_code(F.col("code")).alias("candidate")), "code", "candidate")
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("distance", "candidate")))


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, each part edited once."""
    last2: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, last2[j - 2] + 1)
            row.append(best)
        last2, last = last, row
    return last[-1]


def osa(a, b):
    """Full distance of two columns, for thresholds over one."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


def lexicon_snap(words: DataFrame, column: str, vocab: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """``words`` with snapped and ratio: the vocabulary's nearest value. The vocabulary is a parameter, a form's closed
    list."""
    found = words.withColumn("_near", similar(F.col(column), F.lit("own"), F.lit(cutoff), {"own": vocab}))
    return found.withColumns({"snapped": F.col("_near.word"), "ratio": F.col("_near.near")}).drop("_near")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one machine-word recurrence per character of ``b``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over the lengths' sum."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(label: str, line: str) -> float:
    """The best ``indel_ratio`` of the shorter text with a part of the longer one of at most its length."""
    a, b = sorted((label, line), key=len)
    if not a:
        return 100.0 if not b else 0.0
    inner = (b[i : i + len(a)] for i in range(len(b) - len(a) + 1))
    edges = (part for k in range(1, len(a)) for part in (b[:k], b[-k:]))
    return max(indel_ratio(a, part) for part in (*inner, *edges))


def line_similarity(label: str, line: str) -> float:
    """A label against a line that may go on after it (then a little less)."""
    whole = indel_ratio(line, label)
    return max(whole, 0.98 * indel_ratio(line[: len(label)], label)) if len(line) > len(label) + 2 else whole


def _over_pairs(score, a: Column, b: Column) -> Column:
    """``score`` of two text columns, once per distinct pair of a batch."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[k] if k in known else known.setdefault(k, score(*k)) for k in zip(a.fillna(""), b.fillna(""))], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def label_similarity(label: Column, line: Column) -> Column:
    return _over_pairs(line_similarity, label, line)


def label_in_line(label: Column, line: Column, least: float = 90.0) -> Column:
    """struct(score, at) of a label of four letters on within a longer line: its partial ratio less a share, and the place
    (from 0) where its first four letters stand; null below ``least`` or where they do not."""
    score = _over_pairs(partial_ratio, label, line)
    at = F.instr(line, F.substring(label, 1, 4)) - 1
    return F.when((F.char_length(label) >= 4) & (F.char_length(line) > F.char_length(label)) & (score >= least) & (at >= 0), F.struct((score * 0.85).alias("score"), at.alias("at")))


def best_lines(labels: list[str], lines: DataFrame) -> DataFrame:
    """(page, label, line, similarity): each label's most similar line of each page (page, line, text), the least line
    among equals. Labels are a parameter, a form's printed words; a row becomes as many as there are."""
    pairs = lines.where(F.char_length("text") > 0).withColumn("label", F.explode(F.array(*map(F.lit, dict.fromkeys(labels)))))
    scored = pairs.withColumn("similarity", label_similarity(F.col("label"), F.col("text")))
    best = scored.groupBy("page", "label").agg(F.max_by(F.struct("line", "similarity"), F.struct(F.col("similarity"), (-F.col("line")).alias("first"))).alias("b"))
    return best.select("page", "label", "b.line", "b.similarity")


def label_index(labels: DataFrame) -> DataFrame:
    """(page_type, label, copies, df, idf, unique) of labels (page_type, label) of four characters on: ln(1 + page types /
    page types with the label); unique where its own page type prints it once."""
    own = labels.groupBy("page_type", "label").agg(F.count("*").alias("copies"))
    n = labels.select("page_type").distinct().agg(F.count("*").alias("n"))
    df = own.groupBy("label").agg(F.count("*").alias("df"))
    rows = own.where(F.char_length("label") >= LABEL_LEAST).join(df, "label").join(F.broadcast(n), F.lit(True))
    return rows.select("page_type", "label", "copies", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"), (F.col("copies") == 1).alias("unique"))


def title_factor(words: DataFrame) -> DataFrame:
    """(page, early, late): whether a page's words (page, word) of five letters on name the early or the late kind."""
    long = words.where(F.char_length("word") >= 5)
    rows = long.withColumns({"e": _over_pairs(indel_ratio, F.lit(EARLY[0]), F.col("word")), "l": _over_pairs(indel_ratio, F.lit(LATE[0]), F.col("word"))})
    best = rows.groupBy("page").agg(F.max("e").alias("e"), F.max("l").alias("l"))
    return best.select("page", ((F.col("e") >= TITLE_LEAST) & (F.col("l") < TITLE_LEAST)).alias("early"), ((F.col("l") >= TITLE_LEAST) & (F.col("e") < TITLE_LEAST)).alias("late"))


def classify(labels: DataFrame, seen: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(page, page_type, score, margin, verdict) of every page of ``seen`` (page, label, similarity): the idf-weighted share
    of a type's labels that the page shows, the best type first, then by name. Below .15 the verdict is none, and of a page
    without any hit the type is null; a margin below .08 warns. ``titles`` (page, early, late) halves the types of the other
    kind."""
    index = label_index(labels)
    total = index.groupBy("page_type").agg(F.sum(F.col("idf") * F.col("copies")).alias("total"))
    best = seen.groupBy("page", "label").agg(F.max("similarity").alias("best"))
    hits = best.where(F.col("best") >= NEAR_LABEL).join(index, "label")
    got = hits.groupBy("page", "page_type").agg(F.sum(F.col("idf") * F.col("copies") * F.col("best") / 100).alias("got"))
    score = got.join(F.broadcast(total), "page_type").withColumn("score", F.round(F.col("got") / F.col("total"), 9))
    if titles is not None:
        kind = lambda k: F.contains(F.col("page_type"), F.lit(f"_{k}_"))
        half = (F.col("early") & kind(LATE[1])) | (F.col("late") & kind(EARLY[1]))
        score = score.join(titles, "page", "left").withColumn("score", F.when(half, F.col("score") * 0.5).otherwise(F.col("score")))
    two = score.groupBy("page").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "page_type"))), 1, 2).alias("top"))
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    every = best.select("page").distinct().join(two, "page", "left")
    rows = every.select("page", first["page_type"].alias("page_type"), F.coalesce(-first["s"], F.lit(0.0)).alias("score"), F.coalesce(-second["s"], F.lit(0.0)).alias("next"))
    margin = F.col("score") - F.col("next")
    return rows.select("page", "page_type", "score", margin.alias("margin"), F.when(F.col("score") < 0.15, "none").when(margin < 0.08, "close").otherwise("clear").alias("verdict"))


def type_confidence(score: Column, margin: Column) -> Column:
    """How sure a page type is."""
    return F.least(F.lit(1.0), score / 0.6) * F.least(F.lit(1.0), 0.5 + margin * 5)


def alignment_confidence(inliers: Column, error: Column) -> Column:
    """How sure a page's geometry is, from its fit's inliers and median error in points."""
    return F.least(F.lit(1.0), inliers / 20) * F.exp(-F.greatest(F.lit(0.0), error - 0.5) / 2)


def signature_layout(seen: DataFrame, signatures: DataFrame, least: float = 0.6) -> DataFrame:
    """(page, layout, score): the layout with the largest share of its signature labels on the page, none below
    ``least``. seen: (page, label); signatures: (layout, ord, label), a few forms' layouts."""
    sizes = signatures.groupBy("layout", "ord").agg(F.countDistinct("label").alias("size"))
    hits = seen.join(F.broadcast(signatures), "label").groupBy("page", "layout", "ord").agg(F.countDistinct("label").alias("hits"))
    scored = hits.join(F.broadcast(sizes), ["layout", "ord"]).withColumn("score", F.col("hits") / F.col("size"))
    best = scored.groupBy("page").agg(F.max_by(F.struct("layout", "score"), F.struct(F.col("score"), (-F.col("ord")).alias("o"))).alias("b"))
    all_ = seen.select("page").distinct().join(best, "page", "left")
    score = F.coalesce("b.score", F.lit(0.0))
    return all_.select("page", F.when(score >= least, F.col("b.layout")).alias("layout"), F.round(score, 4).alias("score"))
