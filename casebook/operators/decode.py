"""Constrained decoding: candidate values as rows, scored by connectionist probabilities and priors."""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.functions.lexicon import VOCABULARIES
from casebook.functions.parse import general_number
from casebook.functions.text import fold

#: Weights of priors and of the small recogniser, and how many values are few.
PRIOR_WEIGHT, SMALL_WEIGHT, FEW = 0.5, 2.0, 100
#: Characters that handwriting confuses, by the one that is meant.
LOOKALIKES = {
    "1": "1lI|i!AΛ^7", "0": "0OoDQ", "2": "2Zz", "3": "3", "4": "4", "5": "5Ss", "6": "6Gb", "7": "7T1", "8": "8B", "9": "9gq",
    "/": "/|lI1()\\", "+": "+tT", ",": ",.", ".": ".,", "-": "-—–_~",
}
#: Columns that hold a few words, words beside the vocabulary's, and words written across rows.
WORD_COLUMNS = ["skeletal_anomalies", "conjunctivae", "breast_exam", "edema", "fetal_movements", "cervix", "presentation", "pelvis", "speculum_exam", "iron", "syphilis", "hiv", "hepatitis_b", "rai", "glycosuria", "albuminuria", "rubella", "toxoplasmosis", "reminder_visit"]
EXTRA_WORDS = ["RAS", "NF", "Oui", "Non", "+", "-", "0", "nég", "neg", "Neg", "pos", "Reçu", "Fait", "colorées", "Colorées", "Décolorées", "Fermé", "Ouvert", "Céphalique", "Siège", "Normal", "Normaux", "Normales"]
SPAN_WORDS = ["RAS", "R.A.S", "Néant", "Normal", "Normale", "Normaux", "Rien", "Négatif", "Aucun", "Aucune"]


def number_prior(value: Column, mean, sd) -> Column:
    """Log prior of a number: a normal law, half again as wide."""
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    return -0.5 * F.pow((value - mean) / (1.5 * F.greatest(sd, F.lit(1e-3))), 2)


def _prior(priors: dict, column: str, *values: Column) -> Column:
    """Sum of the log priors of a column's numbers; 0 where it has none. ``priors``: column to [(mean, sd)]."""
    law = priors.get(column, [])
    parts = [number_prior(v, float(m), s) for v, (m, s) in zip(values, law)]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _best(rows: DataFrame) -> DataFrame:
    """(text, value, prior): each text once, with its greatest prior, the least value among equals."""
    best = F.max_by(F.struct("value", "prior"), F.struct(F.col("prior"), (-F.col("ord")).alias("first")))
    return rows.where("text <> ''").groupBy("text").agg(best.alias("b")).select("text", "b.value", "b.prior")


def _rows(rows: DataFrame, *kinds: tuple[Column, Column, Column]) -> DataFrame:
    """One row for each (text, value, prior) of each input row."""
    spelled = F.array(*[F.struct(t.cast("string").alias("text"), v.cast("string").alias("value"), p.cast("double").alias("prior"), F.lit(i).alias("ord")) for i, (t, v, p) in enumerate(kinds)])
    return rows.select(F.explode(spelled).alias("r")).select("r.*")


def pressure_candidates(spark, column: str = "blood_pressure", priors: dict = {}) -> DataFrame:
    """Pairs in centimetres, the same in tens of millimetres, and whole pairs of millimetres at least ten apart, of which
    one is no ten; values and priors are in centimetres."""
    span = lambda name, lo, hi: spark.range(lo, hi).withColumnRenamed("id", name)
    s, d = F.col("s"), F.col("d")
    small = span("s", 7, 23).withColumn("d", F.explode(F.sequence(F.lit(4), F.lit(13)))).where(d < s)
    value, prior = F.concat_ws("/", s, d), _prior(priors, column, s, d)
    pairs = _rows(small, (value, value, prior), (F.concat_ws("/", s * 10, d * 10), value, prior))
    fine = span("s", 80, 200).withColumn("d", F.explode(F.sequence(F.lit(40), F.lit(129)))).where((d + 10 <= s) & ((s % 10 != 0) | (d % 10 != 0)))
    return _best(pairs.unionByName(_rows(fine, (F.concat_ws("/", s, d), F.concat_ws("/", general_number(s / 10), general_number(d / 10)), _prior(priors, column, s / 10, d / 10)))))


def date_candidates(spark, as_of: str, years: int = 4) -> DataFrame:
    """Six spellings of every day from four years before ``as_of``'s year to the next year's end; days of the two years up
    to ``as_of`` are the usual ones."""
    y = int(as_of[:4])
    days = spark.sql(f"SELECT explode(sequence(DATE'{y - years}-01-01', DATE'{y + 1}-12-31')) AS d")
    usual = F.when(F.datediff(F.lit(as_of).cast("date"), "d").between(0, 730), 0.0).otherwise(-3.0)
    iso = F.date_format("d", "yyyy-MM-dd")
    return _best(_rows(days, *[(F.date_format("d", p), iso, usual) for p in ("d/M/yy", "dd/MM/yy", "d/M/yyyy", "dd/MM/yyyy", "dd/M/yy", "d/MM/yy")]))


def week_candidates(spark, lo: int = 4, hi: int = 44, column: str = "gestational_age_weeks", priors: dict = {}) -> DataFrame:
    w, d = F.col("w"), F.col("d")
    weeks = spark.range(lo, hi + 1).withColumnRenamed("id", "w")
    prior = _prior(priors, column, w)
    whole = _rows(weeks, (F.concat(w, F.lit("SA")), w, prior), (w, w, prior - 1.0))
    parts = weeks.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(6))))
    value = F.concat(w, F.lit("+"), d)
    spelled = [F.concat(w, F.lit("SA+"), d, F.lit("j")), F.concat(w, F.lit("SA+"), d), F.concat(w, F.lit("SA"), d, F.lit("j"))]
    return _best(whole.unionByName(_rows(parts, *[(t, value, prior) for t in spelled])))


def number_candidates(spark, dtype: str, column: str, lo: float | None = None, hi: float | None = None, priors: dict = {}) -> DataFrame:
    """Numbers of a range with their usual units; decimals with comma and point, two places in ranges up to 5; NF where a
    measurement may be left out. Weights default to 30-160, others to 0-60."""
    lo, hi = (lo, hi) if lo is not None else (30, 160) if dtype == "kg" else (0, 60)
    n = F.col("n")
    if dtype == "float":
        places = 2 if hi <= 5 else 1
        scale = 10**places
        whole = spark.range(int(lo), int(np.ceil(hi)) + 1).withColumnRenamed("id", "n")
        ticks = whole.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(scale - 1))))
        v = n + F.col("b") / scale
        inside = ticks.where(v.between(lo, hi))
        prior, frac = _prior(priors, column, v), F.lpad(F.col("b").cast("string"), places, "0")
        kinds = [(F.concat(n, F.lit(sep), frac), general_number(v), prior) for sep in (",", ".")]
        if places == 2:
            short = F.when(F.col("b") % 10 == 0, (F.col("b") / 10).cast("int"))
            kinds += [(F.coalesce(F.concat(n, F.lit(sep), short), F.lit("")), general_number(v), prior) for sep in (",", ".")]
        rows = _rows(inside, *kinds).unionByName(_rows(whole, (n, n, _prior(priors, column, n) - 0.5)))
    else:
        whole = spark.range(int(lo), int(hi) + 1).withColumnRenamed("id", "n")
        units = ["", "ans", "jours", "j"] if column == "age" else ["", "cm"] if dtype == "cm" or column.endswith("_cm") else ["", "kg"] if dtype == "kg" else [""]
        rows = _rows(whole, *[(F.concat(n, F.lit(u)), n, _prior(priors, column, n)) for u in units])
        if dtype == "kg":
            tenths = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
            value = F.concat(n, F.lit("."), F.col("k"))
            rows = rows.unionByName(_rows(tenths, *[(F.concat(n, F.lit(sep), F.col("k")), value, _prior(priors, column, n + F.col("k") / 10)) for sep in (",", ".")]))
    if dtype in ("kg", "cm") or column.endswith(("_kg", "_cm")):
        rows = rows.unionByName(spark.createDataFrame([("NF", "NF", 0.0, 0)], "text string, value string, prior double, ord int"))
    return _best(rows)


def word_candidates(spark, counts: dict[str, int] = {}, words: list[str] | None = None) -> DataFrame:
    """The vocabulary with Laplace-smoothed log shares of how often a column holds each word."""
    vocabulary = list(dict.fromkeys([*(VOCABULARIES["clinical"] + EXTRA_WORDS if words is None else words), *counts]))
    total = sum(counts.values()) + len(vocabulary)
    return spark.createDataFrame([(w, w, float(np.log((counts.get(w, 0) + 1) / total))) for w in vocabulary], "text string, value string, prior double")


def candidates(spark, column: str, dtype: str, lo: float | None = None, hi: float | None = None, as_of: str = "2024-06-01", priors: dict = {}, counts: dict[str, int] = {}) -> DataFrame | None:
    """(text, value, prior) of every plausible value of a field as it may be written; None for free text without a grammar."""
    if dtype == "bp":
        return pressure_candidates(spark, column, priors)
    if dtype == "date":
        return date_candidates(spark, as_of)
    if dtype == "weeks":
        return week_candidates(spark, *((int(lo), int(hi)) if lo is not None else (4, 44)), column, priors)
    if dtype in ("kg", "int", "cm") or (dtype == "float" and lo is not None):
        return number_candidates(spark, dtype, column, lo, hi, priors)
    if column == "platelets":
        n = F.col("id")
        return _best(_rows(spark.range(80, 600), *[(F.concat(n, F.lit(end)), F.concat(n, F.lit("000")), F.lit(0.0)) for end in ("000", "000/mm3", "k")]))
    if dtype in ("yesno", "posneg", "enum") or column in WORD_COLUMNS:
        return word_candidates(spark, counts)
    return None


def plausible(readings: DataFrame, grammar: DataFrame) -> DataFrame:
    """``readings`` (text) with plausible: whether the text, folded and without blanks, is a candidate's."""
    tight = lambda c: F.regexp_replace(fold(F.coalesce(F.col(c), F.lit(""))), r"\s", "")
    known = grammar.select(tight("text").alias("_key"), F.lit(True).alias("plausible")).distinct()
    return readings.withColumn("_key", tight("text")).join(known, "_key", "left").withColumn("plausible", F.coalesce("plausible", F.lit(False))).drop("_key")


def canonical_text(value: Column, text: Column, dtype: Column) -> Column:
    """A decoded value as the parser reads it best."""
    w, d = F.substring_index(value, "+", 1), F.regexp_extract(value, r"\+(\d)$", 1)
    weeks = F.when(d != "", F.concat(w, F.lit("SA+"), d, F.lit("j"))).otherwise(F.concat(w, F.lit("SA")))
    return F.when(dtype == "weeks", weeks).when(dtype.isin("int", "kg", "cm", "float") & (value != "NF"), value).otherwise(text)


def word_priors(words: DataFrame, column: str, word: str) -> DataFrame:
    """(column, word, n, prior): Laplace-smoothed log shares within each column."""
    n = words.groupBy(column, word).agg(F.count("*").alias("n"))
    w = Window.partitionBy(column)
    return n.withColumn("prior", F.log((F.col("n") + 1) / (F.sum("n").over(w) + F.count("*").over(w))))


def _first(c: str) -> str:
    return unicodedata.normalize("NFD", c.lower())[:1]


def emissions(probs: np.ndarray, charset: list[str], symbols: list[str]) -> np.ndarray:
    """Log probability of each symbol in each slice: the sum over the characters that may stand for it, whatever their case
    and accents. Column 0 is the blank together with the space."""
    blank = probs[:, 0] + (probs[:, charset.index(" ")] if " " in charset else 0)
    folded = [_first(c) if i and len(c) == 1 else "" for i, c in enumerate(charset)]
    columns = [blank]
    for s in symbols:
        meant = LOOKALIKES.get(s)
        if meant is None:
            own = [i for i, f in enumerate(folded) if f and f == _first(s)]
        else:
            letters = {_first(m) for m in meant if m.isalpha()}
            own = [i for i, f in enumerate(folded) if f and (charset[i] in meant or f in letters)]
        columns.append(probs[:, own].sum(1) if own else np.zeros(len(probs)))
    return np.log(np.clip(np.stack(columns, 1), 1e-12, 1))


def forward(logp: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log probability of each of N label sequences of one length (N x L): the forward algorithm over all at once."""
    n, length = labels.shape
    path = np.zeros((n, 2 * length + 1), np.int64)
    path[:, 1::2] = labels
    may_skip = np.zeros(path.shape, bool)
    may_skip[:, 3::2] = labels[:, 1:] != labels[:, :-1]
    a = np.full(path.shape, -np.inf)
    a[:, : min(2, path.shape[1])] = logp[0, path[:, :2]]
    for t in range(1, len(logp)):
        step = np.pad(a, ((0, 0), (1, 0)), constant_values=-np.inf)[:, :-1]
        leap = np.pad(a, ((0, 0), (2, 0)), constant_values=-np.inf)[:, :-2]
        a = np.logaddexp(np.logaddexp(a, step), np.where(may_skip, leap, -np.inf)) + logp[t, path]
    return np.logaddexp(a[:, -1], a[:, -2]) if length else a[:, -1]


def ctc_scores(probs: np.ndarray, charset: list[str], texts: list[str]) -> np.ndarray:
    """Log probability that a crop's T x C character probabilities spell each text; -inf for texts longer than T."""
    symbols = sorted({c for t in texts for c in t})
    number = {c: i + 1 for i, c in enumerate(symbols)}
    logp = emissions(probs, charset, symbols)
    out = np.full(len(texts), -np.inf)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(size[size <= len(probs)]).tolist():
        rows = np.flatnonzero(size == length)
        out[rows] = forward(logp, np.array([[number[c] for c in texts[i]] for i in rows], np.int64).reshape(len(rows), length))
    return out


def free_score(probs: np.ndarray) -> float:
    """Log probability of the free reading, the best character of every slice."""
    return float(np.log(np.clip(probs.max(1), 1e-12, 1)).sum())


def ctc_log_score(probs: np.ndarray, labels: list[int], blank: int = 0) -> float:
    """Log probability that a T x C matrix spells a sequence of columns, without lookalikes."""
    return float(forward(np.log(np.clip(probs, 1e-12, 1)), np.array([labels], np.int64).reshape(1, len(labels)))[0])


def ctc_score(crops: DataFrame, grammar: DataFrame, charset: list[str]) -> DataFrame:
    """(crop, text, score, free): crops (crop, probs array<array<double>>; column 0 is the blank) against candidates
    (crop, text). A crop's candidates, a grammar's, are scored together, equal lengths at once."""

    def run(batches):
        for pdf in batches:
            for crop, probs, texts in zip(pdf["crop"], pdf["probs"], pdf["texts"]):
                p = np.array([list(r) for r in probs], float)
                yield pd.DataFrame({"crop": crop, "text": list(texts), "score": ctc_scores(p, charset, list(texts)), "free": free_score(p)})

    texts = grammar.groupBy("crop").agg(F.collect_list("text").alias("texts"))
    return crops.join(texts, "crop").select("crop", "probs", "texts").mapInPandas(run, "crop bigint, text string, score double, free double")


def with_small(scored: DataFrame, small: DataFrame | None) -> DataFrame:
    """Scores (crop, text, score, free) with scale, the small recogniser's added with its weight for crops of at most FEW
    candidates; where it has no finite score the medium one's stands alone."""
    if small is None:
        return scored.withColumn("scale", F.lit(1.0))
    other = small.select("crop", "text", F.col("score").alias("_s"), F.col("free").alias("_f"))
    few = F.count("*").over(Window.partitionBy("crop")) <= FEW
    rows = scored.join(other, ["crop", "text"], "left").withColumn("_few", few & F.col("_f").isNotNull())
    finite = F.col("_few") & (F.col("_s") > float("-inf"))
    return rows.withColumns({
        "score": F.when(finite, F.col("score") + SMALL_WEIGHT * F.col("_s")).otherwise(F.col("score")),
        "free": F.when(F.col("_few"), F.col("free") + SMALL_WEIGHT * F.col("_f")).otherwise(F.col("free")),
        "scale": F.when(F.col("_few"), 1 + SMALL_WEIGHT).otherwise(1.0),
    }).drop("_s", "_f", "_few")


def posterior(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best of each crop: (crop, text, rank, posterior) by score and half the prior, and (where free and scale are
    given) fit, how well the text explains the ink against the free reading."""
    w = Window.partitionBy("crop")
    total = scored.withColumn("total", F.col("score") + PRIOR_WEIGHT * F.col("prior")).where(F.col("total") > float("-inf"))
    weight = total.withColumn("e", F.exp(F.col("total") - F.max("total").over(w)))
    shared = weight.withColumn("posterior", F.col("e") / F.sum("e").over(w))
    best = shared.withColumn("rank", F.row_number().over(w.orderBy(F.desc("total"), "text"))).where(F.col("rank") <= k)
    fit = [((F.col("score") - F.col("free")) / F.col("scale")).alias("fit")] if {"free", "scale"} <= set(scored.columns) else []
    return best.select("crop", "text", "rank", "posterior", *fit)


def confidence(margin: Column, fit: Column) -> Column:
    return margin / (1 + F.exp(-(fit + 6) / 2))
