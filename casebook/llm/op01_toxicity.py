"""Toxic passages by maximum-scoring segments of token log-odds.

Labelled documents give, for every word and two stems of it (its first four and five letters), log-odds of the toxic class
against the other with a Dirichlet prior whose shape is the whole corpus's token counts. The tables are hashed to a
fixed number of buckets, so the model's size does not grow. A weight is the log-odds less a multiple of its standard
deviation, so what rare tokens seem to say counts for nothing; the r-th time a document says a word, a positive weight
counts an r-th. Weights, less a drift, are negative in expectation on
clean text; one linear scan then finds all maximal scoring segments of a document (each a passage whose every prefix and
suffix is positive). Scores of segments are calibrated by extreme values: clean labelled documents give the two
parameters of the limiting law, lambda from the distribution of token weights and K from the greatest segments, and a
segment's significance follows from its score and the document's length. A document's evidence is the best sum
statistic over its greatest segments; a logistic curve on held-back labelled rows turns it into a score.

Token counts and scores cover all documents and whole texts. Labelled rows are taken for training up to
``max_labels`` (documented bound; the least by hash of doc_id); weights are first fitted on one half of them, the
calibration uses the other half, then the weights are fitted on both.

Defined cases: null and empty texts have no tokens and get the least score; a null doc_id is scored, held_out false;
labels with null doc_id or null toxic are left out, several labels of one doc_id count as toxic if one does; without
labels of both classes the score is at most a half, so nothing is rejected; other columns are carried through unless
their names are those of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from casebook.llm import textblock as tb

BUCKETS = 1 << 18
STEMS = (4, 5)
SLICE_CHARS = 100_000
DRIFT, LEAST, MOST = 0.25, -1.5, 8.0
PRIOR_SHARE, CAUTION = 0.05, 1.2
TOP, PRICE = 8, 1.5
COUNTS = "space int, bucket int, corpus bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint"
PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("p_value", T.DoubleType())]))


@dataclass
class Model:
    #: Log-odds by bucket: of words, then of stems.
    table: tuple[np.ndarray, ...]
    lam: float
    k: float
    intercept: float
    slope: float


def buckets_of(words: tb.Words) -> list[np.ndarray]:
    """Bucket of each word, then of its stems."""
    stems = (words.hasher.of(words.start, np.minimum(words.end, words.start + n)) for n in STEMS)
    return [(h & np.uint64(BUCKETS - 1)).astype(np.int64) for h in (words.hash, *stems)]


def labelled(labels: DataFrame, max_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids (sorted), labels and fold (0 or 1) of the training rows: crc32 of the doc_id's text mod 3 is not 1."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    rows = rows.withColumn("m", F.crc32(F.col("doc_id").cast("string")) % 3).where("m <> 1")
    got = rows.orderBy(F.xxhash64("doc_id")).limit(max_labels).toPandas().sort_values("doc_id")
    return got["doc_id"].to_numpy(np.int64), (got["y"].to_numpy() > 0).astype(np.int64), (got["m"].to_numpy() > 0).astype(np.int64)


def token_counts(docs: DataFrame, sample) -> DataFrame:
    """COUNTS over all documents: in how many documents a bucket occurs, and in how many of each fold and class."""

    def run(batches):
        import pyarrow as pa

        ids, y, fold = sample.value
        total = np.zeros((1 + len(STEMS), 5, BUCKETS), np.int64)
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part, rows in tb.batches(texts, docs_, SLICE_CHARS):
                words = tb.Words(part)
                own = np.array([-1 if d is None else d for d in rows], np.int64)
                at = np.searchsorted(ids, own)
                hit = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own) if len(ids) else np.zeros(len(own), bool)
                group = np.full(len(own), 0, np.int64)
                group[hit] = 1 + fold[at[hit]] * 2 + y[at[hit]]
                doc = np.repeat(np.arange(len(own)), np.diff(words.first))
                for space, bucket in enumerate(buckets_of(words)):
                    once = np.unique(doc * BUCKETS + bucket)
                    b, g = once & (BUCKETS - 1), group[once >> 18]
                    np.add.at(total[space, 0], b, 1)
                    np.add.at(total[space], (g[g > 0], b[g > 0]), 1)
        for space in range(len(total)):
            b = np.flatnonzero(total[space, 0])
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), space, np.int32)), pa.array(b.astype(np.int32)), *(pa.array(total[space, i, b]) for i in range(5))], names=[x.split()[0] for x in COUNTS.split(", ")])

    parts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, COUNTS)
    return parts.groupBy("space", "bucket").agg(*(F.sum(c).alias(c) for c in ("corpus", "a0", "a1", "b0", "b1")))


def log_odds(y1: np.ndarray, y0: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Weight of each bucket: log-odds with a Dirichlet prior in the corpus's shape, drawn towards 0 by its deviation."""
    n1, n0 = y1.sum(), y0.sum()
    strength = PRIOR_SHARE * (n1 + n0)
    a = np.maximum(strength * corpus / max(1, corpus.sum()), 1e-2)
    strength = max(strength, 2 * a.max())
    delta = np.log((y1 + a) / (n1 + strength - y1 - a)) - np.log((y0 + a) / (n0 + strength - y0 - a))
    doubt = CAUTION * np.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    return np.clip(np.where(delta > 0, np.maximum(0, delta - doubt), np.minimum(0, delta + doubt)), LEAST, MOST).astype(np.float32)


def weights(words: tb.Words, table: tuple[np.ndarray, ...]) -> np.ndarray:
    """Score of each word: the greatest of its own and its stems' where that is positive, else their mean; less DRIFT."""
    odds = np.stack([t[b] for t, b in zip(table, buckets_of(words))]).astype(np.float64)
    top = odds.max(0)
    up = np.flatnonzero(top > 0)
    if len(up):
        doc = np.searchsorted(words.first, up, "right").astype(np.uint64)
        _, same = np.unique(words.hash[up] + doc * np.uint64(0x9E3779B97F4A7C15), return_inverse=True)
        order = np.argsort(same, kind="stable")
        grouped = same[order]
        heads = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]]))
        nth = np.empty(len(up), np.int64)
        nth[order] = np.arange(len(up)) - np.repeat(heads, np.diff(np.append(heads, len(up)))) + 1
        top[up] /= nth
    return np.where(top > 0, top, odds.mean(0)) - DRIFT


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order: the linear-time scan over cumulative sums."""
    up = score > 0
    if not up.any():
        return []
    sums = np.concatenate([[0.0], np.cumsum(score)])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], up.astype(np.int8), [0]])))
    found: list[list] = []  # start, end, left sum, right sum, index of the nearest earlier one with a smaller left sum
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        new = [a, b, sums[a], sums[b], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in found]


def evidence(scores: np.ndarray, n: int, lam: float, k: float) -> float:
    """The greatest sum statistic over the r greatest segments, r up to TOP; each pays for the text's length and PRICE.
    -10 without a segment."""
    if not len(scores):
        return -10.0
    best = np.sort(scores)[::-1][:TOP]
    stat = np.cumsum(lam * best - np.log1p(k * n) - PRICE)
    return float(np.clip(stat.max(), -10, 40))


def _segments_by_doc(part: list, table):
    words = tb.Words(part)
    score = weights(words, table)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        yield words, a, score[a:b], segments(score[a:b])


BIN, BINS, BIN_FROM = 0.05, 220, -2.5


def _calibrate(docs: DataFrame, sample, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the second fold's documents: label, length, TOP segment scores; and the clean ones' token weights by bin."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa

        ids, y, fold = sample.value
        hist, out = np.zeros(BINS), []
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = np.array([-1 if d is None else d for d in docs_], np.int64)
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            hit = np.flatnonzero((ids[at] == own) & (fold[at] == 1)) if len(ids) else []
            for part, rows in tb.batches([texts[i] for i in hit], [at[i] for i in hit], SLICE_CHARS):
                for row, (_, _, score, found) in zip(rows, _segments_by_doc(part, shared.value)):
                    label = int(y[row])
                    if not label:
                        hist += np.bincount(np.clip(((score - BIN_FROM) / BIN).astype(int), 0, BINS - 1), minlength=BINS)
                    out.append({"label": label, "n": len(score), "best": sorted((s for _, _, s in found), reverse=True)[:TOP]})
        out.append({"label": -1, "n": 0, "best": hist.tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("label", pa.int32()), ("n", pa.int64()), ("best", pa.list_(pa.float64()))]))

    # only labelled documents reach Python: their ids are few by the bound
    wanted = spark.createDataFrame([(int(i),) for i, f in zip(sample.value[0], sample.value[2]) if f], "wanted bigint")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = slim.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted"), "left_semi").mapInArrow(run, "label int, n bigint, best array<double>").toPandas()
    hist = np.sum([np.array(x) for x in got["best"][got["label"] < 0]], axis=0) if (got["label"] < 0).any() else np.zeros(BINS)
    rows = got[got["label"] >= 0]
    return rows["label"].to_numpy(), rows["n"].to_numpy(), list(rows["best"]), hist


def law(hist: np.ndarray, n: np.ndarray, greatest: np.ndarray) -> tuple[float, float]:
    """lambda: where the expectation of exp(lambda * weight) is 1, or the Gumbel law's for the greatest segments' deviation
    if that is less; K: by the greatest segments' likelihood."""
    p = hist + 1e-3
    p = p / p.sum()
    x = BIN_FROM + BIN * (np.arange(BINS) + 0.5)
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * x, 500))).sum() < 1 else (low, mid)
    lam = (low + high) / 2
    if not len(n):
        return lam, 0.1
    if (deviation := float(greatest.std())) > 0:  # where clean texts vary more than the law of the weights has it
        lam = min(lam, float(np.pi / np.sqrt(6) / deviation))
    return lam, float(np.clip(len(n) / max((n * np.exp(-lam * greatest)).sum(), 1e-9), 1e-4, 10))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (never negative) by Newton's method with a small ridge."""
    X = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        H = (X * (p * (1 - p) + 1e-6)[:, None]).T @ X + np.diag([1e-3, 1e-1])
        w = w + np.linalg.solve(H, X.T @ (y - p) - np.array([1e-3, 1e-1]) * w)
    return float(w[0]), float(max(w[1], 0))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 200_000) -> Model:
    """The model from all documents' token counts and up to ``max_labels`` training labels."""
    sc = docs.sparkSession.sparkContext
    ids, y, fold = labelled(labels, max_labels)
    sample = sc.broadcast((ids, y, fold))
    got = token_counts(docs, sample).toPandas()  # at most BUCKETS rows for each table
    total = np.zeros((1 + len(STEMS), 5, BUCKETS), np.int64)
    for i, c in enumerate(("corpus", "a0", "a1", "b0", "b1")):
        total[got["space"], i, got["bucket"]] = got[c]
    none = np.full(BUCKETS, 0, np.float32)
    if not (total[0, 2].any() and total[0, 1].any() and total[0, 3:].any()):
        if not ((total[0, 2] + total[0, 4]).any() and (total[0, 1] + total[0, 3]).any()):
            share = (y.sum() + 0.5) / (len(y) + 1)
            return Model((none,) * (1 + len(STEMS)), 1.0, 0.1, float(np.log(min(share, 0.5) / (1 - min(share, 0.5)))), 0.0)
    half = tuple(log_odds(t[2], t[1], t[0]) for t in total)
    label, n, best, hist = _calibrate(docs, sample, half)
    greatest = np.array([b[0] if len(b) else 0.0 for b in best])
    clean = (label == 0) & (n > 0)
    lam, k = law(hist, n[clean], greatest[clean])
    x = np.array([evidence(np.asarray(b), int(m), lam, k) for b, m in zip(best, n)])
    if (label == 1).any() and (label == 0).any():
        a, b = logistic(x, label.astype(float))
    else:
        a, b = -4.0, 1.0
    both = tuple(log_odds(t[2] + t[4], t[1] + t[3], t[0]) for t in total)
    return Model(both, lam, k, a, b)


def score_documents(docs: DataFrame, model: Model, significance: float = 0.01, passages: bool = True, threshold: float = 0.7) -> DataFrame:
    """``docs`` with held_out, score, predicted, n_passages and (if asked for) passages: word spans of significance."""
    import pyarrow as pa

    added = ["held_out", "score", "predicted", "n_passages", "passages"]
    kept = docs.select(*[c for c in docs.columns if c not in added])
    kept = kept.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.IntegerType())])
    if passages:
        schema = schema.add("passages", PASSAGES)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score, count, spans = [], [], []
            for part, _ in tb.batches(texts, texts, SLICE_CHARS):
                for _, _, w, found in _segments_by_doc(part, m.table):
                    n = len(w)
                    e = evidence(np.array([s for _, _, s in found]), n, m.lam, m.k)
                    score.append(1 / (1 + np.exp(-np.clip(m.intercept + m.slope * e, -30, 30))))
                    p = [-np.expm1(-m.k * n * np.exp(-m.lam * s)) for _, _, s in found]
                    count.append(sum(x <= significance for x in p))
                    if passages:
                        spans.append([{"start": a, "end": b, "score": s, "p_value": float(x)} for (a, b, s), x in zip(found, p) if x <= significance])
            score = np.array(score, np.float64)
            cols = [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count, pa.int32())]
            names = [*batch.schema.names, "score", "predicted", "n_passages"]
            if passages:
                cols.append(pa.array(spans, span))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return kept.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's row per document of the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, passages=False).select("doc_id", "held_out", "score", "predicted", "n_passages")
