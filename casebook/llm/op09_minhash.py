"""Near-duplicates by consistent weighted sampling over TF-IDF shingles, banded and verified.

A document's shingles are runs of five words; a shingle weighs its count times the mean inverse document frequency of
its words. Frequencies are of all documents, in 2^18 hash buckets (a bounded table). Improved consistent weighted
sampling draws BANDS x ROWS samples (shingle, level) whose collision probability is the weighted Jaccard similarity;
documents that agree in all samples of a band share a bucket. At similarity 0.8 a pair shares none with probability
(1 - 0.8^3)^12, about 0.0002.

Equal token sequences are collapsed first: the least doc_id stands for them. Within a bucket no pairs are emitted: each
member is verified against the bucket's least member by exact weighted Jaccard similarity of the whole texts, links are
joined into classes, and only buckets that still hold several classes are looked at again: there, members outside the
bucket's largest class are verified against all members of other classes, in tasks of at most TILE x TILE documents.
So every two members of a bucket are of one class or were found unlike, directly or through links; a group of thousands
of copies costs one verification per member.

Frequencies, signatures and links are tables; nothing that grows with the documents reaches the driver. Hot buckets are
aggregated before the shuffle and joined as slim rows. Texts are shuffled only where a document shares a bucket: a bitmap
of FILTER_BITS over hashed doc_ids, a broadcast table whose size does not depend on the input, leaves out most others
before the exact join (a full bitmap lets all pass), and each side of the verification reads only the texts it needs. A leader's
text goes to its members' tasks once for GROUP members, not with every member.

Defined cases: a text of one to four words is one shingle; null texts and texts without words are each a class of their
own; rows that share a doc_id are one class; null doc_ids are left out of the result and stay as they are in ``keep_one``;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from casebook.llm import textblock as tb
from casebook.llm.shared import unused, written

SHINGLE, BANDS, ROWS, THRESHOLD = 5, 12, 3, 0.8
BUCKETS = 1 << 18
TILE = 256
#: Members of a leader that are verified in one group.
GROUP = 1024
SLICE_CHARS = 100_000
LEVELS = 1 << 16
FILTER_BITS, PAGE_BITS = 1 << 25, 1 << 15
U = np.uint64


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each word bucket over all documents."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for part, _ in tb.batches(texts, texts, SLICE_CHARS):
                words = tb.Words(part)
                doc = np.repeat(np.arange(len(part)), np.diff(words.first))
                once = np.unique(doc * BUCKETS + (words.hash & U(BUCKETS - 1)).astype(np.int64))
                total += np.bincount(once & (BUCKETS - 1), minlength=BUCKETS)
        b = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(b, -1).astype(np.int32)), pa.array(np.append(total[b], n))], names=["bucket", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = int(got["n"][got["bucket"] < 0].sum())
    df = np.zeros(BUCKETS, np.float64)
    seen = got["bucket"] >= 0
    df[got["bucket"][seen]] = got["n"][seen]
    return np.log1p((n + 1) / (df + 1)).astype(np.float32)


def shingles(words: tb.Words, idf: np.ndarray):
    """Of each text: sorted distinct shingle hashes and their weights."""
    w = idf[(words.hash & U(BUCKETS - 1)).astype(np.int64)].astype(np.float64)
    n = len(w)
    factor = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], U)
    h = np.zeros(n, U)
    for k in range(min(SHINGLE, n)):
        h[: n - k] += words.hash[k:] * factor[k]
    h = tb.mix(h)
    sums = np.concatenate([[0.0], np.cumsum(w)])
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        m = b - a
        if m >= SHINGLE:
            own = h[a : b - SHINGLE + 1]
            weight = (sums[a + SHINGLE : b + 1] - sums[a : b - SHINGLE + 1]) / SHINGLE
        elif m:
            total = (words.hash[a:b] * factor[:m]).sum(keepdims=True)
            own, weight = tb.mix(total + np.array([m], U)), np.array([w[a:b].mean()])
        else:
            yield words.hash[:0], w[:0]
            continue
        key, where, count = np.unique(own, return_index=True, return_counts=True)
        # from the shingle's own words, so that equal shingles weigh the same in every text
        yield key, np.round(weight[where], 4) * count


_tables: dict[str, np.ndarray] = {}


def _draws() -> dict[str, np.ndarray]:
    """Quantiles of the sampling's laws: r and c are Gamma(2, 1), by a fixed order of draws."""
    if not _tables:
        draw = np.random.RandomState(20240229)
        r = draw.gamma(2.0, 1.0, LEVELS) + 1e-6
        _tables["r"], _tables["inv"] = r.astype(np.float32), (1 / r).astype(np.float32)
        _tables["c"] = np.log(draw.gamma(2.0, 1.0, LEVELS) + 1e-9).astype(np.float32)
        _tables["k"] = tb.mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return _tables


def signature(key: np.ndarray, weight: np.ndarray, step: int = 2048) -> np.ndarray:
    """One hash per band of a document's samples."""
    t = _draws()
    best = np.full(BANDS * ROWS, np.inf, np.float32)
    sample = np.zeros(BANDS * ROWS, U)
    for a in range(0, len(key), step):
        h, logw = key[a : a + step], np.log(weight[a : a + step]).astype(np.float32)
        z = (h[None, :] ^ t["k"][:, None]) * U(0xBF58476D1CE4E5B9)
        z ^= z >> U(29)
        z *= U(0x94D049BB133111EB)
        i = (z >> U(48)).astype(np.uint16)
        j = (z >> U(32)).astype(np.uint16)
        beta = (z >> U(16)).astype(np.uint16).astype(np.float32) * np.float32(1 / LEVELS)
        r = t["r"][i]
        level = np.floor(logw[None, :] * t["inv"][i] + beta)
        score = t["c"][j] - r * (level - beta + 1)
        low = score.argmin(1)
        rows = np.arange(len(low))
        value = score[rows, low]
        better = value < best
        best[better] = value[better]
        got = tb.mix(h[low] + level[rows, low].astype(np.int64).astype(U) * U(0x632BE59BD9B4E019))
        sample[better] = got[better]
    mixed = tb.mix(sample + t["k"])
    out = np.zeros(BANDS, U)
    for k in range(ROWS):
        out = tb.mix(out * U(3) + mixed[k::ROWS])
    return out


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, same binary, bands array<bigint>): same is equal for equal token sequences; no bands without words."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part, rows in tb.batches(texts, ids, SLICE_CHARS):
                words = tb.Words(part)
                same, bands = [], []
                known: dict[bytes, list] = {}
                for (key, weight), a, b in zip(shingles(words, idf.value), words.first[:-1].tolist(), words.first[1:].tolist()):
                    digest = hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest()
                    same.append(digest)
                    if not len(key):
                        bands.append([])
                        continue
                    if digest not in known:
                        known[digest] = signature(key, weight).view(np.int64).tolist()
                    bands.append(known[digest])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "same", "bands"])

    slim = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id bigint, same binary, bands array<bigint>")


def jaccard(a, b) -> float:
    """Weighted Jaccard similarity of two (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total > 0 else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Of (a, b), those whose texts are similar enough. A leader b and at most about GROUP of its members are a group;
    the leader's text is dealt once to each of its groups and comes before the members', one row after the other."""

    def run(batches):
        import pyarrow as pa

        lead = None
        for batch in batches:
            keep_a, keep_b = [], []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = next(iter(shingles(tb.Words([text]), idf.value)))
                if a is None:
                    lead = own
                elif jaccard(own, lead) >= threshold:
                    keep_a.append(a), keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    members = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("part"))
    members = members.join(texts.where("member").select(F.col("doc_id").alias("a"), "text"), "a").select("a", "b", "text", "part")
    leads = groups.join(texts.where("lead").select(F.col("doc_id").alias("b"), "text"), "b")
    leads = leads.select(F.lit(None).cast("bigint").alias("a"), "b", "text", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    dealt = leads.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return dealt.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id is not among ``ids``; none of those is lost. The bitmap is a table of at
    most FILTER_BITS / PAGE_BITS rows of 4 kB, so its broadcast is bounded."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1
    pages = ids.select(F.bitmap_bucket_number(bit).alias("page"), F.bitmap_bit_position(bit).alias("at")).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(_byte, _bit) & 1") == 1
    marked = docs.withColumn("page", F.bitmap_bucket_number(bit)).join(F.broadcast(pages), "page")
    return marked.withColumns({"_byte": byte, "_bit": (at % 8).cast("int")}).where(held).select(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every document in (a, b): the least doc_id that links lead to. Labels pass along links and
    are then followed to their own label, so rounds grow with the logarithm of a chain's length."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    label = written(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("class_id")), "near-classes")
    while True:
        near = both.join(label.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("class_id").alias("near"))
        step = label.join(near, "doc_id").select("doc_id", F.least("class_id", "near").alias("new"), F.col("class_id").alias("old"))
        jump = label.select(F.col("doc_id").alias("new"), F.col("class_id").alias("far"))
        new = written(step.join(jump, "new").select("doc_id", F.least("new", "far").alias("class_id"), "old"), "near-classes")
        moved = new.where("class_id <> old").limit(1).count()
        label = new.select("doc_id", "class_id")
        if not moved:
            return label


def _crossed(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links (a, b) between classes within (bucket, doc_id, class_id): members outside a bucket's largest class against
    the members of other classes, tile by tile. A similarity is at most the lesser total weight over the greater, so only
    texts whose totals allow it are compared; two members outside the largest class meet once."""
    sizes = members.groupBy("bucket", "class_id").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most"))
    rows = members.join(largest, "bucket")
    down = F.ceil((F.col("total") - F.col("most")) / TILE).cast("int")
    across = F.ceil(F.col("total") / TILE).cast("int")
    spot = F.xxhash64("doc_id")
    minor = rows.where("class_id <> main").select("bucket", "doc_id", "class_id", F.pmod(spot, down).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), across - 1)).alias("j"), F.lit(True).alias("left"), F.lit(True).alias("minor"))
    every = rows.select("bucket", "doc_id", "class_id", F.explode(F.sequence(F.lit(0), down - 1)).alias("i"), F.pmod(spot, across).cast("int").alias("j"), F.lit(False).alias("left"), (F.col("class_id") != F.col("main")).alias("minor"))
    dealt = minor.unionByName(every).join(texts.select("doc_id", "text"), "doc_id")

    def tile(rows):
        import pandas as pd

        sets = {d: next(iter(shingles(tb.Words([t]), idf.value))) for d, t in zip(rows["doc_id"], rows["text"])}
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        left = rows[rows["left"]]
        right = rows[~rows["left"]]
        others = list(zip(right["doc_id"].tolist(), right["class_id"].tolist()))
        ids, minors = right["doc_id"].to_numpy(np.int64), right["minor"].to_numpy(bool)
        totals = np.array([sets[e][1].sum() for e, _ in others])
        for d, c in zip(left["doc_id"].tolist(), left["class_id"].tolist()):
            own = sets[d][1].sum()
            # a little slack for rounding of sums
            able = np.minimum(totals, own) >= threshold * (1 - 1e-9) * np.maximum(totals, own)
            for k in np.flatnonzero(able & (~minors | (ids > d))).tolist():
                e, other = others[k]
                if root(c) != root(other) and jaccard(sets[d], sets[e]) >= threshold:
                    out.append((d, e))
                    parent[root(c)] = root(other)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("bucket", "i", "j").applyInPandas(tile, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every document: class_id is the least doc_id of its class."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequency(docs))
    signed = written(signatures(docs, idf), "near-signatures")
    worded = signed.where(F.size("bands") > 0)
    copies = worded.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = copies.select(F.col("rep").alias("doc_id"), F.posexplode("bands").alias("band", "value")).select("doc_id", F.xxhash64("band", "value").alias("bucket"))
    reps = reps.distinct()
    sized = reps.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.xxhash64("doc_id", F.lit(1)).bitwiseAND((1 << 30) - 1)).alias("s")).where("n > 1")
    one = sized.groupBy("n", "x", "s", "lead").agg(F.min("bucket").alias("bucket"))  # buckets of the same members count once
    members = written(reps.join(one.select("bucket", "lead", "n"), "bucket"), "near-buckets")
    wanted = written(members.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("lead")).alias("lead"), F.bool_or(F.col("doc_id") != F.col("lead")).alias("member")), "near-wanted")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = written(_likely(slim, wanted).join(wanted, "doc_id").dropDuplicates(["doc_id"]), "near-texts")
    stars = members.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    links = written(_verified(stars, texts, idf, threshold), "near-stars")
    label = components(links)
    open_ = members.where("n > 2").join(label, "doc_id", "left").select("bucket", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    several = open_.groupBy("bucket").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v")).where("u <> v").select("bucket")
    crossed = written(_crossed(open_.join(several, "bucket"), texts, idf, threshold), "near-crossed")
    if crossed.limit(1).count():
        label = components(links.unionByName(crossed))
    # copies, and rows of one doc_id with several texts, tie token sequences together through doc_ids
    of_copy = worded.select("doc_id", "same").join(copies.select("same", "rep"), "same").join(label.withColumnRenamed("doc_id", "rep"), "rep", "left")
    classed = of_copy.select("doc_id", F.coalesce("class_id", "rep").alias("class_id")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other"))
    mixed = classed.where("class_id <> other").select(F.col("class_id").alias("a"), F.col("other").alias("b"))
    every = signed.select("doc_id").distinct().join(classed.select("doc_id", "class_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    if mixed.limit(1).count():
        more = components(mixed).withColumnsRenamed({"doc_id": "class_id", "class_id": "joined"})
        every = every.join(more, "class_id", "left").select("doc_id", F.coalesce("joined", "class_id").alias("class_id"))
    return every


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but the least doc_id of each class."""
    classes = near_duplicates(docs, threshold)
    (gone,) = unused(docs.columns, "_gone")
    dropped = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(gone))
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The class of every document of the whole table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
