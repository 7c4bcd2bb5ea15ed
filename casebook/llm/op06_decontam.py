"""Benchmark decontamination by canonical templates.

A text becomes tokens in several views: ``literal`` (every word in lower case, whatever its case), ``typed`` (numbers, that
is digits and number words, names, that is capitalised words that start no sentence, runs of them being one, and units
after a number become placeholders), ``opened`` (likewise, but a capitalised word is a name wherever it stands, except
common words), and ``counted`` (only numbers and units become placeholders, so case plays no part). Windows of ``width``
tokens (literal, and typed with at least ``literals`` that are no placeholders) and of SHORT_WIDTH tokens (literal, opened,
counted) are hashed; an item of fewer than SHORT_WIDTH words is one window of its own length. Documents' windows pass a
bitmap of fixed size built from the benchmark's, then a hash join with the benchmark's windows.

What a placeholder stood for goes along as a slot. Evidence is put together by alignment (document position minus item
position), by bands of neighbouring alignments (words put in or left out) and over the document; slots must map one to
one within it, so that a question with other numbers or names is caught while a text that merely fits the template is
not. Evidence is enough with ``min_windows`` windows of ``width`` (six windows of eight tokens are 13 tokens in a row) or
``min_share`` of them, or, by short windows on one alignment or band, where these cover as many tokens and MIN_COVER of the
item; items of fewer than ``width`` tokens only count where they stand word for word. Views that type no names are held
against those that do: where these show one name or number standing for two at the same place, only the entire item
word for word counts.

Work per document is linear; only windows in the bitmap leave the scan. The benchmark is joined, not broadcast by
force, so its size is free; a passage in a third of all documents is a hot join key of slim rows, which AQE splits, and
groups are (document, item, alignment).

Limits: an item of 8 to about 11 tokens with a changed word in its middle is not found, as less than MIN_COVER of it or
than the demanded tokens lies in windows; nor are names changed in a text whose case carries no information. An item of
a word or two is held by every document with these words in a row.

Defined cases: null and empty texts have no windows; rows that share a doc_id are one document, null doc_ids are one
group with a null doc_id; repeated items count once; other columns are ignored; an empty benchmark finds nothing.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from casebook.llm import textblock as tb

WIDTH, LITERALS, MIN_WINDOWS, MIN_SHARE = 8, 5, 6, 0.5
#: Shorter windows, and the share of an item's tokens that they must cover on one alignment.
SHORT_WIDTH, SHORT_LITERALS, MIN_COVER = 5, 3, 0.6
#: Alignments this far apart can be one occurrence with words put in or left out.
BAND = 4
BITMAP_BITS = 25
SLICE_CHARS = 100_000
#: Words for numbers, and words for units after a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = "mm cm m km mg g kg lb lbs oz ml l inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years mph kph dollar dollars cent cents euro euros percent degree degrees".split()
#: Words that are no names where they are capitalised.
COMMON_WORDS = "a about after all also an and any are as at be because before both but by can could did do does each every few find five for four from had has have he her here his how however i if in into is it its many more most much my no nor not now of on once one only or other our she should since so some suppose than that the their them then there these they this those though three through to two under until was we were what when where which while who whom whose why will with would yet you your".split()
#: Letters that capitals change into others.
FOLDS = [("ß", "ss"), ("ẞ", "SS"), ("ς", "σ"), ("ſ", "s"), ("ı", "i"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("µ", "μ")]
NUMBER, NAME, UNIT = 1, 2, 3
LITERAL, TYPED, OPENED, COUNTED = range(4)
#: Numbers of window sets by what they are; whole-item sets are WHOLE plus the width.
LITERAL_SETS, SHORT_SETS, NAMED_SETS, WHOLE = [1, 3], [3, 4, 5], [2, 4], 100
WINDOWS = "id bigint, s int, pos int, word int, n int, h bigint, slots array<bigint>"


@lru_cache(1)
def _upper() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c)) in ("Lu", "Lt") for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def _word_hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.sort(tb.Words(NUMBER_WORDS).hash), np.sort(tb.Words(UNIT_WORDS).hash), np.sort(tb.Words(COMMON_WORDS).hash)


def folded(text: str | None) -> str:
    """A text with the letters whose capitals are other letters spelt as their capitals' lower case."""
    text = text or ""
    if not text.isascii():
        for a, b in FOLDS:
            text = text.replace(a, b)
    return text


def typed(words: tb.Words, view: int = TYPED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch in a view: canonical hash of each token, its kind (0: literal), what it stood for, each text's first
    token, and each token's first word."""
    n = len(words.hash)
    kind = np.zeros(n, np.int8)
    if not n or view == LITERAL:
        return words.hash, kind, words.hash, words.first, np.arange(n)
    kinds = tb.classes()
    numbers, units, common = _word_hashes()
    kind[(kinds[words.cps[words.start]] == tb.NUMBER) | np.isin(words.hash, numbers)] = NUMBER
    heads = np.zeros(n, bool)
    heads[words.first[:-1][words.first[:-1] < n]] = True
    after_number = np.zeros(n, bool)
    after_number[1:] = kind[:-1] == NUMBER
    kind[after_number & ~heads & (kind == 0) & np.isin(words.hash, units)] = UNIT
    # a sentence starts where a stop stands between the last word and this one
    stop = np.isin(words.cps, np.array([ord(c) for c in ".!?\n:;\"«“„|"], np.uint32))
    stops = np.concatenate([[0], np.cumsum(stop)])
    starts = heads.copy()
    starts[1:] |= stops[words.start[1:]] > stops[words.end[:-1]]
    if view != COUNTED:
        plain = starts if view == TYPED else np.isin(words.hash, common)
        kind[(kind == 0) & _upper()[words.cps[words.start]] & ~plain] = NAME
    follow = np.zeros(n, bool)
    follow[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & ~starts[1:]
    keep = np.flatnonzero(~follow)
    run_end = np.append(keep[1:], n) - 1
    value = words.hash[keep]
    many = run_end > keep
    if many.any():  # a run of names stands for the sum of its words in order
        weighted = words.hash * (np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
        plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash, dtype=np.uint64)])
        base = (keep.astype(np.uint64)) * np.uint64(2)
        run = (sums[run_end + 1] - sums[keep]) - base * (plain[run_end + 1] - plain[keep])
        value = np.where(many, tb.mix(run), value)
    kind = kind[keep]
    place = np.array([0, 0xA11CE5, 0xB0B5, 0xCAFE], np.uint64)
    return np.where(kind == 0, value, tb.mix(place[kind])), kind, value, np.searchsorted(keep, words.first), keep


def windows(tokens, number: int, width: int, literals: int):
    """(text, index of the first token, hash) of all windows of kind ``number`` with enough literals in a batch."""
    canon, kind, _, first, _ = tokens
    n = len(canon) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, number, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for k in range(width):
        h += canon[k : k + n] * np.uint64(pow(factor, k + 1, 1 << 64))
    h = tb.mix(h)
    lit = np.concatenate([[0], np.cumsum(kind == 0)])
    enough = lit[width:] - lit[:-width] >= literals
    text = np.searchsorted(first, np.arange(n), "right") - 1
    whole = np.arange(n) + width <= first[np.minimum(text + 1, len(first) - 1)]
    at = np.flatnonzero(enough & whole)
    return text[at], at, h[at]


def window_table(texts: DataFrame, key: str, sets: dict[int, tuple[int, int, int]], bitmap=None) -> DataFrame:
    """WINDOWS of a table's texts, of each set (number: view, width, literals); with ``bitmap`` (a broadcast of bytes)
    only those whose hash is in it, without it those of whole-item sets only where they are the entire text."""

    def run(batches):
        import pyarrow as pa

        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        for batch in batches:
            ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part, rows in tb.batches(all_texts, ids, SLICE_CHARS):
                words = tb.Words([folded(t) for t in part])
                views = {view: typed(words, view) for view in {v for v, _, _ in sets.values()}}
                for number, (view, width, literals) in sets.items():
                    tokens = views[view]
                    _, kind, value, first, keep = tokens
                    text, at, h = windows(tokens, number, width, literals)
                    size = np.diff(first)[text]
                    if bits is not None:
                        bit = h & np.uint64((1 << BITMAP_BITS) - 1)
                        hit = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    else:
                        hit = (size == width) | (number < WHOLE)
                    text, at, h, size = text[hit], at[hit], h[hit], size[hit]
                    if not len(text):
                        continue
                    grid = at[:, None] + np.arange(width)
                    filled = kind[grid] > 0
                    offsets = np.concatenate([[0], np.cumsum(filled.sum(1))]).astype(np.int32)
                    slots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[grid][filled].view(np.int64)))
                    columns = [
                        pa.array([rows[i] for i in text.tolist()], pa.int64()), pa.array(np.full(len(text), number, np.int32)),
                        pa.array((at - first[text]).astype(np.int32)), pa.array((keep[at] - words.first[text]).astype(np.int32)),
                        pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), slots,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "s", "pos", "word", "n", "h", "slots"])

    return texts.select(F.col(key).cast("bigint"), F.col("text").cast("string")).mapInArrow(run, WINDOWS)


def _bitmap(items: DataFrame) -> bytes:
    """Bits of the items' hashes: 2^BITMAP_BITS of them whatever the benchmark's size."""
    bit = F.col("h").bitwiseAND((1 << BITMAP_BITS) - 1)
    parts = items.select(F.bitmap_bucket_number(bit + 1).alias("b"), F.bitmap_bit_position(bit + 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = bytearray((1 << BITMAP_BITS) // 8)
    for r in parts.collect():
        out[(r.b - 1) * 4096 : r.b * 4096] = r.bits
    return bytes(out)


def _scopes(place):
    """Where evidence is put together: one alignment, two ways of bands of four alignments, and the whole document."""
    return F.array(*[F.struct(F.lit(scope).alias("scope"), at.cast("int").alias("place")) for scope, at in (("one", place), ("band", F.floor(place / BAND)), ("shifted", F.floor((place + BAND // 2) / BAND)), ("document", F.lit(0)))])


def _judged(groups: DataFrame, width: int, min_windows: int, min_share: float) -> DataFrame:
    """Of evidence groups (at, links, s, n, item_windows, scope): n_windows, share, same, one_to_one, full, enough."""
    literal = F.col("s").isin(LITERAL_SETS) | (F.col("s") > WHOLE)
    short = F.col("s").isin(SHORT_SETS)
    wide = F.when(short, SHORT_WIDTH).otherwise(F.lit(width))
    covered = F.aggregate(
        F.array_sort("at"), F.struct(F.lit(-(1 << 30)).alias("last"), F.lit(0).alias("sum")),
        lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(wide, x - acc["last"])).cast("int").alias("sum")), lambda acc: acc["sum"],
    )
    n, size = F.col("n"), F.size("links")
    # as many tokens as the demanded windows hold when they follow each other, all tokens of an item without any
    need = F.when(n < width, n).otherwise(F.least(F.lit(width + min_windows - 1), F.ceil((n - width + 1) * min_share) + width - 1))
    need = F.greatest(need, F.ceil(n * MIN_COVER))
    by_windows = (F.col("n_windows") >= min_windows) | (F.col("share") >= min_share)
    by_cover = (F.col("scope") != "document") & (literal | (n >= width)) & (covered >= need)
    out = groups.withColumn("n_windows", F.size("at").cast("bigint")).withColumn("share", F.col("n_windows") / F.col("item_windows"))
    return out.select(
        "*", F.forall("links", lambda x: x["slots"] == x["item_slots"]).alias("same"), literal.alias("literal"),
        ((size == F.size(F.array_distinct("links.slots"))) & (size == F.size(F.array_distinct("links.item_slots")))).alias("one_to_one"),
        (literal & (F.col("scope") == "one") & (F.col("n_windows") == F.col("item_windows"))).alias("full"),
        F.when(F.col("s") > WHOLE, True).when(short, by_cover).otherwise(by_windows).alias("enough"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS, min_windows: int = MIN_WINDOWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, share, kind) of each document and item it holds; kind: exact, or
    template where a slot is filled otherwise. Counts are those of the accepted evidence with the largest share."""
    spark = docs.sparkSession
    sets = {1: (LITERAL, width, width), 2: (TYPED, width, literals), 3: (LITERAL, SHORT_WIDTH, SHORT_WIDTH), 4: (OPENED, SHORT_WIDTH, SHORT_LITERALS), 5: (COUNTED, SHORT_WIDTH, SHORT_LITERALS)}
    whole = {WHOLE + k: (LITERAL, k, k) for k in range(1, SHORT_WIDTH)}
    items = window_table(benchmark, "item_id", sets | whole).withColumnsRenamed({"id": "item_id", "pos": "item_pos", "word": "item_word", "slots": "item_slots"}).distinct()
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    used = {r.s for r in items.where(F.col("s") > WHOLE).select("s").distinct().collect()}
    sizes = items.groupBy("item_id", "s").agg(F.countDistinct("item_pos").alias("item_windows"), F.max("n").alias("size"))
    items = items.join(sizes, ["item_id", "s"]).drop("n").withColumnRenamed("size", "n")
    found = window_table(docs, "doc_id", sets | {k: v for k, v in whole.items() if k in used}, bitmap).withColumnRenamed("id", "doc_id").drop("n")
    pairs = found.join(items, ["h", "s"])
    link = F.arrays_zip("slots", "item_slots")
    keys = ["doc_id", "item_id", "s", "item_windows", "n"]
    aligned = pairs.groupBy(*keys, (F.col("pos") - F.col("item_pos")).alias("line"), (F.col("word") - F.col("item_word")).alias("word_line")).agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(link))).alias("links"))
    # evidence by aligned tokens; what typed views say of slots also by aligned words, to hold against the other views
    own = F.transform(_scopes(F.col("line")), lambda x: F.struct(x["scope"].alias("scope"), x["place"].alias("place"), F.col("s").isin(NAMED_SETS).alias("named"), F.lit(True).alias("counts")))
    said = F.transform(_scopes(F.col("word_line")), lambda x: F.struct(x["scope"].alias("scope"), x["place"].alias("place"), F.lit(False).alias("named"), F.lit(False).alias("counts")))
    scoped = aligned.select("*", F.explode(F.when(F.col("s").isin(NAMED_SETS), F.concat(own, said)).otherwise(own)).alias("g")).select(*keys, "g.*", "at", "links")
    groups = scoped.groupBy(*keys, "scope", "place", "named", "counts").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    judged = _judged(groups, width, min_windows, min_share)
    evidence = F.struct("full", "one_to_one", "share", "n_windows", "item_windows", "same")
    claims = judged.groupBy("doc_id", "item_id", "scope", "place", "named").agg(
        F.collect_list(F.when(F.col("counts") & F.col("enough") & F.col("one_to_one"), evidence)).alias("claims"),
        F.bool_or(~F.col("one_to_one")).alias("bad"), F.bool_and("same").alias("all_same"),
    ).select("doc_id", "item_id", "named", "bad", "all_same", F.explode("claims").alias("c"))
    # a claim without names stands where no view contradicts it, or where it is the entire item
    sound = claims.where(F.col("named") | ~F.col("bad") | F.col("c.full"))
    exact = F.col("c.full") | F.when(F.col("named"), F.col("c.same")).otherwise(F.col("all_same"))
    best = sound.groupBy("doc_id", "item_id").agg(F.max(F.struct(exact.alias("exact"), F.col("c.share").alias("share"), F.col("c.n_windows").alias("n_windows"), F.col("c.item_windows").alias("item_windows"))).alias("b"))
    return best.select("doc_id", "item_id", "b.n_windows", "b.item_windows", F.round("b.share", 4).alias("share"), F.when(F.col("b.exact"), "exact").otherwise("template").alias("kind"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, item) pair of the whole tables."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
