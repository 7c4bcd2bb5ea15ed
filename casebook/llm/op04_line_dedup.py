r"""Line deduplication over all documents, in DataFrame operations only.

Lines are exploded with their position, normalised to a key, and hashed to 128 bits. One aggregation, combined before
the shuffle, finds for each hash the documents that hold it; hashes of enough documents are joined back to the lines,
and what must go is gathered per document as positions. A document's text is then put together from the positions that
stay. The hashes are a table in the shared folder, so lines are split once. Hot lines: the aggregation has one row per
hash and task; hashes that hold over a HEAVY-th of all lines, of which there are fewer than HEAVY, are joined by broadcast,
where no key is hot, and the others by hash. No text but the document's own is ever shuffled with a line.

Defined cases: null and empty texts are one empty line; rows with a null doc_id keep all lines and take no part in
counting; rows that share a doc_id are one document (what they hold twice is kept); other columns, whatever their names,
are carried through by ``dedup_lines``, but for ``n_lines`` and ``n_dropped``, which are replaced; an empty table gives
none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.llm.shared import unused, written

#: A hash is heavy with more than this share of all lines, so fewer than this many hashes are.
HEAVY = 1000

#: Fixed value: the characters stripped at both ends of a line, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without outer blanks and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key is long enough; ``row`` tells rows of one doc_id apart."""
    exploded = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")
    )
    keyed = exploded.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def dropped_positions(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, row, drop array<int>) of rows that lose lines: keys of ``min_docs`` documents stay only in the least."""
    lines = written(_lines(docs, min_chars), "line-hashes")
    if min_docs == 2:  # two documents hold a line where the least and the greatest differ
        held = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("lines")).where("keeper < last")
    else:
        by_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("lines"))
        held = by_doc.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"), F.sum("lines").alias("lines")).where(F.col("n") >= min_docs)
    held = written(held.select("h1", "h2", "keeper", "lines"), "line-holders")
    hot = F.col("lines") > lines.count() // HEAVY
    heavy, rest = F.broadcast(held.where(hot).drop("lines")), held.where(~hot).drop("lines")
    key = ["h1", "h2"]
    both = lines.join(heavy, key).unionByName(lines.join(heavy, key, "left_anti").join(rest, key))
    return both.where("doc_id <> keeper").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the kept ``text``, and ``n_lines``, ``n_dropped``."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, row, drop, lines = unused(own, "_doc", "_row", "_drop", "_lines")
    drops = dropped_positions(docs.select("doc_id", "text"), min_chars, min_docs).withColumnsRenamed({"doc_id": doc, "row": row, "drop": drop})
    joined = docs.select(*own).join(drops, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.when(F.col(drop).isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i)), "\n")
    )
    staged = joined.withColumn(lines, F.when(F.col(drop).isNotNull(), split))
    n_lines = F.when(F.col(drop).isNotNull(), F.size(lines)).otherwise(F.size(split))
    n_dropped = F.when(F.col(drop).isNotNull(), F.size(drop)).otherwise(0)
    return staged.select(*[c for c in own if c != "text"], n_lines.cast("bigint").alias("n_lines"), n_dropped.cast("bigint").alias("n_dropped"), kept.alias("text"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's row per document of the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), held AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), flagged AS (
  SELECT l.doc_id, l.pos, l.line, (h.k IS NOT NULL AND h.keeper <> l.doc_id) AS gone
  FROM keyed l LEFT JOIN held h ON l.k = h.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
