"""Exact deduplication by recipes of content-defined chunks, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. A text is cut where its
own content says so, chunks become identifiers, and documents are compared by
their ordered lists of identifiers. The text itself never leaves the task that
read it: only digests and identifiers are shuffled.

Null counts as empty text; empty texts have an empty recipe and are equal.
Repeated rows are copies of each other and exactly one stays: the largest id
wins, and of rows with that id one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import LOWER, UPPER, Scratch, ascii_lower, table

#: Characters of a chunk: at least, at most.
LEAST, MOST = 512, 8192


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A chunk ends at the first white space before a vowel after `least` characters, at the end of the text, or at `most` characters."""
    return rf"(?s).{{{least},{most}}}?(?:[ \n](?=[aeiou])|\z)|.{{1,{most}}}"


def recipes(rows: DataFrame) -> DataFrame:
    """(row, chunks: array of struct<h, n, s>) to (row, recipe: ordered list of chunk identifiers).

    A chunk's identifier is the place where its content first occurs. Chunks
    share one only if hash, length and SHA-256 all agree, which verifies that
    equal identifiers stand for equal content.
    """
    each = rows.select("row", F.posexplode("chunks").alias("pos", "chunk")).select("row", "pos", "chunk.*")
    known = each.groupBy("h", "n", "s").agg(F.min(F.struct("row", "pos")).alias("chunk_id"))
    named = each.join(known, ["h", "n", "s"]).select("row", F.struct("pos", "chunk_id").alias("part"))
    return named.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["chunk_id"]).alias("recipe"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks."""
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    cut = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("cut"))
    digests = F.transform("cut", lambda c: F.struct(F.xxhash64(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("s")))
    rows = cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", digests.alias("chunks"))
    rows = Scratch(docs.sparkSession, "exact").keep(rows, "chunks")

    listed = rows.select("row", "doc_id", "text_sha256").join(recipes(rows), "row", "left")
    empty = F.array().cast("array<struct<row:bigint,pos:int>>")
    listed = listed.withColumn("recipe", F.coalesce("recipe", empty))
    groups = listed.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return listed.join(groups, "recipe").select(
        F.col("doc_id").alias(id_col), F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"),
    )


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
