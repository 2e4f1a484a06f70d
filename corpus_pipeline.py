"""A corpus pipeline: language identification, near-duplicate removal, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads again as the next stage's documents. All columns,
whatever their names, are kept by all stages but the last; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm import decontamination, language_id, mixing, near_dedup, sharding
from fieldlab.llm.common import Scratch, table, with_row_key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or too far from all languages.

    A null, empty or letterless text goes. Ids, sources and languages may be
    null; rows with a null language are judged but not learned from, and
    without any to learn from all go. Repeated rows stay or go together.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8.

    The one with the smallest id stays. Rows that share an id are one document
    and stay or go together; rows with a null id, and texts without words, are
    linked with nothing and stay.
    """
    return near_dedup.near_dedup(docs, k=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go.

    Each row is judged by its own text, so nulls elsewhere and repeated rows
    make no difference; a null or empty text stays.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, to the nearest.

    A null source is a source, the last one. Texts without words are never
    taken. Rows have a key of their own, so ids may be null or repeated.
    """
    keyed, key = with_row_key(docs)
    keyed = Scratch(spark, "mixing").keep(keyed, "rows")
    copies = F.expr("(2 * taken + size) div (2 * size)").cast("int").alias(f"{key}_copies")
    taken = mixing.mix(keyed, row_col=key).where("taken > 0").select(key, copies).where(F.col(f"{key}_copies") > 0)
    repeated = keyed.join(taken, key).select(*docs.columns, F.explode(F.sequence(F.lit(1), f"{key}_copies")).alias(f"{key}_copy"))
    return repeated.select(*docs.columns)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Target-sized shards under a manifest; the result says where each document is.

    Nulls and repeated rows are kept as they are, a row each.
    """
    return sharding.shard(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: SQL can't express the fitted language model or the compaction.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.keep(out, name) if i < len(STAGES) - 1 else out
    return docs
