"""Recording collections: maps of species to recordings as JSON, catalog responses, and their flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a recording in all versions of the files; absent ones are null. Fixed values.
FIELDS = (
    "_xeno_canto_id", "genus", "species", "phylo_name", "full_name", "country", "loc", "recording_date", "length", "rating",
    "encoding", "type", "_url", "_filename", "dest_dir", "load_dir", "filepath",
)
#: Fields of a catalog response and the names they get.
RESPONSE = {"id": "_xeno_canto_id", "gen": "genus", "sp": "species", "cnt": "country", "loc": "loc", "date": "recording_date", "length": "length", "q": "rating", "file-name": "_filename", "type": "type", "url": "_url"}


def parse_collection(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of JSON maps species -> recordings to one row per recording; `position` is its place in the species' list."""
    record = ",".join(f"`{f}`:string" for f in FIELDS)
    maps = texts.select(F.from_json(column, f"map<string,array<struct<{record}>>>").alias("m"))
    each = maps.select(F.explode("m").alias("key", "recordings")).select("key", F.posexplode("recordings").alias("position", "r"))
    return each.select("position", "r.*").withColumn("phylo_name", F.col("phylo_name")).select(*FIELDS, "position")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return parse_collection(spark.read.text(path, wholetext=True))


def read_catalog_response(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of catalog responses under the names of a collection."""
    record = ",".join(f"`{f}`:string" for f in RESPONSE)
    raw = spark.read.schema(f"numSpecies string, recordings array<struct<{record}>>").json(path, multiLine=True)
    each = raw.select(F.explode("recordings").alias("r"))
    named = each.select(*[F.col("r").getField(k).alias(v) for k, v in RESPONSE.items()])
    phylo = F.concat("genus", "species")
    return named.withColumn("phylo_name", phylo).withColumn("full_name", F.concat(phylo, F.lit("_xc"), F.col("_xeno_canto_id")))


def collection_json(recordings: DataFrame, *, species: str = "phylo_name", order: str = "position", fields: tuple[str, ...] | None = None) -> DataFrame:
    """(species, value): each species' recordings in order as a JSON array; only string columns are kept. A species is one row, not the collection one value."""
    names = fields or tuple(f.name for f in recordings.schema if f.dataType.simpleString() == "string")
    record = F.struct(order, F.struct(*names).alias("r"))
    lists = recordings.groupBy(species).agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("_list"))
    return lists.select(species, F.to_json("_list").alias("value"))


def write_collection(recordings: DataFrame, path: str, **options) -> None:
    """JSON lines, each a map of one species to its recordings, which read_collection reads back."""
    lists = collection_json(recordings, **options)
    key, value = lists.columns
    line = F.concat(F.lit("{"), F.to_json(F.array(F.col(key))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key)))) - 2), F.lit(":"), F.col(value), F.lit("}"))
    lists.select(line.alias("value")).write.mode("overwrite").text(path)


def read_collection_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_collection(spark.read.text(path))
