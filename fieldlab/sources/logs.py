"""Prediction logs, run logs, confusion matrices and metric files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S

PHASES = {"train": "training", "val": "validating"}


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """(run properties, file, step, phase, position, pred, label): one row per prediction of each epoch and phase."""
    raw = spark.read.csv(path, header=True, schema="epoch int, train_preds string, train_labels string, val_preds string, val_labels string", quote='"', escape='"')
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    ints = lambda c: F.from_json(F.col(c), "array<int>")
    phases = F.array(*[F.struct(F.lit(long).alias("phase"), F.arrays_zip(ints(f"{short}_preds").alias("pred"), ints(f"{short}_labels").alias("label")).alias("rows")) for short, long in PHASES.items()])
    each = raw.select("file", F.col("epoch").alias("step"), F.explode(phases).alias("p")).select("file", "step", "p.phase", F.posexplode("p.rows").alias("position", "r"))
    return each.select("file", S.parse_run_filename("file").alias("run"), "step", "phase", "position", F.col("r.pred").alias("pred"), F.col("r.label").alias("label"))


def prediction_log(predictions: DataFrame) -> DataFrame:
    """The table of a prediction log: one row per step, lists as text in the order of position. The format has all predictions of a step in one row, so they meet in one task."""
    lists = lambda c, p: F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("phase") == p, F.struct("position", c)))), lambda x: x[c]))
    columns = [lists(c, long).alias(f"{short}_{c}s") for short, long in PHASES.items() for c in ("pred", "label")]
    return predictions.groupBy(F.col("step").alias("epoch")).agg(*columns).orderBy("epoch")


def write_prediction_log(predictions: DataFrame, path: str) -> None:
    prediction_log(predictions).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_run_log(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """JSON lines of value arrays under a header array; fields: (name, type) in the header's order."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    values = F.from_json("value", "array<string>")
    rows = raw.select(values.alias("v")).where(F.element_at("v", 1) != fields[0][0])
    simple = lambda t: t in ("string", "int", "bigint", "double", "boolean")
    cell = lambda i, t: F.get("v", F.lit(i)) if t == "string" else (F.get("v", F.lit(i)).try_cast(t) if simple(t) else F.from_json(F.get("v", F.lit(i)), t))
    return rows.select(*[cell(i, t).alias(n) for i, (n, t) in enumerate(fields)])


def write_run_log(rows: DataFrame, path: str, order: str) -> None:
    """The header array, then one array of values per row in the given order. One file: a log has one line per epoch."""
    names = rows.columns
    header = rows.sparkSession.createDataFrame([(0, None)], "_a int, _o string").select("_a", F.lit(None).cast(rows.schema[order].dataType).alias("_o"), F.to_json(F.array(*[F.lit(n) for n in names])).alias("value"))
    parts = [F.substring(F.to_json(F.array(F.col(n))), F.lit(2), F.length(F.to_json(F.array(F.col(n)))) - 2) for n in names]
    body = rows.select(F.lit(1).alias("_a"), F.col(order).alias("_o"), F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("value"))
    header.unionByName(body).orderBy("_a", "_o").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_confusion_csv(spark: SparkSession, path: str, *, file_col: str | None = None) -> DataFrame:
    """(truth, pred, n): square matrices with or without a comma before the header's labels; field 0 names the row.

    Each file is a matrix with a header of its own. file_col: a column with
    the file's name, to tell several apart.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    cells = F.transform(F.split("value", ","), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    lines = raw.select(F.col("_metadata.file_path").alias("_file"), place.alias("_i"), cells.alias("c"))
    header = lines.groupBy("_file").agg(F.min_by("c", "_i").alias("h"), F.min("_i").alias("_first"), F.max(F.size("c")).alias("w"))
    labels = F.slice(F.col("h"), F.size("h") - F.col("w") + 2, F.col("w") - 1)
    body = lines.join(header, "_file").where(F.col("_i") != F.col("_first"))
    each = body.select("_file", F.element_at("c", 1).alias("truth"), F.explode(F.arrays_zip(labels.alias("pred"), F.slice("c", 2, F.col("w") - 1).alias("n"))).alias("x"))
    named = [F.regexp_extract("_file", "([^/]+)$", 1).alias(file_col)] if file_col else []
    return each.select(*named, "truth", F.col("x.pred").alias("pred"), F.col("x.n").cast("double").alias("n"))


def metric_rows(summary: DataFrame, class_scores: DataFrame | None = None) -> DataFrame:
    """(measure, class_id, value) of a one-row summary and of per-class scores."""
    long = summary.unpivot([], summary.columns, "measure", "value").select("measure", F.lit(None).cast("string").alias("class_id"), F.col("value").cast("double").alias("value"))
    if class_scores is None:
        return long
    each = class_scores.select(F.col("cls").cast("string").alias("class_id"), "precision", "recall", "f1").unpivot("class_id", ["precision", "recall", "f1"], "measure", "value")
    return long.unionByName(each.select("measure", "class_id", "value"))


def write_metric_csv(summary: DataFrame, path: str, class_scores: DataFrame | None = None) -> None:
    metric_rows(summary, class_scores).write.mode("overwrite").csv(path, header=True)
