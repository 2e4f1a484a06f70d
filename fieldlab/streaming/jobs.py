"""Streams: tallies that refresh as predictions arrive, and spectrograms of new recordings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from fieldlab.functions.shipping import by_value
from fieldlab.operators.evaluate import summary_scores
from fieldlab.operators.signal import create_spectrograms
from fieldlab.sources.stores import contents

BY = ("run_id", "step", "phase")
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Seconds without a prediction after which a group's tally is forgotten.
KEEP_SECONDS = 7 * 24 * 3600
#: Keyed state needs this store. Batches without data would follow each other for as long as timers exist, so a trigger of what is available would never end; timers fire in the next batch with data.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class Tally(StatefulProcessor):
    """Confusion counts of one group; a batch changes the cells it has predictions of and moves the group's end of life."""

    def __init__(self, by: list[str], cell: StructType, keep_seconds: float):
        self.by, self.cell, self.keep = by, cell, int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", self.cell, StructType([StructField("n", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[tuple, int] = {}
        for pdf in rows:
            for cell, n in pdf.groupby(["truth", "pred"]).size().items():
                new[cell] = new.get(cell, 0) + int(n)
        for cell, n in new.items():
            cell = tuple(v.item() if hasattr(v, "item") else v for v in cell)
            self.counts.updateValue(cell, ((self.counts.getValue(cell)[0] if self.counts.containsKey(cell) else 0) + n,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
        cells = [(*key, *cell, value[0]) for cell, value in self.counts.iterator()]
        yield pd.DataFrame(cells, columns=[*self.by, "truth", "pred", "n"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        yield from ()

    def close(self) -> None:
        pass


def tally_changes(predictions: DataFrame, by: Sequence[str] = BY, *, label: str = "label", pred: str = "pred", keep_seconds: float = KEEP_SECONDS) -> DataFrame:
    """A stream of (by..., truth, pred, n): all cells of the groups that a batch has predictions of, and no others.

    Each group's counts live in the state store, at most classes squared of
    them. A group that has had no prediction for keep_seconds is forgotten: a
    later one begins a new tally. Predictions without truth or decision don't
    count.
    """
    by = list(by)
    rows = predictions.select(*by, F.col(label).alias("truth"), F.col(pred).alias("pred")).where("truth IS NOT NULL AND pred IS NOT NULL")
    cell = StructType([StructField(c, rows.schema[c].dataType) for c in ("truth", "pred")])
    out = StructType([*(StructField(c, rows.schema[c].dataType) for c in by), *cell.fields, StructField("n", LongType())])
    return rows.groupBy(*by).transformWithStateInPandas(Tally(by, cell, keep_seconds), out, "Update", "ProcessingTime")


def start_tally(
    predictions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, by: Sequence[str] = BY, zero_division: float = 1.0, *,
    label: str = "label", pred: str = "pred", keep_seconds: float = KEEP_SECONDS, **trigger,
):
    """Starts a query that hands the scores of every (run, step, phase) that has changed to sink(scores, epoch) after each batch.

    A restart from the checkpoint goes on with the counts it holds. A batch
    that is run again hands over the same scores, so a sink should replace
    what it has of a group.
    """

    def refresh(changed: DataFrame, epoch: int) -> None:
        changed = changed.persist()  # read by several actions of a sink
        try:
            sink(summary_scores(changed, zero_division, by), epoch)
        finally:
            changed.unpersist()

    spark = predictions.sparkSession
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():  # a query keeps what holds when it starts
        spark.conf.set(k, v)
    try:
        counts = tally_changes(predictions, by, label=label, pred=pred, keep_seconds=keep_seconds)
        return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(refresh).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _quarantine(output: str, quarantine: str | None) -> str:
    return quarantine or f"{output.rstrip('/')}-quarantine"


def start_ingest(spark: SparkSession, recordings: str, output: str, checkpoint: str, pattern: str = "*.wav", *, quarantine: str | None = None, **trigger):
    """Starts a query that writes a spectrogram row for each recording not seen before; the checkpoint remembers which were.

    Recordings that fail go to the quarantine, a table (path, error, batch)
    beside the output by default, and not to the output; `retry_quarantined`
    tries them again.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(recordings)
    held = _quarantine(output, quarantine)

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again replaces its own folders
        made = create_spectrograms(batch).persist()
        try:
            made.where("error IS NULL").write.mode("overwrite").parquet(f"{output}/batch={epoch}")
            made.where("error IS NOT NULL").select("path", "error").write.mode("overwrite").parquet(f"{held}/batch={epoch}")
        finally:
            made.unpersist()

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def quarantined(spark: SparkSession, output: str, quarantine: str | None = None) -> DataFrame:
    """(path, error): recordings that failed, with the last error, and have no spectrogram yet."""
    bad = spark.read.option("basePath", _quarantine(output, quarantine)).parquet(f"{_quarantine(output, quarantine)}/*").groupBy("path").agg(F.max_by("error", "batch").alias("error"))
    return bad.join(spark.read.parquet(f"{output}/*").select("path"), "path", "left_anti")


def retry_quarantined(spark: SparkSession, output: str, quarantine: str | None = None) -> DataFrame:
    """Reads quarantined recordings again: those that are fine now get their spectrogram; returns (path, error) of what still fails."""
    made = create_spectrograms(contents(quarantined(spark, output, quarantine).select("path")))
    # one file name per try, so that a try that breaks off leaves nothing half done
    made.where("error IS NULL").write.parquet(f"{output}/batch=retry-{uuid.uuid4().hex}")
    return quarantined(spark, output, quarantine)


by_value(__name__)
