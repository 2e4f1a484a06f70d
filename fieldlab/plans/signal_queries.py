"""Registered queries over signals, images and files that Spark makes from the tables, and over streams of predictions."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S
from fieldlab.functions.shipping import by_value
from fieldlab.operators import pieces, ranks, sampling, signal
from fieldlab.plans.more_queries import _folder
from fieldlab.plans.registry import _predictions, query, table
from fieldlab.sources import audio_ranges, file_sink, files, media
from fieldlab.streaming import jobs

RATE = 8000


def _signals(spark, sf_dir):
    """Embeddings as signals; the rate tells the label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), (RATE + F.col("label")).alias("sr"), F.col("embedding").alias("samples"))


def _id(path="path"):
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long").alias("vec_id")


def _recordings(spark, sf_dir) -> str:
    root = _folder(spark, "recordings")
    file_sink.write_files(media.wav_files(_signals(spark, sf_dir)), root)
    return root


@query(f"SELECT vec_id, ({RATE} + label)::INT AS sr, 64::BIGINT AS frames, round(64 / ({RATE} + label), 9) AS duration, 172::BIGINT AS bytes_read FROM embeddings")
def q101_audio_headers(spark, sf_dir):
    """Signals written as WAV files, then known by their headers."""
    h = audio_ranges.audio_headers(spark, _recordings(spark, sf_dir))
    return h.select(_id(), "sr", "frames", F.round("duration", 9).alias("duration"), "bytes_read")


@query(f"""
WITH w AS (SELECT vec_id, embedding, round_even(0.001 * ({RATE} + label), 0)::INT AS a, round_even(0.005 * ({RATE} + label), 0)::INT AS n FROM embeddings),
f AS (SELECT vec_id, unnest(range(a, a + n)) AS frame, embedding FROM w)
SELECT vec_id, frame, frame // 16 AS piece, round(round_even(embedding[frame + 1]::DOUBLE * 32767, 0) / 32768, 9) AS value FROM f
""")
def q102_audio_ranges(spark, sf_dir):
    """Five milliseconds of every recording from the first on, read by pieces of 16 frames."""
    p = audio_ranges.read_audio_pieces(spark, _recordings(spark, sf_dir), offset=0.001, duration=0.005, piece_frames=16)
    each = p.select(_id(), "piece", "start", F.posexplode("samples").alias("i", "x"))
    return each.select("vec_id", (F.col("start") + F.col("i")).alias("frame"), "piece", F.round(F.col("x").cast("double"), 9).alias("value"))


def _bandpass_sql() -> str:
    """The filter's recurrence, a step a sample."""
    b, a = signal.bandpass_coefficients(500.0, 3000.0, RATE)
    new = ", ".join(f"{f'z{i + 1} + ' if i < 4 else ''}{b[i]!r} * x - ({a[i]!r}) * y AS z{i}".replace("np.float64(", "(") for i in range(1, 5))
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings),
r AS (
  SELECT vec_id, 0 AS i, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2, 0.0::DOUBLE AS z3, 0.0::DOUBLE AS z4 FROM e
  UNION ALL
  SELECT vec_id, i, y, {new} FROM (SELECT r.vec_id, r.i + 1 AS i, e.s[r.i + 1] AS x, {float(b[0])!r} * e.s[r.i + 1] + z1 AS y, z1, z2, z3, z4 FROM r JOIN e USING (vec_id) WHERE r.i < 64))
SELECT vec_id, (i - 1)::BIGINT AS i, round(y / max(y) OVER (PARTITION BY vec_id), 6) AS y FROM r WHERE i > 0
"""


@query(_bandpass_sql())
def q103_bandpass_pieces(spark, sf_dir):
    """Signals cut into pieces of 16 samples and band-passed as if whole."""
    s = _signals(spark, sf_dir).withColumn("sr", F.lit(RATE))
    done = pieces.filter_pieces(pieces.in_pieces(s, frames=16), 500.0, 3000.0, kind="double")
    each = done.select(_id(), "start", F.posexplode("samples").alias("i", "y"))
    return each.select("vec_id", (F.col("start") + F.col("i")).alias("i"), F.round("y", 6).alias("y"))


def _images(spark, sf_dir):
    """Embeddings as images of 8 x 8 bytes: columns of the text tell the label."""

    def work(batches):
        for pdf in batches:
            pdf["pixels"] = [np.clip(np.floor(np.asarray(x, dtype=np.float64) * 256 + 128), 0, 255).astype(np.uint8).tobytes() for x in pdf["embedding"]]
            yield pdf[["vec_id", "label", "pixels"]]

    made = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInPandas(work, "vec_id bigint, label int, pixels binary")
    path = F.concat_ws("/", F.when(F.col("vec_id") % 5 == 0, "val").otherwise("train"), F.concat(F.lit("Label"), F.col("label").cast("string")), F.concat(F.col("vec_id").cast("string"), F.lit(".png")))
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("duration"), F.lit("8.0"))
    return made.select("vec_id", path.alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), "pixels", meta.alias("meta"))


_PIXELS = "p AS (SELECT vec_id, label, list_transform(embedding, lambda c: greatest(0, least(255, floor(c::DOUBLE * 256 + 128)))) AS p FROM embeddings)"


def _weights_sql(size: int, new: int) -> str:
    """(o, i, w): how much of each old pixel is in each new one."""
    scale = size / new
    reach = max(scale, 1.0)
    return f"SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, greatest(0, 1 - abs(i + 0.5 - (o + 0.5) * {scale!r}) / {reach!r}) AS w FROM range({new}) a(o), range({size}) b(i))"


@query(f"""
WITH {_PIXELS}, wx AS ({_weights_sql(8, 3)}), wy AS ({_weights_sql(8, 12)}),
px AS (SELECT vec_id, y, x, p[y * 8 + x + 1] AS v FROM p, range(8) a(y), range(8) b(x)),
ax AS (SELECT vec_id, y, o AS x, floor(round(sum(w * v), 9) + 0.5) AS v FROM px JOIN wx ON wx.i = px.x GROUP BY ALL),
ay AS (SELECT vec_id, x, o AS y, floor(round(sum(w * v), 9) + 0.5) AS v FROM ax JOIN wy ON wy.i = ax.y GROUP BY ALL)
SELECT vec_id, (y * 3 + x)::INT AS i, round((v / 255 - 0.5) / 0.25, 5) AS value FROM ay
""")
def q104_resize(spark, sf_dir):
    """Images shrunk across, with antialiasing, and stretched down."""
    r = signal.resize_normalize(_images(spark, sf_dir), 12, 3, mean=0.5, std=0.25)
    return r.select(_id(), F.posexplode("values").alias("i", "value")).select("vec_id", "i", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(f"""WITH {_PIXELS}
SELECT vec_id, label::VARCHAR AS label, list_sum(p)::BIGINT AS total, list_sum([p[i] * i FOR i IN range(1, 65)])::BIGINT AS weighed, 'Label' || label AS class_name,
  CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM p""")
def q105_png_files(spark, sf_dir):
    """Images written as PNG files in folders of splits and classes, listed and read back with their text."""
    root = _folder(spark, "images")
    file_sink.write_files(media.png_files(_images(spark, sf_dir)), root)
    listed = files.labelled_split(files.list_files(spark, root, "*.png")).select("path", "class_name", "split")
    back = media.read_spectrograms(media.load_files(spark, root, "*.png")).join(listed, "path")
    pixel = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("long"))
    back = back.select(_id(), F.col("meta")["label"].alias("label"), pixel.alias("p"), "class_name", "split")
    weighed = F.aggregate(F.transform("p", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return back.select("vec_id", "label", F.aggregate("p", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), weighed.alias("weighed"), "class_name", "split")


@query("""
WITH c AS (SELECT 'Label' || label AS class_name, list_sort(list(DISTINCT CASE WHEN vec_id % 5 = 0 THEN 'val' ELSE 'train' END)) AS d FROM embeddings GROUP BY ALL)
SELECT class_name, array_to_string(d, ',') AS splits, (row_number() OVER (ORDER BY class_name) - 1)::BIGINT AS position FROM c
""")
def q106_class_tree(spark, sf_dir):
    """Classes of a tree of image files, with the splits they are in, in natural order."""
    root = _folder(spark, "images")
    file_sink.write_files(media.png_files(_images(spark, sf_dir)), root)
    samples = files.class_samples(files.list_children(spark, f"{root}/*", "*.png"))
    split = lambda d: F.array_join(F.array_sort(F.transform(d, lambda x: F.regexp_extract(x, r"([^/]+)/[^/]+$", 1))), ",")
    named = files.class_directories(samples).join(files.class_names(samples), "class_name").select("class_name", split(F.col("directories")).alias("splits"))
    return ranks.numbered(named, [S.natural_key("class_name"), "class_name"])


@query("""
WITH s AS (SELECT vec_id, label, run::INT AS run_id, [embedding[i]::DOUBLE * (run + 1) FOR i IN range(1, 11)] AS l FROM embeddings, range(2) r(run))
SELECT vec_id, run_id, (list_position(l, list_max(l)) - 1)::INT AS pred, round(ln(list_sum([exp(x) FOR x IN l])) - l[label + 1], 5) AS loss FROM s
""")
def q107_batch_scores(spark, sf_dir):
    """Two models over all embeddings in batches, with each prediction's loss."""

    def make_predict():
        return lambda run, x: x[:, :10].astype(np.float64) * (run[:, None] + 1)

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    scored = signal.batch_scores(e, make_predict, [64], values="embedding", models=2, label="label")
    return scored.select("vec_id", "run_id", F.col("pred").cast("int").alias("pred"), F.round("loss", 5).alias("loss"))


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT epoch, place FROM range(3) e(epoch), n, range(n) r(place))
SELECT epoch::INT AS epoch, (place % 4)::INT AS replica, place // 4 // 16 AS batch, count(*) AS documents, min(place) AS first_place, max(place) AS last_place, count(*) AS places FROM p GROUP BY ALL
""")
def q108_epoch_orders(spark, sf_dir):
    """Three epochs' orders of the documents, dealt to four replicas in batches of 16, computed from one numbering."""
    d = ranks.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    n = d.count()
    epochs = [sampling.epoch_order(d, n, replicas=4, batch=16, epoch=e).withColumn("epoch", F.lit(e)) for e in range(3)]
    both = epochs[0].unionByName(epochs[1]).unionByName(epochs[2])
    return both.groupBy("epoch", "replica", "batch").agg(F.count(F.lit(1)).alias("documents"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.countDistinct("place").alias("places"))


@query("""
WITH p AS (SELECT vec_id % 3 AS run_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings)
SELECT run_id, round(avg((label = pred)::INT), 9) AS accuracy, (SELECT round(avg(r), 9) FROM (SELECT avg((q.label = q.pred)::INT) AS r FROM p q WHERE q.run_id = p.run_id GROUP BY q.label)) AS balanced_accuracy FROM p GROUP BY run_id
""")
def q109_streaming_tally(spark, sf_dir):
    """Predictions that arrive in four files, scored by run as they come; the last scores of each run."""
    root = _folder(spark, "stream")
    p = _predictions(spark, sf_dir).select((F.col("vec_id") % 3).alias("run_id"), "label", F.col("pred").cast("int").alias("pred"), (F.col("vec_id") % 4).alias("arrival"))
    p.repartition("arrival").write.partitionBy("arrival").parquet(f"{root}/in")
    stream = spark.readStream.schema("run_id bigint, label int, pred int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")

    def keep(scores, epoch):
        scores.select("run_id", "accuracy", "balanced_accuracy").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")

    jobs.start_tally(stream, keep, f"{root}/state-{uuid.uuid4().hex}", by=["run_id"]).awaitTermination()
    last = spark.read.parquet(f"{root}/out").groupBy("run_id").agg(F.max_by(F.struct("accuracy", "balanced_accuracy"), "epoch").alias("s"))
    return last.select("run_id", F.round("s.accuracy", 9).alias("accuracy"), F.round("s.balanced_accuracy", 9).alias("balanced_accuracy"))


by_value(__name__)
