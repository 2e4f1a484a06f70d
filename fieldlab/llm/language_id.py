"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Fitting: n-grams of lower-cased letters are hashed into a fixed number of
dimensions. Document frequencies are counted over all training documents, as
partial sums per task. A sample of at most `per_language` training documents
per language, the first by a hash of their id, is clustered into several
centroids per language by spherical k-means.

Prediction: a text's unit TF-IDF vector goes to the language of the centroid
with the highest cosine, which is the score. For rejection, cosines are
divided by what the text's length lets them reach, in fitting as in prediction.
A text whose distance (1 - that) exceeds, by a margin, what all but a low
quantile of the sampled training documents of its language have is flagged as
rejected; so is a text that is null or has no letter, which gets language `und`
and score 0. Whole texts are read.

Repeated rows each give a row. Ids may be null: rows are sampled by id and text.
Of centroids with the same cosine the first counts, in the order of languages.
Other columns are not read and may have any name. Training rows without a language or a letter
are not used; without any training rows every text is `und`. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.llm.common import by_value, table

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 8
#: A language rejects what lies further away than all but this share of its sample, and this much more.
LOW = 0.01
SLACK = 1.5
#: Cosines of texts of fewer different n-grams than this are proportionally (by root) lower, as chance dominates theirs.
FULL = 600
UNDETERMINED = "und"
#: Languages whose counts are broadcast at most; those of more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; all else than letters as one space between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    other = np.flatnonzero(points >= 128)
    is_letter = ascii_letter
    if len(other):
        kinds, back = np.unique(points[other], return_inverse=True)
        is_letter = ascii_letter.copy()
        is_letter[other] = np.array([chr(c).isalpha() for c in kinds])[back]
    if not is_letter.any():
        return np.empty(0, dtype=np.uint64)
    kept = np.where(is_letter, points, 32).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each word
    return np.concatenate([np.array([32], dtype=np.uint64), kept[keep]])


def counts_of(text: str | None, dimensions: int = DIMENSIONS, orders: tuple[int, ...] = ORDERS) -> np.ndarray | None:
    """How often the n-grams of each dimension occur; None if there is no letter."""
    points = letters_of(text or "")
    if not len(points):
        return None
    out = np.zeros(dimensions, dtype=np.int64)
    for n in orders:
        if len(points) < n:
            break
        h = points[: len(points) - n + 1] + np.uint64(n << 32)
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount((h >> np.uint64(40)).astype(np.int64) % dimensions, minlength=dimensions)
    return out


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-12)).astype(np.float32)


def reach(vectors: np.ndarray) -> np.ndarray:
    """What cosines are divided by for a text's length: 1 from FULL different n-grams on."""
    return np.minimum(1.0, np.maximum(1, np.count_nonzero(vectors, axis=-1)) / FULL) ** 0.5


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means that starts from the mean and then from vectors drawn, by a fixed seed, by their distance from all centres so far."""
    rng = np.random.default_rng(0)
    centres = [vectors.mean(axis=0) / (np.linalg.norm(vectors.mean(axis=0)) + 1e-12)]
    while len(centres) < min(k, len(vectors)):
        far = np.maximum(0.0, 1.0 - (vectors @ np.array(centres).T).max(axis=1).astype(np.float64))
        if far.sum() < 1e-6:
            break
        centres.append(vectors[rng.choice(len(vectors), p=far / far.sum())])
    centres = np.array(centres, dtype=np.float32)
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                m = vectors[own == c].sum(axis=0)
                centres[c] = m / (np.linalg.norm(m) + 1e-12)
    return centres


class Model:
    """idf, centroids, the language of each and the lowest cosine, divided by reach(), that it accepts."""

    def __init__(self, idf, centres, languages, least):
        self.idf, self.centres, self.languages, self.least = idf, centres, languages, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, and whether it is rejected."""
        counts = counts_of(text, len(self.idf))
        if counts is None or not len(self.centres):
            return UNDETERMINED, 0.0, True
        vector = unit(counts, self.idf)
        cosines = self.centres @ vector
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, score < self.least[self.languages[best]] * float(reach(vector))


def fit(
    training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS,
    per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, slack: float = SLACK,
) -> Model:
    """per_language bounds what the task that clusters a language gathers; the driver gets centroids only. Document frequencies come from all training rows."""
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def frequencies(batches):
        total, n = np.zeros(dimensions, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = counts_of(text, dimensions)
                if c is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1), pa.int32()), pa.array(np.append(total, n), pa.int64())], names=["dim", "n"])

    found = dict(rows.select(text_col).mapInArrow(frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n")).collect())
    n = found.get(dimensions, 0)
    idf = np.log((1 + n) / (1 + np.array([found.get(i, 0) for i in range(dimensions)]))) + 0.1

    def vectors(batches):
        for batch in batches:
            got = [(lang, counts_of(t, dimensions)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            got = [(lang, unit(c, idf)) for lang, c in got if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].tobytes() for g in got], pa.binary())], names=["lang", "vector"])

    sample = sample_of(rows, id_col, text_col, lang_col, per_language)

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(sorted(map(bytes, pdf["vector"]))), dtype=np.float32).reshape(-1, dimensions)
        own = cluster(v, centroids)
        least = 1.0 - slack * (1.0 - float(np.quantile(np.minimum(1.0, (v @ own.T).max(axis=1) / reach(v)), LOW)))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centres": [own.astype(np.float32).tobytes()], "least": [least]})

    by_lang = sample.mapInArrow(vectors, "lang string, vector binary").groupBy("lang").applyInPandas(clustered, "lang string, centres binary, least double")
    centres, languages, least = [], [], {}
    for lang, raw, cut in sorted((r.lang, bytes(r.centres), r.least) for r in by_lang.collect()):
        own = np.frombuffer(raw, dtype=np.float32).reshape(-1, dimensions)
        centres.append(own)
        languages += [lang] * len(own)
        least[lang] = cut
    return Model(idf, np.concatenate(centres) if centres else np.empty((0, dimensions), np.float32), languages, least)


def sample_of(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """The rows of each language with the lowest hash of id and text: a threshold per language from the counts, then an exact cut. Columns lang and text."""
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("sample")).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = F.broadcast(counts) if rows.select("lang").distinct().limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else counts
    # twice the rows that are needed, then the lowest of those: no language meets in one task whole
    near = rows.withColumn("place", F.pmod("h", F.lit(1_000_003)) / 1_000_003.0).join(counts, "lang").where(F.col("place") * F.col("n") <= 2 * per_language)
    order = Window.partitionBy("lang").orderBy("place", "h")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("lang", "text")


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(id_col, text_col)

    def work(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that the model does not reject."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches):
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not m.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


by_value(__name__)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Documents that no model learns from: crc32 of the id as text is divisible by `folds`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
