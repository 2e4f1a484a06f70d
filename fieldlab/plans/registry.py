"""All registered queries of the library and their SQL.

Every query reads the standard tables whole. Where the library's operators ask
for recordings, samples or predictions, these are derived from the tables:
events are annotations on users' timelines, embeddings are signals and logits,
documents are samples of a language, orders are artefacts of a customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S
from fieldlab.operators import augment, counts, evaluate, filters, intervals, lookups, ordering, sampling, windows
from fieldlab.sources import collections

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers the function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _micros(ts: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def _seconds(ts: str):
    return _micros(ts) / 1e6


# ---- intervals --------------------------------------------------------------
HOUR = 3600.0


@query(f"""
WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events),
u AS (SELECT user_id, floor(min(t) / {3 * HOUR}) * {3 * HOUR} AS lo, max(t) AS hi FROM e GROUP BY user_id),
s AS (SELECT user_id, i AS snippet_id, lo + i * {3 * HOUR} AS s, lo + i * {3 * HOUR} + {6 * HOUR} AS f
  FROM (SELECT *, unnest(range(0, (floor((hi - lo) / {3 * HOUR}) + 1)::BIGINT)) AS i FROM u)),
a AS (SELECT user_id, event_id, t AS b, t + {2 * HOUR} AS f, event_type AS label FROM e WHERE event_type IN ('error', 'purchase')),
j AS (SELECT s.*, a.b, a.f AS af, a.label, a.event_id, row_number() OVER (PARTITION BY s.user_id, s.snippet_id ORDER BY a.b, a.f, a.label) AS nth
  FROM s JOIN a ON a.user_id = s.user_id AND a.b <= s.f AND a.f > s.s),
g AS (SELECT user_id, snippet_id, s, f, min(label) FILTER (nth = 1) AS first_label, list_sort(list_distinct(list(label))) AS labels FROM j GROUP BY ALL),
o AS (SELECT s.user_id, s.snippet_id, s.s AS start_s, s.f AS end_s, coalesce(first_label, 'noise') AS first_label, coalesce([x FOR x IN labels IF x <> first_label], []) AS m
  FROM s LEFT JOIN g ON g.user_id = s.user_id AND g.snippet_id = s.snippet_id)
SELECT user_id, snippet_id, start_s, end_s, first_label AS label, array_to_string(m, ',') AS mix, true AS is_primary FROM o
UNION ALL SELECT user_id, snippet_id, start_s, end_s, unnest(m), array_to_string(m, ','), false FROM o
""")
def q01_label_by_overlap(spark, sf_dir):
    """Six-hour snippets every three hours of each user's timeline, labelled by errors and purchases that last two hours."""
    e = table(spark, sf_dir, "events").withColumn("t", _seconds("ts"))
    users = e.groupBy("user_id").agg((F.floor(F.min("t") / (3 * HOUR)) * 3 * HOUR).alias("lo"), F.max("t").alias("hi"))
    snippets = users.withColumn("snippet_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / (3 * HOUR)))))
    snippets = snippets.withColumn("start_s", F.col("lo") + F.col("snippet_id") * 3 * HOUR).withColumn("end_s", F.col("start_s") + 6 * HOUR)
    notes = e.where(F.col("event_type").isin("error", "purchase")).select("user_id", F.col("t").alias("begin"), (F.col("t") + 2 * HOUR).alias("finish"), "event_type")
    out = intervals.label_by_overlap(snippets, notes, keys=["user_id"], start="start_s", end="end_s", label="event_type", mix=None, part_rows=4096)
    return out.withColumn("mix", F.array_join("mix", ","))


@query(f"""
WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events),
i AS (SELECT user_id, t AS low, t + {HOUR} AS high, event_id AS idx FROM e WHERE event_type = 'signup')
SELECT e.event_id, coalesce(max(i.idx), -1) AS interval FROM e LEFT JOIN i ON i.user_id = e.user_id AND i.low <= e.t AND e.t < i.high
GROUP BY e.event_id
""")
def q02_point_in_interval(spark, sf_dir):
    """For every event, the latest of the user's hours after a signup that holds it."""
    e = table(spark, sf_dir, "events").withColumn("t", _seconds("ts"))
    hours = e.where("event_type = 'signup'").select("user_id", F.col("t").alias("low"), (F.col("t") + HOUR).alias("high"), F.col("event_id").alias("index"))
    out = intervals.point_in_interval(e.select("event_id", "user_id", "t"), hours, x="t", keys=["user_id"], bin_width=24 * HOUR)
    return out.groupBy("event_id").agg(F.max("interval").alias("interval"))


_ASOF = """
WITH c AS (SELECT user_id, ts, min(event_id) AS click FROM events WHERE event_type = 'click' GROUP BY ALL),
p AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click')
SELECT p.event_id, c.click AS {name} FROM p ASOF LEFT JOIN c ON c.user_id = p.user_id AND p.ts {op} c.ts
"""


def _clicks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.min("event_id").alias("click"))
    return e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), clicks


@query(_ASOF.format(name="le", op=">="))
def q03_asof_le(spark, sf_dir):
    """The user's last click at or before each other event."""
    others, clicks = _clicks(spark, sf_dir)
    return intervals.asof_le(others, clicks, on="ts", keys=["user_id"], value="click", bins=F.to_date("ts")).select("event_id", "le")


@query(_ASOF.format(name="gt", op="<"))
def q04_asof_gt(spark, sf_dir):
    """The user's first click after each other event."""
    others, clicks = _clicks(spark, sf_dir)
    return intervals.asof_gt(others, clicks, on="ts", keys=["user_id"], value="click", bins=F.to_date("ts")).select("event_id", "gt")


# ---- evaluation -------------------------------------------------------------
def _predictions(spark, sf_dir):
    """Embeddings as predictions: the first ten dimensions are logits, the label is the truth."""
    e = table(spark, sf_dir, "embeddings").withColumn("logits", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")))
    return e.select("vec_id", "label", "logits", S.argmax("logits").alias("pred"))


def _classes(spark):
    return spark.range(10).select(F.col("id").cast("int").alias("class_id"))


_PRED = """p AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding[1:10]] AS logits,
  (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INT AS pred FROM embeddings),
k AS (SELECT i::INT AS c FROM range(10) r(i)),
m AS (SELECT t.c AS truth, q.c AS pred, count(p.vec_id) AS n FROM k t CROSS JOIN k q LEFT JOIN p ON p.label = t.c AND p.pred = q.c GROUP BY ALL),
s AS (SELECT c, coalesce(sum(n) FILTER (truth = c AND pred = c), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (pred = c), 0)::DOUBLE AS got, coalesce(sum(n) FILTER (truth = c), 0)::DOUBLE AS actual
  FROM k CROSS JOIN m GROUP BY c HAVING got + actual > 0),
v AS (SELECT *, CASE WHEN got > 0 THEN tp / got ELSE 0 END AS p, CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS r, 2 * tp / (got + actual) AS f FROM s)"""


@query(f"WITH {_PRED} SELECT * FROM m")
def q05_confusion(spark, sf_dir):
    return evaluate.confusion_matrix(_predictions(spark, sf_dir), _classes(spark))


@query(f"WITH {_PRED}, t AS (SELECT *, sum(n) OVER (PARTITION BY truth) AS total FROM m) SELECT truth, pred, n, CASE WHEN total > 0 THEN n / total END AS share, CASE WHEN total > 0 THEN floor(n / total * 100)::INT END AS percent FROM t")
def q06_confusion_norm(spark, sf_dir):
    matrix = evaluate.confusion_matrix(_predictions(spark, sf_dir), _classes(spark))
    return evaluate.normalize_rows(matrix).join(evaluate.confusion_percent(matrix), ["truth", "pred"])


@query(f"WITH {_PRED} SELECT c AS cls, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, actual::BIGINT AS support FROM v")
def q07_prf(spark, sf_dir):
    matrix = evaluate.confusion_counts(_predictions(spark, sf_dir))
    return _rounded(evaluate.class_scores(matrix), "precision", "recall", "f1").select("cls", "precision", "recall", "f1", "support")


@query(f"""WITH {_PRED}, a AS (
SELECT sum(tp) / sum(actual) AS accuracy, avg(r) FILTER (actual > 0) AS balanced_accuracy, count(*) FILTER (actual > 0) AS kk,
  avg(p) AS precision_macro, sum(p * actual) / sum(actual) AS precision_weighted, avg(r) AS recall_macro, sum(r * actual) / sum(actual) AS recall_weighted,
  avg(f) AS f1_macro, sum(f * actual) / sum(actual) AS f1_weighted, sum(tp) / sum(got) AS precision_micro, 2 * sum(tp) / (sum(got) + sum(actual)) AS f1_micro FROM v)
SELECT round(accuracy, 9) AS accuracy, round(balanced_accuracy, 9) AS balanced_accuracy, round(precision_macro, 9) AS precision_macro, round(precision_weighted, 9) AS precision_weighted,
  round(recall_macro, 9) AS recall_macro, round(recall_weighted, 9) AS recall_weighted, round(f1_macro, 9) AS f1_macro, round(f1_weighted, 9) AS f1_weighted, round(precision_micro, 9) AS precision_micro,
  round(accuracy, 9) AS recall_micro, round(f1_micro, 9) AS f1_micro, round((balanced_accuracy - 1.0 / kk) / (1 - 1.0 / kk), 9) AS adjusted_balanced_accuracy FROM a""")
def q08_accuracy(spark, sf_dir):
    out = evaluate.summary_scores(evaluate.confusion_counts(_predictions(spark, sf_dir)))
    return _rounded(out, *out.columns)


THRESHOLDS = (0.05, 0.08, 0.1, 0.12, 0.15)
_CURVE = f"""x AS (SELECT vec_id, label, [exp(l - list_max(logits)) FOR l IN logits] AS e FROM p),
w AS (SELECT label AS truth, unnest(range(10))::INT AS cls, unnest([v / list_sum(e) FOR v IN e]) AS score FROM x),
h AS (SELECT (i - 1)::INT AS i, {list(THRESHOLDS)}[i]::DOUBLE AS threshold FROM range(1, {len(THRESHOLDS) + 1}) r(i)),
cc AS (SELECT cls, i, threshold, count(*) FILTER (score >= threshold AND truth = cls)::DOUBLE AS tp, count(*) FILTER (score >= threshold)::DOUBLE AS got, count(*) FILTER (truth = cls)::DOUBLE AS actual FROM w CROSS JOIN h GROUP BY ALL),
pr AS (SELECT *, CASE WHEN got > 0 THEN tp / got ELSE 0 END AS pre, CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS rec FROM cc),
curve AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1 FROM pr),
ap AS (SELECT cls, sum(pre * fall) AS ap FROM (SELECT *, rec - lead(rec, 1, 0) OVER (PARTITION BY cls ORDER BY i) AS fall FROM curve) GROUP BY cls)"""


def _curves(spark, sf_dir):
    return evaluate.pr_curves_multiclass(_predictions(spark, sf_dir), THRESHOLDS)


@query(f"WITH {_PRED}, {_CURVE} SELECT cls, i, threshold, round(pre, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1, got = 0 AS undef_prec, actual = 0 AS undef_rec, pre + rec = 0 AS undef_f1 FROM curve")
def q09_pr_curves(spark, sf_dir):
    return _rounded(_curves(spark, sf_dir), "precision", "recall", "f1")


@query(f"WITH {_PRED}, {_CURVE} SELECT cls, threshold, round(f1, 9) AS f1, round(pre, 9) AS precision, round(rec, 9) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, i) AS nth FROM curve) WHERE nth = 1")
def q10_best_point(spark, sf_dir):
    return _rounded(evaluate.best_operating_point(_curves(spark, sf_dir), "cls"), "f1", "precision", "recall")


@query(f"WITH {_PRED}, {_CURVE} SELECT cls, round(ap, 9) AS average_precision FROM ap")
def q11_average_precision(spark, sf_dir):
    return _rounded(evaluate.average_precision(_curves(spark, sf_dir), "cls"), "average_precision")


@query(f"WITH {_PRED}, {_CURVE} SELECT round(avg(ap), 9) AS mean_average_precision FROM ap")
def q12_multiclass_map(spark, sf_dir):
    return _rounded(evaluate.mean_average_precision(_curves(spark, sf_dir)), "mean_average_precision")


@query("""
WITH p AS (SELECT (round_even(l_discount * 100, 0) >= 5)::INT AS label, l_quantity / 50 AS score FROM lineitem),
h AS (SELECT (i - 1)::INT AS i, [0.2, 0.4, 0.6, 0.8][i]::DOUBLE AS threshold FROM range(1, 5) r(i)),
c AS (SELECT i, threshold, count(*) FILTER (score >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold)::DOUBLE AS got, count(*) FILTER (label = 1)::DOUBLE AS actual FROM p CROSS JOIN h GROUP BY ALL)
SELECT i, threshold, round(tp / got, 9) AS precision, round(tp / actual, 9) AS recall, round(2 * tp / (got + actual), 9) AS f1 FROM c
""")
def q48_pr_binary(spark, sf_dir):
    """One curve of a score against a 0/1 label over all line items."""
    p = table(spark, sf_dir, "lineitem").select((F.bround(F.col("l_discount") * 100, 0) >= 5).cast("int").alias("label"), (F.col("l_quantity") / 50).alias("score"))
    return _rounded(evaluate.pr_curve(p), "precision", "recall", "f1").select("i", "threshold", "precision", "recall", "f1")


# ---- counts and weights -----------------------------------------------------
@query("SELECT lang, count(*) AS num_samples, count(*) / max(count(*)) OVER () AS weight FROM documents GROUP BY lang")
def q13_class_weights(spark, sf_dir):
    return counts.class_weights(table(spark, sf_dir, "documents"), "lang")


@query("SELECT source, count(*) AS num_samples, sum(n_chars) AS total_seconds FROM documents GROUP BY source")
def q14_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return counts.samples_per_class(d, "source").join(counts.recording_length_per_class(d, "source", "n_chars"), "source")


@query("""
WITH k AS (SELECT source, CASE WHEN text LIKE '%\\_bgd%' ESCAPE '\\' THEN 'add_bg' WHEN text LIKE '%-shift%' THEN 'time_shift' WHEN text LIKE '%-volume%' THEN 'volume'
  WHEN text LIKE '%-noise%' THEN 'noise' WHEN text LIKE '%-fmask%' OR text LIKE '%-tmask%' THEN 'mask' ELSE 'original' END AS kind
  FROM (SELECT source, lang || ['_bgd', '-shift', '-volume', '-noise', '-fmask', '-tmask', '.wav'][(doc_id % 7 + 1)::INT] AS text FROM documents))
SELECT source, count(*) FILTER (kind = 'add_bg') AS add_bg, count(*) FILTER (kind = 'time_shift') AS time_shift, count(*) FILTER (kind = 'volume') AS volume,
  count(*) FILTER (kind = 'noise') AS noise, count(*) FILTER (kind = 'mask') AS mask, count(*) FILTER (kind = 'original') AS original, count(*) AS total FROM k GROUP BY source
""")
def q15_counts_by_kind(spark, sf_dir):
    marks = F.array(*[F.lit(m) for m in ("_bgd", "-shift", "-volume", "-noise", "-fmask", "-tmask", ".wav")])
    d = table(spark, sf_dir, "documents").select("source", F.concat("lang", F.element_at(marks, (F.col("doc_id") % 7 + 1).cast("int"))).alias("path"))
    return counts.samples_per_class_and_kind(d, "source")


# ---- sampling ---------------------------------------------------------------
_KEY = "md5('42:' || doc_id::VARCHAR)"


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:0:' || doc_id::VARCHAR), doc_id) AS nth FROM labels),
c AS (SELECT quality, (sum(n) OVER (ORDER BY quality) - n)::BIGINT AS start FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality))
SELECT doc_id, quality, ((nth - 1 + start) % 5)::INT AS fold FROM r JOIN c USING (quality)
""")
def q16_kfold(spark, sf_dir):
    return sampling.stratified_kfold(table(spark, sf_dir, "labels").select("doc_id", "quality"), 5, cls="quality", ident="doc_id")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:0:' || doc_id::VARCHAR), doc_id) - 1 AS position, count(*) OVER () AS n FROM labels),
d AS (SELECT doc_id, position, unnest(CASE WHEN position < (7 - n % 7) % 7 THEN [position, position + n] ELSE [position] END) AS place FROM r)
SELECT doc_id, position, place, (place % 7)::INT AS replica FROM d
""")
def q17_shard(spark, sf_dir):
    at = sampling.positions(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return sampling.shard(at, 7)


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:0:' || doc_id::VARCHAR), doc_id) AS nth FROM labels),
c AS (SELECT quality, (sum(n) OVER (ORDER BY quality) - n)::BIGINT AS start FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)),
f AS (SELECT doc_id, ((nth - 1 + start) % 3)::INT AS fold FROM r JOIN c USING (quality)),
s AS (SELECT doc_id, fold, unnest(range(3))::INT AS split FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:0:' || doc_id::VARCHAR), doc_id) AS nth FROM s WHERE split <> fold)
SELECT doc_id, split, ((nth - 1) // 32)::BIGINT AS batch FROM t
""")
def q18_batches(spark, sf_dir):
    folds = sampling.stratified_kfold(table(spark, sf_dir, "labels").select("doc_id", "quality"), 3, cls="quality", ident="doc_id")
    return sampling.fold_batches(sampling.fold_splits(folds, 3), 32, ident="doc_id").select("doc_id", "split", "batch")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_KEY}, doc_id) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE nth <= round_even(n * 30.0 / 100, 0)")
def q19_keep_pct(spark, sf_dir):
    return sampling.keep_percent_per_class(table(spark, sf_dir, "documents").select("doc_id", "source"), 30.0, cls="source", ident="doc_id")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) <= round_even(count(*) OVER () * 12.5 / 100, 0) AS held_out FROM documents")
def q20_holdout(spark, sf_dir):
    return sampling.holdout_percent(table(spark, sf_dir, "documents").select("doc_id"), 12.5, ident="doc_id")


@query(f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 20.0 / 100) THEN 'validation' ELSE 'train' END AS split FROM documents")
def q21_holdout_class(spark, sf_dir):
    return sampling.holdout_percent_per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20.0, cls="lang", ident="doc_id")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_KEY}, doc_id) AS nth FROM documents) WHERE nth <= round_even(90 / (SELECT count(DISTINCT source) FROM documents), 0)")
def q22_sample_n(spark, sf_dir):
    return sampling.sample_across_classes(table(spark, sf_dir, "documents").select("doc_id", "source"), 90, cls="source", ident="doc_id")


# ---- augmentation plans -----------------------------------------------------
def _quota_sql(goal: str) -> str:
    return f"WITH c AS (SELECT lang, count(*) AS num_samples FROM documents GROUP BY lang), g AS (SELECT {goal} AS goal FROM c) SELECT lang, num_samples, goal::BIGINT AS goal, greatest(0, goal - num_samples)::BIGINT AS need FROM c, g"


def _quota(spark, sf_dir, goal):
    return augment.quota(counts.samples_per_class(table(spark, sf_dir, "documents"), "lang"), goal, cls="lang")


@query(_quota_sql("1 + max(num_samples) // 10"))
def q23_quota_tenth(spark, sf_dir):
    return _quota(spark, sf_dir, "tenth")


@query(_quota_sql("floor(median(num_samples))"))
def q23_quota_median(spark, sf_dir):
    return _quota(spark, sf_dir, "median")


@query(_quota_sql("max(num_samples)"))
def q23_quota_max(spark, sf_dir):
    return _quota(spark, sf_dir, "max")


_ROBIN = """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
q AS (SELECT lang, n, (SELECT max(n) FROM c) - n AS need FROM c),
a AS (SELECT doc_id, lang, (need // n + (row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= need % n)::INT)::BIGINT AS augmentations FROM documents JOIN q USING (lang))"""


@query(f"{_ROBIN} SELECT * FROM a")
def q24_round_robin(spark, sf_dir):
    return augment.allocate_round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), _quota(spark, sf_dir, "max"), cls="lang", order="doc_id")


METHODS = ("add_bg", "time_shift", "volume", "freq_mask", "time_mask")


@query(f"""{_ROBIN},
m AS (SELECT doc_id, list(x ORDER BY md5('42:' || x || ':' || doc_id::VARCHAR), x)[1:3] AS xs FROM (SELECT doc_id, unnest({list(METHODS)}) AS x FROM documents) GROUP BY doc_id)
SELECT doc_id, lang, slot, xs[((slot - 1) % 3 + 1)::INT] AS method FROM (SELECT *, unnest(range(1, augmentations + 1)) AS slot FROM a) JOIN m USING (doc_id)
""")
def q25_methods(spark, sf_dir):
    given = augment.allocate_round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), _quota(spark, sf_dir, "max"), cls="lang", order="doc_id")
    return augment.assign_methods(given, METHODS, ident="doc_id").select("doc_id", "lang", "slot", "method")


# ---- windows and signals ----------------------------------------------------
@query("""
SELECT vec_id, start_time::INT AS start_time, round(list_sum([x::DOUBLE FOR x IN embedding[start_time * 4 + 1:start_time * 4 + 20]]), 6) AS total
FROM (SELECT vec_id, embedding, unnest(range(0, 16 - 5)) AS start_time FROM embeddings)
""")
def q26_sliding_windows(spark, sf_dir):
    """Embeddings as 16-second signals at four samples a second: five-second windows every second."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(4).alias("sr"))
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return windows.audio_windows(a).select("vec_id", "start_time", F.round(total, 6).alias("total"))


@query("""
WITH s AS (SELECT doc_id, n_chars AS width, n_chars / 50.0 AS duration FROM documents WHERE n_chars / 50.0 >= 5),
w AS (SELECT *, duration / width AS per FROM s),
v AS (SELECT *, greatest(256, round_even((5.0 - 5.0::DOUBLE % per) / per, 0)::INT) AS cols, greatest(1, round_even((2.0 - 2.0::DOUBLE % per) / per, 0)::INT) AS hop,
  least(round_even(((1.0 + ceil(duration) - 2.0) - (1.0 + ceil(duration) - 2.0)::DOUBLE % per) / per, 0)::BIGINT, width) AS bound FROM w),
e AS (SELECT doc_id, width, per, cols, unnest(range(0, bound, hop)) AS start_column FROM v)
SELECT doc_id, start_column::INT AS start_column, cols AS columns, round(start_column * per, 6) AS start_time, round(start_column * per + cols * per, 6) AS end_time FROM e WHERE start_column + cols <= width
""")
def q49_spectrogram_windows(spark, sf_dir):
    """Documents as spectrograms of 50 columns a second, chopped into overlapping snippets."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("width"), (F.col("n_chars") / 50.0).alias("duration"))
    out = windows.spectrogram_windows(s)
    return _rounded(out, "start_time", "end_time", digits=6).select("doc_id", "start_column", "columns", "start_time", "end_time")


def _signal_sql(expr: str) -> str:
    return f"SELECT vec_id, unnest(range(64))::INT AS i, round(unnest({expr}), 6) AS x FROM (SELECT vec_id, [v::DOUBLE FOR v IN embedding] AS s FROM embeddings)"


def _signal(spark, sf_dir, f):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return e.select("vec_id", F.posexplode(f("s")).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(_signal_sql("[v * pow(10.0, -6 / 20.0) FOR v IN s]"))
def q27_gain(spark, sf_dir):
    return _signal(spark, sf_dir, lambda s: windows.gain(s, -6))


@query(_signal_sql("list_concat(s[11:64], s[1:10])"))
def q28_shift(spark, sf_dir):
    return _signal(spark, sf_dir, lambda s: windows.time_shift(s, 2.5, 4))


@query(_signal_sql("[(v - list_min(s)) / (list_max(s) - list_min(s)) * 255 FOR v IN s]"))
def q29_minmax(spark, sf_dir):
    return _signal(spark, sf_dir, lambda s: S.minmax_scale(s, 0.0, 255.0))


@query("SELECT vec_id, (i - 1)::INT AS i, round(CASE WHEN i BETWEEN 21 AND 30 THEN list_sum(s) / 64 ELSE s[i] END, 6) AS x FROM (SELECT vec_id, [v::DOUBLE FOR v IN embedding] AS s, unnest(range(1, 65)) AS i FROM embeddings)")
def q30_mask(spark, sf_dir):
    return _signal(spark, sf_dir, lambda s: windows.mask_stripe(s, 20, 10))


@query("""
WITH s AS (SELECT vec_id, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[1:32]]) / 32) AS a, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[33:64]]) / 32) AS b FROM embeddings)
SELECT vec_id, round(a / pow(10.0, (3 + vec_id % 28) / 20.0) / b, 6) AS factor FROM s
""")
def q31_noise_gain(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(S.noise_gain(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), (3 + F.col("vec_id") % 28).cast("double")), 6).alias("factor"))


# ---- history ----------------------------------------------------------------
@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1")
def q32_first_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return counts.first_per_group(e, "user_id", ["ts", "event_id"])


_DAYS = """d AS (SELECT user_id AS run_id, (epoch_us(ts) // 86400000000)::BIGINT AS step, event_type, value FROM events),
a AS (SELECT run_id, step, CASE WHEN event_type IN ('click', 'view') THEN 'training' ELSE 'validating' END AS phase, round(avg(value), 9) AS score FROM d GROUP BY ALL)"""


def _days(spark, sf_dir):
    """Users as runs and days as steps; clicks and views train, other events validate."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.floor(_micros("ts") / 86400000000).alias("step"), "event_type", "value")
    phase = F.when(F.col("event_type").isin("click", "view"), "training").otherwise("validating")
    return e.groupBy("run_id", "step", phase.alias("phase")).agg(F.round(F.avg("value"), 9).alias("score"))


@query(f"""WITH {_DAYS}, w AS (SELECT run_id, step, max(score) FILTER (phase = 'training') AS training, max(score) FILTER (phase = 'validating') AS validating FROM a GROUP BY ALL)
SELECT run_id, step, training, validating FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS nth FROM w) WHERE nth <= 5""")
def q33_recent_history(spark, sf_dir):
    return evaluate.recent_history(_days(spark, sf_dir), "score", 5)


@query(f"""WITH {_DAYS}, t AS (SELECT run_id, step, score, row_number() OVER o AS nth, count(*) OVER r AS n, first_value(score) OVER r AS first FROM a WHERE phase = 'training'
  WINDOW o AS (PARTITION BY run_id ORDER BY step), r AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT run_id, step, score, round(CASE WHEN n > 1 THEN abs(score - first) / (n - 1) END, 6) AS mean_diff,
  coalesce(CASE WHEN n > 1 THEN abs(score - first) / (n - 1) END < 1.0 AND nth > 5, false) AS stop FROM t""")
def q34_plateau(spark, sf_dir):
    days = _days(spark, sf_dir).where("phase = 'training'").select("run_id", "step", "score")
    return _rounded(evaluate.plateau(days, "score", least=1.0, min_epochs=5), "mean_diff", digits=6)


# ---- catalogs ---------------------------------------------------------------
@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q35_anti_skip(spark, sf_dir):
    return lookups.skip_existing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), on=["doc_id"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3 AS retained FROM orders")
def q36_retain_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return lookups.retain_latest(o, 3, run="o_custkey", order=[F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@query("""
WITH c AS (SELECT DISTINCT translate('doc (' || vec_id || ')', '/ ()', '____') AS name FROM embeddings),
f AS (SELECT DISTINCT translate('doc (' || doc_id || ')', '/ ()', '____') AS name FROM labels)
SELECT coalesce(c.name, f.name) AS name, c.name IS NOT NULL AS in_catalog, f.name IS NOT NULL AS in_files FROM c FULL JOIN f ON c.name = f.name
""")
def q37_reconcile(spark, sf_dir):
    """Names of embeddings against names of labelled documents: both sides lack some."""
    named = lambda t, key: table(spark, sf_dir, t).select(F.concat(F.lit("doc ("), F.col(key).cast("string"), F.lit(")")).alias("name"))
    return lookups.reconcile(named("embeddings", "vec_id"), named("labels", "doc_id"), "name", "name")


_NAT = "regexp_replace(source, '[0-9]+', '') || lpad(regexp_extract(source, '[0-9]+'), 20, '0')"


@query(f"SELECT doc_id, source, (dense_rank() OVER (ORDER BY {_NAT}) - 1)::INT AS class_id, row_number() OVER (ORDER BY {_NAT}, doc_id) - 1 AS sample_id FROM documents")
def q38_natural_sort_ids(spark, sf_dir):
    """Class and sample ids in natural order: src2 before src10."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "doc_id")
    return counts.assign_sample_ids(d, cls="source").select("doc_id", "source", "class_id", "sample_id")


@query(f"""WITH u AS (SELECT 0 AS root, doc_id, source FROM documents UNION ALL SELECT 1, doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT root, doc_id, source, (dense_rank() OVER (ORDER BY {_NAT}) - 1)::INT AS class_id, row_number() OVER (ORDER BY {_NAT}, root, doc_id) - 1 AS sample_id FROM u""")
def q39_union_roots(spark, sf_dir):
    """Two roots as one index: all documents, and the labelled ones again."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "doc_id")
    labelled = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(*d.columns)
    roots = [x.withColumn("path", F.col("path").cast("string")) for x in (d, labelled)]
    out = counts.union_roots(roots, cls="source")
    return out.select("root", "doc_id", "source", "class_id", "sample_id")


@query("""
WITH p AS (SELECT p_partkey, '/data/' || p_brand || '/' || p_name || ' (' || p_type || ').wav' AS path, p_type FROM part),
s AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM p),
t AS (SELECT *, regexp_extract(base, '^(.+?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(base, '^.+?(\\.[^.]+)$', 1) AS suf FROM s)
SELECT p_partkey, regexp_replace(path, '/?[^/]*$', '') AS root, stem, suf, translate(base, '/ ()', '____') AS clean,
  CASE WHEN lower(p_type) LIKE '%call%' THEN 'CALL' WHEN lower(p_type) LIKE '%song%' THEN 'SONG' ELSE 'UNKNOWN' END AS voc,
  stem || '_sw-start' || (round_even(p_partkey / 2.0, 0)::BIGINT)::VARCHAR || '.png' AS snippet, suf IN ('.wav', '.mp3', '.ogg') AS audio FROM t
""")
def q40_string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_name", F.lit(" ("), "p_type", F.lit(").wav"))
    p = p.select("p_partkey", path.alias("path"), "p_type").withColumn("e", S.path_elements("path"))
    return p.select(
        "p_partkey", "e.root", F.col("e.fname").alias("stem"), F.col("e.suffix").alias("suf"), S.clean_filename(S.base_name("path")).alias("clean"),
        S.vocalization_type("p_type").alias("voc"), S.snippet_name("path", F.col("p_partkey") / 2.0).alias("snippet"), S.is_audio_file("path").alias("audio"),
    )


@query("""
SELECT conv_id, to_json(list({'role': role, 'text': text} ORDER BY turn, role, text))::VARCHAR AS value FROM conversations GROUP BY conv_id
""")
def q41_collection_json(spark, sf_dir):
    """Conversations as a collection: each as a JSON array of its turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return collections.collection_json(c, species="conv_id", order="turn", fields=("role", "text"))


@query("SELECT r_name AS region, n_name AS nation, r_name || '/' || n_name AS settings FROM region, nation")
def q42_grid(spark, sf_dir):
    """All combinations of two value lists, each with its settings map."""
    grid = table(spark, sf_dir, "region").select(F.col("r_name").alias("region")).crossJoin(table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation")))
    return augment.with_settings(grid, ["region", "nation"]).select("region", "nation", F.concat_ws("/", F.col("settings")["region"], F.col("settings")["nation"]).alias("settings"))


@query(f"""WITH {_DAYS}, l AS (SELECT *, row_number() OVER (PARTITION BY run_id, phase ORDER BY step DESC) AS nth FROM a)
SELECT run_id, max(step) AS last_step, max(score) FILTER (phase = 'training') AS score_training, max(score) FILTER (phase = 'validating') AS score_validating, NULL::DOUBLE AS score_testing FROM l WHERE nth = 1 GROUP BY run_id""")
def q43_leaderboard(spark, sf_dir):
    return evaluate.run_leaderboard(_days(spark, sf_dir), metrics=("score",))


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) AS only_a, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)) AS only_b")
def q44_exceptall(spark, sf_dir):
    key = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("k"))
    return lookups.equal_rows(key("customer", "c_nationkey"), key("supplier", "s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def q45_union(spark, sf_dir):
    key = lambda name, c: table(spark, sf_dir, name).select(F.col(c).alias("k"))
    return lookups.distinct_union([key("customer", "c_nationkey"), key("supplier", "s_nationkey")], "k")


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:0:' || doc_id::VARCHAR), doc_id) AS nth FROM labels),
c AS (SELECT quality, (sum(n) OVER (ORDER BY quality) - n)::BIGINT AS start FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)),
s AS (SELECT doc_id, ((nth - 1 + start) % 5)::INT AS fold, unnest(range(5))::INT AS split FROM r JOIN c USING (quality)),
b AS (SELECT split, count(*) AS n FROM (SELECT split, doc_id FROM s WHERE split <> fold INTERSECT SELECT split, doc_id FROM s WHERE split = fold) GROUP BY split)
SELECT split, count(*) AS n_train, coalesce(any_value(n), 0) AS n_leaking FROM s LEFT JOIN b USING (split) WHERE split <> fold GROUP BY split
""")
def q46_intersect(spark, sf_dir):
    """Of each split, rows that are trained on, and those of them that it is validated with too: there must be none."""
    folds = sampling.stratified_kfold(table(spark, sf_dir, "labels").select("doc_id", "quality"), 5, cls="quality", ident="doc_id")
    return sampling.leaks_per_split(sampling.fold_splits(folds, 5), "doc_id")


@query("""WITH p AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding[1:10]] AS s FROM embeddings)
SELECT vec_id, round(-ln(exp(s[label + 1] - list_max(s)) / list_sum([exp(x - list_max(s)) FOR x IN s])), 6) AS loss FROM p""")
def q47_loss(spark, sf_dir):
    return _predictions(spark, sf_dir).select("vec_id", F.round(S.cross_entropy("logits", "label"), 6).alias("loss"))


@query("""
WITH f AS (SELECT doc_id, 'AM01_' || (45000 + doc_id * 131) || '.wav' AS path FROM documents)
SELECT doc_id, n BETWEEN 50000 AND 70000 OR n BETWEEN 170000 AND 180000 AS kept FROM (SELECT doc_id, 45000 + doc_id * 131 AS n FROM f)
""")
def q50_serial_range(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("AM01_"), (45000 + F.col("doc_id") * 131).cast("string"), F.lit(".wav")).alias("path"))
    kept, rejected = filters.cull_by_serial_range(d)
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False))).select("doc_id", "kept")


@query(f"""WITH {_PRED} SELECT DISTINCT label, p.pred, 's' || vec_id || '.png' AS name FROM p WHERE label <> pred""")
def q51_misclassified(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    index = p.select("vec_id", F.concat(F.lit("/data/s"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"))
    return filters.misclassified(p, index, "vec_id")


@query(f"""WITH {_PRED}, t AS (SELECT truth // 2 AS pair, pred // 2 AS got, n FROM m)
SELECT pair, round(sum(n) FILTER (pair = got) / sum(n), 9) AS share FROM t GROUP BY pair""")
def q52_paired_precision(spark, sf_dir):
    return _rounded(evaluate.paired_class_precision(evaluate.confusion_matrix(_predictions(spark, sf_dir), _classes(spark))), "share")


@query("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:0:' || doc_id::VARCHAR), doc_id) AS nth FROM labels),
c AS (SELECT quality, (sum(n) OVER (ORDER BY quality) - n)::BIGINT AS start FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)),
f AS (SELECT quality, ((nth - 1 + start) % 4)::INT AS fold FROM r JOIN c USING (quality)),
s AS (SELECT quality, fold, unnest(range(4))::INT AS split FROM f)
SELECT split, quality, count(*) FILTER (split <> fold) AS train, count(*) FILTER (split = fold) AS validate FROM s GROUP BY ALL
""")
def q53_class_coverage(spark, sf_dir):
    folds = sampling.stratified_kfold(table(spark, sf_dir, "labels").select("doc_id", "quality"), 4, cls="quality", ident="doc_id")
    return sampling.class_coverage(sampling.fold_splits(folds, 4), "quality")


@query("""
WITH f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT o_orderkey, o_custkey, o_orderpriority,
  o_orderpriority || CASE WHEN nth = 1 THEN '' ELSE '_r' || (nth - 1) END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders)
""")
def q54_unique_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sampling.unique_names(o, folder="o_custkey", name="o_orderpriority", order="o_orderkey")


@query(f"""WITH {_PRED}, b AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[11:20]] AS t FROM embeddings)
SELECT p.vec_id, ((list_position(list_concat(p.logits, t), list_max(list_concat(p.logits, t))) - 1) % 10)::INT AS pred FROM p JOIN b USING (vec_id)""")
def q55_ensemble(spark, sf_dir):
    """Two models' scores joined end to end; positions map to classes modulo ten."""
    e = table(spark, sf_dir, "embeddings")
    model = lambda at: e.select("vec_id", F.transform(F.slice("embedding", at, 10), lambda x: x.cast("double")).alias("scores"))
    mapping = spark.range(20).select(F.col("id").cast("int").alias("position"), (F.col("id") % 10).cast("int").alias("class_id"))
    return lookups.ensemble_prediction([model(1), model(11)], mapping, "vec_id")


_ITEMS = """p AS (SELECT l_linenumber AS step, (l_linestatus = 'O')::INT AS label, CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'A' THEN 0 ELSE 2 END AS pred FROM lineitem),
m AS (SELECT step, label AS truth, pred, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
k AS (SELECT step, truth AS c FROM m UNION SELECT step, pred FROM m),
s AS (SELECT k.step, c, coalesce(sum(n) FILTER (truth = c AND pred = c), 0) AS tp, coalesce(sum(n) FILTER (pred = c), 0) AS got, coalesce(sum(n) FILTER (truth = c), 0) AS actual FROM k JOIN m ON m.step = k.step GROUP BY ALL),
v AS (SELECT *, CASE WHEN got > 0 THEN tp / got ELSE 1 END AS p, CASE WHEN actual > 0 THEN tp / actual ELSE 1 END AS r, 2 * tp / (got + actual) AS f FROM s)"""


def _line_items(spark, sf_dir):
    """Line items as predictions: their status is the truth, their return flag the guess, their number the step."""
    pred = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 0).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("step"), (F.col("l_linestatus") == "O").cast("int").alias("label"), pred.alias("pred"))


@query(f"""WITH {_ITEMS}
SELECT step, round(sum(tp) / sum(actual), 9) AS accuracy, round(avg(r) FILTER (actual > 0), 9) AS balanced_accuracy, round(avg(p), 9) AS precision_macro, round(avg(r), 9) AS recall_macro, round(avg(f), 9) AS f1_macro,
  round(sum(p * actual) / sum(actual), 9) AS precision_weighted, round(sum(f * actual) / sum(actual), 9) AS f1_weighted FROM v GROUP BY step""")
def q56_epoch_summary(spark, sf_dir):
    out = evaluate.epoch_summary(_line_items(spark, sf_dir), by=["step"])
    names = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "f1_weighted")
    return _rounded(out, *names).select("step", *names)


@query(f"""WITH {_ITEMS} SELECT truth, pred, round(sum(n) / (SELECT count(DISTINCT step) FROM m), 9) AS mean_n FROM m GROUP BY truth, pred""")
def q57_matrix_mean(spark, sf_dir):
    matrices = evaluate.confusion_counts(_line_items(spark, sf_dir), ["step"])
    return _rounded(evaluate.aggregate_matrices(matrices), "mean_n")


@query(f"""WITH {_ITEMS}, a AS (SELECT c, sum(tp) AS tp, sum(got) AS got, sum(actual) AS actual FROM s GROUP BY c)
SELECT i::INT AS cls, CASE WHEN actual > 0 THEN round(CASE WHEN got > 0 THEN tp / got ELSE 0 END, 9) END AS precision, CASE WHEN actual > 0 THEN round(tp / actual, 9) END AS recall,
  CASE WHEN actual > 0 THEN round(2 * tp / (got + actual), 9) END AS f1, CASE WHEN actual > 0 THEN actual::BIGINT END AS support FROM range(5) r(i) LEFT JOIN a ON a.c = i""")
def q58_scores_on_all_classes(spark, sf_dir):
    """Scores of five known classes of which some never occur."""
    scores = evaluate.class_scores(evaluate.confusion_counts(_line_items(spark, sf_dir)))
    classes = spark.range(5).select(F.col("id").cast("int").alias("class_id"))
    return _rounded(evaluate.place_on_all_classes(scores, classes), "precision", "recall", "f1")


@query("""SELECT l_returnflag AS run_id, l_linenumber AS step, l_linestatus AS phase, round(avg(l_extendedprice / l_quantity), 6) AS mean_loss FROM lineitem GROUP BY ALL""")
def q59_loss_summary(spark, sf_dir):
    """Prices as losses of batches of the line's quantity."""
    losses = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run_id"), F.col("l_linenumber").alias("step"), F.col("l_linestatus").alias("phase"), F.col("l_extendedprice").alias("loss"), F.col("l_quantity").alias("batch_size"))
    return _rounded(evaluate.loss_summary(losses), "mean_loss", digits=6)


@query(f"WITH {_PRED}, {_CURVE}, b AS (SELECT cls, max(f1) AS f FROM curve GROUP BY cls) SELECT (SELECT cls FROM b ORDER BY f DESC, cls LIMIT 1) AS best, (SELECT cls FROM b ORDER BY f, cls LIMIT 1) AS worst")
def q60_best_and_worst_curve(spark, sf_dir):
    return evaluate.best_and_worst_curve(evaluate.curve_summary(_curves(spark, sf_dir)))


@query("""
WITH d AS (SELECT doc_id, lang || doc_id || ['', '-shift12ms', '-volume-3', '-rain_bgd0ms'][(doc_id % 4 + 1)::INT] || '.wav' AS name, (doc_id % 90) || ':' || lpad((doc_id % 60)::VARCHAR, 2, '0') AS len, source FROM documents)
SELECT doc_id, lang_part || '.wav' AS original, CASE doc_id % 4 WHEN 1 THEN 'time_shift' WHEN 2 THEN 'volume' WHEN 3 THEN 'add_bg' END AS kind, (doc_id % 90) * 60.0 + doc_id % 60 AS seconds, source || '_xc' || doc_id AS full_name
FROM (SELECT *, split_part(regexp_replace(name, '\\.wav$', ''), '-', 1) AS lang_part FROM d)
""")
def q61_names_of_augmentations(spark, sf_dir):
    marks = F.array(*[F.lit(m) for m in ("", "-shift12ms", "-volume-3", "-rain_bgd0ms")])
    d = table(spark, sf_dir, "documents")
    name = F.concat("lang", F.col("doc_id").cast("string"), F.element_at(marks, (F.col("doc_id") % 4 + 1).cast("int")), F.lit(".wav"))
    length = F.concat((F.col("doc_id") % 90).cast("string"), F.lit(":"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"))
    return d.select("doc_id", S.original_file_name(name).alias("original"), S.augmentation_kind(name).alias("kind"), S.minutes_seconds(length).alias("seconds"), S.full_name("source", F.lit(""), "doc_id").alias("full_name"))


@query("SELECT DISTINCT (epoch_us(ts) // 86400000000)::BIGINT AS step FROM events")
def q62_steps(spark, sf_dir):
    days = _days(spark, sf_dir)
    parts = [days.where(F.col("phase") == p) for p in ("training", "validating")]
    return ordering.steps(ordering.append_tallies(*parts))


@query("SELECT count(DISTINCT source) AS num_species, count(*) AS num_recordings FROM documents")
def q63_totals(spark, sf_dir):
    return counts.totals(table(spark, sf_dir, "documents"), "source")


@query(f"WITH {_PRED} SELECT truth, sum(n)::BIGINT AS total FROM m GROUP BY truth")
def q64_truth_totals(spark, sf_dir):
    return evaluate.truth_totals(evaluate.confusion_matrix(_predictions(spark, sf_dir), _classes(spark)))


from fieldlab.plans import more_queries, signal_queries  # noqa: E402, F401  they register their queries with the decorator above
