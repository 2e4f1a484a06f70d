"""Further registered queries: names and texts, catalogs, logs that are written and read back, orders and plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldlab.functions import scalars as S
from fieldlab.operators import augment, counts, evaluate, filters, intervals, lookups, ordering, ranks, sampling
from fieldlab.plans.registry import _CURVE, _ITEMS, _PRED, THRESHOLDS, _classes, _line_items, _predictions, _rounded, query, table
from fieldlab.sources import annotations, collections, logs


def _folder(spark, name: str) -> str:
    return f"{ranks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pick(texts, number):
    """One of the texts by a number from 0."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (number % len(texts) + 1).cast("int"))


# ---- names and texts --------------------------------------------------------
@query("""
WITH p AS (SELECT p_partkey, p_type, ['', 'CALL_', 'UNKNOWN_'][(p_partkey % 3 + 1)::INT] AS pre, ['.png', '.PNG', '.wav', '.jpg', '.txt'][(p_partkey % 5 + 1)::INT] AS suf FROM part)
SELECT p_partkey, suf IN ('.png', '.jpg') AS image, pre = 'CALL_' AS prefixed,
  CASE WHEN pre = 'CALL_' THEN 'CALL_' ELSE CASE WHEN lower(p_type) LIKE '%call%' THEN 'CALL' WHEN lower(p_type) LIKE '%song%' THEN 'SONG' ELSE 'UNKNOWN' END || '_' END || 'p' || p_partkey || suf AS ensured FROM p
""")
def q65_file_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(_pick(("", "CALL_", "UNKNOWN_"), F.col("p_partkey")), F.lit("p"), F.col("p_partkey").cast("string"), _pick((".png", ".PNG", ".wav", ".jpg", ".txt"), F.col("p_partkey")))
    path = F.concat(F.lit("/data/"), name)
    return p.select("p_partkey", S.is_image_file(path).alias("image"), S.has_vocalization_prefix(path).alias("prefixed"), S.ensure_vocalization_prefix(name, "p_type").alias("ensured"))


@query("SELECT l_orderkey, l_linenumber, l_quantity - 5 <= l_partkey % 50 AND l_partkey % 50 < l_quantity + 5 AS inside FROM lineitem")
def q66_interval_contains(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    return item.select("l_orderkey", "l_linenumber", S.interval_contains(F.col("l_quantity") - 5, F.col("l_quantity") + 5, F.col("l_partkey") % 50).alias("inside"))


@query("SELECT doc_id, doc_id * 5 + quality AS step FROM labels")
def q67_step_number(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", S.step_number("doc_id", "quality", 5).alias("step"))


@query("SELECT vec_id, i::INT AS i, (i = label)::INT AS x FROM embeddings, range(10) r(i)")
def q68_one_hot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.one_hot("label", 10)).alias("i", "x"))


@query("SELECT vec_id, round(list_sum([pow(embedding[i]::DOUBLE - embedding[i + 32]::DOUBLE, 2) FOR i IN range(1, 33)]) / 32, 6) AS mse FROM embeddings")
def q69_squared_error(spark, sf_dir):
    half = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.mean_squared_error(half(1), half(33)), 6).alias("mse"))


@query("SELECT c_custkey, 'extra=' || c_nationkey || ',name=new' || c_custkey || ',segment=' || c_mktsegment AS entries, 0 AS cleared FROM customer")
def q70_map_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name")
    new = F.create_map(F.lit("name"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")), F.lit("extra"), F.col("c_nationkey").cast("string"))
    entries = F.transform(F.array_sort(F.map_entries(S.map_update(old, new))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return c.select("c_custkey", F.array_join(entries, ",").alias("entries"), F.size(S.map_clear()).alias("cleared"))


@query("""
WITH p AS (SELECT p_partkey, p_size, '0.' || lpad(p_size::VARCHAR, 2, '0') AS lr, p_partkey % 2 = 0 AS pre FROM part)
SELECT p_partkey, 'model_net_resnet' || p_size || '_pre_' || CASE WHEN pre THEN 'True' ELSE 'False' END || '_lr_' || lr || '_bs_' || p_size || '_folds_na.csv' AS name,
  'resnet' || p_size AS net, pre, NULL::INT AS frz, lr::DOUBLE AS lr, NULL::VARCHAR AS opt, p_size::INT AS bs, NULL::INT AS ks, NULL::INT AS folds, NULL::BOOLEAN AS gray, NULL::INT AS classes FROM p
""")
def q71_run_names(spark, sf_dir):
    """Run properties to file names and back."""
    size = F.col("p_size").cast("string")
    properties = {"net": F.concat(F.lit("resnet"), size), "pre": F.col("p_partkey") % 2 == 0, "lr": F.concat(F.lit("0."), F.lpad(size, 2, "0")), "bs": size, "folds": F.lit(None).cast("string"), "other": size}
    p = table(spark, sf_dir, "part").select("p_partkey", S.run_filename("model", properties, ".csv").alias("name"))
    return p.select("p_partkey", "name", S.parse_run_filename("name").alias("run")).select("p_partkey", "name", "run.*")


@query("""SELECT c_custkey, '/home/' || c_name AS short, '/top/.../' || c_name || '.wav' AS middle, '/top/...a_long_' || c_name || '.wav' AS long FROM customer""")
def q72_ellipsed_paths(spark, sf_dir):
    path = lambda *parts: S.ellipsed_path(F.concat(*[F.lit(p) if i != 1 else F.col(p) for i, p in enumerate(parts)]))
    return table(spark, sf_dir, "customer").select("c_custkey", path("/home/", "c_name", "").alias("short"), path("/top/mid/", "c_name", ".wav").alias("middle"), path("/top/mid/a_long_", "c_name", ".wav").alias("long"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderkey * 977 - 977 AS s FROM orders),
n AS (SELECT *, [s // 604800, s % 604800 // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60] AS n FROM s),
t AS (SELECT *, [CASE WHEN n[i] > 0 THEN n[i] || '.0 ' || ['week', 'day', 'hour', 'minute', 'second'][i] || CASE WHEN n[i] = 1 THEN '' ELSE 's' END END FOR i IN range(1, 6)] AS t FROM n)
SELECT o_orderkey, CASE WHEN s < 1 THEN '< 1sec>' ELSE array_to_string([x FOR x IN t IF x IS NOT NULL][1:2], ', ') END AS duration FROM t
""")
def q73_durations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.duration_text(F.col("o_orderkey") * 977 - 977).alias("duration"))


@query("""
WITH s AS (SELECT o_orderkey, 2 * 977 * o_orderkey * o_orderkey + 1 AS n FROM orders),
u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 WHEN n < 1125899906842624 THEN 4 ELSE 5 END AS u FROM s)
SELECT o_orderkey, printf('%.1f', n / pow(1024.0, u)) || ['', 'K', 'M', 'G', 'T', 'P'][u + 1] || 'B' AS size FROM u
""")
def q74_byte_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.bytes_text(F.col("o_orderkey") * F.col("o_orderkey") * 2 * 977 + 1).alias("size"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H_%M_%S') AS stamp, 'run_' || strftime(ts, '%Y-%m-%dT%H_%M_%S') || '.csv' AS name, strftime(ts, '%Y-%m-%dT%H_%M_%S') AS found FROM events")
def q75_file_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", S.file_timestamp("ts").alias("stamp"))
    return e.withColumn("name", F.concat(F.lit("run_"), "stamp", F.lit(".csv"))).withColumn("found", S.run_timestamp("name"))


@query("SELECT p_partkey, p_size::INT AS kernel_size, p_partkey::INT AS batch_size FROM part")
def q76_log_names(spark, sf_dir):
    name = F.concat(F.lit("res_K"), F.col("p_size").cast("string"), F.lit("_B"), F.col("p_partkey").cast("string"), F.lit(".jsonl"))
    return table(spark, sf_dir, "part").select("p_partkey", S.log_name_parts(name).alias("n")).select("p_partkey", "n.*")


@query("""SELECT c_custkey, c_custkey % 6 IN (0, 1, 3) AS flag, CASE WHEN c_custkey % 4 < 3 THEN ['a|b', '', 'x1|y']  [(c_custkey % 4 + 1)::INT] END AS items FROM customer""")
def q77_flags_and_lists(spark, sf_dir):
    key = F.col("c_custkey")
    flag, items = _pick(("1", "yes", "no", "True", "true", ""), key), _pick((" a, b,, ", "", "x1,y", "[1, 2]"), key)
    return table(spark, sf_dir, "customer").select("c_custkey", S.str2bool(flag).alias("flag"), F.array_join(S.split_list(items), "|").alias("items"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'AM' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '_20190719_' || lpad(p_partkey::VARCHAR, 6, '0') END AS recording,
  'p' || p_partkey || '_' || translate(p_type, ' ', '_') || '.png' AS copy FROM part""")
def q78_recording_ids(spark, sf_dir):
    """Recording ids in names, and names of snippets copied for a further species."""
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("/x/AM"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), _pick(("_20190719_", "_2019_"), F.col("p_partkey")), F.lpad(key, 6, "0"), F.lit(".png"))
    return table(spark, sf_dir, "part").select("p_partkey", S.recording_id(name).alias("recording"), S.species_copy_name(F.concat(F.lit("/s/p"), key, F.lit(".png")), "p_type").alias("copy"))


# ---- catalogs ---------------------------------------------------------------
def _samples(spark, sf_dir):
    """Documents as samples: one image each in a folder of their source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("sample_id"), F.concat(F.lit("/d/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.col("source").alias("class_name"))


_SAMPLES = """s AS (SELECT doc_id AS sample_id, '/d/' || source || '/' || doc_id || '.png' AS path, source AS class_name FROM documents),
k AS (SELECT class_name, (row_number() OVER (ORDER BY regexp_extract(class_name, '[0-9]+')::INT) - 1)::INT AS class_id FROM (SELECT DISTINCT class_name FROM s))"""


@query(f"WITH {_SAMPLES} SELECT c_custkey AS sample_id, path, s.class_name, class_id FROM customer LEFT JOIN s ON sample_id = c_custkey LEFT JOIN k ON k.class_name = s.class_name")
def q79_lookup_samples(spark, sf_dir):
    """Customers' keys as sample ids, of which some are unknown."""
    s = _samples(spark, sf_dir)
    index = s.join(counts.assign_class_ids(s), "class_name")
    return lookups.lookup_samples(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id")), index)


@query(f"WITH {_SAMPLES} SELECT sample_id, path FROM s WHERE class_name = 'src' || sample_id % 10 AND sample_id IN (SELECT doc_id FROM labels)")
def q80_requested_samples(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select(F.concat(F.lit("src"), (F.col("doc_id") % 10).cast("string")).alias("class_name"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("file_name"))
    return lookups.requested_samples(_samples(spark, sf_dir), pairs).select("sample_id", "path")


@query("""SELECT 'recording' AS kind, vec_id AS key FROM embeddings WHERE label IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'without', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT label FROM embeddings)""")
def q81_select_by_species(spark, sf_dir):
    """Embeddings of labels that are nations' keys, and nations without any."""
    recordings = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("species"))
    found, without = filters.select_by_species(recordings, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("species")), "species")
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"))
    return named(found, "recording", "vec_id").unionByName(named(without, "without", "species"))


@query("SELECT doc_id FROM documents WHERE n_chars // 600 * 60 + n_chars // 10 % 60 BETWEEN 5 AND 60 AND doc_id % 3 < 2")
def q82_filter_recordings(spark, sf_dir):
    n = F.col("n_chars")
    length = F.concat(F.expr("n_chars div 600").cast("string"), F.lit(":"), F.lpad((F.expr("n_chars div 10") % 60).cast("string"), 2, "0"))
    d = table(spark, sf_dir, "documents").where(n.isNotNull()).select("doc_id", length.alias("length"), _pick(("A", "B", "C"), F.col("doc_id")).alias("rating"))
    return filters.filter_recordings(d).select("doc_id")


@query("SELECT l_orderkey, l_linenumber AS step, l_linestatus AS phase FROM lineitem WHERE l_linenumber = 3 AND l_linestatus = 'O'")
def q83_filter_tallies(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("step"), F.col("l_linestatus").alias("phase"))
    return filters.filter_tallies(p, step=3, phase="O")


@query(f"WITH {_PRED}, {_CURVE} SELECT cls FROM curve GROUP BY cls HAVING NOT bool_or(got = 0 OR actual = 0 OR pre + rec = 0)")
def q84_well_defined(spark, sf_dir):
    return filters.well_defined(evaluate.curve_summary(evaluate.pr_curves_multiclass(_predictions(spark, sf_dir), THRESHOLDS))).select("cls")


@query("SELECT o_orderkey, c_custkey AS recording_id, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q85_associate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("recording_id"))
    return intervals.associate(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording_id"), "c_name"))


# ---- scores -----------------------------------------------------------------
@query(f"""WITH {_ITEMS}, a AS (SELECT c, sum(tp) AS tp, sum(got) AS got, sum(actual) AS actual FROM s GROUP BY c),
x AS (SELECT i::INT AS cls, CASE WHEN got > 0 AND actual > 0 THEN tp / got * (tp / actual) ELSE 0 END AS ap FROM range(3) r(i) LEFT JOIN a ON c = i)
SELECT cls, round(ap, 9) AS average_precision, round(avg(ap) OVER (), 9) AS mean_average_precision FROM x""")
def q86_testing_summary(spark, sf_dir):
    return _rounded(evaluate.testing_result_summary(_line_items(spark, sf_dir), classes=3), "average_precision", "mean_average_precision")


@query(f"WITH {_PRED} SELECT count(*) FILTER (n <> 0) AS nonzero FROM m")
def q87_count_nonzero(spark, sf_dir):
    return counts.count_nonzero(evaluate.confusion_matrix(_predictions(spark, sf_dir), _classes(spark)), "n")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:3:' || doc_id::VARCHAR), doc_id) - 1 AS position FROM documents")
def q88_shuffle(spark, sf_dir):
    return sampling.positions(sampling.shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=7, epoch=3), "doc_id", seed=7, epoch=3)


@query("""SELECT l_returnflag AS cls, round(max(s) FILTER (l_linestatus = 'O'), 1) AS training, round(max(s) FILTER (l_linestatus = 'F'), 1) AS validating
FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS s FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def q89_train_val_per_class(spark, sf_dir):
    phase = F.when(F.col("l_linestatus") == "O", "training").otherwise("validating")
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("cls"), phase.alias("phase")).agg(F.avg("l_quantity").alias("f1"))
    return evaluate.per_class_train_val(scores)


@query(f"""WITH {_PRED}, w AS (SELECT label, count(*) / max(count(*)) OVER () AS weight FROM embeddings GROUP BY label),
x AS (SELECT p.label, weight, -ln(exp(logits[p.label + 1] - list_max(logits)) / list_sum([exp(l - list_max(logits)) FOR l IN logits])) AS loss FROM p JOIN w ON w.label = p.label)
SELECT round(sum(weight * loss) / sum(weight), 6) AS mean_loss FROM x""")
def q90_weighted_loss(spark, sf_dir):
    weights = counts.class_weights(table(spark, sf_dir, "embeddings"), "label").select(F.col("label").alias("class_id"), "weight")
    return _rounded(evaluate.weighted_loss(_predictions(spark, sf_dir), weights), "mean_loss", digits=6)


@query(f"""WITH {_ITEMS}, b AS (SELECT step - 1 AS step, truth, pred, n FROM m)
SELECT coalesce(a.step, b.step) AS step, coalesce(a.truth, b.truth) AS truth, coalesce(a.pred, b.pred) AS pred, a.n::BIGINT AS left, b.n::BIGINT AS right
FROM m a FULL JOIN b ON a.step = b.step AND a.truth = b.truth AND a.pred = b.pred WHERE a.n IS DISTINCT FROM b.n""")
def q91_cell_differences(spark, sf_dir):
    """Every step's confusion matrix against the next one's."""
    matrices = evaluate.confusion_counts(_line_items(spark, sf_dir), ["step"])
    return lookups.cell_differences(matrices, matrices.withColumn("step", F.col("step") - 1), ["step", "truth", "pred"], "n")


# ---- orders and plans -------------------------------------------------------
@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS position FROM part")
def q92_natural_order(spark, sf_dir):
    """Parts numbered in the natural order of names such as item7x30: numbers compare as numbers."""
    name = F.concat(F.lit("item"), F.col("p_size").cast("string"), F.lit("x"), F.col("p_partkey").cast("string"))
    named = ordering.natural_sort(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name")
    return ranks.numbered(named, [S.natural_key("name"), "name"]).select("p_partkey", "position")


@query("WITH c AS (SELECT source, count(*) AS num_samples FROM documents GROUP BY source) SELECT source, num_samples, (SELECT floor(median(num_samples))::BIGINT FROM c) AS goal FROM c")
def q93_class_target(spark, sf_dir):
    return augment.class_target(counts.samples_per_class(table(spark, sf_dir, "documents"), "source"), "median", cls="source")


METHODS = {"volume": 1.0, "time_shift": 2.0, "add_bg": 0.5}


@query(f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), g AS (SELECT floor(median(n))::BIGINT AS goal FROM c),
r AS (SELECT doc_id, d.source, n, goal, row_number() OVER (PARTITION BY d.source ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS nth FROM documents d JOIN c ON c.source = d.source, g),
k AS (SELECT *, greatest(goal - n, 0) AS short FROM r WHERE nth <= goal),
x AS (SELECT doc_id, source, unnest(range(0, short // n + (nth <= short % n)::INT + 1)) AS copy FROM k),
m AS (SELECT doc_id, source, copy, unnest({list(METHODS)}) AS method, unnest({list(METHODS.values())}::DOUBLE[]) AS w FROM x WHERE copy > 0),
b AS (SELECT doc_id, copy, arg_min(method, -ln((('0x' || substr(md5('42:' || method || ':' || doc_id || ':' || copy), 1, 12))::BIGINT + 1)::DOUBLE / (281474976710656.0 + 1)::DOUBLE) / w) AS method FROM m GROUP BY ALL)
SELECT source, x.doc_id, x.copy, method FROM x LEFT JOIN b ON b.doc_id = x.doc_id AND b.copy = x.copy
""")
def q94_balance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    targets = augment.class_target(counts.samples_per_class(d, "source"), "median", cls="source")
    return augment.balance_to_target(d, targets, METHODS, cls="source", ident="doc_id")


# ---- files that are written and read back -----------------------------------
@query("""
WITH e AS (SELECT event_id, event_id * 1.5 AS b, event_type, user_id FROM events)
SELECT event_id::VARCHAR AS number, b::DOUBLE AS low_val, (b + 2.25)::DOUBLE AS high_val, event_type AS species, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id || '|other' ELSE '' END AS mix FROM e
""")
def q95_selection_tables(spark, sf_dir):
    """Events as selection tables: written as tab-separated files and read as annotations."""
    begin = (F.col("event_id") * 1.5).cast("double")
    mix = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(", other,")))
    values = [F.col("event_id"), F.lit("Spectrogram 1"), F.lit(1), begin, begin + 2.25, F.lit(500.0), F.lit(8000.0), F.col("event_type"), F.lit("call"), F.col("event_id"), mix]
    path = _folder(spark, "selections")
    table(spark, sf_dir, "events").select(*[v.cast("string").alias(c) for v, c in zip(values, annotations.COLUMNS)]).write.csv(path, sep="\t", header=True)
    return annotations.read_selection_tables(spark, path).select("number", "time_interval.low_val", "time_interval.high_val", "species", F.array_join("mix", "|").alias("mix"))


@query(f"""WITH {_PRED}, l AS (SELECT vec_id // 50 AS step, CASE WHEN vec_id % 3 > 0 THEN 'training' ELSE 'validating' END AS phase, vec_id, pred, label FROM p)
SELECT step::INT AS step, phase, (row_number() OVER (PARTITION BY step, phase ORDER BY vec_id) - 1)::INT AS position, pred, label FROM l""")
def q96_prediction_log(spark, sf_dir):
    """Fifty predictions an epoch: written as a log of lists and read as one row each."""
    p = _predictions(spark, sf_dir)
    phase = F.when(F.col("vec_id") % 3 > 0, "training").otherwise("validating")
    path = _folder(spark, "predictions")
    logs.write_prediction_log(p.select(F.expr("vec_id div 50").cast("int").alias("step"), phase.alias("phase"), F.col("vec_id").alias("position"), "pred", "label"), path)
    return logs.read_prediction_log(spark, path).select("step", "phase", "position", "pred", "label")


@query("""WITH c AS (SELECT c_nationkey AS epoch, min(c_mktsegment) AS segment, count(*) AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer GROUP BY c_nationkey)
SELECT epoch, segment, n, ((2 * cents + n) // (2 * n))::DOUBLE / 100::DOUBLE AS mean FROM c""")
def q97_run_log(spark, sf_dir):
    """Customers of a nation as an epoch: written as JSON lines under a header and read back."""
    epochs = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("epoch")).agg(F.min("c_mktsegment").alias("segment"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    # in whole cents, so that a mean that lies half way is rounded alike everywhere
    epochs = epochs.select("epoch", "segment", "n", (F.expr("(2 * cents + n) div (2 * n)").cast("double") / 100).alias("mean"))
    path = _folder(spark, "runs")
    logs.write_run_log(epochs, path, "epoch")
    return logs.read_run_log(spark, path, [("epoch", "int"), ("segment", "string"), ("n", "bigint"), ("mean", "double")])


@query(f"WITH {_PRED} SELECT 'c' || truth AS truth, 'c' || pred AS pred, n::DOUBLE AS n FROM m")
def q98_confusion_csv(spark, sf_dir):
    """A confusion matrix as a file with a row per truth, read in long form."""
    m = evaluate.confusion_matrix(_predictions(spark, sf_dir), _classes(spark))
    wide = m.groupBy("truth").pivot("pred", list(range(10))).agg(F.first("n"))
    line = wide.select("truth", F.concat_ws(",", F.concat(F.lit("c"), F.col("truth").cast("string")), *[F.col(str(i)).cast("string") for i in range(10)]).alias("value"))
    head = spark.range(1).select(F.lit(-1).alias("truth"), F.lit("," + ",".join(f"c{i}" for i in range(10))).alias("value"))
    path = _folder(spark, "matrix")
    head.unionByName(line).orderBy("truth").coalesce(1).select("value").write.text(path)
    return logs.read_confusion_csv(spark, path)


@query(f"""WITH {_PRED}, u AS (SELECT c::VARCHAR AS class_id, unnest(['precision', 'recall', 'f1']) AS measure, unnest([p, r, f]) AS value FROM v)
SELECT measure, class_id, round(value, 9) AS value FROM u UNION ALL SELECT 'accuracy', NULL, round(sum(tp) / sum(actual), 9) FROM v""")
def q99_metric_rows(spark, sf_dir):
    """Metrics of a run, and of each class, written as a file and read back."""
    matrix = evaluate.confusion_counts(_predictions(spark, sf_dir))
    path = _folder(spark, "metrics")
    logs.write_metric_csv(evaluate.summary_scores(matrix).select("accuracy"), path, evaluate.class_scores(matrix))
    return _rounded(spark.read.csv(path, header=True, schema="measure string, class_id string, value double"), "value")


@query("SELECT 'c' || o_custkey AS phylo_name, o_orderkey::VARCHAR AS _xeno_canto_id, o_orderpriority AS type, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS position FROM orders")
def q100_collection_lines(spark, sf_dir):
    """Customers' orders as a collection of recordings, written as JSON lines and read back."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("phylo_name"), F.col("o_orderkey").cast("string").alias("_xeno_canto_id"), F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("position"))
    path = _folder(spark, "collection")
    collections.write_collection(o, path)
    return collections.read_collection_lines(spark, path).select("phylo_name", "_xeno_canto_id", "type", "position")
