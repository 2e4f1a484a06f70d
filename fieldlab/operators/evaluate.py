"""Scores of classifiers: confusion matrices, precision, recall, F1, precision-recall curves, run summaries.

Predictions are a long table (run_id, step, phase, sample_id, label, pred,
logits). One shuffle turns them into counts per (truth, pred); all other
measures come from those few rows. Matrices are in long form too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.functions import scalars as S

THRESHOLDS = (0.2, 0.4, 0.6, 0.8)


# ---- confusion matrices -----------------------------------------------------
def confusion_counts(predictions: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """(by..., truth, pred, n) of the pairs that occur."""
    return predictions.groupBy(*by, F.col(label).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: DataFrame, *, cls: str = "class_id", label: str = "label", pred: str = "pred") -> DataFrame:
    """(truth, pred, n) of all pairs of known classes, zeros included."""
    truths, preds = classes.select(F.col(cls).alias("truth")), classes.select(F.col(cls).alias("pred"))
    grid = truths.crossJoin(preds)  # classes squared, which is what a matrix holds
    return grid.join(confusion_counts(predictions, label=label, pred=pred), ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def normalize_rows(matrix: DataFrame, fill: float | None = None) -> DataFrame:
    """Adds `share`: n / sum of the truth's row; for an empty row `fill`, by default null."""
    total = F.sum("n").over(Window.partitionBy("truth"))
    share = F.when(total != 0, F.col("n") / total)
    return matrix.withColumn("share", share if fill is None else F.coalesce(share, F.lit(float(fill))))


def confusion_percent(matrix: DataFrame) -> DataFrame:
    """(truth, pred, percent): whole percents of the row, truncated."""
    return normalize_rows(matrix).select("truth", "pred", F.floor(F.col("share") * 100).cast("int").alias("percent"))


def aggregate_matrices(matrices: DataFrame, step: str = "step") -> DataFrame:
    """Mean of the matrices of the steps: sum of n over the steps there are."""
    steps = matrices.agg(F.countDistinct(step).alias("_steps"))
    return matrices.groupBy("truth", "pred").agg(F.sum("n").alias("_n")).crossJoin(steps).select("truth", "pred", (F.col("_n") / F.col("_steps")).alias("mean_n"))  # steps is one row


def paired_class_precision(matrix: DataFrame) -> DataFrame:
    """(pair, share): classes 2k and 2k+1 as one; hits / truths of the pair."""
    paired = matrix.select(F.floor(F.col("truth") / 2).alias("pair"), F.floor(F.col("pred") / 2).alias("got"), "n")
    return paired.groupBy("pair").agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("pair") == F.col("got"), F.col("n"))).alias("_hit")).select("pair", (F.coalesce("_hit", F.lit(0)) / F.when(F.col("_all") != 0, F.col("_all"))).alias("share"))


def truth_totals(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("truth").agg(F.sum("n").alias("total"))


# ---- precision, recall, F1 --------------------------------------------------
def prec_rec_components(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cls, tp, predicted, actual, in_truth) of each class in truth or predictions."""
    # each cell counts for its truth's row and for its prediction's column
    sides = F.array(
        F.struct(F.col("truth").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    each = matrix.where("n > 0").select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    return each.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual")).withColumn("in_truth", F.col("actual") > 0)


def class_scores(matrix: DataFrame, zero_division: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cls, precision, recall, f1, support); undefined ones are zero_division."""
    c = prec_rec_components(matrix, by)
    z = F.lit(float(zero_division))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(z)
    r = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(z)
    f = F.when(F.col("predicted") + F.col("actual") > 0, 2 * F.col("tp") / (F.col("predicted") + F.col("actual"))).otherwise(z)
    return c.select(*by, "cls", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("actual").alias("support"), "tp", "predicted", "in_truth")


def _summary(name: str) -> list[Column]:
    weighted = F.sum(F.col(name) * F.col("support")) / F.sum("support")
    return [F.avg(name).alias(f"{name}_macro"), weighted.alias(f"{name}_weighted")]


def summary_scores(matrix: DataFrame, zero_division: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """One row (per `by`): accuracy, balanced and adjusted balanced accuracy, macro, micro and weighted precision, recall and F1."""
    c = class_scores(matrix, zero_division, by)
    micro = F.sum("tp") / F.sum("support")
    measures = [
        micro.alias("accuracy"), F.avg(F.when(F.col("in_truth"), F.col("recall"))).alias("balanced_accuracy"), F.count_if(F.col("in_truth")).alias("_k"),
        *_summary("precision"), *_summary("recall"), *_summary("f1"),
        (F.sum("tp") / F.sum("predicted")).alias("precision_micro"), micro.alias("recall_micro"), (2 * F.sum("tp") / (F.sum("predicted") + F.sum("support"))).alias("f1_micro"),
    ]
    out = (c.groupBy(*by) if by else c).agg(*measures)
    chance = 1 / F.col("_k")
    return out.withColumn("adjusted_balanced_accuracy", F.when(F.col("_k") > 1, (F.col("balanced_accuracy") - chance) / (1 - chance))).drop("_k")


def place_on_all_classes(scores: DataFrame, classes: DataFrame, cls: str = "class_id") -> DataFrame:
    """Scores of every known class; those of classes absent from the truth are null."""
    known = classes.select(F.col(cls).alias("cls"))
    return known.join(scores.where("in_truth"), "cls", "left").select("cls", "precision", "recall", "f1", "support")


def loss_summary(losses: DataFrame, by: Sequence[str] = ("run_id", "step", "phase"), batch_size: str = "batch_size") -> DataFrame:
    return losses.groupBy(*by).agg(F.avg(F.col("loss") / F.col(batch_size)).alias("mean_loss"))


def weighted_loss(predictions: DataFrame, weights: DataFrame, *, logits: str = "logits", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by..., mean_loss): cross entropy with the weight (class_id, weight) of each row's truth, over the sum of those weights."""
    weighed = predictions.join(weights.select(F.col("class_id").alias(label), "weight"), label)
    loss = F.sum(F.col("weight") * S.cross_entropy(logits, label)) / F.sum("weight")
    return (weighed.groupBy(*by) if by else weighed).agg(loss.alias("mean_loss"))


# ---- precision-recall curves ------------------------------------------------
def pr_curve(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS, *, cls: str | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """(cls, i, threshold, precision, recall, f1 and whether each was undefined) from 0/1 labels and scores.

    Each row is counted for all thresholds it passes in one pass; the counts
    of a class are one row with an array per measure. Precision of no
    predictions, recall of no positives and F1 of both zero are 0.
    """
    by = [cls] if cls else []
    one = F.col(label) == 1
    counts = [F.array(*[F.count_if((F.col(score) >= t) & one) for t in thresholds]).alias("tp"), F.array(*[F.count_if(F.col(score) >= t) for t in thresholds]).alias("got"), F.count_if(one).alias("actual")]
    each = (scored.groupBy(*by) if by else scored.groupBy()).agg(*counts)
    pos = F.posexplode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in thresholds]).alias("threshold"), "tp", "got"))
    rows = each.select(*by, "actual", pos.alias("i", "x")).select(*by, "i", "actual", F.col("x.threshold").alias("threshold"), F.col("x.tp").alias("tp"), F.col("x.got").alias("got"))
    p = F.when(F.col("got") > 0, F.col("tp") / F.col("got")).otherwise(0.0)
    r = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0)
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    s = F.col("precision") + F.col("recall")
    return rows.select(
        *by, "i", "threshold", "precision", "recall", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0).alias("f1"),
        (F.col("got") == 0).alias("undef_prec"), (F.col("actual") == 0).alias("undef_rec"), (s == 0).alias("undef_f1"),
    )


def best_operating_point(curve: DataFrame, cls: str | None = None) -> DataFrame:
    """(cls, threshold, f1, precision, recall) with the largest F1, the first threshold of ties."""
    point = F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct(F.col("f1"), -F.col("i"))).alias("p")
    out = (curve.groupBy(cls) if cls else curve.groupBy()).agg(point)
    return out.select(*([cls] if cls else []), "p.*")


def average_precision(curve: DataFrame, cls: str | None = None) -> DataFrame:
    """(cls, average_precision): sum of precision times the fall of recall to the next threshold; the last falls to 0."""
    order = Window.partitionBy(*([cls] if cls else [])).orderBy("i")
    stepped = curve.withColumn("_fall", F.col("recall") - F.lead("recall", 1, 0.0).over(order))
    return (stepped.groupBy(cls) if cls else stepped.groupBy()).agg(F.sum(F.col("precision") * F.col("_fall")).alias("average_precision"))


def curve_summary(curve: DataFrame, cls: str = "cls") -> DataFrame:
    """One row per class: best operating point, average precision, whether any measure was undefined at some threshold."""
    undefined = curve.groupBy(cls).agg(*[F.bool_or(c).alias(c) for c in ("undef_prec", "undef_rec", "undef_f1")])
    return best_operating_point(curve, cls).join(average_precision(curve, cls), cls).join(undefined, cls)


def one_vs_all(predictions: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """(cls, label, score): each sample once per class, with the softmax share as score."""
    return predictions.select(F.col(label).alias("_label"), F.posexplode(S.softmax(logits)).alias("cls", "score")).select("cls", (F.col("_label") == F.col("cls")).cast("int").alias("label"), "score")


def pr_curves_multiclass(predictions: DataFrame, thresholds: Sequence[float] = THRESHOLDS, logits: str = "logits", label: str = "label") -> DataFrame:
    return pr_curve(one_vs_all(predictions, logits, label), thresholds, cls="cls")


def mean_average_precision(curves: DataFrame, cls: str = "cls") -> DataFrame:
    return average_precision(curves, cls).agg(F.avg("average_precision").alias("mean_average_precision"))


def testing_result_summary(predictions: DataFrame, thresholds: Sequence[float] = THRESHOLDS, classes: int | None = None) -> DataFrame:
    """(cls, average_precision) of 0/1 decisions, and mean_average_precision over the classes."""
    k = F.lit(classes - 1) if classes else F.max(F.greatest("label", "pred")).over(Window.partitionBy())
    numbered = predictions.select("label", "pred", k.alias("_k")) if classes else predictions.join(predictions.agg(F.max(F.greatest("label", "pred")).alias("_k")))
    each = numbered.select("label", "pred", F.explode(F.sequence(F.lit(0), "_k")).alias("cls")).select("cls", (F.col("label") == F.col("cls")).cast("int").alias("label"), (F.col("pred") == F.col("cls")).cast("double").alias("score"))
    ap = average_precision(pr_curve(each, thresholds, cls="cls"), "cls")
    return ap.withColumn("mean_average_precision", F.avg("average_precision").over(Window.partitionBy()))


def best_and_worst_curve(summaries: DataFrame, cls: str = "cls") -> DataFrame:
    """One row (best, worst): the classes with the largest and smallest F1 at their best point, lower class first on ties."""
    return summaries.agg(F.max_by(cls, F.struct(F.col("f1"), -F.col(cls))).alias("best"), F.min_by(cls, F.struct(F.col("f1"), F.col(cls))).alias("worst"))


# ---- epochs and runs --------------------------------------------------------
def epoch_summary(predictions: DataFrame, losses: DataFrame | None = None, by: Sequence[str] = ("run_id", "step", "phase"), zero_division: float = 1.0) -> DataFrame:
    """All summary scores per run, step and phase, with the mean loss if there are losses."""
    out = summary_scores(confusion_counts(predictions, by), zero_division, by)
    return out if losses is None else out.join(loss_summary(losses, by), list(by), "left")


def run_leaderboard(epochs: DataFrame, run: str = "run_id", step: str = "step", phase: str = "phase", metrics: Sequence[str] = ("accuracy", "f1_macro")) -> DataFrame:
    """One row per run: the last step's metrics of each phase, as <metric>_<phase>."""
    last = epochs.groupBy(run, phase).agg(F.max_by(F.struct(*metrics), step).alias("m"), F.max(step).alias("last_step"))
    columns = [F.max(F.when(F.col(phase) == p, F.col(f"m.{m}"))).alias(f"{m}_{p}") for p in ("training", "validating", "testing") for m in metrics]
    return last.groupBy(run).agg(F.max("last_step").alias("last_step"), *columns)


def plateau(epochs: DataFrame, value: str = "accuracy", *, run: str = "run_id", step: str = "step", window: int = 5, least: float = 0.05, min_epochs: int = 15) -> DataFrame:
    """Adds mean_diff, the mean difference of the last `window` values, and stop."""
    order = Window.partitionBy(run).orderBy(step)
    recent = order.rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(recent)
    diff = F.when(n > 1, F.abs(F.col(value) - F.first(value).over(recent)) / (n - 1))
    out = epochs.withColumn("mean_diff", diff).withColumn("_n", F.row_number().over(order))
    return out.withColumn("stop", F.coalesce((F.col("mean_diff") < least) & (F.col("_n") > min_epochs), F.lit(False))).drop("_n")


def recent_history(epochs: DataFrame, value: str, n: int, *, run: str = "run_id", step: str = "step", phase: str = "phase", phases: Sequence[str] = ("training", "validating"), strict: bool = False) -> DataFrame:
    """(run, step, one column per phase) of each run's last n steps. strict: fail if a run has no steps of one of the phases, or not the same number of them."""
    if strict:
        held = epochs.where(F.col(phase).isin(*phases)).groupBy(run).agg(*[F.count_if(F.col(phase) == p).alias(p) for p in phases])
        if epochs.isEmpty() or not held.where(" OR ".join(f"`{p}` <> `{phases[0]}` OR `{p}` = 0" for p in phases)).isEmpty():
            raise ValueError("the phases of a run have different numbers of steps")
    wide = epochs.groupBy(run, step).agg(*[F.max(F.when(F.col(phase) == p, F.col(value))).alias(p) for p in phases])
    return wide.withColumn("_back", F.row_number().over(Window.partitionBy(run).orderBy(F.col(step).desc()))).where(F.col("_back") <= n).drop("_back")


def per_class_train_val(scores: DataFrame, value: str = "f1", cls: str = "cls", phase: str = "phase", phases: Sequence[str] = ("training", "validating")) -> DataFrame:
    """(class, one column per phase), rounded to one digit. Without scores there is nothing to compare, which is an error."""
    if scores.isEmpty():
        raise ValueError("there are no scores")
    return scores.groupBy(cls).agg(*[F.round(F.max(F.when(F.col(phase) == p, F.col(value))), 1).alias(p) for p in phases])


def score_report(predictions: DataFrame, classes: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> dict[str, DataFrame]:
    """Everything about one table of predictions: matrix, percents, class scores, summary, curves and their summaries."""
    matrix = confusion_matrix(predictions, classes)
    curves = pr_curves_multiclass(predictions, thresholds)
    return {
        "matrix": matrix, "percent": confusion_percent(matrix), "class_scores": class_scores(matrix), "summary": summary_scores(matrix),
        "curves": curves, "curve_summaries": curve_summary(curves), "map": mean_average_precision(curves),
    }
