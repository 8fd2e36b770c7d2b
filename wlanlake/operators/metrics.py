"""Scores of predictions against the truth, all from counts of (truth, prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.labels import label_name
from wlanlake.operators.layout import slice_of, value_cuts
from wlanlake.session import store

CLASS_IDS = list(range(len(spec.CLASSES)))
# 33 thresholds from 0.10 to 0.90 in equal steps.
THRESHOLDS = [0.1 + i * 0.025 for i in range(32)] + [0.9]


def predictions_truth(pred: DataFrame, truth: DataFrame, keys=("block_id", "frame_number")) -> DataFrame:
    """Predictions next to the truth of the same frame; the key is unique on both sides."""
    return pred.join(truth, list(keys))


def pair_counts(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Rows per (truth, prediction): at most 81 groups, and all any metric needs."""
    return df.groupBy(
        F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """One row per true class, one column per predicted class, every class present."""
    counted = pair_counts(df, truth, pred).groupBy("truth").pivot("pred", CLASS_IDS).agg(F.sum("n"))
    classes = df.sparkSession.createDataFrame([(i,) for i in CLASS_IDS], "truth int")
    full = classes.join(counted, "truth", "left").na.fill(0)
    return full.withColumnsRenamed({str(i): f"pred_{i}" for i in CLASS_IDS})


def per_class_metrics(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class.

    A class the truth lacks has no scores (it could not be tested), but its false
    positives are still told.
    """
    pairs = pair_counts(df, truth, pred)
    classes = df.sparkSession.createDataFrame([(i,) for i in CLASS_IDS], "label int")
    is_true, is_pred = F.col("truth") == F.col("label"), F.col("pred") == F.col("label")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    # Nine classes against at most 81 pair counts.
    sums = (
        classes.join(F.broadcast(pairs), is_true | is_pred, "left")
        .groupBy("label")
        .agg(
            total(is_true & is_pred).alias("tp"),
            total(is_pred & ~is_true).alias("fp"),
            total(is_true & ~is_pred).alias("fn"),
        )
        .withColumn("support", F.col("tp") + F.col("fn"))
    )
    tested = F.col("support") > 0
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return sums.select(
        "label",
        label_name("label").alias("class"),
        F.when(tested, precision).alias("precision"),
        F.when(tested, F.col("tp") / F.col("support")).alias("recall"),
        F.when(tested, f1).alias("f1"),
        "support",
        F.when(~tested, F.col("fp")).alias("absent_false_positives"),
    )


def macro_f1(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Mean F1 over the classes the truth holds; 0 for no rows."""
    scores = per_class_metrics(df, truth, pred)
    return scores.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def threshold_sweep(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Precision, recall and F1 of the positive class at 33 thresholds.

    Each row is counted once under the number of thresholds it reaches; the thresholds'
    own counts are sums over that 34-row table.
    """
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: t <= F.col(score)))
    counts = df.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    grid = df.sparkSession.createDataFrame(
        [(i + 1, t) for i, t in enumerate(THRESHOLDS)], "step int, threshold double"
    )

    def total(column, condition):
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    over = F.col("reached") >= F.col("step")
    sums = (
        grid.crossJoin(F.broadcast(counts))
        .groupBy("step", "threshold")
        .agg(
            total("pos", over).alias("tp"), total("neg", over).alias("fp"), total("pos", ~over).alias("fn")
        )
    )
    zero = F.lit(0.0)
    return sums.select(
        "threshold",
        F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), zero).alias("precision"),
        F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), zero).alias("recall"),
        F.coalesce(
            2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), zero
        ).alias("f1"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the best F1."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return sweep.agg(best.alias("b")).select("b.threshold", "b.f1")


def score_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Rows per distinct score: ``s``, ``pos``, ``neg`` and the ``slice`` of the score.

    Slices hold about as many distinct scores each, wherever these pile up; a score of many rows is one
    counted row.
    """
    points = store(
        df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")),
        "scores",
    )
    # One row of fixed length.
    cuts = value_cuts(points, [], "s")
    return points.crossJoin(F.broadcast(cuts)).select("s", "pos", "neg", slice_of("s").alias("slice"))


def auc_report(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact ROC-AUC and average precision; rows without a score (NULL or NaN) are left out.

    Rows are counted per distinct score; running counts come from slices of the distinct scores, so no
    task sorts them all.
    """
    points = score_points(df, truth, score)
    sums = points.groupBy("slice").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    # At most 1024 rows.
    down = Window.orderBy(F.desc("slice"))
    offsets = sums.select(
        "slice",
        (F.sum("p").over(down) - F.col("p")).alias("_p"),
        (F.sum("q").over(down) - F.col("q")).alias("_q"),
    )
    totals = sums.agg(F.sum("p").alias("P"), F.sum("q").alias("N"))
    inside = Window.partitionBy("slice").orderBy(F.desc("s"))
    curve = (
        points.join(F.broadcast(offsets), "slice")
        .withColumn("tp", F.col("_p") + F.sum("pos").over(inside))
        .withColumn("fp", F.col("_q") + F.sum("neg").over(inside))
        .crossJoin(F.broadcast(totals))
    )
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.nullif(
        F.max("P") * F.max("N"), F.lit(0)
    )
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("P"), F.lit(0))
    return curve.agg(area.alias("roc_auc"), step.alias("average_precision"))


def scored_report(df: DataFrame, thr1: float = spec.STAGE1_THRESHOLD, verdict: str = "verdict") -> DataFrame:
    """One row about a scored capture: frames, span, how many passed each stage."""
    hot = F.count_if(F.col(f"{verdict}.p1") >= thr1)
    kept = F.count_if(F.col(f"{verdict}.is_attack") & F.col(f"{verdict}.label").isNotNull())
    n = F.count(F.lit(1))
    timed = F.when(F.col("epoch").isNotNull(), F.col("frame_number"))
    first, last = F.min_by("epoch", timed), F.max_by("epoch", timed)
    return df.agg(
        n.alias("packets"),
        (last - first).alias("capture_span_s"),
        hot.alias("stage1_hot"),
        F.when(n > 0, 100.0 * hot / n).otherwise(0.0).alias("stage1_attack_rate_pct"),
        kept.alias("attacks_persisted"),
        F.when(n > 0, 100.0 * kept / n).otherwise(0.0).alias("persist_rate_pct"),
    )


def scored_labels(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Per class: frames considered at stage 2, and frames kept."""
    return (
        df.filter((F.col(f"{verdict}.stage") == 2) & F.col(f"{verdict}.label").isNotNull())
        .groupBy(F.col(f"{verdict}.label").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("considered"),
            F.count_if(F.col(f"{verdict}.is_attack")).alias("persisted"),
        )
    )
