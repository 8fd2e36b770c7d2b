"""Training, scoring and probing frame classifiers with MLlib."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.verdicts import verdict, verdict_two_stage
from wlanlake.operators import dataset, metrics
from wlanlake.operators.layout import union_all, with_position
from wlanlake.operators.rollups import causal_rollups
from wlanlake.operators.windows import densest_window
from wlanlake.session import store
from wlanlake.sources.shards import rows_by_split

N_CLASSES = len(spec.CLASSES)
# Far below every real value, so that a tree can split "absent" off.
ABSENT = -1.0e6


@dataclass
class BoostedClasses:
    """One boosted ensemble for each class against the rest; their probabilities are normalised.

    A class that training lacked has none, and probability 0.
    """

    models: dict[int, GBTClassificationModel]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (a vector over the classes) and ``prediction``, as other classifiers do."""
        keep = df.columns
        for i, model in self.models.items():
            df = model.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_p{i}").setPredictionCol(f"_c{i}").transform(df)
            df = df.withColumn(f"_p{i}", vector_to_array(f"_p{i}")[1]).drop(f"_raw{i}", f"_c{i}")
        p = F.array(*[F.col(f"_p{i}") if i in self.models else F.lit(0.0) for i in range(N_CLASSES)])
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        shares = df.select(*keep, F.transform(p, lambda x: x / total).alias("_shares"))
        best = F.array_position("_shares", F.array_max("_shares")) - 1
        return shares.withColumns(
            {"probability": array_to_vector("_shares"), "prediction": best.cast("double"), "rawPrediction": F.lit(None)}
        ).drop("_shares")

    @property
    def featureImportances(self) -> np.ndarray:
        """Mean over the ensembles; one that never splits has none."""
        each = [m.featureImportances.toArray() for m in self.models.values()]
        total = np.sum([e for e in each if e.sum() > 0] or each, axis=0)
        return total / total.sum() if total.sum() > 0 else total


@dataclass
class FrameModel:
    """A fitted classifier and the columns it was fitted on, in order."""

    model: RandomForestClassificationModel | PipelineModel | BoostedClasses
    columns: list[str]
    history: list[tuple[int, float]] = field(default_factory=list)


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature vector in the given order; MLlib takes no NULL, absent becomes the sentinel."""
    filled = df.withColumns({f"_x_{c}": F.expr(f"coalesce(double({c}), {ABSENT}D)") for c in columns})
    packed = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="features").transform(filled)
    return packed.drop(*[f"_x_{c}" for c in columns])


def _class_probabilities(vector: Column) -> Column:
    """Probabilities for all classes; a model that never saw the last ones gives fewer."""
    p = vector_to_array(vector)
    return F.concat(p, F.array_repeat(F.lit(0.0), F.lit(N_CLASSES) - F.size(p)))


def _weighted(df: DataFrame, label: str, alpha: float, cap: float | None) -> DataFrame:
    return dataset.with_weights(df, dataset.class_weights(df, label, alpha, cap), label)


def _forest(rows: DataFrame, label: str, trees: int, depth: int, seed: int):
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight",
        numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False,
    ).fit(rows)


def train_multiclass(
    train: DataFrame,
    val: DataFrame | None = None,
    columns: list[str] | None = None,
    *,
    trees: list[int] = (20, 40, 80),
    depth: int = 10,
    alpha: float = 0.5,
    cap: float | None = 100.0,
    seed: int = 1337,
) -> FrameModel:
    """Forest over all classes with capped class weights.

    Grows through the given sizes and stops when the validation macro-F1 no longer rises.
    Without validation rows there is nothing to choose by, so one size has to be given.
    """
    if val is None and len(trees) != 1:
        raise ValueError(f"no validation rows to choose from the sizes {list(trees)}; give one")
    columns = columns or spec.FLAT_MODEL_COLUMNS
    rows = assemble(_weighted(train, "label", alpha, cap), columns)
    rows = rows.withColumn("label", F.col("label").cast("double")).select("label", "weight", "features")
    best, best_score, history = None, -1.0, []
    for n in trees:
        model = _forest(rows, "label", n, depth, seed)
        if val is None:
            return FrameModel(model, columns)
        score = score_of(predict(FrameModel(model, columns), val))
        history.append((n, score))
        if score <= best_score:
            break
        best, best_score = model, score
    return FrameModel(best, columns, history)


def train_boosted(
    train: DataFrame,
    val: DataFrame,
    columns: list[str] | None = None,
    *,
    rounds: int = 40,
    depth: int = 5,
    rate: float = 0.1,
    alpha: float = 0.5,
    cap: float | None = 100.0,
    least_gain: float = 0.001,
    seed: int = 1337,
    at_once: int = 3,
) -> FrameModel:
    """Boosted trees over all classes with capped class weights, each stopped on the validation rows.

    A class is boosted against the rest until its weighted loss on the validation rows no longer falls by
    ``least_gain``; probabilities of the classes are normalised. ``history`` has, for each round, the mean
    loss over the classes: an ensemble that has stopped keeps its last loss. ``at_once`` ensembles are
    fitted side by side. A class without training rows gets no ensemble; its validation rows count once.
    """
    columns = columns or spec.FLAT_MODEL_COLUMNS
    weights = store(dataset.class_weights(train, "label", alpha, cap), "weights")
    both = train.select("label", *columns).withColumn("_val", F.lit(False)).unionByName(
        val.select("label", *columns).withColumn("_val", F.lit(True))
    )
    known = F.broadcast(weights.select(F.col("label").alias("_label"), "weight"))
    weighted = both.join(known, F.col("label").cast("int") == F.col("_label"), "left").na.fill(1.0, ["weight"])
    rows = store(assemble(weighted, columns).select("label", "weight", "features", "_val"), "boosting")

    def fit(i: int) -> tuple[GBTClassificationModel, list[float]]:
        of_class = rows.withColumn("target", (F.col("label") == i).cast("double"))
        model = GBTClassifier(
            labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed,
            validationIndicatorCol="_val", validationTol=least_gain,
        ).fit(of_class)
        return model, model.evaluateEachIteration(of_class.filter("_val"))

    classes = sorted(r["label"] for r in weights.collect())
    if not classes:
        raise ValueError("no training rows")
    with ThreadPool(at_once) as pool:
        found = pool.map(inheritable_thread_target(rows.sparkSession)(fit), classes)
    longest = max(len(losses) for _, losses in found)
    padded = [losses + losses[-1:] * (longest - len(losses)) for _, losses in found]
    history = [(r + 1, math.fsum(losses[r] for losses in padded) / len(padded)) for r in range(longest)]
    return FrameModel(BoostedClasses({i: m for i, (m, _) in zip(classes, found)}), columns, history)


# ---- bundles ------------------------------------------------------------------------------

_KINDS = {"forest": RandomForestClassificationModel, "boosted": GBTClassificationModel}


class BundleMismatch(ValueError):
    """A stored model was made for other columns, classes or thresholds than are asked for."""


def save_bundle(
    fitted: FrameModel, path: str, thr1: float = spec.STAGE1_THRESHOLD, thr2: float = spec.STAGE2_THRESHOLD
) -> str:
    """Write a model with all that is needed to use it rightly: columns in order, classes, thresholds, history.

    The contract is written last, so a folder without one is a write that did not end.
    """
    boosted = isinstance(fitted.model, BoostedClasses)
    models = fitted.model.models if boosted else {0: fitted.model}
    for i, model in models.items():
        model.write().save(f"{path}/model={i}")
    contract = {
        "kind": "boosted" if boosted else "forest",
        "models": list(models),
        "columns": fitted.columns,
        "classes": list(spec.CLASSES),
        "absent": ABSENT,
        "thresholds": [thr1, thr2],
        "history": [list(h) for h in fitted.history],
    }
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(contract),)], "value string").coalesce(1).write.text(f"{path}/contract")
    return path


def bundle_faults(contract: dict, columns: list[str] | None = None) -> list[str]:
    """Why a contract must not be used for the given columns (default: the model columns)."""
    want, got = columns or spec.FLAT_MODEL_COLUMNS, contract.get("columns", [])
    faults = []
    if set(got) != set(want):
        faults += [f"lacks column {c}" for c in want if c not in got] + [f"asks for column {c}" for c in got if c not in want]
    elif got != want:
        i = next(i for i, (a, b) in enumerate(zip(got, want, strict=False)) if a != b)
        faults.append(f"column {i} is {got[i]}, not {want[i]}")
    if contract.get("classes") != list(spec.CLASSES):
        faults.append(f"classes are {contract.get('classes')}")
    if contract.get("absent") != ABSENT:
        faults.append(f"absent values are {contract.get('absent')}, not {ABSENT}")
    cuts = contract.get("thresholds", [])
    if len(cuts) != 2 or not all(isinstance(t, float) and 0 < t < 1 for t in cuts):
        faults.append(f"thresholds are {cuts}")
    kind, models = contract.get("kind"), contract.get("models") or []
    if kind not in _KINDS or not models or not set(models) <= set(range(N_CLASSES if kind == "boosted" else 1)):
        faults.append(f"models {models} of kind {kind}")
    return faults


def read_contract(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/contract").first()["value"])


def load_bundle(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[FrameModel, tuple[float, float]]:
    """The model and its two thresholds; refused with every reason when it does not fit."""
    contract = read_contract(spark, path)
    faults = bundle_faults(contract, columns)
    if not faults:
        models = {i: _KINDS[contract["kind"]].load(f"{path}/model={i}") for i in contract["models"]}
        faults = [f"model {i} takes {m.numFeatures} columns" for i, m in models.items() if m.numFeatures != len(contract["columns"])]
    if faults:
        raise BundleMismatch(f"{path}: " + "; ".join(faults))
    model = BoostedClasses(models) if contract["kind"] == "boosted" else models[0]
    history = [(int(n), float(x)) for n, x in contract["history"]]
    return FrameModel(model, contract["columns"], history), tuple(contract["thresholds"])


def predict(fitted: FrameModel, df: DataFrame) -> DataFrame:
    """Rows with ``probability`` (all classes) and ``prediction`` (class id)."""
    kept = assemble(df, fitted.columns)
    if "label" in df.columns:
        kept = kept.withColumn("label", F.col("label").cast("int"))
    scored = fitted.model.transform(kept)
    return (
        scored.withColumn("probability", _class_probabilities(F.col("probability")))
        .withColumn("prediction", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction")
    )


def score_frames(
    fitted: FrameModel, df: DataFrame, thr1: float = spec.STAGE1_THRESHOLD, thr2: float = spec.STAGE2_THRESHOLD
) -> DataFrame:
    """Rows with the verdict of the decision rule."""
    return predict(fitted, df).withColumn("verdict", verdict("probability", thr1, thr2))


def score_of(predicted: DataFrame) -> float:
    return float(metrics.macro_f1(predicted).first()[0])


# ---- two stages ---------------------------------------------------------------------------


@dataclass
class TwoStageModel:
    stage1: PipelineModel
    stage2: RandomForestClassificationModel
    columns: list[str]


def train_two_stage(
    train: DataFrame,
    val: DataFrame,
    columns: list[str] | None = None,
    *,
    rounds: int = 20,
    depth: int = 5,
    trees: int = 20,
    seed: int = 42,
) -> TwoStageModel:
    """Boosted trees for attack or not, stopped on the validation rows, then a forest over
    the attack classes of the attack rows."""
    columns = columns or spec.FLAT_MODEL_COLUMNS
    both = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    both = both.withColumn("is_attack", (F.col("label") > 0).cast("double"))
    rows = assemble(both, columns).select("label", "is_attack", "features", "_val")
    stage1 = GBTClassifier(
        labelCol="is_attack", featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed,
        validationIndicatorCol="_val", validationTol=0.001,
    ).fit(rows)
    attacks = train.filter("label > 0").withColumn("attack", F.col("label").cast("int") - 1)
    weighted = _weighted(attacks, "attack", 1.0, None)
    packed = assemble(weighted, columns).select(F.col("attack").cast("double").alias("attack"), "weight", "features")
    return TwoStageModel(stage1, _forest(packed, "attack", trees, depth, seed), columns)


def score_two_stage(
    fitted: TwoStageModel, df: DataFrame, thr1: float = spec.STAGE1_THRESHOLD, thr2: float = spec.STAGE2_THRESHOLD
) -> DataFrame:
    packed = assemble(df, fitted.columns)
    first = fitted.stage1.transform(packed).withColumn("p1", vector_to_array("probability")[1])
    first = first.drop("probability", "rawPrediction", "prediction")
    second = fitted.stage2.transform(first).withColumn("class_probs", vector_to_array("probability"))
    out = second.withColumn("verdict", verdict_two_stage("p1", "class_probs", spec.ATTACK_CLASSES, thr1, thr2))
    return out.drop("features", "rawPrediction", "probability", "prediction", "class_probs", "p1")


# ---- evaluation and probes --------------------------------------------------------------------


def evaluate_split(fitted: FrameModel, rows: DataFrame, assignment: DataFrame, split: str = "test") -> DataFrame:
    """Scores per class on the blocks of one split, with the macro-F1 beside."""
    held_out = rows_by_split(rows, assignment).filter(F.col("split") == split)
    predicted = predict(fitted, held_out)
    per_class = metrics.per_class_metrics(predicted)
    return per_class.crossJoin(metrics.macro_f1(predicted))


def feature_importance(fitted: FrameModel) -> DataFrame:
    """Columns by importance: one number per column of the model."""
    spark = SparkSession.getActiveSession()
    found = fitted.model.featureImportances
    weights = (found if isinstance(found, np.ndarray) else found.toArray()).tolist()
    rows = sorted(zip(fitted.columns, weights, strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(i + 1, c, float(w)) for i, (c, w) in enumerate(rows)], "rank int, feature string, importance double"
    )


def top_features(fitted: FrameModel, n: int) -> list[str]:
    return [r.feature for r in feature_importance(fitted).orderBy("rank").limit(n).collect()]


def leakage_probe(
    fitted: FrameModel, train: DataFrame, test: DataFrame, top: int = 1, *, retrain: bool = True, **fit
) -> DataFrame:
    """What the score loses without the most important columns: absent at scoring, and
    retrained without them."""
    base = score_of(predict(fitted, test))
    found = []
    for name in top_features(fitted, top):
        blind = test.withColumn(name, F.lit(None).cast("float"))
        score = score_of(predict(fitted, blind))
        found.append((name, "score only", score, score - base))
        if retrain:
            rest = [c for c in fitted.columns if c != name]
            again = train_multiclass(train, None, rest, **fit)
            score = score_of(predict(again, test))
            found.append((name, "retrained", score, score - base))
    return train.sparkSession.createDataFrame(
        found, "feature string, probe string, macro_f1 double, delta double"
    )


def drop_features_retrain(train: DataFrame, test: DataFrame, drop: list[str], columns=None, **fit) -> DataFrame:
    """Macro-F1 of a model retrained without the named columns."""
    columns = [c for c in columns or spec.FLAT_MODEL_COLUMNS if c not in drop]
    return metrics.macro_f1(predict(train_multiclass(train, None, columns, **fit), test))


def stratified_cv(rows: DataFrame, columns=None, folds: int = 5, seed: int = 42, **fit) -> DataFrame:
    """Macro-F1 of every fold, with mean and population deviation."""
    folded = store(dataset.stratified_folds(rows, "label", folds, seed=seed), "folds")
    scores = []
    for i in range(folds):
        train, held = folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)
        model = train_multiclass(train, None, columns, alpha=1.0, cap=None, **fit)
        scores.append((i + 1, score_of(predict(model, held))))
    table = rows.sparkSession.createDataFrame(scores, "fold int, macro_f1 double")
    return table.crossJoin(table.agg(F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std")))


def shuffled_label_check(train: DataFrame, test: DataFrame, columns=None, seed: int = 42, **fit) -> DataFrame:
    """Macro-F1 after training on permuted labels, which should be no better than chance,
    next to the true one."""
    shuffled = store(dataset.shuffle_labels(train, "label", seed=seed), "shuffled")
    true = score_of(predict(train_multiclass(train, None, columns, **fit), test))
    chance = score_of(predict(train_multiclass(shuffled, None, columns, **fit), test))
    return train.sparkSession.createDataFrame(
        [("true labels", true), ("shuffled labels", chance)], "labels string, macro_f1 double"
    )


def contract_check(df: DataFrame, columns: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Every way a feature table departs from the contract, as rows (kind, expected, found).

    Names, order and types come from the schema; class ids and NaNs from one pass.
    """
    want = columns or spec.FLAT_MODEL_COLUMNS
    types = dict(df.dtypes)
    got = [c for c in df.columns if c not in ("session_id", "block_id", "frame_number", "label")]
    faults = []
    if len(got) != len(want):
        faults.append(("count", str(len(want)), str(len(got))))
    faults += [("missing", c, "") for c in want if c not in got]
    faults += [("extra", "", c) for c in got if c not in want]
    if sorted(got) == sorted(want) and got != want:
        i = next(i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b)
        faults.append(("order", f"{i}: {want[i]}", f"{i}: {got[i]}"))
    faults += [("type", f"{c} float", f"{c} {types[c]}") for c in want if c in types and types[c] != "float"]
    if stats is not None:
        known = set(stats.columns)
        faults += [("stats", c, "") for c in want if c not in known]
    checks = []
    if "label" in types:
        checks.append(
            f"struct('class id' as kind, '0..{N_CLASSES - 1}' as expected, "
            f"count_if(label is null or label < 0 or label >= {N_CLASSES}) as rows)"
        )
    checks += [
        f"struct('nan' as kind, '{c}' as expected, count_if(isnan({c})) as rows)"
        for c in want
        if types.get(c) in ("float", "double")
    ]
    schema = df.sparkSession.createDataFrame(faults, "kind string, expected string, found string")
    if not checks:
        return schema
    content = df.selectExpr(f"inline(array({', '.join(checks)}))").filter("rows > 0")
    return schema.unionByName(content.selectExpr("kind", "expected", "concat(rows, ' rows') as found"))


def require_contract(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    found = contract_check(df, columns)
    faults = found.limit(100).collect()
    if faults:
        lines = "\n".join(f"- {tuple(f)}" for f in faults)
        raise ValueError(f"the feature table breaks its contract in {found.count()} ways, the first ones are:\n{lines}")
    return df


def best_segments(
    fitted: FrameModel,
    features: DataFrame,
    assignment: DataFrame,
    *,
    split: str = "test",
    window: int = 512,
    max_window: int = 4096,
    target: int = 200,
    min_attacks: int = 20,
    **tiling,
) -> DataFrame:
    """Per class the held-out stretch that is detected best: correct rate, then attack rows
    up to the target, then the shorter one.

    A stretch is scored as a stream of its own, so its rolling columns start at its head.
    """
    held = rows_by_split(features, assignment).filter(F.col("split") == split).drop("split")
    held = store(with_position(held, **tiling), "held_out")
    present = held.groupBy("block_id", "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_attacks)
    stretches = []
    for i, name in enumerate(spec.ATTACK_CLASSES, start=1):
        found = densest_window(held, F.col("label") == i, window, max_window, target, **tiling)
        ok = present.filter(F.col("label") == i).select("block_id")
        stretches.append(found.join(ok, "block_id", "left_semi").select("block_id", "lo", "hi", F.lit(i).alias("want"), F.lit(name).alias("class")))
    chosen = union_all(stretches)
    rows = held.join(chosen, "block_id").filter((F.col("rn") >= F.col("lo")) & (F.col("rn") < F.col("hi")))
    rows = rows.withColumn("source_block", F.col("block_id")).withColumn(
        "block_id", F.concat_ws("|", "class", "block_id")
    )
    keep = ["block_id", "source_block", "class", "want", "lo", "hi", "label", "frame_number", *spec.FLAT_FEATURES]
    scored = score_frames(fitted, causal_rollups(rows.select(*keep), keep=keep, **tiling))
    right = F.count_if(
        (F.col("label") == F.col("want")) & F.col("verdict.is_attack") & (F.col("verdict.label") == F.col("class"))
    )
    hits = F.count_if(F.col("label") == F.col("want"))
    per_segment = scored.groupBy("class", "source_block", "lo", "hi").agg(
        F.count(F.lit(1)).alias("frames"),
        hits.alias("attack_rows"),
        F.when(hits > 0, 100.0 * right / hits).otherwise(0.0).alias("correct_pct"),
    )
    rank = F.struct(
        F.round("correct_pct", 3),
        F.least("attack_rows", F.lit(target).cast("long")),
        -F.col("frames"),
        F.col("source_block"),
    )
    picked = F.struct("source_block", "lo", "hi", "frames", "attack_rows", "correct_pct")
    return per_segment.groupBy("class").agg(F.max_by(picked, rank).alias("s")).select("class", "s.*")
