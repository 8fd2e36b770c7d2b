"""Checks of the block split, training and evaluation jobs.

Models are fitted with the library's defaults. No SQL can say what a fitted model answers, so these queries
give for every row that must be there whether what has to hold for it does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.adapters import features, labelled_frames
from wlanlake.catalog.common import FRAME_KEYS
from wlanlake.functions.labels import label_id
from wlanlake.operators import dataset
from wlanlake.operators.rollups import model_rows_from_raw
from wlanlake.plans import training
from wlanlake.session import store, work_dir

QUERIES = {}
ORACLES = {}
# The first of the default sizes, where there are no validation rows to choose by.
FIT = {"trees": [20]}
COLUMNS = spec.FLAT_MODEL_COLUMNS


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def block_counts(spark, sf_dir):
    return dataset.block_class_counts(labelled_frames(spark, sf_dir).select("block_id", "label"))


def prepared(spark, sf_dir):
    """Model rows stored once, and the split of their blocks."""
    rows = store(model_rows_from_raw(labelled_frames(spark, sf_dir)), "model_rows")
    assignment = dataset.grouped_split(dataset.block_class_counts(rows.select("block_id", "label")))
    return rows, store(assignment, "split")


def parts(spark, sf_dir):
    rows, assignment = prepared(spark, sf_dir)
    by_split = training.rows_by_split(rows, assignment)
    return [by_split.filter(F.col("split") == s).drop("split") for s in dataset.SPLITS]


_BLOCKS = f"""{FRAME_KEYS}, c AS (SELECT block_id, label, count(*)::BIGINT AS n FROM f0 GROUP BY ALL),
t AS (SELECT label, sum(n)::BIGINT AS total FROM c GROUP BY 1)"""


@query(
    "select_blocks",
    f"""WITH RECURSIVE {_BLOCKS},
p AS (SELECT block_id, sum(n) AS n, sum(n) FILTER (label > 0) AS attacks, min(total) FILTER (label > 0) AS rarity
  FROM c JOIN t USING (label) GROUP BY 1),
o AS (SELECT *, (SELECT sum(n) // 2 FROM c) AS budget, row_number() OVER (
  ORDER BY rarity NULLS LAST, coalesce(attacks, 0) DESC, substr(md5('0:' || block_id), 1, 15), block_id) AS k FROM p),
walk AS (SELECT k, block_id, n AS used, TRUE AS taken FROM o WHERE k = 1 UNION ALL
  SELECT o.k, o.block_id, CASE WHEN used + o.n <= budget THEN used + o.n ELSE used END, used + o.n <= budget
  FROM walk JOIN o ON o.k = walk.k + 1)
SELECT block_id FROM walk WHERE taken""",
)
def _select(spark, sf_dir):
    counts = block_counts(spark, sf_dir)
    total = sum(dataset._totals(counts))
    return dataset.select_blocks(counts, total // 2)


@query(
    "grouped_split",
    f"""WITH {_BLOCKS},
b AS (SELECT block_id, coalesce(arg_min(label, total * 16 + label) FILTER (label > 0), 0) AS g
  FROM c JOIN t USING (label) GROUP BY 1),
r AS (SELECT block_id, g, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (block_id) WHERE label = g),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, block_id DESC) AS place,
  count(*) OVER (PARTITION BY g) AS blocks FROM r),
rest AS (SELECT *, row_number() OVER w AS k,
  (sum(n) OVER w - n / 2)::DOUBLE / sum(n) OVER (PARTITION BY g)::DOUBLE AS middle
  FROM o WHERE place > 1 AND place < blocks
  WINDOW w AS (PARTITION BY g ORDER BY substr(md5('0:' || block_id), 1, 15), block_id))
SELECT block_id, CASE WHEN place = 1 THEN 'train' WHEN blocks = 2 THEN 'test' ELSE 'val' END AS split
FROM o WHERE place = 1 OR place = blocks
UNION ALL SELECT block_id,
  CASE WHEN k = 1 OR middle >= 0.6 AND middle < 0.85 THEN 'test' WHEN middle < 0.6 THEN 'train' ELSE 'val' END FROM rest""",
)
def _split(spark, sf_dir):
    return dataset.grouped_split(block_counts(spark, sf_dir))


@query(
    "split_coverage",
    f"WITH {_BLOCKS} SELECT label, count(DISTINCT block_id) AS blocks, least(3, count(DISTINCT block_id)) AS splits "
    "FROM c WHERE n > 0 GROUP BY label",
)
def _coverage(spark, sf_dir):
    counts = store(block_counts(spark, sf_dir), "block_counts")
    return dataset.split_coverage(counts, dataset.grouped_split(counts))


# ---- what must hold for a model's answers ----------------------------------------------------

_TEST = f"WITH {FRAME_KEYS}, sp AS ({ORACLES['grouped_split']}), t AS (SELECT * FROM f0 JOIN sp USING (block_id) WHERE split = 'test')"
_TEST_ROWS = f"{_TEST} SELECT block_id, event_id AS frame_number, label, TRUE AS holds FROM t"


def are_probabilities(p="probability"):
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return (F.size(p) == training.N_CLASSES) & F.forall(p, lambda x: x.between(0, 1)) & (F.abs(total - 1) < 1e-9)


def names_likeliest():
    """The predicted class is one that no other exceeds."""
    return F.col("probability")[F.col("prediction")] == F.array_max("probability")


def follows_rule(thr1: float = spec.STAGE1_THRESHOLD, thr2: float = spec.STAGE2_THRESHOLD):
    """The verdict worked out once more, from the probabilities."""
    attacks = F.array_sort(
        F.transform(F.slice("probability", 2, len(spec.ATTACK_CLASSES)), lambda x, i: F.struct((-x).alias("p"), i.alias("i")))
    )
    best, hot = attacks[0], 1.0 - F.col("probability")[0] >= thr1
    name = F.array(*[F.lit(c) for c in spec.ATTACK_CLASSES])[best["i"]]
    v = F.col("verdict")
    return (
        (v["stage"] == F.when(hot, 2).otherwise(1))
        & (v["is_attack"] == (hot & (-best["p"] >= thr2)))
        & v["label"].eqNullSafe(F.when(hot, name))
        & are_probabilities()
    )


def keyed(df, holds):
    return df.select("block_id", "frame_number", F.col("label").cast("int").alias("label"), holds.alias("holds"))


@query("train_multiclass", _TEST_ROWS)
def _multiclass(spark, sf_dir):
    """Test rows, and whether their probabilities are some and the likeliest class is predicted."""
    train, val, test = parts(spark, sf_dir)
    out = training.predict(training.train_multiclass(train, val), test)
    return keyed(out, are_probabilities() & names_likeliest())


@query("train_boosted", _TEST_ROWS)
def _boosted(spark, sf_dir):
    """As ``train_multiclass``; the loss on the validation rows must have fallen in every round, too."""
    train, val, test = parts(spark, sf_dir)
    fitted = training.train_boosted(train, val)
    losses = [x for _, x in fitted.history]
    falls = all(a > b for a, b in zip(losses, losses[1:]))
    return keyed(training.predict(fitted, test), are_probabilities() & names_likeliest() & F.lit(falls))


@query("model_bundle", f"{_TEST_ROWS} UNION ALL SELECT 'refused', 0, 0, TRUE")
def _bundle(spark, sf_dir):
    """Test rows, and whether the stored model answers as the fitted one; a model of other columns is refused."""
    train, _, test = parts(spark, sf_dir)
    fitted = training.train_multiclass(train, None, COLUMNS, **FIT)
    path = training.save_bundle(fitted, work_dir(spark, "bundle"))
    again, cuts = training.load_bundle(spark, path)
    both = training.score_frames(fitted, test).withColumnsRenamed({"verdict": "before", "probability": "p", "prediction": "c"})
    same = F.col("before").eqNullSafe(F.col("verdict")) & (F.col("p") == F.col("probability"))
    out = keyed(training.score_frames(again, both, *cuts), same)
    try:
        training.load_bundle(spark, path, COLUMNS[::-1])
        refused = False
    except training.BundleMismatch:
        refused = True
    return out.unionByName(
        spark.createDataFrame([("refused", 0, 0, refused)], "block_id string, frame_number long, label int, holds boolean")
    )


@query("train_two_stage", _TEST_ROWS)
def _two(spark, sf_dir):
    """Test rows, and whether stage, class and thresholds of their verdicts agree."""
    train, val, test = parts(spark, sf_dir)
    out = training.score_two_stage(training.train_two_stage(train, val), test)
    v = F.col("verdict")
    cold = (v["stage"] == 1) & ~v["is_attack"] & v["label"].isNull() & (v["p1"] < spec.STAGE1_THRESHOLD)
    hot = (
        (v["stage"] == 2) & (v["p1"] >= spec.STAGE1_THRESHOLD) & v["label"].isin(spec.ATTACK_CLASSES)
        & v["p2"].between(0, 1) & (v["is_attack"] == (v["p2"] >= spec.STAGE2_THRESHOLD))
    )
    return keyed(out, F.coalesce(cold, F.lit(False)) | F.coalesce(hot, F.lit(False)))


@query("score_frames", _TEST_ROWS)
def _score(spark, sf_dir):
    """Test rows, and whether their verdicts follow from their probabilities."""
    train, _, test = parts(spark, sf_dir)
    fitted = training.train_multiclass(train, None, COLUMNS, **FIT)
    return keyed(training.score_frames(fitted, test), follows_rule())


@query(
    "evaluate_split",
    f"{_TEST} SELECT CAST(i AS INTEGER) AS label, (SELECT count(*) FROM t WHERE label = i) AS support, TRUE AS holds FROM range(0, 9) c(i)",
)
def _evaluate(spark, sf_dir):
    """Support of each class in the test split, and whether its scores fit together and give the mean."""
    rows, assignment = prepared(spark, sf_dir)
    train = training.rows_by_split(rows, assignment).filter("split = 'train'").drop("split")
    scores = store(training.evaluate_split(training.train_multiclass(train, None, COLUMNS, **FIT), rows, assignment), "scores")
    mean = scores.agg(F.avg("f1").alias("_mean"))
    f1 = F.coalesce(F.expr("2 * precision * recall / nullif(precision + recall, 0)"), F.lit(0.0))
    right = (
        F.when(F.col("support") == 0, F.col("f1").isNull() & (F.col("absent_false_positives") >= 0))
        .otherwise(F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & (F.abs(F.col("f1") - f1) < 1e-9))
    )
    return scores.crossJoin(mean).select("label", "support", (right & (F.abs(F.col("macro_f1") - F.col("_mean")) < 1e-9)).alias("holds"))


@query("leakage_probe", "SELECT * FROM (VALUES ('retrained', TRUE), ('score only', TRUE)) t(probe, holds)")
def _probe(spark, sf_dir):
    """Both probes of the most important column, and whether they are of that column and told against one base."""
    train, _, test = parts(spark, sf_dir)
    fitted = training.train_multiclass(train, None, COLUMNS, **FIT)
    base, top = training.score_of(training.predict(fitted, test)), training.top_features(fitted, 1)[0]
    found = training.leakage_probe(fitted, train, test, top=1, **FIT)
    right = (F.col("feature") == top) & F.col("macro_f1").between(0, 1) & (F.abs(F.col("macro_f1") - base - F.col("delta")) < 1e-9)
    return found.select("probe", right.alias("holds"))


@query(
    "feature_importance",
    "SELECT feature, TRUE AS holds FROM (VALUES " + ", ".join(f"('{c}')" for c in COLUMNS) + ") t(feature)",
)
def _importance(spark, sf_dir):
    """Every model column, and whether importances are shares of one whole that fall with the rank."""
    train, _, _ = parts(spark, sf_dir)
    found = store(training.feature_importance(training.train_multiclass(train, None, COLUMNS, **FIT)), "importances")
    after = found.select((F.col("rank") - 1).alias("rank"), F.col("importance").alias("_next"))
    total = found.agg(F.sum("importance").alias("_total"))
    right = (
        F.col("importance").between(0, 1) & (F.col("importance") >= F.coalesce("_next", F.lit(0.0)))
        & (F.abs(F.col("_total") - 1) < 1e-9) & F.col("rank").between(1, len(COLUMNS))
    )
    return found.join(after, "rank", "left").crossJoin(total).select("feature", right.alias("holds"))


@query("stratified_cv", "SELECT CAST(i AS INTEGER) AS fold, TRUE AS holds FROM range(1, 6) t(i)")
def _cv(spark, sf_dir):
    """Every fold, and whether scores, mean and deviation fit together."""
    rows, _ = prepared(spark, sf_dir)
    found = store(training.stratified_cv(rows, COLUMNS, **FIT), "scores")
    sums = found.agg(F.avg("macro_f1").alias("_m"), F.avg(F.col("macro_f1") * F.col("macro_f1")).alias("_s"))
    spread = F.sqrt(F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    right = F.col("macro_f1").between(0, 1) & (F.abs(F.col("mean") - F.col("_m")) < 1e-9) & (F.abs(F.col("std") - spread) < 1e-6)
    return found.crossJoin(sums).select("fold", right.alias("holds"))


@query("shuffled_label_check", "SELECT * FROM (VALUES ('true labels', TRUE), ('shuffled labels', TRUE)) t(labels, holds)")
def _shuffled(spark, sf_dir):
    """Both scores, and whether permuted labels score below the true ones."""
    train, _, test = parts(spark, sf_dir)
    found = store(training.shuffled_label_check(train, test, COLUMNS, **FIT), "scores")
    pair = found.agg(F.max(F.expr("if(labels = 'true labels', macro_f1, -1)")).alias("_t"), F.max(F.expr("if(labels = 'true labels', -1, macro_f1)")).alias("_s"))
    return found.crossJoin(pair).select("labels", (F.col("macro_f1").between(0, 1) & (F.col("_t") > F.col("_s"))).alias("holds"))


@query("drop_features_retrain", "SELECT TRUE AS holds")
def _dropped(spark, sf_dir):
    """Whether the model without five columns has a score between 0 and 1."""
    train, _, test = parts(spark, sf_dir)
    gone = ["radio_freq_mhz", "frame_dt", "rsn_country_present", "frame_len", "fc_ds"]
    found = training.drop_features_retrain(train, test, gone, COLUMNS, **FIT)
    return found.select(F.col("macro_f1").between(0, 1).alias("holds"))


@query(
    "contract_check",
    "SELECT * FROM (VALUES ('missing', 'fc_ds', ''), ('extra', '', 'fc_dss'), ('type', 'fc_type float', 'fc_type double')) "
    "t(kind, expected, found) UNION ALL SELECT 'class id', '0..8', count(*) || ' rows' FROM events WHERE event_id % 100 = 0",
)
def _contract(spark, sf_dir):
    """Faults of a table with one column renamed, one of another type and odd class ids."""
    rows = model_rows_from_raw(labelled_frames(spark, sf_dir))
    odd = rows.withColumnRenamed("fc_ds", "fc_dss").withColumn("fc_type", F.col("fc_type").cast("double"))
    odd = odd.withColumn("label", F.expr("if(frame_number % 100 = 0, 12, int(label))"))
    return training.contract_check(odd)


@query(
    "best_segments",
    f"""{_TEST}, n AS (SELECT block_id, label, count(*) AS n FROM t WHERE label > 0 GROUP BY ALL)
SELECT label, TRUE AS holds FROM n GROUP BY label HAVING max(n) >= 20""",
)
def _segments(spark, sf_dir):
    """Classes with enough attacks in a block of the test split, and whether their stretch lies in one and holds some."""
    rows, assignment = prepared(spark, sf_dir)
    held = training.rows_by_split(rows, assignment)
    fitted = training.train_multiclass(held.filter("split = 'train'").drop("split"), None, COLUMNS, **FIT)
    found = training.best_segments(fitted, features(spark, sf_dir), assignment)
    sizes = held.filter("split = 'test'").groupBy(F.col("block_id").alias("source_block")).agg(F.count(F.lit(1)).alias("_n"))
    right = (
        (F.col("lo") >= 0) & (F.col("frames") == F.least("hi", "_n") - F.col("lo")) & (F.col("frames") <= 4096)
        & F.col("attack_rows").between(1, F.col("frames")) & F.col("correct_pct").between(0, 100)
    )
    return found.join(sizes, "source_block").select(label_id("class").cast("int").alias("label"), right.alias("holds"))
