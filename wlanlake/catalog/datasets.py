"""Checks of profiles, statistics, imputation, weights and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wlanlake.adapters import detections, labelled_frames, table
from wlanlake.catalog.common import FRAME_KEYS, with_detections
from wlanlake.operators import dataset, metrics, quality

QUERIES = {}
ORACLES = {}


def query(name: str, source, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---- profiles over lineitem, with NULLs on every tenth part ---------------------------------

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINES = (
    "x AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, CASE WHEN l_partkey % 200 = 0 THEN l_tax END AS sparse FROM lineitem)"
)


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "if(l_partkey % 10 = 0, null, l_quantity) as l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "if(l_partkey % 200 = 0, l_tax, null) as sparse",
    )


def per_column(select: str, columns=NUMERIC) -> str:
    return f"WITH {_LINES} " + " UNION ALL ".join(
        "SELECT '" + c + "' AS feature, " + select.replace("{c}", c) + " FROM x" for c in columns
    )


@query(
    "null_profile",
    lines,
    per_column(
        "count(*) - count({c}) AS nulls, round(1 - count({c}) / count(*)::DOUBLE, 9) AS null_ratio, "
        'count(*) - count({c}) > 0.98 * count(*) AS "drop"',
        [*NUMERIC, "sparse"],
    ),
)
def _nulls(df):
    return quality.null_profile(df, [*NUMERIC, "sparse"]).withColumn("null_ratio", F.round("null_ratio", 9))


query(
    "duplicate_rows",
    lines,
    f"WITH {_LINES}, y AS (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM x) "
    "SELECT (SELECT count(*) FROM y) AS rows, (SELECT count(*) FROM y) - (SELECT count(*) FROM (SELECT DISTINCT * FROM y) d) AS duplicates",
)(lambda df: quality.duplicate_rows(df.select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")))

_OUT = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "iqr_outliers",
    lambda spark, sf_dir: table(spark, sf_dir, "events").selectExpr(
        "value", "if(event_id % 10 = 0, double('NaN'), value * value) as squared", "double(user_id % 7) as spread", "1D as flat"
    ),
    "WITH x AS (SELECT value, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value * value END AS squared, "
    "(user_id % 7)::DOUBLE AS spread FROM events) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round((SELECT 100.0 * avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) "
        f"THEN 1 ELSE 0 END) FROM x), 6) AS outlier_pct FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM x) q"
        for c in ("value", "squared", "spread")
    ),
)
def _iqr(df):
    out = quality.iqr_outliers(df, ["value", "squared", "spread", "flat"])
    return out.withColumn("outlier_pct", F.round("outlier_pct", 6))


def _rho(a: str, b: str) -> str:
    ranks = ", ".join(
        f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE AS {n}" for c, n in ((a, "p"), (b, "q"))
    )
    both = f"SELECT {a}, {b} FROM x WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr(p, q), 6) AS rho FROM (SELECT {ranks} FROM ({both}) n) r"


@query(
    "spearman_corr",
    lines,
    f"WITH {_LINES} " + " UNION ALL ".join(_rho(a, b) if a != b else f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in NUMERIC for b in NUMERIC)
    .replace("SELECT 'l_quantity', 'l_quantity', 1.0::DOUBLE", "SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0::DOUBLE AS rho"),
)
def _spearman(df):
    return quality.spearman(df, NUMERIC).withColumn("rho", F.round("rho", 6))


@query(
    "column_profile",
    lines,
    per_column(
        "count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", min({c}) AS min, max({c}) AS max, "
        "round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, round(quantile_cont({c}, 0.25), 6) AS p25, "
        "round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75"
    ),
)
def _profile(df):
    out = quality.column_profile(df, NUMERIC)
    digits = {"mean": 7, "std": 7, "p25": 6, "p50": 6, "p75": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


query(
    "top_values",
    lines,
    f"WITH {_LINES}, v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, count(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY {c}" for c in _OUT)
    + ") SELECT feature, x, n, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, x) AS INTEGER) AS rank FROM v QUALIFY rank <= 5",
)(lambda df: quality.top_values(df, _OUT, 5))


# ---- statistics fitted on one part, applied to another ----------------------------------------

_PARTS = (
    "c AS (SELECT c_custkey, c_custkey % 5 = 0 AS test, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS bal, "
    "(c_nationkey * 1.0)::DOUBLE AS nation, NULL::DOUBLE AS empty, 7.0::DOUBLE AS flat, c_mktsegment FROM customer)"
)
FITTED = ["bal", "nation", "empty", "flat"]


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "c_custkey % 5 = 0 as test",
        "if(c_custkey % 11 = 0, null, c_acctbal) as bal",
        "double(c_nationkey) as nation",
        "cast(null as double) as empty",
        "7D as flat",
        "c_mktsegment",
    )


@query(
    "norm_stats",
    customers,
    f"WITH {_PARTS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(coalesce(avg({c}), 0), 6) AS mean, round(CASE WHEN coalesce(stddev_pop({c}), 0) < 1e-6 "
        f"THEN 1 ELSE stddev_pop({c}) END, 6) AS std, count({c}) < count(*) AS can_be_absent FROM c WHERE NOT test"
        for c in FITTED
    ),
)
def _stats(df):
    out = dataset.stats_long(dataset.norm_stats(df.filter("not test"), FITTED))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


_STAT_ROW = "s AS (SELECT " + ", ".join(
    f"coalesce(avg({c}), 0) AS {c}_m, CASE WHEN coalesce(stddev_pop({c}), 0) < 1e-6 THEN 1 ELSE stddev_pop({c}) END AS {c}_d"
    for c in FITTED
) + " FROM c WHERE NOT test)"


@query(
    "norm_apply",
    customers,
    f"WITH {_PARTS}, {_STAT_ROW} SELECT c_custkey, "
    + ", ".join(
        f"round(CASE WHEN {c} IS NULL THEN 0 ELSE greatest(least(({c} - {c}_m) / {c}_d, 8), -8) END, 6) AS {c}, "
        f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_absent"
        for c in FITTED
    )
    + " FROM c, s",
)
def _norm_apply(df):
    stats = dataset.norm_stats(df.filter("not test"), FITTED)
    out = dataset.norm_apply(df, stats, FITTED, masks=True)
    return out.select("c_custkey", *[F.round(c, 6).alias(c) for c in FITTED], *[f"{c}_absent" for c in FITTED])


@query(
    "zscore",
    customers,
    f"WITH {_PARTS}, {_STAT_ROW} SELECT c_custkey, round((bal - bal_m) / bal_d, 6) AS bal, round((nation - nation_m) / nation_d, 6) AS nation FROM c, s",
)
def _zscore(df):
    stats = dataset.norm_stats(df.filter("not test"), ["bal", "nation"])
    out = dataset.zscore(df, stats, ["bal", "nation"])
    return out.select("c_custkey", F.round("bal", 6).alias("bal"), F.round("nation", 6).alias("nation"))


@query(
    "median_impute",
    customers,
    f"WITH {_PARTS}, m AS (SELECT quantile_cont(bal, 0.5) AS b, quantile_cont(nation, 0.5) AS n FROM c WHERE NOT test) "
    "SELECT c_custkey, round(coalesce(bal, b), 6) AS bal, round(coalesce(nation, n), 6) AS nation, empty FROM c, m",
)
def _impute(df):
    columns = ["bal", "nation", "empty"]
    out = dataset.median_impute(df, dataset.medians(df.filter("not test"), columns), columns)
    return out.select("c_custkey", F.round("bal", 6).alias("bal"), F.round("nation", 6).alias("nation"), "empty")


@query(
    "align_categories",
    customers,
    f"WITH {_PARTS}, v AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '__NA__' ELSE c_mktsegment END AS seg FROM c) "
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY seg) - 1 AS INTEGER) AS segment_code FROM v",
)
def _categories(df):
    df = df.withColumn("segment", F.when(F.col("c_custkey") % 13 != 0, F.col("c_mktsegment")))
    train, test = df.filter("not test"), df.filter("test")
    codes = dataset.category_table([train, test], "segment")
    return dataset.align_categories(df, codes, "segment").select("c_custkey", "segment_code")


def _pandas_like(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "if(event_id % 10 = 0, 'n/a', string(user_id)) as mostly",
        "if(event_id % 10 < 4, string(user_id), event_type) as rarely",
        "concat('0x', event_id % 100) as hexed",
        "value",
    )


@query(
    "coerce_mixed",
    _pandas_like,
    "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id::DOUBLE END AS mostly, "
    "CASE WHEN event_id % 10 < 4 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS rarely, (event_id % 100)::DOUBLE AS hexed, value "
    "FROM events WHERE event_id % 5 = 0",
)
def _coerce(df):
    train, test = df.filter("event_id % 5 <> 0"), df.filter("event_id % 5 = 0")
    (train, test), numeric, _ = dataset.coerce_mixed(train, [test])
    return test.withColumns({c: F.col(c).cast("double") for c in numeric})


def _weights_sql(expr: str) -> str:
    return (
        f"WITH {FRAME_KEYS}, g AS (SELECT label, count(*) AS count FROM f0 GROUP BY 1), "
        "t AS (SELECT sum(count)::DOUBLE AS n, count(*) AS k FROM g) "
        f"SELECT label, count, round({expr}, 6) AS weight FROM g, t"
    )


query("class_weights", labelled_frames, _weights_sql("greatest(least(sqrt(n / (k * count)), 100), 0.001)"))(
    lambda df: dataset.class_weights(df).withColumn("weight", F.round("weight", 6))
)
query("class_weights_plain", labelled_frames, _weights_sql("n / (k * count)"))(
    lambda df: dataset.class_weights(df, alpha=1.0, cap=None).withColumn("weight", F.round("weight", 6))
)


# ---- metrics -------------------------------------------------------------------------------------

_PRED = "CASE WHEN (event_id * 7) % 10 = 0 THEN (label + 1) % 9 ELSE label END"
_PT = f"{FRAME_KEYS}, pt AS (SELECT block_id, event_id, label, {_PRED} AS pred FROM f0)"


def predicted(spark, sf_dir):
    frames = labelled_frames(spark, sf_dir).selectExpr("block_id", "frame_number", "int(label) as label")
    return frames.withColumn(
        "prediction", F.expr("if((frame_number * 7) % 10 = 0, (label + 1) % 9, label)")
    )


@query(
    "predictions_truth",
    predicted,
    f"WITH {_PT} SELECT block_id, event_id AS frame_number, label, pred AS prediction FROM pt",
)
def _joined(df):
    return metrics.predictions_truth(df.drop("label"), df.drop("prediction")).select(
        "block_id", "frame_number", "label", "prediction"
    )


query(
    "confusion_matrix",
    predicted,
    f"WITH {_PT} SELECT CAST(c.i AS INTEGER) AS truth, "
    + ", ".join(f"count(*) FILTER (pt.pred = {i}) AS pred_{i}" for i in range(9))
    + " FROM range(9) c(i) LEFT JOIN pt ON pt.label = c.i GROUP BY 1",
)(metrics.confusion_matrix)

_COUNTS = (
    "m AS (SELECT CAST(c.i AS INTEGER) AS label, count(*) FILTER (pt.label = c.i AND pred = c.i) AS tp, "
    "count(*) FILTER (pt.label <> c.i AND pred = c.i) AS fp, count(*) FILTER (pt.label = c.i AND pred <> c.i) AS fn "
    "FROM range(9) c(i) LEFT JOIN pt ON pt.label = c.i OR pt.pred = c.i GROUP BY 1)"
)
_NAMES = "['Normal', 'Deauth', 'Disas', '(Re)Assoc', 'RogueAP', 'Krack', 'Kr00k', 'Evil_Twin', 'SSDP']"


@query(
    "per_class_metrics",
    predicted,
    f"WITH {_PT}, {_COUNTS} SELECT label, {_NAMES}[label + 1] AS class, "
    "CASE WHEN tp + fn > 0 THEN round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) END AS precision, "
    "CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) END AS recall, "
    "CASE WHEN tp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) END AS f1, tp + fn AS support, "
    "CASE WHEN tp + fn = 0 THEN fp END AS absent_false_positives FROM m",
)
def _per_class(df):
    out = metrics.per_class_metrics(df)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


query(
    "macro_f1",
    predicted,
    f"WITH {_PT}, {_COUNTS} SELECT round(avg(2 * tp / (2 * tp + fp + fn)::DOUBLE), 6) AS macro_f1 FROM m WHERE tp + fn > 0",
)(lambda df: metrics.macro_f1(df).withColumn("macro_f1", F.round("macro_f1", 6)))


def scored(spark, sf_dir):
    return detections(spark, sf_dir).select(
        F.when(F.col("predicted_label") == "Evil_Twin", 1).otherwise(0).alias("truth"),
        F.col("proba_attack").alias("score"),
    )


_GRID = "g(threshold) AS (VALUES " + ", ".join(f"({t!r}::DOUBLE)" for t in metrics.THRESHOLDS) + ")"
_SCORED = "s AS (SELECT CASE WHEN predicted_label = 'Evil_Twin' THEN 1 ELSE 0 END AS truth, proba_attack AS score FROM detections)"
_SWEEP = (
    "w AS (SELECT threshold, count(*) FILTER (truth = 1 AND score >= threshold) AS tp, "
    "count(*) FILTER (truth = 0 AND score >= threshold) AS fp, "
    "count(*) FILTER (truth = 1 AND coalesce(score < threshold, true)) AS fn FROM g, s GROUP BY 1)"
)


@query(
    "threshold_sweep",
    scored,
    with_detections(
        "SELECT round(threshold, 6) AS threshold, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, "
        "round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, "
        "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM w",
        _SCORED, _GRID, _SWEEP,
    ),
)
def _sweep(df):
    out = metrics.threshold_sweep(df, "truth", "score")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "best_threshold",
    scored,
    with_detections(
        "SELECT round(threshold, 6) AS threshold, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM w "
        "ORDER BY 2 * tp / (2 * tp + fp + fn)::DOUBLE DESC, w.threshold LIMIT 1",
        _SCORED, _GRID, _SWEEP,
    ),
)
def _best(df):
    out = metrics.best_threshold(metrics.threshold_sweep(df, "truth", "score"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "auc_report",
    scored,
    with_detections(
        "SELECT round(sum(neg * (tp - pos / 2.0)) / (max(tp) * max(fp)), 6) AS roc_auc, "
        "round(sum(pos * tp / (tp + fp)) / max(tp), 6) AS average_precision FROM (SELECT *, "
        "sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS fp FROM "
        "(SELECT score, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM s WHERE score IS NOT NULL GROUP BY 1) a) b",
        _SCORED,
    ),
)
def _auc(df):
    out = metrics.auc_report(df, "truth", "score")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# ---- scored captures ----------------------------------------------------------------------------

_VERDICT = (
    "v AS (SELECT id, epoch_us(ts)::DOUBLE / 1000000 AS epoch, proba_anomaly AS p1, predicted_label AS label, proba_attack AS p2 FROM detections)"
)


def verdicts_of(spark, sf_dir):
    """Detections read back as verdicts of the two thresholds."""
    return detections(spark, sf_dir).selectExpr(
        "id as frame_number",
        "unix_micros(ts) / 1000000D as epoch",
        "named_struct('is_attack', proba_anomaly >= 0.4 and coalesce(proba_attack >= 0.8, false), "
        "'label', if(proba_anomaly >= 0.4, predicted_label, null), 'p1', proba_anomaly, "
        "'p2', if(proba_anomaly >= 0.4, proba_attack, null), 'stage', if(proba_anomaly >= 0.4, 2, 1)) as verdict",
    )


@query(
    "scored_report",
    verdicts_of,
    with_detections(
        "SELECT count(*) AS packets, round(arg_max(epoch, id) - arg_min(epoch, id), 3) AS capture_span_s, "
        "count(*) FILTER (p1 >= 0.4) AS stage1_hot, round(100.0 * count(*) FILTER (p1 >= 0.4) / count(*), 6) AS stage1_attack_rate_pct, "
        "count(*) FILTER (p1 >= 0.4 AND p2 >= 0.8) AS attacks_persisted, "
        "round(100.0 * count(*) FILTER (p1 >= 0.4 AND p2 >= 0.8) / count(*), 6) AS persist_rate_pct FROM v",
        _VERDICT,
    ),
)
def _scored_report(df):
    out = metrics.scored_report(df)
    return out.withColumns(
        {
            "capture_span_s": F.round("capture_span_s", 3),
            "stage1_attack_rate_pct": F.round("stage1_attack_rate_pct", 6),
            "persist_rate_pct": F.round("persist_rate_pct", 6),
        }
    )


query(
    "scored_labels",
    verdicts_of,
    with_detections(
        "SELECT label, count(*) AS considered, count(*) FILTER (p2 >= 0.8) AS persisted FROM v WHERE p1 >= 0.4 GROUP BY 1",
        _VERDICT,
    ),
)(metrics.scored_labels)
