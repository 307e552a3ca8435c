"""Scores, classes, evaluation models, labels and what-if scenarios."""

import os

from pyspark.sql import functions as F

from paywatch import fixed
from paywatch.functions import risk
from paywatch.operators import baselines, evaluation, evidence, features, labels, model, series
from paywatch.operators.sampling import time_split
from paywatch.plans import scoring
from paywatch.session import materialize
from paywatch.sources.tables import read_table

from checks.base_sql import DENSE, FEATURE_CTES, scored_sql, sql
from checks.feature_queries import SERIES, SMOOTH
from checks.registry import check, dense, learned, r6, rounded, scored, stored_scores

SCORES = "anomaly_score spike_ratio z_score"


@check("risky_merchants", scored_sql(
    "select merchant_id, count(*) as txns, count(*) filter (risk_level <> 'low') as risky, "
    "round(count(*) filter (risk_level <> 'low') / count(*)::double, 6) as risky_share, "
    "round(max(overall_risk), 4) as peak_risk, round(max(velocity_ratio), 6) as peak_velocity "
    "from scored group by 1 order by risky_share desc, merchant_id limit 10"))
def risky_merchants(spark, d):
    """Which merchants spike: the ten with the largest share of payments above low risk."""
    by_merchant = scored(spark, d).groupBy("merchant_id").agg(
        F.expr("count(1) as txns"), F.expr("count_if(risk_level <> 'low') as risky"),
        F.expr("count_if(risk_level <> 'low') / double(count(1)) as risky_share"),
        F.expr("round(max(overall_risk), 4) as peak_risk"), F.expr("max(velocity_ratio) as peak_velocity"),
    )
    return rounded(by_merchant).orderBy(F.desc("risky_share"), "merchant_id").limit(10)


RATE_MOMENTS = """
rate_base as (
  select merchant_id, count(*) as minutes, avg(rate) as baseline_rate, coalesce(stddev_samp(rate), 0) as baseline_std,
    arg_max(rate, minute)::double as current_rate from series group by 1
),
rated as (
  select b.*, s.ewma, s.ewma_std,
    case when baseline_std > 0 then (current_rate - baseline_rate) / baseline_std
         else (current_rate - baseline_rate) / greatest(baseline_rate * 0.1, 1) end as z,
    case when b.minutes < 10 then 0 when ewma_std > 0 then (current_rate - ewma) / ewma_std
         else (current_rate - ewma) / greatest(ewma * 0.1, 1) end as dev,
    current_rate / greatest(baseline_rate, 0.01) as spike
  from rate_base b join spreads s using (merchant_id)
),
judged as (
  select *, least(greatest(0.4 / (1 + exp(-(z - 3))) + 0.3 / (1 + exp(-0.8 * (dev - 2)))
    + 0.3 / (1 + exp(-0.5 * (spike - 3))), 0), 1) as score from rated
)
"""


@check("detect_rate", sql(
    "select merchant_id, round(score, 4) as anomaly_score, round(spike, 2) as spike_ratio, round(z, 4) as z_score, "
    "round(dev, 4) as ewma_deviation, z > 3 or score > 0.6 or spike > 5 as is_anomalous, "
    "case when score >= 0.9 or spike >= 10 then 'critical' when score >= 0.7 or spike >= 5 then 'high' "
    "when score >= 0.5 or spike >= 3 then 'medium' when score >= 0.3 or spike >= 2 then 'low' else 'none' end "
    "as spike_severity from judged", DENSE, SERIES, SMOOTH, RATE_MOMENTS))
def detect_rate(spark, d):
    """Each merchant's newest minute against its whole rate series."""
    payments = dense(spark, d)
    rates = series.rate_moments(payments).join(series.ewma(payments).drop("minutes"), "merchant_id")
    found = risk.detect_rate(rates, ewma="ewma", ewma_std="ewma_std", history="minutes")
    return found.select("merchant_id", *SCORES.split(), "ewma_deviation", "is_anomalous", "spike_severity")


@check("detect_features", scored_sql(
    "select transaction_id, anomaly_score, spike_ratio, z_score, is_anomalous, spike_severity from scored"))
def detect_features(spark, d):
    found = risk.detect_features(features.score_inputs(dense(spark, d)))
    return found.select("transaction_id", *SCORES.split(), "is_anomalous", "spike_severity")


# Scores spread over 0..1 and spikes over 0..12, from the event table, to reach every class.
RAW = "event_id, event_id % 1000 / 999D as score, value / 40D as spike"
RAW_SQL = "select event_id, event_id % 1000 / 999.0::double as score, value / 40 as spike from events"


@check("severity", "select event_id, case when score >= 0.9 or spike >= 10 then 'critical' when score >= 0.7 or spike >= 5 "
       "then 'high' when score >= 0.5 or spike >= 3 then 'medium' when score >= 0.3 or spike >= 2 then 'low' else 'none' end "
       f"as severity from ({RAW_SQL})")
def severity(spark, d):
    raw = read_table(spark, d, "events").selectExpr(*RAW.split(", "))
    return raw.selectExpr("event_id", f"{risk.severity('score', 'spike')} as severity")


@check("sigmoid", f"select event_id, round(1 / (1 + exp(-0.8 * (spike - 3))), 6) as s from ({RAW_SQL})")
def sigmoid(spark, d):
    raw = read_table(spark, d, "events").selectExpr(*RAW.split(", "))
    return rounded(raw.selectExpr("event_id", f"{risk.sigmoid('spike', 3.0, 0.8)} as s"))


@check("aggregate_risk", scored_sql("select transaction_id, overall_risk, risk_level from scored"))
def aggregate_risk(spark, d):
    return scored(spark, d).select("transaction_id", "overall_risk", "risk_level")


@check("classify_risk", "select event_id, case when score >= 0.95 then 'critical' when score >= 0.8 then 'high' "
       "when score >= 0.6 then 'medium' else 'low' end as stored_level, case when score > 0.85 then 'critical' "
       "when score > 0.6 then 'high' when score > 0.3 then 'medium' else 'low' end as gateway_level "
       f"from ({RAW_SQL})")
def classify_risk(spark, d):
    raw = read_table(spark, d, "events").selectExpr(*RAW.split(", "))
    return raw.selectExpr(
        "event_id", f"{risk.classify('score')} as stored_level",
        f"{risk.classify('score', tuple(fixed.GATEWAY_RISK_CUTS), False)} as gateway_level",
    )


THRESHOLD = """
threshold as (
  select transaction_id, t, is_suspicious::int as label, (velocity_ratio > 3)::int as prediction,
    least(greatest(velocity_ratio / 20, 0), 1) as score from features
)
"""
KEYS = " + ".join(f"abs(({n} - m_{n}) / s_{n})" for n in fixed.ZSCORE_FEATURES)
ZSCORE = f"""
fit as (
  select {', '.join(f"avg({n}) as m_{n}, coalesce(nullif(stddev_pop({n}), 0), 1) as s_{n}" for n in fixed.ZSCORE_FEATURES)}
  from features join cutoff using (merchant_id) where t <= cutoff_us
),
zraw as (select f.*, ({KEYS}) / 5 as raw from features f, fit),
zscore as (
  select transaction_id, t, is_suspicious::int as label,
    least(greatest(raw / ((select max(raw) from zraw join cutoff using (merchant_id) where t <= cutoff_us) + 1e-8), 0), 1) as score from zraw
),
combined as (
  select z.transaction_id, z.t, z.label, least(greatest(0.6 * h.score + 0.4 * z.score, 0), 1) as score
  from zscore z join threshold h using (transaction_id)
),
predictions as (
  select 'threshold' as model, transaction_id, t, label, score, prediction from threshold
  union all select 'zscore', transaction_id, t, label, score, (score > 0.5)::int from zscore
  union all select 'combined', transaction_id, t, label, score, (score > 0.5)::int from combined
)
"""


def predictions(spark, d):
    """Three closed-form models on the same rows; the z-score model is fitted on the known history."""
    payments = dense(spark, d)
    history = baselines.learn(payments)
    inputs = features.score_inputs(payments, history).selectExpr(
        "transaction_id", "merchant_id", "ts_us", *fixed.ZSCORE_FEATURES, "int(is_suspicious) as label"
    )
    rows = materialize(inputs, "model-rows")
    fitted = rows.join(history.cutoff, "merchant_id").where("ts_us <= cutoff_us")
    scored_rows = evaluation.zscore_model(rows, fitted).withColumnRenamed("score", "zscore").drop("prediction")
    scored_rows = risk.threshold_model(scored_rows).withColumnsRenamed({"score": "tscore", "prediction": "tpred"})
    scored_rows = risk.combined_model(scored_rows, "tscore", "zscore").withColumnsRenamed({"score": "cscore", "prediction": "cpred"})
    # Twelve places: the engines' sums differ in the last bits, which would part scores that are equal.
    return scored_rows.selectExpr(
        "transaction_id", "label",
        "stack(3, 'threshold', tscore, tpred, 'zscore', zscore, int(zscore > 0.5D), 'combined', cscore, cpred)"
        " as (model, score, prediction)",
    ).withColumn("score", F.round("score", 12))


def one_model(spark, d, name):
    rows = predictions(spark, d).where(F.col("model") == name)
    return rounded(rows.select("transaction_id", "score", "prediction"))


MODEL_CTES = (*FEATURE_CTES, THRESHOLD, ZSCORE)
for model_name in ("threshold", "zscore", "combined"):
    check(f"{model_name}_model", sql(
        "select transaction_id, round(score, 6) as score, prediction::bigint as prediction from predictions "
        f"where model = '{model_name}'", *MODEL_CTES))(lambda spark, d, name=model_name: one_model(spark, d, name))


CONFUSION = """
counts as (
  select model, count(*) filter (label = 0 and prediction = 0) as tn, count(*) filter (label = 0 and prediction = 1) as fp,
    count(*) filter (label = 1 and prediction = 0) as fn, count(*) filter (label = 1 and prediction = 1) as tp
  from predictions group by 1
),
confusion as (
  select *, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 4) as precision,
    round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 4) as recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 4) as f1,
    round(fp / greatest(fp + tn, 1)::double, 4) as false_positive_rate, fp * 100.0::double as false_positive_cost
  from counts
)
"""
PR = """
steps as (select model, round(score, 12) as score, count(*) as n, count(*) filter (label = 1) as hits from predictions group by 1, 2),
curve as (
  select model, score, sum(hits) over w as tp, sum(n) over w as flagged, sum(hits) over (partition by model) as pos
  from steps window w as (partition by model order by score desc)
),
points as (select model, score, tp / flagged::double as p, tp / pos::double as r from curve),
areas as (
  select model, (r - coalesce(lag(r) over w, 0)) * (p + coalesce(lag(p) over w, 1)) / 2 as area
  from points window w as (partition by model order by score desc)
),
pr as (select model, round(sum(area), 4) as pr_auc from areas group by 1)
"""


@check("agg_confusion", sql("select * from confusion", *MODEL_CTES, CONFUSION))
def agg_confusion(spark, d):
    return rounded(evaluation.confusion(evaluation.outcome_counts(predictions(spark, d))))


@check("agg_pr_auc", sql("select * from pr", *MODEL_CTES, PR))
def agg_pr_auc(spark, d):
    return evaluation.pr_auc(evaluation.outcome_counts(predictions(spark, d)))


# Explanations

MEANS = ("means as (select avg(velocity_ratio) as mv, avg(new_device_ratio) as mn, avg(payment_failure_rate) as mp, "
         "avg(amount_deviation) as ma from scored)")


@check("explain_linear", scored_sql(r6(
    "select transaction_id, velocity_ratio / 3 / 4 * 3 as z_velocity_ratio, new_device_ratio * 5 / 4 * 3 as z_new_device_ratio, "
    "payment_failure_rate * 10 / 4 * 3 as z_payment_failure_rate, amount_deviation / 3 / 4 * 3 as z_amount_deviation, "
    "0.5 * ml_score as part_ml, 0.3 * anomaly_score as part_anomaly, 0.2 * least(spike_ratio / 20, 1) as part_spike from scored",
    "z_velocity_ratio z_new_device_ratio z_payment_failure_rate z_amount_deviation part_ml part_anomaly part_spike")))
def explain_linear(spark, d):
    names = [f"z_{n}" for n in risk.DETECTOR_TERMS] + ["part_ml", "part_anomaly", "part_spike"]
    return rounded(risk.linear_contributions(scored(spark, d)).select("transaction_id", *names))


@check("top_abs", scored_sql(
    "select transaction_id, array_to_string(list_transform(list_filter(items, lambda x: x.v > 0), lambda x: x.n), ',') as up, "
    "array_to_string(list_transform(list_filter(items, lambda x: x.v < 0), lambda x: x.n), ',') as down from ("
    "select transaction_id, list_transform(list_sort(list_transform(parts, lambda x: {'a': -abs(x.v), 'n': x.n, 'v': x.v})), "
    "lambda x: {'n': x.n, 'v': x.v}) as items from ("
    "select transaction_id, [{'n': 'velocity_ratio', 'v': round((velocity_ratio - mv) / 3 / 4 * 3, 4)}, "
    "{'n': 'new_device_ratio', 'v': round((new_device_ratio - mn) * 5 / 4 * 3, 4)}, "
    "{'n': 'payment_failure_rate', 'v': round((payment_failure_rate - mp) * 10 / 4 * 3, 4)}, "
    "{'n': 'amount_deviation', 'v': round((amount_deviation - ma) / 3 / 4 * 3, 4)}] as parts from scored, means))", MEANS))
def top_abs(spark, d):
    rows = stored_scores(spark, d)
    driven = evidence.drivers(rows, evidence.term_means(rows))
    return driven.selectExpr(
        "transaction_id", "array_join(transform(top_risk_drivers, x -> x.name), ',') as up",
        "array_join(transform(top_risk_reducers, x -> x.name), ',') as down",
    )


# Labels and scenarios

LABELS = """
known_place as (select distinct merchant_id, location from p join cutoff using (merchant_id) where t <= cutoff_us),
tagged as (
  select f.transaction_id, f.merchant_id, velocity_ratio >= 3 as velocity_spike,
    amount >= 5 * base_avg_amount or amount between 1 and 50 as amount_anomaly, is_new_device as device_flood,
    rows_10m >= 5 and method_max_share > 0.7 as payment_method_concentration,
    k.location is null as geographic_anomaly
  from features f left join known_place k on k.merchant_id = f.merchant_id and k.location = f.location
),
listed as (
  select *, list_filter([case when velocity_spike then 'velocity_spike' end, case when amount_anomaly then 'amount_anomaly' end,
    case when device_flood then 'device_flood' end,
    case when payment_method_concentration then 'payment_method_concentration' end,
    case when geographic_anomaly then 'geographic_anomaly' end], lambda x: x is not null) as tags from tagged
)
"""


@check("label_patterns", sql(
    "select * exclude (tags), len(tags) >= 2 as combined, coalesce(array_to_string(tags, ','), '') as tag_list from listed",
    *FEATURE_CTES, LABELS))
def label_patterns(spark, d):
    payments = dense(spark, d)
    history = baselines.learn(payments)
    places = baselines.known_values(payments, "location", history.cutoff)
    return labels.patterns(labels.inputs(payments, history.base), history.devices, places)


# Boosted trees: no SQL text can repeat the training, so these are checked by rows here and by quality in the tests. Where SQL can
# say some of the rows, a test compares those.

_EXTRACTED, _FITTED = {}, {}


def state_of(spark, path):
    """Names, sizes and times of a table's files, by which a changed table is known."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))


def table_key(spark, d):
    return spark.sparkContext.applicationId, state_of(spark, os.path.join(d, "events.parquet"))


def extracted(spark, d):
    """What the history teaches, and all features of every payment, written once a session for the queries of the trees."""
    key = table_key(spark, d)
    if key not in _EXTRACTED:
        history = learned(spark, d)
        _EXTRACTED[key] = history, materialize(features.extract(dense(spark, d), history), "features")
    return _EXTRACTED[key]


def fitted(spark, d):
    """The trained model and the cleaned features with their split. Training takes minutes, so a session fits a table once."""
    key = table_key(spark, d)
    if key not in _FITTED:
        # The split counts and compares stored rows: on the features' plan it would compute them again for each reading.
        rows = materialize(model.matrix(time_split(extracted(spark, d)[1])), "matrix")
        train, check_rows = (rows.where(f"split = '{s}'").drop("split") for s in ("train", "validation"))
        _FITTED[key] = model.train(train, check_rows), rows
    return _FITTED[key]


def held_out(spark, d):
    """Four models on the held-out last part: threshold, z-score (fitted on the first part), trees, and trees with the z-score."""
    trained, rows = fitted(spark, d)
    judged = model.score(trained, rows.where("split = 'test'")).drop("score")
    test = evaluation.zscore_model(judged.withColumnsRenamed({"probability": "gbt", "prediction": "gbt_hit"}),
                                   rows.where("split = 'train'")).withColumnsRenamed({"score": "zscore", "prediction": "z_hit"})
    test = risk.threshold_model(test).withColumnsRenamed({"score": "threshold", "prediction": "t_hit"})
    test = risk.combined_model(test, "gbt", "zscore").withColumnsRenamed({"score": "combined", "prediction": "c_hit"})
    return test.selectExpr(
        "int(label) as label", "stack(4, 'threshold', threshold, t_hit, 'zscore', zscore, z_hit, 'gbt', gbt, gbt_hit, 'combined', combined, c_hit)"
        " as (model, score, prediction)")


@check("gbt_train")
def gbt_train(spark, d):
    return evaluation.compare(held_out(spark, d))


# SQL can say the two models that are not trained; they stand on the matrix, in its order and single precision.
HELD_OUT = f"""
placed as (select *, row_number() over (order by t, transaction_id) as r, count(*) over () as n from features),
matrix as (
  select coalesce(is_suspicious, false)::int as label, r <= floor(n * 0.7::double) as known,
    r > floor(n * (0.7::double + 0.15::double)) as held, {', '.join(f"coalesce({n}, 0)::float::double as {n}" for n in fixed.ZSCORE_FEATURES)}
  from placed
),
fit as (
  select {', '.join(f"avg({n}) as m_{n}, coalesce(nullif(stddev_pop({n}), 0), 1) as s_{n}" for n in fixed.ZSCORE_FEATURES)}
  from matrix where known
),
zraw as (select matrix.*, ({KEYS}) / 5 as raw from matrix, fit),
predictions as (
  select 'threshold' as model, label, least(greatest(velocity_ratio / 20, 0), 1) as score, (velocity_ratio > 3)::int as prediction
  from matrix where held
  union all select 'zscore', label, score, (score > 0.5)::int from (
    select label, least(greatest(raw / ((select max(raw) from zraw where known) + 1e-8), 0), 1) as score from zraw where held)
)
"""


@check("agg_model_compare", sql("select c.*, pr.pr_auc from confusion c join pr using (model)", *FEATURE_CTES, HELD_OUT, CONFUSION, PR),
       part="model in ('threshold', 'zscore')")
def agg_model_compare(spark, d):
    """All four models on one split that none was trained on, the combined one with the trees' probability, and the best of them."""
    return rounded(evaluation.compare(held_out(spark, d)))


@check("gbt_score")
def gbt_score(spark, d):
    trained, rows = fitted(spark, d)
    return model.score(trained, rows).select("transaction_id", "score", "risk_score", "prediction")


@check("score_with_model")
def score_with_model(spark, d):
    """The score path with the trained model: its probability, the aggregate and the level."""
    history, rows = extracted(spark, d)
    rows = scoring.score_payments(dense(spark, d), history, fitted(spark, d)[0], extracted=rows)
    return rows.select("transaction_id", "ml_score", "anomaly_score", "spike_ratio", "overall_risk", "risk_level")


@check("feature_importance")
def feature_importance(spark, d):
    return model.importances(spark, fitted(spark, d)[0])


@check("explain_trees")
def explain_trees(spark, d):
    trained, rows = fitted(spark, d)
    return model.explain(trained, rows)
