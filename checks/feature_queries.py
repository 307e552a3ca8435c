"""Features, baselines, aggregates and series."""

from paywatch import fixed
from paywatch.operators import baselines, evaluation, features, profiles, series

from checks.base_sql import BASE30, DENSE, EVENT, FEATURE_CTES, KNOWN, MERCHANTS, alerts_sql, frame, scored_sql, sql
from checks.registry import alerts, check, dense, event, learned, merchants, r6, rounded, scored, stored_scores


def feature_sql(names):
    return sql(r6(f"select transaction_id, merchant_id, {', '.join(names.split())} from features", names), *FEATURE_CTES)


VELOCITY = "txn_count_1m txn_count_5m txn_count_10m txn_count_30m txn_count_1h"


@check("feat_velocity", sql(
    "select transaction_id, merchant_id, " + ", ".join(
        f"count(*) over {frame(m)} as {n}" for n, m in fixed.VELOCITY_WINDOWS.items()) + " from p", DENSE))
def feat_velocity(spark, d):
    return rounded(features.velocity(dense(spark, d)).select("transaction_id", "merchant_id", *VELOCITY.split()))


def picked(df, names):
    return rounded(df.selectExpr("transaction_id", "merchant_id", *[f"double({n}) as {n}" for n in names.split()]))


AMOUNT = "current_amount avg_amount median_amount amount_deviation amount_ratio_to_baseline"


@check("feat_amount", feature_sql(AMOUNT))
def feat_amount(spark, d):
    return picked(features.amount(dense(spark, d), learned(spark, d).base), AMOUNT)


DEVICE = "unique_devices new_device_count new_device_ratio accounts_per_device"


@check("feat_device", feature_sql(DEVICE))
def feat_device(spark, d):
    return picked(features.device(dense(spark, d), learned(spark, d).devices), DEVICE)


CUSTOMER = "unique_customers new_customer_ratio"


@check("feat_customer", feature_sql(CUSTOMER))
def feat_customer(spark, d):
    return picked(features.customer(dense(spark, d), learned(spark, d).customers), CUSTOMER)


METHOD = "payment_method_entropy payment_failure_rate payment_method_spike"


@check("feat_method", feature_sql(METHOD))
def feat_method(spark, d):
    return picked(features.method(dense(spark, d)), METHOD)


@check("feat_time", sql(r6(
    "select transaction_id, hour(make_timestamp(t)) as hour, isodow(make_timestamp(t)) - 1 as day_of_week, "
    "abs(hour(make_timestamp(t)) - typical) / 12.0::double as time_deviation from p join "
    "(select merchant_id, median(hour(make_timestamp(t))) as typical from p group by 1) using (merchant_id)",
    "time_deviation"), EVENT))
def feat_time(spark, d):
    return rounded(features.time(event(spark, d)).select("transaction_id", "hour", "day_of_week", "time_deviation"))


RATES = "velocity_ratio current_txn_rate current_suspicious_rate"


@check("feat_baseline", feature_sql(RATES))
def feat_baseline(spark, d):
    return picked(features.rates(dense(spark, d), learned(spark, d).base), RATES)


@check("feat_all", sql(r6(
    f"select transaction_id, merchant_id, {', '.join(fixed.FEATURES)}, is_suspicious from features",
    " ".join(fixed.FEATURES)), *FEATURE_CTES))
def feat_all(spark, d):
    return rounded(features.extract(dense(spark, d)).drop("timestamp", "ts_us"))


@check("known_devices", sql("select * from known_device", DENSE, BASE30, KNOWN))
def known_devices(spark, d):
    return baselines.known_values(dense(spark, d), "device_id")


@check("known_customers", sql("select * from known_customer", DENSE, BASE30, KNOWN))
def known_customers(spark, d):
    return baselines.known_values(dense(spark, d), "customer_id")


@check("win_last_n", sql(
    "select merchant_id, transaction_id, rn from (select *, row_number() over (partition by merchant_id "
    "order by t desc, transaction_id desc) as rn from p) where rn <= 100", EVENT))
def win_last_n(spark, d):
    return rounded(profiles.last_n(event(spark, d), fixed.RECENT_ROWS).select("merchant_id", "transaction_id", "rn"))


@check("win_first_third", sql(
    "select merchant_id, transaction_id, position from (select *, row_number() over (partition by merchant_id "
    "order by t, transaction_id) as position, count(*) over (partition by merchant_id) as n from p) where position <= n // 3",
    EVENT))
def win_first_third(spark, d):
    return profiles.first_third(event(spark, d)).select("merchant_id", "transaction_id", "position")


SERIES = """
minutes as (select merchant_id, t // 60000000 as minute, count(*) as rate from p group by 1, 2),
spans as (select merchant_id, min(minute) as lo, max(minute) as hi from minutes group by 1),
series as (
  select s.merchant_id, g.minute, coalesce(m.rate, 0) as rate
  from (select merchant_id, unnest(generate_series(lo, hi)) as minute from spans) g
  join spans s using (merchant_id) left join minutes m on m.merchant_id = g.merchant_id and m.minute = g.minute
)
"""


@check("rate_series", sql("select * from series", DENSE, SERIES))
def rate_series(spark, d):
    return series.rate_series(dense(spark, d))


@check("win_rolling_points", sql(
    "select merchant_id, minute, rate, rn from (select *, row_number() over (partition by merchant_id order by minute desc)"
    " as rn from series) where rn <= 30", DENSE, SERIES))
def win_rolling_points(spark, d):
    return rounded(series.rolling_points(series.rate_series(dense(spark, d))))


SMOOTH = """
lists as (select merchant_id, list(rate::double order by minute) as rates, count(*) as minutes from series group by 1),
levels as (select *, list_reduce(rates, lambda e, r: 0.3 * r + 0.7 * e) as ewma from lists),
spreads as (
  select merchant_id, minutes, ewma,
    sqrt(list_reduce(list_transform(rates, lambda r: (r - ewma) * (r - ewma)), lambda v, x: 0.3 * x + 0.7 * v)) as ewma_std
  from levels
)
"""


@check("ewma", sql("select merchant_id, minutes, round(ewma, 6) as ewma from spreads", DENSE, SERIES, SMOOTH))
def ewma(spark, d):
    return rounded(series.ewma(dense(spark, d)).drop("ewma_std"))


@check("ewma_std", sql("select merchant_id, round(ewma_std, 6) as ewma_std from spreads", DENSE, SERIES, SMOOTH))
def ewma_std(spark, d):
    return rounded(series.ewma(dense(spark, d)).select("merchant_id", "ewma_std"))


@check("agg_peak_rate", sql(
    "select merchant_id, max(rate) as peak_rate, round(max(rate / (coalesce(baseline_txn_rate, 100) / 60)), 1) as spike_ratio, "
    "bool_or(rate > coalesce(baseline_txn_rate, 100) / 60 * 2.5) as has_spike from (select *, row_number() over "
    "(partition by merchant_id order by minute desc) as rn from series) s left join merchants m on m.id = s.merchant_id "
    "where rn <= 30 group by 1", DENSE, SERIES, MERCHANTS))
def agg_peak_rate(spark, d):
    return rounded(series.peak_rate(series.rate_series(dense(spark, d)), merchants(spark, d)))


# Baselines and aggregates

SEVEN = """
stats as (
  select merchant_id, count(*) as n, avg(amount) as a, count(*) filter (status = 'failed') as f,
    count(*) filter (is_suspicious) as s
  from p where t >= (select max(t) from p) - 7 * 86400000000 group by 1
)
"""


@check("agg_baseline_7d", sql(r6(
    "select id as merchant_id, coalesce(n, 0) as txn_count_7d, "
    "coalesce(n / 10080.0::double * 60, baseline_txn_rate) as baseline_txn_rate_per_hour, "
    "coalesce(a, baseline_avg_amount) as baseline_avg_amount, coalesce(f / n::double, baseline_failure_rate) "
    "as baseline_failure_rate, coalesce(s / n::double, baseline_suspicious_rate) as baseline_suspicious_rate "
    "from merchants left join stats on id = merchant_id where is_active",
    "baseline_txn_rate_per_hour baseline_avg_amount baseline_failure_rate baseline_suspicious_rate"),
    EVENT, MERCHANTS, SEVEN))
def agg_baseline_7d(spark, d):
    return rounded(baselines.baseline_7d(event(spark, d), merchants(spark, d)))


@check("agg_baseline_first30", sql(r6("select * from base30", "base_rate_per_min base_avg_amount"), EVENT, BASE30))
def agg_baseline_first30(spark, d):
    return rounded(baselines.baseline_first_share(event(spark, d)))


@check("agg_alerts_24h", alerts_sql(
    "select 'alerts_24h_' || risk_level as key, count(*)::double as value from alerts, (select max(t) as now from p) "
    "where created_us >= now - 86400000000 group by risk_level union all "
    "select 'avg_risk_' || risk_level, round(avg(risk_score), 3) from alerts, (select max(t) as now from p) "
    "where created_us >= now - 86400000000 group by risk_level"))
def agg_alerts_24h(spark, d):
    return profiles.alerts_24h(alerts(spark, d), baselines.latest_time(dense(spark, d)))


@check("agg_risk_1h", scored_sql(
    "select count(*) as transactions_1h, round(avg(ml_score), 3) as avg_ml_score_1h, "
    "round(avg(anomaly_score), 3) as avg_anomaly_score_1h from scored where t >= (select max(t) from p) - 3600000000"))
def agg_risk_1h(spark, d):
    return profiles.risk_1h(scored(spark, d), baselines.latest_time(dense(spark, d)))


@check("agg_risk_distribution", scored_sql(
    "select count(*) as total_predictions_24h, " + ", ".join(
        f"round(count(*) filter (risk_level = '{lv}') * 100.0::double / count(*), 2) as pct_{lv}" for lv in fixed.RISK_LEVELS)
    + " from scored where t >= (select max(t) from p) - 86400000000"))
def agg_risk_distribution(spark, d):
    return profiles.risk_distribution(scored(spark, d), baselines.latest_time(dense(spark, d)))


LAST = """
last200 as (
  select *, row_number() over (partition by merchant_id order by t desc, transaction_id desc) as rn from p
  qualify rn <= 200
),
last100 as (select * from last200 where rn <= 100)
"""

AMOUNT_DIST = """
amounts as (
  select merchant_id, count(*) as n, round(min(amount), 2) as min_amount, round(max(amount), 2) as max_amount,
    round(list_sort(list(amount))[count(*) // 2 + 1], 2) as median_amount,
    (cast(floor(sum(cast(amount as decimal(24,6))) * 100 / count(*) + 0.5) as bigint) / 100.0)::double as mean_amount
  from last200 group by 1
)
"""


@check("agg_amount_dist", sql("select * from amounts", EVENT, LAST, AMOUNT_DIST))
def agg_amount_dist(spark, d):
    return rounded(profiles.amount_distribution(event(spark, d)))


@check("agg_median_interp", sql(
    "select merchant_id, round(median(amount), 6) as median_amount from p group by 1", EVENT))
def agg_median_interp(spark, d):
    return rounded(profiles.median_per_merchant(event(spark, d)))


def share_cte(name, column, top=""):
    return f"""
{name} as (
  select merchant_id, coalesce({column}, 'unknown') as {column}, count(*) as n,
    round(count(*) * 100.0::double / sum(count(*)) over (partition by merchant_id), 1) as pct,
    row_number() over (partition by merchant_id order by count(*) desc, max(rn) desc, coalesce({column}, 'unknown')) as place
  from last200 group by 1, 2 {top}
)
"""


METHOD_SHARES = share_cte("method_shares", "payment_method")
PLACE_SHARES = share_cte("place_shares", "location", "qualify place <= 10")


@check("agg_method_dist", sql("select * from method_shares", EVENT, LAST, METHOD_SHARES))
def agg_method_dist(spark, d):
    return rounded(profiles.shares(event(spark, d), "payment_method"))


@check("agg_geo_dist", sql("select * from place_shares", EVENT, LAST, PLACE_SHARES))
def agg_geo_dist(spark, d):
    return rounded(profiles.shares(event(spark, d), "location", top=fixed.TOP_LOCATIONS))


TOP_DEVICES = (
    "select merchant_id, device_id, count(*) as transaction_count, row_number() over (partition by merchant_id "
    "order by count(*) desc, max(rn) desc) as place from (select *, row_number() over (partition by merchant_id "
    "order by t desc, transaction_id desc) as rn from p where device_id is not null qualify rn <= 100) group by 1, 2 "
    "qualify place <= 5"
)


@check("agg_top_devices", sql(TOP_DEVICES, EVENT))
def agg_top_devices(spark, d):
    return rounded(profiles.top_devices(event(spark, d)))


@check("agg_accounts_per_device", sql(
    "select merchant_id, count(*) as devices, round(avg(n), 6) as accounts_feature_rule, "
    "round(coalesce(avg(n) filter (n > 0), 0), 6) as accounts_report_rule from (select merchant_id, device_id, "
    "count(distinct customer_id) as n from p where device_id is not null group by 1, 2) group by 1", EVENT))
def agg_accounts_per_device(spark, d):
    return rounded(profiles.accounts_per_device(event(spark, d)))


DEVICES = """
placed as (
  select *, row_number() over (partition by merchant_id order by t, transaction_id) as position,
    count(*) over (partition by merchant_id) as n from p
),
device_first as (
  select merchant_id, device_id, min(position) > max(n) // 3 as is_new from placed where device_id is not null group by 1, 2
),
device_totals as (
  select merchant_id, count(*) as total_devices, count(*) filter (is_new) * 100.0::double / count(*) as new_pct
  from device_first group by 1
),
device_accounts as (
  select merchant_id, avg(c) as accounts from (select merchant_id, device_id, count(distinct customer_id) as c from last100
    where device_id is not null and customer_id is not null group by 1, 2) group by 1
),
devices as (
  select m.merchant_id, coalesce(total_devices, 0) as total_devices, round(coalesce(new_pct, 0), 1) as new_device_percentage,
    case when total_devices is null then 'No device data available'
         when new_pct > 50 then printf('HIGH: %.0f%% new devices detected', new_pct)
         when new_pct > 20 then printf('Elevated: %.0f%% new devices detected', new_pct)
         else 'Normal distribution' end as device_concentration,
    round(case when total_devices is null then 1 else coalesce(accounts, 0) end, 2) as accounts_per_device_avg
  from (select distinct merchant_id from p) m left join device_totals using (merchant_id)
  left join device_accounts using (merchant_id)
)
"""


@check("agg_device_summary", sql("select * from devices", DENSE, LAST, DEVICES))
def agg_device_summary(spark, d):
    return rounded(profiles.device_summary(dense(spark, d)))


ACTIVITY = """
anchors as (select merchant_id, max(t) as anchor from p group by 1),
window_counts as (
  select merchant_id, count(*) filter (t >= anchor - 60000000) as txn_count_1m,
    count(*) filter (t >= anchor - 300000000) as txn_count_5m, count(*) filter (t >= anchor - 600000000) as txn_count_10m,
    count(*) filter (t >= anchor - 1800000000) as txn_count_30m
  from p join anchors using (merchant_id) group by 1
),
recent_stats as (
  select merchant_id,
    (cast(floor(sum(cast(amount as decimal(24,6))) * 100 / count(*) + 0.5) as bigint) / 100.0)::double as avg_amount,
    round(count(*) filter (status = 'failed') / count(*)::double, 4) as failure_rate,
    round(count(*) filter (is_suspicious) / count(*)::double, 4) as suspicious_rate
  from last100 group by 1
),
activity as (
  select merchant_id, txn_count_1m::double as current_txn_rate, txn_count_1m, txn_count_5m, txn_count_10m, txn_count_30m,
    round(v, 2) as velocity_ratio, avg_amount, failure_rate, suspicious_rate,
    case when v > 5 then printf('⚠️ SEVERE SPIKE: %.1fx above baseline', v)
         when v > 3 then printf('⚠️ SPIKE: %.1fx above baseline', v)
         when v > 1.5 then printf('Elevated: %.1fx above baseline', v)
         else printf('%.1fx baseline', v) end as change_from_baseline
  from (select c.*, r.* exclude (merchant_id),
      txn_count_1m / greatest(coalesce(baseline_txn_rate, 100) / 60, 0.01) as v
    from window_counts c join recent_stats r using (merchant_id) left join merchants m on m.id = c.merchant_id)
)
"""


@check("agg_recent_activity", sql("select * from activity", DENSE, MERCHANTS, LAST, ACTIVITY))
def agg_recent_activity(spark, d):
    return rounded(profiles.recent_activity(dense(spark, d), merchants(spark, d)))


@check("agg_merchant_profile", sql(
    "select merchant_id, count(*) as txns, count(*) filter (is_suspicious) as suspicious, "
    "round(count(*) filter (is_suspicious) * 100.0::double / count(*), 6) as suspicious_pct from p group by 1", EVENT))
def agg_merchant_profile(spark, d):
    return rounded(profiles.merchant_profile(event(spark, d)))


@check("agg_dataset_profile", sql(
    "select count(*) as total, count(*) filter (is_suspicious) as suspicious, count(*) filter (not is_suspicious) as normal, "
    "round(count(*) filter (is_suspicious) / count(*)::double, 6) as suspicious_share, "
    "count(distinct merchant_id) as merchants, min(t) as first_us, max(t) as last_us from p", EVENT))
def agg_dataset_profile(spark, d):
    return rounded(profiles.dataset_profile(event(spark, d)))


@check("agg_class_ratio", sql(
    "select count(*) filter (not is_suspicious) as negatives, count(*) filter (is_suspicious) as positives, "
    "round(count(*) filter (not is_suspicious) / greatest(count(*) filter (is_suspicious), 1)::double, 6) as ratio from p",
    EVENT))
def agg_class_ratio(spark, d):
    return rounded(profiles.class_ratio(event(spark, d)))


@check("agg_feature_moments", sql(
    " union all ".join(
        f"select '{n}' as feature, round(avg({n}), 6) as mean, "
        f"round(case when stddev_pop({n}) = 0 then 1 else stddev_pop({n}) end, 6) as std from features"
        for n in fixed.FEATURES), *FEATURE_CTES))
def agg_feature_moments(spark, d):
    return rounded(evaluation.feature_moments(features.extract(dense(spark, d))))


@check("agg_status_counts", alerts_sql(
    "select count(*) filter (status = 'open') as open_alerts, count(*) filter (status = 'investigating') as investigating, "
    "(select count(*) from scored where risk_level in ('high', 'critical')) as flagged from alerts"))
def agg_status_counts(spark, d):
    assessed = stored_scores(spark, d)
    return profiles.status_counts(alerts(spark, d, assessed), assessed)


@check("proj_features", sql(r6(
    f"select transaction_id, {', '.join(f'coalesce({n}, 0) as {n}' for n in fixed.FEATURES)} from features",
    " ".join(fixed.FEATURES)), *FEATURE_CTES))
def proj_features(spark, d):
    return rounded(features.project(features.extract(dense(spark, d))))


# Some values are made missing or infinite on purpose, to be cleaned again.
DIRTY = (
    "case when event_id % 50 = 0 then {nan} when event_id % 50 = 1 then {inf} when event_id % 50 = 2 then -{inf}"
    " when event_id % 50 = 3 then null else value end"
)


@check("clean_matrix",
       "select event_id, round(case when x is null or isnan(x) then 0 when x = 'infinity'::double then 100 "
       "when x = '-infinity'::double then -100 else x end::float::double, 4) as value from (select event_id, "
       + DIRTY.format(nan="'nan'::double", inf="'infinity'::double") + " as x from events)")
def clean_matrix(spark, d):
    from paywatch.sources.tables import read_table

    raw = read_table(spark, d, "events").selectExpr(
        "event_id", DIRTY.format(nan="double('nan')", inf="double('infinity')") + " as value"
    )
    return rounded(features.clean_matrix(raw, ["value"]), 4)
