"""Shared parts of the DuckDB texts: adapter views, baselines, features and scores, as named CTEs."""

PAYMENTS = """
payments_raw as (
  select *, cast(json_extract_string(props, '$.k') as bigint) as k, user_id % 20 + 1 as m, epoch_us(ts) as us from events
),
payments as (
  select event_id, printf('tx_%08d', event_id) as transaction_id, printf('merchant_%03d', m) as merchant_id,
    us as event_us, 1704067200000000 + (us - 1704067200000000) // 60 as dense_us,
    case when event_id % 997 = 0 then value * 2000 else value * 100 end as amount,
    'INR' as currency,
    case when m = 3 and k % 10 < 8 then 'card'
         else ['upi','card','netbanking','wallet','emi'][cast(k % 5 as int) + 1] end as payment_method,
    'cust_' || cast(user_id as varchar) as customer_id,
    case when k % 17 = 0 then null else 'dev_' || cast(k % 50 as varchar) end as device_id,
    case when m = 7 and k < 60 then 'Proxy_VPN'
         else ['Mumbai','Delhi','Bangalore','Chennai','Hyderabad','Pune','Kolkata'][cast(user_id % 7 as int) + 1] end as location,
    case when event_type = 'error' and k % 3 <> 0 then 'failed' else 'success' end as status,
    (value > 150 or (event_type = 'error' and k % 10 = 0)) as is_suspicious
  from payments_raw
),
"""
# p: payments on the chosen clock
DENSE = PAYMENTS + "p as (select *, dense_us as t from payments)"
EVENT = PAYMENTS + "p as (select *, event_us as t from payments)"

MERCHANTS = """
merchants as (
  select printf('merchant_%03d', s_suppkey + 3) as id, s_name as name,
    ['standard','elevated','trusted'][cast(s_nationkey % 3 as int) + 1] as risk_tier,
    100.0::double as baseline_txn_rate, 5000.0::double as baseline_avg_amount,
    0.02::double as baseline_failure_rate, 0.02::double as baseline_suspicious_rate,
    (s_acctbal > 0) as is_active
  from supplier
)
"""

CUTOFF = """
rel as (select merchant_id, t, t - min(t) over (partition by merchant_id) as rel from p),
cutoff as (
  select merchant_id, min(t) + cast(floor(quantile_cont(rel, 0.3) + 0.01) as bigint) as cutoff_us from rel group by 1
)
"""

BASE30 = CUTOFF + """,
base30 as (
  select p.merchant_id, count(*) as baseline_rows,
    count(*) / greatest((max(t) - min(t)) / 60000000.0, 1.0) as base_rate_per_min, avg(amount) as base_avg_amount
  from p join cutoff using (merchant_id) where t <= cutoff_us group by 1
)
"""

KNOWN = """
known_device as (
  select distinct merchant_id, device_id from p join cutoff using (merchant_id)
  where t <= cutoff_us and device_id is not null
),
known_customer as (
  select distinct merchant_id, customer_id from p join cutoff using (merchant_id)
  where t <= cutoff_us and customer_id is not null
),
flagged as (
  select p.*, b.base_rate_per_min, b.base_avg_amount,
    p.device_id is not null and d.device_id is null as is_new_device,
    p.customer_id is not null and c.customer_id is null as is_new_customer
  from p
  left join base30 b using (merchant_id)
  left join known_device d on d.merchant_id = p.merchant_id and d.device_id = p.device_id
  left join known_customer c on c.merchant_id = p.merchant_id and c.customer_id = p.customer_id
)
"""


def frame(minutes):
    return f"(partition by merchant_id order by t range between {minutes * 60000000} preceding and current row)"


MEASURED = f"""
measured as (
  select flagged.*,
    count(*) over w1 as c1, count(*) over w5 as c5, count(*) over w10 as c10, count(*) over w30 as c30,
    count(*) over w60 as c60,
    avg(amount) over w60 as avg_60, median(amount) over w60 as med_60, stddev_samp(amount) over w60 as std_60,
    count(distinct device_id) over w10 as devices,
    count(distinct case when is_new_device then device_id end) over w10 as new_devices,
    count(distinct case when device_id is not null and customer_id is not null then device_id || '|' || customer_id end)
      over w10 as pairs,
    count(distinct customer_id) over w10 as customers,
    count(distinct case when is_new_customer then customer_id end) over w10 as new_customers,
    count(*) filter (status = 'failed') over w10 as failed, count(*) filter (is_suspicious) over w10 as suspicious,
    coalesce(map_values(histogram(lower(payment_method)) over w10), []) as methods
  from flagged
  window w1 as {frame(1)}, w5 as {frame(5)}, w10 as {frame(10)}, w30 as {frame(30)}, w60 as {frame(60)}
),
hours as (select merchant_id, median(hour(make_timestamp(t))) as typical_hour from p group by 1),
shaped as (
  select m.*, h.typical_hour, list_filter(methods, lambda x: x > 0) as used,
    case when coalesce(std_60, 0) > 0 then least(abs(amount - avg_60) / greatest(std_60, 1), 50) else 0 end as deviation
  from measured m join hours h using (merchant_id)
),
features as (
  select transaction_id, merchant_id, t, amount, payment_method, device_id, customer_id, location, status, is_suspicious,
    base_rate_per_min, base_avg_amount, is_new_device,
    c1::double as txn_count_1m, c5::double as txn_count_5m, c10::double as txn_count_10m, c30::double as txn_count_30m,
    c60::double as txn_count_1h,
    amount as current_amount, avg_60 as avg_amount, med_60 as median_amount, deviation::double as amount_deviation,
    least(amount / greatest(base_avg_amount, 1), 100)::double as amount_ratio_to_baseline,
    devices::double as unique_devices, new_devices::double as new_device_count,
    new_devices / greatest(devices, 1)::double as new_device_ratio,
    case when devices > 0 then pairs / devices::double else 1.0 end as accounts_per_device,
    customers::double as unique_customers, new_customers / greatest(customers, 1)::double as new_customer_ratio,
    case when len(used) > 1
      then -list_sum(list_transform(used, lambda x: x / list_sum(used)::double * ln(x / list_sum(used)::double)))
      else 0 end::double as payment_method_entropy,
    failed / c10::double as payment_failure_rate,
    case when len(used) > 0 then list_max(used) / list_sum(used)::double - 1.0 / len(used) else 0 end::double
      as payment_method_spike,
    hour(make_timestamp(t))::double as hour, (isodow(make_timestamp(t)) - 1)::double as day_of_week,
    (abs(hour(make_timestamp(t)) - typical_hour) / 12.0)::double as time_deviation,
    least(c1 / greatest(base_rate_per_min, 0.01), 100)::double as velocity_ratio,
    c1::double as current_txn_rate, suspicious / c10::double as current_suspicious_rate,
    coalesce(list_max(used) / list_sum(used)::double, 0) as method_max_share, c10 as rows_10m
  from shaped
)
"""

SCORED = """
zed as (
  select *, (velocity_ratio / 3 + new_device_ratio * 5 + payment_failure_rate * 10 + amount_deviation / 3) / 4 * 3 as z
  from features
),
sig as (select *, 1 / (1 + exp(-0.8 * (z - 3))) as sig from zed),
detected as (
  select *, round(sig, 4) as anomaly_score, round(velocity_ratio, 2) as spike_ratio, round(z, 4) as z_score,
    sig > 0.6 as is_anomalous,
    case when sig >= 0.9 or velocity_ratio >= 10 then 'critical' when sig >= 0.7 or velocity_ratio >= 5 then 'high'
         when sig >= 0.5 or velocity_ratio >= 3 then 'medium' when sig >= 0.3 or velocity_ratio >= 2 then 'low'
         else 'none' end as spike_severity
  from sig
),
mixed as (
  select *, anomaly_score as ml_score,
    least(greatest(0.5 * anomaly_score + 0.3 * anomaly_score + 0.2 * least(spike_ratio / 20, 1), 0), 1) as raw_overall
  from detected
),
scored as (
  select *, round(raw_overall, 4) as overall_risk,
    case when raw_overall >= 0.95 then 'critical' when raw_overall >= 0.8 then 'high'
         when raw_overall >= 0.6 then 'medium' else 'low' end as risk_level
  from mixed
)
"""

# Candidates of level medium and above, then greedy suppression (five minutes) per merchant.
ALERTS = """
cands as (select merchant_id, t, min(transaction_id) as transaction_id from scored where risk_level <> 'low' group by 1, 2),
kept(merchant_id, t) as (
  select merchant_id, min(t) from cands group by 1
  union all
  select k.merchant_id, (select min(c.t) from cands c where c.merchant_id = k.merchant_id and c.t > k.t + 300000000)
  from kept k where k.t is not null
),
alerts as (
  select 'alert_' || substr(sha256(s.merchant_id || '|' || s.transaction_id), 1, 12) as alert_id, s.merchant_id,
    s.transaction_id, s.overall_risk as risk_score, s.anomaly_score, s.spike_ratio, s.ml_score, s.current_txn_rate,
    s.base_rate_per_min as baseline_txn_rate, s.risk_level, 'open' as status, s.t as created_us,
    s.velocity_ratio, s.txn_count_1m, s.new_device_ratio, s.payment_failure_rate, s.amount_deviation,
    printf('FRAUD SPIKE DETECTED — Merchant %s. Current rate: %.0f/min (baseline: %.0f/min, spike: %.1fx). Risk: %s.',
      s.merchant_id, s.current_txn_rate, s.base_rate_per_min, s.spike_ratio, upper(s.risk_level)) as summary
  from kept k join cands c on c.merchant_id = k.merchant_id and c.t = k.t
  join scored s on s.transaction_id = c.transaction_id
)
"""


def sql(body, *ctes, recursive=False):
    word = "with recursive" if recursive else "with"
    return f"{word} {', '.join(c.strip().strip(',') for c in ctes)}\n{body}"


FEATURE_CTES = (DENSE, BASE30, KNOWN, MEASURED)
SCORE_CTES = (*FEATURE_CTES, SCORED)


def scored_sql(body, *ctes):
    return sql(body, *SCORE_CTES, *ctes)


def alerts_sql(body, *ctes):
    return sql(body, *SCORE_CTES, ALERTS, *ctes, recursive=True)
