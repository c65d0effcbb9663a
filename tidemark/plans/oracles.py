"""DuckDB SQL for the queries over the driver's tables, written independently of the Spark code."""

from __future__ import annotations

from tidemark.plans import operations, streams, ticketing_sql

_T = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _text(column: str) -> str:
    return _T.format(column)


_FACT = """fact as (
  select l.*, o.*, p.*, cast(o_orderdate as date) as paid_date, case when l_returnflag = 'R' then cast(l_shipdate as date) end as refunded_date
  from lineitem l join orders o on l_orderkey = o_orderkey join part p on l_partkey = p_partkey
)"""
_DAILY = f"""{_FACT}, signed as (
  select paid_date as sales_date, 1 as sign, p_type, p_brand, o_orderkey, cast(l_quantity as bigint) as tickets, cast(l_extendedprice as decimal(18,2)) as amount from fact
  union all select refunded_date, -1, p_type, p_brand, o_orderkey, 0, -cast(l_extendedprice as decimal(18,2)) from fact where refunded_date is not null
), daily as (
  select sales_date, p_type, p_brand, count(distinct case when sign > 0 then o_orderkey end) as paid_orders, cast(sum(tickets) as bigint) as tickets_sold, cast(sum(greatest(amount, 0)) as double) as gross_revenue,
    count(distinct case when sign < 0 then o_orderkey end) as refunded_orders, cast(-sum(least(amount, 0)) as double) as refunded_amount, cast(sum(amount) as double) as net_revenue from signed group by all
)"""


def _versions(source: str, keep: str = "true") -> str:
    """A user's states in order (none after an error): runs of one state are islands, and a version lasts until the next island."""
    return f"""s as (select user_id, event_id, ts, case when event_type <> 'error' then event_type end as state from {source} where {keep}), i as (
  select *, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, state order by event_id) as island from s
), runs as (select user_id, state, min(event_id) as first_id, arg_min(ts, event_id) as began from i group by user_id, state, island), n as (
  select *, lead(first_id) over w as next_id, lead(began) over w as ended from runs window w as (partition by user_id order by first_id)
), versions as (select user_id, state as event_type, first_id as start_seq, next_id as end_seq, next_id is null as is_current, began as valid_from, ended as valid_to from n where state is not null)"""


_PIT = _versions("events", "event_type <> 'purchase'") + """, pit as (
  select b.event_id, b.user_id, b.value, b.ts, v.event_type as tier, v.start_seq as version
  from (select * from events where event_type = 'purchase') b left join versions v on b.user_id = v.user_id and v.valid_from <= b.ts and (v.valid_to is null or v.valid_to > b.ts)
)"""
_MARKS = """m as (
  select l.*, o.*, not coalesce(l_discount between 0 and 0.08, false) as r1, not coalesce(l_shipdate >= o_orderdate, false) as r2, not coalesce(l_quantity <= 45, false) as w1
  from lineitem l join orders o on l_orderkey = o_orderkey
)"""
_MEASURES = f"""{_MARKS}, q as (
  select 'lineitem' as source_table, unnest(['known_discount', 'ships_after_order', 'small_quantity', '__quarantined__']) as rule, unnest(['drop', 'drop', 'warn', 'drop']) as action,
    unnest([count(*) filter (r1), count(*) filter (r2), count(*) filter (w1), count(*) filter (r1 or r2)]) as failed_rows, count(*) as total_rows from m
  union all
  select 'customer', unnest(['has_balance', 'known_segment', '__quarantined__']), unnest(['drop', 'warn', 'drop']),
    unnest([count(*) filter (not c_acctbal >= 0), count(*) filter (not c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')), count(*) filter (not c_acctbal >= 0)]), count(*) from customer
)"""
_PERFORMANCE = f"""{_FACT}, sums as (
  select l_partkey, sum(case when refunded_date is null then cast(l_quantity as bigint) else 0 end) as sold, sum(cast(l_extendedprice as decimal(18,2))) as gross,
    sum(case when refunded_date is not null then cast(l_extendedprice as decimal(18,2)) end) as back, min(paid_date) as first_sale, max(paid_date) as last_sale from fact group by all
), perf as (
  select p.p_partkey, cast(coalesce(sold, 0) as bigint) as tickets_sold, coalesce(cast(gross as double), 0) as gross, coalesce(cast(back as double), 0) as refunded,
    round(coalesce(cast(gross as double), 0) - coalesce(cast(back as double), 0), 2) as net, round(case when p_size > 0 then coalesce(sold, 0) / cast(p_size as double) end, 9) as sell_through, first_sale, last_sale
  from part p left join sums on p.p_partkey = l_partkey
)"""
_CUSTOMERS = f"""{_FACT}, b as (
  select o_custkey, max(paid_date) as last_purchase, count(distinct o_orderkey) as orders, count(distinct case when refunded_date is not null then o_orderkey end) as refunded_orders,
    coalesce(cast(sum(case when refunded_date is null then cast(l_extendedprice as decimal(18,2)) end) as double), 0) as net from fact group by all
), f as (
  select o_custkey, p_type from (select o_custkey, p_type, row_number() over (partition by o_custkey order by sum(cast(l_quantity as bigint)) desc, p_type) as n from fact where p_type is not null group by o_custkey, p_type) where n = 1
), cust as (
  select c_custkey, c_mktsegment, coalesce(orders, 0) as orders, coalesce(refunded_orders, 0) as refunded_orders, coalesce(net, 0) as net, f.p_type as favourite, coalesce(clicks, 0) as clicks, last_purchase
  from customer left join b on c_custkey = b.o_custkey left join f on c_custkey = f.o_custkey left join (select user_id, count(*) as clicks from events group by all) e on c_custkey = user_id
)"""
_FUNNEL = """s as (
  select user_id, cast(ts as date) as d, min(ts) as began, max(cast(event_type = 'view' as int)) as viewed, max(cast(event_type = 'click' as int)) as clicked,
    max(cast(event_type = 'signup' as int)) as signed_up, max(cast(event_type = 'purchase' as int)) as purchased from events group by all
), fun as (
  select cast(cast(began as date) as varchar) as session_date, cast(user_id % 3 as varchar) as device, count(*) as sessions, cast(sum(viewed) as bigint) as viewed, cast(sum(clicked) as bigint) as clicked,
    cast(sum(signed_up) as bigint) as signed_up, cast(sum(purchased) as bigint) as purchased from s group by all
)"""
_WHO = """bounds as (select cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as z from orders), dates as (
  select cast(unnest(generate_series(cast(a + 90 as timestamp), cast(z - 60 as timestamp), interval 14 days)) as date) as as_of_date from bounds
), ord as (
  select o.*, cast(o_orderdate as date) as paid_date, (select cast(max(l_shipdate) as date) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as refunded_date from orders o
), who as (select distinct o_custkey, as_of_date from ord, dates where paid_date > as_of_date - 365 and paid_date <= as_of_date)"""


def _in(day: str, n: int) -> str:
    return f"{day} > w.as_of_date - {n} and {day} <= w.as_of_date"


_FEATURES = f"""{_WHO}, feat as (
  select w.o_custkey, w.as_of_date, cast(date_diff('day', max(paid_date), w.as_of_date) as int) as recency_days,
    {", ".join(f"cast(count(distinct case when {_in('paid_date', n)} then o_orderkey end) as int) as orders_{n}d" for n in (30, 90, 365))},
    {", ".join(f"coalesce(cast(cast(sum(case when {_in('paid_date', n)} then o_totalprice end) as decimal(12,2)) as double), 0) as revenue_{n}d" for n in (90, 365))},
    cast(count(distinct case when {_in('refunded_date', 365)} then o_orderkey end) as int) as refunds_365d
  from who w join ord o on o.o_custkey = w.o_custkey and paid_date <= w.as_of_date group by w.o_custkey, w.as_of_date
)"""
_LABELS = """lab as (
  select o_custkey, as_of_date, 1 - cast(exists (select 1 from ord o where o.o_custkey = w.o_custkey and o.paid_date > w.as_of_date and o.paid_date <= w.as_of_date + 60) as int) as churned
  from who w where as_of_date + 60 <= (select z from bounds)
)"""
_PREDICTIONS = f"""{_FEATURES}, pred as (
  select o_custkey, as_of_date, 1 / (1 + exp(-(recency_days / 100.0::double - orders_365d))) as score from feat
), bands as (select *, case when score >= 0.6 then 'high' when score >= 0.3 then 'medium' else 'low' end as risk_band from pred)"""
_SCORED = """rows as (select doc_id, quality, n_chars from labels join documents using (doc_id) where quality is not null), scored as (
  select doc_id, 'champion' as role, cast(quality as double) as y, fmod(round(n_chars / 100::double), 97) / 97 as p from rows
  union all select doc_id, 'challenger', quality, least(1.0::double, round(n_chars / 100::double) / 100) from rows
), ranked as (
  select *, rank() over (partition by role order by p) + (count(*) over (partition by role, p) - 1) / 2.0::double as r, sum(y) over (partition by role order by p desc) as hits, count(*) over (partition by role order by p desc) as seen,
    least(greatest(p, 1e-6), 1 - 1e-6) as q from scored
), met as (
  select role, count(*) as test_rows, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as roc_auc, sum(y * hits / seen) / sum(y) as pr_auc,
    avg(-(y * ln(q) + (1 - y) * ln(1 - q))) as log_loss, avg((p - y) * (p - y)) as brier, avg(y) as base_rate from ranked group by role
)"""
_SNAPSHOTS = """b as (select o_orderkey, o_orderstatus, round(o_totalprice, 2) as price from orders where o_orderkey % 10 <> 1), a as (
  select o_orderkey, case when o_orderkey % 10 = 3 then 'X' else o_orderstatus end as o_orderstatus, round(o_totalprice, 2) as price from orders where o_orderkey % 10 <> 2
), diff as (
  select a.*, 'insert' as change from a anti join b using (o_orderkey) union all select b.*, 'delete' from b anti join a using (o_orderkey)
  union all select b.*, 'update_preimage' from b join a using (o_orderkey) where b.o_orderstatus is distinct from a.o_orderstatus or b.price is distinct from a.price
  union all select a.*, 'update_postimage' from b join a using (o_orderkey) where b.o_orderstatus is distinct from a.o_orderstatus or b.price is distinct from a.price
)"""


def _psi() -> str:
    parts = []
    for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        parts.append(f"""select '{f}' as feature, round(sum((a - e) * ln(a / e)), 5) as psi from (
          select bin, greatest(sum(s) / (select count(*) from base), 1e-4) as e, greatest(sum(1 - s) / (select count(*) from now), 1e-4) as a from (
            select s, case when v is null then -1 else least(greatest(len(list_filter(edges, lambda x: x <= v)), 1), greatest(len(edges) - 1, 1)) end as bin
            from (select {f} as v, 1 as s from base union all select {f}, 0 from now), (select list_sort(list_distinct(quantile_cont({f}, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as edges from base)
          ) group by bin)""")
    return "with base as (select * from lineitem where year(l_shipdate) = 1996), now as (select * from lineitem where year(l_shipdate) = 2000), d as (" + " union all ".join(parts) + ") select feature, psi, case when psi > 0.25 then 'significant' when psi > 0.1 then 'moderate' else 'stable' end as status from d"


ORACLES: dict[str, str] = ticketing_sql.ORACLES | streams.ORACLES | operations.ORACLES | {
    "daily_sales": f"with {_DAILY} select * replace (cast(sales_date as varchar) as sales_date) from daily",
    "daily_sales_incremental": f"with {_DAILY} select * replace (cast(sales_date as varchar) as sales_date) from daily",
    "scd1_orders_state": f"""select user_id, arg_max(event_type, event_id) as last_type, max(event_id) as last_id, {_text("min(case when event_type = 'purchase' then ts end)")} as first_purchase,
      {_text("min(case when event_type = 'signup' then ts end)")} as first_signup, {_text("max(ts)")} as last_seen from events group by user_id""",
    "scd2_history": f"with {_versions('events')} select user_id, event_type, start_seq, end_seq, is_current, {_text('valid_from')} as valid_from from versions",
    "auto_cdc_history": "select user_id, event_type, event_id as start_at, nxt as end_at from (select *, lead(event_id) over (partition by user_id order by event_id) as nxt from events) where event_type <> 'error'",
    "most_versions": f"with {_versions('events')} select user_id, start_seq, event_type from versions where user_id = (select user_id from versions group by user_id order by count(*) desc, user_id limit 1)",
    "insert_new_only": "select event_id, user_id, event_type from events",
    "snapshot_replace": "select p_partkey, p_name, round(p_retailprice + 1, 2) as price from part where p_partkey % 3 <> 0",
    "expectations": f"with {_MARKS} select concat_ws(',', case when r1 then 'known_discount' end, case when r2 then 'ships_after_order' end) as failed, case when w1 then 'small_quantity' else '' end as warned, count(*) as n from m group by all",
    "valid_lines": f"with {_MARKS} select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount from m where not r1 and not r2 group by all",
    "inverted_rules": "select c_custkey, c_mktsegment from customer where not (c_acctbal >= 0) or c_mktsegment not in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')",
    "quality_measures": f"with {_MEASURES} select rule, action, failed_rows, total_rows from q where source_table = 'lineitem'",
    "quality_gate": f"""with {_MEASURES}, g as (select source_table, failed_rows as rejected_rows, total_rows, failed_rows / cast(total_rows as double) as rate, case when source_table = 'customer' then 0.9::double else 0.02::double end as "limit" from q where rule = '__quarantined__')
      select source_table, rejected_rows, total_rows, round(rate, 9) as rate, "limit" from g where rate > "limit" """,
    "failure_rates": f"with {_MEASURES} select source_table, rule, round(failed_rows / cast(total_rows as double), 9) as rate from q",
    "quarantine_by_rule": f"with {_MARKS} select 'lineitem' as source_table, rule, n from (select 'known_discount' as rule, count(*) as n from m where r1 union all select 'ships_after_order', count(*) from m where r2) where n > 0",
    "key_contract": "select l_orderkey, l_linenumber, count(*) as n, 'duplicate key' as problem from lineitem group by all having count(*) > 1",
    "check_constraints": """select "check", n from (select 'known_status' as "check", count(*) as n from orders where not o_orderstatus in ('O', 'F') union all select 'positive_price', count(*) from orders where not o_totalprice > 1000) where n > 0""",
    "latest_per_user": "select user_id, event_type, max(event_id) as event_id from events group by all",
    "pit_fact": f"with {_PIT} select event_id, user_id, tier, version from pit",
    "pit_tier_revenue": f"with {_PIT} select strftime(ts, '%Y-%m') as month, tier, cast(sum(cast(value as decimal(18,2))) as double) as revenue, count(*) as n from pit group by all",
    "event_performance": f"with {_PERFORMANCE} select p_partkey, tickets_sold, gross, refunded, net, sell_through, cast(first_sale as varchar) as first_sale, cast(last_sale as varchar) as last_sale from perf",
    "top_sell_through": f"with {_PERFORMANCE} select p_partkey, sell_through from perf where first_sale > (select min(first_sale) from perf) order by sell_through desc, p_partkey limit 20",
    "customer_360": f"with {_CUSTOMERS} select c_custkey, c_mktsegment, orders, refunded_orders, net, favourite, clicks, cast(date_diff('day', last_purchase, date '2001-12-31') as int) as days_since from cust",
    "favourite_type": f"with {_CUSTOMERS} select o_custkey, p_type from f",
    "quiet_customers": f"with {_CUSTOMERS} select c_custkey, net from cust where last_purchase < date '2001-01-01' order by net desc, c_custkey limit 25",
    "funnel": f"with {_FUNNEL} select *, round(purchased / nullif(viewed, 0)::double, 9) as view_to_purchase from fun",
    "conversion_by_device": f"with {_FUNNEL} select device, cast(sum(sessions) as bigint) as sessions, cast(sum(viewed) as bigint) as viewed, cast(sum(clicked) as bigint) as clicked, cast(sum(signed_up) as bigint) as signed_up, cast(sum(purchased) as bigint) as purchased, round(sum(purchased) / sum(sessions)::double, 9) as conversion from fun group by device",
    "engagement": "select cast(cast(ts as date) as varchar) as event_date, event_type, count(*) as events, count(distinct (user_id, cast(ts as date))) as sessions, count(distinct user_id) as customers from events group by all",
    "live_engagement": f"select {_text('w')} as window_start, event_type, count(*) as events from (select time_bucket(interval 5 minutes, ts) as w, event_type from events) where w + interval 5 minutes <= (select max(ts) - interval 30 minutes from events) group by w, event_type",
    "stream_dedup": "select event_id, event_type from events",
    "stream_insert_once": "select event_id, user_id, event_type from events",
    "rescue_fields": "select event_type, count(*) filter (json_extract(props, '$.k') is not null) as rescued, cast(0 as bigint) as nothing, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total from events group by all",
    "kafka_decode": "select 'kafka://events/' || (user_id % 3) || '/' || event_id as source_file, case when event_id % 50 <> 0 then cast(json_extract_string(props, '$.k') as bigint) end as k, case when event_id % 50 = 0 then 'not json' end as rescued from events",
    "file_load_once": "select event_id, user_id, event_type from events",
    "features_orders": f"with {_FEATURES} select * replace (cast(as_of_date as varchar) as as_of_date) from feat",
    "features_lines": f"""with {_WHO}, {_FACT} select w.o_custkey, cast(w.as_of_date as varchar) as as_of_date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as bigint)) as double) as avg_ticket_price_365d, cast(count(distinct p_type) as int) as genres_365d
      from who w join fact f on f.o_custkey = w.o_custkey and {_in("f.paid_date", 365)} group by w.o_custkey, w.as_of_date""",
    "churn_labels": f"with {_WHO}, {_LABELS} select o_custkey, cast(as_of_date as varchar) as as_of_date, churned from lab",
    "training_set": f"""with {_FEATURES}, {_LABELS}, j as (select * from feat join lab using (o_custkey, as_of_date)), d as (select as_of_date, row_number() over (order by as_of_date desc) as r, count(*) over () as n from (select distinct as_of_date from j))
      select cast(as_of_date as varchar) as as_of_date, case when r <= greatest(1, ceil(n * 0.2)) then 'test' else 'train' end as split, count(*) as n, cast(sum(churned) as bigint) as churned from j join d using (as_of_date) group by all""",
    "churned_history": f"""with {_FEATURES}, {_LABELS} select f.o_custkey, cast(f.as_of_date as varchar) as as_of_date, recency_days, churned from feat f left join lab l on f.o_custkey = l.o_custkey and f.as_of_date = l.as_of_date
      where f.o_custkey = (select o_custkey from lab group by o_custkey having sum(churned) > 1 order by o_custkey limit 1)""",
    "features_engagement": """with c as (select user_id, cast(ts as date) as d, event_type from events), dates as (select cast(unnest(generate_series(cast(min(d) as timestamp), cast(max(d) as timestamp), interval 7 days)) as date) as as_of_date from c), w as (select distinct user_id, as_of_date from c, dates where c.d > as_of_date - 30 and c.d <= as_of_date),
      s as (select w.user_id, w.as_of_date, count(case when c.d > w.as_of_date - 7 then 1 end) as a, count(c.d) as b, count(case when event_type = 'click' then 1 end) as k from w left join c on c.user_id = w.user_id and c.d > w.as_of_date - 30 and c.d <= w.as_of_date group by all)
      select user_id, cast(as_of_date as varchar) as as_of_date, cast(a as int) as events_7d, cast(b as int) as events_30d, cast(k as int) as cart_adds_30d, round(a / nullif(b, 0)::double, 9) as engagement_ratio from s""",
    "moving_average": f"with {_DAILY}, n as (select sales_date, sum(cast(net_revenue as decimal(18,2))) as net from daily group by all) select cast(sales_date as varchar) as sales_date, cast(net as double) as net, round(avg(cast(net as double)) over (order by sales_date rows between 6 preceding and current row), 2) as average from n",
    "psi_drift": _psi(),
    "eval_metrics": f"""with {_SCORED} select role, test_rows, round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc, round(log_loss, 6) as log_loss, round(brier, 6) as brier, round(base_rate, 6) as base_rate,
      round((select avg(y) from (select y, row_number() over (order by p desc, doc_id) as place, count(*) over () as n from scored s where s.role = met.role) where place <= greatest(1, ceil(n * 0.1))) / base_rate, 6) as top_decile_lift from met""",
    "compare_models": f"""with {_SCORED}, d as (select concat_ws('; ', case when not n.roc_auc >= 0.7 then 'roc_auc below floor' end, case when n.pr_auc - o.pr_auc < 0 then 'pr_auc gain too small' end,
      case when n.roc_auc - o.roc_auc < -0.01 then 'roc_auc worse than allowed' end, case when n.brier - o.brier > 0.005 then 'brier worse than allowed' end) as reasons from met n, met o where n.role = 'challenger' and o.role = 'champion')
      select reasons = '' as promote, reasons from d""",
    "batch_scoring": f"with {_PREDICTIONS} select o_custkey, cast(as_of_date as varchar) as as_of_date, round(score, 9) as score, risk_band from bands",
    "risk_bands": f"with {_PREDICTIONS} select risk_band, count(*) as n, round(avg(score), 6) as average from bands group by all",
    "run_log_shares": "select event_type as task, event_type as example, count(*) as runs, cast(sum(count(*)) over () as bigint) as all_runs, date_sub('minute', min(ts), max(ts)) as minutes from events group by event_type",
    "above_own_average": "select event_type, count(*) as n from events e where value > (select avg(value) from events u where u.user_id = e.user_id) group by event_type",
    "ingest_days": "select cast(cast(ts as date) as varchar) as day, count(*) as n, count(json_extract(props, '$.k')) as with_rescued, min('{\"k\":\"' || json_extract_string(props, '$.k') || '\"}') as example from events group by all",
    "feature_dates_replaced": f"with {_FEATURES} select o_custkey, cast(as_of_date as varchar) as as_of_date, orders_365d from feat",
    "feature_job_training": f"with {_FEATURES}, {_LABELS} select cast(as_of_date as varchar) as as_of_date, count(*) as n, cast(sum(orders_365d) as bigint) as orders, cast(sum(churned) as bigint) as churned from feat join lab using (o_custkey, as_of_date) group by as_of_date",
    "feature_job_scoring": f"""with {_WHO} select o_custkey, cast(z as varchar) as as_of_date, cast(date_diff('day', max(paid_date), z) as int) as recency_days, cast(count(*) filter (paid_date > z - 365) as int) as orders_365d,
      cast(count(*) filter (refunded_date > z - 365 and refunded_date <= z) as int) as refunds_365d from ord, bounds group by o_custkey, z having max(paid_date) > z - 365""",
    "crm_bookmarks": f"with {_SNAPSHOTS} select cast(0 as int) as run, count(*) as exported from b where price > 1000 union all select 1, count(*) from diff where change in ('insert', 'update_postimage') and price > 1000 union all select 2, 0",
    "snapshot_diff": f"with {_SNAPSHOTS} select * from diff",
    "snapshot_counts": f"with {_SNAPSHOTS} select 'before' as what, o_orderstatus, count(*) as n from b group by all union all select 'after', o_orderstatus, count(*) from a group by all union all select change, o_orderstatus, count(*) from diff group by all",
    "crm_export": f"with {_SNAPSHOTS} select o_orderkey, o_orderstatus, price from diff where change in ('insert', 'update_postimage') and price > 1000",
    "bookmark_upsert": "select c_custkey, case when c_custkey % 2 = 0 then 0 else round(c_acctbal, 2) end as balance from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0",
    "compaction": "select l_orderkey, l_partkey, l_linenumber, cast(l_quantity as bigint) as quantity, cast(cast(l_shipdate as date) as varchar) as shipped from lineitem",
    "replace_where": "select o_orderkey, cast(year(o_orderdate) as int) as year from orders where year(o_orderdate) <> 1997 or o_orderkey % 2 = 0",
    "masked_view": "select c_custkey, '***@example.com' as mail, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where lower(r_name) in ('europe', 'asia')",
    "active_keys": "select o_custkey as key from orders union select user_id from events",
    "run_log_report": "select event_type as task, count(*) as runs, count(*) filter (value > 90) as failures, cast(round(avg(cast(value as decimal(18,4))), 4) as double) as mean from events group by all",
}
