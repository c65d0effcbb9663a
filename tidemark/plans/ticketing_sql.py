"""DuckDB SQL for the queries of ``ticketing``, from the driver's tables alone."""

from __future__ import annotations

_TEXT = "'%Y-%m-%d %H:%M:%S'"
_LINES = """li as (
  select l_orderkey, l_linenumber, max(l_returnflag) as l_returnflag, cast(sum(cast(l_quantity as int)) as int) as n, cast(round(max(l_extendedprice), 2) as decimal(12,2)) as price, min(l_partkey) as l_partkey, max(l_shipdate) as l_shipdate from lineitem group by 1, 2
)"""
_ORDERS = f"""{_LINES}, back as (
  select l_orderkey, min(l_partkey) as event, max(l_shipdate) filter (l_returnflag = 'R') as back_at, sum(n * price) as amount, sum(n) as tickets from li group by 1
), ords as (
  select o.*, cast(o_orderkey as varchar) as order_id, cast(o_custkey as varchar) as customer_id, cast(event as varchar) as event_id, cast(o_orderdate as date) as order_date, amount, tickets,
    case when o_orderstatus <> 'P' then o_orderdate + interval 1 hour end as paid_at, case when o_orderstatus <> 'P' and back_at > o_orderdate + interval 1 hour then back_at end as refunded_at from orders o join back on l_orderkey = o_orderkey
)"""
_CUSTOMERS = """cust as (
  select *, date '1998-01-01' + cast(c_custkey % 100 as int) as day, c_custkey % 7 = 0 as same, c_custkey % 50 = 3 as gone from customer
), vers as (
  select c_custkey, 'standard' as loyalty_tier, 1 as version, timestamp '1990-01-01' as valid_from, case when not same then cast(day as timestamp) when gone then timestamp '2001-06-15' end as valid_to, c_name, c_nationkey, c_acctbal from cust
  union all select c_custkey, lower(c_mktsegment), 2, cast(day as timestamp), case when gone then timestamp '2001-06-15' end, c_name, c_nationkey, c_acctbal from cust where not same
)"""
_EVENTS = """ev as (
  select cast(p_partkey as varchar) as event_id, p_name as artist, p_type as genre, '2001-12-31' as event_date, p_brand as venue_id, lower(p_brand) as venue_name, 'Rome' as city, 'IT' as country,
    max(p_size) over (partition by p_brand) as capacity, cast(round(p_retailprice, 2) as double) as base_price from part
)"""
_CLICKS = """clicks as (
  select cast(event_id as varchar) as event_id, user_id || '/' || cast(cast(ts - interval 273 months as date) as varchar) as session_id, case when user_id % 10 <> 9 then cast(user_id as varchar) end as customer_id,
    case event_type when 'view' then 'view_event' when 'click' then 'add_to_cart' when 'signup' then 'checkout' when 'purchase' then 'purchase' else 'page_view' end as event_type,
    ['web', 'ios', 'android'][user_id % 3 + 1] as device, ts - interval 273 months as event_ts, cast(ts - interval 273 months as date) as event_date from events
)"""
_SALES = f"""{_ORDERS}, {_CUSTOMERS}, {_EVENTS}, sales as (
  select order_id, l_linenumber as line_no, customer_id, event_id, n as quantity, price as unit_price, cast(n * price as decimal(12,2)) as gross, refunded_at is not null as is_back, order_date, paid_at, cast(paid_at as date) as paid_date, refunded_at, cast(refunded_at as date) as refunded_date,
    version, loyalty_tier, c_nationkey
  from ords join li l on l.l_orderkey = o_orderkey left join vers v on v.c_custkey = o_custkey and v.valid_from <= paid_at and (v.valid_to is null or v.valid_to > paid_at) where paid_at is not null
)"""
_DAILY = f"""{_SALES}, signed as (
  select paid_date as d, 1 as sign, event_id, order_id, quantity as tickets, gross as amount from sales union all select refunded_date, -1, event_id, order_id, 0, -gross from sales where is_back
), daily as (
  select cast(d as varchar) as sales_date, venue_id, genre, count(distinct case when sign > 0 then order_id end) as paid_orders, cast(sum(tickets) as bigint) as tickets_sold, cast(sum(greatest(amount, 0)) as double) as gross_revenue,
    count(distinct case when sign < 0 then order_id end) as refunded_orders, cast(-sum(least(amount, 0)) as double) as refunded_amount, cast(sum(amount) as double) as net_revenue from signed join ev using (event_id) group by all
)"""
_FUNNEL = f"""{_CLICKS}, s as (
  select session_id, min(event_ts) as began, min(device) as device, max(cast(event_type = 'view_event' as int)) as a, max(cast(event_type = 'add_to_cart' as int)) as b, max(cast(event_type = 'checkout' as int)) as c, max(cast(event_type = 'purchase' as int)) as d from clicks group by 1
), fun as (
  select cast(cast(began as date) as varchar) as session_date, device, count(*) as sessions, cast(sum(a) as bigint) as viewed_sessions, cast(sum(b) as bigint) as cart_sessions, cast(sum(c) as bigint) as checkout_sessions, cast(sum(d) as bigint) as purchase_sessions,
    round(sum(d) / nullif(sum(a), 0)::double, 9) as view_to_purchase_rate from s group by 1, 2
)"""
_DATES = f"""{_SALES}, paid as (select *, cast(paid_at as date) as paid_day, cast(refunded_at as date) as back_day from ords where paid_at is not null), dates as (
  select cast(unnest(generate_series(cast(a + 90 as timestamp), cast(z - 60 as timestamp), interval 14 days)) as date) as as_of_date from (select min(paid_day) as a, max(paid_day) as z from paid)
), who as (
  select a.customer_id, as_of_date, loyalty_tier, cast(c_nationkey as varchar) as country, c_acctbal > 0 as marketing_opt_in
  from (select distinct customer_id, o_custkey, as_of_date from paid, dates where paid_day > as_of_date - 365 and paid_day <= as_of_date) a
  join vers v on v.c_custkey = a.o_custkey and v.valid_from <= as_of_date + 1 and (v.valid_to is null or v.valid_to > as_of_date + 1)
)"""


def _in(day: str, n: int) -> str:
    return f"({day} > w.as_of_date - {n} and {day} <= w.as_of_date)"


_FEATURES = f"""{_DATES}, {_CLICKS}, o as (
  select w.customer_id, w.as_of_date, cast(date_diff('day', max(paid_day), w.as_of_date) as int) as recency_days,
    {", ".join(f"cast(count(*) filter ({_in('paid_day', n)}) as int) as orders_{n}d" for n in (30, 90, 365))}, {", ".join(f"cast(coalesce(sum(amount) filter ({_in('paid_day', n)}), 0) as double) as revenue_{n}d" for n in (90, 365))},
    cast(count(*) filter ({_in('back_day', 365)}) as int) as refunds_365d from who w join paid p on p.customer_id = w.customer_id and paid_day <= w.as_of_date group by 1, 2
), l as (
  select w.customer_id, w.as_of_date, round(cast(sum(gross) as double) / sum(quantity), 9) as avg_ticket_price_365d, cast(count(distinct genre) as int) as genres_365d
  from who w join (select * from sales join ev using (event_id)) s on s.customer_id = w.customer_id and {_in('paid_date', 365)} group by 1, 2
), c as (
  select w.customer_id, w.as_of_date, cast(count(*) filter (k.event_date > w.as_of_date - 7) as int) as events_7d, cast(count(k.event_id) as int) as events_30d, cast(count(*) filter (k.event_type = 'add_to_cart') as int) as cart_adds_30d
  from who w left join clicks k on k.customer_id = w.customer_id and {_in('k.event_date', 30)} group by 1, 2
), feat as (
  select customer_id, cast(as_of_date as varchar) as as_of_date, recency_days, orders_30d, orders_90d, orders_365d, revenue_90d, revenue_365d, refunds_365d, avg_ticket_price_365d, genres_365d, events_7d, events_30d, cart_adds_30d,
    round(events_7d / nullif(events_30d, 0)::double, 9) as engagement_ratio, cast(date_diff('day', date '1992-02-01', as_of_date) as int) as tenure_days, loyalty_tier, marketing_opt_in, country
  from who join o using (customer_id, as_of_date) join l using (customer_id, as_of_date) join c using (customer_id, as_of_date)
)"""

ORACLES: dict[str, str] = {
    "clean_orders": f"""with {_ORDERS} select order_id, customer_id, event_id, cast(order_date as varchar) as order_date, case when refunded_at is not null then 'REFUNDED' when paid_at is not null then 'PAID' else 'PLACED' end as status, 'web' as channel, 'EUR' as currency,
      cast(amount as double) as order_amount, cast(tickets as int) as ticket_count, strftime(paid_at, {_TEXT}) as paid_at, strftime(refunded_at, {_TEXT}) as refunded_at, strftime(coalesce(refunded_at, paid_at, o_orderdate), {_TEXT}) as updated_at from ords""",
    "clean_order_lines": f"""with {_LINES} select cast(l_orderkey as varchar) as order_id, l_linenumber as line_no, l_returnflag as ticket_type, n as quantity, cast(price as double) as unit_price, cast(n * price as double) as line_amount from li""",
    "clean_customers": f"""with {_CUSTOMERS} select cast(c_custkey as varchar) as customer_id, c_name || '@example.com' as email, c_name as full_name, cast(c_nationkey as varchar) as country, loyalty_tier, c_acctbal > 0 as marketing_opt_in, '1992-02-01' as signup_date,
      strftime(valid_from, {_TEXT}) as valid_from, strftime(valid_to, {_TEXT}) as valid_to, valid_to is null as is_current from vers""",
    "clean_clicks": f"with {_CLICKS} select * replace (strftime(event_ts, {_TEXT}) as event_ts, cast(event_date as varchar) as event_date) from clicks",
    "dim_events": f"with {_EVENTS} select * from ev",
    "fct_sales": f"""with {_SALES} select order_id, line_no, customer_id, event_id, quantity, cast(unit_price as double) as unit_price, cast(gross as double) as gross_amount, cast(case when is_back then gross else 0 end as double) as refunded_amount, cast(order_date as varchar) as order_date,
      strftime(paid_at, {_TEXT}) as paid_at, cast(paid_date as varchar) as paid_date, strftime(refunded_at, {_TEXT}) as refunded_at, cast(refunded_date as varchar) as refunded_date, cast(version as bigint) as version from sales""",
    "fact_keys": f"with {_SALES} select count(*) as n from (select order_id, line_no from sales group by all having count(*) > 1)",
    "sales_by_tier": f"with {_SALES} select loyalty_tier, cast(c_nationkey as varchar) as country, cast(sum(case when is_back then 0 else gross end) as double) as net, count(*) as n from sales where version is not null group by all",
    "agg_daily_sales": f"with {_DAILY} select * from daily",
    "agg_daily_sales_incremental": f"with {_DAILY} select * from daily",
    "performance_of_events": f"""with {_SALES}, s as (select event_id, sum(quantity) filter (not is_back) as sold, sum(gross) as gross, sum(gross) filter (is_back) as back, min(paid_at) as first_at, max(paid_at) as last_at from sales group by 1)
      select event_id, artist, genre, event_date, venue_id, capacity, cast(coalesce(sold, 0) as bigint) as tickets_sold, cast(coalesce(gross, 0) as double) as gross_revenue, cast(coalesce(back, 0) as double) as refunded_amount, cast(coalesce(gross, 0) - coalesce(back, 0) as double) as net_revenue,
      round(case when capacity > 0 then coalesce(sold, 0) / capacity::double end, 9) as sell_through, strftime(first_at, {_TEXT}) as first_sale_at, strftime(last_at, {_TEXT}) as last_sale_at from ev left join s using (event_id)""",
    "customers_360": f"""with {_SALES}, {_CLICKS}, day as (select max(event_date) as d from clicks), own as (select sales.*, genre from sales join ev using (event_id), day where paid_date <= d), b as (
        select customer_id, min(paid_at) as first_at, max(paid_at) as last_at, count(distinct order_id) as n, count(distinct order_id) filter (is_back) as back, sum(case when is_back then 0 else gross end) as net from own group by 1
      ), g as (select customer_id, genre from (select customer_id, genre, row_number() over (partition by customer_id order by sum(quantity) desc, genre) as p from own where genre is not null group by 1, 2) where p = 1), k as (
        select customer_id, count(*) filter (event_date > d - 30 and event_date <= d) as e, max(event_ts) as seen from clicks, day where customer_id is not null group by 1
      ) select cast(v.c_custkey as varchar) as customer_id, c_name || '@example.com' as email, c_name as full_name, cast(c_nationkey as varchar) as country, cast(null as varchar) as city, loyalty_tier, c_acctbal > 0 as marketing_opt_in, '1992-02-01' as signup_date,
        strftime(first_at, {_TEXT}) as first_purchase_at, strftime(last_at, {_TEXT}) as last_purchase_at, coalesce(n, 0) as lifetime_orders, coalesce(back, 0) as refunded_orders, cast(coalesce(net, 0) as double) as lifetime_net_revenue, genre as favorite_genre, coalesce(e, 0) as events_30d,
        strftime(seen, {_TEXT}) as last_seen_at, cast(date_diff('day', cast(last_at as date), d) as int) as days_since_last_purchase, cast(d as varchar) as as_of_date
      from vers v left join b on b.customer_id = cast(v.c_custkey as varchar) left join g on g.customer_id = cast(v.c_custkey as varchar) left join k on k.customer_id = cast(v.c_custkey as varchar), day where v.valid_to is null""",
    "funnel_of_days": f"with {_FUNNEL} select * from fun",
    "funnel_incremental": f"with {_FUNNEL} select * from fun",
    "engagement_of_days": f"with {_CLICKS} select cast(event_date as varchar) as event_date, event_type, count(*) as events, count(distinct session_id) as sessions, count(distinct customer_id) as customers from clicks group by all",
    "live_sessions": f"""with {_CLICKS}, b as (select *, time_bucket(interval 5 minutes, event_ts) as w from clicks) select strftime(w, {_TEXT}) as window_start, event_type, count(*) as events, count(distinct session_id) as exact, true as close
      from b where w + interval 5 minutes <= (select max(event_ts) - interval 30 minutes from clicks) group by w, event_type""",
    "feature_population": f"with {_DATES} select customer_id, cast(as_of_date as varchar) as as_of_date, loyalty_tier, country from who",
    "customer_features": f"with {_FEATURES} select * from feat",
    "reference_snapshots": """select cast(p_partkey as varchar) as event_id, p_name as artist, p_type as genre, '2001-12-31' as event_date, p_brand as venue_id, cast(round(p_retailprice, 2) + 1 as double) as base_price, '2001-01-08' as _snapshot_date,
      (select count(*) + count(*) filter (p_partkey % 4 <> 0) from part) as raw_rows from part where p_partkey % 4 <> 0""",
}
