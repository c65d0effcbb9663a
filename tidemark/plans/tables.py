"""The ticketing data model: sources, table contracts and rules."""

from __future__ import annotations

from tidemark.operators.contracts import Contract
from tidemark.operators.quality import Rule

#: The fields of each raw source.
SOURCES = {
    "orders": "order_id customer_id event_id order_ts status updated_at channel currency promo_code items source_system".split(),
    "customers_cdc": "lsn op changed_at customer_id email full_name country city loyalty_tier marketing_opt_in signup_date".split(),
    "clickstream": "event_id session_id customer_id event_type event_ref device event_ts properties".split(),
    "events": "event_id artist genre event_date venue_id base_price".split(),
    "venues": "venue_id venue_name city country capacity".split(),
}
_INGESTED = {"_rescued_data": "string", "_source_file": "string", "_file_modified_at": "timestamp", "_ingested_at": "timestamp"}
ITEMS = "array<struct<line_no:int,ticket_type:string,quantity:int,unit_price:decimal(10,2)>>"
TRACKED = ["email", "full_name", "country", "city", "loyalty_tier", "marketing_opt_in", "signup_date"]


#: Every table's columns and types in order, keys, layout columns and checks.
CONTRACTS = {
    c.name: c
    for c in (
        *(Contract(f"bronze.{s}_raw", {n: "string" for n in names} | _INGESTED) for s, names in SOURCES.items()),
        Contract(
            "silver.orders",
            {
                "order_id": "string", "customer_id": "string", "event_id": "string", "order_ts": "timestamp", "order_date": "date", "status": "string",
                "channel": "string", "currency": "string", "promo_code": "string", "order_amount": "decimal(12,2)", "ticket_count": "int", "paid_at": "timestamp",
                "cancelled_at": "timestamp", "refunded_at": "timestamp", "updated_at": "timestamp", "_first_ingested_at": "timestamp",
                "_last_ingested_at": "timestamp",
            },
            keys=("order_id",), cluster=("order_date",), checks={"valid_status": "status IN ('PLACED','PAID','CANCELLED','REFUNDED')"},
        ),
        Contract(
            "silver.order_items",
            {
                "order_id": "string", "line_no": "int", "ticket_type": "string", "quantity": "int", "unit_price": "decimal(10,2)", "line_amount": "decimal(12,2)",
            },
            keys=("order_id", "line_no"), checks={"positive_quantity": "quantity > 0"},
        ),
        Contract(
            "silver.customers",
            {
                "customer_sk": "string", "customer_id": "string", "email": "string", "full_name": "string", "country": "string", "city": "string",
                "loyalty_tier": "string", "marketing_opt_in": "boolean", "signup_date": "date", "valid_from": "timestamp", "valid_to": "timestamp",
                "is_current": "boolean", "_start_seq": "bigint", "_end_seq": "bigint", "_row_hash": "string",
            },
            keys=("customer_sk",), cluster=("customer_id",),
        ),
        Contract(
            "silver.clickstream",
            {
                "event_id": "string", "session_id": "string", "customer_id": "string", "event_type": "string", "event_ref": "string", "device": "string",
                "event_ts": "timestamp", "event_date": "date", "properties": "string", "_ingested_at": "timestamp",
            },
            keys=("event_id",), cluster=("event_date",),
        ),
        Contract(
            "silver.events",
            {
                "event_id": "string", "artist": "string", "genre": "string", "event_date": "date", "venue_id": "string", "base_price": "decimal(10,2)",
                "_snapshot_date": "date",
            },
            keys=("event_id",),
        ),
        Contract(
            "silver.venues",
            {
                "venue_id": "string", "venue_name": "string", "city": "string", "country": "string", "capacity": "int", "_snapshot_date": "date",
            },
            keys=("venue_id",),
        ),
        Contract(
            "gold.dim_customer",
            {
                "customer_sk": "string", "customer_id": "string", "email": "string", "full_name": "string", "country": "string", "city": "string",
                "loyalty_tier": "string", "marketing_opt_in": "boolean", "signup_date": "date", "valid_from": "timestamp", "valid_to": "timestamp",
                "is_current": "boolean",
            },
            keys=("customer_sk",),
        ),
        Contract(
            "gold.dim_event",
            {
                "event_id": "string", "artist": "string", "genre": "string", "event_date": "date", "venue_id": "string", "venue_name": "string", "city": "string",
                "country": "string", "capacity": "int", "base_price": "decimal(10,2)",
            },
            keys=("event_id",),
        ),
        Contract(
            "gold.fct_sales",
            {
                "order_id": "string", "line_no": "int", "customer_id": "string", "customer_sk": "string", "event_id": "string", "channel": "string",
                "ticket_type": "string", "quantity": "int", "unit_price": "decimal(10,2)", "gross_amount": "decimal(12,2)", "refunded_amount": "decimal(12,2)",
                "order_date": "date", "paid_at": "timestamp", "paid_date": "date", "refunded_at": "timestamp", "refunded_date": "date",
            },
            keys=("order_id", "line_no"), cluster=("paid_date",),
        ),
        Contract(
            "gold.agg_daily_sales",
            {
                "sales_date": "date", "venue_id": "string", "genre": "string", "paid_orders": "bigint", "tickets_sold": "bigint", "gross_revenue": "decimal(18,2)",
                "refunded_orders": "bigint", "refunded_amount": "decimal(18,2)", "net_revenue": "decimal(18,2)",
            },
            cluster=("sales_date",),
        ),
        Contract(
            "gold.event_performance",
            {
                "event_id": "string", "artist": "string", "genre": "string", "event_date": "date", "venue_id": "string", "capacity": "int", "tickets_sold": "bigint",
                "gross_revenue": "decimal(18,2)", "refunded_amount": "decimal(18,2)", "net_revenue": "decimal(18,2)", "sell_through": "double",
                "first_sale_at": "timestamp", "last_sale_at": "timestamp",
            },
            keys=("event_id",),
        ),
        Contract(
            "gold.customer_360",
            {
                "customer_id": "string", "email": "string", "full_name": "string", "country": "string", "city": "string", "loyalty_tier": "string",
                "marketing_opt_in": "boolean", "signup_date": "date", "first_purchase_at": "timestamp", "last_purchase_at": "timestamp", "lifetime_orders": "bigint",
                "refunded_orders": "bigint", "lifetime_net_revenue": "decimal(18,2)", "favorite_genre": "string", "events_30d": "bigint",
                "last_seen_at": "timestamp", "days_since_last_purchase": "int", "as_of_date": "date",
            },
            keys=("customer_id",),
        ),
        Contract(
            "gold.funnel_daily",
            {
                "session_date": "date", "device": "string", "sessions": "bigint", "viewed_sessions": "bigint", "cart_sessions": "bigint",
                "checkout_sessions": "bigint", "purchase_sessions": "bigint", "view_to_purchase_rate": "double",
            },
            cluster=("session_date",),
        ),
        Contract(
            "gold.live_engagement",
            {
                "window_start": "timestamp", "window_end": "timestamp", "event_type": "string", "events": "bigint", "sessions": "bigint",
            },
        ),
        Contract(
            "ml.customer_features",
            {
                "customer_id": "string", "as_of_date": "date", "recency_days": "int", "orders_30d": "int", "orders_90d": "int", "orders_365d": "int",
                "revenue_90d": "decimal(12,2)", "revenue_365d": "decimal(12,2)", "refunds_365d": "int", "avg_ticket_price_365d": "double", "genres_365d": "int",
                "events_7d": "int", "events_30d": "int", "cart_adds_30d": "int", "engagement_ratio": "double", "tenure_days": "int", "loyalty_tier": "string",
                "marketing_opt_in": "boolean", "country": "string",
            },
            keys=("customer_id", "as_of_date"), cluster=("as_of_date",),
        ),
        Contract(
            "ml.churn_labels",
            {
                "customer_id": "string", "as_of_date": "date", "churned": "int",
            },
            keys=("customer_id", "as_of_date"),
        ),
        Contract(
            "ml.churn_training_set",
            {
                "customer_id": "string", "as_of_date": "date", "recency_days": "int", "orders_30d": "int", "orders_90d": "int", "orders_365d": "int",
                "revenue_90d": "decimal(12,2)", "revenue_365d": "decimal(12,2)", "refunds_365d": "int", "avg_ticket_price_365d": "double", "genres_365d": "int",
                "events_7d": "int", "events_30d": "int", "cart_adds_30d": "int", "engagement_ratio": "double", "tenure_days": "int", "loyalty_tier": "string",
                "marketing_opt_in": "boolean", "country": "string", "churned": "int", "split": "string",
            },
            keys=("customer_id", "as_of_date"),
        ),
        Contract(
            "ml.model_evaluations",
            {
                "run_id": "string", "model_name": "string", "model_version": "string", "role": "string", "test_rows": "bigint", "roc_auc": "double",
                "pr_auc": "double", "log_loss": "double", "brier": "double", "top_decile_lift": "double", "promote": "boolean", "reasons": "array<string>",
                "evaluated_at": "timestamp",
            },
        ),
        Contract(
            "ml.churn_predictions",
            {
                "customer_id": "string", "as_of_date": "date", "churn_probability": "double", "risk_band": "string", "model_name": "string",
                "model_version": "string", "scored_at": "timestamp",
            },
            keys=("customer_id", "as_of_date"),
        ),
        Contract(
            "ml.feature_drift",
            {
                "as_of_date": "date", "feature": "string", "psi": "double", "status": "string", "computed_at": "timestamp",
            },
        ),
        Contract(
            "ops.quarantine",
            {
                "source_table": "string", "record_key": "string", "failed_rules": "array<string>", "payload": "string", "source_file": "string", "run_id": "string",
                "quarantined_at": "timestamp",
            },
        ),
        Contract(
            "ops.quality_metrics",
            {
                "run_id": "string", "source_table": "string", "rule": "string", "action": "string", "failed_rows": "bigint", "total_rows": "bigint",
                "measured_at": "timestamp",
            },
        ),
        Contract(
            "ops.task_runs",
            {
                "run_id": "string", "task": "string", "status": "string", "started_at": "timestamp", "finished_at": "timestamp",
            },
        ),
        Contract(
            "ops.export_bookmarks",
            {
                "export_name": "string", "table_name": "string", "last_version": "bigint", "updated_at": "timestamp",
            },
            keys=("export_name",),
        ),
    )
}


def _present(column: str) -> str:
    return f"{column} IS NOT NULL AND {column} <> ''"


#: The rules of each source, in order.
RULES = {
    "orders": [
        Rule("order_id_present", _present("order_id")), Rule("customer_id_present", _present("customer_id")), Rule("event_id_present", _present("event_id")),
        Rule("valid_order_ts", "order_ts IS NOT NULL"), Rule("valid_updated_at", "updated_at IS NOT NULL"), Rule("known_status", "status IN ('PLACED', 'PAID', 'CANCELLED', 'REFUNDED')"),
        Rule("has_items", "items IS NOT NULL AND size(items) > 0"), Rule("valid_items", "forall(items, i -> i.line_no IS NOT NULL AND i.quantity > 0 AND i.unit_price >= 0)"),
        Rule("known_channel", "channel IN ('web', 'app', 'partner', 'box_office')", "warn"),
    ],
    "customers_cdc": [
        Rule("customer_id_present", _present("customer_id")), Rule("valid_lsn", "lsn IS NOT NULL"), Rule("known_op", "op IN ('INSERT', 'UPDATE', 'DELETE')"),
        Rule("valid_changed_at", "changed_at IS NOT NULL"), Rule("email_format", "op = 'DELETE' OR instr(email, '@') > 1", "warn"),
    ],
    "clickstream": [
        Rule("event_id_present", _present("event_id")), Rule("session_present", _present("session_id")), Rule("valid_event_ts", "event_ts IS NOT NULL"),
        Rule("known_event_type", "event_type IN ('page_view', 'search', 'view_event', 'add_to_cart', 'checkout', 'purchase')"), Rule("known_device", "device IN ('web', 'ios', 'android')", "warn"),
    ],
    "events": [Rule("event_id_present", _present("event_id")), Rule("venue_id_present", _present("venue_id")), Rule("valid_event_date", "event_date IS NOT NULL"), Rule("valid_base_price", "base_price IS NOT NULL AND base_price >= 0")],
    "venues": [Rule("venue_id_present", _present("venue_id")), Rule("valid_capacity", "capacity IS NOT NULL AND capacity > 0")],
}
#: The share of rejected rows that stops a run.
LIMITS = {"orders": 0.02, "customers_cdc": 0.01, "clickstream": 0.02, "events": 0.0, "venues": 0.0}
