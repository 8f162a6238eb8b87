"""Column names, schemas and fixed lists of the event log."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "id"
NAME = "event_name"
TS = "event_timestamp"
TIE = "event_id"

# Time order inside a journey. Equal timestamps are settled by the event id, and
# by the name for logs that carry no event id.
ORDER = (TS, TIE, NAME)

RAW_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("ed_id", T.IntegerType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("event_timestamp", T.StringType()),
        T.StructField("journey_steps_until_end", T.IntegerType()),
        T.StructField("sep", T.StringType()),
    ]
)

EVENT_DEFINITION_SCHEMA = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("journey_id", T.IntegerType()),
        T.StructField("event_definition_id", T.IntegerType()),
        T.StructField("milestone_number", T.IntegerType()),
        T.StructField("stage", T.StringType()),
    ]
)

# The target event, the inactivity rule, the down-sampling ratio
# and the events that get their own count and last-event columns.
TARGET_EVENT = "order_shipped"
INACTIVITY_DAYS = 60
FAILURES_PER_SUCCESS = 19
FEATURE_EVENTS = (
    "browse_products",
    "view_cart",
    "add_to_cart",
    "begin_checkout",
    "place_order_web",
    "place_order_phone",
    "place_downpayment",
    "application_web_view",
    "application_web_submit",
    "application_web_approved",
    "promotion_created",
    "campaignemail_clicked",
    "campaign_click",
)

# Columns that reveal the outcome and must not reach a model, for
# snapshot features and for the baseline features.
LEAKY_COLUMNS = (
    "first_action_ts",
    "last_action_ts",
    "n_order_shipped",
    "n_place_order_web",
    "n_place_order_phone",
    "n_place_downpayment",
    "n_account_downpaymentreceived",
    "n_account_downpaymentcleared",
    "n_customer_requested_catalog_(digital)",
)
LEAKY_BASELINE_COLUMNS = (
    "n_order_shipped",
    "n_place_order_web",
    "n_place_order_phone",
    "n_place_downpayment",
    "n_account_downpaymentreceived",
    "n_account_downpaymentcleared",
    "n_customer_requested_catalog_(digital)",
    "last_is_place_order_web",
    "last_is_place_order_phone",
    "last_is_place_downpayment",
)
LEAKY_STEP_COLUMN = "max_journey_steps_until_end"

OUTCOMES = ("success", "failure", "incomplete")
