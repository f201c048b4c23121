"""Adapter from a flat ``events`` table to the nested event shape.

The flat table has ``event_id, ts, user_id, event_type, value, props`` with
``props`` holding one integer ``k``. The mapping is a fixture rule: it gives a
user-day unit, two landing pages, sessions, traffic parameters and a few
crossovers, so that every operator has something to work on. Needs a UTC
session, as ``ts`` has no time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

FLAT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
SITE = "https://shop.example.com"

EVENT_NAME = """
CASE event_type
  WHEN 'view' THEN 'page_view'
  WHEN 'purchase' THEN 'purchase'
  WHEN 'signup' THEN 'add_to_cart'
  WHEN 'click' THEN element_at(array('click', 'scroll', 'view_item'), k % 3 + 1)
  WHEN 'error' THEN element_at(array('session_start', 'first_visit'), k % 2 + 1)
END"""

# Key: (value field, value, condition under which the key is present).
PARAMS = {
    "page_location": (
        "string_value",
        f"""CASE
          WHEN k < 80 THEN concat('{SITE}/landing-v', user_id % 2 + 1)
          WHEN k < 85 THEN concat('{SITE}/landing-v', 2 - user_id % 2)
          WHEN k < 90 THEN concat('{SITE}/home?variant=', if(k % 2 = 0, 'A', 'B'))
          ELSE concat('{SITE}/product/', k)
        END""",
        "k < 95",
    ),
    "ga_session_id": ("int_value", "hour(ts) div 6", "k % 25 <> 13"),
    "experiment_id": ("string_value", "'exp_1'", "k % 10 = 7"),
    "source": (
        "string_value",
        "element_at(array('google', 'bing', 'facebook', 'partner'), int(user_id % 5) + 1)",
        "k % 2 = 0 AND user_id % 5 < 4",
    ),
    "medium": (
        "string_value",
        "element_at(array('cpc', 'organic', 'paid_social', 'email', 'referral', 'affiliate'), "
        "int(user_id % 7) + 1)",
        "k % 2 = 0 AND user_id % 7 < 6",
    ),
}


def _entry(key: str, field: str, value: str, present: str) -> str:
    """A one-element array with the key's entry, or an empty array."""
    text = value if field == "string_value" else "CAST(NULL AS STRING)"
    number = f"CAST({value} AS BIGINT)" if field == "int_value" else "CAST(NULL AS BIGINT)"
    entry = (
        f"named_struct('key', '{key}', 'value', "
        f"named_struct('string_value', {text}, 'int_value', {number}))"
    )
    return f"if({present}, array({entry}), array())"


def read_flat_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLAT_SCHEMA).parquet(path)


def nest_events(
    flat: DataFrame, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """Map flat events to the nested shape. The dates (``YYYYMMDD``) become a
    filter on ``ts`` itself, so that they reach the file scan."""
    if start_date is not None:
        first = datetime.strptime(start_date, "%Y%m%d")
        flat = flat.where(f"ts >= timestamp_ntz '{first}'")
    if end_date is not None:
        end = datetime.strptime(end_date, "%Y%m%d") + timedelta(days=1)
        flat = flat.where(f"ts < timestamp_ntz '{end}'")

    params = ", ".join(_entry(key, *rule) for key, rule in PARAMS.items())
    return flat.selectExpr(
        "ts",
        "user_id",
        "event_type",
        "date_format(ts, 'yyyyMMdd') AS event_date",
        r"CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k",
    ).selectExpr(
        "event_date",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS event_timestamp",
        f"{EVENT_NAME} AS event_name",
        "concat(user_id, '.', event_date) AS user_pseudo_id",
        f"concat({params}) AS event_params",
    )
