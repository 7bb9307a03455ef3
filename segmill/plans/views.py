"""The two clickstream views over ``events`` and ``part``, one text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmill.session import pin_utc

# `props` is {"k": n}; reading n is the only engine-specific piece.
SPARK_KEY = "cast(get_json_object(e.props, '$.k') as bigint)"
DUCKDB_KEY = "cast(regexp_extract(e.props, '([0-9]+)', 1) as bigint)"

# `click` plays the role of `cart`, and a session is one user-day.
CLICKSTREAM = """
select e.event_id, e.ts as event_time,
  case when e.event_type = 'click' then 'cart' else e.event_type end as event_type,
  p.p_partkey as product_id, lower(p.p_brand) as brand, e.value as price, e.user_id,
  concat(cast(e.user_id as varchar(20)), '-', cast(cast(e.ts as date) as varchar(10))) as user_session,
  lower(p.p_type) as category_code_1
from {events} e join {part} p on p.p_partkey = {key}
"""

# Adds padding, upper case, blanks, `nan`, nulls, paths of 1 to 5 levels with an
# empty segment, and every 50th event once more with another price; for every
# 100th the first copy has no price.
DIRTY_CLICKSTREAM = """
with b as (
  select e.event_id, e.event_id as ordinal, e.ts as event_time, e.event_type, e.user_id,
    e.value as price, p.p_partkey as product_id, p.p_brand, p.p_type, p.p_name,
    concat(cast(e.user_id as varchar(20)), '-', cast(cast(e.ts as date) as varchar(10))) as sess
  from {events} e join {part} p on p.p_partkey = {key}),
d as (
  select * from b
  union all
  select event_id, ordinal + 1000000000 as ordinal, event_time, event_type, user_id,
    price + 1 as price, product_id, p_brand, p_type, p_name, sess
  from b where event_id % 50 = 0)
select ordinal, event_time, event_type, product_id, event_id * 7 as category_id,
  case when event_id % 13 = 0 then null
       when event_id % 11 = 0 then concat(p_type, '..', p_name)
       when event_id % 7 = 0 then p_type
       when event_id % 5 = 0 then concat(p_type, '.', replace(p_name, ' ', '.'), '.x.y')
       else concat(' ', p_type, '.', replace(p_name, ' ', '.'), ' ') end as category_code,
  case when event_id % 17 = 0 then null when event_id % 19 = 0 then ''
       when event_id % 23 = 0 then 'NaN' else concat('  ', p_brand, ' ') end as brand,
  case when ordinal < 1000000000 and (event_id % 97 = 0 or event_id % 100 = 0) then null else price end as price,
  user_id,
  case when event_id % 101 = 0 then null else sess end as user_session
from d
"""


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    pin_utc(spark)
    return spark.sql(
        text.format(events="{events}", part="{part}", key=SPARK_KEY),
        events=spark.read.parquet(f"{sf_dir}/events.parquet"),
        part=spark.read.parquet(f"{sf_dir}/part.parquet"),
    )


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CLICKSTREAM)


def dirty_clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, DIRTY_CLICKSTREAM)


def oracle_clickstream() -> str:
    return CLICKSTREAM.format(events="events", part="part", key=DUCKDB_KEY)


def oracle_dirty_clickstream() -> str:
    return DIRTY_CLICKSTREAM.format(events="events", part="part", key=DUCKDB_KEY)
