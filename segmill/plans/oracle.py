"""The SQL each query is checked against, in the dialect of the checking engine."""

from __future__ import annotations

from segmill.plans.settings import (
    AS_OF,
    CENTRE_WEIGHTS,
    CSV_PARTS,
    DENSITY_COLUMNS,
    EPS,
    FIRST_ID,
    FIRST_PARTS,
    LAST_ID,
    LATENESS,
    LATER_PARTS,
    MIN_CLUSTER_SIZE,
    HOT_MIN_POINTS,
    MIN_POINTS,
    N_BRANDS,
    N_CATEGORIES,
    N_CENTRES,
    RANGE_END,
    RANGE_START,
)
from segmill.plans.views import oracle_clickstream, oracle_dirty_clickstream
from segmill.schemas import CUSTOMERS_SCHEMA, INTEGER_FEATURES, NUMERIC_FEATURES

CLICKS = f"cs as ({oracle_clickstream()})"

FOLDED = f"""{CLICKS},
topb as (select brand from cs group by brand order by count(*) desc, brand limit {N_BRANDS}),
topc as (select category_code_1 from cs group by category_code_1
  order by count(*) desc, category_code_1 limit {N_CATEGORIES}),
folded as (
  select *, case when brand in (select brand from topb) then brand else 'Other' end as brand_clean,
    case when category_code_1 in (select category_code_1 from topc) then category_code_1 else 'Other' end
      as category_code_1_clean,
    cast(hour(event_time) as int) as hour, cast(isodow(event_time) as int) as weekday
  from cs)"""

WINDOWED = f"""{FOLDED},
win as (
  select *,
    count(*) over (partition by user_id, category_code_1_clean) as category_count,
    count(*) over (partition by user_id, brand_clean) as brand_count,
    count(*) over (partition by user_id, hour) as hour_count,
    count(*) over (partition by user_id, weekday) as weekday_count,
    min(case when event_type = 'cart' then event_time end) over (partition by user_id, product_id) as cart_time,
    min(case when event_type = 'purchase' then event_time end) over (partition by user_id, product_id)
      as purchase_time,
    count(case when event_type = 'view' then 1 end) over (partition by user_id, product_id) as views_per_product,
    min(event_time) over (partition by user_id, user_session) as session_start,
    max(event_time) over (partition by user_id, user_session) as session_end
  from folded)"""

METRICS = f"""{WINDOWED},
base as (
  select user_id,
    cast(count(case when event_type = 'view' then 1 end) as bigint) as n_clicks,
    cast(count(case when event_type = 'cart' then 1 end) as bigint) as n_carts,
    cast(count(case when event_type = 'purchase' then 1 end) as bigint) as n_purchases,
    cast(count(distinct product_id) as bigint) as unique_products,
    cast(count(distinct category_code_1_clean) as bigint) as unique_categories,
    arg_min(category_code_1_clean, {{'n': -category_count, 'v': category_code_1_clean}}) as most_common_category,
    arg_min(brand_clean, {{'n': -brand_count, 'v': brand_clean}}) as most_common_brand,
    cast(count(distinct user_session) as bigint) as n_sessions,
    avg((epoch_us(session_end) - epoch_us(session_start)) / 1e6) as avg_session_len_sec,
    cast(date_diff('day', min(event_time), max(event_time)) as double) as user_lifespan_days,
    avg(date_diff('second', cart_time, purchase_time)) as avg_decision_delay_sec,
    sum(case when event_type = 'view' and views_per_product > 1 then 1.0 else 0.0 end)
      / nullif(count(case when event_type = 'view' then 1 end), 0) as product_revisit_rate,
    coalesce(sum(case when event_type = 'purchase' then price end), 0.0) as total_spent,
    avg(case when event_type = 'purchase' then price end) as avg_item_value,
    arg_min(hour, {{'n': -hour_count, 'v': hour}}) as modal_hour,
    arg_min(weekday, {{'n': -weekday_count, 'v': weekday}}) as modal_weekday,
    cast(date_diff('day', max(event_time), timestamp '{AS_OF}') as double) as recency_days,
    min(event_time) as first_event, max(event_time) as last_event
  from win group by user_id),
customers as (
  select cast(row_number() over (order by user_id) - 1 as bigint) as id_client, *,
    n_carts / nullif(n_clicks, 0) as cart_to_click_ratio,
    n_purchases / nullif(n_carts, 0) as purchase_to_cart_ratio,
    n_purchases / nullif(n_clicks, 0) as purchase_to_click_ratio
  from base)"""

# Digits kept in the output. A mean of microseconds over n rows often ends in an
# exact half at the sixth digit, so that one keeps three.
ROUNDED = {
    "cart_to_click_ratio": 6,
    "purchase_to_cart_ratio": 6,
    "purchase_to_click_ratio": 6,
    "avg_session_len_sec": 3,
    "avg_decision_delay_sec": 6,
    "product_revisit_rate": 6,
    "total_spent": 6,
    "avg_item_value": 6,
}


def _columns(names: list[str]) -> str:
    return ", ".join(f"round({c}, {ROUNDED[c]}) as {c}" if c in ROUNDED else c for c in names)


def from_customers(names: list[str]) -> str:
    return f"with {METRICS} select {_columns(names)} from customers"


def _input(column: str) -> str:
    kind = "double" if column in INTEGER_FEATURES else "float"
    return f"coalesce(cast(cast({column} as {kind}) as double), 0.0)"


SCALED = f"""{METRICS},
inputs as (select id_client, most_common_category, most_common_brand,
  {', '.join(f'{_input(c)} as {c}' for c in NUMERIC_FEATURES)} from customers),
scaled as (select id_client, most_common_category, most_common_brand,
  {', '.join(
      f"({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1) as {c}_z"
      for c in NUMERIC_FEATURES
  )} from inputs)"""

CLEANED = f"""raw as ({oracle_dirty_clickstream()}),
dedup as (select * from raw
  qualify row_number() over (partition by event_time, user_id, product_id, event_type order by ordinal) = 1),
present as (select * from dedup where price is not null and user_session is not null)"""


def _normalised(column: str) -> str:
    cleaned = f"regexp_replace(lower({column}), '^\\s+|\\s+$', '', 'g')"
    return f"case when {column} is null or {cleaned} in ('', 'nan') then 'unknown' else {cleaned} end"


def _levels(path: str) -> str:
    """Level columns; a list index past the end gives null."""
    parts = [f"string_split({path}, '.')[{i}]" for i in range(1, 5)]
    rest = ", ".join(f"coalesce({p}, 'unknown') as category_code_{i}" for i, p in enumerate(parts[1:], 2))
    return f"{parts[0]} as category_code_1, {rest}, {_rest(path)} as category_rest"


def _rest(path: str) -> str:
    """What follows the fourth level, null where nothing does."""
    return f"nullif(array_to_string(list_slice(string_split({path}, '.'), 5, -1), '.'), '')"


def cleaned(source: str, time: str, price: str) -> str:
    """The cleaned events of a relation with the raw columns."""
    return f"""select {time} as event_time, event_type, product_id, brand, {price} as price, user_id,
    user_session, {_levels('category_code')}
  from (select * replace ({_normalised('brand')} as brand, {_normalised('category_code')} as category_code)
        from {source})"""


# A written CSV holds whole seconds, and some rows of it carry a bad price.
CSV_ROWS = f"""raw as ({oracle_dirty_clickstream()}),
csv as (select * replace (date_trunc('second', event_time) as event_time) from raw),
good as (select * from csv where ordinal % 29 <> 3 or price is null),
dedup as (select * from good
  qualify row_number() over (partition by event_time, user_id, product_id, event_type order by ordinal) = 1),
present as (select * from dedup where price is not null and user_session is not null)"""

CSV_PRICE = "round(cast(cast(price as float) as double), 2)"
CSV_CLEANED = f"with {CSV_ROWS} {cleaned('present', 'event_time', CSV_PRICE)}"

CSV_PART = f"cast(product_id % {len(CSV_PARTS)} as int) as part"
CSV_SPOILT = "(ordinal % 29 = 3 and price is not null)"

# A first batch, then one with copies of its events and some rows far behind its last event.
STREAMED = f"""{CSV_ROWS},
parts as (select *, {CSV_PART} from good),
early as (select * from parts where part in {FIRST_PARTS}
  qualify row_number() over (partition by event_time, user_id, product_id, event_type order by ordinal) = 1),
later as (select *, event_time <= (select max(event_time) from early) - interval '{LATENESS}' as late
  from parts where part in {LATER_PARTS}),
fresh as (select * from later where not late
  qualify row_number() over (partition by event_time, user_id, product_id, event_type order by ordinal) = 1),
once as (select * from early union all select * exclude (late) from fresh
  anti join early using (event_time, user_id, product_id, event_type)),
once_present as (select * from once where price is not null and user_session is not null)"""


def _marked_missing(column: str) -> str:
    return f"case when lower(trim({column})) in ('', 'nan') then null else {column} end as {column}"


_long_z = " union all ".join(
    f"select id_client, {k} as position, {c}_z as value from scaled" for k, c in enumerate(NUMERIC_FEATURES)
)
# The matrix by entry; zeros of the one-hot blocks are not listed.
ENTRIES = f"""{SCALED},
slots as (select id_client, 1.0 as value,
    {len(NUMERIC_FEATURES)} + dense_rank() over (order by most_common_category) - 1 as category_position,
    {len(NUMERIC_FEATURES)} + (select count(distinct most_common_category) from scaled)
      + dense_rank() over (order by most_common_brand) - 1 as brand_position
  from scaled),
entries as (
  select id_client, cast(position as int) as position, cast(value as double) as value from ({_long_z})
  union all select id_client, cast(category_position as int), cast(value as double) from slots
  union all select id_client, cast(brand_position as int), cast(value as double) from slots)"""

ASSIGNED = f"""{ENTRIES},
centres as (select id_client as cluster, position, value from entries where id_client < {N_CENTRES}),
lengths as (select id_client, sum(value * value) as length from entries group by id_client),
products as (select e.id_client, c.cluster, sum(e.value * c.value) as product
  from entries e join centres c using (position) group by all),
distances as (select a.id_client, b.id_client as cluster, a.length + b.length - 2 * coalesce(product, 0) as distance
  from lengths a join lengths b on b.id_client < {N_CENTRES}
    left join products p on p.id_client = a.id_client and p.cluster = b.id_client),
assigned as (select id_client, cast(arg_min(cluster, {{'d': distance, 'c': cluster}}) as int) as cluster
  from distances group by id_client),
positions as (select distinct position from entries),
weights(cluster, weight) as (values {", ".join(f"({i}, {w!r})" for i, w in enumerate(CENTRE_WEIGHTS))})"""

_x, _y = DENSITY_COLUMNS
NEIGHBOURS = f"""{SCALED},
points as (select id_client, {_x}_z as x, {_y}_z as y,
    cast(floor({_x}_z / {EPS / 2**0.5!r}) as bigint) as cx, cast(floor({_y}_z / {EPS / 2**0.5!r}) as bigint) as cy
  from scaled),
near as (select a.id_client, a.x, a.y, a.cx, a.cy, count(*) as neighbours
  from points a join points b
    on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS!r}
  group by all)"""

# Brute force: core points joined pairwise, components by spreading the smallest id.
DENSITY = f"""{NEIGHBOURS},
core as (select * from near where neighbours >= {MIN_POINTS}),
linked as (select a.id_client as u, b.id_client as v from core a join core b
  on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS!r}),
reach(node, root) as (
  select id_client, id_client from core
  union
  select l.v, r.root from reach r join linked l on l.u = r.node),
roots as (select node, min(root) as root from reach group by node),
sizes as (select root, count(*) as size, min({{'x': cx, 'y': cy}}) as cell
  from roots join core on core.id_client = roots.node group by root),
numbered as (select root, cast(row_number() over (order by size desc, cell) - 1 as int) as label
  from sizes where size >= {MIN_CLUSTER_SIZE}),
labels as (select n.id_client, n.x, n.y, coalesce(numbered.label, -1) as label
  from near n left join roots on roots.node = n.id_client left join numbered using (root))"""

_nulls = " union all ".join(
    f"select '{c}' as column_name, cast(count(*) - count({c}) as bigint) as n_missing from raw"
    for c in ["event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session"]
)


def oracle_sql() -> dict[str, str]:
    stored_events = f"with {CLEANED} {cleaned('present', 'event_time', CSV_PRICE)}"
    entries = f"""with {ENTRIES}
  select id_client, position, round(value, 6) as value from entries where round(value, 6) <> 0"""
    return {
        "customer_metrics": from_customers(
            [
                "id_client", "user_id", "n_clicks", "n_carts", "n_purchases", "cart_to_click_ratio",
                "purchase_to_cart_ratio", "purchase_to_click_ratio", "unique_products", "unique_categories",
                "most_common_category", "most_common_brand", "n_sessions", "avg_session_len_sec",
                "user_lifespan_days", "avg_decision_delay_sec", "product_revisit_rate", "total_spent",
                "avg_item_value", "modal_hour", "modal_weekday", "recency_days", "first_event", "last_event",
            ]
        ),
        "funnel_counts": from_customers(["user_id", "n_clicks", "n_carts", "n_purchases"]),
        "funnel_ratios": from_customers(
            ["user_id", "cart_to_click_ratio", "purchase_to_cart_ratio", "purchase_to_click_ratio"]
        ),
        "user_distincts": from_customers(["user_id", "unique_products", "unique_categories", "n_sessions"]),
        "user_modal_values": from_customers(
            ["user_id", "most_common_category", "most_common_brand", "modal_hour", "modal_weekday"]
        ),
        "user_spend": from_customers(["user_id", "total_spent", "avg_item_value"]),
        "session_length": from_customers(["user_id", "avg_session_len_sec"]),
        "user_lifespan": from_customers(
            ["user_id", "user_lifespan_days", "recency_days", "first_event", "last_event"]
        ),
        "decision_delay": from_customers(["user_id", "avg_decision_delay_sec"]),
        "revisit_rate": from_customers(["user_id", "product_revisit_rate"]),
        "assign_customer_id": from_customers(["id_client", "user_id"]),
        "customers_by_id_range": from_customers(["id_client", "user_id", "n_clicks", "total_spent"])
        + f" where id_client between {FIRST_ID} and {LAST_ID}",
        "write_customers": from_customers(CUSTOMERS_SCHEMA.names),
        "create_customer_table": from_customers(CUSTOMERS_SCHEMA.names),
        "top_brands": f"with {CLICKS} select brand, count(*) as n from cs group by brand "
        f"order by n desc, brand limit {N_BRANDS}",
        "top_categories": f"with {CLICKS} select category_code_1, count(*) as n from cs group by category_code_1 "
        f"order by n desc, category_code_1 limit {N_CATEGORIES}",
        "collapse_rare_brand": f"with {FOLDED} select event_id, brand, brand_clean from folded",
        "collapse_rare_category": f"with {FOLDED} select event_id, category_code_1, category_code_1_clean from folded",
        "time_parts": f"with {FOLDED} select event_id, event_time, hour, weekday, "
        "strftime(event_time, '%Y%m') as event_month from folded",
        "win_value_counts": f"with {WINDOWED} select event_id, category_count, brand_count, hour_count, weekday_count from win",
        "win_cart_purchase_time": f"with {WINDOWED} select event_id, cart_time, purchase_time from win",
        "win_views_per_product": f"with {WINDOWED} select event_id, views_per_product from win",
        "win_session_bounds": f"with {WINDOWED} select event_id, session_start, session_end from win",
        "drop_unused": f"with {CLEANED} select * exclude (category_id) from raw",
        "dedup_events": f"with {CLEANED} select * from dedup",
        "drop_missing": f"with {CLEANED} select * from raw where price is not null and user_session is not null",
        "normalise_strings": f"with {CLEANED} select ordinal, {_normalised('brand')} as brand, "
        f"{_normalised('category_code')} as category_code from raw",
        "split_category": f"""with {CLEANED},
  parts as (select ordinal, string_split({_normalised('category_code')}, '.') as p from raw)
  select ordinal, {', '.join(f'p[{i}] as category_code_{i}' for i in range(1, 5))},
    nullif(array_to_string(list_slice(p, 5, -1), '.'), '') as category_rest from parts""",
        "fill_category_levels": f"""with {CLEANED},
  norm as (select ordinal, {_normalised('category_code')} as category_code from raw)
  select ordinal, {_levels('category_code')} from norm""",
        "clean_events": f"with {CLEANED} {cleaned('present', 'event_time', 'price')}",
        "scan_events_csv": f"""with {CSV_ROWS}
  select {CSV_PART}, event_time, event_type, product_id, category_id, {_marked_missing('category_code')},
    {_marked_missing('brand')}, case when {CSV_SPOILT} then null else {CSV_PRICE} end as price, user_id, user_session,
    case when {CSV_SPOILT} then 'bad price' end as reject_reason
  from csv""",
        "quarantine": f"""with {CSV_ROWS}
  select {CSV_PART}, 'bad price' as reject_reason, cast(category_id as varchar) as category_id, '12,5?' as price
  from csv where {CSV_SPOILT}""",
        "list_tables": f"""with {METRICS}, {CLEANED}
  select 'client' as name, count(*) as n_rows from customers union all select 'events', count(*) from present""",
        "ingest_folder": CSV_CLEANED,
        "ingest_report": f"""with {CSV_ROWS},
  inserted as (select {CSV_PART}, count(*) as rows_inserted from present group by all)
  select part, count(*) as rows_read, count(case when {CSV_SPOILT} then 1 end) as rows_rejected,
    count(case when not coalesce({CSV_SPOILT}, false)
      and len(string_split({_normalised('category_code')}, '.')) > 4 then 1 end) as rows_too_deep,
    rows_inserted
  from (select *, {CSV_PART} from csv) join inserted using (part) group by part, rows_inserted""",
        "ingest_global": CSV_CLEANED,
        "stream_dedup": f"with {STREAMED} {cleaned('once_present', 'event_time', CSV_PRICE)}",
        "stream_late_rows": f"with {STREAMED} select part, category_id from later where late",
        "append_events": stored_events,
        "create_events_table": stored_events,
        "events_between": f"""with stored as ({stored_events})
  select * from stored where event_time >= timestamp '{RANGE_START}' and event_time < timestamp '{RANGE_END}'""",
        "null_profile": f"with {CLEANED}, counts as ({_nulls}) select * from counts where n_missing > 0",
        "distinct_categories": f"""with {METRICS}
  select distinct 'most_common_category' as column_name, most_common_category as value from customers
  union all select distinct 'most_common_brand', most_common_brand from customers""",
        "scaled_features": f"with {SCALED} select id_client, "
        + ", ".join(f"round({c}_z, 6) as {c}_z" for c in NUMERIC_FEATURES)
        + " from scaled",
        "one_hot_features": f"""with {METRICS}
  select id_client, most_common_category, most_common_brand,
    cast(dense_rank() over (order by most_common_category) - 1 as int) as most_common_category_slot,
    cast(dense_rank() over (order by most_common_brand) - 1 as int) as most_common_brand_slot
  from customers""",
        "feature_matrix": entries,
        "save_model": entries,
        "feature_batch": f"{entries} and id_client between {FIRST_ID} and {LAST_ID}",
        "assign_clusters": f"with {ASSIGNED} select id_client, cluster from assigned",
        "minibatch_step": f"""with {ASSIGNED},
  sizes as (select cluster, count(*) as n from assigned group by cluster),
  totals as (select a.cluster, e.position, sum(e.value) as total
    from assigned a join entries e using (id_client) group by all)
  select cast(w.cluster as int) as cluster, p.position as dim,
    round((coalesce(c.value, 0) * w.weight + coalesce(t.total, 0)) / (w.weight + coalesce(n, 0)), 6) as center,
    cast(w.weight + coalesce(n, 0) as double) as weight
  from weights w cross join positions p left join centres c on c.cluster = w.cluster and c.position = p.position
    left join totals t on t.cluster = w.cluster and t.position = p.position left join sizes s on s.cluster = w.cluster""",
        "total_inertia": f"""with {SCALED},
  numeric as (select {' + '.join(f'count(*) * var_pop({c}_z)' for c in NUMERIC_FEATURES)} as s from scaled),
  slots as (select most_common_category as v, count(*) as c from scaled group by 1
    union all select most_common_brand, count(*) from scaled group by 1),
  encoded as (select sum(c - c * c / (select count(*) from scaled)) as s from slots)
  select round(numeric.s + encoded.s, 6) as inertia from numeric, encoded""",
        "feature_covariance": f"""with {ENTRIES},
  sums as (select position, sum(value) as s from entries group by position),
  products as (select a.position as i, b.position as j, sum(a.value * b.value) as p
    from entries a join entries b on a.id_client = b.id_client and a.position <= b.position group by all),
  counted as (select count(*) as n from scaled)
  select a.position as i, b.position as j, round(coalesce(p, 0) / n - a.s / n * (b.s / n), 6) + 0.0 as covariance
  from sums a join sums b on a.position <= b.position cross join counted
    left join products on i = a.position and j = b.position""",
        "random_sample": f"""with {CLICKS}
  select event_id, user_id from cs order by md5(concat('42', chr(31), event_id)), event_id limit 1000""",
        "density_core_points": f"""with {NEIGHBOURS}
  select id_client, round(x, 6) as x, round(y, 6) as y, neighbours, neighbours >= {MIN_POINTS} as is_core from near""",
        "k_distances": f"""with {NEIGHBOURS}
  select a.id_client, round(a.x, 6) as x, round(a.y, 6) as y, round(sqrt(list_sort(
      list((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))[{MIN_POINTS}]), 6) as k_distance
  from points a cross join points b group by all""",
        "density_hot_cells": f"""with {NEIGHBOURS}
  select id_client, neighbours >= {HOT_MIN_POINTS} as is_core from near""",
        "density_clusters": f"with recursive {DENSITY} select id_client, round(x, 6) as x, round(y, 6) as y, label from labels",
        "density_noise_share": f"""with recursive {DENSITY}
  select label, count(*) as n_points, round(count(*) / (select count(*) from labels), 6) as share
  from labels group by label""",
        "stream_ingest": CSV_CLEANED,
    }
