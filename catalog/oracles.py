"""DuckDB SQL that computes the registered queries from the same tables."""

from __future__ import annotations

import math

DAY_US = 86_400_000_000
NAMES = ("click", "error", "purchase", "signup", "view")

# --- shared table expressions --------------------------------------------------

CTE: dict[str, str] = {
    "log": """
        SELECT event_id, user_id || ' ' || CAST((epoch_us(ts) // 1000000) // 259200 AS VARCHAR) AS id,
               event_type AS event_name, ts AS event_timestamp, epoch_us(ts) AS us, value, props, user_id
        FROM events""",
    "hour_log": """
        SELECT event_id, id, event_name, date_trunc('hour', event_timestamp) AS event_timestamp,
               epoch_us(date_trunc('hour', event_timestamp)) AS us, value, props
        FROM log""",
    "status": """
        SELECT id, count(*) AS total_actions, min(us) AS first_us, max(us) AS last_us,
               min(us) FILTER (event_name = 'purchase') AS target_us, (SELECT max(us) FROM log) AS as_of
        FROM log GROUP BY id""",
    "labels": f"""
        SELECT id, CASE WHEN target_us IS NOT NULL THEN 'success'
                        WHEN (as_of - last_us) // {DAY_US} >= 7 THEN 'failure' ELSE 'incomplete' END AS final_outcome
        FROM status""",
    "closed": "SELECT id, final_outcome FROM labels WHERE final_outcome <> 'incomplete'",
    "scores": """
        SELECT id, CASE WHEN final_outcome = 'success' THEN 1 ELSE 0 END AS label,
               round(('0x' || substr(md5(id || '_7'), 1, 8))::BIGINT / 4294967296.0, 2) AS p
        FROM labels""",
    "order_log": """
        SELECT CASE WHEN l_returnflag = 'R' THEN 'order_returned' ELSE 'order_shipped' END AS event_name, l_shipdate
        FROM lineitem""",
    "daily": """
        SELECT CAST(l_shipdate AS DATE) AS ds, count(*) FILTER (event_name = 'order_shipped') AS y
        FROM order_log GROUP BY 1""",
    "warm": "SELECT ds, y FROM daily WHERE ds > (SELECT min(ds) FROM daily) + 71",
    "gaps": """
        SELECT *, us // 1000000 - lag(us // 1000000) OVER w AS gap_s, us - lag(us) OVER w AS gap_us
        FROM log WINDOW w AS (PARTITION BY id ORDER BY us, event_id)""",
    "lengths": f"""
        SELECT id, count(*) AS total_actions, max(us) - min(us) AS length_us,
               (max(us) - min(us)) / {DAY_US}.0 AS days, (max(us) - min(us)) / 6e7 AS minutes
        FROM log GROUP BY id""",
    "defs": """
        SELECT * FROM (VALUES ('click', NULL::BIGINT, 'Discover'), ('signup', 1, 'Apply for Credit'),
               ('view', NULL, 'First Purchase'), ('purchase', 6, 'Order Shipped')) AS t(event_name, milestone_number, stage)""",
    "bounds": "SELECT id, count(*) AS total_actions, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS journey_us FROM log GROUP BY id",
    "ranked": """
        SELECT *, CAST((5 * rank() OVER (ORDER BY total_actions) + count(*) OVER () - 1) // count(*) OVER () AS BIGINT) AS k
        FROM bounds""",
    "cuts": """
        SELECT id, k_no, id || '_' || k_no AS snapshot_id, start_us + CAST(floor(
                 ('0x' || substr(md5(id || '_' || k_no || '_42'), 1, 8))::BIGINT / 4294967296.0 * (end_us - start_us)) AS BIGINT) AS cut_us
        FROM (SELECT *, unnest(range(1, k + 1)) AS k_no FROM ranked)""",
    "one_cut": """
        SELECT id, start_us + CAST(floor(
                 ('0x' || substr(md5(id || '_1_42'), 1, 8))::BIGINT / 4294967296.0 * (end_us - start_us)) AS BIGINT) AS cut_us
        FROM bounds""",
    "snaps": """
        SELECT c.id, c.snapshot_id, max(l.us) AS last_us, any_value(o.final_outcome) AS final_outcome
        FROM cuts c JOIN log l ON l.id = c.id AND l.us <= c.cut_us JOIN closed o ON o.id = c.id GROUP BY 1, 2""",
    "vocab": "SELECT event_name, row_number() OVER (ORDER BY event_name) AS event_idx FROM (SELECT DISTINCT event_name FROM log)",
    "snap_rows": """
        SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY us, event_id) AS BIGINT) AS seq_idx FROM (
          SELECT s.snapshot_id, s.last_us, l.event_id, l.us, l.event_name,
                 row_number() OVER (PARTITION BY s.snapshot_id ORDER BY l.us DESC, l.event_id DESC) AS back
          FROM snaps s JOIN log l ON l.id = s.id AND l.us <= s.last_us) WHERE back <= 6""",
    "channels": """
        SELECT *, ln(1 + greatest(coalesce(us - lag(us) OVER (PARTITION BY snapshot_id ORDER BY seq_idx), 0), 0) / 3.6e9) AS log_delta_h,
               ln(1 + greatest(last_us - us, 0) / 3.6e9) AS log_to_cutoff_h
        FROM snap_rows""",
    "snap_keys": "SELECT c.snapshot_id, c.id, o.final_outcome FROM cuts c JOIN closed o ON o.id = c.id",
    "numbered": "SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY us, event_id) AS BIGINT) AS event_number FROM log",
    "curve": """
        SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (
          SELECT p AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY 1)
        WINDOW w AS (ORDER BY score DESC)""",
    "cells": """
        SELECT count(*) FILTER (label = 0 AND p < 0.5) AS n00, count(*) FILTER (label = 0 AND p >= 0.5) AS n01,
               count(*) FILTER (label = 1 AND p < 0.5) AS n10, count(*) FILTER (label = 1 AND p >= 0.5) AS n11 FROM scores""",
}
NEEDS = {
    "hour_log": ["log"],
    "status": ["log"],
    "labels": ["status"],
    "closed": ["labels"],
    "scores": ["labels"],
    "daily": ["order_log"],
    "warm": ["daily"],
    "gaps": ["log"],
    "lengths": ["log"],
    "bounds": ["log"],
    "ranked": ["bounds"],
    "cuts": ["ranked"],
    "one_cut": ["bounds"],
    "snaps": ["cuts", "closed", "log"],
    "vocab": ["log"],
    "snap_rows": ["snaps"],
    "channels": ["snap_rows"],
    "snap_keys": ["cuts", "closed"],
    "numbered": ["log"],
    "curve": ["scores"],
    "cells": ["scores"],
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """Prefix a query with the table expressions it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def hashed(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def r6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


COUNTS = ", ".join(f"count(*) FILTER (event_name = '{n}') AS n_{n}" for n in NAMES)


def flat(source: str, keys: str, cut: str, more: str = "") -> str:
    """The feature aggregation over visible events with ``gap_s``."""
    return f"""
        SELECT {keys}, min(us) AS first_action_ts, max(us) AS last_action_ts,
               max(us) // 1000000 - min(us) // 1000000 AS journey_length_s,
               (max({cut}) // 1000000 - max(us) // 1000000) // 86400 AS days_inactive,
               count(*) AS total_actions, {r6('avg(gap_s)', 'mean_gap_sec')}, {r6('median(gap_s)', 'median_gap_sec')},
               max(gap_s) AS max_gap_sec, {COUNTS}{more}
        FROM {source} GROUP BY {keys}"""


def snapshot_sql(cuts: str) -> str:
    return f"""
        SELECT f.*, o.final_outcome FROM ({flat('v', 'id, snapshot_id', 'cut_us')}) f JOIN closed o ON o.id = f.id"""


VISIBLE = "SELECT g.*, c.snapshot_id, c.cut_us FROM gaps g JOIN {cuts} c ON c.id = g.id AND g.us <= c.cut_us"

BASELINE = f"""
    SELECT id, n_events, n_unique_events, {r6(f'(last_us - first_us) / {DAY_US}.0', 'journey_duration_days')},
           {', '.join(f"CAST(last_name = '{n}' AS BIGINT) AS last_is_{n}" for n in NAMES)},
           {', '.join(f'n_{n}' for n in NAMES)}
    FROM (SELECT id, count(*) AS n_events, count(DISTINCT event_name) AS n_unique_events, min(us) AS first_us,
                 max(us) AS last_us, arg_max(event_name, (us, event_id)) AS last_name, {COUNTS}
          FROM {{source}} GROUP BY id)"""

TAKE = """
    SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY final_outcome ORDER BY {h}, {key}) AS rn FROM {source}) s
    JOIN quota q USING (final_outcome) WHERE rn <= n_take"""


def paths_sql(collapse: bool) -> str:
    steps = """SELECT n.id, n.us, n.event_id, coalesce(d.stage, 'NA') AS stage FROM log n LEFT JOIN defs d USING (event_name)"""
    if collapse:
        steps = f"""SELECT * FROM (SELECT *, lag(stage) OVER (PARTITION BY id ORDER BY us, event_id) AS before FROM ({steps}))
                    WHERE before IS NULL OR before <> stage"""
    return sql(
        """SELECT final_outcome, rank, 0::BIGINT AS page, path, n_steps, n FROM (
             SELECT final_outcome, path, n_steps, count(*) AS n,
                    row_number() OVER (PARTITION BY final_outcome ORDER BY count(*) DESC, min(id)) AS rank
             FROM chains JOIN labels USING (id) GROUP BY 1, 2, 3) WHERE rank <= 5""",
        "labels",
        "defs",
        steps=steps,
        chains="SELECT id, string_agg(stage, ' > ' ORDER BY us, event_id) AS path, count(*) AS n_steps FROM steps GROUP BY id",
    )


def _future(name: str, source: str, step: str) -> str:
    return f"""
        SELECT CAST(ds AS VARCHAR) AS ds, '{name}' AS freq FROM ({source}
          UNION ALL SELECT CAST(unnest(generate_series(CAST((SELECT max(ds) FROM ({source})) AS TIMESTAMP) + INTERVAL {step},
                     TIMESTAMP '2002-12-01', INTERVAL {step})) AS DATE) AS ds)"""


SEQ = """
    SELECT s.id, s.seq_idx, v.event_idx, round(ln(1 + s.gap), 6) AS log_gap{more} FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY us, event_id) AS seq_idx FROM (
        SELECT *, coalesce(gap_s, 0) AS gap, row_number() OVER (PARTITION BY id ORDER BY us DESC, event_id DESC) AS back FROM {source})
      WHERE back <= {n}) s JOIN vocab v USING (event_name) {join}"""

W_NEWNAME = "row_number() OVER (PARTITION BY id, event_name ORDER BY us, event_id)"

REPORT = """
    SELECT n00, n01, n10, n11, n00::DOUBLE / nullif(n00 + n10, 0) AS p0, n00::DOUBLE / nullif(n00 + n01, 0) AS r0,
           n11::DOUBLE / nullif(n01 + n11, 0) AS p1, n11::DOUBLE / nullif(n10 + n11, 0) AS r1,
           (n00 + n01)::DOUBLE AS s0, (n10 + n11)::DOUBLE AS s1 FROM cells"""

MONTH_ONLY = "SELECT CAST(date_trunc('month', ds) AS DATE) AS ds, CAST(sum(y) AS BIGINT) AS y FROM {source} GROUP BY 1"
WEEKLY = "SELECT CAST(date_trunc('week', ds) AS DATE) AS ds, CAST(sum(y) AS BIGINT) AS y FROM {source} GROUP BY 1"


def dated(source: str, where: str = "TRUE") -> str:
    return f"SELECT CAST(ds AS VARCHAR) AS ds, y FROM ({source}) WHERE {where}"


def interpolated(column: str, q: float) -> str:
    return f"quantile_cont({column}, {q})"


ORACLES: dict[str, str] = {
    # sources and sinks
    "events_csv": sql("SELECT id, event_name, us // 1000000 * 1000000 AS event_timestamp, event_id AS ed_id FROM log", "log"),
    "lenient_timestamps": "SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000000 * 1000000 END AS parsed FROM events",
    "parquet_projection": "SELECT event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1",
    "table_round_trip": sql(
        "SELECT CAST(CAST(date_trunc('week', event_timestamp) AS DATE) AS VARCHAR) AS week, event_name, count(*) AS n FROM log GROUP BY 1, 2", "log"
    ),
    "predictions_csv": sql("SELECT id, p AS order_shipped FROM scores", "scores"),
    "reuse_or_build": sql(dated("SELECT * FROM daily"), "daily"),
    "template_scores": sql(
        """SELECT l.id, round(coalesce(s.p, (SELECT median(p) FROM scores JOIN closed USING (id))), 6) AS p
           FROM labels l LEFT JOIN (SELECT scores.* FROM scores JOIN closed USING (id)) s ON s.id = l.id""",
        "scores",
        "closed",
    ),
    "sequence_table": sql(
        """SELECT CASE WHEN final_outcome = 'success' THEN 1 ELSE 0 END::BIGINT AS label, length, count(*) AS n, 6::BIGINT AS width
           FROM (SELECT snapshot_id, count(*) AS length FROM snap_rows GROUP BY 1) JOIN snaps USING (snapshot_id) GROUP BY 1, 2""",
        "snap_rows",
        "snaps",
    ),
    # projections, filters, columns
    "listed_events": sql("SELECT event_id, id, event_name FROM log WHERE event_name IN ('click', 'view', 'purchase')", "log"),
    "target_events": sql("SELECT event_id, id, us AS event_timestamp FROM log WHERE event_name = 'purchase'", "log"),
    "visible_before_target": sql(
        "SELECT event_id, l.id, us AS event_timestamp FROM log l JOIN status USING (id) WHERE target_us IS NULL OR us < target_us", "status"
    ),
    "pruned_log": "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type FROM events",
    "weekday_series": sql(dated("SELECT * FROM daily", "isodow(CAST(ds AS DATE)) < 6"), "daily"),
    "date_range": sql(dated("SELECT * FROM daily", "ds > DATE '1996-01-31' AND ds <= DATE '1999-12-31'"), "daily"),
    "outcomes_elapsed": sql("SELECT * FROM labels", "labels"),
    "outcomes_by_date": sql(
        """SELECT id, CASE WHEN target_us IS NOT NULL THEN 'success' WHEN date_diff('day', CAST(make_timestamp(last_us) AS DATE),
             CAST(make_timestamp(as_of) AS DATE)) > 7 THEN 'failure' ELSE 'incomplete' END AS final_outcome FROM status""",
        "status",
    ),
    "outcomes_by_window": sql(
        f"""SELECT id, CASE WHEN target_us IS NOT NULL THEN 'success' WHEN last_us < as_of - 7 * {DAY_US} THEN 'failure'
             ELSE 'incomplete' END AS final_outcome FROM status""",
        "status",
    ),
    "open_journeys": sql(
        f"SELECT id, CAST(target_us IS NULL AND last_us >= as_of - 7 * {DAY_US} AS BIGINT) AS incomplete FROM status", "status"
    ),
    "last_is_target": sql("SELECT id, CAST(arg_max(event_name, (us, event_id)) = 'purchase' AS BIGINT) AS will_ship FROM log GROUP BY id", "log"),
    "aligned_columns": sql(
        """SELECT id, count(*) FILTER (event_name = 'click') AS n_click, 0::BIGINT AS n_catalog,
             count(*) FILTER (event_name = 'view') AS n_view FROM log GROUP BY id""",
        "log",
    ),
    "filled_medians": sql(
        """SELECT id, round(coalesce(m, (SELECT median(m) FROM f), 0), 6) AS median_gap_sec, coalesce(x, 0) AS max_gap_sec FROM f""",
        "gaps",
        f="SELECT id, median(gap_s) AS m, max(gap_s) AS x FROM gaps GROUP BY id",
    ),
    "numeric_columns": """SELECT o_orderkey, 0.0::DOUBLE AS o_orderpriority, epoch_us(o_orderdate) / 1e6 AS o_orderdate,
             CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rank_text FROM orders""",
    "clipped_values": """SELECT c_custkey, round(least(greatest(c_acctbal / 5000, 0.0), 1.0), 6) AS p,
             CAST(least(greatest(c_acctbal / 5000, 0.0), 1.0) >= 0.5 AS BIGINT) AS c FROM customer""",
    "rate_features": sql(
        f"""SELECT id, {r6("count(*) FILTER (event_name = 'signup') / greatest(count(*), 1)", 'checkout_rate')},
             {r6("count(*) FILTER (event_name = 'view') / greatest(count(*), 1)", 'cart_rate')},
             {r6("count(*) FILTER (event_name = 'view') / (count(*) FILTER (event_name = 'click') + 1)", 'browse_to_cart')}
             FROM log GROUP BY id""",
        "log",
    ),
    "outcome_labels": sql("SELECT id, final_outcome, CAST(final_outcome = 'success' AS BIGINT) AS label FROM labels", "labels"),
    # joins
    "duplicate_rows": sql(
        """SELECT event_id, id, event_name, us AS event_timestamp FROM (
             SELECT *, count(*) OVER (PARTITION BY id, us, event_name) AS c FROM hour_log) WHERE c > 1""",
        "hour_log",
    ),
    "closed_events": sql("SELECT event_id, id FROM log WHERE id IN (SELECT id FROM closed)", "closed"),
    "other_events": sql("SELECT event_id, id FROM log WHERE id NOT IN (SELECT id FROM closed)", "closed"),
    "first_target_join": sql("SELECT event_id, target_us AS first_target_ts FROM log JOIN status USING (id)", "status"),
    "events_with_outcome": sql("SELECT final_outcome, event_name, count(*) AS n FROM log JOIN labels USING (id) GROUP BY 1, 2", "labels"),
    "truncated_events": sql("SELECT event_id, l.id, cut_us AS cutoff_time FROM log l JOIN one_cut c ON c.id = l.id AND us <= cut_us", "one_cut"),
    "snapshot_events": sql("SELECT snapshot_id, event_id FROM log l JOIN cuts c ON c.id = l.id AND us <= cut_us", "cuts"),
    "staged_events": sql(
        "SELECT stage, milestone_number, event_name, count(*) AS n FROM log LEFT JOIN defs USING (event_name) GROUP BY 1, 2, 3", "log", "defs"
    ),
    "encoded_events": sql(
        "SELECT event_id, CASE event_name WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 0 END::BIGINT AS event_idx FROM log", "log"
    ),
    "prediction_deltas": sql(
        f"""SELECT id, p AS p_a, q AS p_b, round(q - p, 6) AS delta FROM (
             SELECT id, p, round({hashed("id || '_8'")} / 4294967296.0, 2) AS q FROM scores)""",
        "scores",
    ),
    "days_to_target": sql(
        """SELECT id, date_diff('day', CAST(make_timestamp(first_us) AS DATE), CAST(make_timestamp(target_us) AS DATE)) AS days_to_buy
           FROM status WHERE target_us IS NOT NULL""",
        "status",
    ),
    "filled_months": sql(
        """SELECT CAST(CAST(ds AS DATE) AS VARCHAR) AS ds, coalesce(y, 0) AS y FROM (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds FROM m)
           LEFT JOIN m USING (ds)""",
        m="""SELECT date_trunc('month', l_shipdate) AS ds, count(*) AS y FROM lineitem WHERE l_partkey = (
             SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT date_trunc('month', l_shipdate)) > 1 ORDER BY count(*), 1 LIMIT 1) GROUP BY 1""",
    ),
    # aggregations
    "duplicate_share": sql(
        """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, round(sum(n - 1) / sum(n), 6) AS share
           FROM (SELECT count(*) AS n FROM hour_log GROUP BY id, us, event_name)""",
        "hour_log",
    ),
    "deduplicated": sql("SELECT id, event_name, us AS event_timestamp, min(event_id) AS event_id FROM hour_log GROUP BY 1, 2, 3", "hour_log"),
    "deduplicated_whole_rows": sql(
        """SELECT id, event_name, us AS event_timestamp, event_id, value, props FROM hour_log
           QUALIFY row_number() OVER (PARTITION BY id, us, event_name ORDER BY event_id) = 1""",
        "hour_log",
    ),
    "nulls_per_column": sql(
        """SELECT c.name AS column_name, CASE WHEN c.name IN ('mean_gap_sec', 'median_gap_sec', 'max_gap_sec') THEN s ELSE 0 END AS n_null,
                  round(CASE WHEN c.name IN ('mean_gap_sec', 'median_gap_sec', 'max_gap_sec') THEN s ELSE 0 END * 100.0 / n, 2)::DOUBLE AS pct_null
           FROM (SELECT count(*) FILTER (total_actions = 1) AS s, count(*) AS n FROM status),
                (SELECT unnest(['id', 'first_action_ts', 'last_action_ts', 'journey_length_s', 'days_inactive', 'total_actions', 'mean_gap_sec',
                  'median_gap_sec', 'max_gap_sec', 'n_click', 'n_error', 'n_purchase', 'n_signup', 'n_view']) AS name) c""",
        "status",
    ),
    "log_profile": sql(
        """SELECT count(*) AS n_rows, count(DISTINCT id) AS n_id, count(DISTINCT user_id) AS n_user_id, min(us) AS first_ts,
             max(us) AS last_ts FROM log""",
        "log",
    ),
    "key_pairs": "SELECT count(*) AS n_pairs FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)",
    "keys_with_many": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1",
    "keys_with_many_share": """SELECT count(*) FILTER (n > 1) AS n_multi, CAST(sum(n) AS BIGINT) AS n_pairs,
             round(count(*) FILTER (n > 1) / sum(n), 5) AS share
           FROM (SELECT count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey)""",
    "journey_states": sql(
        f"""SELECT id, total_actions, first_us AS first_ts, last_us AS last_ts, target_us AS first_target_ts,
             CAST(target_us IS NOT NULL AS BIGINT) AS has_shipped, as_of, (as_of - last_us) // {DAY_US} AS days_inactive FROM status""",
        "status",
    ),
    "outcome_totals": sql("SELECT final_outcome, count(*) AS n FROM labels GROUP BY 1", "labels"),
    "flat_journeys": sql(
        flat("(SELECT *, (SELECT max(us) FROM log) AS cut_us FROM gaps)", "id", "cut_us"), "gaps"
    ),
    "wide_counts": sql(f"SELECT id, {COUNTS} FROM log GROUP BY id", "log"),
    "baseline_table": sql(BASELINE.format(source="log"), "log"),
    "journey_as_lists": sql(
        """SELECT id, (rn - 1) // 4096 AS page, count(*) AS n_events, string_agg(event_name, ',' ORDER BY rn) AS event_names,
             string_agg(CAST(us AS VARCHAR), ',' ORDER BY rn) AS event_times
           FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us, event_id) AS rn FROM log) GROUP BY ALL""",
        "log",
    ),
    "list_based_features": sql(
        f"""SELECT id, n_events, n_unique_events, {r6(f'len_us / {DAY_US}.0', 'journey_duration_days')}, last_event_name, n_click, n_signup, n_view,
             CAST(last_event_name = 'view' AS BIGINT) AS last_event_is_view FROM (
             SELECT id, count(*) AS n_events, count(DISTINCT event_name) AS n_unique_events, max(us) - min(us) AS len_us,
                    arg_max(event_name, (us, event_id)) AS last_event_name, {COUNTS} FROM log GROUP BY id)""",
        "log",
    ),
    "list_functions": sql(
        """SELECT id, count(*) AS n_events, count(DISTINCT event_name) AS n_unique_events,
             CAST(arg_max(event_name, (us, event_id)) = 'view' AS BIGINT) AS last_is, count(*) FILTER (event_name = 'click') AS n_of,
             CAST(bool_or(event_name = 'click') AS BIGINT) AS has FROM log GROUP BY id""",
        "log",
    ),
    "event_shares": sql("SELECT event_name, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM log), 6)::DOUBLE AS pct FROM log GROUP BY 1", "log"),
    "most_common_events": sql("SELECT event_name, count(*) AS n FROM log GROUP BY 1 ORDER BY n DESC, event_name LIMIT 3", "log"),
    "length_statistics": sql(
        f"""SELECT {r6('avg(minutes)', 'mean_minutes')}, {r6('quantile_cont(length_us, 0.5) / 6e7', 'median_minutes')},
             {r6('avg(total_actions)', 'mean_actions')}, {r6('median(total_actions)', 'median_actions')} FROM lengths""",
        "lengths",
    ),
    "length_six_numbers": sql(
        f"""SELECT {r6('min(total_actions)', '"min"')}, {r6('quantile_cont(total_actions, 0.25)', 'q1')}, {r6('median(total_actions)', 'median')},
             {r6('quantile_cont(total_actions, 0.75)', 'q3')}, {r6('max(total_actions)', '"max"')}, {r6('avg(total_actions)', 'mean')} FROM lengths""",
        "lengths",
    ),
    "gap_statistics": sql(
        f"""SELECT {r6('avg(gap_us) / 1e6', 'mean_s')}, {r6('quantile_cont(gap_us::DOUBLE, 0.5) / 1e6', 'p50_s')},
             {r6('quantile_cont(gap_us::DOUBLE, 0.9) / 1e6', 'p90_s')}, {r6('quantile_cont(gap_us::DOUBLE, 0.99) / 1e6', 'p99_s')} FROM gaps""",
        "gaps",
    ),
    "length_by_outcome": sql(
        f"""SELECT final_outcome, count(*) AS n, {r6(f'avg(length_us) / {DAY_US}', 'mean_days')}, {r6(f'stddev_samp(length_us) / {DAY_US}', 'sd_days')},
             {r6(f'median(length_us::DOUBLE) / {DAY_US}', 'median_days')} FROM lengths JOIN labels USING (id) GROUP BY 1""",
        "lengths",
        "labels",
    ),
    "gap_by_outcome": sql(
        f"""SELECT final_outcome, count(gap_us) AS n, {r6('avg(gap_us) / 1e6', 'mean_s')}, {r6('stddev_samp(gap_us) / 1e6', 'sd_s')},
             {r6('median(gap_us::DOUBLE) / 1e6', 'median_s')} FROM gaps JOIN labels USING (id) WHERE gap_us IS NOT NULL GROUP BY 1""",
        "gaps",
        "labels",
    ),
    "length_quantiles": sql(
        f"""SELECT {r6(f'quantile_cont(length_us::DOUBLE, 0.8) / {DAY_US}', 'p80')}, {r6(f'quantile_cont(length_us::DOUBLE, 0.95) / {DAY_US}', 'p95')},
             {r6(f'max(length_us) FILTER (pos = round(0.8 * (n - 1)) + 1) / {DAY_US}', 'near80')},
             {r6(f'max(length_us) FILTER (pos = round(0.95 * (n - 1)) + 1) / {DAY_US}', 'near95')}
           FROM (SELECT length_us, row_number() OVER (ORDER BY length_us) AS pos, count(*) OVER () AS n FROM lengths)""",
        "lengths",
    ),
    "order_value_quantiles": f"""SELECT o_orderpriority, {r6('quantile_cont(o_totalprice, 0.1)', 'p10')}, {r6('quantile_cont(o_totalprice, 0.5)', 'p50')},
             {r6('quantile_cont(o_totalprice, 0.9)', 'p90')}, {r6('quantile_cont(o_totalprice, 0.99)', 'p99')} FROM orders GROUP BY 1""",
    "daily_series": sql(dated("SELECT * FROM daily"), "daily"),
    "daily_series_targets_only": sql(
        "SELECT CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS ds, count(*) AS y FROM log WHERE event_name = 'purchase' GROUP BY 1", "log"
    ),
    "weekly_series": sql(dated(WEEKLY.format(source="daily")), "daily"),
    "weekly_series_from_january": sql(
        """SELECT CAST(make_date(year(ds), 1, 1) + CAST(7 * (dayofyear(ds) // 7) AS INTEGER) AS VARCHAR) AS ds, CAST(sum(y) AS BIGINT) AS y
           FROM daily GROUP BY 1""",
        "daily",
    ),
    "monthly_series": sql(dated(MONTH_ONLY.format(source="daily"), "ds > '1995-02-01' AND ds < '2001-11-01'"), "daily"),
    "yearly_series": sql("SELECT CAST(make_date(year(ds), 1, 1) AS VARCHAR) AS ds, CAST(sum(y) AS BIGINT) AS y FROM daily GROUP BY 1", "daily"),
    "cohort_success": sql(
        f"""SELECT CAST(first_day AS VARCHAR) AS ds, count(*) AS total_users, count(*) FILTER (o = 'success') AS successes,
             {r6("count(*) FILTER (o = 'success') / count(*)", 'y')}
           FROM j WHERE o <> 'incomplete' AND first_day <= as_of_day - CAST(round_even((SELECT quantile_cont(date_diff('day', first_day, target_day), 0.95)
             FROM j WHERE target_day IS NOT NULL), 0) + 7 AS INTEGER) GROUP BY first_day""",
        "status",
        j="""SELECT CAST(make_timestamp(first_us) AS DATE) AS first_day, CAST(make_timestamp(target_us) AS DATE) AS target_day,
                    CAST(make_timestamp(as_of) AS DATE) AS as_of_day,
                    CASE WHEN target_us IS NOT NULL THEN 'success' WHEN date_diff('day', CAST(make_timestamp(last_us) AS DATE),
                      CAST(make_timestamp(as_of) AS DATE)) > 7 THEN 'failure' ELSE 'incomplete' END AS o FROM status""",
    ),
    "dropout": sql(
        f"""SELECT last_event_name, count(*) AS journeys, {r6(f'(SELECT median(len_us::DOUBLE) FROM e) / {DAY_US}', 'median_duration_days')},
             {r6('(SELECT median(n) FROM e)', 'median_events')} FROM e GROUP BY 1 ORDER BY journeys DESC, 1 LIMIT 12""",
        "log",
        e="""SELECT arg_max(event_name, (us, event_id)) AS last_event_name, count(*) AS n, max(us) - min(us) AS len_us FROM log
             GROUP BY id HAVING NOT bool_or(event_name = 'purchase')""",
    ),
    "stages_by_outcome": sql(
        "SELECT final_outcome, stage, count(*) AS n FROM log LEFT JOIN defs USING (event_name) JOIN labels USING (id) GROUP BY 1, 2", "labels", "defs"
    ),
    "last_stage_by_outcome": sql(
        f"""SELECT final_outcome, stage, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY final_outcome)', 'share')}
           FROM (SELECT id, arg_max(event_name, (us, event_id)) AS event_name FROM log GROUP BY id) LEFT JOIN defs USING (event_name)
           JOIN labels USING (id) GROUP BY 1, 2""",
        "labels",
        "defs",
    ),
    "paths_by_outcome": paths_sql(False),
    "collapsed_paths_by_outcome": paths_sql(True),
    "stage_reached": sql(
        f"""SELECT final_outcome, count(*) AS journeys, {r6('avg(hit)', 'share')} FROM (
             SELECT id, max(CASE WHEN event_name = 'signup' THEN 1 ELSE 0 END) AS hit FROM log GROUP BY id) JOIN labels USING (id) GROUP BY 1""",
        "labels",
    ),
    "score_summary": sql(
        f"""SELECT {r6('avg(p)', 'mean')}, {r6('stddev_samp(p)', 'sd')}, min(p) AS "min", max(p) AS "max", count(*) AS n, {r6('median(p)', 'median')}
           FROM scores""",
        "scores",
    ),
    "score_correlation": sql(f"""SELECT round(corr(p, p + {hashed("id || '_8'")} / 4294967296.0), 6) AS corr FROM scores""", "scores"),
    "length_histogram": sql(
        f"""SELECT b AS bin, {r6('lo + b * w', '"left"')}, {r6('lo + (b + 1) * w', '"right"')}, count(total_actions) AS n
           FROM (SELECT unnest(range(10)) AS b) CROSS JOIN s
           LEFT JOIN lengths ON least(CAST(floor((total_actions - lo) / w) AS BIGINT), 9) = b GROUP BY b, lo, w""",
        "lengths",
        s="SELECT min(total_actions)::DOUBLE AS lo, (max(total_actions)::DOUBLE - min(total_actions)::DOUBLE) / 10 AS w FROM lengths",
    ),
    "length_histogram_log": sql(
        f"""SELECT b AS bin, {r6('lo + b * w', '"left"')}, {r6('lo + (b + 1) * w', '"right"')}, count(x) AS n
           FROM (SELECT unnest(range(12)) AS b) CROSS JOIN s
           LEFT JOIN v ON least(CAST(floor((x - lo) / w) AS BIGINT), 11) = b GROUP BY b, lo, w""",
        v="SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0",
        s="SELECT min(x) AS lo, (max(x) - min(x)) / 12 AS w FROM v",
    ),
    "positive_share": sql(f"SELECT {r6('avg(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END)', 'share_positive')} FROM scores", "scores"),
    "vocabulary": sql(
        """SELECT event_name, row_number() OVER (ORDER BY event_name) AS event_idx FROM (
             SELECT event_name FROM log UNION SELECT event_name FROM order_log)""",
        "log",
        "order_log",
    ),
    "code_names": """SELECT count(DISTINCT l_returnflag) AS n_codes, count(DISTINCT l_linestatus) AS n_names, count(*) AS n_pairs,
             CAST(count(DISTINCT l_returnflag) = count(*) AND count(DISTINCT l_linestatus) = count(*) AS BIGINT) AS one_to_one
           FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)""",
    "standardized": sql(
        f"""SELECT id, {r6('(total_actions - ma) / sa', 'total_actions')}, {r6('(days - md) / sd', 'days')}, 0.0::DOUBLE AS flat,
             CASE WHEN final_outcome = 'incomplete' THEN 'test' ELSE 'train' END AS part
           FROM k, (SELECT avg(total_actions) AS ma, stddev_samp(total_actions) AS sa, avg(days) AS md, stddev_samp(days) AS sd FROM k
                    WHERE final_outcome <> 'incomplete')""",
        "lengths",
        "labels",
        k="SELECT * FROM lengths JOIN labels USING (id)",
    ),
    # windows
    "gaps_between_events": sql("SELECT event_id, gap_s FROM gaps", "gaps"),
    "first_and_last": sql(
        """SELECT id, min(us) AS first_ts, max(us) AS last_ts, arg_min(event_name, (us, event_id)) AS first_event_name,
             arg_max(event_name, (us, event_id)) AS last_event_name, count(*) AS n_events FROM log GROUP BY id""",
        "log",
    ),
    "last_events": sql(
        """SELECT event_id, id, row_number() OVER (PARTITION BY id ORDER BY us, event_id) AS seq_idx FROM (
             SELECT *, row_number() OVER (PARTITION BY id ORDER BY us DESC, event_id DESC) AS back FROM log) WHERE back <= 4""",
        "log",
    ),
    "snapshot_counts": sql('SELECT id, total_actions, k AS "K" FROM ranked', "ranked"),
    "snapshot_counts_by_length": sql(
        """SELECT id, journey_us, CAST((5 * rank() OVER (ORDER BY journey_us) + count(*) OVER () - 1) // count(*) OVER () AS BIGINT) AS "K" FROM bounds""",
        "bounds",
    ),
    "event_timeline": sql(
        f"""SELECT id, event_id, count(*) OVER w AS n_events, CAST(sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_unique_events,
             {r6(f'(us - min(us) OVER w) / {DAY_US}.0', 'journey_duration_days')},
             {', '.join(f"CAST(event_name = '{n}' AS BIGINT) AS last_is_{n}" for n in NAMES)},
             {', '.join(f"count(*) FILTER (event_name = '{n}') OVER w AS n_{n}" for n in NAMES)}
           FROM (SELECT *, {W_NEWNAME} AS nth FROM log) WINDOW w AS (PARTITION BY id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""",
        "log",
    ),
    "step_recount": sql(
        """SELECT event_id, n AS journey_steps_until_end FROM log JOIN (SELECT id, count(DISTINCT event_name) AS n FROM log GROUP BY id) USING (id)""", "log"
    ),
    "steps_remaining": sql(
        "SELECT event_id, row_number() OVER (PARTITION BY id ORDER BY us DESC, event_id DESC) AS journey_steps_until_end FROM log", "log"
    ),
    "elapsed_days": sql(
        f"""SELECT event_id, event_number, {r6(f'(us - min(us) OVER (PARTITION BY id)) / {DAY_US}.0', 'time_since_start_days')} FROM numbered""",
        "numbered",
    ),
    "value_deltas": sql(
        f"""SELECT event_id, value, {r6('value - coalesce(lag(value) OVER (PARTITION BY id ORDER BY us, event_id), 0)', 'value_delta')} FROM log""", "log"
    ),
    "largest_value_moves": sql(
        f"""SELECT event_id, {r6('d', 'value_delta')} FROM (
             SELECT event_id, value - coalesce(lag(value) OVER (PARTITION BY id ORDER BY us, event_id), 0) AS d FROM log)
           ORDER BY abs(d) DESC, event_id LIMIT 10""",
        "log",
    ),
    "nearest_scores": sql(
        """SELECT * FROM (SELECT id, label, p, 'high' AS profile FROM scores ORDER BY abs(p - 0.75), id LIMIT 1)
           UNION ALL SELECT * FROM (SELECT id, label, p, 'low' FROM scores ORDER BY abs(p - 0.10), id LIMIT 1)
           UNION ALL SELECT * FROM (SELECT id, label, p, 'highest' FROM scores ORDER BY p DESC, id LIMIT 1)
           UNION ALL SELECT * FROM (SELECT id, label, p, 'lowest' FROM scores ORDER BY p, id LIMIT 1)""",
        "scores",
    ),
    "channel_values": sql(
        "SELECT snapshot_id, seq_idx, round(log_delta_h, 6) AS log_delta_h, round(log_to_cutoff_h, 6) AS log_to_cutoff_h FROM channels", "channels"
    ),
    # samples, splits, sets
    "journey_sample": sql(f"""SELECT event_id, id FROM log WHERE {hashed("id || '_42'")} / 4294967296.0 < 0.1""", "log"),
    "row_sample": sql(f"""SELECT event_id, id FROM log WHERE {hashed("event_id || '_42'")} / 4294967296.0 < 0.1""", "log"),
    "balanced_classes": sql(
        TAKE.format(cols="id, final_outcome", h=hashed("id || '_42'"), key="id", source="closed"),
        "closed",
        quota="""SELECT final_outcome, least(150, min(n) OVER ()) AS n_take
                 FROM (SELECT final_outcome, count(*) AS n FROM closed GROUP BY 1)""",
    ),
    "downsampled": sql(
        TAKE.format(cols="snapshot_id, id, final_outcome", h=hashed("snapshot_id || '_42'"), key="snapshot_id", source="snap_keys"),
        "snap_keys",
        quota="""SELECT 'failure' AS final_outcome, count(*) FILTER (final_outcome = 'failure') AS n_take FROM snap_keys
                 UNION ALL SELECT 'success', least(count(*) FILTER (final_outcome = 'failure') // 19, count(*) FILTER (final_outcome = 'success'))
                 FROM snap_keys""",
    ),
    "downsampled_capped": sql(
        TAKE.format(cols="snapshot_id, id, final_outcome", h=hashed("snapshot_id || '_42'"), key="snapshot_id", source="snap_keys"),
        "snap_keys",
        g="""SELECT f, s, least(f // 19, s) AS goal FROM (SELECT count(*) FILTER (final_outcome = 'failure') AS f,
               count(*) FILTER (final_outcome = 'success') AS s FROM snap_keys)""",
        w="SELECT *, greatest(1, CAST(round_even(500 * (goal / (f + goal)), 0) AS BIGINT)) AS want FROM g",
        quota="SELECT 'success' AS final_outcome, least(want, s) AS n_take FROM w UNION ALL SELECT 'failure', least(500 - want, f) FROM w",
    ),
    "stratified_tenth": sql(
        TAKE.format(cols="id, final_outcome", h=hashed("id || '_42'"), key="id", source="closed"),
        "closed",
        quota="SELECT final_outcome, greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS n_take FROM closed GROUP BY 1",
    ),
    "stratified_holdout": sql(
        f"""SELECT id, final_outcome, CAST(rn <= n_take AS BIGINT) AS is_valid FROM (
             SELECT *, row_number() OVER (PARTITION BY final_outcome ORDER BY {hashed("id || '_42'")}, id) AS rn FROM closed)
           JOIN (SELECT final_outcome, round(count(*) * 0.25) AS n_take FROM closed GROUP BY 1) USING (final_outcome)""",
        "closed",
    ),
    "grouped_folds": sql(
        f"""SELECT id, (row_number() OVER (PARTITION BY final_outcome ORDER BY {hashed("id || '_42'")}, id) - 1) % 5 AS fold FROM closed""",
        "closed",
    ),
    "fold_check": sql(
        f"""SELECT count(*) AS n_overlap FROM (
             SELECT k.id FROM snap_keys k JOIN folds f ON f.id = k.id GROUP BY 1 HAVING count(DISTINCT fold) > 1)""",
        "snap_keys",
        folds=f"SELECT id, (row_number() OVER (PARTITION BY final_outcome ORDER BY {hashed("id || '_42'")}, id) - 1) % 5 AS fold FROM closed",
    ),
    "single_cutoffs": sql("SELECT id, cut_us AS cutoff_time FROM one_cut", "one_cut"),
    "several_cutoffs": sql("SELECT id, k_no, snapshot_id, cut_us AS cutoff_time, id AS stripped FROM cuts", "cuts"),
    "id_sets": """SELECT o_custkey, 'common' AS part FROM (SELECT o_custkey FROM orders INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
           UNION ALL SELECT o_custkey, 'missing' FROM (SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
    # sequences
    "long_sequences": sql(SEQ.format(more="", source="gaps", n=5, join=""), "gaps", "vocab"),
    "training_sequences": sql(
        SEQ.format(
            more=", o.final_outcome",
            source="(SELECT g.* FROM gaps g JOIN c13 ON c13.id = g.id AND g.us <= c13.cut_us)",
            n=100,
            join="JOIN closed o ON o.id = s.id",
        ),
        "gaps",
        "vocab",
        "closed",
        "bounds",
        c13=f"SELECT id, start_us + CAST(floor({hashed(chr(105) + chr(100) + ' || ' + repr('_1_13'))} / 4294967296.0 * (end_us - start_us)) AS BIGINT) AS cut_us FROM bounds",
    ),
    "open_journey_sequences": sql(
        SEQ.format(more="", source="gaps", n=100, join="WHERE s.id IN (SELECT id FROM labels WHERE final_outcome = 'incomplete')"),
        "gaps",
        "vocab",
        "labels",
    ),
    "snapshot_sequences": sql("SELECT snapshot_id, event_id, seq_idx FROM snap_rows", "snap_rows"),
    "padded_arrays": sql(
        """SELECT snapshot_id, CAST(final_outcome = 'success' AS BIGINT) AS label, length,
             ids || repeat(',0', CAST(6 - length AS INTEGER)) AS event_ids, d || repeat(',0.000', CAST(6 - length AS INTEGER)) AS delta,
             c || repeat(',0.000', CAST(6 - length AS INTEGER)) AS to_cutoff
           FROM (SELECT snapshot_id, count(*) AS length, string_agg(CAST(event_idx AS VARCHAR), ',' ORDER BY seq_idx) AS ids,
                   string_agg(CAST(CAST(round(CAST(CAST(log_delta_h AS FLOAT) AS DOUBLE), 3) AS DECIMAL(12, 3)) AS VARCHAR), ',' ORDER BY seq_idx) AS d,
                   string_agg(CAST(CAST(round(CAST(CAST(log_to_cutoff_h AS FLOAT) AS DOUBLE), 3) AS DECIMAL(12, 3)) AS VARCHAR), ',' ORDER BY seq_idx) AS c
                 FROM channels JOIN vocab USING (event_name) GROUP BY 1) JOIN snaps USING (snapshot_id)""",
        "channels",
        "vocab",
        "snaps",
    ),
    # end-to-end tables
    "snapshot_features": sql(
        snapshot_sql("cuts"),
        "gaps",
        "closed",
        rk="""SELECT *, CAST((5 * rank() OVER (ORDER BY total_actions) + count(*) OVER () - 1) // count(*) OVER () AS BIGINT) AS k
              FROM (SELECT id, count(*) AS total_actions, min(us) AS start_us, max(us) AS end_us FROM log
                    WHERE id IN (SELECT id FROM closed) GROUP BY id)""",
        kc=f"""SELECT id, id || '_' || k_no AS snapshot_id, start_us + CAST(floor({hashed("id || '_' || k_no || '_42'")} / 4294967296.0
                 * (end_us - start_us)) AS BIGINT) AS cut_us FROM (SELECT *, unnest(range(1, k + 1)) AS k_no FROM rk)""",
        v=VISIBLE.format(cuts="kc"),
    ),
    "snapshot_features_by_length": sql(
        snapshot_sql("cuts"),
        "gaps",
        "closed",
        rk="""SELECT *, CAST((5 * rank() OVER (ORDER BY end_us - start_us) + count(*) OVER () - 1) // count(*) OVER () AS BIGINT) AS k
              FROM (SELECT id, min(us) AS start_us, max(us) AS end_us FROM log WHERE id IN (SELECT id FROM closed) GROUP BY id)""",
        kc=f"""SELECT id, id || '_' || k_no AS snapshot_id, start_us + CAST(floor({hashed("id || '_' || k_no || '_13'")} / 4294967296.0
                 * (end_us - start_us)) AS BIGINT) AS cut_us FROM (SELECT *, unnest(range(1, k + 1)) AS k_no FROM rk)""",
        v=VISIBLE.format(cuts="kc"),
    ),
    "single_snapshot_features": sql(
        f"SELECT f.*, o.final_outcome FROM ({flat('v', 'id', 'cut_us')}) f JOIN closed o ON o.id = f.id",
        "gaps",
        "closed",
        "one_cut",
        v="SELECT g.*, c.cut_us FROM gaps g JOIN one_cut c ON c.id = g.id AND g.us <= c.cut_us",
    ),
    "open_journey_features": sql(
        flat("v", "id", "cut_us", ", 'incomplete' AS final_outcome"),
        "gaps",
        "labels",
        seen="SELECT * FROM gaps WHERE id IN (SELECT id FROM labels WHERE final_outcome = 'incomplete')",
        v="SELECT *, (SELECT max(us) FROM seen) AS cut_us FROM seen",
    ),
    "training_table": sql(
        f"SELECT b.*, t.label FROM ({BASELINE.format(source='vis')}) b JOIN taken t USING (id)",
        "status",
        lab=f"""SELECT id, CAST(target_us IS NOT NULL AS BIGINT) AS label FROM status WHERE target_us IS NOT NULL OR last_us < as_of - 7 * {DAY_US}""",
        quota="""SELECT label, least(250, min(n) OVER ()) AS n_take
                 FROM (SELECT label, count(*) AS n FROM lab GROUP BY 1)""",
        taken=f"""SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hashed("id || '_123'")}, id) AS rn FROM lab)
                  JOIN quota USING (label) WHERE rn <= n_take""",
        vis="""SELECT l.* FROM log l JOIN taken USING (id) JOIN status s ON s.id = l.id WHERE target_us IS NULL OR us < target_us""",
    ),
    "cleaned_and_labelled": sql(
        """SELECT final_outcome, count(*) AS n_events, count(DISTINCT id) AS n_journeys FROM (SELECT DISTINCT id, us, event_name FROM hour_log)
           JOIN lab USING (id) GROUP BY 1""",
        "hour_log",
        lab=f"""SELECT id, CASE WHEN bool_or(event_name = 'purchase') THEN 'success'
                 WHEN ((SELECT max(us) FROM hour_log) - max(us)) // {DAY_US} >= 7 THEN 'failure' ELSE 'incomplete' END AS final_outcome
                 FROM hour_log GROUP BY id""",
    ),
    # metrics
    "accuracy_of_scores": sql(f"SELECT {r6('avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = label THEN 1 ELSE 0 END)', 'accuracy')} FROM scores", "scores"),
    "confusion_matrix": sql(
        """SELECT 0::BIGINT AS label, 0::BIGINT AS predicted, n00 AS n FROM cells UNION ALL SELECT 0, 1, n01 FROM cells
           UNION ALL SELECT 1, 0, n10 FROM cells UNION ALL SELECT 1, 1, n11 FROM cells""",
        "cells",
    ),
    "class_report": sql(
        """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
             SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM g
             UNION ALL SELECT '1', p1, r1, f1, s1 FROM g
             UNION ALL SELECT 'macro', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM g
             UNION ALL SELECT 'weighted', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM g)""",
        "cells",
        rep=REPORT,
        g="SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM rep",
    ),
    "brier_score": sql(f"SELECT {r6('avg(power(p - label, 2))', 'brier')} FROM scores", "scores"),
    "average_precision": sql(f"SELECT {r6('sum(pos * (tp / (tp + fp))) / sum(pos)', 'average_precision')} FROM curve", "curve"),
    "roc_auc": sql(f"SELECT {r6('sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))', 'roc_auc')} FROM curve", "curve"),
    "sensitivity_specificity": sql(
        f"SELECT {r6('n11 / (n10 + n11)', 'sensitivity')}, {r6('n00 / (n00 + n01)', 'specificity')} FROM cells", "cells"
    ),
    "all_measures": sql(
        f"""SELECT {r6('avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = label THEN 1 ELSE 0 END)', 'accuracy')},
             {r6('(SELECT n11 / (n10 + n11) FROM cells)', 'sensitivity')}, {r6('(SELECT n00 / (n00 + n01) FROM cells)', 'specificity')},
             {r6('avg(power(p - label, 2))', 'brier')}, {r6('(SELECT sum(pos * (tp / (tp + fp))) / sum(pos) FROM curve)', 'average_precision')},
             {r6('(SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) FROM curve)', 'roc_auc')}, {r6('avg(p)', 'mean_p')} FROM scores""",
        "cells",
        "curve",
    ),
    "mean_score": sql(f"SELECT {r6('avg(p)', 'mean_p')} FROM scores", "scores"),
    # series preparation
    "warm_started_series": sql(
        dated(
            "SELECT * FROM daily",
            """ds::DATE > (SELECT min(ds) FROM daily) + CAST(round_even((SELECT quantile_cont(date_diff('day', CAST(make_timestamp(first_us) AS DATE),
                 CAST(make_timestamp(last_us) AS DATE)), 0.8) FROM status WHERE target_us IS NOT NULL), 0) AS INTEGER)""",
        ),
        "daily",
        "status",
    ),
    "success_length_cuts": sql(
        f"""SELECT {r6("quantile_cont(date_diff('day', CAST(make_timestamp(first_us) AS DATE), CAST(make_timestamp(last_us) AS DATE)), 0.8)", 'days')},
             {r6(f'max(w) FILTER (pos = round(0.8 * (n - 1)) + 1)', 'whole_days')}
           FROM (SELECT *, (last_us - first_us) // {DAY_US} AS w, row_number() OVER (ORDER BY (last_us - first_us) // {DAY_US}) AS pos,
                   count(*) OVER () AS n FROM status WHERE target_us IS NOT NULL)""",
        "status",
    ),
    "training_days": sql(dated("SELECT * FROM warm", "isodow(CAST(ds AS DATE)) < 6"), "warm"),
    "training_weeks": sql(dated(WEEKLY.format(source="warm")), "warm"),
    "training_months": sql(dated(MONTH_ONLY.format(source="warm"), "ds > '1995-03-01' AND ds < '2001-11-01'"), "warm"),
    "future_dates": sql(
        _future("day", "SELECT ds FROM daily", "1 DAY")
        + " UNION ALL "
        + _future("week", "SELECT DISTINCT CAST(date_trunc('week', ds) AS DATE) AS ds FROM daily", "7 DAY")
        + " UNION ALL "
        + _future("month", "SELECT DISTINCT CAST(date_trunc('month', ds) AS DATE) AS ds FROM daily", "1 MONTH"),
        "daily",
    ),
    "seasonal_columns": sql(
        """SELECT CAST(ds AS VARCHAR) AS ds, y, ((year(ds) - 1995) * 12 + month(ds) - 1)::DOUBLE AS trend_month, round(sin(a), 6) AS sin_annual,
             round(cos(a), 6) AS cos_annual, round(sin(2 * a), 6) AS sin_semiannual, round(cos(2 * a), 6) AS cos_semiannual
           FROM (SELECT *, 2 * pi() * (month(ds) - 1) / 12 AS a FROM m)""",
        "daily",
        m=MONTH_ONLY.format(source="daily"),
    ),
    "date_functions": sql(
        """SELECT CAST(ds AS VARCHAR) AS ds, CAST(CAST(date_trunc('week', ds) AS DATE) AS VARCHAR) AS week,
             CAST(make_date(year(ds), 1, 1) + CAST(7 * (dayofyear(ds) // 7) AS INTEGER) AS VARCHAR) AS year_week,
             CAST(CAST(date_trunc('month', ds) AS DATE) AS VARCHAR) AS month, CAST(make_date(year(ds), 1, 1) AS VARCHAR) AS year,
             dayname(ds) AS weekday,
             CAST(make_date(2023, month(ds), CASE WHEN month(ds) = 2 THEN least(day(ds), 28) ELSE day(ds) END) AS VARCHAR) AS aligned,
             strftime(ds, '%Y-%m') AS month_text, (year(ds) - 1995) * 12 + month(ds) - 1 AS month_no, CAST(ds + 71 AS VARCHAR) AS shifted FROM daily""",
        "daily",
    ),
    "time_functions": sql(
        f"""SELECT event_id, {r6('e / 1e6', 's')}, e // 60000 AS milli_min, {r6('e / 3.6e9', 'h')}, {r6(f'e / {DAY_US}.0', 'd')},
             e // {DAY_US} AS whole_d, us - 7 * {DAY_US} AS shifted, us // 1000000 AS epoch_s
           FROM (SELECT event_id, us, us - min(us) OVER (PARTITION BY id) AS e FROM log)""",
        "log",
    ),
    "value_grid": "SELECT DISTINCT round(v, 2) AS value FROM (SELECT unnest(["
    + ", ".join(f"quantile_cont(o_totalprice, {i / 11})" for i in range(12))
    + "]) AS v FROM orders)",
    "streamed_months": sql(dated(MONTH_ONLY.format(source="daily"), "y > 0"), "daily"),
    "picked_journey": sql(
        f"""SELECT id, n, {r6('d', 'days')} FROM (
             SELECT *, n BETWEEN 8 AND 20 AND d BETWEEN 1.5 AND 3.0 AS inside, abs(n - 12) + 0.5 * abs(d - 2.5) AS score FROM (
               SELECT id, count(*) AS n, (max(us) - min(us)) / {DAY_US}.0 AS d FROM log
               WHERE id IN (SELECT id FROM labels WHERE final_outcome = 'failure') GROUP BY id))
           ORDER BY inside DESC, score, id LIMIT 1""",
        "labels",
    ),
}
ORACLES["vocabulary_json"] = ORACLES["vocabulary"]

# --- formulas in place of fitted models ------------------------------------------

FORMULA = "n_events / (n_events + 10 + journey_duration_days)"
GRID = "SELECT DISTINCT round(v, 6) AS value FROM (SELECT unnest([" + ", ".join(
    f"quantile_cont(n_events, {i / 11})" for i in range(12)
) + "]) AS v FROM base)"
EXACT = f"""
    SELECT id, count(*) AS n_events, (max(us) - min(us)) / {DAY_US}.0 AS journey_duration_days FROM log GROUP BY id"""
SWEPT = "value / (value + 10 + journey_duration_days)"
FORECAST = """
    SELECT CAST(ds AS DATE) AS ds, dayofyear(ds) / 2.0 + dayofweek(ds) + 1 AS yhat, dayofyear(ds) / 2.0 AS trend,
           dayofweek(ds) + 1.0 AS weekly, CASE WHEN day(ds) = 1 THEN 3.0 ELSE 0.0 END AS holidays FROM daily"""
CALENDAR = """
    SELECT ds AS feature_ds, CAST(yhat AS DOUBLE) AS orders_yhat, CAST(trend AS DOUBLE) AS orders_trend,
           CAST(weekly AS DOUBLE) AS orders_weekly, 0.0::DOUBLE AS orders_yearly, CAST(holidays AS DOUBLE) AS orders_holidays FROM f"""
PARTS = ("yhat", "trend", "weekly", "yearly", "holidays")

ORACLES |= {
    "ice_of_formula": sql(f"SELECT id, value, round({SWEPT}, 6) AS p FROM base, grid", "log", base=EXACT, grid=GRID),
    "dependence_of_formula": sql(
        f"SELECT value, round(avg({SWEPT}), 6) AS p, count(*) AS n FROM base, grid GROUP BY 1", "log", base=EXACT, grid=GRID
    ),
    "profile_of_formula": sql(
        f"""SELECT 'highest' AS profile, id, value, round({SWEPT}, 6) AS p, CAST(n_events AS DOUBLE) AS baseline_value, round({FORMULA}, 6) AS baseline_p
            FROM (SELECT * FROM base ORDER BY {FORMULA} DESC, id LIMIT 1) b,
                 LATERAL (SELECT value FROM grid UNION SELECT CAST(b.n_events AS DOUBLE)) g(value)""",
        "log",
        base=EXACT,
        grid=GRID,
    ),
    "timeline_of_formula": sql(
        f"""SELECT id, event_number, {r6('d', 'time_since_start_days')}, {r6('p', 'p')},
              {r6('p - coalesce(lag(p) OVER (PARTITION BY id ORDER BY event_number), 0)', 'probability_delta')}
            FROM (SELECT *, event_number / (event_number + 10 + d) AS p FROM (
              SELECT id, event_number, (us - min(us) OVER (PARTITION BY id)) / {DAY_US}.0 AS d FROM numbered))""",
        "numbered",
    ),
    "calendar_of_formula": sql(
        f"SELECT CAST(feature_ds AS VARCHAR) AS feature_ds, * EXCLUDE (feature_ds) FROM ({CALENDAR})", "daily", f=FORECAST
    ),
    "orders_with_formula_calendar": sql(
        "SELECT o_custkey, epoch_us(last_action_ts) AS last_action_ts, "
        + ", ".join(f"round(coalesce(c.orders_{x}, (SELECT median(orders_{x}) FROM c)), 6) AS orders_{x}" for x in PARTS)
        + """ FROM (SELECT o_custkey, max(o_orderdate) AS last_action_ts FROM orders GROUP BY 1) o
             LEFT JOIN c ON c.feature_ds = CAST(o.last_action_ts AS DATE)""",
        "daily",
        f=FORECAST,
        c=CALENDAR,
    ),
    "holiday_years_of_formula": sql(
        """SELECT year(ds) AS year, CAST(make_date(2023, month(ds), CASE WHEN month(ds) = 2 THEN least(day(ds), 28) ELSE day(ds) END) AS VARCHAR)
             AS aligned_ds, CAST(ds AS VARCHAR) AS ds, CAST(holidays AS DOUBLE) AS holidays FROM f""",
        "daily",
        f=FORECAST,
    ),
    "moving_holidays": sql(
        """SELECT CAST(ds AS VARCHAR) AS ds, holiday FROM (
             SELECT ds, 'thanksgiving' AS holiday FROM daily WHERE month(ds) = 11 AND dayofweek(ds) = 4 AND day(ds) BETWEEN 22 AND 28
             UNION ALL SELECT ds, 'memorial' FROM daily WHERE month(ds) = 5 AND dayofweek(ds) = 1 AND day(ds) >= 25
             UNION ALL SELECT ds, 'labor' FROM daily WHERE month(ds) = 9 AND dayofweek(ds) = 1 AND day(ds) <= 7)""",
        "daily",
    ),
    "definitions_csv": """SELECT DISTINCT event_type AS event_name, 1::BIGINT AS journey_id, length(event_type) AS event_definition_id,
        NULL::BIGINT AS milestone_number, 'Discover' AS stage FROM events""",
    "template_csv": sql(
        "SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM labels WHERE final_outcome = 'failure'", "labels"
    ),
    "forecast_summary": sql(
        """SELECT 'success_journey_length_days' AS key, '71' AS value
           UNION ALL SELECT 'start_cutoff', CAST(CAST(min(ds) AS DATE) + 71 AS VARCHAR) FROM warm
           UNION ALL SELECT 'daily_train_rows_weekdays_only', CAST(count(*) FILTER (isodow(ds) < 6) AS VARCHAR) FROM warm
           UNION ALL SELECT 'forecast_end', CAST(greatest(max(CAST(ds AS DATE)), DATE '2002-12-01') AS VARCHAR) FROM warm""",
        "warm",
    ),
}

HOLEY = """
    SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN id END AS id, CASE WHEN event_name <> 'error' THEN event_name END AS event_name, us
    FROM hour_log"""

ORACLES |= {
    "duplicates_with_null_keys": sql(
        """SELECT event_id, id, event_name, us AS event_timestamp FROM (
             SELECT *, count(*) OVER (PARTITION BY id, us, event_name) AS c FROM holey) WHERE c > 1""",
        "hour_log",
        holey=HOLEY,
    ),
    "numbers_with_null_keys": sql(
        """SELECT event_id, lag(event_name) OVER w AS before, row_number() OVER w AS event_number FROM holey
           WINDOW w AS (PARTITION BY id ORDER BY us, event_id)""",
        "hour_log",
        holey=HOLEY,
    ),
    # The deviation is rounded away from the last digits that engines differ in.
    "summary_of_close_values": sql(
        """SELECT count(*) AS n, CAST(round(stddev_samp(us - (SELECT min(us) FROM log)) / 1e6) AS BIGINT) AS sd_seconds,
             min(us)::DOUBLE AS "min", max(us)::DOUBLE AS "max", quantile_cont(us::DOUBLE, 0.25) AS q1, quantile_cont(us::DOUBLE, 0.5) AS median FROM log""",
        "log",
    ),
}

HOLEY_LABELS = f"""
    SELECT id, CASE WHEN bool_or(coalesce(event_name = 'purchase', false)) THEN 'success'
                    WHEN ((SELECT max(us) FROM holey) - max(us)) // {DAY_US} >= 7 THEN 'failure' ELSE 'incomplete' END AS final_outcome
    FROM holey GROUP BY id"""
HOLEY_STAGED = """
    SELECT h.event_id, h.id, h.us, d.stage, o.final_outcome
    FROM holey h JOIN outcome o ON o.id IS NOT DISTINCT FROM h.id LEFT JOIN defs d ON d.event_name = h.event_name"""

FIRST_BAR = int(math.exp(-1.0) * 4294967296)


def _free_terms() -> dict[str, str]:
    """Columns of the additive design without penalty, as SQL over ``e`` (day since 1970) and ``t``."""
    terms = {"_one": "1.0", "_t": "t"}
    for name, period, order in (("yearly", 365.25, 10), ("weekly", 7.0, 3)):
        for n in range(1, order + 1):
            terms[f"_{name}_s{n}"] = f"sin(e * {2 * math.pi * n / period!r})"
            terms[f"_{name}_c{n}"] = f"cos(e * {2 * math.pi * n / period!r})"
    return terms


TRAIN_DAYS = """
    SELECT CAST(ds AS DATE) AS ds, y, date_diff('day', DATE '1970-01-01', CAST(ds AS DATE)) AS e FROM warm
    WHERE isodow(CAST(ds AS DATE)) < 6"""
SPAN = "SELECT min(ds) AS first, max(ds) AS last, date_diff('day', min(ds), max(ds))::DOUBLE AS days FROM train"
POISSON_TERMS = {
    "intercept": "1.0",
    "trend_month": "trend",
    **{f"{f}_{n}": f"{f}({k} * angle)" for n, k in (("annual", 1), ("semiannual", 2)) for f in ("sin", "cos")},
}
GROWN = """
    SELECT {key} AS ds, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS y,
           sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS quantity, round(max(l_extendedprice), 6) AS dearest, min(l_orderkey) AS first_order
    FROM lineitem WHERE {where} GROUP BY 1"""

ORACLES |= {
    "timeline_with_null_keys": sql(
        """SELECT event_id, count(*) OVER w AS n_events, count(DISTINCT event_name) OVER w AS n_unique_events,
                  count(*) FILTER (event_name = 'click') OVER w AS n_click
           FROM holey WINDOW w AS (PARTITION BY id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "hour_log",
        holey=HOLEY,
    ),
    "stages_with_null_keys": sql(
        """SELECT final_outcome, stage, count(*) AS n, 'events' AS report FROM staged GROUP BY 1, 2
           UNION ALL SELECT final_outcome, stage, count(*), 'last stage' FROM (
               SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY id ORDER BY us DESC, event_id DESC) = 1) GROUP BY 1, 2
           UNION ALL SELECT final_outcome, 'Discover', count(DISTINCT coalesce(id, '-')), 'journeys' FROM staged GROUP BY 1""",
        "hour_log",
        "defs",
        holey=HOLEY,
        outcome=HOLEY_LABELS,
        staged=HOLEY_STAGED,
    ),
    "snapshots_with_null_keys": sql(
        """SELECT h.event_id FROM holey h JOIN (SELECT id, (min(us) + max(us)) // 2 AS cut FROM holey GROUP BY id) c
             ON c.id IS NOT DISTINCT FROM h.id WHERE h.us <= c.cut""",
        "hour_log",
        holey=HOLEY,
    ),
    "staged_by_code": sql(
        """SELECT event_id, CASE event_name WHEN 'click' THEN 2 WHEN 'error' THEN 99 WHEN 'purchase' THEN 28 WHEN 'signup' THEN 12 ELSE 4 END::BIGINT AS ed_id,
                  milestone_number, stage FROM log LEFT JOIN defs USING (event_name)""",
        "log",
        "defs",
    ),
    "oob_votes": f"""
        SELECT id, label, CAST(count(tree) AS BIGINT) AS n_voters, coalesce(string_agg(tree, ',' ORDER BY tree), '') AS voters,
               CAST(count(tree) > 0 AS BIGINT) AS has_vote, 1::BIGINT AS in_range
        FROM (SELECT id, label FROM ({ORACLES["training_table"]})) rows_
        LEFT JOIN range(25) trees(tree) ON {hashed("id || '_' || tree || '_42'")} < {FIRST_BAR}
        GROUP BY 1, 2""",
    "sparse_trend_equations": sql(
        " UNION ALL ".join(
            [f"SELECT '{n}' AS term, count(*) AS n, round(sum(y * {x}), 3) AS of_fit, 0.0::DOUBLE AS violation FROM timed" for n, x in _free_terms().items()]
            + ["SELECT '_h' || i, (SELECT count(*) FROM timed), NULL::DOUBLE, 0.0::DOUBLE FROM range(25) hinges(i)"]
        ),
        "warm",
        train=TRAIN_DAYS,
        span=SPAN,
        timed="SELECT y, e, date_diff('day', first, ds) / days AS t FROM train, span",
    ),
    "simulated_trend": sql(
        """SELECT CAST(ds AS VARCHAR) AS ds, round(quantile_cont(v, 0.1), 6) AS lower, round(quantile_cont(v, 0.9), 6) AS upper FROM (
             SELECT ds, t * sum(size) OVER w - sum(size * t) OVER w + noise AS v FROM drawn
             WINDOW w AS (PARTITION BY path ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1""",
        "warm",
        train=TRAIN_DAYS,
        span=SPAN,
        ahead="""SELECT CAST(d AS DATE) AS ds, date_diff('day', first, CAST(d AS DATE)) / days AS t, 1.0 AS last_t
                 FROM span, generate_series(last + INTERVAL 1 DAY, TIMESTAMP '2002-12-01', INTERVAL 1 DAY) s(d)""",
        steps="SELECT ds, t, (t - coalesce(lag(t) OVER (ORDER BY t), last_t)) * 25 AS chance FROM ahead",
        hashes=f"""SELECT ds, t, chance, path, {hashed("path || '_' || ds || '_148_1'")} / 4294967296.0 AS u,
                   {hashed("path || '_' || ds || '_148_2'")} / 4294967296.0 - 0.5 AS side,
                   ({hashed("path || '_' || ds || '_149_1'")} + 1) / 4294967296.0 AS n1, {hashed("path || '_' || ds || '_149_2'")} / 4294967296.0 AS n2
                   FROM steps, range(200) paths(path)""",
        drawn="""SELECT ds, t, path, sqrt(-2 * ln(n1)) * cos(2 * pi() * n2) * 2.0 AS noise,
                 CASE WHEN u < chance THEN -sign(side) * ln(greatest(1 - 2 * abs(side), 1e-12)) * 2.0 ELSE 0.0 END AS size FROM hashes""",
    ),
    "saturating_checks": sql(
        """SELECT n_dates, n_dates AS n_inside, n_months, 0.0::DOUBLE AS largest_score FROM (
             SELECT count(*) AS n_months, count(*) + date_diff('month', max(ds), DATE '2003-10-01') AS n_dates FROM months)""",
        "daily",
        months="""SELECT DISTINCT CAST(date_trunc('month', CAST(ds AS DATE)) AS DATE) AS ds FROM daily
                  WHERE date_trunc('month', CAST(ds AS DATE)) > DATE '1995-01-01' AND date_trunc('month', CAST(ds AS DATE)) < DATE '2001-11-01'""",
    ),
    "poisson_equations": sql(
        " UNION ALL ".join(f"SELECT '{n}' AS term, round(sum(y * {x}), 2) AS total FROM design" for n, x in POISSON_TERMS.items()),
        "daily",
        months="""SELECT CAST(date_trunc('month', CAST(ds AS DATE)) AS DATE) AS ds, sum(y)::DOUBLE AS y FROM daily GROUP BY 1
                  HAVING date_trunc('month', min(CAST(ds AS DATE))) > DATE '1995-01-01' AND date_trunc('month', min(CAST(ds AS DATE))) < DATE '2001-11-01'""",
        design="""SELECT y, 2 * pi() * (month(ds) - 1) / 12 AS angle,
                  date_diff('month', (SELECT min(ds) FROM months), ds)::DOUBLE AS trend FROM months""",
    ),
    "grown_days": GROWN.format(key="CAST(CAST(l_shipdate AS DATE) AS VARCHAR)", where="true"),
    "grown_months": GROWN.format(
        key="CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR)", where="l_shipdate >= TIMESTAMP '1998-01-01'"
    ),
}

ORACLES |= {
    "streamed_deduplicated": sql("SELECT DISTINCT id, event_name, us AS event_timestamp FROM hour_log", "hour_log"),
    "streamed_states": sql(
        """SELECT id, total_actions AS n_events, first_us, last_us, target_us AS first_target_us, final_outcome
           FROM status JOIN labels USING (id)""",
        "labels",
    ),
}

ORACLES |= {
    "timeline_within_a_day": sql(
        """SELECT event_id, lag(event_name) OVER o AS before, row_number() OVER o AS event_number, row_number() OVER o AS n_events,
                  count(DISTINCT event_name) OVER w AS n_unique_events, count(*) FILTER (event_name = 'click') OVER w AS n_click, 1::BIGINT AS spread_out
           FROM crammed WINDOW o AS (ORDER BY us NULLS FIRST, event_id),
                w AS (ORDER BY us NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "log",
        crammed=f"SELECT event_id, event_name, CASE WHEN event_name <> 'error' THEN us % {DAY_US} END AS us FROM log",
    ),
}

ORACLES |= {
    "forecast_orders": sql(
        """SELECT name, n AS n_rows, n AS n_ordered FROM (
             SELECT 'months' AS name, date_diff('month', max(CAST(ds AS DATE)), DATE '2002-12-01') AS n FROM (
                 SELECT date_trunc('month', CAST(ds AS DATE)) AS ds FROM daily) WHERE ds > DATE '1995-01-01' AND ds < DATE '2001-11-01'
             UNION ALL SELECT 'year', 1
             UNION ALL SELECT 'weeks', count(DISTINCT ds) + date_diff('day', max(CAST(ds AS DATE)), DATE '2002-12-01') // 7 FROM (
                 SELECT date_trunc('week', CAST(ds AS DATE)) AS ds FROM warm))""",
        "daily",
        "warm",
    ),
    "calendar_variant_checks": sql(
        f"""SELECT count(*) AS n_scored, count(*) AS n_in_range, count(*) AS n_unseen, 5::BIGINT AS n_more, 1::BIGINT AS agrees FROM (
             SELECT (row_number() OVER (PARTITION BY final_outcome ORDER BY {hashed("id || '_42'")}, id) - 1) % 5 AS fold FROM closed) WHERE fold = 0""",
        "closed",
    ),
    "tuning_checks": sql(
        f"""SELECT d.draw, count(*) AS n_scored, count(*) AS n_in_range, 1::BIGINT AS in_stated_space, 1::BIGINT AS brier_agrees,
             1::BIGINT AS winner_agrees, 1::BIGINT AS ends_at_lowest_loss, 1::BIGINT AS tried_beyond FROM (
             SELECT (row_number() OVER (PARTITION BY label ORDER BY {hashed("id || '_42'")}, id) - 1) % 5 AS fold FROM (
                 SELECT id, target_us IS NOT NULL AS label FROM status
                 WHERE CASE WHEN target_us IS NOT NULL THEN first_us < target_us ELSE last_us < as_of - 7 * {DAY_US} END)),
             range(15) d(draw) WHERE fold = 0 GROUP BY d.draw""",
        "status",
    ),
    "forest_checks": sql(
        f"""SELECT count(*) AS n, count(*) AS n_in_range, 1::BIGINT AS better FROM (
             SELECT (row_number() OVER (PARTITION BY label ORDER BY {hashed("id || '_42'")}, id) - 1) % 5 AS fold FROM (
                 SELECT id, target_us IS NOT NULL AS label FROM status
                 WHERE CASE WHEN target_us IS NOT NULL THEN first_us < target_us ELSE last_us < as_of - 7 * {DAY_US} END)) WHERE fold = 0""",
        "status",
    ),
}
