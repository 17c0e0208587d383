"""The registered queries as SQL over the same tables, written from the definitions."""

from __future__ import annotations

_HOURS = "unnest(range(timestamp '2024-01-01', timestamp '2024-02-01', interval 1 hour))"

_LINE_TEXTS = """
  select 'ord-' || l_orderkey as issue_id,
         'see (ord-' || l_partkey || ') and ord-' || l_orderkey as title,
         'blocked by ord-' || l_suppkey || '.' || l_linenumber || '.' as description,
         'ORD-' || l_partkey || ' xord-1, ord-' || l_suppkey || '-tail' as design,
         '' as acceptance_criteria,
         'éord-' || l_linenumber || ' ord-' || l_linenumber || 'A' as notes,
         case when l_returnflag = 'R' then 'ord-' || l_suppkey || ',ord-' || l_suppkey else '' end as close_reason
  from lineitem
"""

_UNPIVOTED = f"""
  select issue_id, field, text
  from ({_LINE_TEXTS}) unpivot (text for field in
    (title, description, design, acceptance_criteria, notes, close_reason))
"""

_LINE_MENTIONS = f"""
  select issue_id, mentioned_issue_id, field, count(*) as mention_count
  from (
    select issue_id, field,
           unnest(regexp_extract_all(text, '\\b(?:ord)-[0-9a-z]+(?:\\.[0-9]+)*\\b')) as mentioned_issue_id
    from ({_UNPIVOTED}))
  where mentioned_issue_id <> issue_id
  group by all
"""

_DOCUMENT_MENTIONS = """
  with prefixes as (select string_agg(distinct source, '|') as p from documents),
  texts as (
    select source || '-' || doc_id as issue_id, 'title' as field,
           'about ' || source || '-' || n_chars as text from documents
    union all
    select source || '-' || doc_id, 'description', replace(text, ' ', ' ' || source || '-') from documents),
  found as (
    select issue_id, field,
           unnest(regexp_extract_all(text, '\\b(?:' || p || ')-[0-9a-z]+(?:\\.[0-9]+)*\\b')) as mentioned_issue_id
    from texts, prefixes)
  select issue_id, mentioned_issue_id, field, count(*) as mention_count
  from found where mentioned_issue_id <> issue_id group by all
"""

_ORDER_CLOSINGS = """
  select o.*, s.last_ship, case when o_orderstatus = 'F' then s.last_ship end as closed_at
  from orders o left join
    (select l_orderkey, max(l_shipdate) as last_ship from lineitem group by 1) s on l_orderkey = o_orderkey
"""

_TEXT_COLS = """'close_reason ' || o_orderpriority as close_reason, 'description ' || o_orderpriority as description,
  'design ' || o_orderpriority as design, 'acceptance_criteria ' || o_orderpriority as acceptance_criteria,
  'notes ' || o_orderpriority as notes"""

_SNAPSHOTS = f"""
  select 'ord-' || o_orderkey as issue_id, 'order of ' || o_custkey as title, o_orderstatus as status,
         o_orderpriority as issue_type, o_custkey as priority, 'cust-' || o_custkey as assignee,
         o_orderdate as created_at, last_ship as updated_at, closed_at, {_TEXT_COLS},
         o_orderdate::date as snapshot_date, o_orderdate as _extracted_at
  from ({_ORDER_CLOSINGS})
"""

_STAGED_EVENTS = """
  select event_id::varchar as event_id, 'usr-' || user_id as issue_id, event_type, 'actor-' || user_id as actor,
         null::varchar as old_value, props as new_value,
         case when user_id > 75 then 'first' else 'again' end as comment,
         timezone('UTC', timezone('Australia/Sydney', ts)) as created_at, ts::date as created_date_local,
         case when user_id > 75 then ts + to_minutes(user_id) else ts + to_seconds(75 * 60 + 30) end as _extracted_at
  from events
"""

_SCD2 = """
  with states as (
    select o_custkey, o_orderdate::date as d, arg_max(o_orderstatus, o_orderkey) as o_orderstatus,
           arg_max(o_orderpriority, o_orderkey) as o_orderpriority
    from orders group by all),
  marked as (
    select *, (o_orderstatus, o_orderpriority) is distinct from
              lag((o_orderstatus, o_orderpriority)) over (partition by o_custkey order by d) as opens
    from states),
  opened as (
    select o_custkey, o_orderstatus, o_orderpriority, d as valid_from,
           lead(d) over (partition by o_custkey order by d) as valid_to
    from marked where opens)
  select *, valid_to is null as is_current from opened
"""

_INTERVALS = """
  select row_number() over () as rid, l_partkey as part, l_shipdate::date as valid_from,
         case when l_returnflag <> 'R' then l_shipdate::date + (l_linenumber * 20)::integer end as valid_to,
         l_returnflag = 'R' or l_linenumber = 1 as is_current
  from lineitem
"""

_LEDGER = """
  select event_type as table_name, date_trunc('hour', ts) as window_start, (user_id % 3 + 1) as attempt,
         case when user_id % 3 = 0 then 0 else count(*) end as n_rows,
         case when user_id % 3 = 0 then 0 else sum(length(props))::bigint end as bytes,
         case when user_id % 3 = 0 then 'timeout in ' || event_type end as error
  from events group by event_type, date_trunc('hour', ts), user_id % 3
"""

_LAST_ATTEMPT = f"""
  select * from ({_LEDGER})
  qualify row_number() over (partition by table_name, window_start order by attempt desc) = 1
"""

_NODES = """
  with lines as (
    select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as invocation_id from lineitem)
  select invocation_id, l_shipdate as generated_at, l_quantity as elapsed_time,
         'model.shop.part_' || l_partkey as unique_id, 'model' as resource_type, 'part_' || l_partkey as name,
         case when l_returnflag = 'R' then 'error' else 'success' end as status, l_quantity as execution_time,
         'line ' || l_linenumber as message, null::bigint as failures, l_shipdate as started_at,
         l_shipdate + to_minutes(case when l_linestatus = 'F' then 2 else 1 end) as completed_at,
         l_returnflag = 'R' as is_failed, case when l_linestatus = 'F' then 120.0 else 60.0 end::double as duration_seconds
  from lines
  union all
  select invocation_id, l_shipdate, l_quantity, 'test.shop.unique_part.h' || l_suppkey, 'test', 'h' || l_suppkey,
         case when l_discount > 0.05 then 'fail' else 'pass' end, l_tax, null, l_linenumber::bigint, null, null,
         l_discount > 0.05, l_tax
  from lines
"""

_COVERAGE = """
  select 'hour' as grain, h as window_start, h + interval 1 hour as window_end, count(ts) as row_count,
         coalesce(bool_or(event_type = 'purchase'), false) and not coalesce(bool_or(user_id % 50 = 0), false) as written
  from ({hours}) left join events on date_trunc('hour', ts) = h group by h
"""

ORACLES: dict[str, str] = {
    "window_assign": """
      select 'hour' as grain, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') as window_id,
             date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end,
             count(*) as n_events
      from events group by all
      union all
      select 'day', strftime(ts, '%Y-%m-%d'), date_trunc('day', ts)::timestamp,
             (date_trunc('day', ts) + interval 1 day)::timestamp, count(*)
      from events group by all""",
    "window_coverage": _COVERAGE.format(hours=f"select {_HOURS} as h"),
    "lookback_coverage": _COVERAGE.format(
        hours="select unnest(range(timestamp '2024-01-29 13:00:00', timestamp '2024-01-30 13:00:00', interval 1 hour)) as h"
    ),
    "window_integrity": """
      select event_id, ts + to_minutes(user_id % 45) as seen_at,
             case when event_type = 'view' then 'start_not_aligned'
                  when event_type = 'error' then 'end_not_start_plus_grain'
                  else 'event_outside_window' end as violation
      from events
      where event_type in ('view', 'error') or ts + to_minutes(user_id % 45) >= date_trunc('hour', ts) + interval 1 hour""",
    "event_log_window": """
      select event_id, ts, user_id, event_type from events
      where ts >= timestamp '2024-01-10 11:00:00' and ts < timestamp '2024-01-20 11:00:00'""",
    "local_time_conversion": """
      select event_id, days, timezone('UTC', timezone('Australia/Sydney', local_at)) as utc_at,
             local_at::date as local_date, timezone('Australia/Sydney', timezone('UTC', local_at))::date as date_if_utc
      from (select event_id, d::bigint as days, ts + to_days(d) as local_at from events, (values (90), (270)) v(d))""",
    "as_of_snapshot": """
      select o_custkey, o_orderkey, o_orderstatus, o_orderdate from orders where o_orderdate <= timestamp '1998-01-01'
      qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
    "daily_snapshots": """
      select user_id, d as window_start, arg_max(event_id, (ts, event_id)) as event_id,
             arg_max(event_type, (ts, event_id)) as event_type
      from (select unnest(range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as d), events
      where ts <= d + interval 1 day group by all""",
    "as_of_with_removals": """
      select * from (
        select o_custkey, o_orderkey, o_orderstatus, o_orderdate from orders where o_orderdate <= timestamp '1998-01-01'
        qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
      where o_orderstatus <> 'F'""",
    "daily_snapshots_with_removals": """
      select user_id, d as window_start, arg_max(event_id, (ts, event_id)) as event_id,
             arg_max(event_type, (ts, event_id)) as event_type
      from (select unnest(range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as d), events
      where ts <= d + interval 1 day group by all having arg_max(event_type, (ts, event_id)) <> 'error'""",
    "database_windows": """
      select event_id, ts, user_id, event_type from events
      where ts >= timestamp '2024-01-10 11:00:00' and ts < timestamp '2024-01-20 11:00:00'""",
    "current_value_changes": """
      select o_orderkey, change, old_custkey, new_custkey, o_orderstatus as status, date '2024-01-02' as dt
      from (
        select o_orderkey, o_orderstatus,
               case when o_orderkey % 10 <> 0 then o_custkey end as old_custkey,
               case when o_orderkey % 10 <> 1 then o_custkey + case when o_orderkey % 7 = 0 then 1 else 0 end end as new_custkey,
               case when o_orderkey % 10 = 0 then 'inserted' when o_orderkey % 10 = 1 then 'removed'
                    when o_orderkey % 7 = 0 then 'changed' end as change
        from orders)
      where change is not null""",
    "late_queue": """
      with touched as (select distinct date_trunc('hour', ts) as h from events
                       where event_type = 'click' and ts < timestamp '2024-01-20')
      select event_id, event_type, date_trunc('hour', ts) as _window_start,
             case when h is null then timestamp '2024-02-01' else timestamp '2024-02-02' end as _extracted_at,
             0 as left_in_queue
      from events left join touched on h = date_trunc('hour', ts) where event_type <> 'click' or h is not null""",
    "duration_quantiles": """
      select event_type as step, case when user_id % 2 = 0 then 'success' else 'failure' end as outcome, count(value) as n,
             q as quantile, true as within_error
      from events, (select unnest([0.5::double, 0.9::double, 0.99::double]) as q) group by all""",
    "carried_snapshots": """
      select user_id, d as window_start, arg_max(event_id, (ts, event_id)) as event_id,
             arg_max(event_type, (ts, event_id)) as event_type
      from (select unnest(range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) as d), events
      where ts <= d + interval 1 day group by all having arg_max(event_type, (ts, event_id)) <> 'error'""",
    "compaction": """
      with stored as (select *, hour(ts) < 6 and ts < timestamp '2024-01-10' as late from events)
      select event_id, ts, event_type, case when late then timestamp '2024-02-02' else timestamp '2024-02-01' end as _extracted_at,
             'raw/app/events/dt=' || strftime(ts, '%Y-%m-%d') || '/hh=' || strftime(ts, '%H') || '.parquet' as _source_file,
             ts::date as dt, hour(ts) as hh, true as fewer_files
      from stored where not (late and event_type = 'error')""",
    "ledger_checkpoint": """
      select h as window_start, count(event_id) as n_rows, true as few_files
      from (select unnest(range(timestamp '2024-01-01', timestamp '2024-01-13', interval 1 hour)) as h)
      left join events on date_trunc('hour', ts) = h group by 1""",
    "partition_restore": """
      select event_id, user_id,
             case when ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-15' then timestamp '2024-02-02'
                  else timestamp '2024-02-01' end as _extracted_at,
             'raw/app/events/dt=' || strftime(ts, '%Y-%m-%d') || '/hh=' || strftime(ts, '%H') || '.parquet' as _source_file
      from events where ts < timestamp '2024-01-31'""",
    "mart_swap": """
      select event_type, count(*) as n_events, ts::date as dt, 'lost' as second_build from events group by all""",
    "incremental_run": """
      with e as (
        select *, timezone('UTC', timezone('Australia/Sydney', ts)) as utc_at from events
        where ts < timestamp '2024-01-30 23:00:00'),
      commits as (select * from events where ts < timestamp '2024-01-30 12:00:00'),
      daily as (
        select user_id, d, arg_max(event_type, ts) as status
        from (select unnest(range(timestamp '2024-01-02', timestamp '2024-02-01', interval 1 day)) as d), events
        where ts <= d group by user_id, d),
      changes as (
        select status is distinct from lag(status) over (partition by user_id order by d) as opens from daily),
      dim as (select user_id, bool_or(ts = last and event_type = 'purchase') as closed, max(last) as last
              from (select *, max(ts) over (partition by user_id) as last from events where ts <= timestamp '2024-01-31')
              group by user_id),
      hours as (
        select date_trunc('hour', utc_at) as h, user_id % 7 as actor from e
        union
        select date_trunc('hour', ts), user_id % 7 from commits),
      found as (
        select 'dim_issues' as mart, null::date as dt, count(*) as n from dim
        union all select 'dim_issues_scd2', null, count(*) from changes where opens
        union all select 'fct_issue_events', ts::date, count(*) from e group by 2
        union all
        select 'mart_daily_throughput', dt, cast(sum(n) as bigint) from (
          select timezone('Australia/Sydney', timezone('UTC', timestamp '2023-12-31' + to_minutes(user_id)))::date as dt, 0 as n from dim
          union all
          select timezone('Australia/Sydney', timezone('UTC', last))::date, 0 from dim where closed
          union all
          select ts::date, 1 from e) group by dt
        union all
        select 'mart_actor_activity_hourly', timezone('Australia/Sydney', timezone('UTC', h))::date, count(*) from hours group by 2
        union all select 'mart_issue_mention_drift', null, count(*) from dim where user_id >= 2)
      select *, true as same_as_rebuild from found""",
    "as_of_too_early": """
      select o_orderstatus, count(*) as n_orders, 'no commit at or before 1900-01-01 00:00:00 UTC' as message
      from orders group by 1""",
    "late_windows": """
      select distinct 'hour' as grain, date_trunc('hour', ts) as window_start,
             date_trunc('hour', ts) + interval 1 hour as window_end
      from events where ts < timestamp '2024-01-29 13:00:00'""",
    "gate_failure": """
      select o_orderstatus, count(*) as n_orders,
             (select 'no_open_orders: ' || count(*) || ' failing rows' from orders where o_orderstatus = 'O') as message
      from orders group by 1""",
    "stream_late": "select event_id, ts, user_id from events",
    "stream_quarantine": """
      select event_id::varchar as id, case when event_type in ('error', 'click') then 'quarantine' else 'stored' end as place
      from events""",
    "conform_columns": """
      select l_orderkey, l_linenumber::bigint as l_linenumber, l_discount, l_partkey::varchar as l_partkey, l_shipdate
      from lineitem""",
    "raw_roundtrip": """
      select *, timestamp '2024-02-02' as _extracted_at, date_trunc('hour', ts) as _window_start,
             date_trunc('hour', ts) + interval 1 hour as _window_end,
             'raw/app/events/dt=' || strftime(ts, '%Y-%m-%d') || '/hh=' || strftime(ts, '%H') || '.parquet' as _source_file,
             ts::date as dt, hour(ts) as hh
      from events""",
    "raw_rerun": """
      select event_id, event_type, date_trunc('hour', ts) as _window_start, timestamp '2024-02-02' as _extracted_at
      from events where event_type = 'purchase'""",
    "raw_rerun_ledger": f"""
      select 'app' as source, 'events' as "table", 'raw' as zone, 'hour' as grain, h as window_start,
             h + interval 1 hour as window_end, count(ts) as n_rows, true as bytes_agree
      from (select unnest(range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 hour)) as h)
      left join events on date_trunc('hour', ts) = h and event_type = 'purchase' group by h""",
    "raw_schema_union": """
      select event_id, ts, case when ts >= timestamp '2024-01-16' then value end as value, ts::date as dt from events""",
    "backfill_totals": """
      select 'events' as table_name, 720::bigint as windows, 0::bigint as failed_windows, count(*) as n_rows
      from events where ts < timestamp '2024-01-31'
      union all
      select 'users', 30, 0, count(distinct (d, user_id))
      from (select unnest(range(timestamp '2024-01-02', timestamp '2024-02-01', interval 1 day)) as d), events
      where ts <= d""",
    "refresh_rows": """
      select 'events' as table_name, user_id, event_id, date_trunc('hour', ts) as _window_start,
             strftime(ts, 'raw/app/events/dt=%Y-%m-%d/hh=%H.parquet') as _source_file
      from events where ts >= timestamp '2024-01-29 13:00:00' and ts < timestamp '2024-01-30 13:00:00'
      union all
      select 'users', user_id, arg_max(event_id, ts), d, strftime(d, 'raw/app/users/dt=%Y-%m-%d/part-0.parquet')
      from (values (timestamp '2024-01-29'), (timestamp '2024-01-30')) v(d), events
      where ts <= d + interval 1 day group by user_id, d""",
    "derived_mentions": f"""
      select *, date '2024-01-31' as dt, 'derived/issue_mentions/dt=2024-01-31/part-0.parquet' as _source_file
      from ({_LINE_MENTIONS})""",
    "tracker_build": """
      with e as (
        select *, timezone('UTC', timezone('Australia/Sydney', ts)) as utc_at from events
        where ts < timestamp '2024-01-31 11:00:00'),
      commits as (select * from events where ts < timestamp '2024-01-31'),
      daily as (
        select user_id, d, arg_max(event_type, ts) as status
        from (select unnest(range(timestamp '2024-01-02', timestamp '2024-02-01', interval 1 day)) as d), events
        where ts <= d group by user_id, d),
      changes as (
        select status is distinct from lag(status) over (partition by user_id order by d) as opens from daily),
      dim as (select user_id, bool_or(ts = last and event_type = 'purchase') as closed, max(last) as last
              from (select *, max(ts) over (partition by user_id) as last from events where ts <= timestamp '2024-01-31')
              group by user_id)
      select 'dim_issues' as mart, count(*) as n_rows from dim
      union all select 'dim_issues_scd2', count(*) from changes where opens
      union all select 'fct_issue_events', count(*) from e
      union all
      select 'mart_daily_throughput', count(*) from (
        select timezone('Australia/Sydney', timezone('UTC', timestamp '2023-12-31' + to_minutes(user_id)))::date from dim
        union
        select timezone('Australia/Sydney', timezone('UTC', last))::date from dim where closed
        union
        select ts::date from e)
      union all
      select 'mart_actor_activity_hourly', count(*) from (
        select date_trunc('hour', utc_at), user_id % 7 from e
        union
        select date_trunc('hour', ts), user_id % 7 from commits)
      union all select 'mart_issue_mention_drift', count(*) from dim where user_id >= 2
      union all select 'passed assertions', 49::bigint""",
    "content_diff": """
      select *, 'left_only' as side from (select l_orderkey as order_key from lineitem except all select o_orderkey from orders)
      union all
      select *, 'right_only' from (select o_orderkey from orders except all select l_orderkey from lineitem)""",
    "content_hash": "select count(*) as n_rows, true as same_rows, true as same_hash from events",
    "stream_refresh": """
      select event_id, ts, user_id, event_type, date_trunc('hour', ts) as _window_start from events""",
    "stream_dedupe": "select event_id, ts, user_id from events",
    "staging_event_dedupe": _STAGED_EVENTS,
    "staging_issue_snapshots": _SNAPSHOTS,
    "staging_issue_history": f"""
      select s.issue_id, l_orderkey || '|' || l_linenumber || '|' || l_partkey as commit_hash,
             'supp-' || l_suppkey as committer, l_shipdate as commit_date, status, priority, issue_type, assignee,
             title, created_at, updated_at, closed_at, close_reason, description, design, acceptance_criteria, notes,
             _extracted_at
      from lineitem join ({_SNAPSHOTS}) s on s.issue_id = 'ord-' || l_orderkey""",
    "staging_commits": """
      select event_id::varchar as commit_hash, 'actor-' || user_id as committer, ts as committed_at, ts as _extracted_at
      from events""",
    "staging_comment_snapshots": """
      select conv_id || '|' || turn as comment_id, 'conv-' || conv_id as issue_id, role as author, text as comment_text,
             make_date(2024, 1, conv_id % 28 + 1)::timestamp as created_at,
             make_date(2024, 1, conv_id % 28 + 1) as snapshot_date,
             make_date(2024, 1, conv_id % 28 + 1)::timestamp as _extracted_at
      from conversations""",
    "staging_dependency_snapshots": """
      select 'dep-' || l_orderkey || '-' || l_linenumber as dependency_id, 'ord-' || l_orderkey as issue_id,
             l_returnflag as dependency_type, 'ord-' || l_suppkey as depends_on_issue_id, l_shipdate as created_at,
             l_shipdate::date as snapshot_date, l_shipdate as _extracted_at
      from lineitem""",
    "staging_label_snapshots": """
      select source || '-' || d.doc_id as issue_id, concat_ws(':', lang, quality::varchar) as label,
             date '2024-01-31' as snapshot_date, timestamp '2024-01-31' as _extracted_at
      from documents d left join labels l on l.doc_id = d.doc_id""",
    "latest_snapshot_dim": f"""
      select issue_id, title, status, issue_type, priority, assignee, created_at, closed_at,
             date_diff('second', created_at, closed_at) / 3600.0::double as cycle_time_hours,
             description, design, acceptance_criteria, notes, close_reason
      from ({_SNAPSHOTS}) where snapshot_date = (select max(o_orderdate)::date from orders)""",
    "scd2_customer_orders": _SCD2,
    "event_fact": f"""
      select event_id, issue_id, event_type, actor, created_at, created_date_local, c_mktsegment as issue_type,
             created_date_local as dt
      from ({_STAGED_EVENTS}) left join customer on issue_id = 'usr-' || c_custkey""",
    "daily_throughput": f"""
      with o as ({_ORDER_CLOSINGS}),
      born as (select timezone('Australia/Sydney', timezone('UTC', o_orderdate))::date as dt, count(*) as n from o group by 1),
      done as (select timezone('Australia/Sydney', timezone('UTC', closed_at))::date as dt, count(*) as n
               from o where closed_at is not null group by 1),
      seen as (select timezone('Australia/Sydney', timezone('UTC', l_shipdate))::date as dt, count(*) as n from lineitem group by 1)
      select dt, coalesce(born.n, 0) as issues_created, coalesce(done.n, 0) as issues_closed, coalesce(seen.n, 0) as events
      from born full join done using (dt) full join seen using (dt)""",
    "hourly_actor_activity": """
      with roles as (
        select date_trunc('hour', ts) as hour_utc, event_type = 'purchase' as is_commit,
               case when event_type <> 'error' then 'actor-' || user_id end as actor
        from events)
      select hour_utc, actor, count(*) filter (not is_commit and actor is not null) as events,
             count(*) filter (is_commit) as commits,
             timezone('Australia/Sydney', timezone('UTC', hour_utc))::date as dt
      from roles group by hour_utc, actor""",
    "mention_drift": f"""
      with m as ({_LINE_MENTIONS}),
      e as (select 'ord-' || l_orderkey as a, 'ord-' || l_suppkey as b from lineitem)
      select issue_id, mentioned_issue_id, sum(mention_count)::bigint as mention_count,
             count(distinct field) as field_count,
             mentioned_issue_id in (select 'ord-' || o_orderkey from orders) as mentioned_issue_exists
      from m
      where not exists (select 1 from e where a = issue_id and b = mentioned_issue_id)
        and not exists (select 1 from e where b = issue_id and a = mentioned_issue_id)
      group by issue_id, mentioned_issue_id""",
    "mart_rebuild": """
      select event_type, count(*) as n_events, ts::date as dt from events group by all""",
    "text_unpivot": _UNPIVOTED,
    "id_prefixes": "select distinct split_part('ord-' || l_orderkey, '-', 1) as prefix from lineitem",
    "mentions_lines": _LINE_MENTIONS,
    "mentions_documents": _DOCUMENT_MENTIONS,
    "mentions_many_prefixes": """
      select 'p' || doc_id || '-x' as issue_id, 'p' || (doc_id + 1) || '-y' as mentioned_issue_id, 'title' as field,
             1 as mention_count
      from documents where doc_id + 1 in (select doc_id from documents)""",
    "mentions_deep_ids": """
      select 'sup-' || s_suppkey as issue_id, 'sup-' || (s_suppkey + 1) || repeat('.1', 20000) as mentioned_issue_id,
             'title' as field, 1 as mention_count
      from supplier""",
    "dq_unique": """
      select l_orderkey || '|' || l_linenumber as unique_field, count(*) as n_records from lineitem
      group by 1 having count(*) > 1""",
    "dq_not_null": """
      select event_id, props from events where coalesce(json_extract_string(props, '$.k')::bigint, 90) >= 90""",
    "dq_accepted_values": """
      select event_type as value_field, count(*) as n_records from events
      where event_type not in ('view', 'click', 'purchase') group by 1""",
    "dq_relationships": """
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem
      where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""",
    "dq_relationships_cutoff": """
      select l_orderkey, l_linenumber, l_partkey, l_shipdate from lineitem
      where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')
        and l_shipdate < (select max(o_orderdate) - interval 60 days from orders where o_orderstatus = 'F')""",
    "dq_event_created_matches": """
      select l_orderkey || '|' || l_linenumber || '|' || l_partkey as event_id, o_orderkey as issue_id,
             l_shipdate as event_created_at, o_orderdate as issue_created_at,
             abs(date_diff('second', l_shipdate, o_orderdate)) as diff_seconds
      from lineitem join orders on o_orderkey = l_orderkey
      where l_returnflag = 'N' and abs(date_diff('second', l_shipdate, o_orderdate)) > 90 * 86400""",
    "dq_not_closed_before_created": f"""
      select o_orderkey, o_orderdate as created_at, closed_at from ({_ORDER_CLOSINGS}) where closed_at < o_orderdate""",
    "dq_scd2_one_current": f"""
      select part, count(*) filter (is_current) as current_count from ({_INTERVALS})
      group by part having count(*) filter (is_current) <> 1""",
    "dq_scd2_valid_to": f"""
      select part, valid_from, valid_to, is_current from ({_INTERVALS}) where (valid_to is null) <> is_current""",
    "dq_scd2_no_overlap": f"""
      with i as (select rid, part, valid_from, coalesce(valid_to, date '9999-12-31') as valid_to from ({_INTERVALS})),
      worst as (
        select b.rid, b.part, max((a.valid_to, a.valid_from)) as w, any_value(b.valid_from) as b_valid_from,
               any_value(b.valid_to) as b_valid_to
        from i a join i b on a.part = b.part and a.valid_from < b.valid_from and a.valid_to > b.valid_from
        group by b.rid, b.part)
      select part, w[2] as a_valid_from, w[1] as a_valid_to, b_valid_from, b_valid_to from worst""",
    "assertion_results": f"""
      with history as ({_SCD2}),
      counts(name, severity, failures) as (
        select 'orders_unique', 'error', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)
        union all
        select 'lines_unique', 'error', count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)
        union all
        select 'event_types', 'warn', count(distinct event_type) from events where event_type not in ('view', 'click')
        union all
        select 'lines_have_orders', 'error', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
        union all
        select 'scd2_one_current', 'error', count(*)
        from (select o_custkey from history group by 1 having count(*) filter (is_current) <> 1)
        union all
        select 'scd2_valid_to', 'error', count(*) from history where (valid_to is null) <> is_current
        union all
        select 'scd2_has_start', 'error', count(*) from history where valid_from is null
        union all
        select 'scd2_no_overlap', 'error', count(*)
        from history a join history b on a.o_custkey = b.o_custkey and a.valid_from < b.valid_from
          and coalesce(a.valid_to, date '9999-12-31') > b.valid_from)
      select *, case when failures = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end as status
      from counts""",
    "freshness_status": """
      with newest(table_name, max_loaded_at, warn_s, error_s) as (
        select 'events', max(ts), 6 * 3600, 48 * 3600 from events
        union all select 'orders', max(o_orderdate), 48 * 3600, 30 * 86400 from orders
        union all select 'lineitem', max(l_shipdate), 9000 * 86400, 9900 * 86400 from lineitem)
      select table_name, max_loaded_at,
             (epoch_us(timestamp '2024-02-01 12:00:00') - epoch_us(max_loaded_at)) / 1e6::double as age_seconds,
             case when max_loaded_at is null or age_seconds > error_s then 'error'
                  when age_seconds > warn_s then 'warn' else 'pass' end as status
      from newest""",
    "ledger_summary": f"""
      select 'run-1' as run_id, 'app' as source, table_name, 'raw' as zone, count(*) as windows,
             count(error) as failed_windows, coalesce(sum(n_rows) filter (error is null), 0)::bigint as n_rows,
             coalesce(sum(bytes) filter (error is null), 0)::bigint as bytes
      from ({_LAST_ATTEMPT}) group by table_name""",
    "failed_windows": f"""
      select 'run-1' as run_id, 'app' as source, table_name, 'raw' as zone, window_start, error
      from ({_LAST_ATTEMPT}) where error is not null""",
    "write_counters": f"""
      select 'app' as source, table_name, 'raw' as zone, sum(n_rows)::bigint as n_rows, sum(bytes)::bigint as bytes
      from ({_LEDGER}) where error is null group by table_name""",
    "duration_histogram": """
      select event_type as step, case when user_id % 2 = 0 then 'success' else 'failure' end as outcome,
             (case when v <= 0 then 0 when v <= 5 then 5 when v <= 10 then 10 when v <= 25 then 25 when v <= 50 then 50
                   when v <= 75 then 75 when v <= 100 then 100 when v <= 250 then 250 when v <= 500 then 500
                   when v <= 750 then 750 when v <= 1000 then 1000 when v <= 2500 then 2500 when v <= 5000 then 5000
                   when v <= 7500 then 7500 when v <= 10000 then 10000 end)::bigint as upper_bound,
             count(*) as n, sum(v)::double as total_seconds
      from (select *, value::decimal(18, 2) as v from events) group by 1, 2, 3""",
    "run_results_nodes": _NODES,
    "run_results_status_counts": f"""
      select resource_type, status, count(*) as n_nodes from ({_NODES}) group by all""",
    "run_results_failed": f"""
      select invocation_id, unique_id, status, message, failures from ({_NODES}) where is_failed""",
    "build_totals": f"""
      select 'pass' as kind, 'pass of ' || resource_type as step, count(*) as nodes, count(*) filter (is_failed) as failed,
             null::bigint as n_rows, null::bigint as bytes
      from ({_NODES}) group by resource_type
      union all
      select 'transform', table_name, null, count(error), coalesce(sum(n_rows) filter (error is null), 0)::bigint,
             coalesce(sum(bytes) filter (error is null), 0)::bigint
      from ({_LAST_ATTEMPT}) group by table_name""",
}
