"""Logical operations tables, derived from the given tables.

Each text runs unchanged on Spark and on DuckDB; ``{name}`` stands for a given table.
Nulls, ties and unparsable values are introduced here on purpose.
"""

from __future__ import annotations

LOGICAL: dict[str, str] = {
    "fx_job_periods": """
select cast(run_id % 5 as string) as workspace_id, case when run_id % 7 = 0 then 1 else (run_id * run_id) % 97 end as job_id, run_id, ts as period_end_time,
  case when event_id % 11 = 0 then 'SUBMIT_RUN' else 'JOB_RUN' end as run_type,
  case when event_id % 13 = 0 then null when event_type = 'purchase' then 'SUCCEEDED' when event_type = 'view' then 'FAILED'
       when event_type = 'click' then 'ERROR' when event_type = 'error' then 'TIMEDOUT'
       when event_id % 3 = 0 then 'CANCELLED' when event_id % 3 = 1 then 'BLOCKED' else 'SKIPPED' end as result_state,
  case when event_type = 'purchase' then 'SUCCESS' when event_id % 19 = 0 then null when event_id % 3 = 0 then 'RUN_EXECUTION_ERROR'
       else split_part('INTERNAL_ERROR,CLOUD_FAILURE,CLUSTER_ERROR,DRIVER_ERROR,INVALID_RUN_CONFIGURATION,INVALID_CLUSTER_REQUEST,RESOURCE_NOT_FOUND,REPOSITORY_CHECKOUT_FAILED,LIBRARY_INSTALLATION_ERROR,FEATURE_DISABLED,UNAUTHORIZED_ERROR,STORAGE_ACCESS_ERROR,MAX_CONCURRENT_RUNS_EXCEEDED,MAX_JOB_QUEUE_SIZE_EXCEEDED,WORKSPACE_RUN_LIMIT_EXCEEDED,CLUSTER_REQUEST_LIMIT_EXCEEDED,MAX_SPARK_CONTEXTS_EXCEEDED,USER_CANCELLED,SOMETHING_NEW', ',', cast(1 + event_id % 19 as int)) end as termination_code
from (select event_id, event_type, ts, cast(floor(event_id / 2) as bigint) as run_id from {events}) e
""",
    "fx_jobs": """
select cast(o_orderkey % 5 as string) as workspace_id, o_custkey % 97 as job_id, o_orderdate as change_time, concat('job_', cast(o_orderkey as string)) as name from {orders}
""",
    "fx_workspaces": """
select cast(n_nationkey + 1 as string) as workspace_id, n_name as workspace_name from {nation}
""",
    "fx_task_errors": """
select run_id, case when run_id % 7 = 0 then 1 else (run_id * run_id) % 97 end as job_id, concat('task_', cast(event_id % 2 as string)) as task_key,
  case when event_id % 4 = 0 then null else 'Workload failed, see run output for details' end as state_message,
  case when event_id % 7 = 0 then null when event_id % 23 = 0 then '[get-output unavailable: Timeout]' else
  split_part('task was skipped because not all its dependencies succeeded|Refer to the logs for this pipeline|Python kernel is unresponsive|Pyspark RDDs not allowed on serverless|UNRESOLVED_COLUMN: a cannot be resolved|Path does not exist: /x|java heap space|deadline exceeded|403 Forbidden|experiment tag is missing or empty|widget is required|NoneType has no attribute|No module named foo|Malformed record|Duplicate primary key|JDBC refused|quota reached|KeyError: k|something odd', '|', cast(1 + event_id % 19 as int)) end as error,
  case when event_id % 5 = 0 then 'java.lang.OutOfMemoryError' else null end as resolved_error
from (select event_id, cast(floor(event_id / 2) as bigint) as run_id from {events}) e
""",
    "fx_query_history": """
select event_id as statement_id, case when event_id % 29 = 0 then null else concat('wh_', cast(user_id % 4 as string)) end as warehouse_id,
  concat('user_', cast(user_id as string)) as executed_by,
  case when event_type in ('view', 'click') then concat('space_', cast(user_id % 3 as string)) else null end as space_id,
  concat('app_', cast(event_id % 3 as string)) as client_application,
  case when event_type = 'error' then 'FAILED' else 'FINISHED' end as execution_status,
  cast(floor(value * 1000) as bigint) as total_duration_ms, cast(floor(value * 4000) as bigint) as total_task_duration_ms,
  cast(floor(value * 1000000) as bigint) as read_bytes, ts as start_time, ts as update_time
from {events}
""",
    "fx_usage": """
select cast(user_id % 5 as string) as workspace_id, case when hour(ts) = 3 then null else concat('wh_', cast(user_id % 4 as string)) end as warehouse_id,
  concat('cl_', cast(user_id % 20 as string)) as cluster_id, case when event_id % 3 = 0 then null else user_id % 97 end as job_id,
  concat('ep_', cast(user_id % 40 as string)) as endpoint_id, 'AZURE' as cloud,
  case event_type when 'purchase' then 'PREMIUM_JOBS_COMPUTE' when 'view' then 'PREMIUM_ALL_PURPOSE_COMPUTE' when 'click' then 'PREMIUM_SQL_PRO'
    when 'signup' then 'PREMIUM_MODEL_SERVING' else 'PREMIUM_MODEL_INFERENCE' end as sku_name,
  case event_type when 'purchase' then 'JOBS' when 'view' then 'ALL_PURPOSE' when 'click' then 'SQL' else 'MODEL_SERVING' end as billing_origin_product,
  'DBU' as usage_unit, floor(value * 100) / 10000 as usage_quantity, ts as usage_start_time, ts as usage_end_time, cast(ts as date) as usage_date
from {events}
""",
    "fx_prices": """
select 'AZURE' as cloud, sku_name, 'DBU' as usage_unit, 'USD' as currency_code, price as price_default,
  case when r_regionkey = 1 then null else price * 0.9 end as price_effective,
  cast(start_s as timestamp) as price_start_time, cast(end_s as timestamp) as price_end_time
from (
  select r_regionkey, split_part('PREMIUM_JOBS_COMPUTE,PREMIUM_ALL_PURPOSE_COMPUTE,PREMIUM_SQL_PRO,PREMIUM_MODEL_SERVING,PREMIUM_MODEL_INFERENCE', ',', cast(1 + r_regionkey as int)) as sku_name,
    cast(r_regionkey + 1 as double) / 8 as price, '2023-01-01 00:00:00' as start_s, '2024-01-15 00:00:00' as end_s from {region}
  union all
  select r_regionkey, split_part('PREMIUM_JOBS_COMPUTE,PREMIUM_ALL_PURPOSE_COMPUTE,PREMIUM_SQL_PRO,PREMIUM_MODEL_SERVING,PREMIUM_MODEL_INFERENCE', ',', cast(1 + r_regionkey as int)),
    cast(r_regionkey + 1 as double) / 4, case when r_regionkey = 4 then '2030-01-01 00:00:00' else '2024-01-15 00:00:00' end, cast(null as string) from {region}) p
""",
    "fx_warehouses": """
select concat('wh_', cast(user_id % 4 as string)) as warehouse_id, concat('warehouse ', cast(user_id % 4 as string)) as warehouse_name, 'PRO' as warehouse_type,
  split_part('SMALL,MEDIUM,LARGE', ',', cast(1 + event_id % 3 as int)) as warehouse_size, 1 + event_id % 2 as min_clusters, 3 + event_id % 5 as max_clusters,
  10 * (1 + event_id % 6) as auto_stop_minutes, ts as change_time
from {events} where event_type = 'signup'
""",
    "fx_node_timeline": """
select cast(user_id % 5 as string) as workspace_id, concat('cl_', cast(user_id % 20 as string)) as cluster_id, concat('i_', cast(user_id as string)) as instance_id,
  event_id % 5 = 0 as driver, ts as start_time,
  case when event_id % 17 = 0 then null else cast(floor(value) as bigint) % 25 + case when user_id % 20 in (2, 3) then 0 else (user_id % 20) * 4 end end as cpu_user_percent,
  event_id % 15 as cpu_system_percent, (event_id * 7) % 40 + case when user_id % 20 = 3 then 45 else (user_id % 20) * 3 end as mem_used_percent, case when user_id % 20 = 7 then event_id % 12 else 0 end as mem_swap_percent
from {events}
""",
    "fx_clusters": """
select cast(o_custkey % 5 as string) as workspace_id, concat('cl_', cast(o_custkey % 22 as string)) as cluster_id, concat('cluster ', cast(o_custkey % 22 as string)) as cluster_name,
  concat('owner_', cast(o_custkey % 4 as string)) as owned_by, split_part('UI,API,JOB', ',', cast(1 + o_custkey % 3 as int)) as cluster_source,
  concat('type_', cast(o_orderkey % 3 as string)) as driver_node_type, concat('type_', cast(o_orderkey % 4 as string)) as worker_node_type, case when o_custkey % 2 = 0 then 1 + o_orderkey % 9 else null end as worker_count,
  case when o_custkey % 2 = 1 then 1 + o_orderkey % 2 else null end as min_autoscale_workers, case when o_custkey % 2 = 1 then 2 + o_orderkey % 6 else null end as max_autoscale_workers,
  case when o_orderkey % 5 = 0 then null else 30 * (1 + o_orderkey % 6) end as auto_termination_minutes, case when o_orderkey % 50 = 0 then o_orderdate else null end as delete_time, o_orderdate as change_time, o_orderkey as o_key
from {orders}
""",
    "fx_node_types": """
select concat('type_', cast(r_regionkey + 1 as string)) as node_type, 4 * (1 + r_regionkey) as core_count, 16384 * (1 + r_regionkey) as memory_mb from {region}
""",
    "fx_endpoint_usage": """
select user_id as served_entity_id, concat('user_', cast(user_id as string)) as requester,
  case when event_type = 'error' and event_id % 2 = 0 then 429 when event_type = 'error' then 503 when event_id % 31 = 0 then 404 else 200 end as status_code,
  event_id % 3 = 0 as request_streaming, case when event_id % 37 = 0 then null else cast(floor(value * 10) as bigint) end as input_token_count,
  cast(floor(value) as bigint) as output_token_count, ts as request_time
from {events}
""",
    "fx_served_entities": """
select p_partkey as served_entity_id, concat('ep_', cast(p_partkey % 40 as string)) as endpoint_id, concat('endpoint ', cast(p_partkey % 40 as string)) as endpoint_name,
  case when p_partkey % 2 = 0 then 'CUSTOM_MODEL' else 'FOUNDATION_MODEL' end as entity_type, p_name as entity_name from {part}
""",
    "fx_table_history": """
select concat('t', cast(case when o_orderkey % 3 = 0 then 0 else o_custkey end as string)) as table_name, o_orderkey as version, o_orderdate as op_ts,
  split_part('WRITE,MERGE,DELETE,UPDATE,OPTIMIZE,VACUUM START,VACUUM END,CREATE TABLE,RESTORE', ',', cast(1 + case when o_custkey % 40 < 8 and o_orderkey % 9 in (5, 6) then 0 else o_orderkey % 9 end as int)) as operation,
  concat('user_', cast(o_custkey % 7 as string)) as user_name,
  case when o_orderkey % 9 in (0, 4) then case when o_orderkey % 45 = 0 then 'n/a' else cast(9 * (o_orderkey % 11) as string) end else null end as m_removed,
  case when o_orderkey % 9 = 1 then cast(o_orderkey % 5 as string) else null end as m_target_removed,
  case when o_orderkey % 9 in (0, 1, 4) then cast(o_orderkey % 13 as string) else null end as m_added,
  case when o_orderkey % 9 = 0 then cast(o_orderkey * 3 as string) else null end as m_rows
from {orders}
""",
    "fx_table_detail": """
select concat('t', cast(c_custkey as string)) as table_name, concat('s', cast(c_custkey % 3 as string)) as schema_name,
  split_part('EXTERNAL,MANAGED,VIEW', ',', cast(1 + c_custkey % 3 as int)) as table_type, split_part('DELTA,delta,PARQUET', ',', cast(1 + c_custkey % 4 % 3 as int)) as data_source_format,
  concat(split_part('dbfs:/mnt/raw/ abfss://c@acc.dfs/ dbfs:/user/hive/warehouse/ s3://b/ dbfs:/x/ wasbs://c@acc.blob/', ' ', cast(1 + c_custkey % 6 as int)), cast(c_custkey as string)) as location,
  (c_custkey * 37) % 400 as num_files, c_custkey * 7000000000 as size_in_bytes, case when c_custkey % 3 = 0 then 'ds' else '' end as partition_columns,
  case when c_custkey % 5 = 0 then 'id' else '' end as clustering_columns, cast('2001-01-01 00:00:00' as timestamp) as last_modified
from {customer}
""",
    "fx_storage_metrics": """
select concat('t', cast(c_custkey + 2 as string)) as table_name, 'total_bytes' as metric_name, c_custkey * 7000000000.0e0 as metric_value from {customer}
union all select concat('t', cast(c_custkey + 2 as string)), 'active_bytes', c_custkey * 2000000000.0e0 from {customer}
union all select concat('t', cast(c_custkey + 2 as string)), 'vacuumable_bytes', case when c_custkey % 6 = 0 then null else c_custkey * 100000000.0e0 * (c_custkey % 50) end from {customer}
union all select concat('t', cast(c_custkey + 2 as string)), 'time_travel_bytes', c_custkey * 1000000.0e0 from {customer}
""",
    "fx_table_props": """
select concat('t', cast(2 * c_custkey as string)) as table_name, 'delta.enableDeletionVectors' as prop_key, concat('v', cast(c_custkey % 3 as string)) as prop_value from {customer}
union all select concat('t', cast(2 * c_custkey as string)), 'delta.logRetentionDuration', concat('v', cast(c_custkey % 3 as string)) from {customer}
union all select concat('t', cast(2 * c_custkey as string)), 'delta.appendOnly', concat('v', cast(c_custkey % 3 as string)) from {customer}
""",
    "fx_report_config": """
select concat('r', cast(s_suppkey as string)) as report_id, s_name as report_name, case s_suppkey % 3 when 0 then 'ALL' when 1 then 'any' else null end as refresh_mode,
  case when s_suppkey % 4 = 0 then cast(60 * (1 + s_suppkey % 5) as int) else null end as dependency_window_minutes, s_suppkey % 9 <> 0 as enabled from {supplier}
""",
    "fx_report_dependencies": """
select distinct concat('r', cast(case when l_suppkey % 10 = 3 then l_suppkey + 1 else l_suppkey end as string)) as report_id, concat('Cat.Sch.T', cast((l_suppkey * 7 + l_partkey % 4) % 30 as string)) as source_table from {lineitem}
""",
    "fx_table_state": """
select concat('cat.sch.t', cast(user_id % 26 as string)) as source_table, max(ts) as last_updated_ts, 'seed' as last_run_id from {events} group by user_id % 26
""",
    "fx_report_state": """
select concat('r', cast(2 * (user_id % 50) as string)) as report_id, case when user_id % 50 % 2 = 0 then max(ts) else min(ts) end as last_refresh_ts, 'seed' as last_refresh_run_id from {events} group by user_id % 50
""",
    "fx_updates": """
select event_id as run_id, case when event_id % 50 = 0 then 'not json' when event_id % 51 = 0 then '' else concat('["Cat.Sch.T', cast(user_id % 30 as string), '", " cat.sch.t', cast(event_id % 30 as string), ' "]') end as updated_tables from {events}
""",
    "fx_dry_run": """
select concat('t', cast(c_custkey as string)) as table_name, case when c_custkey % 7 = 0 or c_custkey % 5 = 4 then null else (c_custkey * 13) % 2000 end as dry_run_files,
  case when c_custkey % 7 = 0 then 'Timeout' else null end as dry_run_error
from {customer}
""",
    "fx_update_events": """
select event_id as run_id, ts as observed_ts, case when event_id % 50 = 0 then 'not json' when event_id % 51 = 0 then '' else concat('["Cat.Sch.T', cast(user_id % 30 as string), '", " cat.sch.t', cast(event_id % 30 as string), ' "]') end as updated_tables
from {events}
""",
    "fx_emissions": """
select event_id as statement_id, event_type as status, value as amount, ts as update_time from {events}
union all select event_id, 'corrected', value + 1, ts + interval '1' hour from {events} where event_type = 'purchase'
union all select event_id, 'stale', value - 1, ts - interval '1' hour from {events} where event_type = 'view'
union all select event_id, event_type, value, ts from {events} where event_type in ('click', 'view')
union all select event_id, 'undated', value, cast(null as timestamp) from {events} where event_type in ('error', 'purchase')
""",
    "fx_runs": """
select run_id, concat('https://h/run/', cast(run_id as string)) as run_page_url
from (select distinct case when floor(event_id / 2) % 9 = 0 then -1 else 1 end * cast(floor(event_id / 2) as bigint) as run_id from {events}) r
""",
    "fx_tasks": """
select case when run_id % 6 = 5 or run_id % 9 = 0 then -1 - run_id else run_id end as run_id, concat('task_', cast(event_id % 2 as string)) as task_key, event_id as task_order, event_id + 1000000000000 as task_run_id,
  case event_id % 4 when 0 then 'FAILED' when 1 then 'SUCCESS' when 2 then 'TIMEDOUT' else null end as result_state,
  case when event_id % 4 = 0 then null when event_id % 12 = 1 then '' else 'Workload failed, see run output for details' end as state_message,
  case when event_id % 10 = 3 then concat('pl_', cast(event_id % 40 as string)) else null end as pipeline_id
from (select event_id, cast(floor(event_id / 2) as bigint) as run_id from {events}) e
""",
    "fx_outputs": """
select case when event_id % 17 = 0 then -1 else 1 end * (event_id + 1000000000000) as run_id,
  case event_id % 8 when 0 then concat('Workload failed, see run output for details: https://h/jobs/7/runs/', lpad(cast(cast(floor(event_id / 3) as bigint) as string), 7, '0'))
    when 1 then 'com.x.NotebookExecutionException: FAILED' when 2 then 'Pipeline execution failed' when 3 then null
    when 4 then concat('ValueError: bad input ', cast(event_id as string)) when 5 then '' when 6 then 'WorkflowException: child'
    else 'java.lang.OutOfMemoryError' end as error,
  case when event_id % 8 = 1 then concat('at https://h/runs/1111 and https://h/?runId=', lpad(cast(cast(floor(event_id / 5) as bigint) as string), 7, '0')) else 'trace' end as error_trace,
  case when event_id % 3 = 0 then 'see run output for details' else null end as state_message,
  case when event_id % 8 = 6 then cast(floor(event_id / 4) as bigint) else null end as child_run_id
from {events}
union all
select case when run_id % 7 = 0 then -1 else 1 end * run_id, case run_id % 5 when 0 then concat('workload failed, see run output: #job/1/run/', lpad(cast(cast(floor(run_id / 2) as bigint) as string), 7, '0'))
    when 1 then null when 2 then 'KeyError: k' when 3 then 'childPipelineFailed' else '[skipped]' end,
  'trace', null, null
from (select distinct cast(floor(event_id / 2) as bigint) as run_id from {events}) r
""",
    "fx_event_log": """
select concat('pl_', cast(event_id % 40 as string)) as pipeline_id, event_id as event_seq, ts as event_ts,
  case when event_id % 40 < 20 and event_id % 3 = 0 then 'ERROR' else 'INFO' end as level,
  case when event_id % 40 = 13 then null else concat('flow failed ', cast(event_id as string)) end as message,
  case when event_id % 40 < 30 and event_id % 5 = 3 then '{{"flow_progress":{{"status":"FAILED"}}}}'
    when event_id % 7 = 0 and event_id % 40 < 35 then '{{"update_progress":{{"state":"FAILED"}}}}' else '{{}}' end as details
from {events}
""",
    "fx_describe_rows": """
select concat('o', cast(l_orderkey as string)) as object, l_linenumber as ord,
  case l_linenumber when 1 then ' id ' when 2 then 'ds' when 3 then '# Partition Information' when 4 then 'ds' when 5 then ''
    when 6 then '# Detailed Table Information' else 'Location' end as col_name,
  case l_linenumber when 7 then concat(' dbfs:/x/', cast(l_partkey as string)) else 'bigint' end as data_type,
  case when l_partkey % 3 = 0 then null else 'note' end as comment
from {lineitem}
""",
    "fx_mounts": """
select concat('/mnt/n', cast(n_nationkey as string), case when n_nationkey % 2 = 0 then '/' else '' end) as mount_point,
  concat(split_part('abfss://c@acc.dfs.core|abfs://c@acc.dfs.core|wasbs://c@acc.blob.core.net|adl://acc.lake|WASB://plain|s3://b', '|', cast(1 + n_nationkey % 6 as int)), '/n', cast(n_nationkey as string)) as source from {nation}
union all select concat('/mnt/n', cast(r_regionkey as string), '/deep'), concat('abfss://d@acc.dfs.core/r', cast(r_regionkey as string)) from {region}
union all select concat('/data-', cast(r_regionkey as string)), 'dbfs-root' from {region}
""",
    "fx_inventory": """
select concat('S', cast(p_partkey % 5 as string)) as src_schema, concat('t', cast(p_partkey as string)) as table_name,
  split_part('managed,EXTERNAL,EXTERNAL,VIEW', ',', cast(1 + p_partkey % 4 as int)) as table_type,
  split_part('Delta,parquet,csv,hive', ',', cast(1 + p_size % 4 as int)) as provider,
  concat(case p_partkey % 7 when 0 then concat('dbfs:/mnt/n', cast(p_size as string), '/') when 1 then 'dbfs:/mnt/n1/deep/' when 2 then 'dbfs:/mnt/n2/deepest/'
    when 3 then 'dbfs:/user/hive/warehouse/' when 4 then 'dbfs:/Volumes/a/b/' when 5 then concat('dbfs:/mnt/n', cast(p_partkey % 25 as string), '/x/') else 'abfss://c@acc.dfs/' end, p_name) as location,
  case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then concat('This table is deprecated. Please use main.s.t instead of h.s.t. ', p_name) else p_name end as comment,
  p_partkey % 6 = 0 as target_exists
from {part}
""",
    "fx_views": """
select concat('S', cast(s_suppkey % 4 as string)) as src_schema, concat('v', cast(s_suppkey as string)) as view_name,
  case s_suppkey % 6 when 0 then concat('select * from Hive_Metastore.S1.t', cast(s_suppkey as string), ' -- from hive_metastore.S1.x')
    when 1 then concat('select a.b from S2.t', cast(s_suppkey as string), ' a join `spark_catalog`.`S1`.`t 4` on a.x = 1')
    when 2 then concat('select "it is from S1.t" as c, /* join S2.t */ 1 from S9.t', cast(s_suppkey as string))
    when 3 then concat('select * from other.S1.t', cast(s_suppkey as string), ', hive_metastore.S3.u')
    when 4 then concat('select * from S9.a x, S1.t', cast(s_suppkey as string)) else concat('select x from `S1` . t', cast(s_suppkey as string)) end as view_text
from {supplier}
""",
    "fx_view_edges": """
select concat('v', cast(s_suppkey as string)) as view, concat('v', cast(cast(floor(s_suppkey / 3) as bigint) as string)) as depends_on from {supplier}
union all select concat('v', cast(s_suppkey + 1 as string)), concat('base', cast(s_nationkey as string)) from {supplier}
union all select concat('w', cast(s_suppkey as string)), concat('w', cast(cast(floor(s_suppkey / 3) as bigint) - 1 as string)) from {supplier}
""",
    "fx_ddl": """
select p_partkey, p_name, concat('main.`s`.`t', cast(p_partkey as string), '`') as target, concat('abfss://c@acc.dfs/$1/', p_name) as cloud_path,
  concat(case p_partkey % 3 when 0 then 'CREATE TABLE hive_metastore.s.t' when 1 then ' create external table `a b`.t' else 'CREATE VIEW v' end, cast(p_partkey as string),
    ' (id INT)', chr(10), 'USING csv', chr(10), case when p_partkey % 5 = 4 then 'COMMENT' else 'LOCATION' end, ' ', chr(39), 'dbfs:/mnt/x/', p_name, chr(39), chr(10), 'LOCATION ', chr(39), 'second', chr(39)) as ddl
from {part}
""",
    "fx_users": """
select concat('u', cast(c_custkey as string)) as id, lower(c_name) as user_name, case when c_custkey % 7 = 0 then null else c_name end as display_name,
  case when c_custkey % 11 = 0 then null else c_mktsegment end as family_name, c_acctbal > 0 as active, concat(lower(c_name), '@x') as emails from {customer}
""",
    "fx_users_replica": """
select concat('R', cast(c_custkey as string)) as id, case when c_custkey % 3 = 0 then c_name else lower(c_name) end as user_name from {customer}
""",
    "fx_spns": """
select concat('s', cast(s_suppkey as string)) as id, concat('app-', cast(s_suppkey as string)) as application_id,
  case when s_suppkey % 4 = 0 then null else s_name end as display_name from {supplier}
""",
    "fx_spns_replica": """
select concat('Q', cast(s_suppkey as string)) as id, concat(case when s_suppkey % 5 = 0 then 'other-' else 'app-' end, cast(s_suppkey as string)) as application_id from {supplier}
""",
    "fx_groups": """
select concat('g', cast(o_orderkey as string)) as id, case when o_orderkey % 20 = 0 then '' else concat('group ', cast(o_orderkey as string)) end as display_name from {orders}
""",
    "fx_groups_replica": """
select concat('H', cast(o_orderkey as string)) as id, concat(case when o_orderkey % 4 = 0 then 'old ' else 'group ' end, cast(o_orderkey as string)) as display_name from {orders}
""",
    "fx_members": """
select concat('g', cast(case when l_orderkey % 3 = 0 then 1 else l_orderkey end as string)) as group_id, l_orderkey * 10 + l_linenumber as position,
  case l_linenumber when 1 then concat('u', cast(l_partkey as string)) when 2 then concat('s', cast(l_suppkey as string)) when 3 then concat('g', cast(l_orderkey + 1 as string))
    when 4 then concat('u', cast(l_suppkey as string)) when 5 then '' when 6 then concat('zz', cast(l_partkey as string)) else concat('s', cast(l_suppkey as string)) end as value,
  case l_linenumber when 1 then 'Users/1' when 3 then 'Groups/1' when 6 then 'Users/9' when 7 then 'Users/2' else null end as ref
from {lineitem}
""",
    "fx_config_lines": """
select case when block % 3 = 0 then 'big' else concat('f', cast(block % 100 as string)) end as file, event_id as line_no,
  case part when 0 then concat('resource "x_sql_table" "t', cast(block as string), '" {{')
    when 1 then case when user_id % 4 = 0 then '  table_type = "MANAGED"' when user_id % 9 = 0 then '  view_definition = "select 1"' else '  table_type = "EXTERNAL"' end
    when 2 then concat('  depends_on = [x_grants.schema_', cast(user_id as string), ', x_schema.s', case when event_id % 2 = 0 then ']' else concat(' ,x_grants.schema_', cast(block as string), ' ] # end') end)
    when 3 then case when user_id % 3 = 0 then concat('depends_on=[ x_grants.schema_', cast(2 * user_id as string), ' ]') else '  properties = {{' end
    when 4 then case when block % 8 = 5 then '' else '}}' end when 5 then concat('# note ', cast(user_id as string)) else case when block % 5 = 0 then '  }}' else '  depends_on = []' end end as line
from (select event_id, user_id, cast(floor(event_id / 7) as bigint) as block, event_id % 7 as part from {events}) e
""",
    "fx_grant_lines": """
select 'grants' as file, s_suppkey as line_no, concat('resource "x_grants" "schema_', cast(2 * s_suppkey as string), '" {{') as line from {supplier}
union all select 'grants', s_suppkey + 1000000000000, '  schema = "x"' from {supplier}
""",
}
