"""Registered table-maintenance queries and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsight.operators import maintenance as m
from opsight.operators import versions as v
from opsight.plans import expected as e
from opsight.plans.common import Inputs, Query, oracle, query, round_raw
from opsight.sources import platform as p

CATALOG, SCHEMA = "main", "s"
SCHEMAS = ["s0", "s1", "s9"]


def _as_of(t: Inputs):
    return t.given("orders").agg(F.max("o_orderdate")).first()[0]


def history(t: Inputs):
    return p.table_history(p.mapped_history(t.logical("fx_table_history")))


def detail(t: Inputs):
    return p.table_detail(t.logical("fx_table_detail"))


def _removable(t: Inputs):
    return m.removable_since(history(t), m.last_vacuum(history(t)))


def _candidates(t: Inputs):
    scope = m.table_scope(detail(t))
    return m.vacuum_candidates(scope, detail(t), history(t), t.logical("fx_dry_run"), _as_of(t), CATALOG)


def _report(t: Inputs):
    metrics, props = t.logical("fx_storage_metrics"), t.logical("fx_table_props")
    return m.maintenance_report(metrics, detail(t), props, history(t), _as_of(t), CATALOG, SCHEMA)


def _versions(t: Inputs):
    return v.version_analysis(history(t), detail(t), _as_of(t))


def _failed(t: Inputs):
    scope = t.logical("fx_table_detail")
    steps = {
        "STORAGE_METRICS": t.logical("fx_storage_metrics"),
        "TBLPROPERTIES": t.logical("fx_table_props"),
        "HISTORY": t.logical("fx_table_history"),
    }
    return m.failed_steps(scope, steps)


def _storage(t: Inputs):
    return m.storage_ratios(m.storage_pivot(t.logical("fx_storage_metrics")))


def _class(t: Inputs):
    columns = ["table_name", "storage_type", "is_managed_storage", "is_mount_point"]
    return v.with_storage_class(detail(t)).select(*columns)


QUERIES: dict[str, Query] = {
    "table_scope": query(lambda t: m.table_scope(detail(t), SCHEMAS).select("schema_name", "table_name")),
    "db_scope": query(
        lambda t: m.db_scope(detail(t).select("schema_name").distinct(), ["s0", "s1"], ["s1"])
    ),
    "missing_schemas": query(lambda t: m.missing_schemas(detail(t), SCHEMAS)),
    "last_vacuum": query(lambda t: m.last_vacuum(history(t))),
    "removable_files": query(_removable),
    "vacuum_candidates": query(_candidates),
    "top_candidates": query(lambda t: m.top_candidates(_candidates(t))),
    "failed_steps": query(_failed),
    "storage_pivot": query(lambda t: m.storage_pivot(t.logical("fx_storage_metrics"))),
    "storage_ratios": query(_storage),
    "detail_features": query(lambda t: m.detail_features(detail(t), _as_of(t))),
    "table_properties": query(lambda t: m.table_properties(t.logical("fx_table_props"))),
    "maintenance_history": query(lambda t: m.maintenance_history(history(t), _as_of(t))),
    "maintenance_report": query(_report),
    "storage_summary": query(lambda t: m.storage_summary(_report(t))),
    "top_reclaimable": query(lambda t: m.top_reclaimable(_report(t))),
    "needs_attention": query(lambda t: m.needs_attention(_report(t))),
    "feature_matrix": query(lambda t: m.feature_matrix(_report(t))),
    "staleness": query(lambda t: m.staleness(_report(t))),
    "file_size_assessment": query(lambda t: m.file_size_assessment(_report(t))),
    "version_analysis": query(_versions),
    "vacuum_priority": query(
        lambda t: _versions(t).select("table_name", "version_count", "potential_vacuum_files", "vacuum_priority")
    ),
    "storage_class": query(_class),
    "priority_summary": query(lambda t: v.priority_distribution(_versions(t))),
    "version_top10": query(lambda t: v.top_versions(_versions(t))),
    "version_statistics": query(lambda t: v.version_statistics(_versions(t))),
    "maintenance_commands": query(lambda t: v.maintenance_commands(_versions(t), CATALOG)),
}

_NOW = "(select max(o_orderdate) from orders)"
_GB = "1073741824.0"
LAST = """last_vacuum as (select table_name, max(case when operation = 'VACUUM END' then op_ts end) as last_vacuum_ts
  from fx_table_history group by table_name)"""
REMOVABLE = """removable as (select h.table_name,
  cast(sum(coalesce(try_cast(m_removed as bigint), 0) + coalesce(try_cast(m_target_removed as bigint), 0)) as bigint) as removable_files,
  count(*) as ops_since_last_vacuum from fx_table_history h left join last_vacuum l on h.table_name = l.table_name
  where h.operation not like 'VACUUM%' and (l.last_vacuum_ts is null or h.op_ts > l.last_vacuum_ts)
    and coalesce(try_cast(m_removed as bigint), try_cast(m_target_removed as bigint)) is not null group by h.table_name)"""
CANDIDATES = f"""joined as (select d.schema_name, d.table_name, d.size_in_bytes as size_bytes, d.num_files, l.last_vacuum_ts,
  (epoch_us({_NOW}) - epoch_us(l.last_vacuum_ts)) / 86400e6 as days_since_last_vacuum, l.last_vacuum_ts is not null as ever_vacuumed,
  cast(coalesce(r.ops_since_last_vacuum, 0) as int) as ops_since_last_vacuum,
  case when y.dry_run_files is not null then 'dry_run'
    when y.dry_run_error is not null then 'history_fallback (' || y.dry_run_error || ')' else 'history' end as estimation_method,
  coalesce(y.dry_run_files, r.removable_files, 0) as est_files_to_clean
  from fx_table_detail d left join last_vacuum l on d.table_name = l.table_name left join removable r on d.table_name = r.table_name
  left join fx_dry_run y on d.table_name = y.table_name where d.table_type = 'EXTERNAL' and upper(d.data_source_format) = 'DELTA'),
candidates as (select 'main' as catalog, schema_name as schema, table_name as "table", 'main.' || schema_name || '.' || table_name as full_name,
  true as is_delta, size_bytes, num_files, last_vacuum_ts, days_since_last_vacuum, ever_vacuumed, ops_since_last_vacuum,
  est_files_to_clean, estimation_method,
  est_files_to_clean * (1 + least(coalesce(days_since_last_vacuum, 30), 365) / 30.0) as candidate_score,
  concat_ws('; ', case when not ever_vacuumed then 'never vacuumed' else
      'last VACUUM ' || printf('%.1f', round(days_since_last_vacuum, 1)) || 'd ago' end,
    case when est_files_to_clean > 0 then '~' || format('{{:,}}', est_files_to_clean) || ' removable files' end,
    case when ops_since_last_vacuum > 0 then ops_since_last_vacuum
      || ' mutating op(s) since last VACUUM (VACUUM ops excluded to prevent double-counting)' end) as reason,
  cast(null as varchar) as error, {_NOW} as analyzed_at from joined)"""


def _pick(metric: str) -> str:
    return f"max(case when metric_name = '{metric}' then coalesce(metric_value, 0) end) as {metric}"


def _units(name: str, out: str) -> str:
    sizes = (("mb", "1048576.0", 2), ("gb", _GB, 4), ("tb", "1099511627776.0", 6))
    return ", ".join(f"round({name} / {size}, {digits}) as {out}_{unit}" for unit, size, digits in sizes)


PIVOT = f"""pivoted as (select table_name, {', '.join(_pick(x) for x in e.STORAGE_METRICS)} from fx_storage_metrics group by table_name)"""
RATIOS = f"""ratios as (select *, {_units('total_bytes', 'total')}, {_units('active_bytes', 'active')},
  {_units('vacuumable_bytes', 'vacuumable')}, {_units('time_travel_bytes', 'time_travel')}, {_units('vacuumable_bytes', 'space_saving')},
  round(case when total_bytes > 0 then vacuumable_bytes / total_bytes * 100 else 0 end, 2) as saving_pct,
  round(case when active_bytes > 0 then total_bytes / active_bytes else 0 end, 2) as bloat_ratio from pivoted)"""
DETAIL = f"""features as (select table_name, table_type, location, last_modified, num_files, size_in_bytes,
  data_source_format as format, partition_columns, clustering_columns, case when partition_columns = '' then 0 else 1 end as num_partitions,
  round(case when num_files > 0 then size_in_bytes / num_files / 1048576.0 else 0 end, 2) as avg_file_size_mb,
  case when partition_columns = '' then 'No' else 'Yes' end as is_partitioned,
  case when clustering_columns = '' then 'No' else 'Yes' end as has_liquid_clustering,
  cast(date_diff('day', cast(last_modified as date), cast({_NOW} as date)) as int) as days_since_last_modified from fx_table_detail)"""
PROPS = "props as (select table_name, " + ", ".join(
    f"coalesce(max(case when prop_key = '{key}' then prop_value end), 'not set') as {name}"
    for name, key in e.PROPERTY_COLUMNS.items()
) + " from fx_table_props group by table_name)"


def _since(ts: str, out: str) -> str:
    return f"cast(coalesce(date_diff('day', cast({ts} as date), cast({_NOW} as date)), -1) as int) as {out}"


HISTORY = f"""times as (select table_name, max(case when operation = 'OPTIMIZE' then op_ts end) as last_optimize,
  max(case when operation in ('VACUUM START', 'VACUUM END') then op_ts end) as last_vacuum,
  max(case when operation in ('WRITE', 'MERGE', 'DELETE', 'UPDATE', 'CREATE TABLE', 'CREATE TABLE AS SELECT') then op_ts end) as last_write_operation,
  cast(count_if(operation = 'OPTIMIZE') as bigint) as optimize_count_in_history,
  cast(count_if(operation = 'VACUUM END') as bigint) as vacuum_count_in_history, count(*) as total_versions_in_history
  from fx_table_history group by table_name),
upkeep as (select *, {_since('last_optimize', 'days_since_last_optimize')}, {_since('last_vacuum', 'days_since_last_vacuum')},
  {_since('last_write_operation', 'days_since_last_write')},
  case when vacuum_count_in_history > 0 then 'Yes' else 'No' end as vacuum_ever_run,
  case when optimize_count_in_history > 0 then 'Yes' else 'No' end as optimize_ever_run from times)"""
REPORT = """report as (select 'main' as catalog, 's' as schema, r.*, f.* exclude (table_name), p.* exclude (table_name), u.* exclude (table_name),
  case when vacuum_ever_run = 'No' and saving_pct > 20 then 'CRITICAL: VACUUM never run, high reclaimable space'
    when vacuum_ever_run = 'No' then 'WARNING: VACUUM has never been run' when days_since_last_vacuum > 30 then 'WARNING: VACUUM not run in 30+ days'
    when avg_file_size_mb < 8 and num_files > 100 then 'WARNING: Small file problem detected - run OPTIMIZE'
    when bloat_ratio > 3 then 'WARNING: High bloat ratio - run VACUUM' when saving_pct > 50 then 'INFO: >50% storage is reclaimable'
    else 'OK' end as recommendation
  from ratios r left join features f on r.table_name = f.table_name left join props p on r.table_name = p.table_name
  left join upkeep u on r.table_name = u.table_name)"""
CLASS = """classed as (select *, lower(location) as l, case when l like '%dbfs:/mnt/%' or l like '%/dbfs/mnt/%' then 'Azure Mount Point'
    when l like '%abfss://%' or l like '%wasbs://%' or l like '%wasb://%' then 'Azure External' else 'Managed' end as storage_type
  from fx_table_detail)"""
VERSIONS = f"""entries as (select *, coalesce(m_added, '0') as a, coalesce(m_removed, '0') as r,
  try_cast(a as bigint) is not null and try_cast(r as bigint) is not null as good from fx_table_history),
ops as (select table_name, string_agg(format('''{{}}'': {{}}', operation, n), ', ' order by newest desc) as ops from (
  select table_name, operation, count(*) as n, max(version) as newest from entries group by all) o group by table_name),
churn as (select table_name, count(*) as version_count,
  cast(sum(case when good then try_cast(a as bigint) else 0 end) as bigint) as total_files_added,
  cast(sum(case when good then try_cast(r as bigint) else 0 end) as bigint) as total_files_removed,
  max(version) as latest_version, arg_max(operation, version) as latest_operation, arg_max(user_name, version) as last_modified_by,
  max_by(op_ts, version) as last_modified_timestamp, min_by(op_ts, version) as oldest_version_timestamp,
  try_cast(arg_max_null(m_rows, version) as bigint) as latest_row_count from entries group by table_name having count(*) > 1),
versions as (select c.table_name, d.schema_name as database, d.location as table_location, d.storage_type,
  d.storage_type = 'Managed' as is_managed_storage, d.storage_type = 'Azure Mount Point' as is_mount_point, c.* exclude (table_name),
  cast(floor((epoch_us({_NOW}) - epoch_us(last_modified_timestamp)) / 86400e6) as int) as days_since_modification,
  cast(floor((epoch_us(last_modified_timestamp) - epoch_us(oldest_version_timestamp)) / 86400e6) as int) as version_span_days,
  d.size_in_bytes as table_size_bytes, case when d.size_in_bytes <> 0 then round(d.size_in_bytes / 1048576.0, 2) end as table_size_mb,
  total_files_removed as potential_vacuum_files, chr(123) || o.ops || chr(125) as operation_summary,
  case when version_count >= 5 and total_files_removed > 100 then 'HIGH' when version_count >= 5 and total_files_removed > 50 then 'MEDIUM'
    else 'LOW' end as vacuum_priority
  from churn c join classed d on c.table_name = d.table_name join ops o on c.table_name = o.table_name)"""

_D, _H = "fx_table_detail", "fx_table_history"
_R = "fx_storage_metrics fx_table_detail fx_table_props fx_table_history"
_C = "fx_table_detail fx_table_history fx_dry_run"
_REPORT = (PIVOT, RATIOS, DETAIL, PROPS, HISTORY, REPORT)
_V = "fx_table_detail fx_table_history"


def _columns(df_columns: str, tail: str = "") -> str:
    return oracle(_R, *_REPORT, f"select {df_columns} from report {tail}")


ORACLE = {
    "table_scope": oracle(
        _D,
        """select schema_name, table_name from fx_table_detail where table_type = 'EXTERNAL' and upper(data_source_format) = 'DELTA'
  and schema_name in ('s0', 's1', 's9')""",
    ),
    "db_scope": oracle(_D, "select distinct schema_name from fx_table_detail where schema_name = 's0'"),
    "missing_schemas": oracle(
        _D,
        """select x.schema_name from (select unnest(['s0', 's1', 's9']) as schema_name) x
where x.schema_name not in (select schema_name from fx_table_detail)""",
    ),
    "last_vacuum": oracle(_H, LAST, "select * from last_vacuum"),
    "removable_files": oracle(_H, LAST, REMOVABLE, "select * from removable"),
    "vacuum_candidates": oracle(_C, LAST, REMOVABLE, CANDIDATES, "select * from candidates"),
    "top_candidates": oracle(
        _C, LAST, REMOVABLE, CANDIDATES,
        """select * from candidates where is_delta and error is null
order by candidate_score desc nulls last, "table" limit 50""",
    ),
    "failed_steps": oracle(
        "fx_table_detail fx_storage_metrics fx_table_props fx_table_history",
        """select table_name, 'STORAGE_METRICS' as step, 'no rows collected' as error from fx_table_detail
  where table_name not in (select table_name from fx_storage_metrics)
union all select table_name, 'TBLPROPERTIES', 'no rows collected' from fx_table_detail
  where table_name not in (select table_name from fx_table_props)
union all select table_name, 'HISTORY', 'no rows collected' from fx_table_detail
  where table_name not in (select table_name from fx_table_history)""",
    ),
    "storage_pivot": oracle("fx_storage_metrics", PIVOT, "select * from pivoted"),
    "storage_ratios": oracle("fx_storage_metrics", PIVOT, RATIOS, "select * from ratios"),
    "detail_features": oracle(_D, DETAIL, "select * from features"),
    "table_properties": oracle("fx_table_props", PROPS, "select * from props"),
    "maintenance_history": oracle(_H, HISTORY, "select * from upkeep"),
    "maintenance_report": oracle(_R, *_REPORT, "select * from report"),
    "storage_summary": oracle(
        _R, *_REPORT,
        f"""select round(sum(total_bytes) / {_GB}, 2) as total_storage_gb, round(sum(active_bytes) / {_GB}, 2) as active_storage_gb,
  round(sum(vacuumable_bytes) / {_GB}, 2) as reclaimable_by_vacuum_gb, round(sum(time_travel_bytes) / {_GB}, 2) as time_travel_gb,
  round(case when sum(total_bytes) > 0 then sum(vacuumable_bytes) / sum(total_bytes) * 100 else 0 end, 2) as overall_saving_pct,
  cast(sum(num_files) as bigint) as total_files, count(table_name) as total_tables from report""",
    ),
    "top_reclaimable": _columns(
        """table_name, table_type, total_gb, active_gb, space_saving_gb, saving_pct, bloat_ratio, vacuum_ever_run,
  days_since_last_vacuum, recommendation""",
        "order by space_saving_gb desc, table_name limit 20",
    ),
    "needs_attention": _columns(
        """table_name, table_type, recommendation, total_gb, space_saving_gb, saving_pct, vacuum_ever_run,
  days_since_last_vacuum, optimize_ever_run, days_since_last_optimize, avg_file_size_mb, num_files""",
        "where recommendation <> 'OK'",
    ),
    "feature_matrix": _columns(
        """table_name, table_type, format, is_partitioned, partition_columns, has_liquid_clustering, clustering_columns,
  delta_deletion_vectors, delta_auto_optimize, delta_auto_compact, delta_log_retention, delta_deleted_file_retention"""
    ),
    "staleness": _columns(
        """table_name, table_type, last_modified, days_since_last_modified, last_write_operation, days_since_last_write,
  last_optimize, days_since_last_optimize, last_vacuum, days_since_last_vacuum, total_versions_in_history,
  optimize_count_in_history, vacuum_count_in_history"""
    ),
    "file_size_assessment": _columns(
        """table_name, num_files, size_in_bytes, avg_file_size_mb, total_gb, is_partitioned, has_liquid_clustering,
  optimize_ever_run, days_since_last_optimize, case when avg_file_size_mb < 8 then 'Too Small (< 8 MB)'
  when avg_file_size_mb > 1024 then 'Too Large (> 1 GB)' else 'Healthy' end as file_size_assessment"""
    ),
    "version_analysis": oracle(_V, CLASS, VERSIONS, "select * from versions"),
    "vacuum_priority": oracle(
        _V, CLASS, VERSIONS,
        "select table_name, version_count, potential_vacuum_files, vacuum_priority from versions",
    ),
    "storage_class": oracle(
        _D, CLASS,
        """select table_name, storage_type, storage_type = 'Managed' as is_managed_storage,
  storage_type = 'Azure Mount Point' as is_mount_point from classed""",
    ),
    "priority_summary": oracle(
        _V, CLASS, VERSIONS, "select vacuum_priority, count(*) as count from versions group by vacuum_priority"
    ),
    "version_top10": oracle(
        _V, CLASS, VERSIONS,
        """select database, table_name, version_count, potential_vacuum_files, vacuum_priority from versions
order by version_count desc, table_name limit 10""",
    ),
    "version_statistics": oracle(
        _V, CLASS, VERSIONS,
        """select avg(version_count) as avg_versions, max(version_count) as max_versions,
  cast(sum(potential_vacuum_files) as bigint) as total_potential_vacuum_files, sum(table_size_mb) as total_size_mb from versions""",
    ),
    "maintenance_commands": oracle(
        _V, CLASS, VERSIONS,
        """select database, table_name, version_count, potential_vacuum_files,
  '-- main.' || database || '.' || table_name || chr(10) || '-- Versions: ' || version_count || ', Potential files to remove: '
  || potential_vacuum_files || chr(10) || 'VACUUM main.' || database || '.' || table_name || ' RETAIN 168 HOURS;' || chr(10)
  || '-- To perform dry run first: VACUUM main.' || database || '.' || table_name || ' RETAIN 168 HOURS DRY RUN;' as command
from versions where vacuum_priority = 'HIGH'""",
    ),
}

round_raw(
    QUERIES,
    ORACLE,
    {
        "vacuum_candidates": "days_since_last_vacuum candidate_score",
        "top_candidates": "days_since_last_vacuum candidate_score",
        "version_statistics": "avg_versions total_size_mb",
    },
)
