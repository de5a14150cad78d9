"""Registered ingestion and refresh-router queries and the SQL they must agree with."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from opsight.operators import ingest as i
from opsight.operators import router as r
from opsight.operators.content import differences
from opsight.plans.common import AS_OF, Inputs, oracle, query
from opsight.scratch import materialize, scratch_path
from opsight.sources.batch_log import BatchLog
from opsight.streaming import ingest as si
from opsight.streaming import router as sr
from opsight.streaming import settle as ss
from opsight.windows import ts_lit

RUN = "run-1"
KEY, TS, TIE = "statement_id", "update_time", ["status"]


# ---- ingestion -----------------------------------------------------------------------


def _emissions(t: Inputs):
    return t.logical("fx_emissions").withColumn("update_time", F.col("update_time").cast("timestamp_ntz"))


def _dedupe(t: Inputs):
    return i.latest_in_batch(_emissions(t), KEY, TS, TIE)


def _upsert(t: Inputs):
    emitted = _emissions(t)
    first = i.latest_in_batch(emitted.filter(F.col("status").isin("stale", "undated")), KEY, TS, TIE)
    return i.upsert(first, emitted.filter(~F.col("status").isin("stale", "undated")), KEY, TS, TIE)


def _stream(t: Inputs, fold: bool = False):
    """Three drops of files, the stream run after each: late, repeated and corrected rows."""
    spark = t.spark
    source, sink_path, checkpoint = (scratch_path(spark, n) for n in ("emitted", "sink", "checkpoint"))
    emitted = _emissions(t)
    sink = BatchLog(spark, sink_path, emitted.schema, KEY, TS, TIE)
    for drop in (["stale", "undated"], None, ["corrected", "stale"]):
        part = emitted.filter(F.col("status").isin(drop)) if drop else emitted.filter(F.col("status") != "undated")
        part.write.mode("append").parquet(source)
        si.ingest(spark, source, emitted.schema, sink, checkpoint)
        if fold:
            sink.fold()
    return sink.read()


def _mismatch(t: Inputs):
    """The ingested rows against a copy that lost some, changed some and has some that are new."""
    rows = materialize(i.latest_in_batch(_emissions(t), KEY, TS, TIE), "ingested")
    late = F.when(F.col(KEY) % 97 == 5, F.col("amount") + 1).otherwise(F.col("amount"))
    copy = rows.filter(F.col(KEY) % 101 != 7).withColumn("amount", late)
    extra = rows.filter(F.col(KEY) % 103 == 9).withColumn(KEY, -F.col(KEY))
    return differences(rows, copy.unionByName(extra), KEY)


def _reconcile(t: Inputs):
    return i.reconcile(_dedupe(t), _emissions(t))


# ---- router --------------------------------------------------------------------------


def _mapping(t: Inputs):
    """Reports with their source tables: one mapping row per dependency."""
    config = t.logical("fx_report_config").select("report_id", "report_name", "enabled")
    return config.join(t.logical("fx_report_dependencies"), "report_id")


def _payloads(t: Inputs):
    """All update payloads."""
    return t.logical("fx_update_events").select("run_id", "updated_tables")


def _hourly(t: Inputs):
    """One payload per hour of observation: the tables updated in it, each once."""
    seen = t.logical("fx_update_events").withColumn("run_id", F.unix_micros(F.col("observed_ts").cast("timestamp")))
    hour = F.floor(F.col("run_id") / F.lit(3_600_000_000)).alias("run_id")
    names = r.parse_updates(seen.select(hour, "updated_tables")).distinct()
    listed = F.to_json(F.array_sort(F.collect_list("source_table"))).alias("updated_tables")
    return names.groupBy("run_id").agg(listed)


def _due(t: Inputs, force: bool = False):
    return r.evaluate_due(
        t.logical("fx_report_config"),
        t.logical("fx_report_dependencies"),
        t.logical("fx_table_state"),
        t.logical("fx_report_state"),
        force,
    )


def _table_state(t: Inputs):
    updates = r.parse_updates(_payloads(t))
    return r.upsert_table_state(t.logical("fx_table_state"), updates, t.as_of(), RUN)


def _report_state(t: Inputs):
    commits = r.decisions(_due(t), t.as_of()).filter("refresh = 'true'")
    return r.commit_state(t.logical("fx_report_state"), commits, RUN)


def _audit(t: Inputs):
    return r.audit(r.refresh_list(_mapping(t), _hourly(t)), t.as_of())


def _each_audit(t: Inputs):
    """Audit rows of every payload by itself."""
    return r.audit(r.refresh_list(_mapping(t), _payloads(t), many=True), t.as_of())


def _route(t: Inputs):
    """Two drops of update events; the decisions of the second."""
    spark = t.spark
    names = ("updates", "state", "checkpoint", "decisions")
    source, state_path, checkpoint, out = (scratch_path(spark, n) for n in names)
    state = sr.state_log(spark, state_path)
    config, deps, marks = (t.logical(n) for n in ("fx_report_config", "fx_report_dependencies", "fx_report_state"))
    events = t.logical("fx_update_events").select(*sr.EVENTS.fieldNames())
    for drop in (F.col("run_id") % 2 == 0, F.col("run_id") % 2 == 1):
        events.filter(drop).write.mode("append").parquet(source)
        sr.route_stream(spark, source, state, config, deps, marks, checkpoint, out)
    last = spark.read.parquet(out).filter("batch = 1")
    return last.select("report_id", "refresh", "reason")


def _settled(t: Inputs):
    """Two drops of update events in order of time, the stream started anew for the second."""
    spark = t.spark
    source, checkpoint, out = (scratch_path(spark, n) for n in ("update-events", "settle-checkpoint", "settled"))
    events = t.logical("fx_update_events")
    needs = t.logical("fx_report_config").filter("enabled").join(t.logical("fx_report_dependencies"), "report_id")
    sets = materialize(ss.report_sets(needs), "report-sets")
    middle = ts_lit(t.as_of() - timedelta(days=12))
    for drop in (F.col("observed_ts") < middle, F.col("observed_ts") >= middle):
        events.filter(drop).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        ss.settle_stream(ss.report_events(stream, ss.set_tables(sets)), out, checkpoint)
    times = ("decided_at", "burst_start", "burst_end")
    return ss.of_reports(spark.read.parquet(out), sets).withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


QUERIES = {
    "ingest_dedupe": query(_dedupe),
    "ingest_upsert": query(_upsert),
    "ingest_stream": query(_stream),
    "ingest_folded": query(lambda t: _stream(t, True)),
    "ingest_reconcile": query(_reconcile),
    "ingest_mismatch": query(_mismatch),
    "settled_decisions": query(_settled),
    "updated_tables": query(lambda t: r.parse_updates(t.logical("fx_updates"))),
    "match_reports": query(lambda t: r.match_reports(_mapping(t), r.parse_updates(_payloads(t)))),
    "refresh_list": query(lambda t: r.refresh_list(_mapping(t), _hourly(t))),
    "refresh_list_named": query(lambda t: r.refresh_list_named(_mapping(t), _hourly(t))),
    "table_state": query(_table_state),
    "report_due": query(_due),
    "report_due_forced": query(lambda t: _due(t, True)),
    "report_decisions": query(lambda t: r.decisions(_due(t), t.as_of())),
    "report_state": query(_report_state),
    "refresh_audit": query(_audit),
    "stale_reports": query(lambda t: r.stale_reports(t.logical("fx_report_state"), t.as_of())),
    "dependency_report": query(
        lambda t: r.dependency_report(t.logical("fx_report_config"), t.logical("fx_report_dependencies"), 2)
    ),
    "reports_by_table": query(
        lambda t: r.reports_by_table(t.logical("fx_report_config"), t.logical("fx_report_dependencies"))
    ),
    "route_stream": query(_route),
}
EACH_AUDIT = query(_each_audit)  # registered as stored_audit


def _newest(where: str) -> str:
    return f"""select statement_id, status, amount, update_time from (select *, row_number() over (partition by statement_id
  order by update_time desc nulls last, status desc nulls last) as rn from fx_emissions where {where}) e where rn = 1"""


# Equal times never differ in status here, except that a late drop may not replace an equal time.
UPDATES = """listed as (select *, case when starts_with(trim(updated_tables), '[') and json_valid(updated_tables)
  then list_filter(list_transform(from_json(updated_tables, '["VARCHAR"]'), lambda x: lower(trim(x))), lambda x: x <> '') else [] end as names
  from payloads),
updates as (select distinct run_id, unnest(names) as source_table from listed)"""
ALL = "payloads as (select * from fx_update_events)"
HOURLY = """seen as (select epoch_us(observed_ts) // 3600000000 as run_id, unnest(case when starts_with(trim(updated_tables), '[') and json_valid(updated_tables)
  then list_transform(from_json(updated_tables, '["VARCHAR"]'), lambda x: lower(trim(x))) else [] end) as source_table from fx_update_events),
payloads as (select run_id, to_json(list_sort(list(distinct source_table))) as updated_tables from seen where source_table <> '' group by run_id)"""
MAPPING = """mapping as (select c.report_id, c.report_name, c.enabled, d.source_table from fx_report_config c
  join fx_report_dependencies d on c.report_id = d.report_id)"""
REFRESH = """refreshed as (select m.report_id, m.report_name, m.source_table, u.run_id,
  '[' || array_to_string(list_transform(l.names, lambda x: '"' || x || '"'), ', ') || ']' as triggering_tables
  from mapping m join updates u on lower(m.source_table) = u.source_table join listed l on u.run_id = l.run_id where m.enabled)"""

# as REFRESH, but each payload by itself, as a run may come twice
REFRESH_EACH = """refreshed as (select m.report_id, m.report_name, m.source_table, l.run_id,
  '[' || array_to_string(list_transform(l.names, lambda x: '"' || x || '"'), ', ') || ']' as triggering_tables
  from listed l, unnest(list_distinct(l.names)) u(source_table) join mapping m on lower(m.source_table) = u.source_table where m.enabled)"""


def _due_sql(state: str, force: bool = False) -> str:
    return f"""states as (select lower(source_table) as source_table, max(last_updated_ts) as seen from {state} group by 1),
counted as (select d.report_id, count(*) as needed, count(distinct case when fresh then d.source_table end) as n,
  (epoch_us(max(case when fresh then seen end)) - epoch_us(min(case when fresh then seen end))) / 60e6 as span
  from (select x.report_id, lower(x.source_table) as source_table, s.seen,
      s.seen is not null and (p.last_refresh_ts is null or s.seen > p.last_refresh_ts) as fresh
    from fx_report_dependencies x left join states s on lower(x.source_table) = s.source_table
    left join fx_report_state p on x.report_id = p.report_id) d group by d.report_id),
judged as (select c.report_id, k.needed, upper(coalesce(c.refresh_mode, 'ALL')) = 'ANY' as any_mode, k.n, k.span,
  c.dependency_window_minutes as lim, case when any_mode then k.n >= 1 else k.n = k.needed end as ready,
  (case when any_mode then 'ANY ' else 'ALL ' end) || k.n || '/' || k.needed as why,
  ready and coalesce(lim, 0) <> 0 and k.n > 1 and k.span > lim as apart
  from fx_report_config c left join counted k on c.report_id = k.report_id where c.enabled),
due as (select report_id, case when needed is null then false when {str(force).lower()} then true when apart then false else ready end as is_due,
  case when needed is null then 'no dependencies configured' when {str(force).lower()} then 'force_all'
    when apart then why || '; window ' || printf('%.1f', round(span, 1)) || 'm>' || lim || 'm' else why end as reason from judged)"""


_DUE = "fx_report_config fx_report_dependencies fx_table_state fx_report_state"
_RF = "fx_report_config fx_report_dependencies fx_update_events"

ORACLE = {
    "ingest_dedupe": oracle("fx_emissions", _newest("true")),
    "ingest_upsert": oracle("fx_emissions", _newest("true")),
    "ingest_stream": oracle("fx_emissions", _newest("true")),
    "ingest_folded": oracle("fx_emissions", _newest("true")),
    "ingest_mismatch": oracle(
        "fx_emissions",
        f"""mine as ({_newest("true")}),
theirs as (select statement_id, status, case when statement_id % 97 = 5 then amount + 1 else amount end as amount, update_time
  from mine where statement_id % 101 <> 7
  union all select -statement_id, status, amount, update_time from mine where statement_id % 103 = 9)""",
        """select coalesce(m.statement_id, t.statement_id) as statement_id,
  case when t.statement_id is null then 'only_left' when m.statement_id is null then 'only_right' else 'changed' end as status,
  case when m.statement_id is null then 0 else 1 end as rows_left, case when t.statement_id is null then 0 else 1 end as rows_right
from mine m full join theirs t on m.statement_id = t.statement_id
where m.statement_id is null or t.statement_id is null or m.amount is distinct from t.amount""",
    ),
    # the settle time is longer than the least interval here, so a burst alone says when it is decided
    "settled_decisions": oracle(
        "fx_update_events fx_report_config fx_report_dependencies", ALL, UPDATES,
        """needs as (select distinct report_id, lower(source_table) as source_table from fx_report_config c
  join fx_report_dependencies d using (report_id) where c.enabled),
seen as (select n.report_id, l.observed_ts as moment, count(*) as n from listed l, unnest(list_distinct(l.names)) x(source_table) join needs n using (source_table) group by all),
starts as (select *, case when moment < lag(moment) over w + interval 90 second then 0 else 1 end as opens from seen
  window w as (partition by report_id order by moment)),
bursts as (select *, sum(opens) over (partition by report_id order by moment rows unbounded preceding) as burst from starts),
decided as (select report_id, max(moment) + interval 90 second as decided_at, min(moment) as burst_start, max(moment) as burst_end, cast(sum(n) as bigint) as events
  from bursts group by report_id, burst)""",
        "select * from decided where decided_at < (select max(moment) from seen) - interval 1 millisecond",
    ),
    "ingest_reconcile": oracle(
        "fx_emissions",
        "select count(distinct statement_id) as rows_left, count(*) as rows_right from fx_emissions",
    ),
    "updated_tables": oracle(
        "fx_updates", "payloads as (select * from fx_updates)", UPDATES, "select run_id, source_table from updates"
    ),
    "match_reports": oracle(
        _RF, ALL, UPDATES, MAPPING,
        """select report_id, bool_or(lower(source_table) in (select source_table from updates)) as refresh
from mapping where enabled group by report_id""",
    ),
    "refresh_list": oracle(_RF, HOURLY, UPDATES, MAPPING, REFRESH, "select * from refreshed"),
    "refresh_list_named": oracle(
        _RF, HOURLY, UPDATES, MAPPING, REFRESH,
        """select * exclude (source_table), split_part(source_table, '.', 1) as catalog, split_part(source_table, '.', 2) as schema,
  split_part(source_table, '.', 3) as "table" from refreshed""",
    ),
    "table_state": oracle(
        "fx_table_state fx_update_events", ALL, UPDATES,
        "named as (select distinct source_table from updates)",
        f"""select coalesce(s.source_table, n.source_table) as source_table,
  case when n.source_table is null then s.last_updated_ts else {AS_OF} end as last_updated_ts,
  case when n.source_table is null then s.last_run_id else '{RUN}' end as last_run_id
from fx_table_state s full outer join named n on lower(s.source_table) = n.source_table""",
    ),
    "report_due": oracle(_DUE, _due_sql("fx_table_state"), "select * from due"),
    "report_due_forced": oracle(_DUE, _due_sql("fx_table_state", True), "select * from due"),
    "report_decisions": oracle(
        _DUE, _due_sql("fx_table_state"),
        f"""select report_id, case when is_due then 'true' else 'false' end as refresh,
  case when is_due then {AS_OF} end as candidate_ts from due""",
    ),
    "report_state": oracle(
        _DUE, _due_sql("fx_table_state"),
        f"""select coalesce(s.report_id, d.report_id) as report_id,
  case when d.report_id is null then s.last_refresh_ts else {AS_OF} end as last_refresh_ts,
  case when d.report_id is null then s.last_refresh_run_id else '{RUN}' end as last_refresh_run_id
from fx_report_state s full outer join (select report_id from due where is_due) d on s.report_id = d.report_id""",
    ),
    "refresh_audit": oracle(
        _RF, HOURLY, UPDATES, MAPPING, REFRESH,
        f"""select run_id, report_id, report_name, triggering_tables, {AS_OF} as refreshed_at, 'SUCCESS' as status
from refreshed""",
    ),
    "stale_reports": oracle(
        "fx_report_state", f"select * from fx_report_state where last_refresh_ts < {AS_OF} - interval 24 hour"
    ),
    "dependency_report": oracle(
        "fx_report_config fx_report_dependencies",
        """select c.report_id, count(d.source_table) as dependencies, count(distinct lower(d.source_table)) as tables,
  count(d.source_table) = 0 as has_no_dependencies, count(distinct lower(d.source_table)) > 2 as over_table_limit
from fx_report_config c left join fx_report_dependencies d on c.report_id = d.report_id where c.enabled group by c.report_id""",
    ),
    "reports_by_table": oracle(
        "fx_report_config fx_report_dependencies",
        """select lower(source_table) as source_table, count(*) as dependencies, count(distinct report_id) as reports
from fx_report_dependencies where report_id in (select report_id from fx_report_config where enabled) group by 1""",
    ),
    "route_stream": oracle(
        "fx_report_config fx_report_dependencies fx_report_state fx_update_events",
        "payloads as (select * from fx_update_events)",
        UPDATES,
        """folded as (select u.source_table, max(p.observed_ts) as last_updated_ts from updates u
  join payloads p on u.run_id = p.run_id group by 1)""",
        _due_sql("folded"),
        "select report_id, case when is_due then 'true' else 'false' end as refresh, reason from due",
    ),
}
EACH_AUDIT_SQL = oracle(
    _RF, ALL, UPDATES, MAPPING, REFRESH_EACH,
    f"""select run_id, report_id, report_name, triggering_tables, {AS_OF} as refreshed_at, 'SUCCESS' as status
from refreshed""",
)
