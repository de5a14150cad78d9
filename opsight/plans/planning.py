"""Registered migration, principal and config-text queries and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsight.operators import configtext as x
from opsight.operators import migration as g
from opsight.operators import principals as p
from opsight.plans.common import AS_OF, Inputs, oracle, query

TARGET = g.Target("main", ["S0", "S1", "s2", "S3"], {"s1": "sales_uc"})


# ---- migration -----------------------------------------------------------------------


def _plan(t: Inputs):
    return g.migration_plan(t.logical("fx_inventory"), t.logical("fx_mounts"), TARGET)


def _uri(t: Inputs):
    uri, error = g.normalize_uri(F.col("source"))
    return t.logical("fx_mounts").select("mount_point", uri.alias("uri"), error.alias("error"))


def _comments(t: Inputs):
    name, old = F.concat(F.lit("main.s."), "table_name"), F.concat(F.lit("h.s."), "table_name")
    return t.logical("fx_inventory").select(
        "table_name",
        g.deprecation_comment(F.col("comment"), name, old).alias("noted"),
        g.copied_comment(F.col("comment")).alias("copied"),
    )


def _checked(t: Inputs):
    return g.check_views(g.rewrite_views(t.logical("fx_views"), TARGET), TARGET)


def _levels(t: Inputs):
    edges = t.logical("fx_view_edges")
    return g.view_levels(edges.select("view").distinct(), edges)


def _circles(t: Inputs):
    edges = t.logical("fx_view_edges")
    return g.view_circles(edges.select("view").distinct(), edges)


# ---- principals ----------------------------------------------------------------------


def _users(t: Inputs):
    flat = t.logical("fx_users")
    named = F.when(F.col("family_name").isNotNull(), F.struct("family_name"))
    return flat.withColumn("name", named).drop("family_name")


def _sides(t: Inputs):
    primary = {"users": _users(t), "service_principals": t.logical("fx_spns"), "groups": t.logical("fx_groups")}
    primary["members"] = t.logical("fx_members")
    replica = {
        "users": t.logical("fx_users_replica"),
        "service_principals": t.logical("fx_spns_replica"),
        "groups": t.logical("fx_groups_replica"),
    }
    return primary, replica


def _to_create(t: Inputs):
    made = p.users_to_create(_users(t), t.logical("fx_users_replica"))
    return made.withColumn("family_name", F.col("name.family_name")).drop("name")


def _members(t: Inputs):
    return p.translate_members(*_sides(t)).select("display_name", "group_id", "member_id")


# ---- config text ---------------------------------------------------------------------


def _declared(t: Inputs):
    return x.declared_names(t.logical("fx_grant_lines"))


QUERIES = {
    "describe_sections": query(lambda t: g.split_describe(t.logical("fx_describe_rows"))),
    "resolve_mount": query(lambda t: g.resolve_mount(t.logical("fx_inventory"), t.logical("fx_mounts"))),
    "normalize_uri": query(_uri),
    "migration_plan": query(_plan),
    "migration_log": query(lambda t: g.migration_log(_plan(t), t.as_of())),
    "rewrite_views": query(lambda t: g.rewrite_views(t.logical("fx_views"), TARGET).select("view_name", "new_text")),
    "check_views": query(_checked),
    "view_levels": query(_levels),
    "view_circles": query(_circles),
    "rewrite_ddl": query(lambda t: g.rewrite_ddl(t.logical("fx_ddl")).select("target", "new_ddl", "error")),
    "deprecation_comment": query(_comments),
    "users_to_create": query(_to_create),
    "spn_payloads": query(lambda t: p.spn_payloads(t.logical("fx_spns"))),
    "groups_to_create": query(lambda t: p.groups_to_create(t.logical("fx_groups"), t.logical("fx_groups_replica"))),
    "translate_members": query(_members),
    "declared_names": query(_declared),
    "drop_dangling": query(lambda t: x.drop_dangling(t.logical("fx_config_lines"), _declared(t))),
    "external_blocks": query(lambda t: x.external_blocks(t.logical("fx_config_lines"), 1000)),
    "external_tables": query(lambda t: x.external_tables(t.logical("fx_config_lines"), _declared(t), 1000)),
}

# The mount source, its scheme in lower case, and the rest after the scheme.
_URI = """uris as (select *, lower(split_part(source, '://', 1)) as scheme, regexp_replace(source, '^.*?://', '') as rest from src),
normal as (select *, case when scheme in ('wasb', 'wasbs') then 'Mount source ' || source || ' uses ' || scheme
    || '://, which UC does not support. If the storage account is ADLS Gen2 (hierarchical namespace), register it as '
    || regexp_replace(rest, '^([^@]+)@([^.]+)\\.blob\\.', 'abfss://\\1@\\2.dfs.') || ' instead.'
  when scheme = 'adl' then 'Mount source ' || source || ' is ADLS Gen1, which UC does not support; migrate the data to ADLS Gen2.' end as error,
  case when scheme in ('wasb', 'wasbs', 'adl') then null when scheme = 'abfs' then 'abfss://' || rest else source end as uri from uris)"""
_MOUNTED = """points as (select rtrim(mount_point, '/') as mp, rtrim(source, '/') as source from fx_mounts where mount_point like '/mnt/%'),
hits as (select i.location, p.source || substr(i.location, 6 + length(p.mp)) as cloud_path,
    row_number() over (partition by i.location order by length(p.mp) desc) as rn
  from (select distinct location from fx_inventory) i join points p on i.location = 'dbfs:' || p.mp or starts_with(i.location, 'dbfs:' || p.mp || '/')),
mounted as (select location, cloud_path from hits where rn = 1)"""
_PLANNED = f"""joined as (select i.*, m.cloud_path as source from fx_inventory i left join mounted m on i.location = m.location
  where lower(i.src_schema) in ('s0', 's1', 's2', 's3')), src as (select * from joined), {_URI},
staged as (select *, upper(table_type) = 'VIEW' as v, lower(provider) as fmt,
  location like 'dbfs:/%' and location not like 'dbfs:/Volumes/%' and source is null as root from normal),
judged as (select *, root and target_exists as skip, not root and location like 'dbfs:/mnt/%' as mnt,
  coalesce(error, case when fmt not in ('delta', 'parquet', 'csv', 'json', 'orc', 'avro', 'text') then 'Provider ''' || fmt
    || ''' (Hive SerDe) can''t be registered in UC; convert it (e.g. CTAS into a managed table) instead.' end) as failure from staged),
plan as (select 'hive_metastore.`' || src_schema || '`.`' || table_name || '`' as source,
  'main.`' || case when lower(src_schema) = 's1' then 'sales_uc' else src_schema end || '`.`' || table_name || '`' as target,
  case when v then 'VIEW' else 'TABLE' end as object_type,
  case when v then 'CREATE VIEW' when skip then '-' when root then case when fmt = 'delta' then 'DEEP CLONE' else 'CTAS' end
    when mnt and failure is not null then '-' when mnt then 'CREATE ... LOCATION (mount resolved)' else 'SYNC' end as method,
  case when v then 'PLANNED' when skip then 'SKIPPED' when root then 'OK' when mnt and failure is not null then 'FAILED' else 'OK' end as status,
  case when v then '' when skip then 'Target already exists; set REFRESH_EXISTING = True to re-copy it' when mnt then coalesce(failure, '') else '' end as message,
  case when not v and mnt and failure is null then uri end as cloud_path from judged)"""
_K = "cast(s_suppkey as varchar)"
_NEW_TEXT = f"""case s_suppkey % 6 when 0 then 'select * from main.`sales_uc`.t' || {_K} || ' -- from hive_metastore.S1.x'
  when 1 then 'select a.b from main.`S2`.t' || {_K} || ' a join main.`sales_uc`.`t 4` on a.x = 1'
  when 2 then 'select "it is from S1.t" as c, /* join S2.t */ 1 from S9.t' || {_K}
  when 3 then 'select * from other.S1.t' || {_K} || ', main.`S3`.u'
  when 4 then 'select * from S9.a x, S1.t' || {_K} else 'select x from main.`sales_uc`.t' || {_K} end"""
_BOTH = "u.display_name is not null and u.family_name is not null"
_CLEAN = """parts as (select file, line_no, string_split(regexp_replace(regexp_replace(line, '^[^\\[]*\\[', ''), '\\].*', ''), ',') as ts,
  regexp_replace(line, '\\[.*', '') as prefix from lines where regexp_matches(line, 'depends_on\\s*=\\s*\\[')),
tokens as (select file, line_no, prefix, unnest(range(len(ts))) as pos, trim(unnest(ts)) as token from parts),
kept as (select file, line_no, prefix || '[' || string_agg(token, ', ' order by pos) || ']' as line from tokens
  where token <> '' and (not regexp_matches(token, '^\\w*grants\\.') or regexp_replace(token, '^\\w*grants\\.', '') in (select name from declared)) group by file, line_no, prefix),
cleaned as (select file, line_no, line from lines where not regexp_matches(line, 'depends_on\\s*=\\s*\\[') union all select * from kept)"""
_DECLARED = """declared as (select distinct regexp_extract(line, 'resource "\\w*grants" "([^"]+)"', 1) as name from fx_grant_lines
  where regexp_matches(line, 'resource "\\w*grants" "([^"]+)"'))"""
_BLOCKS = """numbered as (select *, sum(case when regexp_matches(line, '^resource "\\w*sql_table" ".*" \\{') then 1 else 0 end)
    over (partition by file order by line_no) as block from fx_config_lines),
ends as (select file, block, min(line_no) as end_no from numbered where block > 0 and regexp_matches(line, '^\\s*\\}$') group by all),
placed as (select n.*, e.end_no, n.block > 0 and (e.end_no is null or n.line_no <= e.end_no) as within
  from numbered n left join ends e on n.file = e.file and n.block = e.block),
kinds as (select file, block, bool_or(regexp_matches(line, 'table_type\\s*=\\s*"(MANAGED|VIEW)"|view_definition')) as internal
  from placed where within group by all),
survivors as (select p.* from placed p left join kinds k on p.file = k.file and p.block = k.block
  where not p.within or (p.end_no is not null and not k.internal))"""

ORACLE = {
    "describe_sections": oracle(
        "fx_describe_rows",
        """heads as (select object, min(case when trim(col_name) = '# Partition Information' then ord end) as p,
  min(case when trim(col_name) = '# Detailed Table Information' then ord end) as d from fx_describe_rows group by object)""",
        """select r.object, r.ord, case when r.ord > h.d then 'detail' when r.ord > h.p then 'parts' else 'cols' end as section,
  trim(r.col_name) as name, case when r.ord > h.d then trim(r.data_type) end as value,
  case when coalesce(r.ord > h.d, false) or coalesce(r.ord > h.p, false) then null else r.comment end as comment
from fx_describe_rows r join heads h on r.object = h.object where trim(r.col_name) <> '' and trim(r.col_name) not like '#%'""",
    ),
    "resolve_mount": oracle("fx_inventory fx_mounts", _MOUNTED, "select * from mounted"),
    "normalize_uri": oracle(
        "fx_mounts", "src as (select * from fx_mounts)", _URI, "select mount_point, uri, error from normal"
    ),
    "migration_plan": oracle("fx_inventory fx_mounts", _MOUNTED, _PLANNED, "select * from plan"),
    "migration_log": oracle(
        "fx_inventory fx_mounts", _MOUNTED, _PLANNED,
        f"select {AS_OF} as ts, source, target, object_type, method, status, message from plan",
    ),
    "rewrite_views": f"select 'v' || {_K} as view_name, {_NEW_TEXT} as new_text from supplier",
    "check_views": f"""select 'S' || (s_suppkey % 4) as src_schema, 'v' || {_K} as view_name,
  case when s_suppkey % 6 = 4 then 'Unqualified reference S1.t' || {_K} || ' points at renamed schema ''S1''; qualify it as main.sales_uc.t' || {_K} end as message,
  case when s_suppkey % 6 = 4 then 'FAILED' else 'OK' end as status from supplier""",
    "view_levels": oracle(
        "fx_view_edges",
        """names as (select distinct view from fx_view_edges),
inner_edges as (select distinct view, depends_on from fx_view_edges where depends_on in (select view from names)),
reach as (with recursive r as (select view, depends_on, 1 as n from inner_edges
  union select r.view, e.depends_on, r.n + 1 from r join inner_edges e on r.depends_on = e.view where r.n < 60) select * from r)""",
        """select n.view, case when max(coalesce(r.n, 0)) >= 60 then null else cast(1 + max(coalesce(r.n, 0)) as int) end as level,
  case when max(coalesce(r.n, 0)) >= 60 then 'FAILED' else 'OK' end as status
from names n left join reach r on n.view = r.view group by n.view""",
    ),
    "view_circles": oracle(
        "fx_view_edges",
        """names as (select distinct view from fx_view_edges),
links as (select distinct view as a, depends_on as b from fx_view_edges where depends_on in (select view from names)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
members as (select x.a as view, min(x.b) as circle from reach x join reach y on x.a = y.b and x.b = y.a group by x.a),
ahead as (select r.a as view, min(m.circle) as circle from reach r join members m on r.b = m.view group by r.a)""",
        """select n.view, case when h.view is null then 'OK' else 'FAILED' end as status, m.circle,
  case when m.circle is null then h.circle end as waits_for
from names n left join members m on n.view = m.view left join ahead h on n.view = h.view""",
        recursive=True,
    ),
    "rewrite_ddl": oracle(
        "fx_ddl",
        """select target, case when p_partkey % 3 <> 2 then 'CREATE TABLE IF NOT EXISTS ' || target || ' (id INT)' || chr(10) || 'USING csv' || chr(10)
  || case when p_partkey % 5 = 4 then 'COMMENT ''dbfs:/mnt/x/' || p_name || '''' || chr(10) || 'LOCATION ''' || path || ''''
    else 'LOCATION ''' || path || '''' || chr(10) || 'LOCATION ''second''' end end as new_ddl,
  case when p_partkey % 3 = 2 then 'Could not rewrite SHOW CREATE TABLE output:' || chr(10) || ddl end as error
from (select *, cloud_path as path from fx_ddl) q""",
    ),
    "deprecation_comment": oracle(
        "fx_inventory",
        """select table_name, trim('This table is deprecated. Please use main.s.' || table_name || ' instead of h.s.' || table_name || '. '
  || coalesce(comment, '')) as noted,
  nullif(trim(replace(coalesce(comment, ''), 'This table is deprecated. Please use main.s.t instead of h.s.t. ', '')), '') as copied from fx_inventory""",
    ),
    "users_to_create": oracle(
        "fx_users fx_users_replica",
        f"""select u.user_name, case when {_BOTH} then u.display_name else '' end as display_name,
  case when {_BOTH} then u.family_name end as family_name, u.active, u.emails
from fx_users u where u.user_name not in (select user_name from fx_users_replica)""",
    ),
    "spn_payloads": oracle(
        "fx_spns",
        "select application_id, coalesce(display_name, 'Unnamed service principal') as display_name, true as active from fx_spns",
    ),
    "groups_to_create": oracle(
        "fx_groups fx_groups_replica",
        """select distinct display_name from fx_groups where display_name <> ''
  and display_name not in (select display_name from fx_groups_replica)""",
    ),
    "translate_members": oracle(
        "fx_users fx_users_replica fx_spns fx_spns_replica fx_groups fx_groups_replica fx_members",
        """places as (select id, display_name from fx_groups_replica union all select distinct 'new:' || display_name, display_name from fx_groups
  where display_name <> '' and display_name not in (select display_name from fx_groups_replica)),
mine as (select m.*, g.display_name from fx_members m join fx_groups g on m.group_id = g.id where g.display_name <> '' and m.value <> ''),
found as (select m.display_name, case when m.ref like 'Users/%' or u.id is not null then ur.id
    when m.ref like 'ServicePrincipals/%' or s.id is not null then sr.id
    when m.ref like 'Groups/%' or n.id is not null then np.id end as member_id
  from mine m left join fx_users u on m.value = u.id left join fx_users_replica ur on u.user_name = ur.user_name
  left join fx_spns s on m.value = s.id left join fx_spns_replica sr on s.application_id = sr.application_id
  left join fx_groups n on m.value = n.id left join places np on n.display_name = np.display_name)""",
        """select f.display_name, p.id as group_id, f.member_id from found f join places p on f.display_name = p.display_name
where f.member_id is not null""",
    ),
    "declared_names": oracle("fx_grant_lines", _DECLARED, "select * from declared"),
    "drop_dangling": oracle(
        "fx_config_lines fx_grant_lines", _DECLARED, "lines as (select * from fx_config_lines)", _CLEAN,
        "select * from cleaned",
    ),
    "external_blocks": oracle("fx_config_lines", _BLOCKS, "select file, line_no, line from survivors"),
    "external_tables": oracle(
        "fx_config_lines fx_grant_lines", _DECLARED, _BLOCKS,
        "lines as (select file, line_no, line from survivors where within)", _CLEAN,
        """select file, line_no, line from cleaned union all
select file, line_no, line from survivors where not within""",
    ),
}
