"""Migration planning, view texts, principal sync, config text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opsight.operators import configtext as x
from opsight.operators import migration as g
from opsight.operators import principals as p

TARGET = g.Target("main", ["sales", "Finance"], {"sales": "sales_uc"})


@pytest.mark.parametrize(
    "text, want",
    [
        ("select * from sales.t", "select * from main.`sales_uc`.t"),
        ("SELECT 1 FROM\n finance . `t x` JOIN other.t", "SELECT 1 FROM\n main.`finance`.`t x` JOIN other.t"),
        ("select * from hive_metastore.sales.t", "select * from main.`sales_uc`.t"),
        ("select `spark_catalog`.`We``ird`.t.c from x", "select main.`We``ird`.t.c from x"),
        ("select 'from sales.t', \"from sales.t\" -- from sales.t\nfrom sales.a", "select 'from sales.t', \"from sales.t\" -- from sales.t\nfrom main.`sales_uc`.a"),
        ("/* from sales.t */ select 'it\\'s from sales.t' from sales.b", "/* from sales.t */ select 'it\\'s from sales.t' from main.`sales_uc`.b"),
        ("select `it's` from sales.t where a = 'x'", "select `it's` from main.`sales_uc`.t where a = 'x'"),
        ("select x from cat.sales.t, my_hive_metastore.sales.t", "select x from cat.sales.t, my_hive_metastore.sales.t"),
        ("select sales.c from t", "select sales.c from t"),
        ("select extract(year from sales.ts) from sales.t", "select extract(year from sales.ts) from main.`sales_uc`.t"),
        ("select trim(both 'x' from sales.c) from finance.t", "select trim(both 'x' from sales.c) from main.`finance`.t"),
        ("with sales as (select 1) select * from sales", "with sales as (select 1) select * from sales"),
        ("select 'open from sales.t", "select 'open from main.`sales_uc`.t"),
        ("", ""),
        (None, None),
    ],
)
def test_view_rewrite(spark, text, want):
    df = spark.createDataFrame([("s", "v", text)], "src_schema string, view_name string, view_text string")
    assert g.rewrite_views(df, TARGET).first().new_text == want


def test_long_view_text_is_processed_whole(spark):
    text = "select * from sales.t " + "-- from sales.x\n" * 20000 + "join sales.z on true"
    df = spark.createDataFrame([("s", "v", text)], "src_schema string, view_name string, view_text string")
    new = g.rewrite_views(df, TARGET).first().new_text
    assert new.endswith("join main.`sales_uc`.z on true") and new.count("-- from sales.x") == 20000


def test_view_check(spark, rows):
    data = [
        ("s", "ok", "select * from main.`sales_uc`.t a, x.y b"),
        ("s", "legacy", "select * from a join `Hive_Metastore` . s . t"),
        ("s", "bare", "select * from a.b c, sales.t"),
        ("s", "quoted", "select 'from sales.t' from x"),
        ("s", "call", "select extract(year from sales.ts) from main.`sales_uc`.t"),
        ("s", "with", "with `sales` as (select 1), b as (select 2) select * from sales, b, main.x.y"),
        ("s", "odd", "select * from `a,b`.`c``d` x, `sales`.t"),
    ]
    df = spark.createDataFrame(data, "src_schema string, view_name string, new_text string").withColumn("view_text", F.col("new_text"))
    got = {r.view_name: (r.status, r.message) for r in g.check_views(df, TARGET).collect()}
    assert got == {
        "ok": ("OK", None),
        "legacy": ("FAILED", "View still references Hive_Metastore.s.t after rewrite"),
        "bare": ("FAILED", "Unqualified reference sales.t points at renamed schema 'sales'; qualify it as main.sales_uc.t"),
        "quoted": ("OK", None),
        "call": ("OK", None),
        "with": ("OK", None),
        "odd": ("FAILED", "Unqualified reference sales.t points at renamed schema 'sales'; qualify it as main.sales_uc.t"),
    }


def test_view_levels_with_cycle(spark, rows):
    edges = [("a", "base"), ("b", "a"), ("c", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("f", "d")]
    df = spark.createDataFrame(edges, "view string, depends_on string")
    levels = rows(g.view_levels(df.select("view"), df), "view", "level", "status")
    assert levels == [("a", 1, "OK"), ("b", 2, "OK"), ("c", 3, "OK"), ("d", None, "FAILED"), ("e", None, "FAILED"), ("f", None, "FAILED")]


def test_view_chain_longer_than_fifty(spark):
    df = spark.createDataFrame([(f"v{i}", f"v{i - 1}") for i in range(1, 56)], "view string, depends_on string")
    got = {r.view: r.level for r in g.view_levels(df.select("view"), df).collect()}
    assert got == {f"v{i}": i for i in range(1, 56)}


def test_equal_mount_prefixes(spark):
    mounts = spark.createDataFrame([("/mnt/a", "s1://x"), ("/mnt/a/", "s2://x/")], "mount_point string, source string")
    paths = spark.createDataFrame([("dbfs:/mnt/a/t",)], "location string")
    assert g.resolve_mount(paths, mounts).first().cloud_path == "s2://x/t"


def test_mounts_and_methods(spark):
    mounts = spark.createDataFrame(
        [("/mnt/a", "abfs://c@x.dfs/"), ("/mnt/a/deep/", "abfss://d@x.dfs"), ("/mnt/b", "wasbs://c@acc.blob.core"), ("/mnt/g1", "adl://x"), ("/", "root")],
        "mount_point string, source string",
    )
    cases = {
        "copy": ("dbfs:/user/t", "DELTA", False),
        "ctas": ("dbfs:/mnt/unmounted/t", "parquet", False),
        "skip": ("dbfs:/user/t2", "delta", True),
        "mounted": ("dbfs:/mnt/a/t", "csv", False),
        "exact": ("dbfs:/mnt/a", "csv", True),
        "deep": ("dbfs:/mnt/a/deep/t", "csv", False),
        "near": ("dbfs:/mnt/ab/t", "delta", False),
        "serde": ("dbfs:/mnt/a/h", "hive", False),
        "blob": ("dbfs:/mnt/b/t", "delta", False),
        "gen1": ("dbfs:/mnt/g1/t", "delta", False),
        "volume": ("dbfs:/Volumes/x", "delta", False),
        "cloud": ("s3://b/t", "delta", False),
        "blank": (None, None, False),
    }
    inventory = spark.createDataFrame(
        [("sales", n, "MANAGED", f, loc, e) for n, (loc, f, e) in cases.items()] + [("sales", "view", "VIEW", None, None, False), ("x", "other", "MANAGED", "delta", "s3://b", False)],
        "src_schema string, table_name string, table_type string, provider string, location string, target_exists boolean",
    )
    plan = {re.sub(r".*`(\w+)`$", r"\1", r.source): r for r in g.migration_plan(inventory, mounts, TARGET).collect()}
    got = {n: (r.method, r.status, r.cloud_path) for n, r in plan.items()}
    mounted = "CREATE ... LOCATION (mount resolved)"
    assert got == {
        "copy": ("DEEP CLONE", "OK", None),
        "ctas": ("CTAS", "OK", None),
        "skip": ("-", "SKIPPED", None),
        "mounted": (mounted, "OK", "abfss://c@x.dfs/t"),
        "exact": (mounted, "OK", "abfss://c@x.dfs"),
        "deep": (mounted, "OK", "abfss://d@x.dfs/t"),
        "near": ("DEEP CLONE", "OK", None),
        "serde": ("-", "FAILED", None),
        "blob": ("-", "FAILED", None),
        "gen1": ("-", "FAILED", None),
        "volume": ("SYNC", "OK", None),
        "cloud": ("SYNC", "OK", None),
        "blank": ("SYNC", "OK", None),
        "view": ("CREATE VIEW", "PLANNED", None),
    }
    assert "register it as abfss://c@acc.dfs.core/t instead" in plan["blob"].message
    assert plan["copy"].target == "main.`sales_uc`.`copy`"


def test_members_precedence_and_unresolved(spark, rows):
    users = spark.createDataFrame([("1", "ann"), ("2", "bob"), ("5", None)], "id string, user_name string")
    spns = spark.createDataFrame([("1", "app"), ("3", "app3")], "id string, application_id string")
    groups = spark.createDataFrame([("g1", "top"), ("g2", "new"), ("g3", "")], "id string, display_name string")
    listed = [("1", None), ("3", ""), ("g2", "Groups/g2"), ("2", "Users/2"), ("1", "ServicePrincipals/1"), ("9", "Users/9"), ("", None), (None, None)]
    members = spark.createDataFrame(
        [("g1", i, v, ref) for i, (v, ref) in enumerate(listed)] + [("g3", 0, "1", None)],
        "group_id string, position int, value string, ref string",
    )
    replica = {
        "users": spark.createDataFrame([("R1", "ann")], "id string, user_name string"),
        "service_principals": spark.createDataFrame([("S1", "app"), ("S3", "app3")], "id string, application_id string"),
        "groups": spark.createDataFrame([("H1", "top")], "id string, display_name string"),
    }
    got = p.translate_members({"users": users, "service_principals": spns, "groups": groups, "members": members}, replica)
    # a member found among the users stays a user, whatever its reference says
    assert rows(got, "group_id", "position", "member_id") == [("H1", 0, "R1"), ("H1", 1, "S3"), ("H1", 2, "new:new"), ("H1", 4, "R1")]


def test_users_payload(spark, rows):
    schema = "user_name string, display_name string, name struct<familyName:string>, active boolean, emails string"
    primary = spark.createDataFrame([("Ann", "A", ("x",), True, "e"), ("bob", "B", None, True, "e"), ("cy", None, ("x",), False, "e"), ("dan", "D", ("x",), True, "e")], schema)
    replica = spark.createDataFrame([("ann",), ("dan",), (None,)], "user_name string")
    assert rows(p.users_to_create(primary, replica), "user_name", "display_name", "name.familyName") == [("Ann", "A", "x"), ("bob", "", None), ("cy", "", None)]


def plain_clean(lines, declared):
    """Line by line, as a person would read the file."""

    def clean(line):
        if not re.search(x.DEPENDS_ON, line):
            return line
        inner = line.split("[", 1)[1].split("]", 1)[0]
        kept = []
        for token in (t.strip() for t in inner.split(",")):
            if token and (not re.match(x.GRANT_REFERENCE, token) or re.sub(x.GRANT_REFERENCE, "", token) in declared):
                kept.append(token)
        return line.split("[", 1)[0] + "[" + ", ".join(kept) + "]" if kept else None

    out, block = [], None
    for no, line in lines:
        if re.match(x.TABLE_BLOCK, line):
            block = [(no, line)]
        elif block is not None:
            block.append((no, line))
            if re.match(r"^\s*\}$", line):
                if not re.search(x.NOT_EXTERNAL, "\n".join(t for _, t in block)):
                    out += [(n, clean(t)) for n, t in block if clean(t) is not None]
                block = None
        else:
            out.append((no, line))
    return out


@pytest.mark.parametrize("seed, chunk", [(1, 3), (2, 7), (3, 100_000)])
def test_config_cleaning_matches_sequential_reading(spark, seed, chunk):
    rnd = random.Random(seed)
    parts = [
        'resource "p_sql_table" "t" {', "}", "  }", '  table_type = "EXTERNAL"', '  table_type = "VIEW"', "  view_definition = 1",
        "  depends_on = [p_grants.a, p_grants.b , x.y]", "  depends_on = [p_grants.b]", "  depends_on = []", "", "# text", "} # open",
    ]
    files = {f: [(n, rnd.choice(parts)) for n in range(size)] for f, size in (("big", 120), ("one", 1), ("mid", 30))}
    df = spark.createDataFrame([(f, n, t) for f, ls in files.items() for n, t in ls], "file string, line_no long, line string")
    grants = spark.createDataFrame([("g", 1, 'resource "p_grants" "a" {')], "file string, line_no long, line string")
    got = x.external_tables(df, x.declared_names(grants), chunk).collect()
    want = [(f, n, t) for f, ls in files.items() for n, t in plain_clean(ls, {"a"})]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.tf").write_text("one\ntwo\n\nfour")
    got = x.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "one"), (1, "two"), (2, ""), (3, "four")]


def test_read_lines_of_split_files(spark, tmp_path):
    for name, n in (("a.tf", 4000), ("b.tf", 3)):
        (tmp_path / name).write_text("\n".join(f"{name} line {i}" for i in range(n)))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = x.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert len(got) == 4003 and all(r.line.endswith(f"line {r.line_no}") for r in got)


def test_ddl_and_comments(spark):
    ddl = "CREATE EXTERNAL TABLE `a`.`b` (x INT)\nUSING csv\nLOCATION 'old'\nTBLPROPERTIES ('k' = 'v')"
    df = spark.createDataFrame([(ddl, "m.`s`.`t`", "p'q$1"), ("CREATE VIEW v", "t", "p")], "ddl string, target string, cloud_path string")
    good, bad = g.rewrite_ddl(df).collect()
    assert good.new_ddl == "CREATE TABLE IF NOT EXISTS m.`s`.`t` (x INT)\nUSING csv\nLOCATION 'p\\'q$1'\nTBLPROPERTIES ('k' = 'v')"
    assert bad.new_ddl is None and bad.error.startswith("Could not rewrite")
    texts = spark.createDataFrame([("note",), (None,)], "c string")
    once = texts.select(g.deprecation_comment(F.col("c"), F.lit("n"), F.lit("o")).alias("c"))
    twice = once.select(g.deprecation_comment(F.col("c"), F.lit("n"), F.lit("o")).alias("c"))
    assert [r.c for r in once.collect()] == [r.c for r in twice.collect()] == [
        "This table is deprecated. Please use n instead of o. note", "This table is deprecated. Please use n instead of o.",
    ]
    assert [r.c for r in twice.select(g.copied_comment(F.col("c")).alias("c")).collect()] == ["note", None]


def test_view_circles_and_what_waits_for_them(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", "e"), ("d", "e"), ("f", "base"), ("g", "f"), ("a", "base"), ("h", "a"), ("h", "f")]
    df = spark.createDataFrame(edges + [("c", "a"), ("g", None)], "view string, depends_on string")
    names = spark.createDataFrame([(v,) for v in "abcdefghi"], "view string")
    got = {r.view: (r.status, r.circle, r.waits_for) for r in g.view_circles(names, df).collect()}
    assert got == {
        "a": ("FAILED", "a", None), "b": ("FAILED", "a", None), "c": ("FAILED", None, "a"), "d": ("FAILED", None, "a"),
        "e": ("FAILED", "e", None), "f": ("OK", None, None), "g": ("OK", None, None), "h": ("FAILED", None, "a"), "i": ("OK", None, None),
    }
    assert g.view_circles(names.limit(0), df.limit(0)).count() == 0


def test_members_of_a_large_group_are_dealt_out(spark):
    users = spark.createDataFrame([(f"u{i}", f"n{i}") for i in range(50)], "id string, user_name string")
    spns = spark.createDataFrame([], "id string, application_id string")
    groups = spark.createDataFrame([(f"g{i}", f"group {i}") for i in range(100)], "id string, display_name string")
    members = spark.createDataFrame(
        [("g1" if i % 2 else f"g{i % 100}", i, f"u{i % 50}", None) for i in range(1000)], "group_id string, position int, value string, ref string"
    )
    replica = {"users": users, "service_principals": spns, "groups": groups}
    got = p.translate_members({**replica, "members": members}, replica)
    assert got.groupBy("group_id").count().filter("group_id = 'g1'").first()["count"] == 500 and got.count() == 1000
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "group_id" in x]
    assert joins and all("_deal" in x for x in joins)
