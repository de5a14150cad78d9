import random

import pytest

from opsight.operators.content import Difference, differences, differing_ranges, key_bounds

SCHEMA = "k long, v string, x double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def base(n=3000):
    rng = random.Random(1)
    return [(i * 3, f"v{rng.randint(0, 50)}", rng.random()) for i in range(n)]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_changed_value_opens_one_range(spark, tmp_path):
    rows = base()
    changed = [(k, "other" if k == 4500 else v, x) for k, v, x in rows]
    random.Random(2).shuffle(changed)
    table(spark, rows).repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "a"))
    table(spark, changed).repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    d = differing_ranges(a, b, "k")
    assert len(d.leaves) == 1 and d.compared <= 1 + 16 + 16
    from pyspark.sql import functions as F

    opened = a.filter(d.within(F.col("k")))
    assert opened.count() < 60
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(k," in plan and "LessThan(k," in plan
    assert found(differences(a, b, "k")) == [(4500, "changed", 1, 1)]


@pytest.mark.parametrize("ranges", [1, 5, 16, 17, 256])
def test_every_kind_of_difference(spark, ranges):
    rows = base(400) + [(None, "n", 1.0), (7, "twice", None), (7, "twice", None), (8, None, None)]
    other = [r for r in rows if r[0] not in (30, 600)] + [(1, "new", 0.0), (None, "n", 1.0), (7, "twice", None)]
    other = [(k, "z" if k == 900 else v, x) for k, v, x in other]
    wanted = [(1, "only_right", 0, 1), (30, "only_left", 1, 0), (600, "only_left", 1, 0), (7, "changed", 2, 3), (900, "changed", 1, 1), (None, "changed", 1, 2)]
    assert found(differences(table(spark, rows), table(spark, other), "k", ranges)) == sorted(wanted, key=repr)


def test_equal_tables_and_empty_ones(spark):
    rows = base(100)
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    assert found(differences(table(spark, rows), table(spark, mixed), "k")) == []
    assert differing_ranges(table(spark, rows), table(spark, mixed), "k").compared == 1
    assert found(differences(table(spark, []), table(spark, []), "k")) == []
    assert len(found(differences(table(spark, []), table(spark, rows), "k"))) == 100
    assert key_bounds(table(spark, []), "k", 8) == []


def test_swapped_values_do_not_cancel(spark):
    a = [(1, "x", 1.0), (2, "y", 2.0)]
    b = [(1, "y", 1.0), (2, "x", 2.0)]
    assert [r[1] for r in found(differences(table(spark, a), table(spark, b), "k"))] == ["changed", "changed"]


def test_text_keys_and_other_columns(spark):
    a = spark.createDataFrame([(f"k{i:03}", i) for i in range(200)], "id string, left long")
    b = spark.createDataFrame([(f"k{i:03}", i + (i == 77)) for i in range(200)], "id string, left long")
    assert found(differences(a, b, "id")) == [("k077", "changed", 1, 1)]
    with pytest.raises(ValueError):
        differences(a, b.withColumnRenamed("left", "right"), "id")


def test_ranges_side_by_side_are_one_span(spark):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "k long")
    bounds = list(range(10, 100, 10))
    within = lambda leaves: keys.filter(Difference(leaves, 0, bounds).within(F.col("k")))
    assert sorted(r.k for r in within([1, 2, 5, 9]).collect()) == [*range(10, 30), *range(50, 60), *range(90, 100)]
    assert within([0]).count() == 11 and within(list(range(10))).count() == 101 and within([]).count() == 0
    plan = within([1, 2, 3, 4])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">=") == 1 and plan.count("< ") == 1
