"""Every query on the smallest data; those that SQL can say against DuckDB; the pipeline stage by stage."""

import re
from collections import Counter

import pytest

import __spark_entry__ as entrypoint
import corpus_pipeline as pipeline
from opsight.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import ascii_lower, words
from tests.llm.test_mixing import targets
from tests.llm.test_near_dup import brute_force
from tools.compare import duck, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    assert got or name == "op3_license_scan"
    if name in ORACLE:
        result = duck(FOLDER).execute(ORACLE[name])
        columns = [d[0] for d in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, result.fetchall())


def test_all_are_registered():
    names = set(entrypoint.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for _, stage in pipeline.STAGES:
        steps.append(stage(spark, steps[-1], FOLDER))
    data = [{r["doc_id"]: r for r in s.collect()} for s in steps[:4]]
    assert all(s.columns == columns for s in steps[:-1])

    kept = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, FOLDER).filter("kept").collect()}
    assert set(data[1]) == kept
    largest = {}
    for r in data[1].values():
        key = ascii_lower(r["text"])
        largest[key] = max(r["doc_id"], largest.get(key, -1))
    assert set(data[2]) == set(largest.values())
    texts = [(r["doc_id"], r["text"]) for r in data[2].values()]
    assert set(data[3]) == {i for i, _, _, stays in brute_force(texts, 5, 80) if stays}

    sizes = Counter()
    for r in data[3].values():
        sizes[r["source"]] += len(words(r["text"]))
    want, taken, uses = targets(sizes), Counter(), Counter()
    for r in steps[4].collect():
        assert r == data[3][r["doc_id"]]
        taken[r["source"]] += len(words(r["text"]))
        uses[r["doc_id"]] += 1
    assert max(uses.values()) == 2
    longest = max(len(words(r["text"])) for r in data[3].values())
    assert all(abs(taken[s] - want[s]) <= 2 * longest for s in sizes)

    pieces = Counter()
    for p in steps[5].collect():
        pieces[p["doc_id"]] += p["length"]
        pieces[p["doc_id"], "tokens"] = p["doc_tokens"]
    assert all(pieces[i] == n * pieces[i, "tokens"] for i, n in uses.items())
    assert set(uses) == {k for k in pieces if not isinstance(k, tuple)}


def test_quality_verdicts_stay_with_their_rows(spark):
    """Rows without an id, or with one that a rejected row has too, are judged by their own text."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, FOLDER).filter("kept").collect()}
    every = docs.collect()
    good = [r for r in every if r["doc_id"] in kept]
    for shared in ("null", "7"):
        renamed = docs.selectExpr(f"cast({shared} as bigint) as doc_id", *docs.columns[1:])
        left = pipeline.quality_stage(spark, renamed, FOLDER).collect()
        assert len(good) < len(every)
        assert sorted((r["text"], r["lang"]) for r in left) == sorted((r["text"], r["lang"]) for r in good)


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
