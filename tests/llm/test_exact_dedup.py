import hashlib
from collections import defaultdict

from opsight.llm.exact_dedup import deduplicate, exact_duplicates
from tests.llm.conftest import ascii_lower

ROWS = [
    (1, "Same Text"),
    (2, "same text"),
    (3, "SAME TEXT"),
    (4, "same  text"),
    (5, "ÉTÉ"),
    (6, "été"),
    (7, None),
    (8, ""),
    (9, "only"),
    (9, "only"),
    (None, "lost"),
    (None, "lost"),
    (None, "same text"),
    (10, "x" * 200_000),
    (11, "X" * 200_000),
]


def test_against_brute_force(documents):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[ascii_lower(t)].append(i)
    want = []
    for i, t in ROWS:
        ids = groups[ascii_lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        sha = hashlib.sha256(ascii_lower(t).encode()).hexdigest()
        want.append((i, keep, len(ids), i == keep, sha))
    got = [tuple(r) for r in exact_duplicates(documents(ROWS).repartition(5)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_row_of_each_text_stays(documents):
    docs = documents(ROWS)
    stay = deduplicate(docs)
    assert stay.columns == docs.columns
    texts = [ascii_lower(r["text"]) for r in stay.collect()]
    assert sorted(texts) == sorted({ascii_lower(t) for _, t in ROWS})


def test_hot_text(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text").repartition(9)
    got = exact_duplicates(docs)
    assert got.filter("group_size = 1000 and keep_id = 2997").count() == 1000
    assert got.filter("kept").count() == 2001


def test_empty_table(documents):
    assert exact_duplicates(documents([])).count() == 0
    assert deduplicate(documents([])).count() == 0
