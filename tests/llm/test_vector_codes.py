import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsight.llm import vector_codes as V
from opsight.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The whole query with plain loops."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(mine[e]) for x in zip(*mine[e])) if e in mine else entry for e, entry in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = []
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    return sorted(((i, code, error, total[label], digest) for i, code, error, label in coded), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, seed=1, dims=32, spread=0.02):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(7)]
    return [(k * 3 % 101 + k, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for k in range(n)]


def test_equals_plain_loops(spark):
    rows = vectors(300) + [(5, vectors(1)[0][1], None)] * 50
    assert result(V.vector_codes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_rows_that_do_not_count(spark):
    good = vectors(80, seed=2)
    bad = [(900, None, 1), (901, [], 1), (902, [None] * 32, 1), (903, [float("nan")] * 32, 2), (904, [0.1] * 31 + [float("inf")], 2)]
    odd = [(905, [0.5] * 16, 1), (906, [0.5] * 33, 1), (907, [1e30] * 32, 1)]
    table = spark.createDataFrame(good + bad + odd, SCHEMA)
    assert result(V.vector_codes(table)) == brute(good)


def test_ties_repeats_and_null_ids(spark):
    rows = [(1, [0.5] * 16, None), (1, [-0.5] * 16, None), (1, [0.5] * 16, 3), (None, [0.0] * 16, 3), (None, [0.001] * 16, None)]
    assert result(V.vector_codes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert V.vector_codes(table).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert result(V.vector_codes(table)) == []
    rows = vectors(40, seed=3)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "code", "error", "_label", "total")})
    assert result(V.vector_codes(more)) == brute(rows)


@pytest.mark.parametrize("subtree", [1, 7, 1 << 11])
def test_the_trie_finds_nearest_entries(monkeypatch, subtree):
    monkeypatch.setattr(V, "SUBTREE", subtree)
    rng = np.random.default_rng(4)
    parts = np.unique(rng.integers(-6, 6, size=(400, 3)), axis=0)
    book = rng.integers(-6, 6, size=(9, 3))
    distances = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    trie = V.Trie(parts, book)
    assert (trie.entry == distances.argmin(axis=1)).all() and (trie.error == distances.min(axis=1)).all()


def test_small_gathers_change_nothing(spark, monkeypatch):
    rows = vectors(200, seed=5)
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert result(V.vector_codes(table)) == brute(rows)


def test_sql_gives_the_same(spark):
    from tools.compare import duck, rows

    folder = "/root/testdata/sf0.001"
    df = QUERIES["op13_vector_codes"](spark, folder)
    wanted = duck(folder).execute(ORACLE["op13_vector_codes"])
    columns = [d[0] for d in wanted.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, wanted.fetchall())
