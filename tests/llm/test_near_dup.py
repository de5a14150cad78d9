import random

import numpy as np
import pyarrow as pa
import pytest

from opsight.llm.components import components
from opsight.llm.near_dup import COMPARED, deduplicate, near_duplicates, signatures
from opsight.llm.wordhash import blocks, shingles
from tests.llm.conftest import ascii_lower, words


def sets_of(text, size):
    w = words(ascii_lower(text))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_force(rows, size, percent):
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(sets[i]), least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows)]


def family(seed, n, length, edits):
    """Copies of one text, each a further edit of a random earlier one."""
    chance = random.Random(seed)
    texts = [[f"w{chance.randint(0, 10_000)}" for _ in range(length)]]
    while len(texts) < n:
        copy = list(chance.choice(texts))
        for _ in range(chance.randint(0, edits)):
            copy[chance.randrange(length)] = f"w{chance.randint(0, 10_000)}"
        texts.append(copy)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("size", "similarity"), [(3, 0.85), (5, 0.8)])
def test_against_brute_force(documents, size, similarity):
    texts = family(1, 60, 120, 4) + family(2, 40, 60, 6) + family(3, 20, 15, 2) + [f"alone {i} a b c d e f" for i in range(9)]
    texts += ["", None, "  \t", "two words", "TWO words", "one", "a b c", "A B C"]
    order = list(range(len(texts)))
    random.Random(4).shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    got = near_duplicates(documents(rows), size=size, similarity=similarity).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows, size, round(100 * similarity)))


def test_more_members_than_a_block(documents):
    """A bucket over the block size whose members the least one does not hold together."""
    rows = list(enumerate(family(5, 2 * COMPARED, 100, 3)))
    got = near_duplicates(documents(rows), size=3, similarity=0.85).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows, 3, 85))


def test_edge_rows(documents):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")]
    rows += [(5, "x " * 60_000), (6, "x " * 60_001)]
    got = sorted(map(tuple, near_duplicates(documents(rows)).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (None, 2, None, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)]
    assert got == sorted([*want, (5, 1, 5, True), (6, 1, 5, False)], key=repr)
    assert near_duplicates(documents([])).count() == 0


def test_one_document_of_a_group_stays(documents):
    docs = documents(list(enumerate(family(6, 30, 100, 1))) + [(None, "no id"), (99, "other words of its own here")])
    out = deduplicate(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"] for r in near_duplicates(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == want
    assert {None, 0, 99} <= want


def test_signatures_estimate_similarity():
    a, b = (np.random.default_rng(s).integers(0, 2**63, 3000).astype(np.uint64) for s in (1, 2))
    b = np.concatenate([a[:2000], b[:1000]])
    signed = signatures(np.concatenate([a, b]), np.array([0, 3000]), 1000)
    assert abs((signed[0] == signed[1]).mean() - 0.5) < 0.06


def test_shingles_do_not_cross_texts_or_depend_on_blocks():
    texts = ["Ünï Code a b", None, "", "x", " lead and trail ", "ÜNÏ CODE A b"]
    together = next(blocks(pa.array(texts)))
    hashes, begins = shingles(together, 2)
    alone = [shingles(next(blocks(pa.array([t]))), 2)[0] for t in texts]
    for i, single in enumerate(alone):
        assert np.array_equal(hashes[begins[i] : begins[i + 1]], single)
    assert [len(x) for x in alone] == [3, 0, 0, 1, 2, 3]
    assert len(set(alone[0]) & set(alone[5])) == 2  # Ï is not lower-cased, A-Z are


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*chain, *star, (200, 201), (201, 200), (7, 7)], "u long, v long")
    got = dict(tuple(r) for r in components(edges).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(edges.limit(0)).count() == 0


def test_one_id_on_several_texts(documents):
    """Ids shared by different texts: links of each text count, and only the copy goes."""
    base, other = family(7, 1, 100, 0)[0], family(8, 1, 100, 0)[0]
    near = " ".join(base.split()[:-1])
    twin = " ".join(other.split()[:-1])
    rows = [(3, base), (7, near), (7, "a text of its own under the same id"), (5, other), (5, twin), (3, "one more alone here")]
    got = near_duplicates(documents(rows)).collect()
    assert sorted(r["component_id"] for r in got) == [3, 3, 3, 5, 5, 7]
    stay = {(r["doc_id"], r["text"]) for r in deduplicate(documents(rows)).collect()}
    assert stay - {(5, other), (5, twin)} == {rows[0], rows[2], rows[5]}
    assert len(stay & {(5, other), (5, twin)}) == 1
