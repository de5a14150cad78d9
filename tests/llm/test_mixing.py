import random

from opsight.llm.mixing import mix, mixed
from tests.llm.conftest import words


def targets(sizes, weights=(5, 2, 1)):
    """Water filling step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def rows(n=600):
    chance = random.Random(1)
    sources = ["a", "b", "é", "z", None]
    return [(i, "w " * chance.randint(0, 60), "en", sources[chance.randint(0, 4) if i % 3 else 0]) for i in range(n)]


def test_targets_and_shares(documents):
    data = rows()
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    got = mix(documents(data)).collect()
    assert len(got) == len(data)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 61


def test_reruns_agree(documents):
    data = rows(300)
    once = sorted(mix(documents(data)).select("doc_id", "taken").collect())
    again = sorted(mix(documents(data[::-1]).repartition(7)).select("doc_id", "taken").collect())
    assert once == again


def test_edge_rows(documents):
    data = [(1, None, "en", "a"), (2, "", "en", "a"), (None, "one two", "en", None), (3, "w " * 50_000, "en", "b")]
    got = {r["doc_id"]: r for r in mix(documents(data)).collect()}
    assert got[1]["taken"] == got[2]["taken"] == 0
    assert got[None]["size"] == 2
    assert got[3]["taken"] <= 2 * got[3]["size"]
    assert mix(documents([])).count() == 0
    assert mix(documents([(1, None), (2, "")])).filter("taken <> 0").count() == 0


def test_rows_are_repeated_as_taken(documents):
    docs = documents(rows(200) + [(5, "same words here", "en", "a")] * 2)
    copies = {}
    for r in mix(docs).collect():
        copies[r["order_key"]] = copies.get(r["order_key"], 0) + r["copies"]
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(copies.values())
