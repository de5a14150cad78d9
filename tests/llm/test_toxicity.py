import random
import zlib

from opsight.llm.toxicity import PAD, Distance, toxicity

INSULTS = "wretchedfool miserableclod vileswine rottenscum".split()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=1200):
    chance = random.Random(1)
    syllables = "ka lo mi ren tas ul ve son dor bi".split()
    word = lambda: "".join(chance.choices(syllables, k=chance.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        text, toxic = [word() for _ in range(chance.randint(40, 200))], int(chance.random() < 0.2)
        for _ in range(3 * toxic):
            text.insert(chance.randrange(len(text)), chance.choice(INSULTS))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(5000, None), (5001, ""), (None, "nothing to see"), (5002, "ka lo " * 30_000 + INSULTS[0]), (5003, "!?")]
    got = {r["doc_id"]: r for r in toxicity(documents(rows + extra), table).collect()}
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    truth = {i: t for i, _, t in labels}
    tested = [i for i in truth if held_out(i)]
    assert all(got[i]["held_out"] == held_out(i) for i in truth)
    assert sum(got[i]["predicted"] == truth[i] for i in tested) / len(tested) > 0.95
    assert not got[5000]["predicted"] and got[5000]["score"] == got[5001]["score"]


def test_a_language_of_few_labels(spark, documents):
    """Twenty toxic texts in another script and with endless endings of one stem are enough to find others."""
    rows, labels = corpus(1500)
    chance = random.Random(5)
    parts = "жа ро ми лен тас уль ве сон дор би кра".split()
    word = lambda: "".join(chance.choices(parts, k=chance.randint(1, 3)))
    for i in range(10_000, 10_200):
        text, toxic = [word() for _ in range(100)], int(i % 5 == 0)
        for _ in range(6 * toxic):
            text.insert(chance.randrange(100), "гнусняк" + word())
        rows.append((i, " ".join(text), "xx", "s"))
        labels.append((i, 1, toxic))
    known = sum(t for i, _, t in labels if i >= 10_000 and not held_out(i))
    assert 20 <= known <= 35
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity(documents(rows), table).collect()}
    tested = [(got[i], t) for i, _, t in labels if i >= 10_000 and held_out(i)]
    assert sum(p for p, t in tested if t) >= 0.8 * sum(t for _, t in tested)
    assert sum(p for p, t in tested if not t) <= 0.1 * len(tested)


def test_counts_by_a_plain_loop():
    distance = Distance(b" ka lo mi ren tas ", b" wretchedfool vileswine ")
    text = "Ka lo wretchedfool, mi vileswine! ren 12 wretchedfoolish"
    saved = []
    for word in text.lower().replace(",", "").replace("!", "").split():
        if word != "12":
            window = b" " + word.encode() + b" " + PAD
            saved.append(len(distance.plain(window)) - len(distance.both(window)))
    assert distance.counts(text) == [7, *[sum(s >= k for s in saved) for k in range(1, 9)]]
    assert distance.counts(text)[3] >= 3 and distance.counts(None) == [0] * 9


def test_held_out_labels_are_not_used(spark, documents):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if held_out(i) else t) for i, q, t in labels]
    scores = []
    for data in (labels, flipped):
        table = spark.createDataFrame(data, "doc_id long, quality int, toxic int")
        scores.append(sorted((r["doc_id"], r["score"]) for r in toxicity(documents(rows), table).collect()))
    assert scores[0] == scores[1]


def test_without_labels(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    rows = [(1, "some text"), (2, "other text")]
    for labels in ([], [(1, 1, None), (None, 1, 1)], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (1, 0, 1)]):
        got = toxicity(documents(rows), spark.createDataFrame(labels, schema)).collect()
        assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity(documents([]), spark.createDataFrame([], schema)).count() == 0
