import math
import random

import numpy as np
import pyarrow as pa

from opsight.llm import lm_score as lm
from opsight.llm.wordhash import blocks

STARTS, ENDS = ["red", "blue", "green"], ["fox", "bird", "snake"]


def sentence(chance, n=30):
    """Pairs whose second word follows from the first."""
    out = []
    for _ in range(n):
        k = chance.randrange(3)
        out += [STARTS[k], ENDS[k]]
    return " ".join(out)


def test_learns_what_stands_beside(documents):
    chance = random.Random(1)
    rows = [(i, sentence(chance, 400)) for i in range(600)]
    right = "blue bird red fox green snake " * 4
    wrong = "blue fox red snake green bird " * 4
    rows += [(1000, right), (1001, wrong), (1002, None), (1003, ""), (None, "red"), (1004, right), (1005, "x " * 20_000)]
    got = {r["doc_id"]: r for r in lm.lm_scores(documents(rows).coalesce(1)).collect()}
    assert len(got) == len(rows)
    assert got[1000]["mean_log_likelihood"] > got[1001]["mean_log_likelihood"] + 0.5
    assert got[1000]["log_likelihood"] == got[1004]["log_likelihood"]
    assert got[1002]["n_words"] == got[1003]["n_words"] == 0
    assert got[1002]["log_likelihood"] == 0 and got[1002]["mean_log_likelihood"] is None
    assert got[None]["n_words"] == 1 and got[1005]["n_words"] == 20_000
    assert lm.lm_scores(documents([])).count() == 0


def random_net(side=32, seed=1):
    net = lm.Network.start(side)
    net.flat += np.random.default_rng(seed).normal(0, 0.3, len(net.flat)).astype(np.float32)
    net.embed[net.pad] = 0.0
    return net


def slow_log_probability(net, words, i):
    """Of word ``i`` of a text, place by place and number by number."""
    h = [float(x) for x in net.shift]
    for p, offset in enumerate([*range(-lm.REACH, 0), *range(1, lm.REACH + 1)]):
        if 0 <= i + offset < len(words):
            h = [a + float(w) * float(e) for a, w, e in zip(h, net.place[p], net.embed[words[i + offset]])]
    h = np.tanh(h)

    def log_softmax(logits, k):
        return logits[k] - math.log(sum(math.exp(x) for x in logits))

    c, m = divmod(int(words[i]), net.side)
    of_class = [sum(h * net.to_class[:, k]) + net.class_bias[k] for k in range(net.side)]
    of_word = [sum(h * net.to_word[c][:, k]) + net.word_bias[c][k] for k in range(net.side)]
    return log_softmax(of_class, c) + log_softmax(of_word, m)


def test_scores_equal_a_slow_forward_pass(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 13)
    net = random_net()
    words = "a b c d e f g h i j k l m".split()
    chance = random.Random(2)
    texts = [" ".join(chance.choices(words, k=n)) for n in (1, 0, 3, 40, 7)] + [None, "a"]
    frequent = np.unique(next(blocks(pa.array(["a b c d e f"]))).words)
    shares = np.random.default_rng(3).normal(-2, 1, 1024).astype(np.float32)
    vocabulary = lm.Vocabulary(frequent, 32, shares)
    table = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["_id", "_text"])
    got = [r for b in lm._score(vocabulary, net.flat)(iter([table])) for r in b.to_pylist()]
    for text, row in zip(texts, got):
        hashes = next(blocks(pa.array([text or ""]))).words
        numbers = vocabulary(hashes)
        want = sum(slow_log_probability(net, numbers, i) for i in range(len(numbers)))
        want += sum(float(shares[int(w) % 1024]) for w, k in zip(hashes, numbers) if k >= 1024 - 64)
        assert row["n_words"] == len(numbers) and abs(row["log_likelihood"] - want) < 1e-3 * max(1, abs(want))


def test_probabilities_add_up_to_one():
    net = random_net()
    total = 0.0
    for k in range(net.side**2):
        run = np.array([1, 2, 3, 4, k, 5, 6, 7, 8], dtype=np.int32)
        total += math.exp(float(net.log_probabilities(run)[1][0]))
    assert abs(total - 1) < 1e-3


def test_gradients_are_those_of_the_loss():
    net = random_net(seed=4)
    run = np.random.default_rng(4).integers(0, net.pad + 1, 40).astype(np.int32)
    found = net.gradients(run)
    for name, (rows, gradient) in found.items():
        values = getattr(net, name)
        place = tuple(np.unravel_index(np.abs(gradient).argmax(), gradient.shape))
        at = (rows[place[0]], *place[1:]) if rows is not None else place
        old, step = values[at], 1e-2
        loss = []
        for move in (step, -step):
            values[at] = old + move
            loss.append(-net.log_probabilities(run)[1].astype(float).mean())
        values[at] = old
        assert abs((loss[0] - loss[1]) / (2 * step) - gradient[place]) < 2e-3, name


def test_context_does_not_cross_texts():
    block = next(blocks(pa.array(["a b", "c", None, "d e"])))
    (run, word), = lm.runs(block, np.arange(5), 99)
    assert word[word >= 0].tolist() == [0, 1, 2, 3, 4]
    at = np.flatnonzero(run != 99)
    assert np.diff(at).tolist() == [1, lm.REACH + 1, 2 * lm.REACH + 1, 1]


def test_words_of_a_bucket_share_it(spark):
    rows = [("often " * 50 + "rare once",)] + [(" ".join(f"w{i}" for i in range(3000)),)] * 3
    vocabulary = lm.vocabulary_of(spark.createDataFrame(rows, "_text string"))
    words = next(blocks(pa.array(["often rare w5 w2999"]))).words
    numbers = vocabulary(words)
    share = np.exp(vocabulary.log_share(words, numbers))
    assert share[0] == 1.0 and 0 < share[1] < 1
    outside = numbers >= 32 * 32 - 64
    assert outside[1] and (share[outside] < 0.5).all()
    every = next(blocks(pa.array([rows[0][0] + " " + rows[1][0]]))).words
    every = np.unique(every)
    numbers = vocabulary(every)
    for bucket in (960, 1000, 1023):
        mine = every[numbers == bucket]
        assert abs(np.exp(vocabulary.log_share(mine, np.full(len(mine), bucket))).sum() - 1) < 0.05


def test_the_vocabulary_grows():
    assert [lm.side_for(n) for n in (0, 10**3, 10**6, 10**8, 10**9)] == [32, 32, 32, 64, 128]
