"""Document scores by masked pseudo-likelihood of a bidirectional window network.

The network predicts the word at a place from the ``REACH`` words on each side of it: their
embeddings, weighted per place of the window, are summed and squashed into a hidden vector,
from which a softmax over word classes and one over the words of the class give the word's
probability. A document's score is the sum of the log-probabilities of all its words, each
with the word itself masked; the mean per word is given beside it.

Everything the network learns comes from all documents: the vocabulary from counts of all
words, the weights from one pass of stochastic gradient descent in numpy over every place
of every text. Its size grows with the number of different words (``side_for``). A word outside
the vocabulary is one of a number of hashed buckets and gets its own share of the bucket's probability,
by counts of all words in ``CELLS`` cells (a cell's words, one as a rule, share alike). The pass is
cut into rounds, each over its share of the documents (by a hash of the text): every task trains on its
rows from the common weights and the tasks' weights are averaged, weighted by words, in a shuffle by
parameter. So the weights depend a little on how rows are dealt to tasks. The driver sees the vocabulary,
the cells and one set of weights, whose sizes are bounded whatever the data.

A window is a shift of the text, so hidden vectors and gradients of a run of text are sums of shifted rows:
each word is looked up, and its gradient added up, once and not once for every window it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import text_of
from opsight.llm.wordhash import Block, blocks
from opsight.scratch import materialize

HIDDEN, REACH = 16, 4
CELLS = 1 << 22
BATCH = 4096
RATE = 0.1

_OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]


def side_for(distinct: int) -> int:
    """Classes, and words per class: 32, 64 or 128, at least half the fourth root of the number of different words."""
    return next((side for side in (32, 64) if distinct**0.25 <= 2 * side), 128)


def buckets_of(side: int) -> int:
    return side * side // 16


class Network:
    """``side`` classes of ``side`` words; word ``side ** 2`` is the padding between texts."""

    def __init__(self, weights: np.ndarray, side: int):
        self.side, self.pad = side, side * side
        self.flat = weights.astype(np.float32)
        at = 0
        for name, shape in self.shapes(side).items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def shapes(side: int) -> dict[str, tuple]:
        return {
            "embed": (side * side + 1, HIDDEN),
            "place": (2 * REACH, HIDDEN),
            "shift": (HIDDEN,),
            "to_class": (HIDDEN, side),
            "class_bias": (side,),
            "to_word": (side, HIDDEN, side),
            "word_bias": (side, side),
        }

    @classmethod
    def start(cls, side: int) -> Network:
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.shapes(side).values())), side)
        chance = np.random.default_rng(7)
        for name in ("embed", "to_class", "to_word"):
            values = getattr(net, name)
            values[...] = chance.normal(0.0, 0.1, values.shape)
        net.place[...] = 1.0
        net.embed[net.pad] = 0.0
        return net

    def hidden(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of a run, and hidden vectors of its places but the ``REACH`` first and last."""
        seen, n = self.embed[run], len(run) - 2 * REACH
        total = np.tile(self.shift, (n, 1))
        for weight, offset in zip(self.place, _OFFSETS, strict=True):
            total += weight * seen[REACH + offset : REACH + offset + n]
        return seen, np.tanh(total)

    def log_probabilities(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a run (``REACH`` left out at both ends) that hold words, and the log-probability of each."""
        target = run[REACH:-REACH]
        places = np.flatnonzero(target != self.pad)
        h, target = self.hidden(run)[1][places], target[places]
        of, member = target // self.side, target % self.side
        out = _log_softmax(h @ self.to_class + self.class_bias)[np.arange(len(of)), of]
        for c, rows in _by_class(of):
            logits = _log_softmax(h[rows] @ self.to_word[c] + self.word_bias[c])
            out[rows] += logits[np.arange(len(rows)), member[rows]]
        return places, out

    def gradients(self, run: np.ndarray) -> dict[str, tuple]:
        """Gradient of the mean loss over a run: by parameter the rows it touches (None: all) and their values."""
        target = run[REACH:-REACH]
        places = np.flatnonzero(target != self.pad)
        seen, all_hidden = self.hidden(run)
        h, target, n = all_hidden[places], target[places], len(places)
        of, member = target // self.side, target % self.side
        error = _softmax(h @ self.to_class + self.class_bias)
        error[np.arange(n), of] -= 1.0
        error /= n
        back = error @ self.to_class.T
        found = {"to_class": (None, h.T @ error), "class_bias": (None, error.sum(axis=0))}
        touched, to_word, bias = [], [], []
        for c, rows in _by_class(of):
            mine = h[rows]
            own = _softmax(mine @ self.to_word[c] + self.word_bias[c])
            own[np.arange(len(rows)), member[rows]] -= 1.0
            own /= n
            back[rows] += own @ self.to_word[c].T
            touched.append(c)
            to_word.append(mine.T @ own)
            bias.append(own.sum(axis=0))
        found["to_word"], found["word_bias"] = (touched, np.array(to_word)), (touched, np.array(bias))
        back *= 1.0 - h * h
        found["shift"] = (None, back.sum(axis=0))
        every = np.zeros_like(all_hidden)
        every[places] = back
        each, place = np.zeros_like(seen), np.empty_like(self.place)
        m = len(every)
        for p, offset in enumerate(_OFFSETS):
            at = slice(REACH + offset, REACH + offset + m)
            place[p] = np.einsum("nh,nh->h", seen[at], every)
            each[at] += self.place[p] * every
        found["place"] = (None, place)
        order = np.argsort(run, kind="stable")
        begins = np.flatnonzero(np.diff(run[order], prepend=-1))
        rows, sums = run[order][begins], np.add.reduceat(each[order], begins, axis=0)
        found["embed"] = (rows[rows != self.pad], sums[rows != self.pad])
        return found


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _by_class(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(of, kind="stable")
    begins = np.flatnonzero(np.diff(of[order], prepend=-1))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(of)], strict=True):
        yield int(of[order[a]]), order[a:b]


class Trainer:
    """Stochastic gradient descent with per-parameter rates (Adagrad)."""

    def __init__(self, net: Network):
        self.net = net
        self.seen = {name: np.full(shape, 1e-6, dtype=np.float32) for name, shape in net.shapes(net.side).items()}

    def step(self, run: np.ndarray) -> None:
        for name, (rows, gradient) in self.net.gradients(run).items():
            values, seen = getattr(self.net, name), self.seen[name]
            if rows is None:
                seen += gradient * gradient
                values -= RATE * gradient / np.sqrt(seen)
            else:
                seen[rows] += gradient * gradient
                values[rows] -= RATE * gradient / np.sqrt(seen[rows])


class Vocabulary:
    """Number of each word by its hash: the rank of frequent words, then hashed buckets, each with the share
    that a word has of its bucket."""

    def __init__(self, hashes: np.ndarray, side: int, shares: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.sorted, self.rank, self.side = hashes[order], order, side
        self.buckets = buckets_of(side)
        self.shares = shares  # logarithms, by cell

    def __call__(self, words: np.ndarray) -> np.ndarray:
        other = (self.side**2 - self.buckets + (words & np.uint64(self.buckets - 1))).astype(np.int64)
        if not len(self.sorted):
            return other
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.rank[at], other)

    def log_share(self, words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Logarithm of the share that each word has of the probability of its number."""
        cells = (words & np.uint64(len(self.shares) - 1)).astype(np.int64)
        return np.where(numbers >= self.side**2 - self.buckets, self.shares[cells], np.float32(0.0))


def runs(block: Block, numbers: np.ndarray, pad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of a block's texts, ``REACH`` padding between and around them, and the word (-1: none) at each inner place.

    Consecutive runs overlap by their ends, so every word is an inner place of one run.
    """
    n = np.diff(block.at)
    text = np.repeat(np.arange(len(n)), n)
    padded = np.full(len(numbers) + REACH * (len(n) + 1), pad, dtype=np.int32)
    word = np.full(len(padded), -1, dtype=np.int64)
    place = np.arange(len(numbers)) + REACH * (text + 1)
    padded[place], word[place] = numbers, np.arange(len(numbers))
    for a in range(REACH, len(padded) - REACH, BATCH):
        b = min(a + BATCH, len(padded) - REACH)
        if (word[a:b] >= 0).any():
            yield padded[a - REACH : b + REACH], word[a:b]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [b.words for b in blocks(batch.column(0))]
        found, n = np.unique(np.concatenate(words), return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, int))
        columns = [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n"])


def vocabulary_of(texts: DataFrame) -> Vocabulary:
    """Numbers of the most frequent words over all texts, and the shares of the others in their buckets."""
    counts = materialize(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    distinct = counts.count()
    side = side_for(distinct)
    buckets, cells = buckets_of(side), min(CELLS, 1 << max(10, (4 * distinct).bit_length()))
    top = counts.orderBy(F.col("n").desc(), "word").limit(side**2 - buckets).collect()
    rest = counts
    if len(top) == side**2 - buckets:
        last = top[-1]
        rest = counts.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))
    else:
        rest = counts.limit(0)
    by_cell = rest.groupBy(F.col("word").bitwiseAND(F.lit(cells - 1)).cast("int").alias("cell"))
    by_cell = by_cell.agg((F.sum("n") / F.count(F.lit(1))).cast("float").alias("each"), F.sum("n").alias("n"))
    by_cell = materialize(by_cell, "word-cells")
    totals = {r["b"]: r["n"] for r in by_cell.groupBy(F.col("cell").bitwiseAND(F.lit(buckets - 1)).alias("b")).agg(F.sum("n").alias("n")).collect()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False).astype(t)).tobytes() for i, t in ((0, "<i4"), (1, "<f4"))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["cells", "each"])

    shares = np.zeros(cells, dtype=np.float32)
    for r in by_cell.select("cell", "each").mapInArrow(pack, "cells binary, each binary").collect():
        at = np.frombuffer(r["cells"], dtype="<i4")
        whole = np.array([totals[b] for b in (at & (buckets - 1)).tolist()], dtype=np.float64)
        shares[at] = np.log(np.frombuffer(r["each"], dtype="<f4") / whole)
    hashes = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    return Vocabulary(hashes, side, shares)


def _train(hashes: np.ndarray, side: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net, n = Vocabulary(hashes, side), Network(weights.copy(), side), 0
        trainer = Trainer(net)
        for batch in batches:
            for block in blocks(batch.column(0)):
                for piece, _ in runs(block, vocabulary(block.words), net.pad):
                    trainer.step(piece)
                n += len(block.words)
        if n:
            columns = [pa.array([n], pa.int64()), pa.array([net.flat.astype(np.float32)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "weights"])

    return run


def trained(texts: DataFrame, vocabulary: Vocabulary, rounds: int) -> np.ndarray:
    """Weights after one pass over ``texts`` (column ``_text``) in ``rounds`` shares."""
    weights = Network.start(vocabulary.side).flat
    hashes = np.zeros(len(vocabulary.sorted), dtype=np.uint64)
    hashes[vocabulary.rank] = vocabulary.sorted
    for r in range(rounds):
        share = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(rounds)) == r)
        tasks = share.mapInArrow(_train(hashes, vocabulary.side, weights), "n long, weights array<float>")
        values = tasks.select("n", F.posexplode("weights").alias("place", "value"))
        mean = F.sum(F.col("n") * F.col("value").cast("double")) / F.sum("n")
        merged = values.groupBy("place").agg(mean.alias("value")).orderBy("place").collect()
        if merged:
            weights = np.array([m["value"] for m in merged], dtype=np.float32)
    return weights


def _score(vocabulary: Vocabulary, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights, vocabulary.side)
        for batch in batches:
            for block in blocks(batch.column(1)):
                numbers = vocabulary(block.words)
                each = vocabulary.log_share(block.words, numbers).astype(float)
                for piece, word in runs(block, numbers, net.pad):
                    places, p = net.log_probabilities(piece)
                    each[word[places]] += p
                text = np.repeat(np.arange(len(block.at) - 1), np.diff(block.at))
                sums = np.bincount(text, each, minlength=block.last - block.first)
                ids = batch.column(0).slice(block.first, block.last - block.first)
                columns = [ids, pa.array(np.diff(block.at).astype(np.int64)), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "log_likelihood"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """One row per document: id, ``n_words``, ``log_likelihood`` (sum over its words of the
    log-probability given both sides) and ``mean_log_likelihood``.

    Null and empty texts have no words: sum 0, mean null. Every word counts, at the edges
    with a shorter context. Words outside the vocabulary get their share of the probability of
    a hashed bucket. Repeated rows are scored, and trained on, each; null ids are documents of
    their own. Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(text_of(text_col).alias("_text"))
    vocabulary = vocabulary_of(texts)
    weights = trained(texts, vocabulary, rounds)
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    scored = chosen.mapInArrow(_score(vocabulary, weights), f"_id {kind}, n_words long, log_likelihood double")
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scored.withColumnRenamed("_id", id_col).withColumn("mean_log_likelihood", mean)
