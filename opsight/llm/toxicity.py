"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled text, one on windows of ordinary documents, one
on windows of toxic documents. A window is a word with a fixed run of characters behind it, long enough
for the compressor to look at the word as a whole. It is compressed with the ordinary dictionary, and with
the toxic one loaded behind it; the bytes that the second saves are the window's distance. How
many windows of the whole text save at least one, two, ... bytes, against what that many words of ordinary
documents save, is turned into a probability by a logistic curve, so thresholds are calibrated.

A toxic document consists of ordinary words but for a few, so the toxic dictionary is trained on those of
its windows that hold a string (``GRAM`` bytes, words and neighbours alike) which toxic documents have
much more often than ordinary ones; stems count as strings, whatever their endings. Counts of
strings are hashed and summed by Spark.

Training documents are at most about ``fit_rows`` labelled ones, each text once; folds 0 and 1 choose
and train the dictionaries, fold 3 calibrates, so windows that a dictionary knows by heart do not pass
for evidence. Fold 2 is held out. The driver holds the ids of the sample, words for the dictionaries
(``SAMPLES``), and one row of counts per calibration document; all are bounded by parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import text_of
from opsight.llm.wordhash import mix64
from opsight.scratch import materialize

GRAM = 5
CELLS = 1 << 20
LEVELS = 8
LEVEL = 12
SAMPLES = 200_000
REPEATS = 32
KNOWN = 1 << 19
PAD = b"0123456789ABCDEF"
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


def words_of_text(text: str | None) -> list[bytes]:
    """Runs of letters (all bytes beyond ASCII count as such), A-Z in lower case."""
    return _LETTERS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _compressor(content: bytes):
    content += PAD
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=64,
        dict_size=len(content),
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


class Distance:
    """Bytes that the toxic dictionary saves in a window; remembered per word, ``KNOWN`` at most."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = _compressor(ordinary), _compressor(ordinary + toxic)
        self.known: dict[bytes, int] = {}

    def __call__(self, word: bytes) -> int:
        window = b" " + word + b" " + PAD
        saved = len(self.plain(window)) - len(self.both(window))
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[word] = saved
        return saved

    def counts(self, text: str | None) -> list[int]:
        """Words, and how many of them save at least 1, 2, ... ``LEVELS`` bytes."""
        words, known = words_of_text(text), self.known
        saved = [s if (s := known.get(w)) is not None else self(w) for w in words]
        high = np.bincount(np.clip(np.array(saved, dtype=np.int64), 0, LEVELS), minlength=LEVELS + 1)
        return [len(words), *np.cumsum(high[::-1])[::-1][1:].tolist()]


@lru_cache(maxsize=2)
def _distance(ordinary: bytes, toxic: bytes) -> Distance:
    return Distance(ordinary, toxic)


def features(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Of each document (words, windows per level): how far it is over what ordinary words would save."""
    n, high = counts[:, :1], counts[:, 1:]
    expected = n * rates
    return np.column_stack([(high - expected) / np.sqrt(expected + 1.0), np.log1p(high) - np.log1p(expected), np.log(n + 5.0)])


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic curve over scaled features; ``weights``: intercept, slopes, means, spreads."""
    slopes, means, spreads = weights[1:].reshape(3, -1)
    z = weights[0] + ((x - means) / spreads) @ slopes
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until they improve; without both classes, the base rate alone."""
    width = x.shape[1]
    means = x.mean(axis=0) if len(x) else np.zeros(width)
    spreads = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(width)
    beta = np.zeros(width + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 1e-6
    beta[0] = np.log(rate / (1.0 - rate))
    if len(y) and 0 < y.sum() < len(y):
        z = np.column_stack([np.ones(len(x)), (x - means) / spreads])
        penalty = np.diag([0.0] + [ridge] * width)

        def worth(b: np.ndarray) -> float:
            e = z @ b
            return float(-(y * np.logaddexp(0, -e) + (1 - y) * np.logaddexp(0, e)).sum() - 0.5 * b @ penalty @ b)

        now = worth(beta)
        for _ in range(steps):
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -35.0, 35.0)))
            gradient = z.T @ (y - p) - penalty @ beta
            hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(width + 1)
            step, share = np.linalg.solve(hessian, gradient), 1.0
            while share > 1e-6 and worth(beta + share * step) < now:
                share /= 2
            beta = beta + share * step
            before, now = now, worth(beta)
            if now - before < 1e-9:
                break
    return np.concatenate([beta, means, spreads])


def fold_of(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """About ``fit_rows`` labelled documents outside the held-out fold: ``_text``, ``_toxic``, ``_fold``.

    A document with several labels counts by the largest. The sample is taken by a hash of the id, so
    it is the same in every run. Its ids go to the tasks, which pick the texts as they read them:
    no text is shuffled before it is picked. Equal texts of a label count once, in their least fold.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col) != 2))
    known = known.groupBy(F.col(id_col).cast("string").alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    known = materialize(known, "toxicity-labels")
    below = min(1.0, fit_rows / max(known.count(), 1)) * (1 << 20)
    sampled = F.pmod(F.xxhash64(F.col("_id")), F.lit(1 << 20)) < below
    toxic = {r["_id"]: r["_toxic"] for r in known.filter(sampled).collect()}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [toxic.get(i) for i in batch.column(0).to_pylist()]
            keep = pa.array([f is not None for f in found])
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], ["_id", "_text", "_toxic"])
            yield rows.filter(keep)

    texts = docs.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text"))
    rows = texts.filter(sampled).mapInArrow(pick, "_id string, _text string, _toxic int")
    rows = rows.withColumns({"_fold": fold_of("_id"), "_digest": F.sha2("_text", 256)})
    once = rows.groupBy("_toxic", "_digest").agg(F.min("_fold").alias("_fold"), F.any_value("_text").alias("_text"))
    return materialize(once.select("_text", "_toxic", "_fold"), "toxicity-training")


def _gram_cells(line: bytes) -> np.ndarray:
    """Hashed numbers of all strings of ``GRAM`` bytes."""
    x = np.frombuffer(line, dtype=np.uint8).astype(np.uint64)
    cells = np.zeros(max(0, len(x) - GRAM + 1), dtype=np.uint64)
    for i in range(GRAM):
        cells = cells * np.uint64(257) + x[i : i + len(cells)]
    return (mix64(cells) % np.uint64(CELLS)).astype(np.int64)


def telling_cells(rows: DataFrame, least_contrast: float, least_share: float) -> np.ndarray:
    """Strings that toxic documents have more often than chance (``least_contrast`` standard errors) and than
    ordinary ones (``least_share`` of the two frequencies), as hashed numbers; the 4,096 clearest at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS), dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                line = b" " + b" ".join(words_of_text(text.as_py())) + b" "
                sums[toxic.as_py()][np.unique(_gram_cells(line))] += 1
        found = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[1][found]), pa.array(sums[0][found])], ["cell", "a", "b"])

    n = rows.agg(F.coalesce(F.sum("_toxic"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, plain = n["t"], n["n"] - n["t"]
    if not toxic or not plain:
        return np.zeros(0, dtype=np.int64)
    counts = rows.select("_text", "_toxic").mapInArrow(count, "cell long, a long, b long")
    counts = counts.groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p, q = F.col("a") / F.lit(toxic), F.col("b") / F.lit(plain)
    error = F.sqrt((F.col("a") + F.col("b") + 1) / F.lit(n["n"]) * F.lit(1.0 / toxic + 1.0 / plain))
    clear = (F.col("a") >= 5) & ((p - q) / error > least_contrast) & (p > least_share * (p + q))
    found = counts.filter(clear).orderBy(((p - q) / error).desc(), "cell").limit(4096).collect()
    return np.array(sorted(r["cell"] for r in found), dtype=np.int64)


def training_windows(rows: DataFrame, cells: np.ndarray | None) -> list[bytes]:
    """Windows to train a dictionary on: words of the rows, of those with a telling string if ``cells`` are given.

    The ``SAMPLES // 4`` most frequent words, each as often as it occurs, ``REPEATS`` times at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[bytes, bool] = {}
        for batch in batches:
            found: dict[bytes, int] = {}
            for text in batch.column(0):
                for word in words_of_text(text.as_py()):
                    found[word] = found.get(word, 0) + 1
            if cells is not None:
                for word in found.keys() - told.keys():
                    told[word] = bool(np.isin(_gram_cells(b" " + word + b" "), cells).any())
                found = {w: n for w, n in found.items() if told[w]}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counts = rows.select("_text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "word").limit(SAMPLES // 4).collect()
    windows = [b" " + bytes(r["word"]) + b" " for r in top for _ in range(min(r["n"], REPEATS))]
    return windows[:SAMPLES]


def train_dictionary(windows: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the windows; what is too little to train on is taken as it is."""
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(windows))[-size:]


def dictionaries(rows: DataFrame, ordinary_size: int, toxic_size: int, least_contrast: float, least_share: float) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary; the toxic one is empty where no string tells."""
    cells = telling_cells(rows, least_contrast, least_share)
    if not len(cells):
        return b" ", b""
    ordinary = train_dictionary(training_windows(rows.filter("_toxic = 0"), None), ordinary_size)
    return ordinary, train_dictionary(training_windows(rows.filter("_toxic = 1"), cells), toxic_size)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = 12_000,
    ordinary_size: int = 32 << 10,
    toxic_size: int = 16 << 10,
    least_contrast: float = 5.0,
    least_share: float = 0.6,
    threshold: float = 0.3,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted`` and ``kept`` (not predicted).

    Labels are learnt only where crc32 of the id as text, modulo 4, is not 2, and from at most about
    ``fit_rows`` documents; everything else covers all texts as a whole. Only the text enters a
    score. An empty or null text has no window and gets the score of a text without evidence.
    Without labels of both classes every score is the base rate, or near 0 without any. Rows with a
    null id are scored, and held out by the empty string; repeated rows are scored alike. Other
    columns are not read. An empty table gives an empty result.
    """
    rows = training_rows(docs, labels, fit_rows, id_col, text_col, label_col)
    ordinary, toxic = dictionaries(rows.filter("_fold <> 3"), ordinary_size, toxic_size, least_contrast, least_share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _distance(ordinary, toxic)
        for batch in batches:
            found = [distance.counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["_toxic", "_counts"])

    judged = rows.filter("_fold = 3").select("_toxic", "_text").mapInArrow(judge, "_toxic int, _counts array<long>").collect()
    counts = np.array([r["_counts"] for r in judged], dtype=float).reshape(-1, LEVELS + 1)
    y = np.array([r["_toxic"] for r in judged], dtype=float)
    plain = counts[y == 0]
    rates = plain[:, 1:].sum(axis=0) / max(plain[:, 0].sum(), 1.0)
    weights = calibrate(features(counts, rates), y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = _distance(ordinary, toxic)
        for batch in batches:
            found = np.array([distance.counts(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, LEVELS + 1)
            scores = probability(features(found, rates), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string")).mapInArrow(score, f"_id {kind}, score double")
    hit = F.col("score") >= threshold
    return scored.select(
        F.col("_id").alias(id_col), (fold_of("_id") == 2).alias("held_out"), "score", hit.cast("int").alias("predicted"), (~hit).alias("kept")
    )
