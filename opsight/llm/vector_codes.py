"""Compressed vectors: each vector becomes one codebook index per part, learnt and assigned in integers.

A component x counts as floor(256 * x). Vectors are cut into equal parts, and each part position
has its own codebook, which starts from the vectors of the smallest ids and is moved to the means
of its parts in a fixed number of rounds.

The distinct parts of a batch form a lexicographic trie over their dimensions. It is walked depth
first: a node holds the distances of its prefix to all entries, its children add one dimension
each, so a prefix that parts share is measured once; leaves take the nearest entry and give their
weighted sums. A subtree of few leaves is walked one dimension at a time over all its nodes. Each
round is one pass over the vectors without a shuffle of them: a task sends at most one row of sums
per entry, and codebooks (positions x entries x dimensions) are all that reaches the driver.

Rows are left out whose vector is null, holds null, NaN or an infinity, holds a component of 2^19
or more in size (its squares would leave 64 bits), or is not of the commonest length that the
parts divide (ties: the longer). Repeated rows are rows of their own. Of equal ids the first seeds
are those of the least vector; null ids come last. Empty tables give empty results. Columns of the
input other than id, vector and label do not enter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.scratch import materialize

GATHER = 1 << 15
SUBTREE = 1 << 11
LIMIT = 1 << 27


def as_integers(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector is left out."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    fits = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * 256) < LIMIT), F.lit(False))
    )
    return F.when(fits, whole)


def kept_vectors(table: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v) of the rows that are coded, written once, as every round reads them."""
    rows = table.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), as_integers(F.col(vector_col)).alias("v")
    ).filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0))
    rows = materialize(rows, "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == lengths[0]["n"]) if lengths else rows


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks (position, entry, dimension) of the vectors with the smallest ids."""
    seeds = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not seeds:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    return np.array([r["v"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)


class Trie:
    """Lexicographically sorted distinct parts, walked depth first against one codebook."""

    def __init__(self, parts: np.ndarray, book: np.ndarray):
        self.parts, self.book = parts, book
        self.entry = np.zeros(len(parts), dtype=np.int64)
        self.error = np.zeros(len(parts), dtype=np.int64)
        if len(parts):
            self._walk()

    def _step(self, distance: np.ndarray, parent: np.ndarray | int, values: np.ndarray, depth: int) -> np.ndarray:
        """Distances of children: those of their parents and one dimension more."""
        gap = values[:, None] - self.book[None, :, depth]
        return distance[parent] + gap * gap

    def _walk(self) -> None:
        depths, n = self.parts.shape[1], len(self.parts)
        waiting = [(0, 0, n, np.zeros((1, len(self.book)), dtype=np.int64))]
        while waiting:
            depth, low, high, distance = waiting.pop()
            if depth == depths:
                self._leaves(np.arange(low, high), np.repeat(distance, high - low, axis=0))
            elif high - low <= SUBTREE:
                self._subtree(depth, low, high, distance)
            else:
                values = self.parts[low:high, depth]
                begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
                ends = np.append(begins[1:], high - low)
                for a, b in zip(begins[::-1].tolist(), ends[::-1].tolist(), strict=True):
                    child = self._step(distance, np.zeros(1, dtype=np.int64), values[a : a + 1], depth)
                    waiting.append((depth + 1, low + a, low + b, child))

    def _subtree(self, depth: int, low: int, high: int, distance: np.ndarray) -> None:
        """All nodes below one node, a dimension at a time; ``node`` is the row of each leaf's prefix."""
        node = np.zeros(high - low, dtype=np.int64)
        for d in range(depth, self.parts.shape[1]):
            values = self.parts[low:high, d]
            new = np.concatenate([[True], (values[1:] != values[:-1]) | (node[1:] != node[:-1])])
            begins = np.flatnonzero(new)
            distance = self._step(distance, node[begins], values[begins], d)
            node = np.cumsum(new) - 1
        self._leaves(np.arange(low, high), distance[node])

    def _leaves(self, rows: np.ndarray, distance: np.ndarray) -> None:
        best = distance.argmin(axis=1)  # the lower index of equal distances
        self.entry[rows] = best
        self.error[rows] = distance[np.arange(len(rows)), best]


def assign(vectors: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Trie]]:
    """For each part position: distinct parts with counts, the row of each vector among them, and their trie."""
    parts = len(books)
    cut = vectors.reshape(len(vectors), parts, -1)
    for position in range(parts):
        distinct, where, times = np.unique(cut[:, position], axis=0, return_inverse=True, return_counts=True)
        yield distinct, where.reshape(-1), times, Trie(distinct, books[position])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches put together to at least ``GATHER`` vectors, which share prefixes better, and their matrix."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table, flat.astype(np.int64).reshape(table.num_rows, -1)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= GATHER:
            yield out()
            held = []
    if held:
        yield out()


def next_codebooks(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks moved to the floor of the means of their parts; entries without parts stay."""
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, dims), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for _, matrix in _gathered(batches):
            for position, (distinct, _, times, trie) in enumerate(assign(matrix, books)):
                np.add.at(total[position], trie.entry, distinct * times[:, None])
                np.add.at(count[position], trie.entry, times)
        position, entry = np.nonzero(count)
        if len(position):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(position.astype(np.int32)),
                    pa.array(entry.astype(np.int32)),
                    pa.array(count[position, entry]),
                    pa.array(total[position, entry].tolist(), type=pa.list_(pa.int64())),
                ],
                names=["position", "entry", "n", "total"],
            )

    sums = (
        vectors.select("v")
        .mapInArrow(run, "position int, entry int, n long, total array<long>")
        .groupBy("position", "entry")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dims)])
        .collect()  # one row per entry of a codebook at most
    )
    moved = books.copy()
    for r in sums:
        moved[r["position"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return moved


def learn_codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = next_codebooks(vectors, books)
    return books


def codes(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): two hex digits per part (as many as the entries need, if over 256), in part order."""
    parts, entries = books.shape[:2]
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    schema = T.StructType(
        [*vectors.select("id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:0{digits}x}" for i in range(entries)])
        for table, matrix in _gathered(batches):
            error = np.zeros(len(matrix), dtype=np.int64)
            each = []
            for _, where, _, trie in assign(matrix, books):
                error += trie.error[where]
                each.append(hexes[trie.entry[where]])
            text = pa.array(np.ascontiguousarray(np.stack(each, axis=1)).view(f"U{digits * parts}").reshape(-1))
            columns = [table.column("id").combine_chunks(), table.column("label").combine_chunks(), text.cast(pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.select("id", "label", "v").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(
    table: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per coded vector: its id, ``code``, ``error``, ``label_error`` over its label, ``codebooks_sha256``."""
    vectors = kept_vectors(table, parts, id_col, vector_col, label_col)
    books = learn_codebooks(vectors, parts, entries, rounds)
    # Written, so that Spark knows the size of both sides: totals are broadcast if few, and a hot
    # label is split if they are many.
    coded = materialize(codes(vectors, books), "vector-codes")
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = totals.withColumnRenamed("label", "_label")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
