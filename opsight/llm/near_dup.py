"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A text's set are its distinct word shingles, as 64-bit hashes. Two permutations of the
32-bit numbers give all coordinates of its signature: one scatters the shingles, and the
other, shifted circularly by k, orders them for coordinate k; the coordinate is the least
place. Both are bijective mixing functions, so nothing is stored.

Bands of ``rows`` coordinates are buckets. With 25 bands of 5, a pair of similarity 0.85
misses all buckets with probability 4e-7, one of 0.8 with 5e-5. Every link is confirmed on
the full sets. No bucket is emitted as all its pairs:

1. Equal sets become one node before anything else. Nodes have numbers of their own, so an
   id may stand on any number of texts; ids come back when the components are known.
2. In every bucket all nodes are compared with its least node: one pair per node.
3. Buckets whose nodes are then connected are done. In the others, nodes of different
   components are compared by their signatures in blocks of bounded size, in tasks that
   hold two blocks. Pairs whose estimate is not far below the limit (a miss is less likely
   than one in banding) are candidates, of which a task gives only stars that span them: the
   components of these stars are families that hold both ends of every candidate pair.
4. Families are compared in blocks in the same way, now with full sets, and a task gives
   one confirmed link for every two components that it joins. The rows made are so at most
   in proportion to the nodes and blocks, never to the pairs.

Full sets are made only for nodes in candidate pairs, from their texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.components import components
from opsight.llm.wordhash import blocks, mix64, shingles
from opsight.scratch import materialize

BANDS, ROWS = 25, 5
COMPARED = 256
MARGIN = 0.2


def _mix32(x: np.ndarray, first: int, second: int, spare: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    for shift, factor in ((16, first), (13, second)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def signatures(hashes: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Signatures of the sets that begin at ``begins`` (none empty), one row each."""
    at = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    spare, moved = np.empty_like(at), np.empty_like(at)
    _mix32(at, 0x7FEB352D, 0x846CA68B, spare)
    out = np.empty((len(begins), size), dtype=np.uint32)
    for k in range(size):
        np.add(at, np.uint32(k), out=moved)
        _mix32(moved, 0x85EBCA6B, 0xC2B2AE35, spare)
        out[:, k] = np.minimum.reduceat(moved, begins)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                hashes, begins = shingles(block, size)
                n = np.diff(begins)
                full = n > 0
                keys: list = [None] * len(n)
                coords: list = [None] * len(n)
                digests: list = [None] * len(n)
                if full.any():
                    signed = signatures(hashes, begins[:-1][full], bands * rows)
                    of_band = band_keys(signed, bands, rows)
                    low = signed.astype("<u2")
                    for j, i in enumerate(np.flatnonzero(full).tolist()):
                        keys[i], coords[i] = of_band[j], low[j].tobytes()
                        digests[i] = _digest(hashes[begins[i] : begins[i + 1]])
                ids, texts = (batch.column(c).slice(block.first, block.last - block.first) for c in (0, 2))
                columns = [
                    ids,
                    texts,
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(coords, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_text_key", "n_shingles", "_set", "_bands", "_coords"])

    return run


def _full_sets(size: int):
    """Sets of texts whose set has the wanted digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                hashes, begins = shingles(block, size)
                sets = [hashes[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
                keep = [i for i, s in enumerate(sets) if _digest(s) == wanted[block.first + i]]
                ids = batch.column(0).take(pa.array([block.first + i for i in keep], pa.int64()))
                kept = pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, kept], ["node", "hashes"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows with equal first ``keys`` columns, which arrive one after the other."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        heads = np.stack([table.column(k).to_numpy() for k in range(keys)])
        cuts = np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), table.num_rows]
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield {c: v[a:b] for c, v in columns.items()}
        rest = table.slice(bounds[-2])
    if rest is not None:
        yield {c: rest.column(c).to_numpy() for c in rest.column_names}


def _partners(rows: dict[str, np.ndarray], component: np.ndarray, coords: np.ndarray, i: int, similarity: float) -> np.ndarray:
    """Later rows of a run that may be linked to row ``i`` and would join two components."""
    n = rows["n_shingles"]
    others = component[i + 1 :] != component[i]
    others &= np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i])
    if rows["_low"][0] != rows["_high"][0]:
        others &= rows["_block"][i + 1 :] != rows["_block"][i]
    j = np.flatnonzero(others) + i + 1
    return j[(coords[j] == coords[i]).sum(axis=1) >= (similarity - MARGIN) * coords.shape[1]]


def _coords(rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(rows["_coords"]), dtype="<u2").reshape(len(rows["node"]), -1)


def _pairs(rows: dict[str, np.ndarray], found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (rows["node"][np.array(x, dtype=np.int64)] for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def _compare(similarity: float):
    """Of each run, stars (the least node and each other) that span the candidate pairs across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            coords, tree = _coords(rows), np.arange(len(rows["node"]))
            for i in range(len(coords) - 1):
                for t in np.unique(tree[_partners(rows, rows["component"], coords, i, similarity)]):
                    tree[tree == t] = tree[i]
            least = np.full(len(tree), np.iinfo(np.int64).max)
            np.minimum.at(least, tree, rows["node"])
            others = rows["node"] != least[tree]
            if others.any():
                pair = [pa.array(least[tree][others]), pa.array(rows["node"][others])]
                yield pa.RecordBatch.from_arrays(pair, ["u", "v"])

    return run


def _verify(similarity: float):
    """Of each run, confirmed links, one for every two components that they join."""
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            coords, found = _coords(rows), []
            component = rows["component"].copy()
            sizes = np.array([len(x) for x in rows["hashes"]])
            begins = np.concatenate([[0], np.cumsum(sizes)])
            names, compact = np.unique(np.concatenate(rows["hashes"]), return_inverse=True)
            mine = np.zeros(len(names), dtype=bool)
            for i in range(len(coords) - 1):
                j = _partners(rows, component, coords, i, similarity)
                if not len(j):
                    continue
                own = compact[begins[i] : begins[i + 1]]
                mine[own] = True
                both = np.array([int(mine[compact[begins[x] : begins[x + 1]]].sum()) for x in j.tolist()])
                mine[own] = False
                j = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
                for c, first in zip(*np.unique(component[j], return_index=True), strict=True):
                    found.append((i, int(j[first])))
                    component[component == c] = component[i]
            if found:
                yield _pairs(rows, found)

    return run


def _in_blocks(rows: DataFrame, key: str, blocks_of: DataFrame) -> DataFrame:
    """Rows of each key dealt to blocks, once for every block that theirs is compared with.

    A run of equal (key, ``_low``, ``_high``) holds two blocks, or one compared with itself.
    """
    placed = rows.join(blocks_of, key).withColumn("_block", F.pmod(F.xxhash64("node"), "_blocks").cast("int"))
    paired = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = paired.withColumn("_low", F.least("_block", "_with")).withColumn("_high", F.greatest("_block", "_with"))
    extra = [c for c in rows.columns if c != key]
    paired = paired.select(key, "_low", "_high", "_block", *extra)
    return paired.repartition(key, "_low", "_high").sortWithinPartitions(key, "_low", "_high")


def text_key(text):
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


class NearDuplicates:
    """One run over ``docs``; the tables of its steps are written below the scratch folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, bands: int, rows: int):
        self.size, self.similarity = size, similarity
        self.id_col = id_col
        text = F.col(text_col).cast("string")
        self.texts = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), text_key(text).alias("_text_key"))
        schema = "_id long, _text_key long, n_shingles long, _set binary, _bands array<long>, _coords binary"
        self.sketches = materialize(self.texts.mapInArrow(_sketches(size, bands, rows), schema), "near-sketches")
        one = F.min(F.struct("_id", "_text_key", "n_shingles", "_bands", "_coords")).alias("_one")
        nodes = self.sketches.filter("n_shingles > 0 and _id is not null").groupBy("_set")
        nodes = nodes.agg(one, F.count(F.lit(1)).alias("_copies"))
        # Numbered once, as they are written: read again, a node has the same number everywhere.
        nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "_set", "_copies", "_one.*")
        self.nodes = materialize(nodes, "near-nodes")
        self.buckets = self.nodes.select("node", "n_shingles", F.explode("_bands").alias("_bucket"))

    def fits(self, a: str, b: str):
        percent = round(100 * self.similarity)
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def star_pairs(self) -> DataFrame:
        first = F.min(F.struct("node", "n_shingles")).alias("_first")
        heads = self.buckets.groupBy("_bucket").agg(first, F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        heads = heads.select("_bucket", F.col("_first.node").alias("_head"), F.col("_first.n_shingles").alias("_head_n"))
        pairs = self.buckets.join(heads, "_bucket").filter("node <> _head").filter(self.fits("n_shingles", "_head_n"))
        return pairs.select(F.col("_head").alias("u"), F.col("node").alias("v")).distinct()

    def rest_links(self, members: DataFrame) -> DataFrame:
        """Confirmed links that join components; ``members`` has node and component."""
        nodes = self.nodes.select("node", "n_shingles", "_coords").join(members, "node", "left")
        nodes = nodes.withColumn("component", F.coalesce("component", "node"))
        buckets = self.buckets.select("node", "_bucket").join(nodes.select("node", "component"), "node")
        mixed = buckets.groupBy("_bucket").agg(
            F.min("component").alias("_a"), F.max("component").alias("_z"), F.count(F.lit(1)).alias("_n")
        )
        mixed = mixed.filter("_a <> _z").select("_bucket", F.ceil(F.col("_n") / COMPARED).cast("int").alias("_blocks"))
        left = buckets.join(mixed.select("_bucket"), "_bucket").select("_bucket", "node").join(nodes, "node")
        left = left.select("_bucket", "node", "component", "n_shingles", "_coords")
        close = _in_blocks(left, "_bucket", mixed).mapInArrow(_compare(self.similarity), "u long, v long")
        families = materialize(components(close).withColumnRenamed("component", "_family"), "near-families")
        counts = families.groupBy("_family").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.select("_family", F.ceil(F.col("_n") / COMPARED).cast("int").alias("_blocks"))
        rows = families.join(nodes, "node").join(self.full_sets(families.select("node")), "node")
        rows = rows.select("_family", "node", "component", "n_shingles", "_coords", "hashes")
        return _in_blocks(rows, "_family", counts).mapInArrow(_verify(self.similarity), "u long, v long")

    def full_sets(self, wanted: DataFrame) -> DataFrame:
        """``node`` and ``hashes`` of the wanted nodes, from their texts."""
        wanted = wanted.join(self.nodes.select("node", "_id", "_text_key", "_set"), "node")
        texts = self.texts.join(wanted, ["_id", "_text_key"]).select("node", "_text", "_set")
        sets = texts.mapInArrow(_full_sets(self.size), "node long, hashes array<long>").dropDuplicates(["node"])
        return materialize(sets, "near-sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        pairs = materialize(pairs, "near-pairs")
        sets = self.full_sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("_a"))
        right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("_b"))
        both = pairs.join(left, "u").join(right, "v").withColumn("_common", F.size(F.array_intersect("_a", "_b")))
        union = F.size("_a") + F.size("_b") - F.col("_common")
        return both.filter(100 * F.col("_common") >= round(100 * self.similarity) * union).select("u", "v")

    def result(self) -> DataFrame:
        stars = materialize(self.confirmed(self.star_pairs()), "near-links")
        rest = self.rest_links(materialize(components(stars), "near-stars"))
        members = components(stars.unionAll(rest))
        of_set = self.nodes.select("node", "_set", "_copies", "_id", "_text_key").join(members, "node", "left")
        of_set = of_set.filter("_copies > 1 or component is not null")
        of_set = materialize(of_set.withColumn("component", F.coalesce("component", "node")), "near-members")
        first = of_set.groupBy("component").agg(F.min(F.struct("_id", "_text_key", "node")).alias("_first"))
        of_set = of_set.select("_set", "node", "component").join(first, "component").select("_set", "node", "_first")
        rows = self.sketches.select("_id", "_text_key", "n_shingles", "_set").join(of_set, "_set", "left")
        found = F.when(F.col("_id").isNotNull(), F.coalesce("_first._id", "_id"))
        is_first = (F.col("_id") == F.col("_first._id")) & (F.col("_text_key") == F.col("_first._text_key"))
        is_first = is_first & (F.col("node") == F.col("_first.node"))
        return rows.select(
            F.col("_id").alias(self.id_col),
            "_text_key",
            "n_shingles",
            found.alias("component_id"),
            F.coalesce(is_first, F.lit(True)).alias("kept"),
        )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when ``100 * intersection >= 100 * similarity * union`` (whole
    per cents) of their sets of ``size``-word shingles; ``component_id`` is the least id
    reachable over links. A text of fewer words is one shingle. An empty or null text has
    no shingle, is linked with nothing and stays. A row without an id is not linked, has a
    null ``component_id`` and stays. Rows that repeat an id and its text are one document
    and get the same verdict. With different texts they are documents of their own, whose
    components may bear the same id; of several in one component, one text is kept. Other
    columns are not read. An empty table gives an empty result.
    """
    return NearDuplicates(docs, id_col, text_col, size, similarity, bands, rows).result().drop("_text_key")


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: those that are not dropped by id and text."""
    verdicts = NearDuplicates(docs, id_col, text_col, size, similarity, bands, rows).result().filter("not kept")
    dropped = verdicts.select(F.col(id_col).alias("_dropped"), F.col("_text_key").alias("_dropped_text")).distinct()
    same = (docs[id_col] == F.col("_dropped")) & (text_key(docs[text_col].cast("string")) == F.col("_dropped_text"))
    return docs.join(dropped, same, "left_anti")
