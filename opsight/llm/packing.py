"""Vector bin packing of tokenised examples into training sequences.

A sequence is a bin with three limits: tokens, segments and loss-bearing tokens. Bins are
filled one at a time by the dot-product heuristic: of the examples that still fit, the next
one is that with the largest product of its demand with what is left of the bin, each
dimension as a share of its limit and weighted by how scarce the dimension is over the
waiting examples.

Examples wait in windows of bounded size inside a task, so there is no shuffle and memory
does not grow with the input; what a window leaves over waits for the next one. Where
examples may be cut, a bin that nothing fits whole takes a part of the best one, so bins
end full; the last tokens of a task go into sequences whose lengths are powers of two,
which need no padding. Where they may not, examples over the limits are cut at the limits
only, and bins end as full as the heuristic makes them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1 << 20
KNOWN = 1 << 20

# The pre-tokenisation rule of the byte-level BPE, written for the letters and
# digits that most texts consist of; other texts take the tokenizer itself.
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
)
_PLAIN = re.compile("[\x00-\x1b\x20-ɏ]*")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by the byte-level BPE of a tokenizer file.

    Ids of a piece do not depend on its neighbours, so they are kept for pieces seen before
    (``KNOWN`` at most).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.known: dict[str, bytes] = {}
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        self.symbols = {b: b for b in printed} | {b: 256 + i for i, b in enumerate(others)}

    def _piece(self, piece: str) -> bytes:
        symbols = piece.encode().decode("latin-1").translate(self.symbols)
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(symbols)], dtype="<u4").tobytes()
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or self.special.search(text):
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            return np.array(encoded.ids, dtype="<u4").tobytes()
        known, piece = self.known.get, self._piece
        return b"".join([known(p) or piece(p) for p in _PIECES.findall(text)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def shares(self, demand: np.ndarray) -> np.ndarray:
        return demand / np.array([self.tokens, self.segments, self.loss], dtype=float)


@dataclass
class Piece:
    """Tokens ``start`` to ``start + length - 1`` of an example, of which ``loss`` bear loss, in a sequence."""

    example: int
    start: int
    length: int
    loss: int
    sequence: int
    offset: int


class Packer:
    """Packs examples that arrive one by one; ``loss_before`` of an example: loss-bearing tokens before each token."""

    def __init__(self, limits: Limits, cut: bool, window: int = WINDOW):
        self.limits, self.cut, self.window = limits, cut, window
        self.waiting: list[tuple[int, int, int]] = []
        self.held = 0
        self.loss_before: dict[int, np.ndarray] = {}
        self.sequences = 0
        self.pieces: list[Piece] = []

    def add(self, example: int, loss_mask: np.ndarray) -> None:
        """Take an example; whole sequences are cut from it at once if it is over a limit."""
        sums = np.concatenate([[0], np.cumsum(loss_mask, dtype=np.int64)])
        self.loss_before[example] = sums
        start, end = 0, len(loss_mask)
        while start < end:
            stop = self._stop(sums, start, end, self.limits.tokens, self.limits.loss)
            full = stop - start == self.limits.tokens
            if stop == end and not full:
                break
            if full or not self.cut:
                self._close([(example, start, stop)])
                start = stop
            else:
                break
        if start < end:
            self.waiting.append((example, start, end))
            self.held += end - start
        if self.held >= self.window or len(self.waiting) * 64 >= self.window:
            self.pack(last=False)

    @staticmethod
    def _stop(sums: np.ndarray, start: int, end: int, tokens: int, loss: int) -> int:
        """Where a piece from ``start`` has to end under these limits."""
        stop = min(end, start + tokens)
        if sums[stop] - sums[start] > loss:
            stop = int(np.searchsorted(sums, sums[start] + loss, side="right")) - 1
        return stop

    def _close(self, content: list[tuple[int, int, int]]) -> None:
        offset = 0
        for example, start, end in content:
            sums = self.loss_before[example]
            loss = int(sums[end] - sums[start])
            self.pieces.append(Piece(example, start, end - start, loss, self.sequences, offset))
            offset += end - start
        self.sequences += 1

    def _loss(self, item: tuple[int, int, int]) -> int:
        sums = self.loss_before[item[0]]
        return int(sums[item[2]] - sums[item[1]])

    def pack(self, last: bool) -> None:
        """Fill bins from the waiting examples; unless this is the end, an unfilled bin waits on."""
        items = self.waiting
        demand = np.array([(e - s, 1, self._loss((x, s, e))) for x, s, e in items], dtype=np.int64).reshape(-1, 3)
        open_ = np.ones(len(items), dtype=bool)
        rest: list[tuple[int, int, int]] = []
        weight = self.limits.shares(demand).mean(axis=0) if len(items) else np.ones(3)
        shares = self.limits.shares(demand) * weight
        n_open = len(items)
        while n_open:
            room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.int64)
            content: list[tuple[int, int, int]] = []
            while n_open and room[0] and room[1]:
                fits = open_ & (demand <= room).all(axis=1)
                among = np.flatnonzero(fits)
                if len(among):
                    best = int(among[np.argmax(shares[among] @ self.limits.shares(room))])
                    content.append(items[best])
                    room -= demand[best]
                    open_[best] = False
                    n_open -= 1
                    continue
                if not self.cut:
                    break
                among = np.flatnonzero(open_)
                best = int(among[np.argmax(shares[among] @ self.limits.shares(room))])
                example, start, end = items[best]
                stop = self._stop(self.loss_before[example], start, end, int(room[0]), int(room[2]))
                if stop == start:
                    break
                part = (example, start, stop)
                content.append(part)
                room -= np.array([stop - start, 1, self._loss(part)])
                items[best] = (example, stop, end)
                demand[best] = (end - stop, 1, self._loss(items[best]))
                shares[best] = self.limits.shares(demand[best]) * weight
            filled = self.limits.tokens - int(room[0])
            if not last and not n_open and filled < self.limits.tokens:
                rest = content
            elif self.cut and filled & (filled - 1):
                self._close_in_powers(content) if last and not n_open else self._close(content)
            else:
                self._close(content)
        self.waiting = rest
        self.held = sum(e - s for _, s, e in rest)

    def _close_in_powers(self, content: list[tuple[int, int, int]]) -> None:
        """The last tokens as sequences of power-of-two lengths, longest first."""
        left = sum(e - s for _, s, e in content)
        content = content[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                example, start, end = content.pop()
                stop = min(end, start + size)
                part.append((example, start, stop))
                size -= stop - start
                if stop < end:
                    content.append((example, stop, end))
            self._close(part)

    def drain(self) -> list[Piece]:
        done, self.pieces = self.pieces, []
        return done


def _task_base() -> int:
    """Sequence ids of a task start here: ids are unique and repeat when a task is run again."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids array<int>"


def _pack(tokens_of, limits: Limits, cut: bool, window: int, with_ids: bool):
    """mapInArrow body: ``tokens_of(batch)`` yields the token bytes and loss mask of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits, cut, window), _task_base()
        held: dict[int, tuple[object, bytes]] = {}
        number = 0

        def done() -> Iterator[pa.RecordBatch]:
            rows = packer.drain()
            for a in range(0, len(rows), 1024):
                yield batch_of(rows[a : a + 1024])
            waiting = {x for x, _, _ in packer.waiting}
            for x in [x for x in held if x not in waiting]:
                del held[x], packer.loss_before[x]

        def batch_of(rows: list[Piece]) -> pa.RecordBatch:
            raw = [held[p.example][1][4 * p.start : 4 * (p.start + p.length)] for p in rows]
            columns = {
                "_key": pa.array([held[p.example][0] for p in rows], key_type),
                "start": [p.start for p in rows],
                "length": [p.length for p in rows],
                "ids_crc32": [zlib.crc32(x) for x in raw],
                "doc_tokens": [len(held[p.example][1]) // 4 for p in rows],
                "sequence_id": [base + p.sequence for p in rows],
                "offset": [p.offset for p in rows],
                "loss_tokens": [p.loss for p in rows],
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(x, "<i4") for x in raw], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for key, (raw, mask) in zip(keys, tokens_of(batch), strict=True):
                held[number] = (key, raw)
                packer.add(number, mask)
                number += 1
                if len(packer.pieces) >= 1024:
                    yield from done()
        packer.pack(last=True)
        yield from done()

    return run


def _tokenised(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokens_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
        encode = encoder(path)
        for text in batch.column(1):
            raw = encode(text.as_py() or "") + end
            yield raw, np.ones(len(raw) // 4, dtype=np.int8)

    return tokens_of


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    limits: Limits | None = None,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``loss_tokens`` and, if wanted, the ``ids``.

    A document is its token ids and ``end_id``, all loss-bearing, and may be cut anywhere;
    every token is in exactly one piece. A null or empty text is just ``end_id``. Repeated
    rows and null ids are documents of their own. A text of any length is cut into whole
    sequences first. Other columns are not read. An empty table gives an empty result.
    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    names = PIECES if with_ids else PIECES.rpartition(",")[0]
    body = _pack(_tokenised(tokenizer, end_id), limits or Limits(), True, window, with_ids)
    return docs.select(F.col(id_col).alias("_key"), text_col).mapInArrow(body, f"_key {kind}, {names}").withColumnRenamed("_key", id_col)


def pack_examples(
    examples: DataFrame,
    limits: Limits | None = None,
    window: int = WINDOW,
    id_col: str = "example_id",
    ids_col: str = "ids",
    mask_col: str = "loss_mask",
    cut: bool = False,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of instruction examples: arrays of token ids and of 0/1 loss marks of equal length.

    Examples stay whole (``cut=False``) unless they are over a limit alone. A null array of
    ids is an empty example and gives no piece; a null or short mask counts as 0 from there
    on, a null element of either as 0. Everything else as in ``pack_documents``.
    """

    def tokens_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
        for ids, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ids = np.array([x or 0 for x in ids or []], dtype="<u4")
            marks = np.zeros(len(ids), dtype=np.int8)
            given = np.array([int(bool(x)) for x in (mask or [])[: len(ids)]], dtype=np.int8)
            marks[: len(given)] = given
            yield ids.tobytes(), marks

    kind = examples.schema[id_col].dataType.simpleString()
    names = PIECES if with_ids else PIECES.rpartition(",")[0]
    body = _pack(tokens_of, limits or Limits(), cut, window, with_ids)
    chosen = examples.select(F.col(id_col).alias("_key"), ids_col, mask_col)
    return chosen.mapInArrow(body, f"_key {kind}, {names}").withColumnRenamed("_key", id_col)
