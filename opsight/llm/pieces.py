"""SentencePiece encoding and decoding that keeps the place of every piece in the source text.

A text is normalised by the longest prefixes that the model's compiled character map knows, and
every byte of the normal form keeps the source byte it came from. Merges turn the normal form
into pieces, and a piece's ends are read back through that record, so it is projected to the
bytes of the text as it was given. Decoding turns ids into text again.

Merges never reach across certain places: before a run of space marks, and beside a character
that no longer piece holds. The normal form is cut there, and each distinct cut is merged once
per task (``KNOWN`` cuts are kept at most; the rest is merged again, with the same result).

Null text counts as empty and gives no pieces; rows that repeat are encoded one by one; columns
of the input stay, and result columns replace those of the same name.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20
KNOWN = 1 << 19
LONG = 48

# Fixed values of the model format: piece kinds, the space mark, the surface of an unknown id.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "

_NEVER = np.int64(1) << 62


class CharacterMap:
    """The compiled character map of a model: a double-array trie over source byte strings."""

    def __init__(self, blob: bytes):
        self.units, self.forms = np.zeros(0, dtype=np.uint32), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4)
            self.forms = blob[4 + size :]
        self.starts = np.zeros(256, dtype=bool)
        if len(self.units):
            root = self._child(int(self.units[0]))
            for byte in range(1, 256):
                self.starts[byte] = (int(self.units[root ^ byte]) & 0x800000FF) == byte

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known string at ``at`` and its normal form."""
        found, units = None, self.units
        node = self._child(int(units[0]))
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if (unit & 0x800000FF) != raw[i]:
                break
            node ^= self._child(unit)
            if unit & 0x100:
                found = i + 1 - at, int(units[node]) & 0x7FFFFFFF
        if found is None:
            return None
        length, form = found
        return length, self.forms[form : self.forms.index(b"\0", form)]

    def replacements(self, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, length, normal form) of every replaced string, from left to right."""
        if not self.starts.any():
            return
        data = np.frombuffer(raw, dtype=np.uint8)
        done = 0
        for at in np.flatnonzero(self.starts[data] & ((data & 0xC0) != 0x80)).tolist():
            if at >= done and (match := self.longest(raw, at)):
                yield at, match[0], match[1]
                done = at + match[0]


class Normaliser:
    """Normal forms in UTF-8 with, for every byte and for the end, the source byte it stands for."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, mark_spaces: bool):
        self.map = CharacterMap(blob)
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = SPACE.encode() if mark_spaces else b" "
        self.plain = mark_spaces and not squeeze and not self.map.starts.any()

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode()
        parts, sources, at = [], [], 0
        for start, length, form in self.map.replacements(raw):
            parts += [raw[at:start], form]
            sources += [np.arange(at, start), np.full(len(form), start)]
            at = start + length
        out = b"".join([*parts, raw[at:]])
        source = np.concatenate([*sources, np.arange(at, len(raw) + 1)])
        if self.squeeze and out:
            data = np.frombuffer(out, dtype=np.uint8)
            keep = np.flatnonzero((data != 32) | (np.concatenate([[32], data[:-1]]) != 32))
            out, source = data[keep].tobytes(), source[np.append(keep, len(data))]
        if not out:
            return b"", np.zeros(1, dtype=np.int64)
        if self.space != b" ":
            widths = np.where(np.frombuffer(out, dtype=np.uint8) == 32, len(self.space), 1)
            source = np.concatenate([np.repeat(source[:-1], widths), source[-1:]])
            out = out.replace(b" ", self.space)
        if self.dummy_prefix:
            source = np.concatenate([np.full(len(self.space), source[0]), source])
            out = self.space + out
        if self.squeeze:
            bare = out
            while bare.endswith(self.space):
                bare = bare.removesuffix(self.space)
            out, source = bare, source[: len(bare) + 1]
        return out, source


class Model:
    """Tables of a byte-pair model with byte fallback, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trained, spec = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: not a byte-pair model with byte fallback and leading space marks")
        if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.normalise = Normaliser(
            spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        )
        self.strip_first = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.n = len(proto.pieces)
        self.kinds = np.array([p.type for p in proto.pieces], dtype=np.uint8)
        names = [p.piece for p in proto.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_id = {int(names[i][3:5], 16): i for i in np.flatnonzero(self.kinds == BYTE).tolist()}
        # what an id adds to a decoded text
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
            else b"" if p.type == CONTROL
            else UNKNOWN_SURFACE.encode() if p.type == UNKNOWN
            else p.piece.encode()
            for p in proto.pieces
        ]
        self.width = np.array([len(x) for x in self.surface], dtype=np.int64)
        # characters that occur in pieces but are none get ids beyond those of the model
        symbols = dict(self.id_of)
        for name in self.id_of:
            for c in name:
                symbols.setdefault(c, self.n + len(symbols))
        self.symbol_at = np.full(0x110000, -1, dtype=np.int64)
        for name, i in symbols.items():
            if len(name) == 1:
                self.symbol_at[ord(name)] = i
        scores = np.array([p.score for p in proto.pieces])
        rank = np.searchsorted(np.unique(-scores), -scores)
        pairs = {}
        for name, whole in self.id_of.items():
            for cut in range(1, len(name)):
                left, right = symbols.get(name[:cut]), symbols.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = whole
        self.pairs = {pair: (int(rank[whole]), whole) for pair, whole in pairs.items()}
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ids = np.array(list(pairs.values()), dtype=np.int64)[order]
        self.pair_ranks = rank[self.pair_ids].astype(np.int64)
        joined = {c for name in self.id_of if len(name) > 1 for c in name} - {SPACE}
        inside = "".join(re.escape(c) for c in sorted(joined))
        # a space mark inside a piece, behind another character, would forbid to cut before it
        self.cuts = None
        if inside and not any(re.search(f"[^{SPACE}]{SPACE}", name) for name in self.id_of):
            self.cuts = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|.", re.DOTALL)

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol_at[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]

    def merge_long(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(symbol, characters) after all merges of one cut, with a heap; the best pair first, then the leftmost."""
        n = len(symbols)
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (pair := self.pairs.get((symbols[i], symbols[j]))):
                heapq.heappush(waiting, (pair[0], i, pair[1], size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, whole, left, right = heapq.heappop(waiting)
            j = after[i]
            if size[i] != left or j >= n or size[j] != right:
                continue  # one of the two is part of another piece by now
            symbols[i], size[i], size[j] = whole, left + right, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append((symbols[i], size[i]))
            i = after[i]
        return out

    def merge_short(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All cuts at once, the best pair of each cut in every round: symbols, where they begin, symbols per cut."""
        symbol = self.symbols("".join(cuts))
        owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        place = np.arange(len(symbol))
        done = []
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            known = (self.pair_keys[at] == key) & (owner[:-1] == owner[1:]) & (symbol[:-1] >= 0) & (symbol[1:] >= 0)
            order = np.full(len(symbol), _NEVER)
            order[:-1][known] = self.pair_ranks[at[known]] << 32 | np.flatnonzero(known)
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(order, begins)
            open_ = best < _NEVER
            keep = np.repeat(open_, np.diff(np.append(begins, len(symbol))))
            if not open_.all():
                done.append((place[~keep], symbol[~keep], owner[~keep]))
            left = best[open_] & 0xFFFFFFFF
            symbol[left] = self.pair_ids[at[left]]
            keep[left + 1] = False
            symbol, owner, place = symbol[keep], owner[keep], place[keep]
        if not done:
            return symbol, place, np.zeros(len(cuts), dtype=np.int64)
        place, symbol, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return symbol[order], place[order], np.bincount(owner, minlength=len(cuts))


class Encoder:
    """Encodes texts with a model, remembering cuts it has merged."""

    def __init__(self, path: str):
        self.model = Model(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begin, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids, self.width = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _learn(self, new: list[str]) -> None:
        """Merge cuts and keep their ids, with the bytes of the normal form that each id covers."""
        model = self.model
        short, long = [c for c in new if len(c) <= LONG], [c for c in new if len(c) > LONG]
        symbol, place, count = model.merge_short(short)
        counts = [count]
        for cut in long:
            pairs = np.array(model.merge_long(model.symbols(cut).tolist()), dtype=np.int64)
            sizes = pairs[:, 1]
            symbol = np.concatenate([symbol, pairs[:, 0]])
            place = np.concatenate([place, sum(map(len, short)) + np.cumsum(sizes) - sizes])
            short.append(cut)
            counts.append([len(pairs)])
        count = np.concatenate(counts).astype(np.int64)
        known = (symbol >= 0) & (symbol < model.n)
        ids, width = symbol.copy(), model.width[np.where(known, symbol, 0)]
        if not known.all():
            # an unknown character falls back to its bytes, the last of which covers it
            text = "".join(short)
            data = {i: text[place[i]].encode() for i in np.flatnonzero(~known).tolist()}
            times = np.ones(len(ids), dtype=np.int64)
            times[list(data)] = [len(x) for x in data.values()]
            count = np.add.reduceat(times, np.cumsum(count) - count) if len(count) else count
            ends = np.cumsum(times)
            ids, width = np.repeat(ids, times), np.repeat(width, times)
            for i, x in data.items():
                ids[ends[i] - len(x) : ends[i]] = [model.byte_id[b] for b in x]
                width[ends[i] - len(x) : ends[i]] = [0] * (len(x) - 1) + [len(x)]
        self.known.update(zip(short, range(len(self.known), len(self.known) + len(short)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.width = np.concatenate([self.width, width.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end byte in the source of all texts after each other, and where each text begins."""
        model = self.model
        plain = model.normalise.plain
        forms, aligned = [], []
        for text in texts:
            if plain:
                forms.append((SPACE + text.replace(" ", SPACE) if model.normalise.dummy_prefix else text.replace(" ", SPACE)) if text else "")
            else:
                form, source = model.normalise(text)
                forms.append(form.decode())
                aligned.append(source)
        cut = model.cuts.findall if model.cuts else (lambda form: [form] if form else [])
        cuts = [cut(form) for form in forms]
        known = self.known
        new = list(dict.fromkeys(c for each in cuts for c in each if c not in known))
        if new and len(known) + len(new) > KNOWN:
            self._forget()
            known = self.known
            new = list(dict.fromkeys(c for each in cuts for c in each))
        if new:
            self._learn(new)
        index = np.array([known[c] for each in cuts for c in each], dtype=np.int64)
        count = self.count[index]
        ends = np.cumsum(count)
        take = np.repeat(self.begin[index] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.ids[take]
        covered = np.concatenate([[0], np.cumsum(self.width[take], dtype=np.int64)])
        cut_ends = np.concatenate([[0], ends])
        at = cut_ends[np.concatenate([[0], np.cumsum([len(each) for each in cuts])]).astype(np.int64)]
        first, end = np.empty(len(ids), dtype=np.int64), np.empty(len(ids), dtype=np.int64)
        for i, text in enumerate(texts):
            a, b = at[i], at[i + 1]
            if a == b:
                continue
            if plain:
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                widths = np.where(raw == 32, 3, 1)
                source = np.repeat(np.arange(len(raw)), widths)
                head = np.zeros(3 if model.normalise.dummy_prefix else 0, dtype=np.int64)
                source = np.concatenate([head, source, [len(raw)]])
            else:
                source = aligned[i]
            place = source[covered[a : b + 1] - covered[a]]
            first[a:b], end[a:b] = place[:-1], place[1:]
        return ids, first, end, at

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        surface, ids = self.model.surface, np.asarray(ids, dtype=np.int64)
        kinds = self.model.kinds[ids]
        parts = [surface[i] for i in ids.tolist()]
        if self.model.strip_first:
            # the mark of the dummy prefix: in the first id that adds anything to the text
            for i, (part, kind) in enumerate(zip(parts, kinds, strict=True)):
                if part:
                    if kind == NORMAL:
                        parts[i] = part.removeprefix(SPACE.encode())
                    break
        if (kinds == NORMAL).all():
            return b"".join(parts).decode().replace(SPACE, " ")
        ends = np.flatnonzero((kinds[1:] == BYTE) != (kinds[:-1] == BYTE)) + 1
        out = []
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(parts)], strict=True):
            data = b"".join(parts[a:b])
            out.append(_bytes_alone(data) if kinds[a] == BYTE else data.decode().replace(SPACE, " "))
        return "".join(out)


def _bytes_alone(run: bytes) -> str:
    """A run of byte pieces as text."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


RESULT = [
    T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
    T.StructField("piece_starts", T.ArrayType(T.IntegerType())),
    T.StructField("piece_ends", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
]


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without their text, with ``piece_ids``, the source bytes
    ``piece_starts`` (included) to ``piece_ends`` (excluded) of each piece, and ``decoded``, the text of the ids.

    No shuffle; a task holds a block of texts (``BLOCK`` characters, or one text if longer).
    """
    names = {f.name for f in RESULT} | {text_col}
    kept = [c for c in docs.columns if c not in names]
    held = "_text" + "_" * max(map(len, docs.columns))  # no column has this name
    rows = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(held))
    schema = T.StructType([*docs.select(*kept).schema.fields, *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.large_string())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1])
            first = 0
            while first < batch.num_rows:
                total = np.cumsum(sizes[first:])
                last = first + max(1, int(np.searchsorted(total, BLOCK, side="right")))
                ids, starts, ends, begin = encode.encode(texts[first:last].to_pylist())
                offsets = pa.array(begin, type=pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
                    for values in (ids, starts, ends)
                ]
                decoded = pa.array(
                    [encode.decode(ids[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)], type=pa.string()
                )
                columns = [batch.column(i).slice(first, last - first) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *lists, decoded], names=[f.name for f in schema.fields])
                first = last

    return rows.mapInArrow(run, schema)
