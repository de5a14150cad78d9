import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opsight.llm.packing import Encoder, Limits, Packer, pack_documents, pack_examples

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_read_as_the_tokenizer_reads_them():
    encode = Encoder(PATH)
    plain = Tokenizer.from_file(PATH)
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endoftext|", "日<|endoftext|>"):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encode("a <|endoftext|> b"), "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab'tsÉ é²3\n\t  .,\x1c\x85", max_size=40))
def test_encoder_gives_the_tokenizer_ids(text):
    encode = test_encoder_gives_the_tokenizer_ids.__dict__.setdefault("encode", Encoder(PATH))
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode(text), "<u4").tolist() == want


ROWS = [(i, f"word{i} " * (i * 37 % 900)) for i in range(60)] + [
    (60, None),
    (61, ""),
    (62, "<|endoftext|> is text"),
    (63, "日本語 text " * 50),
    (64, "long " * 20_000),
    (65, "same"),
    (65, "same"),
    (None, "no id"),
]


def test_every_token_is_in_one_piece(documents, reference):
    pieces = pack_documents(documents(ROWS).repartition(3)).collect()
    got, room = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], p["ids_crc32"]))
        room[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, text in set(ROWS):
        ids = np.array([*reference(text or ""), 1], dtype="<u4")
        copies = ROWS.count((i, text))
        parts = sorted(got[i, len(ids)])
        assert sum(n for _, n, _ in parts) == copies * len(ids)
        covered = np.zeros(len(ids), int)
        for start, n, crc in parts:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
            covered[start : start + n] += 1
        assert (covered == copies).all()
    padding = 0
    for places in room.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding == 0


def test_ids_can_be_returned(documents, reference):
    row = pack_documents(documents([(1, "hello there")]), with_ids=True).collect()
    assert [x for r in sorted(row, key=lambda r: r["start"]) for x in r["ids"]] == [*reference("hello there"), 1]


def test_empty_table(documents):
    assert pack_documents(documents([])).count() == 0


def test_examples_keep_all_limits(spark):
    chance = np.random.default_rng(3)
    rows, limits = [], Limits(tokens=100, segments=4, loss=50)
    for i in range(300):
        n = int(chance.integers(1, 60))
        rows.append((i, [i] * n, (chance.random(n) < 0.6).astype(int).tolist()))
    rows += [(300, [300] * 250, [1] * 250), (301, None, None), (302, [], []), (303, [303, None], [1])]
    table = spark.createDataFrame(rows, "example_id int, ids array<int>, loss_mask array<int>").repartition(2)
    bins, seen = defaultdict(list), defaultdict(int)
    for p in pack_examples(table, limits).collect():
        bins[p["sequence_id"]].append(p)
        seen[p["example_id"]] += p["length"]
    assert seen == {i: len(ids) for i, ids, _ in rows if ids}
    for content in bins.values():
        assert sum(p["length"] for p in content) <= 100
        assert len(content) <= 4
        assert sum(p["loss_tokens"] for p in content) <= 50
    whole = [p for c in bins.values() for p in c if p["example_id"] < 300]
    assert len(whole) == sum(1 for i, ids, m in rows[:300] if sum(m) <= 50)


def test_dot_product_prefers_the_example_that_suits_the_room():
    """With few loss-bearing tokens left, the example that needs few of them comes first."""
    packer = Packer(Limits(tokens=100, segments=10, loss=40), cut=False)
    masks = {0: [1] * 40 + [0] * 20, 1: [1] * 35, 2: [0] * 40}
    for i, mask in masks.items():
        packer.add(i, np.array(mask))
    packer.pack(last=True)
    bins = defaultdict(set)
    for p in packer.drain():
        bins[p.sequence].add(p.example)
    assert {0, 2} in bins.values()
