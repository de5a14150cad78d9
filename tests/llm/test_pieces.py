import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from opsight.llm.pieces import Encoder, Normaliser, encode_pieces
from opsight.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a ", "▁", "▁▁a b▁", "hello  world\n\n  x", "日本語テキスト😀😀 x́", "<s> </s> <unk> <0x41>", "a\x00b",
    "x" * 500, "ab" * 300 + " " * 40 + "é" * 100, "   　", "....!!!???", "\U000e0001�", "don't stop 123456 3.14",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def spans(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def encoded(encoder, texts):
    ids, starts, ends, at = encoder.encode(texts)
    return [list(zip(ids[a:b].tolist(), starts[a:b].tolist(), ends[a:b].tolist())) for a, b in zip(at, at[1:])]


def made_up(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "b", "th", "e ", "  ", " ", "\n", "▁", "é", "ß", "日", "😀", "1", "23", ".", ",", "ing", "tion", "\t", "<s>", "x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_ids_and_spans_equal_the_library(library, encoder):
    texts = ODD + made_up(800)
    assert encoded(encoder, texts) == [spans(library, t) for t in texts]


def test_spans_cover_the_text(encoder):
    for text, pieces in zip(ODD, encoded(encoder, ODD)):
        assert b"".join(text.encode()[a:b] for _, a, b in pieces) == text.encode()


def test_forgetting_cuts_changes_nothing(library, monkeypatch):
    from opsight.llm import pieces

    monkeypatch.setattr(pieces, "KNOWN", 50)
    small = Encoder(PATH)
    texts = made_up(100, seed=2)
    for at in range(0, 100, 10):
        assert encoded(small, texts[at : at + 10]) == [spans(library, t) for t in texts[at : at + 10]]


def test_decodes_any_ids_as_the_library_does(library, encoder):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 9))]
        assert encoder.decode(ids) == library.decode(ids)
    for text in ODD:
        assert encoder.decode(library.encode(text)) == library.decode(library.encode(text))


RULES = ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"]
FORMS = ["ｈｅｌｌｏ　ｗｏｒｌｄ", " a  b ", "ﬁn ﬃ ½ ㌔", "がきぐ", "é Ǆ İ", "​x﻿", "Ⅷ  \t\n x", "", "  ", "a\x01b", "①²⑩", "ＡＢ Ⅳ Straße"]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_longest_prefixes_of_the_character_map(rule, squeeze, prefix):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(theirs.serialized_model_proto())
    blob = proto.normalizer_spec.precompiled_charsmap
    assert bool(blob) == (rule != "identity")
    mine = Normaliser(blob, prefix, squeeze, theirs_marks(proto))
    for text in [*FORMS, *ODD, *made_up(100, seed=3)]:
        form, source = mine(text)
        wanted, offsets = theirs.normalize(text, with_offsets=True)
        assert form.decode() == wanted, text
        chars = [len(text.encode()[: source[len(wanted[:i].encode())]].decode()) for i in range(len(wanted) + 1)]
        assert chars == list(offsets), text


def theirs_marks(proto):
    return proto.normalizer_spec.escape_whitespaces


def brute(library, text):
    text = text or ""
    ids = library.encode(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_whole_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_pieces"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all(tuple(r)[1:] == brute(library, texts[r["doc_id"]]) for r in got)


def test_nulls_repeats_long_texts_and_extra_columns(spark, library, documents):
    rows = [(1, None), (1, "same"), (1, "same"), (None, ""), (2, "word " * 300_000), (3, "no" * 30_000)]
    table = documents(rows).withColumns({c: F.lit("x") for c in ("piece_ids", "decoded", "_text", "piece_ends")})
    got = encode_pieces(table, PATH).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["piece_ids"]), r["decoded"]) for r in got) == sorted(
        (i or 0, tuple(library.encode(t or "")), t or "") for i, t in rows
    )
    assert "kept" in encode_pieces(table, PATH).columns
    assert encode_pieces(documents([]), PATH).count() == 0
