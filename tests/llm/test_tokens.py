"""Packing and SentencePiece against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from duespark.llm import packing, sentencepiece_bpe
from duespark.llm.queries import BYTE_BPE, PIECES

from .conftest import odd_rows


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_fast_encoder_equals_the_library():
    enc, full = packing.encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in ["", " ", "a  b\n\n c", "it's 12,345 ###", "é日本𐍈\x00", "a<|endoftext|>b", *(t or "" for _, t in odd_rows())]:
        assert enc.encode(text).tolist() == full.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 1_100_000, "\u3000" * 300_000, " \n" * 60_000])
def test_long_runs_of_white_space(run):
    enc, full, text = packing.encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE), f"before{run}after it's"
    want = full.encode(text, add_special_tokens=False).ids
    assert enc.encode(text).tolist() == want and enc.ordinary(text) == want


def test_pieces_are_whole_and_gapless(spark, odd):
    rows = packing.pack(odd, BYTE_BPE).collect()
    full = Tokenizer.from_file(BYTE_BPE)
    total = sum(len(full.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows())
    assert sum(r.length for r in rows) == total
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, parts in by_seq.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.WINDOW or seq == max(by_seq)
    long = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 29)
    want = full.encode(dict(odd_rows())[29], add_special_tokens=False).ids + [1]
    assert np.frombuffer(b"".join(x for _, x in long), "<u4").tolist() == want


def test_sequences_join_their_pieces(odd):
    found = packing.sequences(packing.pack(odd, BYTE_BPE)).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in found)
    assert all(r.n_tokens == packing.WINDOW for r in found[:-1])


def test_query_digests_of_pieces(spark, small):
    from duespark.llm.queries import QUERIES

    full, texts = Tokenizer.from_file(BYTE_BPE), {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op7_packing"](spark, small).collect():
        ids = full.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_merge_rounds_equal_the_library(library):
    m, draw = sentencepiece_bpe.model(PIECES), random.Random(1)
    texts = ["", " ", "a  b", "  lead", "trail  ", "\n x\ty ", "▁x", "a▁ ▁b", "日本𐍈 ﬁ", "a\x00b", "<s> </s>", "aaaaaaa aaaa", "=====-----    ====", "ab" * 3000]
    texts += ["".join(draw.choice(["a", "b", "the", "ing", " ", "  ", "\n", "é", "=", "0", "x", "▁", "日", "er"]) for _ in range(draw.randint(0, 60))) for _ in range(800)]
    for text, ids in zip(texts, m.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), repr(text)
        assert m.decode(np.append(ids, m.end)) == library.decode([*library.encode(text), m.end]), repr(text)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef0123456789+/", "日本語é"])
def test_long_words_equal_the_library(library, letters):
    m, draw = sentencepiece_bpe.model(PIECES), random.Random(2)
    for text in ["".join(draw.choice(letters) for _ in range(200_000)), letters * (200_000 // len(letters)), letters[:2] * 100_000]:
        assert m.encode([text])[0].tolist() == library.encode(text)


def test_round_trip_digests(odd, library):
    found = sorted(tuple(r) for r in sentencepiece_bpe.round_trip(odd.filter("doc_id IS NOT NULL"), PIECES).collect())
    want = []
    for i, t in odd_rows():
        if i is not None:
            ids = [*library.encode(t or ""), library.eos_id()]
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert found == sorted(want)


def test_encode_then_decode(odd):
    ids = sentencepiece_bpe.encode_documents(odd, PIECES)
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode_documents(ids, PIECES).collect()}
    assert back[29] == dict(odd_rows())[29] and back[27] == "日本  x  y" and back[20] == ""


def test_empty_tables(empty):
    assert packing.pack(empty, BYTE_BPE).count() == 0
    assert sentencepiece_bpe.round_trip(empty, PIECES).count() == 0
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
