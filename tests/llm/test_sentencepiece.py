"""SentencePiece in merge rounds against the library itself."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from larkspur.llm import common, queries
from larkspur.llm import sentencepiece_bpe as S

from .helpers import SCHEMA, rows, sha

PATH = S.default_path()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
KINDS = ["abcdef ghi", "thean and ", "▁ \n\t a", "aaaaab", "0123 ab", "éèüß straße ", "漢字かなカナ中文的", "привет мир как", ".,!?;:'\"()[] ", "\x00\x01​﻿\U0001f600 a▁", "the in er on re at"]


def cases(n, seed):
    """Random strings of one alphabet or of pieces of the model, with and without spaces."""
    r = random.Random(seed)
    pieces = [LIB.id_to_piece(i) for i in range(259, 32000)]
    for _ in range(n):
        if r.random() < 0.5:
            kind = r.choice(KINDS)
            yield "".join(r.choice(kind) for _ in range(r.randint(0, 60)))
        else:
            yield "".join(r.choice(pieces) for _ in range(r.randint(0, 20))).replace("▁", r.choice([" ", "▁", ""]))


def test_codec():
    codec, texts = S.PieceCodec.get(PATH), list(cases(4000, 1))
    for text, want, got in zip(texts, LIB.encode(texts), codec.encode(texts)):
        assert got.tolist() == want, text
        assert codec.decode(got).decode() == LIB.decode(want), text


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_heap_takes_over(most):
    """A word may go on pair by pair after any round."""
    codec = S.PieceCodec.get(PATH)
    for text in cases(300, 2):
        sym = codec.symbol[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        if len(sym) and (sym >= 0).all():
            whole = codec.rounds(sym.copy(), np.zeros(len(sym), np.int32), 10_000)[0]
            assert codec.rounds(sym.copy(), np.zeros(len(sym), np.int32), most)[0].tolist() == whole.tolist()


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 30_000, "the" * 20_000, " " * 50_001, "x" * 2_500_000 + " b", "漢" * 40_000, "word and word " * 250_000])
def test_long_texts(text):
    codec = S.PieceCodec.get(PATH)
    got = codec.encode(["short", text, None])
    assert got[1].tolist() == LIB.encode(text) and got[0].tolist() == LIB.encode("short") and not len(got[2])
    assert codec.decode(got[1]).decode() == text


def test_any_ids_decode():
    """Ids that no text has, with stray bytes and control pieces."""
    r, codec = random.Random(3), S.PieceCodec.get(PATH)
    for _ in range(3000):
        ids = [r.randrange(32000) if r.random() < 0.6 else r.randrange(259) for _ in range(r.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int64)).decode() == LIB.decode(ids)


def test_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    at = tmp_path / "other.model"
    at.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="no normalisation"):
        S.PieceCodec(str(at))


def test_equal_scores(tmp_path):
    """Pieces that share their score are merged from the left, as in the library."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    for p in model.pieces:
        if p.type == 1 and len(p.piece) > 1:
            p.score = float(-(ord(p.piece[0]) % 7))
    at = tmp_path / "ties.model"
    at.write_bytes(model.SerializeToString())
    lib, codec, texts = sentencepiece.SentencePieceProcessor(model_file=str(at)), S.PieceCodec(str(at)), list(cases(1500, 4))
    for text, want, got in zip(texts, lib.encode(texts), codec.encode(texts)):
        assert got.tolist() == want, text


def test_rows(spark, sf):
    """Nulls in every column, repeated rows, clashing names, an empty table, text ids; then the given table."""
    data = rows() + [(None, None, None, None, None), (None, "a row without an id", None, None, 1)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("x") for c in ("t", "ids", "n_tokens", "ids_sha256")})
    want = sorted(((r[0], len(ids := LIB.encode(r[1] or "")), sha(",".join(map(str, ids))), sha(r[1] or "")) for r in data), key=str)
    assert sorted((tuple(r) for r in S.encode(df, PATH, digests=True).collect()), key=str) == want
    assert S.encode(df.limit(0), PATH).count() == 0
    back = S.decode(S.encode(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((None if d is None else f"d{d}", t or "") for d, t, *_ in data), key=str)
    for r in queries.QUERIES["op11_sentencepiece"](spark, sf).join(common.load(spark, sf, "documents").select("doc_id", "text"), "doc_id").collect():
        ids = LIB.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
