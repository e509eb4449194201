"""The byte-level codec against the library that its ranks belong to."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from modelloom.llm.byte_bpe import Codec, codec_of, decode_documents, encode_documents, splitter_of
from modelloom.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.conftest import edge_rows

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
LETTERS = "aabbcdeeee thhhe  in\n\t'sS.,!İ日本語é🙂́‍<|endoftext|>0123²  \x1c՘₏"


def library(path):
    ranks = codec_of(path).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(codec, text):
    return np.frombuffer(b"".join(map(codec.encode, splitter_of(public_tokenizers.PATTERN).parts(text))), dtype="<u4").tolist()


@pytest.mark.parametrize("file", FILES)
def test_fuzz_equals_library(file):
    path = public_tokenizers.path(file)
    codec, theirs, rnd = codec_of(path), library(path), random.Random(1)
    tokens = list(codec.ranks)
    for i in range(6000):
        text = [
            lambda: "".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(40))),
            lambda: b"".join(rnd.choice(tokens) for _ in range(rnd.randrange(8))).decode("utf-8", "ignore"),
            lambda: b"".join(rnd.choice(tokens).strip() for _ in range(rnd.randrange(6))).decode("utf-8", "ignore"),
            lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(60))),
            lambda: "".join(chr(rnd.choice([rnd.randrange(32, 0x3000), rnd.randrange(0xE000, 0x20000)])) for _ in range(rnd.randrange(20))),
        ][i % 5]()
        ids = ids_of(codec, text)
        assert ids == theirs.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_000 + "x", "ab" * 30_000, "é" * 20_000, "word " * 300_000])
def test_long_pieces_and_texts(text):
    path = public_tokenizers.path(FILES[0])
    assert ids_of(codec_of(path), text) == library(path).encode_ordinary(text)


def write_ranks(path, tokens):
    import base64

    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    return str(path)


def test_tokens_that_no_merge_reaches_are_whole_pieces_only(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abcd"]
    path = write_ranks(tmp_path / "ranks", tokens)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(tokens, range(len(tokens)), strict=True)), special_tokens={})
    codec = Codec(path)
    for text in ("abcd", "xabcd", "abcdabcd", "abc", "bcd"):
        assert ids_of(codec, text) == theirs.encode_ordinary(text)


def test_unusable_ranks_are_refused(tmp_path):
    with pytest.raises(ValueError, match="no token for the bytes"):
        Codec(write_ranks(tmp_path / "few", [b"a", b"b"]))


def test_query_equals_library(spark):
    path = public_tokenizers.path(FILES[0])
    theirs = library(path)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(theirs.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_and_edges(spark, edge, no_docs):
    encoded = encode_documents(edge)
    assert "N_TOKENS" not in encoded.columns and encoded.count() == len(edge_rows())
    back = decode_documents(encoded, text_col="back").select("doc_id", "text", "back", "n_tokens").collect()
    assert all((r.text or "") == r.back for r in back)
    assert {r.n_tokens for r in back if not r.text} == {0}
    assert encode_documents(no_docs).count() == 0
    cut = codec_of(public_tokenizers.path(FILES[0])).ranks["é".encode()[:1]]
    nulls = spark.sql(f"SELECT CAST(NULL AS array<int>) AS ids, 1 AS TEXT UNION ALL SELECT array(), 2 UNION ALL SELECT array({cut}), 3")
    assert [r.text for r in decode_documents(nulls).collect()] == [None, "", "�"]
