import gc
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from riskweave.llm import byte_bpe, queries, splitting, toxicity
from riskweave.llm.common import map_rows
from tests.llm.conftest import expected_rows, rows_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_texts(codec, library, odd_texts):
    for text in odd_texts:
        assert ids_of(codec.encode(text or "")) == library.encode_ordinary(text or "")
        assert codec.decode(codec.encode(text or "")) == (text or "").encode()


def test_random_texts_and_slices(codec, library):
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("aabé   ßtheing\n\t 日1😀's  ! \x1c\u00a0") for _ in range(r.randint(0, 40)))
        whole = library.encode_ordinary(text)
        assert ids_of(codec.encode(text)) == whole
        assert ids_of(b"".join(map(codec.words.slice, splitting.slices(text, 5)))) == whole
        assert "".join(splitting.slices(text, 5)) == text


def test_long_pre_tokens(codec, library):
    r = random.Random(2)
    for piece in ("a" * 50_000, "ab" * 30_000, "the" * 20_000, "".join(r.choice("abcdefgh") for _ in range(60_000)), "é" * 9000):
        assert byte_bpe.merged(piece.encode(), codec.ranks) == library.encode_ordinary(piece)


def test_merges_against_rescans(codec):
    """The lowest rank, leftmost first, found by looking at all pairs again after every merge."""

    def rescanned(piece):
        if piece in codec.ranks:
            return [codec.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((codec.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60,))
            if best[0] == 1 << 60:
                return [codec.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    r = random.Random(3)
    for _ in range(500):
        piece = bytes(r.choice(b"aabtheinr\xc3\xa9 ") for _ in range(r.randint(1, 30)))
        assert byte_bpe.merged(piece, codec.ranks) == rescanned(piece)
        assert byte_bpe.merged(piece, codec.ranks, codec.pairs) == rescanned(piece)
        if piece not in codec.ranks:
            assert byte_bpe._merged_long(piece, codec.ranks) == rescanned(piece)


def test_forgetting(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "KEPT", 2)
    codec = byte_bpe.Codec(PATH, PATTERN)
    text = "one two three onetwothree four five one " * 3
    assert ids_of(codec.encode(text)) == library.encode_ordinary(text)


def test_operator(odd_documents, no_documents, library):
    def one(text):
        ids = np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()
        return len(ids) // 4, ids, (text or "").encode()

    encoded = byte_bpe.encode(odd_documents, PATH, PATTERN)
    decoded = byte_bpe.decode(encoded, PATH, PATTERN)
    got = sorted(((a, b, bytes(c), bytes(d)) for a, b, c, d in rows_of(decoded, "doc_id", "n_tokens", "ids", "decoded")), key=repr)
    assert got == expected_rows(odd_documents, one)
    assert byte_bpe.encode(no_documents, PATH, PATTERN).count() == 0


def test_query(spark, small, library):
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, small).collect()}
    for row in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(row.text), dtype="<u4").tobytes()
        found = got.pop(row.doc_id)
        assert found.n_tokens == len(ids) // 4 and found.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()
    assert not got


def test_workers_drop_the_codec_for_other_operators(spark, odd_documents):
    """What a worker keeps goes when a task of another operator comes, and stays for one that uses it."""

    def codecs(batches):
        found = sum(isinstance(x, byte_bpe.Codec) for x in gc.get_objects())
        yield [(found,) for batch in batches for _ in batch]

    def most(keeps=None):
        return max(r.n for r in map_rows(spark.range(0, 64, 1, 8), codecs, "n int", keeps).collect())

    texts = spark.range(0, 64, 1, 8).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    byte_bpe.encode(texts, PATH, PATTERN).collect()
    assert most(("byte_bpe", PATH, PATTERN)) >= 1
    assert toxicity.character_counts(texts).count() > 0
    byte_bpe.encode(texts, PATH, PATTERN).collect()
    assert most() == 0
