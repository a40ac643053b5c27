import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import records
from riskweave.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_frames():
    for doc_id, ids in ((5, b"\1\0\2\0"), (None, b""), (-1, b"\xff\xff")):
        record = records.framed(doc_id, ids, 2)
        got, values = records.unframed(record)
        assert got == doc_id and values.astype("<u2").tobytes() == ids
        for at in range(len(record)):
            broken = bytearray(record)
            broken[at] ^= 64
            with pytest.raises(ValueError):
                records.unframed(bytes(broken))
        with pytest.raises(ValueError):
            records.unframed(record[:-1])


def test_encoder_is_the_library(library):
    encoder, r = records.Encoder(PATH), random.Random(2)
    letters = ["a", "A", "b", "É", "é", " ", "  ", "ß", "the", "Σ", ".", ",", "!", "'s", "S", "\n", "\t", "日", "1", "😀", "\u0301"]
    letters += ["\x1c", "$", "%", "<|endoftext|>", "\u00a0", "ǅ", "İ"]
    for _ in range(300):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(5)]
        for text, ids in zip(texts, encoder(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_special_strings(library):
    encoder = records.Encoder(PATH)
    texts = ["a <|endoftext|> b", "a<|endoftext|>b.", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>\u0301 x", "<|end oftext|>"]
    for text, ids in zip(texts, encoder(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert 49407 in np.frombuffer(encoder(texts[:1])[0], "<u2")


def test_words_of_letters_are_encoded_together(library, monkeypatch):
    """Fewer calls than words, and the ids that each word has by itself; other words are not joined."""
    monkeypatch.setattr(records, "JOINED_WORDS", 7)
    r = random.Random(5)
    pool = "abcdefgéßΣσς日ǅǃıİ"
    words = list({"".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(300)} | {"!", "a!", "", "1", "'s", "x's", "a\u0301"})
    calls = []

    class Counted:
        truncation = padding = None

        def encode(self, text, **options):
            calls.append(text)
            return library.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **options)

    order, flat, starts, ends = records.WordIds(Counted())(words)
    assert sorted(order) == sorted(words) and len(calls) < len(words) / 2
    for word, start, end in zip(order, starts, ends, strict=True):
        assert flat[start:end].tolist() == library.encode(word, add_special_tokens=False).ids


def test_encoder_forgets(library, monkeypatch):
    monkeypatch.setattr(records, "KEPT_PARTS", 3)
    encoder = records.Encoder(PATH)
    for text in ("one two, three. four five", "six seven one", "x" * 200 + " one"):
        assert np.frombuffer(encoder([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def written(spark, documents, end=2):
    place = new_folder(spark, "test-records")
    records.write_records(documents, PATH, place, end_id=end)
    return place


def test_round_trip(spark, odd_documents, library):
    place = written(spark, odd_documents)
    index = records.read_index(spark, place)
    # A shuffled index reads the same records.
    shuffled = index.orderBy(F.rand(3))
    found = records.map_records(shuffled, place, lambda ids: (ids.tolist(),), "ids array<long>").collect()
    got = sorted(((r.doc_id, r.start, r.ids) for r in found), key=lambda x: x[1])
    rows = sorted(
        ((r.doc_id, r.text or "") for r in odd_documents.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())
    )
    start, expected = 0, []
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, ids))
        start += len(ids)
    assert got == expected


def test_damaged_shard(spark, odd_documents):
    place = written(spark, odd_documents.limit(4))
    index = records.read_index(spark, place)
    store, path = records.file_system(place)
    row = index.first()
    with store.open_input_file(f"{path}/{row.file}") as source:
        data = bytearray(source.read())
    data[row.offset + 30 if row.length > 40 else row.offset + 14] ^= 1
    with store.open_output_stream(f"{path}/{row.file}") as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="wrong"):
        records.map_records(index, place, lambda ids: (len(ids),), "n long").collect()


def test_no_documents(spark, no_documents):
    place = written(spark, no_documents)
    assert records.map_records(records.read_index(spark, place), place, lambda ids: (len(ids),), "n long").count() == 0


def test_query(spark, small, library):
    from riskweave.llm import queries

    got = queries.op1_token_records(spark, small).orderBy("doc_id").collect()
    start = 0
    for row, doc in zip(got, spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = np.array(library.encode(doc.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
