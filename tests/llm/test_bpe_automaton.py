import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskweave.llm import bpe_automaton, queries, splitting
from tests.llm.conftest import rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return bpe_automaton.Tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert ids_of(own.encode(text)) == ids
    assert own.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_texts(own, library, odd_texts):
    for text in odd_texts:
        same(own, library, text or "")


def test_added_tokens(own, library):
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext|", "x\n<|endoftext|>\ny"):
        same(own, library, text)


def test_random_texts(own, library):
    r = random.Random(1)
    for _ in range(4000):
        same(own, library, "".join(r.choice("aabé   ßtheing\n\t 日1😀's  ! \x1c ") for _ in range(r.randint(0, 50))))


def test_long_pre_tokens(own, library):
    r = random.Random(2)
    for piece in ("a" * 20_000, "ab" * 9000, "the" * 5000, " " * 3000, "é" * 3000, "".join(r.choice("abcdefgh") for _ in range(20_000))):
        same(own, library, piece)


def test_decoding_any_ids(own, library):
    r = random.Random(3)
    for _ in range(2000):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert own.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([10**6, 15496], dtype=np.int64)) == library.decode([15496])


def applied(word, merges):
    """Every merge in turn, from left to right."""
    parts = [word[i : i + 1] for i in range(len(word))]
    for u, v in merges:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == u and parts[i + 1] == v:
                parts[i : i + 2] = [u + v]
            i += 1
    return parts


def test_random_merges():
    """Small dictionaries, with merges of a token with itself and merges that never apply, on all short words."""
    r = random.Random(4)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 12:
            u, v = r.choice(tokens), r.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                merges.append((u, v))
                tokens.append(u + v)
        ids = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(merges)}
        automaton = bpe_automaton.Automaton(ids, merges)
        labels = {i: t for t, i in ids.items()}
        for _ in range(150):
            word = bytes(r.choice(b"aabbc") for _ in range(r.randint(0, 14)))
            assert [labels[i] for i in automaton.read(word)] == applied(word, merges)


def test_accepts_only_what_merges_make():
    """Of all ways to cut a word into tokens the table allows exactly one."""
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"a"), (b"b", b"ab"), (b"aa", b"b"), (b"ab", b"ab")]
    ids = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(merges)}
    automaton = bpe_automaton.Automaton(ids, merges)

    def accepted(state, word):
        if not word:
            return [[]]
        found = []
        for token, label in enumerate(automaton.tokens):
            if word.startswith(label) and automaton.alive[token] and automaton.allows(state, token):
                found += [[label, *rest] for rest in accepted(automaton.leads[token], word[len(label) :])]
        return found

    for n in range(1, 10):
        for k in range(2**n):
            word = bytes(b"ab"[k >> i & 1] for i in range(n))
            assert accepted(0, word) == [applied(word, merges)]


def test_refused(tmp_path):
    ids = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    with pytest.raises(ValueError, match="same token"):
        bpe_automaton.Automaton(ids, [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")])
    with pytest.raises(ValueError, match="before"):
        bpe_automaton.Automaton(ids, [(b"ab", b"c"), (b"a", b"b")])
    with pytest.raises(ValueError, match="without an id"):
        bpe_automaton.Automaton({}, [])
    file = json.load(open(PATH))
    file["model"]["dropout"] = 0.1
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="plain"):
        bpe_automaton.Tokenizer(str(tmp_path / "t.json"))


def test_forgetting(own, library):
    words = splitting.WordSplitter(bpe_automaton.PATTERN, own._encode_piece, kept=2, longest=8)
    for _ in range(3):
        text = "one two three onetwothree four five one, one's  a\n b"
        assert ids_of(words.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(words.words) <= 2 and len(words.words.old) <= 2


def test_operator(odd_documents, no_documents, library):
    encoded = bpe_automaton.encode(odd_documents, PATH)
    got = rows_of(bpe_automaton.decode(encoded, PATH), "doc_id", "n_tokens", "ids", "text")
    expected = []
    for row in odd_documents.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        expected.append((row.doc_id, len(ids), ids, row.text or ""))
    assert got == sorted(expected, key=repr)
    assert bpe_automaton.encode(no_documents, PATH).count() == 0
    nothing = encoded.selectExpr("doc_id", "n_tokens", "CAST(NULL AS array<int>) AS ids")
    assert {r.text for r in bpe_automaton.decode(nothing, PATH).collect()} == {""}


def test_query(spark, small, library):
    got = {r.doc_id: r for r in queries.op12_bpe_automaton(spark, small).collect()}
    for row in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(row.text, add_special_tokens=False).ids
        found = got.pop(row.doc_id)
        assert found.n_tokens == len(ids)
        assert found.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got
