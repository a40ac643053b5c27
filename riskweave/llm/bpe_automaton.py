"""Byte-level BPE by a deterministic automaton over tokens.

The automaton reads tokens and accepts exactly the sequences that the merges
make of some word.  It begins with one state that any byte leads back to, and
every merge of u and v adds its gadget: the arcs labelled u go to a copy of
their state that v cannot leave, and wherever u could be read, uv can be read
too and leads where v leads.  All arcs of one token go to one state, so a
state is named by the tokens that lead to it, and what it needs is the set of
tokens that cannot be read there.

Tokens are numbered in the order of a tree in which uv hangs below u, the
youngest child first.  A gadget takes v away, and with it all tokens that
begin with v and are made later: these are v's youngest children with all
below them, one range of numbers.  A state is therefore a short sorted list of
ranges, and the table of all states is two arrays.

Every prefix of a word has one accepted sequence, so every place in it one
state.  Encoding follows the longest arc that the table allows, and steps back
from places that no arcs lead on from.  Decoding emits the labels of the arcs.
"""

import json
import struct
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.splitting import WordSplitter

# Words kept with their ids in each worker, in each of two generations.
KEPT = 600_000
LONGEST_KEPT = 64
# Tokens of a text that are decoded at once.
SLICE = 1 << 20

# States and arcs that have been looked up in the table and are kept in each worker.
KNOWN = 1 << 20

# Fixed value: the pattern of a byte-level pre-tokenizer that names none.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that a vocabulary file writes for each byte: itself if it is visible, else the next from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """States and arcs compiled from ``merges``, pairs of tokens in order of rank; ``ids`` names the tokens.

    Tokens are bytes.  A merge must follow those that make its parts, and two
    merges must not make the same token.
    """

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = ids
        singles = [bytes([b]) for b in range(256)]
        missing = [t for t in (*singles, *(u + v for u, v in merges)) if t not in ids]
        if missing:
            raise ValueError(f"tokens without an id: {missing[:5]}")
        self.tokens = singles + [u + v for u, v in merges]
        number = {t: k for k, t in enumerate(self.tokens)}
        if len(number) < len(self.tokens):
            raise ValueError("several merges make the same token")
        pairs = [(number.get(u, len(number)), number.get(v, len(number))) for u, v in merges]
        if any(max(pair) >= 256 + k for k, pair in enumerate(pairs)):
            raise ValueError("a merge stands before those that make its parts")
        self._number(pairs)
        self._states(pairs)
        self._trie()

    def _number(self, pairs: list[tuple[int, int]]) -> None:
        """``place`` and ``end`` of every token in the tree, and ``below``: children with the youngest last."""
        n = len(self.tokens)
        self.below: list[list[int]] = [[] for _ in range(n)]
        for k, (u, _) in enumerate(pairs):
            self.below[u].append(256 + k)
        size = [1] * n
        for k in range(len(pairs) - 1, -1, -1):
            size[pairs[k][0]] += size[256 + k]
        self.place, self.end = [0] * n, [0] * n
        at = 0
        for b in range(256):
            self.place[b] = at
            at += size[b]
        for token in range(n):
            at = self.place[token] + 1
            self.end[token] = self.place[token] + size[token]
            for child in reversed(self.below[token]):
                self.place[child] = at
                at += size[child]

    def _taken(self, token: int, made: int) -> tuple[int, int]:
        """The range of a token and all below it that is made with or after the token ``made``."""
        children = self.below[token]
        older = bisect_right(children, made - 1)
        return self.place[token], self.place[children[older - 1]] if older else self.end[token]

    def _states(self, pairs: list[tuple[int, int]]) -> None:
        ranges: list[list[tuple[int, int]]] = [[]]
        leads, arcs = [0] * 256, [257]  # the start counts as an arc, so its state never changes
        self.alive = [True] * len(self.tokens)
        self.longest = max(map(len, self.tokens))
        self.known: dict[int, bool] = {}
        for k, (u, v) in enumerate(pairs):
            made = 256 + k
            old = leads[u]
            place = self.place[v]
            if not (self.alive[u] and self.alive[v]) or any(a <= place < b for a, b in ranges[old]):
                # u and v never stand side by side: the merge makes nothing.
                self.alive[made] = False
                leads.append(0)
                continue
            gone = self._taken(v, made)
            if u == v:
                leads.append(old)
                arcs[old] += 1
            if arcs[old] == 1:
                # Nothing else leads there, so the copy would leave the old state unreachable.
                ranges[old].append(gone)
            else:
                arcs[old] -= 1
                leads[u] = len(ranges)
                ranges.append([*ranges[old], gone])
                arcs.append(1)
            if u != v:
                leads.append(leads[v])
                arcs[leads[v]] += 1
        self.leads = leads
        # One after the other in two arrays; ranges within others are left out.
        self.first, self.starts, self.ends = [0], [], []
        for state, found in enumerate(ranges):
            last = -1
            for a, b in sorted(found, key=lambda r: (r[0], -r[1])) if arcs[state] else ():
                if b > last:
                    self.starts.append(a)
                    self.ends.append(b)
                    last = b
            self.first.append(len(self.starts))

    def _trie(self) -> None:
        """Labels of the arcs byte by byte: a node has, by byte, the next node and the arc that ends there, or -1."""
        self.root: dict[int, tuple[dict, int]] = {}
        # A token stands behind those that its label begins with, so a node that is made is not yet an arc's end.
        for token in sorted(range(len(self.tokens)), key=lambda t: len(self.tokens[t])):
            if self.alive[token]:
                node, label = self.root, self.tokens[token]
                for byte in label[:-1]:
                    if byte not in node:
                        node[byte] = {}, -1
                    node = node[byte][0]
                node[label[-1]] = node[label[-1]][0] if label[-1] in node else {}, token
        self.length = [len(t) for t in self.tokens]
        self.id_of = [self.ids[t] for t in self.tokens]
        self.single = {t: i for t, i, alive in zip(self.tokens, self.id_of, self.alive) if alive}

    def allows(self, state: int, token: int) -> bool:
        """Whether a token can be read in a state."""
        place = self.place[token]
        at = bisect_right(self.starts, place, self.first[state], self.first[state + 1]) - 1
        return at < self.first[state] or self.ends[at] <= place

    def read(self, word: bytes) -> list[int]:
        """Ids of the accepted sequence whose labels are ``word``.

        The longest arc that the table allows is tried first.  A place has one
        state whatever way leads to it, so a place without a way to the end is
        left at most once.
        """
        if word in self.single:
            return [self.single[word]]  # the start lets every token be read
        n = len(word)
        root, leads, length, known = self.root, self.leads, self.length, self.known
        way: list[int] = []
        left: list[tuple[int, int, list[int]]] = []
        dead: set[int] = set()
        at, state = 0, 0
        while at < n:
            arcs = []
            node = root
            for byte in word[at : at + self.longest]:
                if byte not in node:
                    break
                node, token = node[byte]
                if token >= 0:
                    arcs.append(token)
            while True:
                if not arcs:
                    dead.add(at)
                    at, state, arcs = left.pop()
                    way.pop()
                    continue
                token = arcs.pop()
                to = at + length[token]
                if dead and to in dead:
                    continue
                key = state << 32 | token
                allowed = known.get(key)
                if allowed is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    allowed = known[key] = self.allows(state, token)
                if allowed:
                    break
            left.append((at, state, arcs))
            way.append(token)
            at, state = to, leads[token]
        id_of = self.id_of
        return [id_of[token] for token in way]


class Tokenizer:
    """Encoding and decoding as a byte-level tokenizer file says; ids are little-endian unsigned 32-bit bytes.

    Added tokens are cut out of a text first, the longest of those that begin at
    the leftmost place.  What lies between is split by the pattern.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        self._check(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        ids = {raw(token): i for token, i in file["model"]["vocab"].items() if all(c in letters for c in token)}
        self.automaton = Automaton(ids, [(raw(u), raw(v)) for u, v in merges])
        added = {t["content"]: t["id"] for t in file.get("added_tokens", []) if t["content"]}
        self.added = {text: np.array([i], dtype="<u4").tobytes() for text, i in added.items()}
        found = "|".join(map(regex.escape, sorted(self.added, key=lambda t: (-len(t), t))))
        self.cut = regex.compile(f"({found})") if found else None
        self.labels = {i: token for token, i in ids.items()} | {i: text.encode() for text, i in added.items()}
        self.words = WordSplitter(PATTERN, self._encode_piece, KEPT, LONGEST_KEPT)

    @staticmethod
    def _check(file: dict) -> None:
        before, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = file.get("normalizer") is None and before.get("type") == "ByteLevel"
        plain = plain and not before.get("add_prefix_space") and before.get("use_regex", True)
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = plain and model["type"] == "BPE" and not any(model.get(o) for o in options)
        marks = ("single_word", "lstrip", "rstrip")
        if not plain or any(t.get(m) for t in file.get("added_tokens", []) for m in marks):
            raise ValueError("only plain byte-level BPE files can be compiled")

    def _encode_piece(self, piece: str) -> bytes:
        ids = self.automaton.read(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if self.cut is None or self.cut.search(text) is None:
            return self.words.encode(text)
        parts = self.cut.split(text)
        return b"".join(self.added.get(p) if k % 2 else self.words.encode(p) for k, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> str:
        """Labels of the arcs, as text; ids without a label emit nothing, and bytes that are no UTF-8 become U+FFFD."""
        label = self.labels.get
        parts = (b"".join(label(i, b"") for i in ids[at : at + SLICE].tolist()) for at in range(0, len(ids), SLICE))
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file in a worker process."""
    return Tokenizer(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``documents`` (doc_id, text).

    Null and empty texts have no ids, repeated rows and null doc_ids keep their
    rows, further columns are ignored.  Texts are whole; there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            encoded = [own.encode(text) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(ids) // 4 for ids in encoded)])
            ids = pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"), pa.int32())
            columns = [batch.column("doc_id"), pa.array(np.diff(ends), pa.int64())]
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids))
            yield pa.RecordBatch.from_arrays(columns, schema=_ENCODED)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, n_tokens, ids) and their ``text``; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [own.decode(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", "n_tokens", ids).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")
