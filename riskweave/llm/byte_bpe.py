"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of its bytes.  Every merge rank that is pending
has a bucket of list positions, and a bitmap says which buckets hold any: a
summary word has a bit for each group of 256 ranks, and each group a word with
a bit for each rank.  Two find-first-set steps give the lowest pending rank,
so a step costs the same in a pre-token of any length.  A merge changes the
pairs around it; their old entries stay behind and are skipped when they come
up.
"""

import base64
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import kept, map_rows
from riskweave.llm.splitting import WordSplitter

GROUP_BITS = 8
GROUP_MASK = (1 << GROUP_BITS) - 1
STALE = -1

# Words kept with their ids in each worker, in each of two generations.
KEPT = 600_000
LONGEST_KEPT = 64
# Pre-tokens above this length use compact arrays.
LONG_PIECE = 4096
# Tokens of a text that are decoded at once.
SLICE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file with one base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], pairs: list[int] | None = None) -> list[int]:
    """Ids of one pre-token: always the pair of the lowest rank, of equal ones the leftmost.

    ``pairs`` may hold the rank of every pair of bytes, or ``STALE``.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n > LONG_PIECE:
        return _merged_long(piece, ranks)
    # A bucket is a word of list positions here, and its leftmost one a find-first-set as well.
    after, before, pending = list(range(1, n + 1)), list(range(-1, n - 1)), [STALE] * n
    buckets: dict[int, int] = {}
    groups: dict[int, int] = {}
    summary = 0
    rank_of = ranks.get
    for i in range(n - 1):
        rank = pairs[piece[i] << 8 | piece[i + 1]] if pairs else rank_of(piece[i : i + 2], STALE)
        if rank >= 0:
            pending[i] = rank
            if rank in buckets:
                buckets[rank] |= 1 << i
            else:
                buckets[rank] = 1 << i
                group = rank >> GROUP_BITS
                groups[group] = groups.get(group, 0) | 1 << (rank & GROUP_MASK)
                summary |= 1 << group
    while summary:
        group = (summary & -summary).bit_length() - 1
        word = groups[group]
        rank = group << GROUP_BITS | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        i = (bucket & -bucket).bit_length() - 1
        bucket &= bucket - 1
        if bucket:
            buckets[rank] = bucket
        else:
            del buckets[rank]
            groups[group] = word = word & (word - 1)
            if not word:
                summary &= summary - 1
        if pending[i] != rank:
            continue
        j = after[i]
        after[i] = k = after[j]
        pending[j] = STALE
        if k < n:
            before[k] = i
            at, end = i, after[k]
        else:
            # Nothing follows, so only the pair before has changed.
            pending[i] = STALE
            at, end = before[i], k
        while at >= 0:
            rank = rank_of(piece[at:end])
            if rank is None:
                pending[at] = STALE
            else:
                pending[at] = rank
                if rank in buckets:
                    buckets[rank] |= 1 << at
                else:
                    buckets[rank] = 1 << at
                    group = rank >> GROUP_BITS
                    groups[group] = groups.get(group, 0) | 1 << (rank & GROUP_MASK)
                    summary |= 1 << group
            if at != i:
                break
            at, end = before[i], k
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with compact arrays, and heaps of positions as buckets."""
    n = len(piece)
    after, before, pending = array("i", range(1, n + 1)), array("i", range(-1, n - 1)), array("i", [STALE]) * n
    buckets: dict[int, list[int]] = {}
    groups: dict[int, int] = {}
    summary = 0

    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            pending[i] = rank
            if rank in buckets:
                buckets[rank].append(i)  # positions ascend, so the bucket stays a heap
            else:
                buckets[rank] = [i]
                group = rank >> GROUP_BITS
                groups[group] = groups.get(group, 0) | 1 << (rank & GROUP_MASK)
                summary |= 1 << group

    while summary:
        group = (summary & -summary).bit_length() - 1
        word = groups[group]
        rank = group << GROUP_BITS | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            groups[group] = word = word & (word - 1)
            if not word:
                summary &= summary - 1
        if pending[i] != rank:
            continue
        j = after[i]
        k = after[j]
        after[i] = k
        pending[j] = STALE
        changed = ()
        if k < n:
            before[k] = i
            changed = ((i, after[k]),)
        else:
            pending[i] = STALE
        if i:
            changed += ((before[i], k),)
        for at, end in changed:
            rank = ranks.get(piece[at:end])
            if rank is None:
                pending[at] = STALE
                continue
            pending[at] = rank
            if rank in buckets:
                heappush(buckets[rank], at)
            else:
                buckets[rank] = [at]
                group = rank >> GROUP_BITS
                groups[group] = groups.get(group, 0) | 1 << (rank & GROUP_MASK)
                summary |= 1 << group

    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoding and decoding by the ranks of a file; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = [self.ranks.get(bytes([a, b]), STALE) for a in range(256) for b in range(256)]
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.words = WordSplitter(pattern, self._piece, KEPT, LONGEST_KEPT)
        self.encode = self.words.encode

    def _piece(self, piece: str) -> bytes:
        ids = merged(piece.encode("utf-8"), self.ranks, self.pairs)
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> bytes:
        values = np.frombuffer(ids, dtype="<u4")
        tokens = self.tokens.__getitem__
        return b"".join(
            b"".join(map(tokens, values[at : at + SLICE].tolist())) for at in range(0, len(values), SLICE)
        )


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a worker process, until other operators need the memory."""
    return kept(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``documents`` (doc_id, text).

    ``ids`` is binary, little-endian unsigned 32-bit integers.  Null and empty
    texts have no ids, repeated rows and null doc_ids keep their rows, further
    columns are ignored.  There is no shuffle.
    """

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        own = codec(path, pattern)
        for batch in batches:
            encoded = [(doc_id, own.encode(text)) for doc_id, text in batch]
            yield [(doc_id, len(ids) // 4, ids) for doc_id, ids in encoded]

    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(texts, run, "doc_id long, n_tokens long, ids binary", ("byte_bpe", path, pattern))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` (doc_id, n_tokens, ids) and ``decoded``, the bytes of the text; null ids are none."""

    def run(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        own = codec(path, pattern)
        for batch in batches:
            yield [(doc_id, n, ids, own.decode(ids or b"")) for doc_id, n, ids in batch]

    return map_rows(
        encoded.select("doc_id", "n_tokens", "ids"),
        run,
        "doc_id long, n_tokens long, ids binary, decoded binary",
        ("byte_bpe", path, pattern),
    )
