"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is

    length     8 bytes   of the payload
    check      4 bytes   masked checksum of the 8 length bytes
    payload    1 byte    width of an id in bytes (2 or 4), plus 128 for a null document id
               8 bytes   document id, signed
               ids
    check      4 bytes   masked checksum of the payload

with little-endian numbers.  The checksum is CRC-32, turned by 15 bits and
shifted by a constant, so that checksums of data which holds checksums stay
apart.  Each task writes one shard under a name of its own and returns the
index rows; a shard counts only once the index names it, so tasks may fail or
run twice.  The index is a Parquet table (shard, file, doc_id, offset, length,
position, n_tokens); position counts the ids before the record in its shard.
"""

import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import map_rows

MASK = 0xA282EAD8
NULL_ID = 128
HEAD, ID = struct.Struct("<QI"), struct.Struct("<Bq")
TAIL = struct.Struct("<I")

# Word parts kept with their ids in each worker; beyond it the store starts anew.
KEPT_PARTS = 800_000
LONGEST_KEPT = 64
MARKS = ".,;:!?#$%&*"
# What stands between words that are encoded in one call, and how many are.
MARK, JOINED_WORDS = "!", 1000

INDEX = "shard int, file string, doc_id long, offset long, length long, position long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = ID.pack(width | (NULL_ID if doc_id is None else 0), doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))))


def unframed(record: bytes) -> tuple[int | None, np.ndarray]:
    """(document id, ids) of one record; raises ValueError if a checksum or the length is wrong."""
    if len(record) < HEAD.size + ID.size + TAIL.size:
        raise ValueError("record too short")
    length, check = HEAD.unpack_from(record)
    if masked(record[:8]) != check or HEAD.size + length + TAIL.size != len(record):
        raise ValueError("wrong record length")
    payload = record[HEAD.size : HEAD.size + length]
    if masked(payload) != TAIL.unpack_from(record, HEAD.size + length)[0]:
        raise ValueError("wrong checksum")
    kind, doc_id = ID.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{kind & ~NULL_ID}", offset=ID.size)
    return (None if kind & NULL_ID else doc_id), ids


def file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    if folder.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(folder)


def load_tokenizer(path: str, plain: bool = False):
    """The tokenizer of a file, for one thread; with ``plain``, strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


class WordIds:
    """Ids of words by the tokenizers library, those of letters many in one call.

    Words of letters stand in one text with a mark between them.  The mark is a
    pre-token with one id, which no word of letters has, so it tells where a
    word ends.  Where the vocabulary does not keep to that, every word is
    encoded by itself.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        alone, one, both = (self._ids(text) for text in (MARK, "a", f"a {MARK} a"))
        sure = len(alone) == 1 and alone[0] not in one and both == one + alone + one
        self.mark = alone[0] if sure and tokenizer.truncation is None and tokenizer.padding is None else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, words: list[str]) -> tuple[list[str], np.ndarray, list[int], list[int]]:
        """The words in another order, the ids of all of them one after the other, and where those of each begin and end."""
        order, parts, starts, ends, n = [], [], [], [], 0
        letters: list[str] = []
        others: list[str] = []
        for word in words:
            (letters if self.mark is not None and word.isalpha() else others).append(word)
        for at in range(0, len(letters), JOINED_WORDS):
            part = letters[at : at + JOINED_WORDS]
            text = f" {MARK} ".join([*part, ""])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part):
                others += part
                continue
            order += part
            parts.append(ids)
            starts += [n, *(marks[:-1] + (n + 1)).tolist()]
            ends += (marks + n).tolist()
            n += len(ids)
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            ids = found.ids
            order.append(word)
            parts.append(np.array(ids, dtype=np.uint32))
            starts.append(n)
            n += len(ids)
            ends.append(n)
        flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
        return order, flat, starts, ends


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes.

    The vocabulary's pre-tokens never hold white space, so the parts of a text
    between blanks and line ends are encoded by themselves, and each part that
    comes again is looked up.  Letters and the marks behind them are different
    pre-tokens, and case is folded, so words differ less than parts do.  A
    part with the string of a special token is no word and stays whole.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.word_ids = WordIds(self.tokenizer)
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > KEPT_PARTS:
            self.parts = {}
        if len(self.words) > KEPT_PARTS:
            self.words = {}
        split = [text.replace("\n", " ").split(" ") for text in texts]
        known, long = self.parts, []
        # Most are ASCII letters only: one piece.
        fresh = [part for part in set().union(*split) if part not in known]
        pieces = {part: (part.lower(),) if part.isascii() and part.isalpha() else pieces_of(part) for part in fresh}
        self._learn({word for own in pieces.values() for word in own})
        for part, own in pieces.items():
            known[part] = self.words[own[0]] if len(own) == 1 else self.words[own[0]] + self.words[own[1]]
            if len(part) > LONGEST_KEPT:
                long.append((part, own))
        encoded = [b"".join(map(known.__getitem__, part)) for part in split]
        for part, own in long:
            del known[part]
            for word in own:
                self.words.pop(word, None)
        return encoded

    def _learn(self, words: set[str]) -> None:
        order, flat, starts, ends = self.word_ids([w for w in words if w not in self.words])
        width, ids = self.width, flat.astype(f"<u{self.width}").tobytes()
        for word, start, end in zip(order, starts, ends):
            self.words[word] = ids[start * width : end * width]


def pieces_of(part: str) -> tuple[str, ...]:
    """A word and the marks behind it, or the part as it is."""
    word = part.rstrip(MARKS)
    # Some letters fold to a letter and a mark, which would join the marks behind it.
    if not word.isalpha() or not word.isascii() and not unicodedata.normalize("NFC", word).lower().isalpha():
        return (part,)
    if word.isascii():
        word = word.lower()
    return (word, part[len(word) :]) if len(word) < len(part) else (word,)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_records(documents: DataFrame, tokenizer: str, folder: str, end_id: int | None = None) -> None:
    """Encodes ``documents`` (doc_id, text) into shards and an index below ``folder``.

    Records ascend by doc_id, null ids first and equal ids by text, within the
    shards and from shard to shard.  Null texts are empty; with ``end_id`` that
    id closes every record.  Strings of special tokens get the ids of these
    tokens, as the library gives them by default.
    Further columns are ignored, and an empty table leaves an empty index.
    """
    spark = documents.sparkSession
    shards, place = file_system(folder)
    shards.create_dir(place, recursive=True)
    ordered = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    map_rows(ordered, _writer(tokenizer, folder, end_id), INDEX).write.parquet(f"{folder}/index")


def _writer(tokenizer: str, folder: str, end_id: int | None):
    def write(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        encode, store, place = encoder(tokenizer), *file_system(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        end = b"" if end_id is None else end_id.to_bytes(encode.width, "little")
        offset = position = 0
        out = None
        try:
            for batch in batches:
                out = out or store.open_output_stream(f"{place}/{name}")
                rows = []
                for (doc_id, _), ids in zip(batch, encode([text for _, text in batch])):
                    ids += end
                    record = framed(doc_id, ids, encode.width)
                    out.write(record)
                    n = len(ids) // encode.width
                    rows.append((shard, name, doc_id, offset, len(record), position, n))
                    offset += len(record)
                    position += n
                yield rows
        finally:
            if out is not None:
                out.close()

    return write


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index and ``start``, the number of ids in all records before a record."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    # One row for each shard, so the running sum is over as many rows as there are tasks.
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return index.join(starts, "shard").select(
        *index.columns, (F.col("base") + F.col("position")).alias("start")
    )


def map_records(
    index: DataFrame, folder: str, function: Callable[[np.ndarray], tuple], columns: str
) -> DataFrame:
    """doc_id, start and ``function(ids)`` for every row of ``index``, read from the shards.

    Rows may come in any order: each names its file and offset.  ``columns`` is
    the schema of what the function returns.
    """
    schema = f"doc_id long, start long, {columns}"

    def read(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        store, place = file_system(folder)
        source, opened = None, None
        try:
            for batch in batches:
                rows = []
                for file, offset, length, start in batch:
                    if file != opened:
                        if source is not None:
                            source.close()
                        source, opened = store.open_input_file(f"{place}/{file}"), file
                    doc_id, ids = unframed(source.read_at(length, offset))
                    rows.append((doc_id, start, *function(ids)))
                yield rows
        finally:
            if source is not None:
                source.close()

    return map_rows(index.select("file", "offset", "length", "start"), read, schema)
