"""Token ids in binary files that are read by document.

A file holds the documents of one range of ids, in ascending order:

- one zstandard frame for each document, with a checksum of its content; documents of more than
  ``FRAME_IDS`` ids have several. Content is the ids as little-endian unsigned 32-bit numbers, so any
  zstandard tool decompresses a file to the ids of all its documents in a row;
- a skippable frame with the index of documents: id, whether there is one, number of frames and of ids;
- a skippable frame with the seek table in the layout of the seekable zstandard format: compressed and
  plain size of every frame and the low 32 bits of the XXH64 of its content.

A reader takes the last bytes of a file, finds the tables from them, and fetches and decompresses only
the frames of the documents it wants. Writers name files after their attempt; the table of files that
``write`` returns lists those of the attempts that Spark committed, so what lost tasks leave behind is
never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import stored, text_chunks, text_or_empty, word_hashes, worker_memo
from saleslens.operators.ranks import BUCKET, running_totals

#: Id after each document, ids in a frame at most, bytes of text in a file, on average.
END, FRAME_IDS, FILE_BYTES = 0, 1 << 18, 64 << 20
#: Pieces of text that a worker remembers at most, about; bytes of pieces joined to one text, and texts of one call of the tokenizer.
MEMO, BLOCK, CALL = 1_000_000, 1 << 16, 10_000
# Magic numbers of skippable frames, of the seek table's frame and of its end; its flag for checksums.
_INDEX, _TABLE, _END_MAGIC, _CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("frames", "<u4"), ("ids", "<u8")])
FILES = "file string, number long, documents long, n_ids long, n_bytes long"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder, for tasks. Spark's names of stores are understood."""
    folder = re.sub(r"^s3[an]:", "s3:", folder)
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


# -- encoding -------------------------------------------------------------------------------------

def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def encoder(path: str) -> Encoder:
    """The encoder of this worker, with what it remembers; one at a time."""
    held = worker_memo("file_encoder")
    if path not in held:
        held.clear()
        held[path] = Encoder(path)
    return held[path]


def _cut_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes after which, and before which, a space may be cut at: not those that end or begin a white-space character."""
    after, before = np.ones(256, bool), np.ones(256, bool)
    for t in (after, before):
        t[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = False
    after[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    before[[0xC2, 0xE1, 0xE2, 0xE3]] = False
    return after, before


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of all texts. A piece begins at a single space between two other characters, where the
    pattern of a byte-level tokenizer cuts as well, so the pieces' ids in a row are the ids of the text."""
    after, before = _cut_tables()
    space = np.flatnonzero(data == 0x20)
    space = space[(space > 0) & (space < len(data) - 1)]
    space = space[after[data[space - 1]] & before[data[space + 1]]]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    return np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], space[~edge[space] & ~edge[space + 1]]]))


class Encoder:
    """Ids of texts as the library gives them. Each distinct piece is encoded once in a pass, and once for a while: a Python
    worker remembers pieces by hash until there are ``MEMO`` of them, about 40 MB, and begins anew."""

    def __init__(self, path: str) -> None:
        made = tokenizer(path)
        self._encode = made.encode_batch_fast
        #: Bytes of each token: those of a byte-level alphabet have a character for each byte.
        self._bytes = np.zeros(made.get_vocab_size(), np.int64)
        for token, i in made.get_vocab().items():
            self._bytes[i] = len(token)
        for i, token in made.get_added_tokens_decoder().items():
            self._bytes[i] = len(token.content.encode())
        self._forget()

    def _forget(self) -> None:
        self._known, self._first, self._count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids, self._used = np.zeros(1 << 16, "<u4"), 0

    def _of_blocks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number for pieces that may be joined to longer texts; where a piece ends follows from the bytes of
        the tokens. None if the tokens' bytes are not those of the pieces (a tokenizer that changes the text)."""
        sizes = ends - starts
        upto = np.cumsum(sizes)
        joined = data[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1])].tobytes()
        cut = np.unique(np.append(np.searchsorted(upto, np.arange(BLOCK, upto[-1], BLOCK)), len(upto) - 1))
        edges = [0, *upto[cut].tolist()]
        blocks = [joined[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        ids = np.concatenate([np.array(x.ids, "<u4") for x in self._encode(blocks, add_special_tokens=False)])
        token_ends = np.cumsum(self._bytes[ids])
        last = np.searchsorted(token_ends, upto)
        if len(token_ends) == 0 or token_ends[-1] != upto[-1] or (token_ends[last] != upto).any():
            return None
        return ids, np.diff(last + 1, prepend=0)

    def _of_each(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = data.tobytes()
        pieces = [whole[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [x.ids for lo in range(0, len(pieces), CALL) for x in self._encode(pieces[lo:lo + CALL], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        after, _ = _cut_tables()
        joins = (data[starts] == 0x20) & after[data[ends - 1]] & (ends - starts > 1)
        for some, ways in ((joins, (self._of_blocks, self._of_each)), (~joins, (self._of_each,))):
            if not some.any():
                continue
            ids, count = next(x for way in ways if (x := way(data, starts[some], ends[some])) is not None)
            upto = self._used + len(ids)
            if upto > len(self._ids):
                self._ids = np.concatenate([self._ids[:self._used], np.zeros(2 * upto - self._used, "<u4")])
            self._ids[self._used:upto] = ids
            at = np.searchsorted(self._known, hashes[some])
            self._known, self._count = np.insert(self._known, at, hashes[some]), np.insert(self._count, at, count)
            self._first = np.insert(self._first, at, self._used + np.cumsum(count) - count)
            self._used = upto

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a column, and the end id after them."""
        for _, _, data, offsets in text_chunks(texts):
            starts = cuts(data, offsets)
            ends = np.append(starts[1:], len(data)).astype(np.int64)
            hashes, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            if len(self._known) > MEMO:
                self._forget()
            new = ~np.isin(hashes, self._known, assume_unique=True)
            if new.any():
                self._learn(hashes[new], data, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self._known, hashes)[which]
            counts = self._count[at]
            upto = np.concatenate(([0], np.cumsum(counts)))
            out = self._ids[np.repeat(self._first[at] - upto[:-1], counts) + np.arange(upto[-1])]
            bounds = upto[np.searchsorted(starts, offsets)].tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield np.append(out[a:b], np.uint32(END))


# -- the format ---------------------------------------------------------------------------------

class Writer:
    """Appends documents to an open stream and ends it with index and seek table."""

    def __init__(self, out, level: int = 3, frame_ids: int = FRAME_IDS) -> None:
        import zstandard

        self._out, self._most = out, frame_ids
        self._pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self._entries, self._documents = bytearray(), bytearray()
        self.documents = self.ids = self.bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        frames = 0
        for lo in range(0, max(len(ids), 1), self._most):
            plain = ids[lo:lo + self._most].astype("<u4", copy=False).tobytes()
            packed = self._pack(plain)
            self._out.write(packed)
            self.bytes += len(packed)
            self._entries += struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
            frames += 1
        self._documents += struct.pack("<qBIQ", doc_id or 0, doc_id is not None, frames, len(ids))
        self.documents += 1
        self.ids += len(ids)

    def close(self) -> None:
        index = self._pack(bytes(self._documents))
        frames = len(self._entries) // _ENTRY.itemsize
        tail = struct.pack("<II", _INDEX, len(index)) + index
        tail += struct.pack("<II", _TABLE, len(self._entries) + 9) + self._entries + struct.pack("<IBI", frames, _CHECKSUMS, _END_MAGIC)
        self._out.write(tail)
        self.bytes += len(tail)


@dataclass
class Reader:
    """The tables of a file, and its documents on request. ``source`` is a random-access file."""

    source: object

    def __post_init__(self) -> None:
        import zstandard

        size = self.source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _END_MAGIC or flags != _CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        begin = size - 9 - frames * _ENTRY.itemsize
        self.frames = np.frombuffer(self._at(begin, frames * _ENTRY.itemsize), _ENTRY)
        self.offsets = np.concatenate(([0], np.cumsum(self.frames["packed"], dtype=np.int64)))
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != _INDEX:
            raise ValueError("no index of documents before the seek table")
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.documents = np.frombuffer(self._unpack(self._at(at + 8, length)), _DOCUMENT)
        self.first = np.concatenate(([0], np.cumsum(self.documents["frames"], dtype=np.int64)))
        self.starts = np.concatenate(([0], np.cumsum(self.documents["ids"], dtype=np.int64)))

    def _at(self, offset: int, length: int) -> bytes:
        return self.source.read_at(length, offset)

    def doc_id(self, i: int) -> int | None:
        return int(self.documents["doc_id"][i]) if self.documents["has_id"][i] else None

    def parts(self, i: int) -> Iterator[bytes]:
        """The plain bytes of document ``i``, frame by frame; nothing else of the file is fetched. Damage is an error."""
        import xxhash

        for k in range(int(self.first[i]), int(self.first[i + 1])):
            plain = self._unpack(self._at(int(self.offsets[k]), int(self.frames["packed"][k])))
            if len(plain) != self.frames["plain"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames["check"][k]:
                raise ValueError(f"frame {k} is damaged")
            yield plain

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(i)), "<u4")


# -- Spark jobs ---------------------------------------------------------------------------------

def write(docs: DataFrame, tokenizer_path: str, folder: str, file_bytes: int = FILE_BYTES, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode all texts and write them to ``folder``; returns the table of files, one row each, numbered in the order of ids.

    Documents are dealt by ranges of doc_id. Rows without an id come last; rows with the same id follow each
    other in the order of a hash of their text, and may be spread over several files. Null texts are
    empty and consist of the end id. Strings of special tokens in a text are handled as the library
    does by default.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, writer, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder(tokenizer_path)(batch.column(1)), strict=True):
                if writer is None:
                    store, path = filesystem(folder)
                    store.create_dir(path, recursive=True)
                    name = f"ids-{number:07d}-{uuid.uuid4().hex}.zst"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    writer = Writer(out, frame_ids=frame_ids)
                writer.add(doc_id, found)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([number], pa.int64()), pa.array([writer.documents], pa.int64()),
                                   pa.array([writer.ids], pa.int64()), pa.array([writer.bytes], pa.int64())],
                                  names=["file", "number", "documents", "n_ids", "n_bytes"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("n")]
    placed = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()}).repartitionByRange(
        files, *order).sortWithinPartitions(*order)
    return stored(placed.select("doc_id", "text").mapInArrow(run, FILES))


def _placed(files: DataFrame) -> DataFrame:
    """The files with ``upto``, the ids up to their end, spread for reading."""
    run = running_totals(files.withColumn(BUCKET, F.shiftright("number", 10)), {"upto": "n_ids"}, [F.col("number")])
    spark = files.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), files.count())
    return run.select("file", "number", (F.col("upto") - F.col("n_ids")).alias("before")).repartition(n, "number")


def _of_files(folder: str, rows_of):
    """A task function that opens each file of its rows and gives what ``rows_of`` makes of reader, name and ids before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, path = filesystem(folder)
                with store.open_input_file(f"{path}/{name}") as source:
                    yield from rows_of(Reader(source), name, before)
    return run


def _ids_column(documents: np.ndarray) -> pa.Array:
    return pa.array(documents["doc_id"], pa.int64(), mask=documents["has_id"] == 0)


def index(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, file, place in it, of all documents, from the tables at the ends of the files alone."""
    def rows(reader: Reader, name: str, before: int) -> Iterator[pa.RecordBatch]:
        n = len(reader.documents)
        yield pa.record_batch([_ids_column(reader.documents), pa.array(before + reader.starts[:-1]), pa.array(reader.documents["ids"].astype(np.int64)),
                               pa.array([name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int64))],
                              names=["doc_id", "start", "n_tokens", "file", "place"])

    return _placed(files).mapInArrow(_of_files(folder, rows), "doc_id long, start long, n_tokens long, file string, place long")


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """doc_id, ids of the documents in ``wanted``, rows of ``index``; only their frames are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, reader = None, None, None
        for batch in batches:
            for name, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != opened:
                    if source is not None:
                        source.close()
                    store, path = filesystem(folder)
                    source = store.open_input_file(f"{path}/{name}")
                    opened, reader = name, Reader(source)
                yield pa.record_batch([pa.array([reader.doc_id(place)], pa.int64()), pa.array([reader.ids(place).astype(np.int32)], pa.list_(pa.int32()))],
                                      names=["doc_id", "ids"])
        if source is not None:
            source.close()

    return wanted.select("file", "place").repartition("file").sortWithinPartitions("file", "place").mapInArrow(run, "doc_id long, ids array<int>")


def digests(files: DataFrame, folder: str, rows_per_batch: int = 10_000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back frame by frame."""
    def rows(reader: Reader, name: str, before: int) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(reader.documents), rows_per_batch):
            some = reader.documents[lo:lo + rows_per_batch]
            crcs, sizes = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            for i in range(len(some)):
                crc = 0
                for part in reader.parts(lo + i):
                    crc = zlib.crc32(part, crc)
                    sizes[i] += len(part) // 4
                crcs[i] = crc
            if (sizes != some["ids"].astype(np.int64)).any():
                raise ValueError(f"{name}: the index and the frames disagree")
            yield pa.record_batch([_ids_column(some), pa.array(before + reader.starts[lo:lo + len(some)]), pa.array(sizes), pa.array(crcs)],
                                  names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(files).mapInArrow(_of_files(folder, rows), "doc_id long, start long, n_tokens long, ids_crc32 long")
