"""Token files: equal to the library, read by any zstandard reader, read by document, damaged files."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from saleslens.llm import token_files as T
from saleslens.session import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string"
ODD = [None, "", " ", "  a  b", "a  b c", "é è  x y　 z", "<|endoftext|> it's  a\n b '\x1c x y", "漢字 仮名 🎉 x", "x" * 5000, " lead", "trail ",
       "\u0085 b \u0085", "a  b", "\t\tx\r\n y", "don't  stop  ", "word " * 40000, "１２３ 456"]


def library(texts):
    made = Tokenizer.from_file(PATH)
    return [np.array(made.encode(t or "", add_special_tokens=False).ids + [T.END], "<u4") for t in texts]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = ODD + [" ".join("".join(rng.choice("abcdeé,.'") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    ids = list(range(3, 3 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_encoder_against_the_library(rows):
    texts = [t for _, t in rows] * 2
    rng = random.Random(1)
    texts += ["".join(rng.choice(" \t\n  \u0085ab'é漢.#<|") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for most in (10, T.MEMO):
        T.MEMO, before = most, T.MEMO
        made = T.Encoder(PATH)
        got = [x for lo in range(0, len(texts), 50) for x in made(pa.array(texts[lo:lo + 50]))]
        T.MEMO = before
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, library(texts), strict=True))


def test_files_against_the_library(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).withColumns({c: F.lit("x") for c in ("h", "n", "file", "start", "n_tokens")}).repartition(5)
    folder = scratch(spark)
    files = T.write(docs, PATH, folder, file_bytes=5000, frame_ids=700)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.digests(files, folder).collect()}
    ordered = sorted(rows)
    start, want = 0, {}
    for (i, _), ids in zip(ordered, library([t for _, t in ordered])):
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    numbers = [r["number"] for r in files.collect()]
    assert len(set(numbers)) == len(numbers) > 3 and files.agg(F.sum("documents")).first()[0] == len(rows)
    # Only the documents asked for are read, whatever file they are in.
    wanted = T.index(files, folder).where("doc_id % 7 = 0")
    read = {r["doc_id"]: r["ids"] for r in T.fetch(wanted, folder).collect()}
    of = dict(rows)
    assert set(read) == {i for i in of if i % 7 == 0}
    assert all(ids == library([of[i]])[0].tolist() for i, ids in read.items())


def test_missing_and_repeated_ids(spark):
    rows = [(None, "z"), (5, "b"), (5, "a"), (5, "a"), (None, None), (-2, "minus"), (2 ** 62, "big")] + [(9, f"t{k}") for k in range(300)]
    folder = scratch(spark)
    got = T.digests(T.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, folder, file_bytes=100), folder).collect()
    in_order = sorted(got, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in in_order]
    assert ids[0] == -2 and ids[-2:] == [None, None] and ids[-3] == 2 ** 62 and len(got) == len(rows)
    assert sorted(x for x in ids if x is not None) == [x for x in ids if x is not None]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(in_order, in_order[1:]))
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(x.tobytes()) for x in library([t for _, t in rows]))


def test_empty_table(spark):
    folder = scratch(spark)
    files = T.write(spark.createDataFrame([], DOCS), PATH, folder)
    assert files.count() == 0 and T.digests(files, folder).count() == 0 and T.index(files, folder).count() == 0


class Counting(io.BytesIO):
    """A random-access file that counts what is read of it."""

    def __init__(self, data):
        super().__init__(data)
        self.read_bytes = 0

    def size(self):
        return len(self.getbuffer())

    def read_at(self, length, offset):
        self.read_bytes += length
        return bytes(self.getbuffer()[offset:offset + length])


@pytest.fixture
def written():
    out, rng = io.BytesIO(), np.random.default_rng(0)
    documents = [(i if i % 5 else None, rng.integers(0, 50000, n).astype("<u4")) for i, n in enumerate([1, 40, 3000, 1, 9999, 2, 1000, 1001])]
    writer = T.Writer(out, frame_ids=1000)
    for i, ids in documents:
        writer.add(i, ids)
    writer.close()
    return out.getvalue(), documents


def test_any_reader_sees_all_ids_in_a_row(written):
    data, documents = written
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(ids.tobytes() for _, ids in documents)


def test_a_document_costs_its_own_frames(written):
    data, documents = written
    source = Counting(data)
    reader = T.Reader(source)
    tables = source.read_bytes
    for i, (doc_id, ids) in enumerate(documents):
        source.read_bytes = 0
        assert (reader.ids(i) == ids).all() and reader.doc_id(i) == doc_id
        assert source.read_bytes <= 4 * len(ids) + 60 * (1 + len(ids) // 1000)
    assert tables < 900


def test_damage_is_an_error(written):
    data, documents = written
    reader = T.Reader(Counting(data))
    at = int(reader.offsets[3]) + 30
    broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]
    hurt = T.Reader(Counting(broken))
    assert (hurt.ids(0) == documents[0][1]).all()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        hurt.ids(2)
    with pytest.raises(ValueError):
        T.Reader(Counting(data[:-1]))


def test_what_lost_tasks_leave_is_not_read(spark):
    folder = scratch(spark)
    files = T.write(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string"), PATH, folder)
    store, path = T.filesystem(folder)
    with store.open_output_stream(f"{path}/ids-0000000-lost.zst", compression=None) as out:
        out.write(b"half a file")
    assert T.digests(files, folder).count() == 2
