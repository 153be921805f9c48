"""Collocated phrases by Toivonen's method: a sample proposes, full passes count.

1. A sample of the documents is mined with a lowered threshold. Its frequent phrases are the proposal.
2. A pass over all documents counts every phrase whose two parts (all but its last word, all but its
   first) are proposed: that is the proposal together with its negative border, and all words.
3. Frequent phrases that were not proposed are failures of the border: phrases they are parts of have
   not been counted. A further pass counts what the frequent phrases found so far newly allow, and so
   on until a pass finds nothing new. Phrases have four words at most, so there are four such passes at most.
4. A last pass counts the frequent phrases by their text.

The passes before the last count hashes of 64 bits, so what they call frequent holds every phrase that
is; the last one settles the counts by text, and the threshold is applied to those
(a task takes equal hashes for equal phrases in it). Tasks hold the phrases
that may grow as a bitmap over hashes, of ``MOST_BITS`` bits at most whatever the data; phrases that share a
bit with one of them are counted as well, which costs time only. Everything after counting is joins on phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saleslens.llm.common import chunks, flat_texts, lower_ascii, mixed, stored, text_or_empty, word_bounds, word_hashes

LONGEST, LEAST, MOST_PER_LANG = 4, 30, 2000
#: One document of so many is in the sample; a phrase is proposed from so many occurrences there.
SAMPLE, SAMPLE_LEAST = 8, 2
#: Bits of the bitmap of a proposal at most (16 MB), bits of one piece of it, and bytes of text in an array pass.
MOST_BITS, PIECE_BITS, PASS_BYTES = 27, 19, 1 << 20
#: Bytes of text whose phrases make a range of hashes, counts of hashes and of phrases that a task keeps, and rows that it hands over at once.
RANGE_BYTES, KEPT, KEPT_TEXTS, ROWS = 8 << 20, 1 << 20, 1 << 20, 50_000
#: A longer phrase with so many parts of a phrase's occurrences, in fifths, makes it redundant.
REDUNDANT_FIFTHS = 4
_RADIX = np.uint64(0x9FB21C651E98DF25)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that end a piece, and bytes that end a word."""
    breaks = np.zeros(256, bool)
    breaks[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    spaces = breaks.copy()
    spaces[[0x20, 0x09]] = True
    return breaks, spaces


class Words:
    """The words of some texts: where each begins and ends, whether the next one goes on the same piece, hashes salted by language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, salts: np.ndarray) -> None:
        breaks, spaces = _tables()
        self.data = lower_ascii(data)
        self.starts, self.ends, first = word_bounds(self.data, offsets, spaces)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.lang = langs[self.text]
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(breaks[self.data], out=before[1:])
        n = len(self.starts)
        self.goes_on = np.zeros(n, bool)
        if n > 1:
            self.goes_on[:-1] = (before[self.starts[1:]] == before[self.ends[:-1]]) & (self.text[1:] == self.text[:-1])
        self.hashes = mixed(word_hashes(self.data, self.starts, self.ends) + salts[self.lang]) if n else np.zeros(0, np.uint64)

    def levels(self, keep=None, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, hashes) of the phrases, from single words up.

        ``keep`` tells from length and hashes which phrases may be parts of longer ones; without it all may.
        """
        at, h = np.arange(len(self.hashes)), self.hashes
        yield 1, at, h
        for n in range(2, longest + 1):
            if keep is not None:
                kept = keep(n - 1, h)
                at, h = at[kept], h[kept]
            # The part without the first word begins one word later and must be kept too.
            pair = np.flatnonzero((np.diff(at) == 1) & self.goes_on[at[:-1] + n - 2]) if n == 2 else np.flatnonzero(np.diff(at) == 1)
            last = at[pair] + n - 1
            at, h = at[pair], mixed(h[pair] * _RADIX + self.hashes[last])
            yield n, at, h

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words from the words ``at``, joined by single spaces."""
        if not hasattr(self, "_joined"):
            sizes = self.ends - self.starts + 1
            self._ends = np.cumsum(sizes)
            source = np.repeat(self.starts - (self._ends - sizes), sizes) + np.arange(int(self._ends[-1]) if len(sizes) else 0)
            self._joined = np.append(self.data, np.uint8(0x20))[source]
            self._joined[self._ends - 1] = 0x20
        begin = self._ends[at] - (self.ends[at] - self.starts[at]) - 1
        sizes = self._ends[at + n - 1] - 1 - begin
        offsets = np.zeros(len(at) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        source = np.repeat(begin - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self._joined[source].tobytes())])


def _of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    """Words of bounded numbers of texts (columns lang, text), and the names of their languages."""
    def made(held: list[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
        import xxhash

        both = pa.Table.from_batches(held).combine_chunks()
        coded = both.column(0).combine_chunks().dictionary_encode()
        salts = np.array([xxhash.xxh64_intdigest(x.encode(), 13) for x in coded.dictionary.to_pylist()], np.uint64)
        langs = coded.indices.to_numpy(zero_copy_only=False)
        data, offsets = flat_texts(both.column(1))
        for lo, hi in chunks(np.diff(offsets), PASS_BYTES):
            yield Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], langs[lo:hi], salts), coded.dictionary

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PASS_BYTES:
            yield from made(held)
            held, size = [], 0
    if held:
        yield from made(held)


# -- the proposal ----------------------------------------------------------------------------------

def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the leading bits of a hash name it."""
    slot = h >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(proposed: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """One bit for each hash ``h`` (long), 16 or more for each phrase up to ``most_bits`` in all. Made in pieces by tasks."""
    bits = min(most_bits, max(PIECE_BITS, (16 * proposed.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            piece = (slot >> np.uint64(PIECE_BITS)).astype(np.int64)
            for p in np.unique(piece).tolist():
                own = (slot[piece == p] & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64)
                np.bitwise_or.at(made.setdefault(p, np.zeros(1 << (PIECE_BITS - 3), np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        if made:
            yield pa.record_batch([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["piece", "bytes"])

    parts = proposed.select("h", F.shiftrightunsigned("h", 64 - bits + PIECE_BITS).alias("piece") if bits > PIECE_BITS else F.lit(0).alias("piece"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.repartition(1 << (bits - PIECE_BITS), "piece").select("h").mapInArrow(run, "piece long, bytes binary").collect():
        part = np.frombuffer(row["bytes"], np.uint8)  # pieces of 64 KB, 256 at most
        at = row["piece"] * len(part)
        out[at:at + len(part)] |= part
    return out


class _Sums:
    """Counts of hashes, added up until there are too many to keep."""

    def __init__(self, most: int = KEPT) -> None:
        self._most, self._held, self._size = most, [], 0

    def add(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Sums to hand over, if it is time for that."""
        self._held.append((h, c))
        self._size += len(h)
        if self._size < self._most:
            return None
        h, c = self.all()
        if 2 * len(h) > self._most:
            self._held, self._size = [], 0
            return h, c
        self._held, self._size = [(h, c)], len(h)
        return None

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and their counts."""
        if not self._held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, c = (np.concatenate(x) for x in zip(*self._held, strict=True))
        order = np.argsort(h)
        h, c = h[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(c, first) if len(first) else c


def _packed(h: np.ndarray, c: np.ndarray) -> bytes:
    """Hashes in order and their counts, as steps, byte by byte of all of them, so that what is zero packs away."""
    import zstandard

    steps = np.stack([np.diff(h, prepend=np.uint64(0)), c.astype(np.uint64)])
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(2, 8, -1).transpose(0, 2, 1)).view(np.uint64)[..., 0]
    return np.cumsum(steps[0]), steps[1].astype(np.int64)


def frequent_hashes(texts: DataFrame, phrases_of, least: int, n_bytes: int) -> DataFrame:
    """Hashes ``h`` (long) that occur ``least`` times or more in what ``phrases_of`` gives for some words.

    Tasks add counts up and send them on as arrays, one for each of the ranges that hashes are cut into; the
    receivers add up a range at a time. The number of ranges follows the size of the texts.
    """
    bits = max(6, (n_bytes // RANGE_BYTES).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            at = (h >> np.uint64(64 - bits)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True))
            return pa.record_batch([pa.array(at[first]), pa.array([_packed(h[a:b], c[a:b]) for a, b in bounds], pa.binary())], names=["range", "sums"])

        sums = _Sums()
        for words, _ in _of(batches):
            for h in phrases_of(words):
                found, c = np.unique(h, return_counts=True)
                ready = sums.add(found, c)
                if ready is not None:
                    yield packed(*ready)
        h, c = sums.all()
        if len(h):
            yield packed(h, c)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(sums: list) -> pa.RecordBatch:
            held = _Sums(1 << 62)
            held._held = sums
            h, c = held.all()
            return pa.record_batch([pa.array(h[c >= least].view(np.int64))], names=["h"])

        now, sums, size = None, [], 0
        for batch in batches:
            for place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != now and sums:
                    yield done(sums)
                    sums, size = [], 0
                now = place
                sums.append(_unpacked(data))
                size += len(sums[-1][0])
                if size > 4 * KEPT:  # a range keeps one count for each of its hashes, however many tasks sent them
                    held = _Sums(1 << 62)
                    held._held = sums
                    sums = [held.all()]
                    size = len(sums[0][0])
        if sums:
            yield done(sums)

    sent = texts.mapInArrow(send, "range long, sums binary")
    return stored(sent.repartition("range").sortWithinPartitions("range").mapInArrow(receive, "h long"))


def proposal(texts: DataFrame, n_bytes: int, least: int = SAMPLE_LEAST, most_bits: int = MOST_BITS) -> DataFrame:
    """Hashes ``h`` of the phrases with ``least`` occurrences or more in the texts given; long ones are looked for among those whose pairs have as many."""
    short = frequent_hashes(texts, lambda words: (h for _, _, h in words.levels(None, 2)), least, n_bytes)
    pairs = texts.sparkSession.sparkContext.broadcast(bitmap_of(short, most_bits))

    def longer(words: Words) -> Iterator[np.ndarray]:
        return (h for n, _, h in words.levels(lambda n, h: _holds(pairs.value, h) if n <= 2 else np.ones(len(h), bool)) if n > 2)

    return short.union(frequent_hashes(texts, longer, least, n_bytes))


# -- counts ----------------------------------------------------------------------------------------

def _tagged(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes with the length of their phrases in the last two bits. The leading bits name the place in a bitmap."""
    return h & ~np.uint64(3) | np.uint64(size - 1)


def _growing(found: DataFrame) -> DataFrame:
    """The phrases that may be parts of longer ones."""
    return found.filter(F.col("h").bitwiseAND(F.lit(3)) < LONGEST - 1)


def count_pass(texts: DataFrame, allowed: np.ndarray, new: np.ndarray | None, least: int, n_bytes: int) -> DataFrame:
    """Tagged hashes ``h`` of the frequent phrases whose parts are all allowed: with ``new``, of those with a part in it, without it also all words."""
    spark = texts.sparkSession
    shared = [None if b is None else spark.sparkContext.broadcast(b) for b in (allowed, new)]

    def phrases(words: Words) -> Iterator[np.ndarray]:
        fresh = np.zeros(len(words.hashes) + 1, bool)

        def keep(n: int, h: np.ndarray) -> np.ndarray:
            return _holds(shared[0].value, h)

        for n, at, h in words.levels(keep):
            own = h
            if shared[1] is not None:
                own = h[fresh[at] | fresh[at + 1]] if n > 1 else h[:0]
                fresh = np.zeros(len(words.hashes) + 1, bool)
                fresh[at] = _holds(shared[1].value, h)
            yield _tagged(own, n)

    out = frequent_hashes(texts, phrases, least, n_bytes)
    for b in shared:
        if b is not None:
            b.unpersist()
    return out


def _not_in(bitmap: np.ndarray, found: DataFrame) -> DataFrame:
    """The phrases without a bit."""
    shared = found.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_holds(shared.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return found.select("h").mapInArrow(run, "h long")


class _Texts:
    """Counts of phrases by hash, with the text of each where it was met first."""

    def __init__(self) -> None:
        self._known, self._counts, self._place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._parts: list[pa.Table] = []
        self.size = 0

    def add(self, words: Words, langs: pa.Array, n: int, at: np.ndarray, h: np.ndarray) -> None:
        h, first, c = np.unique(_tagged(h, n), return_index=True, return_counts=True)
        spot = np.searchsorted(self._known, h)
        old = np.zeros(len(h), bool)
        inside = spot < len(self._known)
        old[inside] = self._known[spot[inside]] == h[inside]
        self._counts[spot[old]] += c[old]
        some = at[first][~old]
        if len(some):
            self._parts.append(pa.table([langs.take(pa.array(words.lang[some])).cast(pa.string()), pa.array(np.full(len(some), n, np.int32)), words.phrases(some, n)],
                                        names=["lang", "size", "phrase"]))
            self._place = np.insert(self._place, spot[~old], self.size + np.arange(len(some)))
            self._known, self._counts = np.insert(self._known, spot[~old], h[~old]), np.insert(self._counts, spot[~old], c[~old])
            self.size += len(some)

    def packed(self, bits: int) -> pa.RecordBatch:
        """A row for each range of hashes; what the phrases of a range are, is a table of its own."""
        whole = pa.concat_tables(self._parts).take(pa.array(self._place)).append_column("c", pa.array(self._counts))
        at = (self._known >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))).tolist()
        tables = [_sent(whole.slice(a, b - a)) for a, b in zip(first, [*first[1:], len(at)], strict=True)]
        return pa.record_batch([pa.array(at[first]), pa.array(tables, pa.binary())], names=["range", "counts"])


def _sent(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def count_texts(texts: DataFrame, bitmap: np.ndarray, least: int, n_bytes: int) -> DataFrame:
    """lang, size, phrase, f of the frequent phrases in the bitmap, and the number of words of each language as a phrase of size 0.

    Sums go to the receivers in ranges of hashes, as in ``frequent_hashes``, but are added up by text.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    bits = max(6, (n_bytes // RANGE_BYTES).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = _Texts(), {}
        for words, langs in _of(batches):
            for lang, c in zip(langs.to_pylist(), np.bincount(words.lang, minlength=len(langs)).tolist(), strict=True):
                total[lang] = total.get(lang, 0) + c
            for n, at, h in words.levels(lambda _, h: _holds(shared.value, h)):
                kept = _holds(shared.value, h)
                held.add(words, langs, n, at[kept], h[kept])
            if held.size > KEPT_TEXTS:
                yield held.packed(bits)
                held = _Texts()
        if held.size:
            yield held.packed(bits)
        if total:
            sums = pa.table([pa.array(list(total), pa.string()), pa.array([0] * len(total), pa.int32()), pa.array([""] * len(total), pa.string()),
                             pa.array(list(total.values()), pa.int64())], names=["lang", "size", "phrase", "c"])
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([_sent(sums)], pa.binary())], names=["range", "counts"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(["lang", "size", "phrase"]).aggregate([("c", "sum")]).rename_columns(["lang", "size", "phrase", "c"])

        def done(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            out = summed(tables).rename_columns(["lang", "size", "phrase", "f"])
            frequent = np.logical_or(out.column("f").to_numpy() >= least, out.column("size").to_numpy() == 0)
            yield from out.filter(pa.array(frequent)).to_batches(max_chunksize=ROWS)

        now, tables, size = None, [], 0
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if place != now and tables:
                    yield from done(tables)
                    tables, size = [], 0
                now = place
                tables.append(pa.ipc.open_stream(data.as_buffer()).read_all())
                size += tables[-1].num_rows
                if size > KEPT:
                    tables = [summed(tables)]
                    size = tables[0].num_rows
        if tables:
            yield from done(tables)

    sent = texts.mapInArrow(send, "range long, counts binary")
    return stored(sent.repartition("range").sortWithinPartitions("range").mapInArrow(receive, "lang string, size int, phrase string, f long"))


def frequent(texts: DataFrame, sample: DataFrame, least: int = LEAST, sample_least: int = SAMPLE_LEAST,
             most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """lang, size, phrase, f of all phrases of up to four words with ``least`` occurrences, and the number of passes until closed.

    Both tables have the columns lang and text; ``sample`` decides the number of passes, never the result.
    After the first pass the new phrases are the frequent ones without a bit in the proposal, after a further
    pass all that were not found before it.
    """
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    proposed = bitmap_of(proposal(sample, n_bytes, sample_least, most_bits), most_bits)
    found = count_pass(texts, proposed, None, least, n_bytes)
    new, passes = stored(_not_in(proposed, _growing(found))), 1
    while new.head(1):
        more = count_pass(texts, bitmap_of(_growing(found), most_bits), bitmap_of(new, most_bits), least, n_bytes)
        new = stored(_growing(more).join(found, "h", "left_anti"))
        found, passes = stored(found.union(more).distinct()), passes + 1
    return count_texts(texts, bitmap_of(found, most_bits), least, n_bytes), passes


# -- scores ------------------------------------------------------------------------------------

def _part(start: str, length: str) -> str:
    return f"array_join(slice(words, {start}, {length}), ' ')"


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, k, l, r, score of each phrase of two words or more, by its lowest-scoring cut, the first one on ties."""
    split = found.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = split.select("lang", "phrase", "size", "a", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "size", "a", "k", F.expr(_part("1", "k")).alias("first"), F.expr(_part("k + 1", "size - k")).alias("rest"))
    counts = found.filter(f"size between 1 and {LONGEST - 1}")
    sides = (
        cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    )
    # Decimals, as products may pass 64 bits; the score itself is at most a million.
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    return sides.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "size", "a", "cut.k", "cut.l", "cut.r", "cut.score")


def redundant(found: DataFrame) -> DataFrame:
    """lang, phrase, most: the count of the most frequent longer phrase around each phrase of two words or more."""
    split = found.filter("size >= 3").select("lang", "size", "f", F.split("phrase", " ").alias("words"))
    inner = F.expr(f"""flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> {_part('i', 'n')})))""")
    return split.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_PER_LANG, sample: int = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, best first.

    Null texts are empty; a null lang is ``und``. Documents count once for each row, repeated rows too.
    Languages without a frequent phrase, and an empty table, give no rows. Other columns are not looked at.
    """
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(sample)) == 0
    columns = [F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text")]
    found, _ = frequent(docs.select(*columns), docs.filter(drawn).select(*columns), least)
    words = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    kept = scored(found).join(redundant(found), ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (F.col("most") * 5 < F.col("a") * REDUNDANT_FIFTHS))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
worded AS (SELECT lang, row_number() OVER () AS id, [x FOR x IN string_split_regex(piece, '[\\x20\\x09]+') IF x <> ''] AS words FROM pieces),
words AS (SELECT lang, id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM worded),
runs AS (SELECT lang, w, lead(w, 1) OVER p AS x, lead(w, 2) OVER p AS y, lead(w, 3) OVER p AS z FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT lang, 1 AS size, w AS phrase FROM runs UNION ALL SELECT lang, 2, w || ' ' || x FROM runs WHERE x IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || x || ' ' || y FROM runs WHERE y IS NOT NULL
  UNION ALL SELECT lang, 4, w || ' ' || x || ' ' || y || ' ' || z FROM runs WHERE z IS NOT NULL),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
split AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size >= 2),
cuts AS (SELECT s.lang, s.phrase, a, k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score
  FROM split s, range(1, 4) c(k) JOIN counts l ON l.lang = s.lang AND l.phrase = array_to_string(s.words[1:k], ' ')
  JOIN counts r ON r.lang = s.lang AND r.phrase = array_to_string(s.words[k + 1:], ' ') WHERE k < s.size),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
inner_phrases AS (SELECT lang, array_to_string(words[i:i + n - 1], ' ') AS phrase, a AS f FROM split, range(2, 4) x(n), range(1, 4) y(i)
  WHERE n < size AND i + n - 1 <= size),
around AS (SELECT lang, phrase, max(f) AS most FROM inner_phrases GROUP BY ALL),
ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN around USING (lang, phrase) WHERE place = 1 AND (most IS NULL OR 100 * most < 80 * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
