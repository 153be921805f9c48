"""Benchmark decontamination: a BM25 index of test items, asked with every training passage.

The test items are the indexed collection and each passage of a document is a query; all items whose
BM25 score reaches a share of their own best score are retrieved by block-max WAND. A retrieved item
is verified by the overlap of word sequences with its first part (the question) and its last part
(the answer).

The index is sent to the tasks in shards of about ``SHARD_WORDS`` words of test items; a larger
benchmark takes more passes over the documents. Its statistics are those of the whole benchmark,
however it is cut. Most passages can't reach any threshold: common words add too little, and the sums of
the rare ones show it in array steps before the index is asked.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import letter_table, lower_ascii, stored, text_chunks, text_or_empty, word_bounds, word_hashes

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, words in an overlap, and share of an item's word sequences.
SHARE, GRAM, OVERLAP = 0.5, 6, 0.5
#: Words of test items in one shard of the index; items per block of a posting list; longest piece of an item.
SHARD_WORDS, BLOCK, PIECE = 2_000_000, 16, 128


def words_of(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, lower case, without punctuation."""
    out: list[np.ndarray] = []
    for lo, hi, data, offsets in text_chunks(pa.array(texts, pa.string())):
        low = lower_ascii(data)
        starts, ends, firsts = word_bounds(low, offsets, letter_table())
        h = word_hashes(low, starts, ends)
        out += [h[firsts[i]:firsts[i + 1]] for i in range(hi - lo)]
    return out


def gram_set(words: list[int], n: int) -> set[tuple[int, ...]]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Index:
    """Postings of each term: (piece, score) in order of piece, with the greatest score of each block."""

    items: list[int]  # item of each piece
    words: list[list[int]]
    needed: list[float]
    postings: dict[int, tuple[list[int], list[float], list[float]]] = field(default_factory=dict)
    rare: dict[int, list[int]] = field(default_factory=dict)  # pieces of each term that a match can't do without
    common: list[float] = field(default_factory=list)  # what the other terms of each piece can add
    longest: int = 1

    def block_end(self, term: int, at: int) -> int:
        pieces = self.postings[term][0]
        return pieces[min(len(pieces), (at // BLOCK + 1) * BLOCK) - 1]


@dataclass
class Statistics:
    """What BM25 needs of all pieces of the benchmark, and of the terms of the pieces at hand."""

    pieces: int
    mean: float
    df: dict[int, int]


def pieces_of(item: int, h: np.ndarray) -> list[tuple[int, list[int]]]:
    """An item in pieces of equal length, ``PIECE`` words at most."""
    listed = h.tolist()
    parts = max(1, -(-len(listed) // PIECE))
    size = -(-len(listed) // parts) if listed else 0
    return [(item, listed[k * size:(k + 1) * size]) for k in range(parts) if listed]


def build(items: list[tuple[int, str]], share: float = SHARE) -> Index:
    """Index of the pieces of items that are the whole benchmark."""
    pieces = [x for (item, _), h in zip(items, words_of([t for _, t in items]), strict=True) for x in pieces_of(item, h)]
    df = Counter(t for _, w in pieces for t in set(w))
    return index_of(pieces, Statistics(len(pieces), sum(len(w) for _, w in pieces) / max(1, len(pieces)), df), share)


def index_of(pieces: list[tuple[int, list[int]]], known: Statistics, share: float = SHARE) -> Index:
    """Index of pieces; the score of a term in a piece is its whole BM25 weight."""
    counts = [Counter(w) for _, w in pieces]
    df, mean = known.df, known.mean
    out = Index([i for i, _ in pieces], [w for _, w in pieces], [])
    lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for p, c in enumerate(counts):
        length = len(pieces[p][1])
        own = 0.0
        for t, tf in c.items():
            idf = math.log(1 + (known.pieces - df[t] + 0.5) / (df[t] + 0.5))
            score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            lists[t].append((p, score))
            own += score
        out.needed.append(share * own)
    for t, posted in lists.items():
        scores = [s for _, s in posted]
        tops = [max(scores[i:i + BLOCK]) for i in range(0, len(scores), BLOCK)]
        out.postings[t] = ([p for p, _ in posted], scores, tops)
    out.common = [0.0] * len(pieces)
    for t in sorted(lists, key=lambda t: -df[t]):
        if any(out.common[p] + s > out.needed[p] / 2 for p, s in lists[t]):
            out.rare[t] = [p for p, _ in lists[t]]
        else:
            for p, s in lists[t]:
                out.common[p] += s
    out.longest = max((len(w) for _, w in pieces), default=1)
    return out


def retrieve(index: Index, terms: set[int]) -> list[tuple[int, float]]:
    """(piece, score) of all pieces whose score reaches what they need, by block-max WAND.

    Lists are kept in order of their current piece. The pivot is the first piece at which the summed
    bounds reach the least threshold; if the maxima of the blocks there can't, the lists skip to the
    end of the nearest block, otherwise the pivot is scored in full.
    """
    least = min(index.needed, default=math.inf)
    lists = [[index.postings[t], 0, max(index.postings[t][2]), t] for t in terms if t in index.postings]
    out = []
    while True:
        lists = [x for x in lists if x[1] < len(x[0][0])]
        lists.sort(key=lambda x: x[0][0][x[1]])
        total, pivot = 0.0, None
        for x in lists:
            total += x[2]
            if total >= least * (1 - 1e-12):
                pivot = x[0][0][x[1]]
                break
        if pivot is None:
            return out
        near = [x for x in lists if x[0][0][x[1]] <= pivot]
        for x in near:  # to the pivot or past it
            pieces = x[0][0]
            while x[1] < len(pieces) and pieces[x[1]] < pivot:
                x[1] += 1
        there = [x for x in near if x[1] < len(x[0][0])]
        tops = sum(x[0][2][x[1] // BLOCK] for x in there)
        if tops < least * (1 - 1e-12):
            ends = [index.block_end(x[3], x[1]) for x in there]
            others = [x[0][0][x[1]] for x in lists if x not in near]
            to = max(pivot, min([*ends, *(o - 1 for o in others)], default=pivot)) + 1
            for x in there:
                pieces = x[0][0]
                while x[1] < len(pieces) and pieces[x[1]] < to:
                    x[1] += 1
            continue
        score = 0.0
        for x in there:
            if x[0][0][x[1]] == pivot:
                score += x[0][1][x[1]]
                x[1] += 1
        if score >= index.needed[pivot] * (1 - 1e-12):
            out.append((pivot, score))


def overlaps(words: list[int], passage: list[int], gram: int = GRAM) -> tuple[float, float]:
    """Share of the word sequences of the first and of the last half of an item that the passage has."""
    half = len(words) // 2
    have_question, have_answer = words[:half] or words, words[half:]
    out = []
    for part in (have_question, have_answer):
        grams_ = gram_set(part, gram)
        n = min(gram, len(part))
        have = gram_set(passage, n) if len(passage) >= n else set()
        out.append(len(grams_ & have) / max(1, len(grams_)))
    return out[0], out[1]


def indexes(benchmark: DataFrame, most: int = SHARD_WORDS) -> Iterator[Index]:
    """The index in shards of about ``most`` words, dealt by a hash of the pieces; one is built at a time.

    Pieces, the number of pieces of each term, and the mean length are those of the whole benchmark, counted
    once by Spark, so a score does not depend on the shard it comes from.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for i, h in zip(batch.column(0).to_pylist(), words_of(batch.column(1).to_pylist()), strict=True) for x in pieces_of(i, h)]
            listed = pa.array([np.array(w, np.uint64).view(np.int64).tolist() for _, w in found], pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), listed], names=["item", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("i"), text_or_empty().alias("t")).filter("i is not null").distinct()
    pieces = stored(items.mapInArrow(run, "item long, words array<long>"))
    total = pieces.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("w")).first()
    terms = stored(pieces.select("item", F.explode(F.array_distinct("words")).alias("t")).groupBy("t").agg(F.count("*").alias("df")))
    n = max(1, -(-total.w // most))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
    for k in range(n):
        own = dealt.filter(F.col("shard") == k).select("item", "words")
        used = terms if n == 1 else terms.join(own.select(F.explode("words").alias("t")).distinct(), "t", "left_semi")
        df = {int(np.int64(r.t).view(np.uint64)): r.df for r in used.collect()}  # terms of one shard
        rows = sorted((r.item, np.array(r.words, np.int64).view(np.uint64).tolist()) for r in own.collect())  # words of one shard
        yield index_of(rows, Statistics(total.n, total.w / max(1, total.n), df))


def finder(index: Index, gram: int = GRAM, overlap: float = OVERLAP):
    """A function from the bytes and offsets of texts to what is found: (text, item) to score and overlaps of the best verified passage.

    Few passages reach the index: those whose rare words leave some item in reach, which is summed in array steps. What
    the other words can add is bounded, so nothing that could be retrieved is left out.
    """
    terms = np.array(sorted(index.rare), np.uint64)
    sizes = np.array([len(index.rare[t]) for t in terms.tolist()], np.int64)
    begins = np.cumsum(sizes) - sizes
    pieces = np.array([p for t in terms.tolist() for p in index.rare[t]], np.int64)
    scores = np.array([dict(zip(*index.postings[t][:2], strict=True))[p] for t in terms.tolist() for p in index.rare[t]])
    least = np.array(index.needed) - np.array(index.common)
    step = index.longest
    separator = letter_table()

    def candidates(h: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and last word of the passages whose rare words leave some item in reach.

        A passage is two neighbouring stretches of ``step`` words, so each piece lies whole in one.
        """
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        per = np.maximum(1, -(-np.diff(firsts) // step))
        first = np.cumsum(per) - per
        at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
        hit = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
        stretch = first[text[hit]] + (hit - firsts[text[hit]]) // step
        own = np.unique(stretch * max(1, len(terms)) + at[hit])
        stretch, term = own // max(1, len(terms)), own % max(1, len(terms))
        n = sizes[term]
        of = np.repeat(begins[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(stretch, n) * max(1, len(least)) + pieces[of]
        order = np.argsort(key, kind="stable")
        key = key[order]
        if not len(key):
            return key, key, key
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total, key = np.add.reduceat(scores[of][order], new), key[new]
        stretch, piece = key // len(least), key % len(least)
        owner = np.searchsorted(first, stretch, "right") - 1
        chosen = []
        for shift in (0, 1):  # the stretch with the next one, and with the one before
            other = key + (len(least) if shift == 0 else -len(least))
            where = np.minimum(np.searchsorted(key, other), len(key) - 1)
            both = total + np.where(key[where] == other, total[where], 0.0)
            good = both >= least[piece] - 1e-9
            chosen.append(np.maximum(stretch[good] - shift, first[owner[good]]))
        begin = np.unique(np.concatenate(chosen))
        owner = np.searchsorted(first, begin, "right") - 1
        start = firsts[owner] + (begin - first[owner]) * step
        return owner, start, np.minimum(start + 2 * step, firsts[owner + 1])

    def found_in(data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        low = lower_ascii(data)
        starts, ends, firsts = word_bounds(low, offsets, separator)
        h = word_hashes(low, starts, ends)
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for text, begin, end in zip(*(x.tolist() for x in candidates(h, firsts)), strict=True):
            passage = h[begin:end].tolist()
            for piece, score in retrieve(index, set(passage)):
                q, a = overlaps(index.words[piece], passage, gram)
                if max(q, a) >= overlap:
                    key = (text, index.items[piece])
                    found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (score, q, a))
        return found

    return found_in


def matches_in(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the best verified passage of each document and item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found_in = finder(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                found = found_in(data, offsets)
                if found:
                    listed = sorted(found)
                    values = [found[k] for k in listed]
                    yield pa.record_batch(
                        [ids.take(pa.array([lo + r for r, _ in listed])), pa.array([i for _, i in listed], pa.int64()),
                         *(pa.array([v[j] for v in values], pa.float64()) for j in range(3))],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")


def matches(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each document and test item found in it: doc_id, item_id, score, question_overlap, answer_overlap.

    Null texts count as empty, which match nothing; items without id are left out; repeated items and
    rows give one row for each distinct pair. An empty table on either side gives none.
    """
    found = [matches_in(docs, index) for index in indexes(benchmark, shard_words)]
    if len(found) > 1:
        found = [stored(x) for x in found]
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(
        *(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def without_test_items(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows in whose text no test item is found, with all columns. Each row is judged by its own text, whatever its id."""
    place = docs.columns.index("text")

    def without(rows: DataFrame, index: Index) -> DataFrame:
        found_in = finder(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in text_chunks(batch.column(place).cast(pa.string())):
                    clean[[lo + text for text, _ in found_in(data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    return reduce(without, indexes(benchmark, shard_words), docs)
