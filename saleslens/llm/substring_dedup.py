"""Removal of repeated passages with repeated-phrase automata.

A passage of ``WINDOW`` words that also starts earlier in the corpus goes, except for its first
occurrence. The steps:

1. Anchors. In every window of words the phrase of ``PHRASE`` words with the least hash is its
   anchor, so equal windows have equal anchors and a few windows in a row share one. Anchors that
   occur once are dropped: their windows can't repeat.
2. Confirmation. The stretch of words that an anchor's windows cover is a segment. Equal segments
   are grouped, the first occurrence of each is kept in mind, and where different segments have the
   same anchor, their windows are compared one by one.
3. Automata. Documents are dealt to blocks of bounded size. Each block compiles the repeated
   segments that occur in it into an Aho-Corasick automaton of its own, over numbered words, and
   streams all its documents through it to locate every occurrence; those after the first go.

Positions are word numbers. Anchor and segment hashes are 64 bits each and count together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import (flat_texts, forget_others, grams, mixed, space_table, stored, text_chunks, text_or_empty,
                                  word_bounds, word_hashes)

WINDOW, PHRASE = 20, 8
#: Bytes of text in a block, on average; a block is what one automaton and one task hold at a time.
BLOCK_BYTES = 3_000_000
_ANCHOR, _SEGMENT, _WINDOW = 0x9FB21C651E98DF25 | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1


def place(start: np.ndarray, offset: np.ndarray, more: np.ndarray) -> np.ndarray:
    """First word of a segment, place of the anchor in it, and number of its windows less one, in one number that sorts by start."""
    return start << 8 | offset << 4 | more


def anchors(hashes: np.ndarray, firsts: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other: text, first window, anchor, last window of every segment, as word numbers over all texts."""
    wide = window - phrase + 1
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none
    order = grams(hashes, phrase, _ANCHOR)
    n = len(hashes) - window + 1
    least, at = order[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, wide):
        less = order[j:j + n] < least
        least[less] = order[j:j + n][less]
        at[less] = j
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[:n]
    inside = np.arange(n) + window <= firsts[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none
    chosen = starts + at[starts]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[starts[1:]] != text[starts[:-1]]))))
    last = np.append(new[1:], len(starts)) - 1
    return text[starts[new]], starts[new], chosen[new], starts[last]


def find_anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """h, doc_id, place of every segment."""
    separator = space_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                starts, ends, firsts = word_bounds(data, offsets, separator)
                hashes = word_hashes(data, starts, ends)
                text, a, p, b = anchors(hashes, firsts, window, phrase)
                h = grams(hashes, phrase, _ANCHOR)[p] if len(p) else np.zeros(0, np.uint64)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(ids[lo + text]), pa.array(place(a - firsts[text], p - a, b - a))],
                                      names=["h", "doc_id", "place"])

    return docs.mapInArrow(run, "h long, doc_id long, place long")


def describe(window: int):
    """For a block: (doc_id, text) and (doc_id, place, h) to the digest of each segment and of its windows."""
    separator = space_table()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        forget_others()
        data, offsets = flat_texts(left.column("text"))
        starts, ends, firsts = word_bounds(data, offsets, separator)
        hashes = word_hashes(data, starts, ends)
        ids = left.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        doc, where = right.column("doc_id").to_numpy(), right.column("place").to_numpy()
        row = order[np.searchsorted(ids[order], doc)] if len(doc) else np.zeros(0, np.int64)
        a = firsts[row] + (where >> 8)
        offset, more = where >> 4 & 15, where & 15
        windows = grams(hashes, window, _WINDOW)
        segment = np.zeros(len(a), np.uint64)
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(hashes * _powers_of(_SEGMENT, len(hashes)))))
        inverse = _powers_of(pow(_SEGMENT, -1, 1 << 64), len(hashes) + 1)
        if len(a):
            segment = mixed((prefix[a + window + more] - prefix[a]) * inverse[a] + (offset << 4 | more).astype(np.uint64))
        raw = windows.tobytes()
        listed = [raw[8 * x:8 * (x + m + 1)] for x, m in zip(a.tolist(), more.tolist(), strict=True)]
        return pa.table([right.column("h"), pa.array(segment.view(np.int64)), right.column("doc_id"), right.column("place"),
                         pa.array(listed, pa.binary())], names=["h", "seg", "doc_id", "place", "windows"])

    return run


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def locate(window: int, whole: bool):
    """For a block: compiles its patterns, streams its documents and gives what is left of each.

    Patterns are (doc_id, place) of an occurrence in the block, the first occurrence in the corpus
    (first_doc, first_place), and for first occurrences themselves the windows (as bits) that start
    earlier in another segment. ``alone`` marks first occurrences that a block holds no other of: their
    bits count, but there is nothing to look for.
    """
    import ahocorasick

    separator = space_table()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        forget_others()
        ids = left.column("doc_id").to_numpy()
        data, offsets = flat_texts(left.column("text"))
        starts, ends, firsts = word_bounds(data, offsets, separator)
        # Words are numbered by their hashes, all at once.
        coded = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1].tolist()
        order = np.argsort(ids, kind="stable")
        doc, where = right.column("doc_id").to_numpy(), right.column("place").to_numpy()
        at = firsts[order[np.searchsorted(ids[order], doc)]] + (where >> 8) if len(doc) else np.zeros(0, np.int64)
        gone = np.zeros(len(starts) + 1, np.int64)  # +1 where a removed stretch begins, -1 after it
        bits = right.column("bits").fill_null(0).to_numpy()
        for j in range(16):
            late = at[bits >> j & 1 == 1] + j
            np.add.at(gone, late, 1)
            np.add.at(gone, late + window, -1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        sought = np.flatnonzero(~right.column("alone").to_numpy())
        columns = (at[sought].tolist(), (window + (where[sought] & 15)).tolist(), right.column("first_doc").to_numpy()[sought].tolist(),
                   (right.column("first_place").to_numpy()[sought] >> 8).tolist())
        for a, n, first_doc, first in zip(*columns, strict=True):
            phrase = tuple(coded[a:a + n])
            mark = (first_doc, first, n)
            known = automaton.get(phrase, None)
            automaton.add_word(phrase, mark if known is None else min(known, mark))
        if len(automaton):
            automaton.make_automaton()
            edges = firsts.tolist()
            for i, own in enumerate(ids.tolist()):
                text = tuple(coded[edges[i]:edges[i + 1]])
                for end, (first_doc, first, n) in automaton.iter(text):
                    start = end - n + 1
                    if (own, start) > (first_doc, first):
                        gone[edges[i] + start] += 1
                        gone[edges[i] + start + n] -= 1
        stays = np.cumsum(gone)[:-1] == 0
        # What stays of all documents in a row, a space after each word.
        sizes = ends[stays] - starts[stays] + 1
        upto = np.cumsum(sizes)
        joined = np.append(data, np.uint8(0x20))[np.repeat(starts[stays] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        joined[upto - 1] = 0x20
        left_words = np.concatenate(([0], np.cumsum(stays)))[firsts]
        edge = np.concatenate(([0], upto))[left_words].tolist()
        raw = joined.tobytes()
        kept = [raw[a:max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        n, left_over = np.diff(firsts), np.diff(left_words)
        out = [left.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - left_over, pa.int64())]
        if whole:
            some, texts = (n - left_over).tolist(), left.column("text").to_pylist()
            kept_text = [k.decode() if removed else t for k, t, removed in zip(kept, texts, some, strict=True)]
            return pa.table([*out, pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
        return pa.table([*out, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeats(docs: DataFrame, blocks: int, window: int, phrase: int) -> DataFrame:
    """block, doc_id, place, first_doc, first_place, bits, alone: the patterns of each block."""
    spread = _block(F.col("doc_id"), blocks)
    found = stored(find_anchors(docs, window, phrase))
    often = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    several = stored(found.join(often, "h"))
    left = docs.withColumn("block", spread).groupBy("block")
    right = several.withColumn("block", spread).groupBy("block")
    segments = stored(left.cogroup(right).applyInArrow(describe(window), "h long, seg long, doc_id long, place long, windows binary"))
    firsts = stored(segments.groupBy("h", "seg").agg(F.min(F.struct("doc_id", "place", "windows")).alias("f"), F.count("*").alias("n"))
                    .select("h", "seg", "n", F.col("f.doc_id").alias("first_doc"), F.col("f.place").alias("first_place"), F.col("f.windows").alias("windows")))
    bits = earlier_windows(firsts)
    told = firsts.select("h", "seg", "n", "first_doc", "first_place").join(bits, ["h", "seg"], "left")
    where = segments.withColumn("block", spread).groupBy("block", "h", "seg").agg(F.min(F.struct("doc_id", "place")).alias("o"), F.count("*").alias("k"))
    first = (F.col("o.doc_id") == F.col("first_doc")) & (F.col("o.place") == F.col("first_place"))
    alone = first & (F.col("k") == 1)
    joined = where.join(told, ["h", "seg"]).filter("n > 1 or bits is not null").filter(~alone | F.col("bits").isNotNull())
    return joined.select("block", F.col("o.doc_id").alias("doc_id"), F.col("o.place").alias("place"), "first_doc", "first_place",
                         F.when(first, F.col("bits")).alias("bits"), alone.alias("alone"))


def earlier_windows(firsts: DataFrame) -> DataFrame:
    """h, seg, bits: which windows of a segment's first occurrence start earlier in another segment with the same anchor."""
    many = firsts.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h")
    offset = F.shiftright("first_place", 4).bitwiseAND(15)
    one = firsts.join(many, "h").select(
        "h", "seg", "first_doc", (F.shiftright("first_place", 8) + offset).alias("anchor"), offset.alias("offset"),
        F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("windows") / 8).cast("int") - 1), lambda i: F.substring(
            F.col("windows"), i * 8 + 1, F.lit(8)))).alias("j", "w")).withColumn("back", F.col("offset") - F.col("j"))
    least = one.groupBy("h", "back", "w").agg(F.min(F.struct("first_doc", "anchor")).alias("least"), F.count("*").alias("k")).filter("k > 1").drop("k")
    late = one.join(least, ["h", "back", "w"]).filter(F.col("least") < F.struct("first_doc", "anchor"))
    return late.groupBy("h", "seg").agg(F.sum(F.expr("shiftleft(1, j)")).cast("int").alias("bits"))


def _block(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


def remove_repeats(docs: DataFrame, texts: bool = False, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document: their SHA-256, or with ``texts`` the text itself.

    Kept words are joined by one space; with ``texts`` an untouched text stays as it is. Null and
    empty texts have no words. Rows with the same doc_id count as one document, whose text is the
    smallest of theirs; a row without doc_id has no place in the order and is left out. An empty
    table gives none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")
    sums = own.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"), F.approx_count_distinct("doc_id", 0.01).alias("d")).first()
    if sums.d < 0.97 * sums.n or own.groupBy("doc_id").count().filter("count > 1").head(1):
        own = stored(own.groupBy("doc_id").agg(F.min("text").alias("text")))
    blocks = max(1, -(-(sums.b or 0) // BLOCK_BYTES))
    patterns = stored(repeats(own, blocks, window, phrase))
    left = own.withColumn("block", _block(F.col("doc_id"), blocks)).groupBy("block")
    kind = "kept string" if texts else "kept_sha256 string"
    return left.cogroup(patterns.groupBy("block")).applyInArrow(locate(window, texts), f"doc_id long, n_words long, n_removed long, {kind}")
