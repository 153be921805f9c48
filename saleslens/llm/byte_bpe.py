"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

``encode``, ``decode`` and ``digests`` cut texts by Spark's regular expressions and fold each distinct
word of a worker once, in array steps. ``encode_native`` is the same as folds of Spark's higher-order
functions, without Python in the tasks; it takes several times the CPU time (see the README).

In the native form a word begins as the ids of its single bytes and
``aggregate`` folds the ranked merges over them: each step joins the adjacent pair of lowest rank,
looked up in a literal map from pairs to merged ids. Frequent words are folded once, into a second literal map
of bounded size; every other word is folded where it occurs. Decoding looks the piece of each id up
in an array and concatenates the pieces.

Both maps are session variables, which a plan takes in as literals. A map is an array of small maps,
found by a hash of the key, because Spark searches a map from its start.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm.common import stored, text_or_empty, worker_memo

#: Rows of the word map: the bound of what is held in every task besides the ranks.
FREQUENT = 65_536
#: Documents whose words are counted to choose the map; it decides about speed only.
CHOSEN_FROM = 10_000
_NONE = 2_147_483_647


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """Rank of each piece, from lines of a base64 piece and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


def ranks_of(path: str) -> dict[bytes, int]:
    return parse_ranks(Path(path).read_bytes())


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern for Java: white space as Unicode has it, also inside negated classes."""
    space = r"\t\n\x0B\f\r\x1C-\x20\x85\xA0  -     　"
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(space if inside else f"[{space}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{space}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bucketed(rows: DataFrame, key: str, value: str, buckets: int) -> DataFrame:
    """One row with an array of maps; key k lies in the map numbered pmod(hash(k), buckets)."""
    kept = rows.select(F.pmod(F.hash(key), F.lit(buckets)).alias("b"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("e"))
    spare = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(None).cast(kept.schema["e"].dataType).alias("e"))
    maps = kept.union(spare).groupBy("b").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return maps.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.map_entries("m").alias("m")))), lambda x: F.map_from_entries(x["m"])).alias("maps"))


def variable(df: DataFrame) -> Column:
    """The one value of ``df`` as a session variable, which plans take in as a literal."""
    spark, name = df.sparkSession, f"bpe_{uuid.uuid4().hex}"
    kind = df.schema[0].dataType.simpleString()
    view = f"{name}_value"
    df.createOrReplaceTempView(view)
    spark.sql(f"DECLARE VARIABLE {name} {kind}")
    spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {view})")
    spark.catalog.dropTempView(view)
    return F.expr(f"session.{name}")


class Literal:
    """A bucketed map as a literal."""

    def __init__(self, rows: DataFrame, key: str, value: str, buckets: int) -> None:
        self.buckets = buckets
        self.column = variable(stored(bucketed(rows, key, value, buckets)))

    def get(self, key: Column) -> Column:
        return F.element_at(self.column, F.pmod(F.hash(key), F.lit(self.buckets)) + 1)[key]


def symbol(i: int) -> str:
    """The character that stands for an id: characters sort as the ids do, and none is a surrogate."""
    code = i + 1024
    return chr(code if code < 0xD800 else code + 0x800)


def id_of(character: Column) -> Column:
    code = F.ascii(character)
    return F.when(code < 0xD800, code - 1024).otherwise(code - 1024 - 0x800)


class BytePairEncoder:
    """A sequence of ids is a text with one character for each id (``symbol``)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        ranks = ranks_of(path)
        self.pattern = java_pattern(pattern)
        pairs = [(symbol(ranks[piece[:i]]) + symbol(ranks[piece[i:]]), symbol(rank)) for piece, rank in ranks.items()
                 for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks]
        self.pairs = Literal(spark.createDataFrame(pairs, "pair string, merged string"), "pair", "merged", 65536)
        whole = [(piece.decode(), symbol(rank)) for piece, rank in ranks.items() if _is_text(piece)]
        self.whole = Literal(spark.createDataFrame(whole, "piece string, id string"), "piece", "id", 16384)
        by_id = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            by_id[rank] = piece.hex()
        self.pieces = variable(spark.createDataFrame([(by_id,)], "pieces array<string>"))
        self.digits = variable(spark.createDataFrame([([str(i) for i in range(len(by_id))],)], "digits array<string>"))
        single = {f"{b:02X}": symbol(ranks[bytes([b])]) for b in range(256)}
        self.bytes = variable(spark.createDataFrame([([single[f"{b:02X}"] for b in range(256)],)], "bytes array<string>"))
        self.frequent: Literal | None = None

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def merged(self, word: Column) -> Column:
        """Ids of a word after all merges.

        A step replaces the adjacent pair whose merge has the lowest rank, wherever it stands; that
        is the order of one merge at a time, as pairs with the new piece rank behind it. A leading
        blank marks a word without further merges.
        """
        digits = F.hex(F.encode(word, "UTF-8"))
        start = F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.element_at(
            self.bytes, F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1)), "")

        def found(ids: Column) -> Column:
            """The best merge: its result and then the pair; null if there is none."""
            return F.array_min(F.transform(F.sequence(F.lit(1), F.length(ids) - 1), lambda i: let(
                F.substring(ids, i, F.lit(2)), lambda pair: F.concat(self.pairs.get(pair), pair))))

        def step(ids: Column, _: Column) -> Column:
            return F.when(ids.startswith(" ") | (F.length(ids) < 2), ids).otherwise(let(found(ids), lambda best: F.coalesce(
                F.replace(ids, F.substring(best, 2, 2), F.substring(best, 1, 1)), F.concat(F.lit(" "), ids))))

        return F.ltrim(F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step))

    def ids(self, word: Column) -> Column:
        """Ids of a word: its own id if it has one, else those of its merged pieces."""
        return F.coalesce(self.whole.get(word), self.merged(word))

    def learn_frequent(self, docs: DataFrame, most: int = FREQUENT, chosen_from: int = CHOSEN_FROM) -> None:
        """Fold the most frequent words once. Which words they are changes the speed, never the ids."""
        some = docs.select("text").sample(min(1.0, chosen_from / max(1, docs.count())), seed=1)
        counts = stored(some.select(F.explode(self.words(text_or_empty())).alias("word")).groupBy("word").count())
        steps = counts.groupBy("count").agg(F.count("*").alias("words")).orderBy(F.desc("count")).limit(4096).collect()
        least, held = _NONE, 0
        for r in steps:
            if held + r.words > most:
                break
            held, least = held + r.words, r["count"]
        chosen = counts.filter(F.col("count") >= least).repartition(docs.sparkSession.sparkContext.defaultParallelism * 4)
        self.frequent = Literal(stored(chosen.select("word", self.ids(F.col("word")).alias("ids"))), "word", "ids", 131072)

    def encoded(self, text: Column) -> Column:
        """Ids of a text; an empty text has none."""
        def one(word: Column) -> Column:
            return self.ids(word) if self.frequent is None else F.coalesce(self.frequent.get(word), self.ids(word))

        return F.array_join(F.transform(self.words(text), one), "")

    def listed(self, ids: Column) -> Column:
        """Each id as an element of an array, in order."""
        return F.when(ids == "", F.array().cast("array<string>")).otherwise(F.split(ids, ""))

    def decimal(self, ids: Column) -> Column:
        """Ids as numbers joined by single spaces."""
        return F.array_join(F.transform(self.listed(ids), lambda c: F.element_at(self.digits, id_of(c) + 1)), " ")

    def decoded(self, ids: Column) -> Column:
        """Bytes of the pieces of ids, one after the other."""
        return F.unhex(F.array_join(F.transform(self.listed(ids), lambda c: F.element_at(self.pieces, id_of(c) + 1)), ""))


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode_native(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (numbers joined by spaces), n_tokens, decoded (binary) of every row, in Spark functions only.

    Null texts count as empty and have no ids; repeated rows stay; an empty table gives none.
    """
    coder = BytePairEncoder(docs.sparkSession, path, pattern)
    coder.learn_frequent(docs)
    ids = F.col("ids")
    return (docs.select("doc_id", coder.encoded(text_or_empty()).alias("ids"))
            .select("doc_id", coder.decimal(ids).alias("ids"), F.length(ids).cast("long").alias("n_tokens"), coder.decoded(ids).alias("decoded")))


class Merges:
    """The same fold for many distinct words at once: one array step merges the best pair of every word."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        keys = sorted((ranks[p[:i]] << 32 | ranks[p[i:]], r) for p, r in ranks.items()
                      for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks)
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.values = np.array([r for _, r in keys], np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, r in ranks.items():
            self.pieces[r] = piece
        self.decimal = [b"%d" % i for i in range(len(self.pieces))]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def same_length(self, words: list[bytes]) -> list[bytes]:
        """Ids (32-bit integers as bytes) of words of one length."""
        ids = self.single[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        size = np.full(len(words), ids.shape[1])
        ranks = np.full(ids.shape, _NONE, np.int64)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(len(words)), np.arange(ids.shape[1])
        while True:
            at = ranks[rows].argmin(axis=1)
            best = ranks[rows, at]
            going = best < _NONE
            rows, at, best = rows[going], at[going], best[going]
            if not len(rows):
                break
            moved = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), ids.shape[1] - 1)
            ids[rows] = ids[rows[:, None], moved]
            ranks[rows] = ranks[rows[:, None], moved]
            ids[rows, at] = best
            size[rows] -= 1
            more = at + 1 < size[rows]
            ranks[rows, at] = _NONE
            ranks[rows[more], at[more]] = self.rank(best[more], ids[rows[more], at[more] + 1])
            more = at > 0
            ranks[rows[more], at[more] - 1] = self.rank(ids[rows[more], at[more] - 1], best[more])
        small = ids.astype(np.int32)
        return [small[i, :n].tobytes() for i, n in enumerate(size.tolist())]

    def long_word(self, word: bytes) -> bytes:
        """Ids of one long word, with a heap of the pairs and links between neighbours."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    merged = self.ranks.get(self.pieces[ids[a]] + self.pieces[ids[b]])
                    if merged is not None:
                        heapq.heappush(heap, (merged, a, ids[a], ids[b]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def fold(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word: its own id if it has one, else those of its merged bytes."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                out[w] = np.int32(whole).tobytes()
            elif len(b) > 48:
                out[w] = self.long_word(b)
            else:
                by_length.setdefault(len(b), []).append((w, b))
        for group in by_length.values():
            for lo in range(0, len(group), 8192):
                part = group[lo:lo + 8192]
                out |= zip((w for w, _ in part), self.same_length([b for _, b in part]), strict=True)
        return out


#: Words that a worker remembers in each of two generations; bounds its memory only.
REMEMBERED = 250_000


def _with_ids(ranks_file: bytes, finish, names: list[str]):
    """A function of Arrow batches (doc_id, words); ``finish`` makes the columns from the ids of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_memo("byte_bpe")
        key = hashlib.sha256(ranks_file).digest()
        if key not in held:
            held[key] = [Merges(parse_ranks(ranks_file)), {}, {}]
        state = held[key]
        merges = state[0]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                lists = part.column(1)
                coded = lists.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                missing = []
                for w in words:
                    if w not in state[1]:
                        if w in state[2]:
                            state[1][w] = state[2][w]
                        else:
                            missing.append(w)
                state[1].update(merges.fold(missing))
                blobs = [state[1][w] for w in words]
                if len(state[1]) > REMEMBERED:
                    state[1], state[2] = {}, state[1]
                ids = np.frombuffer(b"".join(blobs), np.int32)
                size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
                start = np.cumsum(size) - size
                at = coded.indices.to_numpy()
                count = size[at]
                total = np.concatenate(([0], np.cumsum(count)))
                flat = ids[np.repeat(start[at] - total[:-1], count) + np.arange(total[-1])]
                edges = total[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
                columns = finish(merges, [flat[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)])
                yield pa.record_batch([part.column(0), *columns], names=["doc_id", *names])
    return run


def _ids(merges: Merges, texts: list[list[int]]) -> list[pa.Array]:
    return [pa.array(texts, pa.list_(pa.int32()))]


def _digests(merges: Merges, texts: list[list[int]]) -> list[pa.Array]:
    number, piece = merges.decimal.__getitem__, merges.pieces.__getitem__
    return [pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(b" ".join(map(number, x))).hexdigest() for x in texts]),
            pa.array([hashlib.sha256(b"".join(map(piece, x))).hexdigest() for x in texts])]


def _mapped(docs: DataFrame, path: str, pattern: str, finish, names: list[str], kinds: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = docs.select("doc_id", F.regexp_extract_all(text_or_empty(), F.lit(java_pattern(pattern)), F.lit(0)).alias("words"))
    return words.mapInArrow(_with_ids(Path(path).read_bytes(), finish, names), f"doc_id {kind}, {kinds}")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array) of every row. Null texts count as empty and have no ids; repeated rows stay."""
    return _mapped(docs, path, pattern, _ids, ["ids"], "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (binary): the pieces of the ids, one after the other. Null ids count as none."""
    pieces = parse_ranks(Path(path).read_bytes())
    by_id = {r: p for p, r in pieces.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(map(by_id.__getitem__, x or [])) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text and decodes its ids in one pass."""
    return _mapped(docs, path, pattern, _digests, ["n_tokens", "ids_sha256", "decoded_sha256"],
                   "n_tokens long, ids_sha256 string, decoded_sha256 string")
