"""Collocations against plain Python, whatever the sample proposes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleslens.llm import collocations as C

DOCS = "doc_id long, text string, lang string"


def plain_counts(rows):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    return counts, total


def plain(rows, least=30, most=2000):
    counts, total = plain_counts(rows)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and " " in p}
        kept = []
        for p, a in found.items():
            words = p.split(" ")
            cuts = []
            for k in range(1, len(words)):
                l, r = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((2000000 * a // (l + r), k, l, r))
            score, _, l, r = min(cuts)
            around = [q for q in found if len(q.split(" ")) > len(words) and f" {p} " in f" {q} "]
            if not any(100 * found[q] >= 80 * a for q in around):
                kept.append((-score, -a, p.encode(), p, l, r))
        for rank, (score, a, _, p, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p, -a, l, r, total[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["The", "of", "new", "York", "city", "été", "漢字", "x-y", "a", "B", "#1"] + [f"w{i}" for i in range(30)]
    out = []
    for i in range(1500):
        text = []
        for _ in range(rng.randint(0, 40)):
            text.append(rng.choice(words[:rng.choice([4, 11, 41])]))
            text.append(rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", " \x0b", "; "]))
            if rng.random() < 0.1:
                text.append("New York City hall ")
        out.append((i, "".join(text), rng.choice(["en", "de", None, "und", ""])))
    hot = "once upon a time there was a hot passage of many words. " * 2
    out += [(1000 + i, hot, "en") for i in range(150)] + [(None, hot, "fr")] * 40
    out += [(2000, None, "en"), (2001, "", None), (2002, " \t\n.,", "es"), (2003, "a " * 20000, "long"), (2003, "a " * 20000, "long")]
    return out


def test_against_plain_python(spark, rows):
    want = plain(rows)
    assert len(want) > 60
    for tasks, sample in ((1, 8), (6, 1)):
        assert got(C.collocations(spark.createDataFrame(rows, DOCS).repartition(tasks), sample=sample)) == want
    names = ["n", "a", "h", "phrase", "rank", "score", "size", "words", "k", "range"]
    clashing = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("x") for n in names})
    assert got(C.collocations(clashing)) == want


@pytest.mark.parametrize("least, bits", [(30, 27), (3, 27), (5, 19)])
def test_failures_of_the_border_are_counted_in_further_passes(spark, rows, least, bits):
    """Whether the sample proposes nothing, little or all, the counts are those of all documents."""
    docs = spark.createDataFrame(rows, DOCS).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).cache()
    counts, total = plain_counts(rows)
    want = {(lang, p, f) for lang, c in counts.items() for p, f in c.items() if f >= least}
    for sample, passes in ((docs.limit(0), {2, 3, 4, 5}), (docs.limit(60), {1, 2, 3, 4, 5}), (docs, {1})):
        found, n = C.frequent(docs, sample, least, 2, bits)
        parts = found.collect()
        assert {(r["lang"], r["phrase"], r["f"]) for r in parts if r["size"]} == want and n in passes
        assert {r["lang"]: r["f"] for r in parts if r["size"] == 0 and r["f"]} == {k: v for k, v in total.items() if v}


def test_sums_kept_in_tasks_are_handed_over(spark, rows, monkeypatch):
    for name, value in (("KEPT", 50), ("KEPT_TEXTS", 40), ("ROWS", 7), ("PASS_BYTES", 2000)):
        monkeypatch.setattr(C, name, value)
    assert C._Sums.__init__.__defaults__ == (1 << 20,)
    monkeypatch.setattr(C._Sums.__init__, "__defaults__", (50,))
    assert got(C.collocations(spark.createDataFrame(rows, DOCS).repartition(3))) == plain(rows)


def test_scores_beyond_64_bits(spark):
    big = 10 ** 16
    found = spark.createDataFrame([("x", 1, "p", big), ("x", 1, "q", 3 * big + 1), ("x", 2, "p q", big - 7)], "lang string, size int, phrase string, f long")
    assert C.scored(found).first()["score"] == 2000000 * (big - 7) // (4 * big + 1)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_packed_sums():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        c = rng.integers(1, 1 << 40, len(h))
        again = C._unpacked(C._packed(h, c))
        assert (again[0] == h).all() and (again[1] == c).all()


def test_sums_of_hashes():
    rng = np.random.default_rng(0)
    sums, want = C._Sums(1000), Counter()
    out = Counter()
    for _ in range(50):
        h, c = np.unique(rng.integers(0, 3000, 200).astype(np.uint64), return_counts=True)
        want.update(dict(zip(h.tolist(), c.tolist())))
        for found in [sums.add(h, c)]:
            if found is not None:
                out.update(dict(zip(*(x.tolist() for x in found))))
    out.update(dict(zip(*(x.tolist() for x in sums.all()))))
    assert out == want
