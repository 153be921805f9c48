"""The filter audit against plain Python, and on odd input."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from saleslens.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    good, toxic = ({i for i, *rest in labels if i is not None and rest[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, _, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": i is not None and i > least[text]}
        rows.append((source or "", fails, i in good, i in toxic))
    out = defaultdict(lambda: [0] * 7)
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(5):
                out[part, order, step + 1]  # zeros included
    for part, fails, is_good, is_toxic in rows:
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order):
                cell = out[part, order, step + 1]
                removed = fails[f] and not gone
                cell[0] += not gone and not fails[f]
                cell[1] += removed
                cell[2] += fails[f] and gone
                cell[3] += fails[f] and sum(fails.values()) == 1
                cell[4] += removed and is_good
                cell[5] += removed and is_toxic
                gone = gone or fails[f]
    total = defaultdict(int)
    for (part, order, step), cell in out.items():
        total[part, order[step - 1]] += cell[1]
    return {k: (*cell[:6], total[k[0], k[1][k[2] - 1]]) for k, cell in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "x#y", "DELTA", "été", "漢字", "a|b"] + [f"w{i}" for i in range(400)]
    docs = []
    for i in range(120):
        pool = rng.choice([words, words[8:], words[:3], words[8:40]])
        docs.append((i, rng.choice(["  ", " ", "\n"]).join(rng.choice(pool) for _ in range(rng.choice([5, 150, 199, 200, 201, 260]))), "en", f"s{i % 3}"))
    docs += [(200, docs[4][1], "en", "s9"), (201, docs[4][1], "en", "s0"), (3, docs[7][1], None, None), (3, docs[7][1], None, ""), (None, docs[4][1], "en", "s1"),
             (None, "only here", "en", "s1"), (None, None, "en", "s1"), (300, None, "en", "s1"), (301, "", "en", "s1"), (302, " \t\x0b\n", "en", "s1"),
             (303, "w " * 30000, "en", "s2"), (304, docs[5][1], "en", "s2"), (304, docs[5][1], "en", "s2")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 310, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (304, None, 1)]
    return docs, labels


def test_against_plain_python(spark, tables):
    docs, labels = tables
    want = plain(docs, labels)
    for tasks in (1, 7):
        d, x = spark.createDataFrame(docs, DOCS).repartition(tasks), spark.createDataFrame(labels, LABELS)
        assert got(filter_audit.audit(d, x)) == want


def test_clashing_columns_and_repeated_rows(spark, tables):
    docs, labels = tables
    names = ["part", "mask", "n", "good", "toxic", "quality", "digest", "__id", "__n", "step", "kept"]
    d = spark.createDataFrame(docs + docs[:9], DOCS).withColumns({n: F.lit("x") for n in names})
    x = spark.createDataFrame(labels, LABELS).withColumns({n: F.lit(7) for n in ("part", "mask", "__id", "text")})
    assert got(filter_audit.audit(d, x)) == plain(docs + docs[:9], labels)


def test_empty_tables(spark, tables):
    docs, labels = tables
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, spark.createDataFrame(labels, LABELS)).count() == 0
    assert got(filter_audit.audit(spark.createDataFrame(docs[:5], DOCS), no_labels)) == plain(docs[:5], [])


def test_a_text_that_a_third_of_the_rows_share(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 3 < 2, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
                                    F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"))
    plain_rows = [tuple(r) for r in rows.collect()]
    assert got(filter_audit.audit(rows, spark.createDataFrame([], LABELS))) == plain(plain_rows, [])
