"""How filters interact: what each of them removes in every order they can be applied in.

All of it is DataFrame functions. A document is reduced to a mask with one bit for each filter it
fails, documents to counts per part and mask (32 cells for each part at most), and every cell is
folded over the literal array of all orders: an inner fold walks along one order and notes what
happens to the cell at each step. The cells of a part are added up element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import stored, text_or_empty

#: The filters, in the order of their bits, and every order to apply them in.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
#: Join keys that rows without an id are spread over.
SPREAD = 4096


def failures_of_text() -> Column:
    """Bits 0 to 3: short, few distinct words, many capitals, signs of markup or code."""
    bits = {
        0: F.col("__n") < LEAST_WORDS,
        1: 100 * F.col("__distinct") < LEAST_DISTINCT_PERCENT * F.col("__n"),
        2: 100 * F.col("__capitals") > MOST_CAPITALS_PERCENT * F.length("__text"),
        3: F.col("__text").rlike("[#$%&*|]"),
    }
    return sum((F.when(fails, 1 << bit).otherwise(0) for bit, fails in bits.items()), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """__id, __part, __digest of the text, __mask of the filters that look at the text alone, __good and __toxic, and __n rows that are alike in these.

    Several labels of an id count as one that says yes if any does. Rows without an id have none.
    """
    words = F.array_remove(F.split("__text", r"[\x20\x09-\x0D]+"), "")
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__part"),
                        text_or_empty().alias("__text"))
    masks = (
        texts.select("__id", "__part", "__text", words.alias("__words"))
        .select("__id", "__part", "__text", F.size("__words").cast("long").alias("__n"),
                F.size(F.array_distinct("__words")).cast("long").alias("__distinct"),
                F.length(F.regexp_replace("__text", "[^A-Z]+", "")).cast("long").alias("__capitals"))
        .select("__id", "__part", F.unhex(F.sha2("__text", 256)).alias("__digest"), failures_of_text().alias("__mask"))
        .withColumn("__spread", F.when(F.col("__id").isNull(), F.pmod(F.xxhash64("__digest"), F.lit(SPREAD))).otherwise(F.lit(0)))
    )
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("__good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("__toxic"),
    ).withColumn("__spread", F.lit(0).cast("long"))
    yes = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("__good", "__toxic")}
    return (
        masks.withColumn("__spread", F.col("__spread").cast("long")).join(known, ["__id", "__spread"], "left").withColumns(yes)
        .groupBy("__id", "__spread", "__part", "__digest", "__mask", "__good", "__toxic").agg(F.count("*").alias("__n"))
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all failures, n documents of them good and toxic ones.

    A text is a copy where a row with a smaller id has it too; rows without an id are never copies
    and never make others copies. Copies are counted per text, part and label before texts meet, so a
    text that a third of all rows share is a few rows by then.
    """
    first = F.min(F.when(F.col("__id").isNotNull(), F.struct("__id", "__n")))
    groups = stored(judged(docs, labels).groupBy("__digest", "__part", "__mask", "__good", "__toxic").agg(
        F.sum("__n").alias("__n"), F.sum(F.when(F.col("__id").isNull(), F.col("__n")).otherwise(0)).alias("__absent"),
        first.alias("__first")))
    least = groups.groupBy(F.col("__digest").alias("__d")).agg(F.min("__first.__id").alias("__least"))
    leads = F.when(F.col("__first.__id") == F.col("__least"), F.col("__first.__n")).otherwise(0)
    own = F.col("__absent") + leads
    two = F.array(F.struct(F.col("__mask").alias("mask"), own.alias("n")),
                  F.struct(F.col("__mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("__n") - own).alias("n")))
    return (
        groups.join(least, groups["__digest"] == least["__d"])
        .select("__part", "__good", "__toxic", F.explode(two).alias("__c")).filter("__c.n > 0")
        .groupBy(F.col("__part").alias("part"), F.col("__c.mask").alias("mask"))
        .agg(F.sum("__c.n").alias("n"), F.sum(F.when(F.col("__good"), F.col("__c.n")).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("__toxic"), F.col("__c.n")).otherwise(0)).alias("toxic"))
    )


def folded() -> Column:
    """For a cell, one struct for each order and step: the filter, and the cell's weight where it counts."""
    orders = "array(" + ", ".join("array(" + ", ".join(str(FILTERS.index(f)) for f in order) + ")" for order in ORDERS) + ")"
    kind = "array<struct<f:int, " + ", ".join(f"{c}:bigint" for c in COUNTS) + ">>"
    return F.expr(f"""
        flatten(transform({orders}, o -> aggregate(o,
          named_struct('alive', true, 'steps', cast(array() as {kind})),
          (s, f) -> named_struct(
            'alive', s.alive and getbit(mask, f) = 0,
            'steps', concat(s.steps, array(named_struct(
              'f', f,
              'kept', if(s.alive and getbit(mask, f) = 0, n, 0L),
              'removed', if(s.alive and getbit(mask, f) = 1, n, 0L),
              'redundant', if(not s.alive and getbit(mask, f) = 1, n, 0L),
              'unique_fails', if(mask = shiftleft(1, f), n, 0L),
              'good_lost', if(s.alive and getbit(mask, f) = 1, good, 0L),
              'toxic_lost', if(s.alive and getbit(mask, f) = 1, toxic, 0L))))),
          s -> s.steps)))""")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step.

    Null and empty texts are documents without words; a null source is the empty string. Repeated
    rows count each. An empty table has no parts and gives no rows. Other columns are not looked at.
    """
    added = ", ".join(f"'{c}', a.{c} + b.{c}" for c in COUNTS)
    sums = (
        cells(docs, labels).select("part", folded().alias("__steps"))
        .groupBy("part").agg(F.collect_list("__steps").alias("__cells"))  # 32 cells at most
        .select("part", F.expr(f"""aggregate(slice(__cells, 2, 31), __cells[0],
            (x, y) -> zip_with(x, y, (a, b) -> named_struct('f', a.f, {added})))""").alias("__steps"))
        .withColumn("__shapley", F.expr(
            f"transform(sequence(0, {len(FILTERS) - 1}), k -> aggregate(__steps, 0L, (t, x) -> t + if(x.f = k, x.removed, 0L)))"))
    )
    rows = sums.select("part", "__shapley", F.posexplode("__steps").alias("__at", "__s"))
    names = F.expr("array(" + ", ".join(f"'{o}'" for o in ORDERS) + ")")
    return rows.select(
        "part", names[F.floor(F.col("__at") / len(FILTERS)).cast("int")].alias("filter_order"),
        (F.col("__at") % len(FILTERS) + 1).cast("int").alias("step"), *[F.col(f"__s.{c}").alias(c) for c in COUNTS],
        F.col("__shapley")[F.col("__s.f")].alias("shapley"))


SQL = """
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
worded AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
fails AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
   regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, FALSE)] AS f
  FROM worded w LEFT JOIN known k ON w.doc_id = k.doc_id),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(substr(filter_order, step, 1)) - 64 AS own,
  [ascii(substr(filter_order, j, 1)) - 64 FOR j IN range(1, step)] AS before FROM orders, range(1, 6) r(step)),
met AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len([j FOR j IN before IF f[j]]) > 0 AS gone,
  len([x FOR x IN f IF x]) = 1 AS once FROM cells, steps),
summed AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept,
  coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
  coalesce(sum(n) FILTER (fails AND once), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM summed"""
