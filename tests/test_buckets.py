"""Stores in buckets and versions, the maintained roll-up, pages by position, the cube, keyed status."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.operators import buckets as B
from saleslens.operators import cube as CU
from saleslens.operators import dashboard as DB
from saleslens.operators import maintained as MT
from saleslens.operators import merge as M
from saleslens.operators import paging as PG
from saleslens.operators import transactions as X
from saleslens.streaming import status as ST

D = dt.date


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder, "rows").rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def stored(spark):
    return spark.createDataFrame([(f"u{i}", i / 100, False, None) for i in range(100)], S.PREDICTIONS)


def test_merge_writes_changed_buckets_only(spark, stored, tmp_path):
    store = B.create(stored, str(tmp_path), "user_id", 8)
    before = files(tmp_path)
    new = spark.createDataFrame([("u3", 0.9, True, dt.datetime(2024, 1, 1)), ("n1", 0.8, True, dt.datetime(2024, 1, 2))], S.PREDICTIONS)
    assert store.merge(new, M.upsert_predictions, "one") == 1
    assert rows(store.read()) == rows(M.upsert_predictions(stored, new))
    after = files(tmp_path)
    assert {f: t for f, t in after.items() if f in before} == before  # nothing written over
    touched = {r[0] for r in new.select(store.bucket()).collect()}
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in set(after) - set(before)} == touched
    held = {r["bucket"]: r["holds"] for r in store.manifest().collect()}
    assert {b for b, v in held.items() if v == 1} == touched
    assert rows(store.read(0)) == rows(stored)


def test_repeated_and_idle_batches_change_nothing(spark, stored, tmp_path):
    store = B.create(stored, str(tmp_path), "user_id", 8)
    new = spark.createDataFrame([("u3", 0.9, True, dt.datetime(2024, 1, 1))], S.PREDICTIONS)
    store.merge(new, M.upsert_predictions, "one")
    state, content = files(tmp_path), rows(store.read())
    assert store.merge(new.withColumn("probability", F.lit(0.1)), M.upsert_predictions, "one") == 1  # the name is known
    assert store.merge(new, M.upsert_predictions, "same rows under another name") == 2
    assert store.merge(new.limit(0), M.upsert_predictions, "nothing") == 2
    assert files(tmp_path) == state and rows(store.read()) == content and [v for v, _ in store.versions()] == [0, 1, 2]


def test_a_merge_writes_its_rows_once(spark, stored, tmp_path, monkeypatch):
    store = B.create(stored, str(tmp_path), "user_id", 4)
    written, plain = [], B.durable
    monkeypatch.setattr(B, "durable", lambda df: written.append(df.columns) or plain(df))
    new = stored.limit(30).withColumn("probability", F.lit(0.7))
    assert store.merge(new, M.upsert_predictions, "one") == 1
    assert written == [new.columns]  # the batch; what is stored goes to its place at once
    assert {r["holds"] for r in store.manifest().collect()} == {1} and store.read().count() == 100


def test_later_months_are_found_in_one_placement(spark):
    old = spark.createDataFrame([("a", D(2023, 1, 1), 1, 1, None), ("a", D(2023, 3, 1), 5, 1, 1), ("b", D(2023, 1, 1), 4, 2, None)], "user_id string, mes date, cents long, transacciones_mes long, anterior long")
    new = spark.createDataFrame([("a", D(2023, 2, 1), 3, 1)], "user_id string, mes date, cents long, transacciones_mes long")
    out = MT._later(old, new)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(out) == rows(spark.createDataFrame(
        [("a", D(2023, 1, 1), 1, 1, None), ("a", D(2023, 2, 1), 3, 1, 1), ("a", D(2023, 3, 1), 5, 1, 3), ("b", D(2023, 1, 1), 4, 2, None)], old.schema))


def test_failed_merge_leaves_the_version_before(spark, stored, tmp_path):
    store = B.create(stored, str(tmp_path), "user_id", 4)

    def fails(old, new):
        return old.withColumn("probability", F.raise_error(F.lit("no")).cast("double"))

    with pytest.raises(Exception, match="no"):
        store.merge(stored.limit(1), fails, "broken")
    assert rows(store.read()) == rows(stored) and store.latest() == 0
    with pytest.raises(ValueError, match="not to change"):
        store.merge(stored.limit(1), lambda old, new: stored, "too much")
    removed = store.merge(stored.where("user_id = 'u5'"), lambda old, new: old.join(new.select("user_id"), "user_id", "left_anti"), "remove")
    assert store.read(removed).count() == 99


def test_rows_without_a_key_are_refused(spark, stored, tmp_path):
    store = B.create(stored, str(tmp_path), "user_id", 4)
    with pytest.raises(ValueError, match="no key"):
        store.merge(stored.limit(2).unionByName(spark.createDataFrame([(None, 0.5, False, None)], S.PREDICTIONS)), M.upsert_predictions, "odd")
    assert store.latest() == 0 and rows(store.read()) == rows(stored)


def test_empty_store(spark, stored, tmp_path):
    store = B.create(stored.limit(0), str(tmp_path), "user_id", 4)
    assert store.read().count() == 0 and store.read().columns == stored.columns
    store.merge(stored, M.upsert_predictions, "all")
    assert rows(store.read()) == rows(stored)


# -- roll-up ---------------------------------------------------------------------------------------


def tx(spark, some):
    return spark.createDataFrame([(f"t{i}", u, d, a, c, None) for i, (u, d, a, c) in enumerate(some)], S.TRANSACTIONS)


FIRST = [("a", D(2023, 1, 5), 10.0, "food"), ("a", D(2023, 3, 5), 20.0, "food"), ("a", D(2023, 5, 1), 5.0, "travel"), ("b", D(2023, 2, 1), 7.0, "food"),
         ("c", None, 3.0, "food"), ("d", D(2023, 4, 1), None, "health")]
DELTAS = [[("a", D(2023, 2, 9), 40.0, "food"), ("e", D(2023, 1, 1), 1.0, "casino")], [("b", D(2023, 2, 2), 3.0, None), ("a", D(2022, 12, 1), 2.5, "food")],
          [("a", D(2023, 6, 1), 9.0, "food"), ("a", D(2023, 5, 2), 1.0, "food"), ("c", D(2023, 1, 1), 4.0, "food")]]


def test_base_and_deltas_equal_one_run(spark, tmp_path):
    everything = tx(spark, FIRST + [r for d in DELTAS for r in d])
    sums = MT.create_sums(tx(spark, FIRST), str(tmp_path / "sums"), 8)
    moves = MT.create_changes(MT.sums_of(tx(spark, FIRST)), str(tmp_path / "moves"), 8)
    for i, delta in enumerate(DELTAS):
        before = files(tmp_path / "moves")
        MT.add_transactions(sums, tx(spark, delta), f"d{i}")
        MT.add_to_changes(moves, tx(spark, delta), f"d{i}")
        written = {int(f.split("_bucket=")[1].split("/")[0]) for f in set(files(tmp_path / "moves")) - set(before)}
        assert written <= {r[0] for r in tx(spark, delta).select(moves.bucket()).collect()}
    whole = X.monthly_changes(X.monthly_rollup(everything)).select("user_id", "mes", "monto_mes", "transacciones_mes", "variacion_monto", "variacion_monto_pct")
    assert rows(MT.changes(moves)) == rows(whole)
    assert rows(sums.read()) == rows(MT.sums_of(everything))
    again = X.per_customer(X.by_month_and_category(X.monthly_by_category(everything)))
    assert rows(MT.customer_sums(sums)) == rows(again)


# -- pages -----------------------------------------------------------------------------------------


def test_pages_by_position(spark, tmp_path):
    clients = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("probability")).cache()
    ranked = PG.ranked_clients(clients, str(tmp_path), rows_per_range=300)
    assert ranked.total() == 5000 and len(ranked.ranges().collect()) > 10
    for page, size in ((1, 10), (7, 33), (137, 10), (500, 10), (501, 10), (3, 700), (1000, 5)):
        want = clients.orderBy(F.desc_nulls_first("probability"), "id").offset((page - 1) * size).limit(size).collect()
        assert ranked.page(page, size).collect() == want
        assert len(ranked.ranges_of(page, size)) <= (2 if size <= 100 else 5)
    plan = ranked.page(400, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"_range#\d+ = \d+\)\], PushedFilters: \[\]", plan)  # files of one range are read
    with pytest.raises(ValueError):
        ranked.page(0)
    assert PG.ranked_clients(clients.limit(0), str(tmp_path / "none")).page(1).count() == 0


def test_small_ranges_are_no_tasks_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PG, "ROWS_PER_RANGE", 2000)
    clients = spark.range(5000).select("id", (F.col("id") * 7919 % 5000 / 5000).alias("probability")).cache()
    pieces = []
    plain = PG.durable
    monkeypatch.setattr(PG, "durable", lambda df: pieces.append(df.rdd.getNumPartitions()) or plain(df))
    ranked = PG.ranked_clients(clients, str(tmp_path), rows_per_range=10)
    assert pieces == [3] and 500 <= ranked.ranges().count() <= 503
    want = clients.orderBy(F.desc_nulls_first("probability"), "id").offset(2490).limit(10).collect()
    assert ranked.page(250).collect() == want
    assert len({f.split("_range=")[1].split("/")[0] for f in ranked.page(250).inputFiles()}) <= 2


# -- cube ------------------------------------------------------------------------------------------


def test_every_pair_comes_from_a_small_view(spark, tmp_path):
    clients = spark.range(3000).select(
        "id", (F.col("id") % 40 + 18).cast("int").alias("age"), F.element_at(F.array(*map(F.lit, S.INCOME_RANGES)), (F.col("id") % 4 + 1).cast("int")).alias("income_range"),
        F.element_at(F.array(*map(F.lit, S.RISK_PROFILES)), (F.col("id") % 3 + 1).cast("int")).alias("risk_profile"), (F.col("id") % 7).cast("string").alias("occupation"),
        F.when(F.col("id") % 5 > 0, "s").alias("segment"), F.when(F.col("id") % 2 == 0, "pending").otherwise("contacted").alias("status"),
        F.when(F.col("id") % 11 > 0, F.rand(2)).alias("probability")).cache()
    cube = CU.build(clients, str(tmp_path))
    names = ["age", "income_range", "risk_profile", "occupation", "segment"]
    read, base = [], max(n for _, n, _ in cube.views)
    for x in names:
        for y in names:
            assert rows(cube.heatmap(x, y)) == rows(DB.heatmap(clients, x, y))
            read.append(cube.view_for([x, y])[1])
    assert sum(read) < 0.6 * base * len(read)
    for metric in ("count", "probability"):
        assert rows(cube.banded_heatmap("age", "status", metric)) == rows(DB.banded_heatmap(clients, "age", "status", metric))
    assert "range" not in cube.heatmap("age", "segment")._jdf.queryExecution().executedPlan().toString().lower()
    with pytest.raises(ValueError):
        cube.counts("nothing")
    assert CU.build(clients.limit(0), str(tmp_path / "none")).heatmap("age", "segment").count() == 0


def test_views_that_save_nothing_are_not_stored():
    sizes = {frozenset("abc"): 10, frozenset("ab"): 10, frozenset("ac"): 4, frozenset("bc"): 9}
    assert CU.chosen("abc", sizes, 5) == [frozenset("ac"), frozenset("bc")]


# -- keyed status ----------------------------------------------------------------------------------


def test_status_out_of_order_and_again(spark, tmp_path):
    clients = spark.createDataFrame([(i, "pending", None) for i in range(6)], "id long, status string, last_contact_date timestamp")

    def at(day):
        return dt.datetime(2024, 1, day)

    batches = [[(1, "contacted", at(5)), (1, "interested", at(3)), (2, "lost", at(4)), (3, "archived", at(9)), (9, "lost", at(1))],
               [(1, "converted", at(4)), (2, "contacted", at(6)), (2, "lost", at(4))],  # the first one is late
               [(1, "contacted", at(5)), (2, "contacted", at(6))],  # again
               [(4, "lost", at(2)), (4, "interested", at(2)), (None, "lost", at(2)), (5, "lost", None)]]
    store = B.create(clients, str(tmp_path / "clients"), "id", 4)
    given = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, ST.CHANGE).write.mode("append").parquet(str(tmp_path / "in"))
        ST.keep_status(spark.readStream.schema(ST.CHANGE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        part = spark.read.schema(ST.CHANGE).parquet(str(tmp_path / "out" / f"batch={i}"))
        given.append(sorted(r["client_id"] for r in part.collect()))
        ST.fold_into(spark, store, str(tmp_path / "out"), i)
        ST.fold_into(spark, store, str(tmp_path / "out"), i)
    assert given == [[1, 2, 9], [2], [], [4]]  # clients with something new, and no others
    everything = spark.createDataFrame([r for b in batches for r in b if r[0] is not None and r[2] is not None], ST.CHANGE)
    want = rows(M.apply_status_changes(clients, everything).clients)
    assert rows(ST.current_clients(clients, str(tmp_path / "out"))) == want == rows(store.read())
    reasons = {(r["client_id"], r["reason"]) for r in ST.rejected_changes(spark.createDataFrame([r for b in batches for r in b], ST.CHANGE), clients).collect()}
    assert reasons == {(3, "status not allowed"), (9, "client not found"), (None, "client not found"), (5, "no time")}
