import datetime as dt

import pytest
from pyspark.sql import functions as F

from saleslens import schemas as S
from saleslens.operators import transactions as X

D = dt.date


def tx(spark, *records):
    return spark.createDataFrame(
        [(str(i), u, d, a, c, None) for i, (u, d, a, c) in enumerate(records)], S.TRANSACTIONS)


@pytest.fixture
def transactions(spark):
    return tx(
        spark,
        ("gap", D(2023, 1, 5), 10.0, "food"), ("gap", D(2023, 1, 9), 20.0, "travel"), ("gap", D(2023, 4, 1), 60.0, "food"),
        ("one", D(2023, 2, 5), 12.5, "health"),
        ("tie", D(2023, 1, 1), 30.0, "travel"), ("tie", D(2023, 2, 1), 30.0, "food"),
        ("zero", D(2023, 1, 1), 0.0, "food"), ("zero", D(2023, 2, 1), 50.0, "food"), ("zero", D(2023, 3, 1), 25.0, "food"),
        ("nothing", D(2023, 1, 1), 0.0, "food"), ("nothing", D(2023, 2, 1), 0.0, "travel"),
        ("odd", D(2023, 1, 1), 5.0, "casino"), ("odd", D(2023, 1, 2), 3.0, None), ("odd", None, 2.0, "food"),
        ("unpriced", D(2023, 1, 1), None, "food"),
        (None, D(2023, 1, 1), 9.0, "food"),
    )


def by_user(df):
    return {r["user_id"]: r.asDict() for r in df.collect()}


def test_changes_use_the_previous_active_month(transactions):
    v12 = by_user(X.transaction_features(transactions))
    skip = by_user(X.transaction_features(transactions, change_variant="skip_first"))
    assert v12["gap"]["variacion_mensual_promedio"] == 15.0 and skip["gap"]["variacion_mensual_promedio"] == 30.0
    assert v12["gap"]["variacion_mensual_promedio_pct"] == 0.5 and skip["gap"]["variacion_mensual_promedio_pct"] == 1.0
    assert v12["one"]["variacion_mensual_promedio"] == 0.0 and skip["one"]["variacion_mensual_promedio"] is None
    assert skip["one"]["variacion_mensual_promedio_pct"] is None


def test_a_month_without_spend_gives_no_relative_change(transactions):
    v12 = by_user(X.transaction_features(transactions))
    skip = by_user(X.transaction_features(transactions, change_variant="skip_first"))
    assert v12["zero"]["variacion_mensual_promedio_pct"] == -0.25
    assert skip["zero"]["variacion_mensual_promedio_pct"] == -0.5
    assert v12["nothing"]["variacion_mensual_promedio_pct"] == 0.0


def test_ties(transactions):
    first = by_user(X.transaction_features(transactions))["tie"]
    joined = by_user(X.transaction_features(transactions, ties="joined"))["tie"]
    assert (first["categoria_favorita"], first["categoria_favorita_monto"], first["total_spend_fav"]) == ("food", "food", 30.0)
    assert joined["categoria_favorita"] == joined["categoria_favorita_monto"] == "food + travel"
    assert (joined["total_spend_fav"], joined["share_fav"]) == (60.0, 1.0)
    assert first["mes_mas_compras"] == first["mes_mayor_monto"] == D(2023, 1, 1)


def test_concentration_and_shares(transactions):
    got = by_user(X.transaction_features(transactions))
    assert got["one"]["hhi"] == 1.0 and got["tie"]["hhi"] == 0.5
    assert got["nothing"]["hhi"] == 0.0 and got["nothing"]["share_fav"] is None
    for r in got.values():
        assert 0 <= r["hhi"] <= 1


def test_rows_outside_the_domain_count_in_the_totals(transactions):
    odd = by_user(X.transaction_features(transactions))["odd"]
    assert odd["total_transacciones"] == 3 and odd["total_spend"] == 10.0 and odd["food_count"] == 1
    assert odd["n_meses_activos"] == 1 and odd["mes_mayor_monto"] == D(2023, 1, 1)
    wider = by_user(X.transaction_features(transactions, categories=[*S.MERCHANT_CATEGORIES, "casino"]))["odd"]
    assert wider["casino_count"] == 1 and wider["categoria_favorita_monto"] == "casino"


def test_missing_amounts_and_customers(transactions):
    got = by_user(X.transaction_features(transactions))
    assert None not in got
    assert got["unpriced"]["total_transacciones"] == 1 and got["unpriced"]["monto_promedio_transaccion"] is None


def test_recency_and_averages(transactions):
    gap = by_user(X.transaction_features(transactions, "2024-01-01"))["gap"]
    assert gap["recencia_transaccion"] == (D(2024, 1, 1) - D(2023, 4, 1)).days
    assert gap["n_meses_activos"] == 2 and gap["monto_promedio_mensual"] == 45.0
    assert gap["transacciones_promedio_mensual"] == 1.5 and gap["monto_promedio_transaccion"] == 30.0


def test_no_transactions_at_all(spark):
    assert X.transaction_features(tx(spark).limit(0)).count() == 0


def test_only_sums_are_shuffled_and_no_order_is_global(transactions):
    plan = X.transaction_features(transactions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in plan and "partial_sum" in plan


@pytest.mark.parametrize("ties", ["first", "joined"])
def test_months_are_summed_in_fixed_width(transactions, ties):
    plan = X.transaction_features(transactions, ties=ties)._jdf.queryExecution().executedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(plan) if "Window [" in line)
    above = [line for line in plan[:window] if "Aggregate(" in line]
    assert "HashAggregate(" in above[-1] and "ObjectHash" not in above[-1]


def test_many_winners_at_once(spark):
    records = [(f"u{i % 50}", D(2023, 1 + i % 3, 1), 10.0, f"c{i // 50 % 4}") for i in range(400)]
    got = by_user(X.transaction_features(tx(spark, *records, ("u1", D(2023, 5, 1), 90.0, "z")), ties="joined"))
    assert len(got) == 50 and got["u0"]["categoria_favorita"] == got["u0"]["categoria_favorita_monto"] == "c0 + c1 + c2 + c3"
    assert got["u0"]["total_spend_fav"] == got["u0"]["total_spend"] == 80.0 and got["u0"]["total_transacciones"] == 8
    assert (got["u1"]["categoria_favorita"], got["u1"]["categoria_favorita_monto"]) == ("c0 + c1 + c2 + c3", "z")
    assert got["u1"]["total_spend_fav"] == 90.0 and got["u1"]["n_meses_activos"] == 4


def test_hot_customer(spark):
    days = spark.range(30000).select(
        F.col("id").cast("string").alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 97).cast("string"))).alias("user_id"),
        F.date_add(F.lit("2022-01-01"), (F.col("id") % 365).cast("int")).alias("date"), F.lit(0.1).alias("amount"),
        F.when(F.col("id") % 2 == 0, "food").otherwise("travel").alias("merchant_category"), F.lit(None).cast("string").alias("description"))
    hot = by_user(X.transaction_features(days))["hot"]
    assert hot["total_transacciones"] == 10000 and hot["total_spend"] == 1000.0 and hot["n_meses_activos"] == 12
    assert sum(hot[f"{c}_count"] for c in S.MERCHANT_CATEGORIES) == 10000


def test_long_form_matches(transactions):
    rows = {(r["user_id"], r["merchant_category"]): r["total_spend_cat"] for r in X.by_customer_category(transactions).collect()}
    assert rows[("odd", "casino")] == 5.0 and rows[("gap", "food")] == 70.0
    assert {r["merchant_category"] for r in X.best_category_rows(transactions).where("user_id = 'tie'").collect()} == {"food", "travel"}
    named = transactions.sparkSession.createDataFrame([("tie", "food + travel"), ("gap", "food")], "user_id string, cats string")
    got = by_user(X.spend_in_named(transactions, named, "cats"))
    assert got["tie"]["total_spend_fav"] == 60.0 and got["gap"]["total_spend_fav"] == 70.0


def test_tasks_follow_the_files(spark, transactions, tmp_path, monkeypatch):
    from saleslens import session

    folder = str(tmp_path / "a b=1")  # names that are encoded in a list of files
    X.monthly_by_category(transactions).write.parquet(folder)
    monthly = spark.read.parquet(folder)
    assert session.pieces_for(monthly) is None
    want = sorted(map(str, X.by_month_and_category(monthly).collect()))
    monkeypatch.setattr(session, "INPUT_PER_TASK", 100)
    pieces = session.pieces_for(monthly)
    assert pieces > int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = X.by_month_and_category(monthly)
    assert f", {pieces})" in sums._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, sums.collect())) == want
