import datetime as dt

import pytest

from saleslens import schemas as S
from saleslens.operators import dashboard as D
from saleslens.operators import merge as M

T = dt.datetime


@pytest.fixture
def clients(spark):
    data = [  # id, age, income, risk, segment, status, probability
        (1, 18, "0-50k", "conservative", "a", "pending", None),
        (2, 30, "50k-100k", "moderate", None, None, 0.0),
        (3, 50, "150k+", "aggressive", "a", "contacted", 0.2),
        (4, 51, "150k+", "other", "b", "contacted", 0.4),
        (5, 70, None, "moderate", "b", "converted", 0.7),
        (6, 17, "0-50k", "moderate", "b", "pending", 1.0),
        (7, 40, "0-50k", "moderate", "b", "pending", 0.7),
    ]
    return spark.createDataFrame(data, "id long, age int, income_range string, risk_profile string, segment string,"
                                       " status string, probability double").selectExpr("*", "CAST(id AS string) AS user_id")


@pytest.fixture
def contacts(spark):
    data = [
        (1, 1, T(2024, 1, 1, 9), "success"), (2, 1, T(2024, 1, 1, 10), None), (3, 2, T(2024, 1, 1, 11), "martian"),
        (4, 2, T(2024, 1, 3, 0), "pending"), (5, 2, T(2024, 1, 3, 23), "unreachable"), (6, 3, None, "success"),
    ]
    return spark.createDataFrame(data, "id long, client_id long, contacted_at timestamp, outcome string")


def test_order_of_the_list(clients):
    got = [(r["id"], r["probability"], r["priority"], r["status"]) for r in D.priority_list(clients, 1, 4).collect()]
    assert got == [(1, 0.0, "low", "pending"), (6, 1.0, "high", "pending"), (5, 0.7, "medium", "converted"), (7, 0.7, "medium", "pending")]
    assert [r["id"] for r in D.priority_list(clients, 2, 4).collect()] == [4, 3, 2]


def test_pages_by_key_and_by_number_are_the_same(clients):
    numbered = [r["id"] for page in range(1, 8) for r in D.ranked_page(clients, page, 1).collect()]
    walked, after = [], None
    while True:
        row = D.ranked_page(clients, 1, 1, after).first()
        if row is None:
            break
        walked.append(row["id"])
        after = (row["probability"], row["id"])
    assert walked == numbered


@pytest.mark.parametrize("page,size", [(0, 10), (1, 0), (1, 101)])
def test_page_limits(clients, page, size):
    with pytest.raises(ValueError):
        D.ranked_page(clients, page, size)


def test_histogram_loses_exactly_one(clients):
    got = {r["range"]: (r["count"], r["percentage"]) for r in D.probability_histogram(clients).collect()}
    assert [got[k][0] for k in ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")] == [1, 1, 1, 2, 0]
    assert got["0-20%"][1] == 16.67
    closed = {r["range"]: r["count"] for r in D.probability_histogram(clients, include_upper=True).collect()}
    assert closed["80-100%"] == 1
    assert D.missing_probabilities(clients).first()[0] == 1


def test_empty_tables(clients, contacts):
    none = clients.limit(0)
    assert {r["percentage"] for r in D.probability_histogram(none).collect()} == {0.0}
    assert D.kpi_summary(none, contacts.limit(0)).first().asDict() == {
        "total_clients": 0, "churn_risk_mean": 0.0, "at_risk_count": 0, "conversion_rate": 0.0, "contacted": 0}
    assert D.contact_progress(contacts.limit(0)).count() == 0


def test_kpis(clients, contacts):
    got = D.kpi_summary(clients, contacts, 0.7).first()
    assert (got["total_clients"], got["contacted"], got["at_risk_count"]) == (7, 6, 3)
    business = D.business_kpis(clients).first()
    assert (business["potential_clients"], business["expected_conversion"], business["financial_opportunity"], business["contacted"]) == (4, 0, 4000, 3)


def test_heatmap_names_missing_values(clients):
    got = {(r["x"], r["y"]): r["value"] for r in D.heatmap(clients, "income_range", "segment").collect()}
    assert got[("50k-100k", "N/A")] == 1 and got[("N/A", "b")] == 1 and sum(got.values()) == 7
    with pytest.raises(ValueError):
        D.heatmap(clients, "status", "age")


def test_banded_heatmap_is_dense(clients):
    counts = D.banded_heatmap(clients, "age", "risk_profile", "count").collect()
    assert len(counts) == 15 and sum(r["value"] for r in counts) == 6
    by_cell = {(r["x"], r["y"]): r["value"] for r in counts}
    assert by_cell[("56+", "moderate")] == 2
    means = D.banded_heatmap(clients, "income_range", "status").collect()
    assert all(0 <= r["value"] <= 1 for r in means)
    matrix = D.banded_matrix(clients, "income_range", "status", "count")
    assert matrix.columns[2:] == S.HEATMAP_BANDS["income_range"] and matrix.count() == 2
    for x, y, metric in (("priority", "age", "count"), ("age", "segment", "count"), ("age", "status", "median")):
        with pytest.raises(ValueError):
            D.banded_heatmap(clients, x, y, metric)


def test_contacts_of_unknown_outcome_are_added_up(contacts):
    got = {str(r["date"]): r.asDict() for r in D.contact_progress(contacts).collect()}
    assert set(got) == {"2024-01-01", "2024-01-03"}
    assert (got["2024-01-01"]["other"], got["2024-01-01"]["success"], got["2024-01-03"]["pending"]) == (2, 1, 1)


def test_end_date_is_midnight_unless_asked(contacts):
    assert D.contact_progress(contacts, end="2024-01-03").where("date = '2024-01-03'").first()["unreachable"] == 0
    whole = D.contact_progress(contacts, start="2024-01-02", end="2024-01-03", end_inclusive_day=True)
    assert whole.first()["unreachable"] == 1 and whole.count() == 1


@pytest.mark.parametrize("target,day,needed,expected,left,text", [
    (2, "2024-01-10", 0, 0, 21, "¡Meta mensual de 2 contactos alcanzada!"),
    (100, "2024-01-31", 97, 0, 1, "Ritmo actual (0/día) insuficiente. Necesitas 97/día."),
    (4, "2024-02-01", 1, 3, 28, "Ritmo actual (3/día) suficiente para alcanzar la meta."),
])
def test_pace(clients, target, day, needed, expected, left, text):
    got = D.contact_pace(clients, target, day).first()
    assert (got["daily_needed"], got["daily_expected"], got["days_remaining"], got["projection_message"]) == (needed, expected, left, text)
    assert got["difference"] == expected - needed


def test_export(clients):
    rows = D.export_list(D.list_row(clients), statuses=["pending"], risks=["moderate", ""]).collect()
    assert {(r["id"], r["probability"]) for r in rows} == {(2, "0.00"), (6, "1.00"), (7, "0.70")}
    assert D.export_list(D.list_row(clients)).where("id = 5").first()["income_range"] == ""


def test_status_changes(clients, spark):
    with_date = clients.selectExpr("*", "CAST(NULL AS timestamp) AS last_contact_date")
    changes = spark.createDataFrame([
        (1, "contacted", T(2024, 1, 1)), (1, "lost", T(2024, 1, 2)), (1, "contacted", T(2024, 1, 1, 12)),
        (2, "nonsense", T(2024, 1, 1)), (99, "contacted", T(2024, 1, 1)), (3, None, T(2024, 1, 1)),
    ], S.STATUS_CHANGES)
    result = M.apply_status_changes(with_date, changes)
    got = {r["id"]: r for r in result.clients.collect()}
    assert got[1]["status"] == "lost" and got[1]["last_contact_date"] == T(2024, 1, 2)
    assert got[2]["status"] is None and len(got) == 7
    assert sorted(r["client_id"] for r in result.new_contacts.collect()) == [1, 1]
    assert {(r["client_id"], r["reason"]) for r in result.rejected.collect()} == {
        (2, "status not allowed"), (3, "status not allowed"), (99, "client not found")}


def test_upsert_keeps_one_row_per_key(spark):
    base = spark.createDataFrame([("a", 0.1, False, T(2024, 1, 1), "x"), ("b", 0.2, False, T(2024, 1, 1), "y")],
                                 "user_id string, probability double, is_target boolean, created_at timestamp, features string")
    new = spark.createDataFrame([("b", 0.9, True, T(2024, 2, 1)), ("b", 0.5, False, T(2024, 1, 15)), ("c", 0.3, False, T(2024, 2, 1))],
                                S.PREDICTIONS)
    got = {r["user_id"]: (r["probability"], r["features"]) for r in M.upsert_predictions(base, new).collect()}
    assert got == {"a": (0.1, "x"), "b": (0.9, "y"), "c": (0.3, None)}
    plain = {r["user_id"]: r["probability"] for r in M.upsert(base, new, order=["created_at"]).collect()}
    assert plain == {"a": 0.1, "b": 0.9, "c": 0.3}
